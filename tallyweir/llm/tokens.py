"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 6).

Pre-tokenisation runs in compiled Arrow kernels. Each block of texts keeps its
documents as codes into the block's own list of distinct words; only (word, block,
code) is shuffled by word, so every distinct word of the corpus is encoded once and
its rows are as many as blocks, however often it occurs. The ids travel back to the
blocks, where positions put them in order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from ..tables import load

#: Ranks of the vocabulary, one "base64 rank" a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text whose distinct words are listed together.
BLOCK_BYTES = 16 << 20
PIECE_BYTES = 8 << 20
#: Tasks whose blocks' rows of one word go to one task; more tasks encode the word again.
WORD_TASKS = 1024

# The pattern that public byte-level BPE vocabularies are made for, and Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_MARK = "\x00"
# A run of white space leaves its last character to the word after it.
_LAST_SPACE = rf"([{SPACE}]+)([{SPACE}][^{SPACE}])"
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}\x00]+|[{SPACE}]+"
_EMPTY = pa.array([], pa.string())


@lru_cache(1)
def _slow_pattern():
    import regex

    return regex.compile(PATTERN)


# What the compiled pattern can't be trusted with: the mark, and code points that its Unicode tables don't know.
_ODD = r"[\x00]|[^\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]"


def split_words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """Pre-tokens of all texts, one after another, and how many each text has (null: none).

    Texts with the mark, or with code points that the compiled kernels' Unicode tables
    don't have, are split by the reference pattern instead.
    """
    texts = pc.fill_null(texts, "")
    marked = pc.replace_substring_regex(pc.replace_substring_regex(texts, _LAST_SPACE, rf"\1{_MARK}\2"), _WORD, rf"\0{_MARK}")
    parts = pc.split_pattern(marked, _MARK)
    words = parts.flatten()
    full = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    counts = np.diff(kept[ends])
    words = words.filter(full)
    odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
    if not len(odd):
        return words, counts
    starts = np.concatenate([[0], np.cumsum(counts)])
    pieces, at = [], 0
    for i in odd:
        pieces.append(words.slice(starts[at], starts[i] - starts[at]))
        own = _slow_pattern().findall(texts[int(i)].as_py())
        pieces.append(pa.array(own, pa.string()) if own else _EMPTY)
        counts[i] = len(own)
        at = i + 1
    pieces.append(words.slice(starts[at]))
    return pa.concat_arrays(pieces), counts


def distinct_codes(words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The distinct words, most frequent first, and each word's place among them."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[codes]


def pack_varint(codes: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """One binary value for each ``counts`` codes, seven bits a byte, low bits first."""
    codes = codes.astype(np.uint64)
    width = np.ones(len(codes), np.int64)
    for bits in (7, 14, 21, 28):
        width += codes >= (1 << bits)
    ends = np.cumsum(width)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - width
    for k in range(5):
        more = np.flatnonzero(width > k)
        if not len(more):
            break
        data[starts[more] + k] = ((codes[more] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(width[more] > k + 1, 128, 0).astype(np.uint64)
    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def unpack_varint(packed: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all values, and how many each value has."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(packed) and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    last = data < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    codes = np.zeros(len(ends), np.int64)
    for k in range(5):
        here = starts + k <= ends
        if not here.any():
            break
        codes[here] |= (data[starts[here] + k] & 127).astype(np.int64) << (7 * k)
    before = np.concatenate([[0], np.cumsum(last)])
    return codes, np.diff(before[offsets - offsets[0]])


class Vocabulary:
    """Token ids of single pre-tokens, by the ranks of a public vocabulary."""

    def __init__(self, lines: bytes):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, words: pa.StringArray) -> list[list[int]]:
        return list(map(self.encoding.encode_ordinary, words.to_pylist()))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.StringArray:
        """Texts of so many ids each, by gathering from the table of token bytes."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


_vocabularies: dict[int, Vocabulary] = {}


def vocabulary(lines: Broadcast) -> Vocabulary:
    """The vocabulary of this Python process, made once."""
    key = hash(lines.value)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(lines.value)
    return _vocabularies[key]


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, under 2 MB whatever the corpus, for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes, so that long texts don't multiply in one task's memory."""
    step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for piece in pieces(batch, limit):
            held.append(piece)
            size += piece.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_BLOCK_ROW = "block bigint, doc_id bigint, codes binary, code int, word string"


def block_codes(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds: (block, doc_id, codes) of each document and (block, code, word) of each word of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, table in enumerate(_blocks(batches, block_bytes)):
            block = (task << 32) | k
            words, counts = split_words(table.column("text").combine_chunks())
            distinct, codes = distinct_codes(words)
            n, m = table.num_rows, len(distinct)
            docs = pa.table({"block": pa.array(np.full(n, block)), "doc_id": table.column("doc_id"), "codes": pack_varint(codes, counts), "code": pa.nulls(n, pa.int32()), "word": pa.nulls(n, pa.string())})
            yield from docs.to_batches(max_chunksize=5_000)
            listed = pa.table({"block": pa.array(np.full(m, block)), "doc_id": pa.nulls(m, pa.int64()), "codes": pa.nulls(m, pa.binary()), "code": pa.array(np.arange(m, dtype=np.int32)), "word": distinct})
            yield from listed.to_batches(max_chunksize=50_000)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _BLOCK_ROW)


def _encode_words(lines: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, last, last_ids = vocabulary(lines), None, []
        for batch in batches:  # sorted by word: equal words are neighbours
            coded = batch.column("word").dictionary_encode()
            distinct = coded.dictionary
            if len(distinct) and distinct[0].as_py() == last:
                ids = [last_ids, *vocab.encode(distinct.slice(1))]
            else:
                ids = vocab.encode(distinct)
            last, last_ids = distinct[-1].as_py(), ids[-1]
            counts = np.array([len(x) for x in ids])
            flat = np.fromiter((i for x in ids for i in x), np.int64, counts.sum())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("code"), pack_varint(flat, counts).take(coded.indices)], names=["block", "code", "ids"])

    return run


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code's run, one after another, and each run's length."""
    lengths = counts[codes]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(total)], lengths


def _reassemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    code = words.column("code").to_numpy()
    flat, counts = unpack_varint(words.column("ids").combine_chunks())
    starts = np.cumsum(counts) - counts
    own_counts, own_starts = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    own_counts[code], own_starts[code] = counts, starts
    codes, per_doc = unpack_varint(docs.column("codes").combine_chunks())
    ids, lengths = _gather(flat, own_starts, own_counts, codes)
    before = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(per_doc)])]
    return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))})


def encode_corpus(documents: DataFrame, path: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and ids (array<int>) of each row: its text's token ids without special tokens.

    Null and empty texts have the empty list; every row of a repeated doc_id comes out;
    other columns are ignored. Texts are encoded whole. A block is read once; besides
    its codes (about 1.3 bytes a pre-token) only its distinct words are shuffled.
    """
    lines = share_vocabulary(documents.sparkSession, path)
    blocks = written(block_codes(documents, block_bytes), "codes")
    listed = blocks.filter(F.col("word").isNotNull()).select("word", "block", "code")
    # A frequent word has a row in every block; blocks of a thousand tasks are enough for one task to encode it for.
    encoded = listed.repartition("word", F.floor(F.shiftright("block", 32) / WORD_TASKS)).sortWithinPartitions("word").mapInArrow(_encode_words(lines), "block bigint, code int, ids binary")
    docs = blocks.filter(F.col("codes").isNotNull()).select("block", "doc_id", "codes")
    return docs.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_reassemble, "doc_id bigint, ids array<int>")


def decode_corpus(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of token ids. The table of token bytes is the vocabulary itself, so it goes to every task."""
    lines = share_vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            counts = np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), vocabulary(lines).decode(lists.flatten().to_numpy(), counts)], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def count_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each row, without a shuffle: of a batch, each distinct word is measured once."""
    lines = share_vocabulary(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(lines)
        for batch in (p for b in batches for p in pieces(b, PIECE_BYTES)):
            words, counts = split_words(batch.column("text"))
            coded = words.dictionary_encode()
            lengths = np.array([len(x) for x in vocab.encode(coded.dictionary)], np.int64)
            total = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy(zero_copy_only=False)])])
            sums = np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; null texts come back empty."""
    return decode_corpus(p6_ids(spark, sf_dir))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
SQL = {"p6_decoded": "select doc_id, coalesce(text, '') as text from documents"}
