from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweir.llm import tokens

from ..conftest import same

TEXTS = [
    "", " ", "\n", "  \n x", "it's we'll 's's ''s", "a\x00b \x00\x00", "naïve café — 東京 123٣½", "tabs\t\tand   spaces  ", "<|endoftext|>", "x" * 70_000 + " y",
    "​­ é 👩‍💻", "ａ１ Ⅷ ²", "   wide　", "\U000e0001 \U0001fae9 ῿z", "_-_=: =>", "a\r\nb\r\n\r\n", "1 22 333", "'", " '", "﷐ ￿",
]


@pytest.fixture(scope="module")
def official():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(tokens.VOCABULARY).with_suffix(".json")))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_tokenizers(spark, official):
    rows = [(i, t, "clash", 1, b"x") for i, t in enumerate([*TEXTS, None, *TEXTS])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, block int, codes binary").repartition(3)
    for size in (1, 1 << 20):
        found = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(df, block_bytes=size).collect()}
        assert found == {i: ids for (i, *_), ids in zip(rows, official([t or "" for _, t, *_ in rows]))}


def test_sample_tables(spark, official):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    reference = {r["doc_id"]: ids for r, ids in zip(rows, official([r["text"] or "" for r in rows]))}
    assert {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(df).collect()} == reference
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {k: len(v) for k, v in reference.items()}


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None)], "doc_id bigint, text string")
    back = tokens.decode_corpus(tokens.encode_corpus(df))
    same(back, [(1, "a b"), (1, "a b"), (None, "a"), (2, "")], ["doc_id", "text"])
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert tokens.count_tokens(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=5))
def test_split_is_the_pattern(texts):
    import regex

    words, counts = tokens.split_words(pa.array(texts))
    expected = [regex.findall(tokens.PATTERN, t) for t in texts]
    assert words.to_pylist() == [w for e in expected for w in e]
    assert counts.tolist() == [len(e) for e in expected]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**31 - 1), max_size=6), max_size=6))
def test_varint_round_trip(lists):
    counts = np.array([len(x) for x in lists], np.int64)
    packed = tokens.pack_varint(np.array([i for x in lists for i in x], np.int64), counts)
    codes, back = tokens.unpack_varint(packed)
    assert codes.tolist() == [i for x in lists for i in x] and back.tolist() == counts.tolist()
    codes, back = tokens.unpack_varint(packed.slice(len(lists) // 2))
    assert codes.tolist() == [i for x in lists[len(lists) // 2 :] for i in x]


def test_words_of_many_tasks_are_salted(spark, monkeypatch):
    """Half of all words are one word: with a salt a task it is encoded more often, with the same ids."""
    from tallyweir.llm import tokens

    df = spark.createDataFrame([(i, "the the the cat" if i % 2 else f"dog {i}") for i in range(40)], "doc_id bigint, text string").repartition(4)
    plain = sorted(tuple(r) for r in tokens.encode_corpus(df).collect())
    monkeypatch.setattr(tokens, "WORD_TASKS", 1)
    assert sorted(tuple(r) for r in tokens.encode_corpus(df).collect()) == plain
