"""Scores for abusive, hateful or sexual content (problem 8).

A cumulative-link (proportional odds) model over sparse text features: one weight
vector, shared by the ordered thresholds of the severity grades; the score of a text
is its expected severity. Grades come from the reviews: 0 none, 1 contested (reviewers
disagree), 2 unanimous. A missing category is missing metadata and changes no grade.

An insult is a sentence, not a document, so sentences are scored and a document has
the score of its worst one; in training, a document's gradient goes to its worst
sentences (multiple-instance learning). Features are hashed: words, word pairs and
triples within a sentence, and letter n-grams of each word, after spelling tricks
(letter look-alikes, digits for letters, spaced letters, invisible characters) are
undone. Words are normalised once per distinct word of a batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from .tokens import pieces

#: Labelled documents that the model is fitted on at most: those with the least hash of doc_id.
SAMPLE = 20_000
#: Bytes of text that are scored at once.
SCORED_BYTES = 4 << 20
#: Buckets of the weight vector: 4 MB, whatever the corpus.
BUCKETS = 1 << 20
GRADES = 3
ROUNDS = 80
#: All sentences are scored again after so many rounds; between, those with at least LEAST_PART in their document's gradient.
WHOLE_PASS = 10
LEAST_PART = 0.01
#: Probability of at least a doubtful grade from which on a document is a case.
CASE = 0.5

# Letters that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁһԛԝɡαεικνορτυχ", "abekmhopctyxijsdhqwgaeikvoptux")
LEET = str.maketrans("0134578@$!|+", "oieastbasilt")
#: Characters that aren't seen.
_HIDDEN = "[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]"
# Single letters one after another: x x x, f-o-r-e-i-g-n.
_SPACED = r"(?:^|[^\p{L}\p{N}])\p{L}(?:[ .*_\-]\p{L}){2,}(?:[^\p{L}\p{N}]|$)"
_ODD = rf"{_SPACED}|[\x{{ad}}\x{{34f}}\x{{61c}}\x{{115f}}\x{{1160}}\x{{17b4}}\x{{17b5}}\x{{180b}}-\x{{180e}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{206f}}\x{{fe00}}-\x{{fe0f}}\x{{feff}}]"
_HIDDEN_RE = regex.compile(_HIDDEN)
_SPACED_RE = regex.compile(r"(?<![\p{L}\p{N}])\p{L}(?:[ .*_\-]\p{L}){2,}(?![\p{L}\p{N}])")
_STOP = "\x01"
_SENTENCE_END = r"[.!?…]+(?:\s|$)|[\n\r\x{2028}\x{2029}]+"
_NOT_WORD = r"[^\p{L}\p{M}\p{N}_@$*'’\x01]+"
_HEX = regex.compile(r"(?=.*[0-9])[0-9a-f]{7,}")
_RUNS = regex.compile(r"(.)\1{2,}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(word: str) -> str:
    """A word's normal form; numbers and program names become placeholders."""
    if word.isascii() and word.isalpha():
        return _RUNS.sub(r"\1\1", word.lower())
    word = unicodedata.normalize("NFKD", word).casefold().translate(LOOKALIKES).strip("_")  # _word_ is emphasis
    word = "".join(c for c in word if not unicodedata.combining(c) and c not in "'’")
    if not word or word.isdigit():
        return "0"
    if "_" in word or _HEX.fullmatch(word):
        return "_"
    if not word.isalpha():
        word = word.translate(LEET)
    return _RUNS.sub(r"\1\1", word)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _bucket(x: np.ndarray) -> np.ndarray:
    return (_mix(x) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _word_hash(words: list[str]) -> np.ndarray:
    """64-bit polynomial hashes of words, over all bytes at once."""
    data = [w.encode() for w in words]
    lengths = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, 0x100000001B3, np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(flat * powers[place]), dtype=np.uint64)])
    ends = np.cumsum(lengths)
    return _mix(total[ends] - total[ends - lengths] + lengths.astype(np.uint64))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter 3- and 4-grams of each word with its borders, and the word's index of each."""
    data = [b"<" + w.encode() + b">" for w in words]
    lengths = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))  # bytes to the word's end
    buckets, owners = [], []
    for n in (3, 4):
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + flat[at + k]
        buckets.append(_bucket(code + np.uint64(1 << 60)))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


class Batch:
    """The sentences of texts: word codes, and where sentences and documents begin."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        if len(odd):
            plain = texts.to_pylist()
            for i in odd:
                plain[i] = _SPACED_RE.sub(lambda m: "".join(c for c in m.group() if c.isalpha()), _HIDDEN_RE.sub("", plain[i]))
            texts = pa.array(plain, pa.string())
        marked = pc.replace_substring_regex(texts, _SENTENCE_END, f" {_STOP} ")
        parts = pc.split_pattern(pc.replace_substring_regex(marked, _NOT_WORD, "\x00"), "\x00")
        coded = parts.flatten().dictionary_encode()
        raw = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        folded = ["" if w == "" else _STOP if _STOP in w else fold(w) for w in raw]
        names = {w: i for i, w in enumerate(dict.fromkeys(folded))}
        self.words = list(names)
        codes = np.array([names[w] for w in folded], np.int64)[codes] if raw else codes.astype(np.int64)
        stop, empty = names.get(_STOP, -1), names.get("", -1)
        sentence = np.cumsum((codes == stop) | np.concatenate([[True], doc[1:] != doc[:-1]]) if len(codes) else codes)
        keep = (codes != stop) & (codes != empty)
        self.codes, self.doc, sentence = codes[keep], doc[keep], sentence[keep]
        new = np.concatenate([[True], sentence[1:] != sentence[:-1]]) if len(sentence) else np.empty(0, bool)
        self.sentence = np.cumsum(new) - 1
        self.starts = np.flatnonzero(new)
        self.sentence_doc = self.doc[self.starts]
        self.hashes = _word_hash(self.words) if self.words else np.empty(0, np.uint64)
        self.n_docs = len(texts)

    def word_features(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of words, pairs and triples, and the sentence of each."""
        h, s = self.hashes[self.codes], self.sentence
        two = s[1:] == s[:-1]
        pair = _mix(h[:-1]) + h[1:] * np.uint64(3)
        three = two[1:] & two[:-1]
        triple = _mix(pair[:-1]) + h[2:] * np.uint64(5)
        return np.concatenate([_bucket(h), _bucket(pair[two]), _bucket(triple[three])]), np.concatenate([s, s[1:][two], s[2:][three]])


def _gram_weight(owners: np.ndarray, n: int) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(1, np.bincount(owners, minlength=n)))


class Model:
    """Weights, thresholds and the scores that follow from them."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def latent(self, texts: pa.Array) -> np.ndarray:
        """Of each text, the greatest linear score of its sentences; -inf without words."""
        b = Batch(texts)
        worst = np.full(b.n_docs, -np.inf)
        if not len(b.codes):
            return worst
        buckets, sentence = b.word_features()
        score = np.bincount(sentence, weights=self.weights[buckets], minlength=len(b.starts))
        grams, owners = _grams(b.words)
        own = np.bincount(owners, weights=self.weights[grams], minlength=len(b.words)) * _gram_weight(owners, len(b.words))
        score += np.bincount(b.sentence, weights=own[b.codes], minlength=len(b.starts))
        first = np.flatnonzero(np.concatenate([[True], b.sentence_doc[1:] != b.sentence_doc[:-1]]))
        worst[b.sentence_doc[first]] = np.maximum.reduceat(score, first)
        return worst

    def at_least(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= j) for each j from 1 on."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -500, 500)))

    def expected(self, latent: np.ndarray) -> np.ndarray:
        return self.at_least(latent).sum(1)


def _design(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct sentences as (sentence, bucket, value), and (document, sentence) pairs."""
    b = Batch(texts)
    h = b.hashes[b.codes]
    place = np.arange(len(h)) - b.starts[b.sentence] if len(h) else np.empty(0, np.int64)
    name = np.zeros(len(b.starts), np.uint64)
    np.add.at(name, b.sentence, _mix(h + place.astype(np.uint64) * _MIX))
    _, first, same = np.unique(name, return_index=True, return_inverse=True)
    is_first = np.zeros(len(b.starts), bool)
    is_first[first] = True
    buckets, sentence = b.word_features()
    keep = is_first[sentence]
    rows, cols, vals = [same[sentence[keep]]], [buckets[keep]], [np.ones(keep.sum())]
    grams, owners = _grams(b.words) if b.words else (np.empty(0, np.int64), np.empty(0, np.int64))
    order = np.argsort(owners, kind="stable")
    grams, scale, each = grams[order], _gram_weight(owners, len(b.words)), np.bincount(owners, minlength=len(b.words))
    begin = np.cumsum(each) - each
    tokens = is_first[b.sentence]
    code, home = b.codes[tokens], same[b.sentence[tokens]]
    n = each[code]
    ends = np.cumsum(n)
    rows.append(np.repeat(home, n))
    cols.append(grams[np.repeat(begin[code] - (ends - n), n) + np.arange(n.sum())])
    vals.append(np.repeat(scale[code], n))
    pairs = np.unique(np.stack([b.sentence_doc, same]), axis=1) if len(same) else np.zeros((2, 0), np.int64)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), pairs[0], pairs[1], len(first)


def train(texts: pa.Array, grades: np.ndarray, rounds: int = ROUNDS, rate: float = 0.08, decay: float = 1e-4) -> Model:
    """Fit the cumulative-link model by full-batch Adam.

    Deterministic: no random draws. Without a document of a grade above 0, or without
    words, the model scores everything 0. Features of a single distinct sentence are
    left out.
    """
    none = Model(np.zeros(BUCKETS, np.float32), np.full(GRADES - 1, 50.0))
    if not len(grades) or not (grades > 0).any():
        return none
    row, col, val, doc, sent, n_sent = _design(texts)
    if not len(doc):
        return none
    code = np.unique(row * BUCKETS + col, return_index=True)
    row, col = code[0] // BUCKETS, code[0] % BUCKETS
    val = np.bincount(np.searchsorted(code[0], row * BUCKETS + col), minlength=len(row)) * val[code[1]]
    used, where, often = np.unique(col, return_inverse=True, return_counts=True)
    keep = often[where] > 1
    row, where, val = row[keep], where[keep], val[keep].astype(np.float64)
    has = np.unique(doc)
    first = np.searchsorted(doc, has)
    y = grades[has]
    of = np.repeat(np.arange(len(has)), np.diff(np.append(first, len(doc))))
    share = np.array([(y >= j).mean() for j in range(1, GRADES)]).clip(1e-4, 1 - 1e-4)
    w, theta = np.zeros(len(used)), np.log((1 - share) / share)
    m, v, mt, vt = np.zeros(len(used)), np.zeros(len(used)), np.zeros(GRADES - 1), np.zeros(GRADES - 1)
    target = np.stack([y >= j for j in range(1, GRADES)], 1)
    score = np.zeros(n_sent)
    for t in range(1, rounds + 1):
        # Most sentences never are a document's worst: between whole passes only those with a share in the gradient are scored.
        if t % WHOLE_PASS == 1:
            live, live_where, live_val = row, where, val
            score = np.bincount(row, weights=w[where] * val, minlength=n_sent)
        else:
            score[active] = np.bincount(live, weights=w[live_where] * live_val, minlength=n_sent)[active]
        own = score[sent]
        worst = np.maximum.reduceat(own, first)
        sharp = 1 + 6 * min(1.0, t / (0.5 * rounds))
        part = np.exp(sharp * (own - worst[of]))
        part /= np.add.reduceat(part, first)[of]
        at_least = 1 / (1 + np.exp(np.clip(theta[None, :] - worst[:, None], -500, 500)))
        # Log likelihood of grade g is log(P(>=g) - P(>=g+1)); its gradient by the latent score and the thresholds.
        up = np.concatenate([np.ones((len(y), 1)), at_least, np.zeros((len(y), 1))], 1)
        slope = up * (1 - up)
        i = np.arange(len(y))
        p = np.maximum(up[i, y] - up[i, y + 1], 1e-9)
        d = (slope[i, y] - slope[i, y + 1]) / p
        dt = np.zeros((len(y), GRADES + 1))
        dt[i, y] -= slope[i, y] / p
        dt[i, y + 1] += slope[i, y + 1] / p
        if t % WHOLE_PASS == 1:
            active = np.bincount(sent, weights=part > LEAST_PART, minlength=n_sent) > 0
            kept = active[row]
            live, live_where, live_val = row[kept], where[kept], val[kept]
        g_sent = np.bincount(sent, weights=d[of] * part, minlength=n_sent)
        g = np.bincount(live_where, weights=g_sent[live] * live_val, minlength=len(used)) / len(y) - decay * w
        gt = dt[:, 1:GRADES].mean(0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        theta = np.sort(theta + rate * (mt / (1 - 0.9**t)) / (np.sqrt(vt / (1 - 0.99**t)) + 1e-5))
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, theta)


def grade_labels(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each reviewed document: 0 if no review says toxic, 2 if all do, else 1; null reviews don't count."""
    seen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic").distinct()
    each = seen.groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    return each.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.col("hi") <= 0, 0).when(F.col("lo") > 0, 2).otherwise(1).alias("grade"))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents, in one task of an executor."""
    drawn = grade_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(batches).sort_by("doc_id")
        model = train(table.column("text").combine_chunks(), table.column("grade").to_numpy().astype(np.int64))
        used = np.flatnonzero(model.weights).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([used.tobytes()]), pa.array([model.weights[used].tobytes()]), pa.array([model.thresholds.tobytes()])], names=["used", "weights", "thresholds"])

    found = rows.repartition(1).mapInArrow(run, "used binary, weights binary, thresholds binary").first()
    weights = np.zeros(BUCKETS, np.float32)
    if found is None:
        return Model(weights, np.full(GRADES - 1, 50.0))
    weights[np.frombuffer(found["used"], np.int32)] = np.frombuffer(found["weights"], np.float32)
    return Model(weights, np.frombuffer(found["thresholds"]))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Store a model (at most 4 MB) as one row, so that one fit serves many runs of ``score``."""
    row = (bytearray(model.weights.astype(np.float32).tobytes()), bytearray(np.asarray(model.thresholds, np.float64).tobytes()))
    spark.createDataFrame([row], "weights binary, thresholds binary").coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(path).first()
    return Model(np.frombuffer(row["weights"], np.float32), np.frombuffer(row["thresholds"]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, severity (expected grade, 0..2) and p_toxic (of at least a doubtful grade) of each row.

    Whole texts are scored, sentence by sentence, without a shuffle. Null, empty and
    blank texts score 0. Every row of a repeated doc_id comes out.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in pieces(batch, SCORED_BYTES):
                p = own.at_least(own.latent(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(p.sum(1)), pa.array(p[:, 0].copy())], names=["doc_id", "source", "severity", "p_toxic"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source").mapInArrow(run, "doc_id bigint, source string, severity double, p_toxic double")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return score(documents, fit(documents, load(spark, sf_dir, "labels")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter(F.col("p_toxic") >= CASE).select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "severity", "p_toxic")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each source, null included."""
    case = F.col("p_toxic") >= CASE
    return _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(case).alias("n_cases"), F.avg(case.cast("double")).alias("case_rate"), F.avg("severity").alias("mean_severity"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold whatever the model is: each source's documents are all scored, within 0..2, and texts without a word score 0."""
    documents = load(spark, sf_dir, "documents")
    scored = _scored(spark, sf_dir)
    silent = documents.filter(F.col("text").isNull() | ~F.col("text").rlike(r"[\p{L}\p{N}]")).select(F.col("doc_id").alias("_s"))
    joined = scored.join(silent, F.col("doc_id") == F.col("_s"), "left")
    inside = (F.col("severity") >= 0) & (F.col("severity") <= GRADES - 1) & (F.col("p_toxic") >= 0) & (F.col("p_toxic") <= 1) & (F.col("severity") >= F.col("p_toxic"))
    return joined.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(inside).alias("n_inside"), F.count_if(F.col("_s").isNotNull() & (F.col("severity") < 1e-6)).alias("n_silent"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p8_check": p8_check}
SQL = {"p8_check": "select source, count(*) n_documents, count(*) n_inside, count(*) filter (where text is null or not regexp_matches(text, '[\\p{L}\\p{N}]')) n_silent from documents group by 1"}
