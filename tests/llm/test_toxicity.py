from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tallyweir.llm import toxicity
from tallyweir.llm.toxicity import Model, fit, fold, grade_labels, score, train

from ..conftest import same

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("word,plain", [("1D10T", "idiot"), ("ｘｘｘ", "xx"), ("fffuck", "ffuck"), ("gаrbаgе", "garbage"), ("Crétin", "cretin"), ("can't", "cant"), ("53x", "sex"), ("1234", "0"), ("load_queue", "_"), ("6b26a990eb6", "_"), ("", "0"), ("_idiot_", "idiot"), ("__1d10t__", "idiot"), ("___", "0")])
def test_fold(word, plain):
    assert fold(word) == plain


def test_spelling_tricks_are_undone():
    texts = pa.array(["send x x x now", "w​o​men", "f-o-r-e-i-g-n-e-r-s!", None, "", " \n "])
    batch = toxicity.Batch(texts)
    words = [[batch.words[c] for c in batch.codes[batch.doc == i]] for i in range(6)]
    assert words == [["send", "xx", "now"], ["women"], ["foreigners"], [], [], []]


def test_held_out_accuracy(spark):
    """Half of the reviewed documents of sf0.1 train; of the rest one half chose the settings and the other is reported.

    About one toxic review in seven is on a harmless text, so no model can reach a recall of 0.9 against the reviews.
    """
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    graded = grade_labels(labels).join(documents.filter("text is not null").select("doc_id", "text"), "doc_id").orderBy("doc_id").collect()
    texts, grades = pa.array([r["text"] for r in graded]), np.array([r["grade"] for r in graded])
    part = np.array([r["doc_id"] for r in graded]) * 2654435761 % 2**31 % 4
    model = train(texts.filter(pa.array(part < 2)), grades[part < 2])
    rest = texts.filter(pa.array(part == 3))
    p, toxic = model.at_least(model.latent(rest))[:, 0], grades[part == 3] > 0
    found = p >= toxicity.CASE
    f1 = 2 * (found & toxic).sum() / (found.sum() + toxic.sum())
    # A random positive is above a random negative.
    order = np.argsort(np.argsort(p))
    auc = (order[toxic].mean() - order[~toxic].mean()) / len(p) + 0.5
    assert f1 > 0.6 and auc > 0.85
    # Probabilities of higher grades are never larger.
    assert (np.diff(model.at_least(model.latent(rest)), axis=1) <= 1e-12).all()


def test_worst_sentence_decides():
    bad, good = "you stupid fool", "the build is green"
    texts = [f"{bad}.", f"{bad}!", f"{good}. {bad}.", good, f"{good}.", "the cache is cold", f"{good}\nthe cache is cold"] * 4
    grades = np.array([2, 2, 2, 0, 0, 0, 0] * 4)
    model = train(pa.array(texts), grades, rounds=60)
    p = model.at_least(model.latent(pa.array([bad, f"{good}. " * 500 + bad, good, "", None])))[:, 0]
    assert p[0] > 0.5 and p[0] == pytest.approx(p[1]) and p[2] < 0.5 and p[3] == p[4] < 1e-100


def test_labels_nulls_and_repeats(spark):
    rows = [(1, 1, "abusive", "a"), (1, 1, "abusive", "a"), (2, 1, None, "a"), (3, 0, None, "a"), (3, 1, "sexual", "b"), (4, 0, None, "a"), (None, 1, "x", "a"), (5, None, "x", "a")]
    labels = spark.createDataFrame([(*r, None) for r in rows], "doc_id bigint, toxic bigint, category string, reviewer string, reviewed_at timestamp")
    same(grade_labels(labels), [(1, 2), (2, 2), (3, 1), (4, 0)], ["doc_id", "grade"])


def test_edge_cases(spark, tmp_path):
    documents = spark.createDataFrame([(1, "x", "s", 1.0), (1, "x", None, 1.0), (2, None, "s", 1.0), (3, " ", "s", 1.0), (4, "long " * 100_000, "s", 1.0)], "doc_id bigint, text string, source string, severity double")
    labels = spark.createDataFrame([], "doc_id bigint, toxic bigint, category string, reviewer string, reviewed_at timestamp")
    model = fit(documents, labels)
    assert [r["p_toxic"] for r in score(documents, model).collect()] == [pytest.approx(0, abs=1e-12)] * 5
    assert score(documents.limit(0), model).count() == 0
    toxicity.save_model(spark, Model(np.arange(toxicity.BUCKETS, dtype=np.float32), np.array([0.5, 1.5])), str(tmp_path / "model"))
    again = toxicity.load_model(spark, str(tmp_path / "model"))
    assert again.weights[7] == 7 and again.thresholds.tolist() == [0.5, 1.5]
    assert isinstance(train(pa.array([], pa.string()), np.array([], np.int64)), Model)
    assert isinstance(train(pa.array(["", " "]), np.array([2, 0])), Model)
