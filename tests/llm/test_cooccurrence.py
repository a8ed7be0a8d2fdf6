from __future__ import annotations

import random
from collections import Counter
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest

from tallyweir.llm import cooccurrence
from tallyweir.llm.cooccurrence import block_pairs, commits, pair_counts

from ..conftest import same

PAIR = ["s", "item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets"]


def brute(rows, together=1, lift=0.0):
    n, single, pair = Counter(), Counter(), Counter()
    for scope, items in rows:
        own = sorted({i for i in items or [] if i is not None})
        n[scope] += bool(own)
        single.update((scope, i) for i in own)
        pair.update((scope, *p) for p in combinations(own, 2))
    return [(s, a, b, k, single[s, a], single[s, b], n[s]) for (s, a, b), k in pair.items() if k >= together and k * n[s] >= lift * single[s, a] * single[s, b]]


def baskets(seed, n=600, items=40):
    rng = random.Random(seed)
    names = [f"i{k:02d}" for k in range(items)]
    weights = [1 / (k + 1) for k in range(items)]
    rows = [(rng.choice(["hot", "hot", "cold", None]), rng.choices(names, weights, k=rng.randint(0, 9)) + [None] * (rng.random() < 0.1)) for _ in range(n)]
    return [*rows, ("cold", None), ("hot", []), ("big", names)]


@pytest.mark.parametrize("block", [16, 10_000])
@pytest.mark.parametrize("share,least", [(3, 2), (256, 32), (1, 10**9), (10**9, 0)])
def test_all_splits_into_heavy_and_light_count_alike(spark, monkeypatch, block, share, least):
    monkeypatch.setattr(cooccurrence, "HEAVY_SHARE", share)
    monkeypatch.setattr(cooccurrence, "HEAVY_LEAST", least)
    rows = baskets(1)
    df = spark.createDataFrame(rows, "s string, m array<string>").repartition(3)
    same(pair_counts(df, "s", "m", block=block), brute(rows), PAIR)
    same(pair_counts(df, "s", "m", 6, 1.5, block), brute(rows, 6, 1.5), PAIR)


def test_chunks_do_not_change_counts(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, rng.integers(0, 12))) for _ in range(200)]
    offsets, item = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    expected = Counter(p for r in rows for p in combinations(r.tolist(), 2))
    for chunk in (1, 7, 10**6):
        monkeypatch.setattr(cooccurrence, "CHUNK", chunk)
        for heavy in (np.zeros(30, bool), np.ones(30, bool), np.arange(30) % 3 == 0):
            a, b, n = block_pairs(offsets, item, heavy)
            assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == expected


def test_commits(spark):
    t = [datetime(2025, 1, d) for d in (1, 2, 3)]
    rows = [
        ("AB", "r", [" a ", "b", None, "a", ""], t[0], 9), ("ab ", "r", ["a", "c"], t[1], 1), ("ab", "r", ["a", "c"], t[1], 1),
        ("cd", "r", None, t[0], 0), ("ef", None, ["x"], None, None), (None, "r", ["a", "b"], t[0], 1),
    ]
    df = spark.createDataFrame(rows, "hash string, repo_key string, modules array<string>, ingested_at timestamp, cochange_count bigint")
    same(commits(df), [("ab", "r", ["a", "c"], 1), ("cd", "r", [], 0), ("ef", None, ["x"], None)], ["hash", "repo_key", "modules", "cochange_count"])


def test_empty(spark):
    assert pair_counts(spark.createDataFrame([], "s string, m array<string>"), "s", "m").count() == 0
    assert pair_counts(spark.createDataFrame([("a", ["x"])], "s string, m array<string>"), "s", "m", 6, 4.0).count() == 0
