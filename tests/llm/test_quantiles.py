from __future__ import annotations

import math
import random
from datetime import date, datetime

import numpy as np
import pytest

from tallyweir.llm import quantiles
from tallyweir.llm.quantiles import METRICS, QUANTILES, Sketch, day_sketches, merge_sketches, pack_values, percentiles, unpack_values

T = datetime(2025, 1, 1)
SCHEMA = "project_key string, module_id string, run_day date, received_at timestamp, function_scores array<double>, cyclomatic_complexities array<double>, cognitive_complexities array<double>, batch_no bigint, slot string, n int, `0_items` string"


def distance(values: np.ndarray, found: float, q: float) -> int:
    """Ranks between the value and the one asked for."""
    v, rank = np.sort(values), math.ceil((len(values) - 1) * q)
    return max(0, int(np.searchsorted(v, found, "left")) - rank, rank - int(np.searchsorted(v, found, "right")) + 1)


@pytest.mark.parametrize("shape", ["uniform", "lognormal", "ties", "sorted", "falling"])
@pytest.mark.parametrize("parts", [1, 40])
def test_rank_errors_stay_within_the_bound(shape, parts):
    rng = np.random.default_rng(1)
    values = {"uniform": rng.random(60_000), "lognormal": rng.lognormal(0, 3, 60_000), "ties": rng.integers(0, 6, 60_000) * 1.0, "sorted": np.arange(60_000.0), "falling": -np.arange(60_000.0)}[shape]
    whole = Sketch(16, 7)
    for i, part in enumerate(np.array_split(values, parts)):
        s = Sketch(16, i)
        for piece in np.array_split(part, 9):
            s.update(piece)
        whole.merge(s.levels, s.compactions, s.tops)
    assert whole.n == len(values) == sum(len(x) << h for h, x in enumerate(whole.levels))
    assert sum(map(len, whole.levels)) < 6_000
    found, errors = whole.quantiles([*QUANTILES, 0.0, 1.0])
    for q, value, error in zip([*QUANTILES, 0.0, 1.0], found, errors):
        assert distance(values, value, q) <= error
    assert found[-1] == values.max() and errors[-1] == 0
    # Multiplicative towards the maximum: a few per cent of the ranks above, with 16 items a section.
    for q, value in zip(QUANTILES, found):
        assert distance(values, value, q) <= 0.15 * (1 - q) * len(values) + 1


def test_packing_is_exact():
    lists = [[], [1.0, 2.0, 0.0], [0.1, 1.25, 2.0], [1.23, 99999.99], [math.pi, 1.0], [2.0**40], [0.005], [1e300, 5e-324], []]
    counts = np.array([len(x) for x in lists])
    mode, packed = pack_values(np.array([v for x in lists for v in x]), counts)
    values, n = unpack_values(mode, packed)
    assert n.tolist() == counts.tolist() and values.tolist() == [v for x in lists for v in x]
    assert mode.to_pylist() == [0, 0, 1, 1, 2, 2, 2, 2, 0]


def rows(seed, n=400):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        project = [None, "hot", "hot", "hot", "cold"][rng.integers(5)]
        day = None if rng.random() < 0.03 else date(2025, 1, int(rng.integers(1, 4)))
        lists = [rng.lognormal(1, 1, rng.integers(0, 60)).round(2).tolist() for _ in METRICS]
        lists[0] += [None, float("nan"), -1.0, float("inf"), -0.0]
        if rng.random() < 0.1:
            lists[1] = None
        out.append((project, "m", day, T, *lists, i, "clash", 1, "clash"))
    return out + out[: n // 10]


def truth(data):
    groups = {}
    for r in {r[7]: r for r in data}.values():
        for m, metric in enumerate(METRICS):
            values = [v for v in r[4 + m] or [] if v is not None and math.isfinite(v) and v >= 0]
            for key in {(r[0], r[2], metric, False), (r[0], None, metric, True)}:
                groups.setdefault(key, []).extend(values)
    return {k: np.array(v) for k, v in groups.items() if v}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD", 2_000)
    data = rows(5)
    expected = truth(data)
    found = percentiles(spark.createDataFrame(data, SCHEMA).repartition(3), 8).collect()
    # A null day and all days of a project have the same key: told apart by n.
    seen = set()
    for r in found:
        options = [k for k in ((r["project_key"], r["run_day"], r["metric"], whole) for whole in (False, True)) if k in expected and len(expected[k]) == r["n"] and k not in seen]
        assert options
        seen.add(options[0])
        for q in QUANTILES:
            name = f"p{round(q * 100)}"
            assert distance(expected[options[0]], r[name], q) <= r[f"{name}_rank_error"]
    assert seen == set(expected)


def test_small_groups_are_exact_and_days_combine(spark):
    data = rows(6)
    df = spark.createDataFrame([r for r in data if r[2]], SCHEMA)
    expected = {k: v for k, v in truth([r for r in data if r[2]]).items() if k[3]}
    one = {(r["project_key"], r["metric"]): r for r in percentiles(df, 4096).filter("run_day is null").collect()}
    two = {(r["project_key"], r["metric"]): r for r in merge_sketches(day_sketches(df, 4096), 4096).collect()}
    assert {(k[0], k[2]) for k in expected} == set(one) == set(two)
    for (project, _, metric, _), values in expected.items():
        for q in QUANTILES:
            exact = np.sort(values)[math.ceil((len(values) - 1) * q)]
            assert one[project, metric][f"p{round(q * 100)}"] == exact == two[project, metric][f"p{round(q * 100)}"]


def test_empty_and_repeats(spark):
    assert percentiles(spark.createDataFrame([], SCHEMA)).count() == 0
    none = ("p", "m", date(2025, 1, 1), T, [], None, [-1.0], 1, "x", 1, "x")
    assert percentiles(spark.createDataFrame([none], SCHEMA)).count() == 0
    late = datetime(2025, 2, 1)
    data = [("p", "m", date(2025, 1, 1), T, [1.0], [1.0], [1.0], 1, "x", 1, "x"), ("p", "m", date(2025, 1, 2), late, [5.0], [], None, 1, "x", 1, "x")]
    data += [("p", "m", date(2025, 1, 2), late, [7.0], [], None, None, "x", 1, "x")] * 2
    found = percentiles(spark.createDataFrame(data, SCHEMA)).filter("run_day is not null").collect()
    assert [(r["run_day"], r["metric"], r["n"], r["p50"]) for r in found] == [(date(2025, 1, 2), "function_scores", 2, 7.0)]


def test_a_day_with_half_of_all_rows_is_dealt(spark):
    """The hot day's sketches are made by several tasks and merged; their bounds hold."""
    rng = random.Random(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    data = [("p" if i % 2 else f"q{i % 40}", "m", date(2025, 1, 1 + (0 if i % 2 else i % 20)), T, [rng.lognormvariate(1, 1) for _ in range(30)], [], None, i, "x", 1, "x") for i in range(600)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    parts = quantiles._sorted_parts(df, 8).mapInArrow(quantiles._merge_days(8, False), quantiles._RESULT).filter(f"metric >= {quantiles.OF_DAY}").collect()
    assert len(parts) > 1 and {(r["project_key"], r["run_day"]) for r in parts} == {("p", date(2025, 1, 1))}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = np.array([v for r in data if r[0] == "p" for v in r[4]])
    for found in (percentiles(df, 8).filter("project_key = 'p'").collect(), merge_sketches(day_sketches(df, 8), 8).filter("project_key = 'p'").collect()):
        for r in found:
            assert r["n"] == len(expected)
            for q in QUANTILES:
                assert distance(expected, r[f"p{round(q * 100)}"], q) <= r[f"p{round(q * 100)}_rank_error"]
    assert day_sketches(df, 8).filter("project_key = 'p'").count() == 1
