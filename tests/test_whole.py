"""Queries on small written tables: all rows count, none is cut by its key."""

from __future__ import annotations

from datetime import datetime

import pytest

from tallyweir.operators import hierarchy
from tallyweir.plans import gates, measures, relations

from .conftest import same
from .test_hierarchy import random_links, table


def written(spark, at, **tables) -> str:
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_threshold_violations_scores_every_supplier(spark, tmp_path):
    items = [(k, 20_000.0) for k in (1, 3, 5, 15)] + [(6, 100.0), (2, 16_000.0)]
    d = written(spark, tmp_path, lineitem=(items, "l_suppkey bigint, l_quantity double"), supplier=([(k,) for k in (1, 2, 3, 4, 5, 6, 9, 15)], "s_suppkey bigint"))
    same(gates.threshold_violations(spark, d), [(k, 500.0, "violation") for k in (1, 3, 5, 15)] + [(k, None, "unknown") for k in (4, 9)], ["s_suppkey", "score", "outcome"])


def test_p3_descendants_go_round_the_cycle(spark, tmp_path):
    links = [("a", None), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("w", "z"), ("s", "s"), ("t", "s")]
    d = written(spark, tmp_path, lexical=([(i, p, datetime(2025, 1, 1)) for i, p in links], "id string, parent_id string, captured_at timestamp"))
    expected = [("a", "b", 1), ("x", "y", 1), ("y", "x", 1), ("x", "z", 1), ("y", "z", 2), ("z", "w", 1), ("x", "w", 2), ("y", "w", 3), ("s", "t", 1)]
    same(hierarchy.p3_descendants(spark, d), expected, ["id", "descendant_id", "distance"])


@pytest.mark.parametrize("task_links", [10, 10_000])
def test_all_descendants_against_brute_force(spark, task_links):
    links = random_links(120, 4) | {"r1": "r3", "r2": "r1", "r3": "r2", "r4": "r2", "r5": "r4"}
    expected = []
    for x in links:
        above, at = [x], links[x]
        while at in links and at not in above:
            expected.append((at, x, len(above)))
            above.append(at)
            at = links[at]
    same(hierarchy.all_descendants(table(spark, links.items()), task_links), expected, ["id", "descendant_id", "distance"])


def test_locality_leverage_keeps_parts_apart(spark, tmp_path):
    items = [(1, 1), (1, 51), (1, 101), (1, 101), (2, 51), (3, 51)]
    d = written(spark, tmp_path, lineitem=(items, "l_suppkey bigint, l_partkey bigint"), supplier=([(k,) for k in (1, 2, 3, 4)], "s_suppkey bigint"), part=([(k,) for k in (1, 51, 101, 151)], "p_partkey bigint"))
    same(measures.locality_leverage(spark, d), [("s1", 3, 0), ("s2", 1, 0), ("s3", 1, 0), ("s4", 0, 0), ("p1", 0, 1), ("p51", 0, 3), ("p101", 0, 1), ("p151", 0, 0)], ["module", "outbound", "inbound"])


def modules_and_commits(spark, at) -> str:
    """Three modules that share a readable key, one known by it alone, and one without commits."""
    day = datetime(2025, 1, 1)
    facts = [("oo::p::mm", "mm", "src/mm.rs", "oo"), ("o::pp::mm", "mm", "src/mm.rs", "o"), ("o::ppp::mm", "mm", "src/mm.rs", "o"), ("q::p::none", "none", "src/none.rs", "q"), ("o::p::gone", "gone", "src/gone.rs", "o")]
    commits = [("h1", ["oo::p::mm"], 3), ("h2", ["oo::p::mm"], 4), ("h3", ["o::pp::mm"], 50), ("h4", ["o::pp::mm"], 1), ("h5", ["o::pp::mm"], 1), ("h6", ["none"], 9)]
    return written(
        spark, at,
        file_facts=([(*f, day) for f in facts], "module_id string, module_key string, path string, package_name string, scanned_at timestamp"),
        history=([(*c, day) for c in commits], "hash string, modules array<string>, churn bigint, ingested_at timestamp"),
    )


def test_coalesced_key_metric_takes_the_id_first(spark, tmp_path):
    found = relations.coalesced_key_metric(spark, modules_and_commits(spark, tmp_path))
    same(found, [("oo::p::mm", 7.0), ("o::pp::mm", 52.0), ("o::ppp::mm", 52.0), ("q::p::none", 9.0), ("o::p::gone", None)], ["module_id", "churn"])


def test_first_match_priority_tries_the_id_first(spark, tmp_path):
    found = relations.first_match_priority(spark, modules_and_commits(spark, tmp_path))
    same(found, [("oo::p::mm", 2), ("o::pp::mm", 3), ("o::ppp::mm", 3), ("q::p::none", 1), ("o::p::gone", 3)], ["module_id", "commits"])


def test_nation_cycles_takes_every_edge(spark, tmp_path):
    """Nations 1 and 2 trade in a circle; 3 only buys from 1, so it is in none."""
    trade = [(1, 2), (2, 1), (3, 1)]
    d = written(
        spark, tmp_path,
        orders=([(k, c) for k, (c, _) in enumerate(trade)], "o_orderkey bigint, o_custkey bigint"),
        customer=([(k, k) for k in (1, 2, 3)], "c_custkey bigint, c_nationkey bigint"),
        lineitem=([(k, s) for k, (_, s) in enumerate(trade)], "l_orderkey bigint, l_suppkey bigint"),
        supplier=([(k, k) for k in (1, 2, 3)], "s_suppkey bigint, s_nationkey bigint"),
    )
    assert {r[0] for r in relations.nation_cycles(spark, d).collect()} == {"1", "2"}
