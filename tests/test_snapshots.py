from __future__ import annotations

from datetime import datetime

import pytest

from tallyweir.operators.snapshots import policy_changes, with_neighbours

from .conftest import same

SCHEMA = (
    "project_key string, snapshot_no bigint, delivered_at timestamp, "
    "score_deltas array<struct<module: string, baseline_score: double, current_score: double>>, "
    "evidence_deltas array<struct<metric: string, benchmark: string, baseline_value: double, current_value: double, status: string>>, "
    "regressions array<struct<metric: string, subject: string, delta: double>>, extra string, prev_seq bigint, _block string"
)
FOUND = ["project_key", "snapshot_no", "section", "record_key", "change_kind"]


def row(no, score=(), evidence=(), regressions=(), at=1, project="p"):
    return (project, no, datetime(2025, 1, at), score, evidence, regressions, "x", 7, "b")


def changes(spark, rows, **kw):
    return policy_changes(spark.createDataFrame(rows, SCHEMA), **kw)


def test_added_removed_changed_and_passed_over(spark):
    rows = [
        row(1, [("a", 1.0, 2.0), ("b", None, 2.0)], [("m", None, 1.0, 1.0, "ok")], [("x", "y", None)]),
        row(2, None, [("m", None, 1.0, 1.0, "bad")], [("x", "y", 0.0)]),
        row(5, [("a", 1.004, 2.0), ("c", 0.0, 1.0), ("c", 0.0, 1.0), None], [], [("x", "y", -0.0)]),
    ]
    same(
        changes(spark, rows),
        [
            ("p", 5, "score_deltas", "b", "removed"),
            ("p", 5, "score_deltas", "c", "added"),
            ("p", 2, "evidence_deltas", "m/", "changed"),
            ("p", 5, "evidence_deltas", "m/", "removed"),
            ("p", 2, "regressions", "x/y", "changed"),
        ],
        FOUND,
    )


def test_last_delivery_counts_and_null_keys(spark):
    rows = [
        row(1, [("a", 1.0, 1.0)], at=1),
        row(2, [("a", 9.0, 1.0)], at=2),
        row(2, [("a", 1.0, 1.0), (None, 1.0, 1.0)], at=3),
        row(2, [("a", 1.0, 1.0), (None, 1.0, 1.0)], at=3),
        row(None, [("z", 1.0, 1.0)], at=4),
        row(1, [("a", 1.0, 1.0)], project=None),
        row(2, [("a", 2.0, 1.0)], project=None),
    ]
    same(changes(spark, rows), [("p", 2, "score_deltas", "", "added"), (None, 2, "score_deltas", "a", "changed")], FOUND)


def test_empty_table(spark):
    assert changes(spark, []).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_neighbours_do_not_depend_on_blocks(spark, block):
    numbers = [-7, 1, 2, 3, 9, 10, 11, 500]
    found = with_neighbours(spark.createDataFrame([("a", n) for n in numbers] + [(None, 4)], "s string, n bigint"), ["s"], "n", block)
    same(found, [("a", n, p, x) for n, p, x in zip(numbers, [None, *numbers], [*numbers[1:], None])] + [(None, 4, None, None)], ["s", "n", "prev_seq", "next_seq"])
