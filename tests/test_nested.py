from __future__ import annotations

import json
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweir.operators.nested import REPORT, _Column, _Node, ordinals, report_checks, report_items, report_table

from .conftest import same

SCHEMA = "report_id bigint, received_at timestamp, checks string, ord_1 string, `group` string"
FOUND = ["report_id", "check_no", "branch", "item_no", "sub_no", "label"]


def table(spark, texts):
    return spark.createDataFrame([(i, datetime(2025, 1, at), t, "x", "y") for i, at, t in texts], SCHEMA)


def items(spark, *texts):
    return report_items(table(spark, [(i, 1, t) for i, t in enumerate(texts)]))


def test_places_and_labels(spark):
    check = {
        "diagnostics": [{"rule_id": "a", "children": [{"level": "note"}, None, {"level": None}]}, None, {"ruleId": "b", "children": {"level": "help"}}, 7],
        "evidence": {"requested_runs": 2, "commands": [{"target": "t"}, None, {}]},
    }
    one = {"diagnostics": {"message": "m"}, "evidence": {"status": "passed"}}
    expected = [
        (0, 1, "diagnostic", 0, -1, "a"), (0, 1, "diagnostic", 2, -1, "b"), (0, 1, "child", 0, 0, "note"), (0, 1, "child", 0, 2, ""), (0, 1, "child", 2, 0, "help"),
        (0, 1, "command", 0, -1, "t"), (0, 1, "command", 2, -1, ""), (0, 2, "diagnostic", 0, -1, ""), (0, 2, "command", 0, -1, ""),
    ]
    same(items(spark, json.dumps([None, check, one])), expected, FOUND)


def test_outer_forms(spark):
    check = {"diagnostics": [{"rule_id": "r"}]}
    forms = [[check], {"checks": [check], "version": 2}, {"tool": "practices", "data": {"checks": [check]}}, json.dumps([check]), check, {"checks": check}]
    same(items(spark, *map(json.dumps, forms)), [(i, 0, "diagnostic", 0, -1, "r") for i in range(len(forms))], FOUND)


def test_nothing(spark):
    texts = [None, "", "  ", "null", "{}", "[]", "[1]", '[{"evidence": {}}]', '[{"evidence": {"requested_runs": 3}}]', '[{"diagnostics": [{"rule_id"', "[" * 100_000, '"\\ud800"']
    assert items(spark, *texts).count() == 0
    assert report_items(table(spark, [])).count() == 0


def test_last_delivery_even_if_broken(spark):
    good = '[{"diagnostics": [{"rule_id": "r"}]}]'
    df = table(spark, [(1, 1, good), (1, 2, "[{"), (2, 1, "[{"), (2, 2, good), (2, 2, good), (None, 1, good)])
    same(report_items(df), [(2, 0, "diagnostic", 0, -1, "r")], FOUND)


def test_typed_table_names_its_parents(spark):
    text = json.dumps([{"diagnostics": [{"line": "12", "column": "x", "children": [{"level": "note", "message": "\ud800é"}]}]}])
    same(report_table(table(spark, [(1, 1, text)]), "checks/diagnostics"), [(1, 0, 0, 12, None)], ["report_id", "check_no", "diagnostic_no", "line", "column"])
    same(report_table(table(spark, [(1, 1, text)]), "checks/diagnostics/children"), [(1, 0, 0, 0, "?é")], ["report_id", "check_no", "diagnostic_no", "child_no", "message"])


leaf = st.one_of(st.none(), st.text("ab", max_size=2))
child = st.one_of(st.none(), st.fixed_dictionaries({"level": leaf}))
diagnostic = st.one_of(st.none(), st.fixed_dictionaries({"rule_id": leaf}, optional={"children": st.lists(child, max_size=3)}))
check = st.one_of(st.none(), st.fixed_dictionaries({}, optional={"diagnostics": st.lists(diagnostic, max_size=4)}))


@settings(max_examples=200, deadline=None)
@given(st.lists(check, max_size=4))
def test_level_sequences_give_back_the_places(checks):
    column = _Column()
    _Node(REPORT[0], "", 1, {"checks/diagnostics/children/level": column}).put(report_checks(checks), 0)
    r, d = np.array(column.r), np.array(column.d)
    rows = np.flatnonzero(d >= 6)
    values = iter(column.v)
    found = [(int(ordinals(r, 1)[i]), int(ordinals(r, 2)[i]), int(ordinals(r, 3)[i]), next(values) if d[i] == 7 else None) for i in rows]
    expected = [(i, j, k, x["level"]) for i, c in enumerate(checks) if c for j, g in enumerate(c.get("diagnostics", [])) if g for k, x in enumerate(g.get("children", [])) if x]
    assert found == expected
