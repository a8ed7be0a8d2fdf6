"""Gates, evidence contracts and ownership reviews on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyweir.functions import text as X
from tallyweir.operators import clones, joins, ranking
from tallyweir.operators import policy as P
from tallyweir.plans import producers
from tallyweir.sources import artifacts, reports

from .conftest import same


def test_required_inputs(spark):
    status = spark.createDataFrame([("p", "map.json", "stale"), ("p", "rust_practices.json", "available"), ("q", "map.json", "available"), ("q", "coverage.json", "partial")], "k string, artifact string, status string")
    found = P.required_failures(status, ["regression", "practice-failure"], False, ["k"])
    expected = [("p", "regression", "map.json", "stale"), ("q", "practice-failure", "rust_practices.json", "missing"), ("q", "regression", "coverage.json", "partial"), ("p", "regression", "baseline", "missing"), ("q", "regression", "baseline", "missing")]
    same(found, expected, ["k", "policy", "artifact", "status"])
    same(P.required_failures(status.filter("k = 'q'").drop("k"), ["threshold", "partial"], True, every=["map.json", "clones.json"]), [("partial", "clones.json", "missing")], ["policy", "artifact", "status"])
    assert P.required_failures(status.limit(0), ["threshold"], True, ["k"]).count() == 0


def test_rules_abstain_without_evidence(spark):
    rules = spark.createDataFrame([("p", r) for r in ("a", "b", "c", "d")] + [("q", "a"), (None, "a")], "k string, rule_id string")
    contracts = spark.createDataFrame([("a", "x.json", True), ("b", "x.json", True), ("c", "x.json", False)], "rule_id string, artifact string, by_check boolean")
    status = spark.createDataFrame([("p", "x.json", "available"), ("q", "x.json", "stale"), (None, "x.json", "available")], "k string, artifact string, status string")
    checks = spark.createDataFrame([("p", "a", "passed"), ("p", "a", "failed"), ("p", "b", "skipped"), (None, "a", None)], "k string, rule_id string, status string")
    found = P.rule_availability(rules, contracts, status, checks, ["k"])
    unknown = "check is absent or its status unknown"
    same(found, [("p", "a", None), ("p", "b", unknown), ("p", "c", None), ("p", "d", "no evaluation coverage"), ("q", "a", "x.json: stale"), (None, "a", unknown)], ["k", "rule_id", "reason"])


def test_regressions(spark):
    cov, bench = "line_coverage_percent", "benchmark_estimate_percent"
    rows = [(1, cov, 80.0, 78.9, None), (2, cov, 80.0, 79.0, None), (3, cov, 80.0, 81.0, None), (4, cov, None, 81.0, None), (5, bench, 100.0, 120.0, "regressed"), (6, bench, 100.0, 105.0, "regressed"), (7, bench, 100.0, 50.0, "improved"), (8, bench, 100.0, 300.0, None), (9, bench, 100.0, 101.0, "within_noise")]
    found = P.evidence_regressions(spark.createDataFrame(rows, "i int, metric string, baseline double, current double, direction string"), 1.0, 10.0)
    same(found, [(1, "regressed"), (2, "unchanged"), (3, "improved"), (4, "incomparable"), (5, "regressed"), (6, "unchanged"), (7, "improved"), (8, "incomparable"), (9, "unchanged")], ["i", "verdict"])


def test_waivable_and_confidence(spark):
    rows = spark.createDataFrame([("failed",), ("timed-out",), (None,), ("incomplete",)], "status string")
    same(rows.withColumn("w", P.waivable(F.col("status"))), [("failed", True), ("timed-out", False), (None, True), ("incomplete", False)], ["status", "w"])
    status = spark.createDataFrame([("p", "a", "missing"), ("p", "b", "stale"), ("p", "c", "partial"), ("q", "a", "available"), ("r", "c", "unreadable")], "k string, artifact string, status string")
    same(P.merged_confidence(status, ["a", "c"], ["k"]), [("p", ["a"], ["b"], ["c"], False), ("q", [], [], [], True), ("r", ["c"], [], [], False)], ["k", "missing_input", "stale_input", "unsupported_pattern", "complete"])
    refs = spark.createDataFrame([("p", "resolved_local"), ("p", "unresolved"), ("p", "resolved_external"), ("q", "resolved_local")], "k string, status string")
    same(P.identity_confidence(refs, ["k"]), [("p", 3, 2, 66.67, False), ("q", 1, 1, 100.0, True)], ["k", "reference_count", "resolved_count", "resolution_percent", "complete"])
    one, two, none = (spark.range(1).select(P.composite_fingerprint({"b": F.lit(b).cast("string"), "a": F.lit("x")}).alias("f")).first()["f"] for b in ("y", "z", None))
    assert one != two and len(one) == 64 and none is None


@pytest.mark.parametrize("change,valid", [({}, True), ({"skipped": 1}, False), ({"status": "partial"}, False), ({"status": "partial", "reasons": ["why"], "skipped": 2}, True), ({"status": "failed", "reasons": ["why"]}, False), ({"status": "failed", "reasons": ["why"], "evaluated": 0}, True), ({"capability": " "}, False), ({"reasons": [" "]}, False), ({"schema_version": 2}, False), ({"evaluated": 2**53}, False), ({"scope": None}, False)])
def test_capability_records(spark, change, valid):
    good = {"schema_version": 1, "capability": "c", "scope": "s", "status": "completed", "evaluated": 3, "skipped": 0, "reasons": []}
    df = spark.createDataFrame([(good | change,)], "e struct<schema_version: int, capability: string, scope: string, status: string, evaluated: bigint, skipped: bigint, reasons: array<string>>")
    assert df.select(P.valid_capability(F.col("e")).alias("v")).first()["v"] is valid


@pytest.mark.parametrize("change,valid", [
    ({"kind": "run"}, True), ({"kind": "run", "schema_version": 2.0}, False), ({"kind": "other"}, False),
    ({"kind": "finding", "rule_id": "a.b", "locations": [{"file": "f", "line": 1.0}]}, True), ({"kind": "finding", "rule_id": "ab", "locations": []}, False), ({"kind": "finding", "rule_id": "a/b", "locations": [{"file": "f", "line": 1.5}]}, False),
    ({"kind": "measurement", "value": 1.0}, True), ({"kind": "measurement"}, False), ({"kind": "measurement", "limitations": ["no"]}, True), ({"kind": "measurement", "value": 1.0, "uncertainty": {"lower": 2.0, "upper": 1.0}}, False), ({"kind": "measurement", "value": float("nan")}, False),
    ({"kind": "comparison", "status": "compatible", "baseline_run": "b"}, True), ({"kind": "comparison", "status": "compatible", "baseline_run": "b", "reasons": ["x"]}, False), ({"kind": "comparison", "status": "unknown", "reasons": ["x"]}, True), ({"kind": "comparison", "status": "unknown"}, False),
])
def test_wire_records(spark, change, valid):
    empty = {"schema_version": 1.0, "kind": None, "rule_id": None, "locations": None, "value": None, "limitations": [], "uncertainty": None, "status": None, "baseline_run": None, "reasons": []}
    df = spark.createDataFrame([(empty | change,)], "e struct<schema_version: double, kind: string, rule_id: string, locations: array<struct<file: string, line: double>>, value: double, limitations: array<string>, uncertainty: struct<lower: double, upper: double>, status: string, baseline_run: string, reasons: array<string>>")
    assert df.select(P.valid_wire(F.col("e")).alias("v")).first()["v"] is valid


def test_ids_however_deep(spark):
    deep = '{"rule_id":"r","id":"deep"}'
    for _ in range(60):
        deep = '{"x":[' + deep + "]}"
    docs = spark.createDataFrame([(1, '{"rule_id":"r","id":"a","x":[{"rule_id":"q","id":"b"},{"id":"no"},{"rule_id":5,"id":"n"}]}'), (2, deep), (3, "broken"), (4, None), (5, "[]"), (1, '[{"rule_id":"q","id":"b"}]')], "k int, d string")
    same(P.nested_finding_ids(docs, "k", "d"), [(1, "a"), (1, "b"), (2, "deep")], ["k", "finding_id"])


def test_owners(spark):
    key = "package string, target string, path string, name string"
    tests = spark.createDataFrame([("p", "t", "f", "one"), ("p", "t", "f", "two"), ("p", "t", "f", "two"), ("q", "t", "f", "same"), ("p", "t", "f", "same"), (None, "t", "f", "null")], key)
    runs = spark.createDataFrame([("p", "t", "f", "one", "passed"), ("q", "t", "f", "same", "passed"), ("p", "t", "f", "same", "passed"), (None, "t", "f", "null", "failed")], key + ", last_status string")
    selectors = spark.createDataFrame([("b1", "p", "t", "f", "one"), ("b2", "p", "t", "f", "two"), ("b3", "p", "t", "f", "same"), ("b4", None, "t", "f", "null"), ("b5", "p", "t", "f", "gone"), ("b1", "p", "t", "f", "one")], "behavior string, " + key)
    observed = P.selector_statuses(selectors, tests, runs)
    same(observed.filter("behavior <> 'b1'"), [("b2", "ambiguous", "unknown"), ("b3", "resolved", "unknown"), ("b4", "resolved", "failed"), ("b5", "unresolved", "unknown")], ["behavior", "resolution", "execution"])
    behaviors = spark.createDataFrame([(f"b{i}", i != 2, "passed") for i in range(1, 7)] + [("b1x", True, "failed")], "behavior string, required boolean, run string")
    reviewed = P.owner_statuses(behaviors, observed, F.col("run"))
    same(reviewed, [("b1", "observed_pass"), ("b2", "unresolved"), ("b3", "unknown"), ("b4", "observed_failure"), ("b5", "unresolved"), ("b6", "unresolved"), ("b1x", "unresolved")], ["behavior", "status"])
    same(P.owner_findings(reviewed), [("b3", "execution is unknown"), ("b4", "the owner failed"), ("b5", "no owner resolves"), ("b6", "no owner resolves"), ("b1x", "no owner resolves")], ["behavior", "reason"])


def test_experiments_and_candidates(spark):
    rows = [("b1", "passed", "assertion_failed", "passed"), ("b2", "passed", "passed", "passed"), ("b3", "failed", "assertion_failed", "passed"), ("b4", "passed", "not_run", None), ("b5", None, "passed", "passed"), ("b6", "passed", "timed_out", "passed")]
    experiments = spark.createDataFrame(rows, "behavior string, baseline string, injected string, restored string")
    same(P.fault_classes(experiments), [("b1", "reported_detected"), ("b2", "survived"), ("b3", "inconclusive"), ("b4", "not_run"), ("b5", "inconclusive"), ("b6", "inconclusive")], ["behavior", "class"])
    behaviors = spark.createDataFrame([("b1", True), ("b2", True), ("b3", False)], "behavior string, required boolean")
    same(P.undetected(behaviors, experiments), [("b2",)], ["behavior"])
    queue = P.consolidation_candidates(spark.createDataFrame([("a", ["t"], 2.0), ("b", ["t", "u"], 1.0), ("c", ["t"], None), ("d", ["t"], 0.5)], "id string, tests array<string>, hours double")).collect()
    assert [(r["id"], r["leverage"]) for r in queue] == [("b", 2.0), ("d", 2.0), ("a", 0.5), ("c", None)]


def test_derived_again(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", 2, "s"), ("z", 3, "s"), (None, 1, "s")], "k string, n int, s string")
    b = spark.createDataFrame([("x", 1, None), ("y", 2, "t"), ("w", 3, "s"), (None, 1, "s")], "k string, n int, s string")
    same(P.disagreements(a, b, "k", ["n", "s"]), [("y",), ("z",), ("w",)], ["k"])


def test_entrypoints(spark):
    schema = "path string, module_key string, target_kind string, entrypoint_kind string, is_entrypoint boolean"
    source = spark.createDataFrame([("a", "m", "lib", "library", True), ("b", "n", "lib", None, True), ("c", "o", "lib", "library", False)], schema)
    tests = spark.createDataFrame([("a", "t", "test", "library", True), ("d", "u", "test", "library", True), ("e", "v", "test", "library", True)], schema)
    changed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "path string")
    same(P.changed_entrypoints(source, tests, changed), [("a", "m"), ("d", "u")], ["path", "module_key"])
    files = spark.createDataFrame([("api::core::x", "a::core", True), ("api::core::y", "misc", False), ("p::q::api", "api", None)], "module_id string, module_key string, is_entrypoint boolean")
    edges = spark.createDataFrame([], "src string, dst string")
    same(producers.topology(files, edges), [("api::core::x", "Entrypoint"), ("api::core::y", "Unclassified"), ("p::q::api", "Interface")], ["module_id", "layer"])


def test_text_functions(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert value(X.file_uri(F.lit("/w/a b*~é.rs"))) == "file:///w/a%20b%2A~%C3%A9.rs" and value(X.uri_path(F.lit("file:///w/a%20b%2A~%C3%A9.rs"))) == "/w/a b*~é.rs" and value(X.uri_path(F.lit("http://x"))) is None
    line = "é𝒳 ab_1 = 2"
    assert [value(X.utf16_to_byte(F.lit(line), F.lit(k))) for k in (0, 1, 2, 3, 4, 50)] == [0, 2, None, 6, 7, None]
    assert [value(X.identifier_at(F.lit(line), F.lit(k))) for k in (3, 4, 7, 10, 90)] == ["ab_1", "b_1", None, None, None]
    assert [value(X.within_budget(F.lit(t))) for t in ("a b+c", " ".join("x" * 128), " ".join("x" * 129), "y" * 65_537)] == [True, True, False, False]
    assert value(X.layer_color(F.lit("Domain"))) == "#4ec9b0" and value(X.layer_color(F.lit(None).cast("string"))) == "#808080"


def test_orders_bodies_and_bytes(spark):
    rows = spark.createDataFrame([("m2", None, 1), ("m1", 5.0, 1), ("m0", 5.0, 1), ("m3", 5.0, 2)], "module_id string, score double, total_count int")
    assert [r["module_id"] for r in ranking.in_report_order(rows, "escape-hatches").collect()] == ["m3", "m0", "m1", "m2"]
    assert [r["module_id"] for r in ranking.canonical_order(rows).collect()] == ["m0", "m1", "m2", "m3"]
    bodies = spark.createDataFrame([("a", "f", "h"), ("a", "g", "h"), ("t", "f", "h")], "file string, qualified_name string, body string")
    tests = spark.createDataFrame([("t", "f"), ("a", "x"), ("t", "f")], "path string, qualified_name string")
    same(clones.test_bodies(bodies, tests), [("t", "f")], ["file", "qualified_name"])
    same(clones.source_bodies(bodies, tests.filter("path = 'a'")), [("a", "f"), ("a", "g")], ["file", "qualified_name"])
    built = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y"), ("q", "z")], "package_id string, path string")
    same(reports.artifact_bytes(built, spark.createDataFrame([("x", 5), ("y", 7)], "path string, bytes bigint")), [("p", 2, 12, 0), ("q", 1, None, 1)], ["package_id", "n_files", "bytes", "n_unknown"])
    types = spark.createDataFrame([("c", "t"), ("c", "u"), (None, "t")], "context string, id string")
    impls = spark.createDataFrame([("c", "t", 3, "f"), ("c", "t", 2, "f"), ("d", "u", 1, "g")], "ic string, owner string, method_count int, path string")
    same(joins.by_owner(types, impls, [("context", "ic"), ("id", "owner")]), [("c", "t", 5, 2, 1), ("c", "u", 0, 0, 0), (None, "t", 0, 0, 0)], ["context", "id", "method_count", "impl_block_count", "impl_file_count"])
    edges = spark.createDataFrame([("one", "a::b", "c::d"), ("two", "a::b", "e")], "profile string, src string, dst string")
    same(joins.rule_edges(edges, [{"id": "r", "level": "error", "from": ["a::*"], "deny": ["c::**"]}], ["profile"]), [("one", "a::b", "r")], ["profile", "src", "rule_id"])


def test_one_writer_publishes(spark, tmp_path):
    df = spark.range(2)
    (tmp_path / artifacts.LOCK).touch()
    with pytest.raises(RuntimeError, match="another writer"):
        artifacts.publish(spark, {"t": df}, str(tmp_path), lambda: True)
    (tmp_path / artifacts.LOCK).unlink()
    artifacts.publish(spark, {"t": df}, str(tmp_path), lambda: True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and not (tmp_path / artifacts.LOCK).exists()
