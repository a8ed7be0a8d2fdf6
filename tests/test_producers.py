"""Golden results of the measurements."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyweir.functions.text import is_defect_subject
from tallyweir.plans import producers as P

from .conftest import same

FILE = "module_id string, module_key string, path string, parse_status string, source_metrics_available boolean, source_nonblank_line_count bigint, is_entrypoint boolean, public_api_count bigint, documented_public_api_count bigint, has_crate_docs boolean, function_count bigint"
FUNCTION = "module_id string, path string, qualified_name string, start_line bigint, end_line bigint, source_line_count bigint, branch_pressure bigint, path_pressure bigint, max_nesting_depth bigint, cyclomatic_complexity bigint, cognitive_complexity bigint"


def files(spark, *rows):
    return spark.createDataFrame([(m, m.split("::")[-1], f"src/{m}.rs", status, metrics, sloc, entry, api, api, True, 1) for m, status, metrics, sloc, entry, api in rows], FILE)


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_hotspots_of_two_modules(spark):
    f = files(spark, ("math", "ok", True, 21, False, 2), ("lib", "ok", True, 8, True, 1), ("broken", "error", True, 9, False, None), ("gone", "error", False, None, False, None), ("empty", "ok", True, 40, False, 0))
    fn = spark.createDataFrame([("math", "m", "wide_branch", 8, 18, 11, 6, 4, 3, 4, 3), ("math", "m", "raw_escape", 20, 23, 4, 0, 1, 1, 1, 0), ("lib", "l", "public_entry", 3, 9, 7, 1, 2, 1, 2, 1)], FUNCTION)
    same(P.module_hotspots(f, fn), [("math", 30.75, 34.94, 34.94, 2, "stable"), ("lib", 6.14, 6.38, 6.38, 1, "stable"), ("broken", None, None, None, None, None), ("empty", 2.0, 0.0, 0.0, 0, "stable")], ["module_id", "score", "max_function_score", "p95_function_score", "function_count", "signals"])
    top = P.function_hotspots(fn).orderBy(F.desc("score")).first()
    assert top["score"] == 34.94 and sum(c["contribution"] for c in top["score_components"]) == pytest.approx(34.94, abs=0.02)


def test_function_risk(spark):
    fn = spark.createDataFrame([("m", "a.rs", "f", 1, 10, 10, 0, 0, 0, 5, 0), ("m", "a.rs", "g", 200, 300, 10, 0, 0, 0, 9, 0), ("m", "b.rs", "h", 1, 5, 5, 0, 0, 0, 2, 0)], FUNCTION)
    lines = spark.createDataFrame([("a.rs", i, i % 2 == 0) for i in range(1, 11)] + [("a.rs", 250, False)], "path string, line bigint, covered boolean")
    same(P.function_risk(fn, lines), [("f", 10, 5, 50.0, 8.13, "normal"), ("g", 1, 0, 0.0, 90.0, "high"), ("h", 0, 0, None, None, "unknown")], ["qualified_name", "executable_lines", "covered_lines", "coverage_percent", "crap", "risk_level"])


def complete(spark):
    f = files(spark, ("domain", "ok", True, 10, False, 1), ("service", "ok", True, 10, False, 1))
    e = edges(spark, ("domain", "service"), ("service", "domain"))
    hot = spark.createDataFrame([("domain", 10.0), ("service", 10.0)], "module_id string, score double")
    git = spark.createDataFrame([("domain", 24, 2, 1, 1)], "module_id string, churn bigint, commit_count bigint, contributor_count bigint, defect_commit_count bigint")
    tests = spark.createDataFrame([("domain", 1, 0, 0, 0)], "module string, test_count bigint, failed_count bigint, skipped_count bigint, unknown_count bigint")
    return f, e, hot, git, tests


def test_complete_risk_inputs_explain_the_total(spark):
    f, e, hot, git, tests = complete(spark)
    rows = {r["module_id"]: r for r in P.risk_map(f, P.topology(f, e), e, hot, git, tests).collect()}
    r = rows["domain"]
    assert r["in_cycle"] and r["violations"] == 1 and r["architectural_risk"] == 160.0
    assert r["change_risk"] == 2 + 5 + 14 + 18 and r["unknown_metrics"] == []
    assert r["total_score"] == pytest.approx(sum(c["contribution"] for c in r["score_components"]))
    # There but without a row: zeros, and no tests.
    assert rows["service"]["change_risk"] == 90.0 and rows["service"]["correctness_risk"] == 90.0


def test_missing_inputs_are_unknown(spark):
    f, e, hot, git, tests = complete(spark)
    for parts, unknown in (((None, git, tests), ["maintainability_risk", "quality_risk", "total_score"]), ((hot, None, tests), ["change_risk", "total_score"]), ((hot, git, None), ["correctness_risk", "total_score"]), ((None, None, None), ["maintainability_risk", "change_risk", "correctness_risk", "quality_risk", "total_score"])):
        rows = P.risk_map(f, P.topology(f, e), e, *parts)
        assert all(r["unknown_metrics"] == unknown and r["total_score"] is None for r in rows.collect())
    empty = [x.limit(0) for x in (git, tests)]
    assert all(r["total_score"] is not None for r in P.risk_map(f, P.topology(f, e), e, hot, *empty).collect())
    same(P.unknown_counts(P.risk_map(f, P.topology(f, e), e, hot, None, tests)), [("change_risk", 2), ("total_score", 2)], ["metric", "n_modules"])


def test_entrypoints_have_allowances(spark):
    names = [f"core::m{i}" for i in range(10)]
    f = files(spark, ("db::entry", "ok", True, 10, True, 1), ("db::plain", "ok", True, 10, False, 1), *((n, "ok", True, 10, False, 1) for n in names))
    e = edges(spark, *(("db::entry", n) for n in names), *(("db::plain", n) for n in names), ("db::entry", "api::x"), ("db::plain", "api::x"))
    hot = spark.createDataFrame([(m, 1.0) for m in ("db::entry", "db::plain")], "module_id string, score double")
    rows = {r["module_id"]: r for r in P.risk_map(f, P.topology(f, e), e, hot, None, None).collect()}
    assert rows["db::entry"]["maintainability_risk"] < rows["db::plain"]["maintainability_risk"] and rows["db::entry"]["architectural_risk"] < rows["db::plain"]["architectural_risk"]


def test_lookup_falls_back_to_the_readable_key(spark):
    f = files(spark, ("p::t::a", "ok", True, 10, False, 1))
    e = edges(spark)
    tests = spark.createDataFrame([("a", 3, 1, 0, 0)], "module string, test_count bigint, failed_count bigint, skipped_count bigint, unknown_count bigint")
    assert P.risk_map(f, P.topology(f, e), e, None, None, tests).first()["correctness_risk"] == 140 + 45


def test_escapes_types_and_findings(spark):
    esc = spark.createDataFrame([("m", "unsafe_block", 2), ("m", "lint_suppression", 3), ("m", "clippy_suppression", 1), ("n", "deref", 0)], "module_id string, kind string, count bigint")
    same(P.escape_hatches(esc), [("m", 6, 2, 4, 23.0)], ["module_id", "total_count", "unsafe_count", "allow_count", "score"])
    types = spark.createDataFrame([("p", "t", "A", "named", 20, 0, 0, 10), ("p", "t", "B", "named", 1, 0, 0, 1), ("p", "t", "B", "named", 1, 0, 0, 1)], "package_name string, target_name string, qualified_name string, shape string, field_count bigint, variant_count bigint, variant_field_count bigint, declaration_span bigint")
    impls = spark.createDataFrame([("p", "t", "A", "x.rs", 10), ("p", "t", "A", "y.rs", 5), ("p", "t", "B", "x.rs", 9), ("p", "t", "gone", "x.rs", 9)], "package_name string, target_name string, qualified_type_name string, path string, method_count bigint")
    same(P.type_health(types, impls), [("A", 15, 2, 32.55, ["wide-fields"]), ("B", 0, 0, 0.0, []), ("B", 0, 0, 0.0, [])], ["qualified_name", "observed_method_count", "observed_impl_file_count", "structural_risk", "signals"])
    assert all(r["structural_risk"] is None and r["method_count"] is None for r in P.type_health(types, impls, False).collect())
    found = spark.createDataFrame([("src/a.rs", "rust.safety.x", 1, False), ("src/a.rs", "rust.style.x", 2, False), ("src/a.rs", "rust.style.x", 3, True), ("src/b.rs", "r", 1, False)], "path string, rule_id string, line bigint, test_code boolean")
    same(P.reliability(files(spark, ("a", "ok", True, 1, False, 0), ("b", "error", True, 1, False, 0)), found), [(1, "error", True), (2, "warning", True), (3, "advisory", False)], ["line", "severity", "policy_selected"])


def test_tests(spark):
    t = spark.createDataFrame([("p", "t", "x", "a", 1, 0, 1, False), ("p", "t", "x", "a", 1, 0, 1, False), ("p", "t", "x", "b", 2, 1, 0, True)], "package_name string, target_name string, path string, qualified_name string, line bigint, assertion_count bigint, sut_call_count bigint, ignored boolean")
    own, found = P.test_quality(t)
    assert own.count() == 2
    same(found, [("a", "rust.test.no-assertion"), ("b", "rust.test.no-sut-call"), ("b", "rust.test.ignored")], ["qualified_name", "rule_id"])
    runs = spark.createDataFrame([(["i", "j"], ["n"], "k", "failed"), ([], ["n"], "k", "passed"), (None, None, "k", "odd"), ([], [], None, "passed"), (["i"], [], None, None)], "tested_module_ids array<string>, tested_modules array<string>, module_key string, last_status string")
    same(P.correctness_counts(runs), [("i", 2, 1, 1), ("j", 1, 1, 0), ("n", 1, 0, 0), ("k", 1, 0, 1)], ["module", "test_count", "failed_count", "unknown_count"])


def test_git_facts(spark):
    commits = spark.createDataFrame([("h1", "ann", "fix crash"), ("h2", "ann", "docs")], "hash string, author string, subject string")
    changed = spark.createDataFrame([("h1", "m", 10), ("h1", "m", 2), ("h1", "n", 1), ("h2", "n", None)], "hash string, module_id string, churn bigint")
    same(P.git_facts(commits, changed, is_defect_subject(F.col("subject"))), [("m", 12, 1, 1, 1, 1), ("n", 1, 2, 1, 1, 1)], ["module_id", "churn", "commit_count", "contributor_count", "defect_commit_count", "cochange_count"])


def test_cohesion(spark):
    m = spark.createDataFrame([("T", "a", ["x"], [], True), ("T", "b", ["x", "y"], [], True), ("T", "c", [], ["b", "gone", "c"], True), ("T", "d", ["z"], [], True), ("U", "a", ["x"], [], True), ("V", "a", [], [], True), ("V", "b", [], [], True), ("W", "a", ["x"], [], True), ("W", "b", ["x"], [], False)], "type_id string, method string, fields array<string>, calls array<string>, complete boolean")
    same(P.structural_cohesion(m), [("T", 6, 1, 3, 16.67, 50.0, 2), ("U", 0, 0, 0, None, None, None), ("V", 1, 0, 0, None, None, None), ("W", 1, 1, 1, None, None, None)], ["type_id", "possible_pairs", "shared_pairs", "connected_pairs", "field_sharing_percent", "connected_pair_percent", "component_count"])
    f = files(spark, ("a", "ok", True, 1, False, 1), ("b", "ok", True, 1, False, 0))
    kinds = spark.createDataFrame([("a", 1, 1)], "module_id string, n_types bigint, n_impls bigint")
    churn = spark.createDataFrame([("src/a.rs", 5), ("src/x.rs", 5)], "path string, churn bigint")
    same(P.module_cohesion(f, kinds, churn), [("a", 4, 0.0, 5, 50.0, 0.5), ("b", 1, 100.0, 0, 0.0, 0.0)], ["module_id", "declaration_categories", "responsibility_focus", "changed_lines", "change_share_percent", "change_entropy_contribution"])


def test_validation_and_calibration(spark):
    modules = spark.createDataFrame([("p", "x::a", 5.0), ("p", "x::b", 1.0), ("p", "x::n", None), ("q", "y", 1.0)], "project string, module string, score double")
    outcomes = spark.createDataFrame([("p", "defect", ["a"], "reviewed-label"), ("q", "defect", ["y"], "repository-inferred")], "project string, kind string, modules array<string>, evidence_class string")
    same(P.validate_rankings(modules, outcomes, ["defect"]), [("p", 1.0, 100.0, "validated"), ("q", None, None, "no-labels")], ["project", "recall_at_top", "mean_percentile_rank", "status"])
    scores = spark.createDataFrame([("p", "f", float(i)) for i in range(10)] + [("q", "f", 100.0)], "project string, kind string, score double")
    same(P.calibrate(scores, "project", "kind", "score"), [("p", 10, 9.0), ("q", 1, 100.0), (None, 11, 9.0)], ["project", "n_values", "p90"])


def test_scope_and_gate(spark):
    rows = spark.createDataFrame([("a", "n", []), ("z", "a", []), ("z", "n", [("a",)]), ("z", None, None)], "path string, name string, instances array<struct<path: string>>")
    changed = spark.createDataFrame([("a",)], "path string")
    assert P.changed_scope(rows, changed, ("path", "name"), "instances").count() == 3 and P.changed_scope(rows, changed).count() == 1
    assert P.gate({"b": rows, "a": changed, "c": rows.limit(0)}) == ["a", "b"]
    same(P.map_edges(edges(spark, ("a", "b"), ("a", "b")), edges(spark, ("a", "b"))), [("a", "b", "dependency"), ("a", "b", "containment")], ["src", "dst", "kind"])
