from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tallyweir.operators import review as R

from .conftest import same


def test_ids_survive_moves(spark):
    rows = [("r", "a.rs", 3, "  let x = 1; "), ("r", "a.rs", 9, "let  x = 1;"), ("r", "b.rs", 3, "let x = 1;"), ("r", "a.rs", 5, None)]
    schema = "rule_id string, path string, line bigint, source_line string"
    one = {(r["path"], r["line"]): r["id"] for r in R.finding_ids(spark.createDataFrame(rows, schema)).collect()}
    two = {(r["path"], r["line"] - 1): r["id"] for r in R.finding_ids(spark.createDataFrame([(a, b, n + 1, s) for a, b, n, s in rows], schema)).collect()}
    assert one == two and len(set(one.values())) == 4


def test_dependencies(spark):
    modules = spark.createDataFrame([("p::t::a",), ("p::t::a::b",), ("p::t::a::c",), ("p::t::lib",)], "module_id string").withColumn("module_key", F.lit("a"))
    refs = spark.createDataFrame([("p::t::a::b", "super::c::f"), ("p::t::a::b", "super::g"), ("p::t::lib", "crate::a::b::T"), ("p::t::lib", "a"), ("p::t::lib", "std::fmt"), ("p::t::lib", "crate::a::use"), ("p::t::a", "self::b::X")], "module_id string, raw_path string")
    same(R.resolve_dependencies(refs, modules), [("p::t::a::b", "p::t::a::c"), ("p::t::lib", "p::t::a::b"), ("p::t::lib", "p::t::a"), ("p::t::a", "p::t::a::b")], ["src", "dst"])
    same(R.semantic_candidates(refs, modules), [(p,) for p in ("super::c::f", "super::g", "crate::a::b::T", "a", "crate::a::use", "self::b::X")], ["raw_path"])


def test_targets_and_test_code(spark):
    targets = spark.createDataFrame([("/w/p/src/lib.rs", "/w/p/Cargo.toml", "p", "p", "lib"), ("/w/p/q/src/main.rs", "/w/p/q/Cargo.toml", "q", "q", "bin")], "src_path string, manifest_path string, package_name string, target_name string, target_kind string")
    files = spark.createDataFrame([("/w/p/src/lib.rs",), ("/w/p/q/tests/x.rs",), ("/w/p/q/src/a.rs",), ("/else/y.rs",)], "path string")
    same(R.target_metadata(files, targets), [("/w/p/src/lib.rs", "p", "p", "lib"), ("/w/p/q/tests/x.rs", "q", None, "test"), ("/w/p/q/src/a.rs", "q", None, "lib"), ("/else/y.rs", None, None, "lib")], ["path", "package_name", "target_name", "target_kind"])
    f = spark.createDataFrame([("p", "a::tests::x", False), ("p", "a", None), ("q", "a::tests", False)], "package_name string, module_key string, test_code boolean")
    same(R.propagate_test_code(f, spark.createDataFrame([("p", "a::tests")], "package_name string, module_key string")), [("a::tests::x", True), ("a", False), ("a::tests", False)], ["module_key", "test_code"])


def test_definitions_and_references(spark):
    places = [(1, "/usr/lib/vec.rs", 0), (1, "/w/src/a.rs", 1), (1, "/w/src/b.rs", 2), (2, "/usr/lib/vec.rs", 0), (2, "/w/target/gen.rs", 1), (3, "/usr/lib/vec.rs", 0), (4, "/usr/x.rs", 0), (4, "/w/src/lost.rs", 1), (5, None, 0), (6, "/w/targets.rs", 0), (7, "/w/src/b.rs", 0)]
    d = spark.createDataFrame(places, "ref int, path string, position int")
    modules = spark.createDataFrame([("/w/src/a.rs", "a"), ("/w/src/b.rs", "b")], "path string, module_id string")
    found = R.best_definition(d, ["ref"], modules, ["/w"], "/w/target")
    expected = [(1, "a", "resolved_local"), (2, None, "unmapped_generated_definition"), (3, None, "resolved_external"), (4, None, "unindexed_project_definition"), (5, None, "unmapped_generated_definition"), (6, None, "unindexed_project_definition"), (7, "b", "resolved_local")]
    same(found, expected, ["ref", "target_module_id", "status"])
    same(R.status_histogram(found), [("resolved_local", 2), ("unmapped_generated_definition", 2), ("resolved_external", 1), ("unindexed_project_definition", 2)], ["status", "n_references"])
    refs = spark.createDataFrame([("c", "o", "t"), ("c", "o", "twice"), ("c", "gone", "t"), ("c", "o", "o")], "context string, owner string, target string")
    decl = spark.createDataFrame([("c", "o", "m"), ("c", "t", "n"), ("c", "twice", "m"), ("c", "twice", "n"), ("d", "gone", "m")], "context string, id string, module string")
    edges, open_ = R.resolve_references(refs, decl)
    same(edges, [("m", "n")], ["src", "dst"])
    same(open_, [("twice", "target"), ("t", "owner")], ["target", "unresolved"])


def test_summaries(spark):
    checks = spark.createDataFrame([("a", "passed", "error", False), ("a", "failed", "warning", None), ("a", "skipped", "error", False), ("a", "timed-out", "error", False), ("b", "failed", "error", False), ("c", "passed", "error", True), ("d", "passed", "error", None)], "k string, status string, severity string, incomplete boolean")
    diag = spark.createDataFrame([("a", "r", "m", "p", 1, 1)] * 2 + [("a", "r", "m", "p", 1, 2), ("a", "r", "m", "p", None, None), ("b", "r", "m", "p", 1, 1)], "k string, rule_id string, message string, path string, line bigint, column bigint")
    assert tuple(R.practice_summary(checks, diag).first()) == (7, 3, 3, 1, 1, 1, 1, False)
    same(R.practice_summary(checks, diag, ["k"]), [("a", 4, 3, 1, 0, 1, 1, 1, False), ("b", 1, 1, 0, 1, 0, 0, 0, False), ("c", 1, 0, 1, 0, 0, 0, 0, False), ("d", 1, 0, 1, 0, 0, 0, 0, True)], ["k", "check_count", "diagnostic_count", "passed", "failed_errors", "failed_warnings", "unavailable", "skipped", "conformant"])
    value = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert [value(R.coverage_change(F.lit(c).cast("double"), F.lit(80.0), 1.0)) for c in (78.0, 79.5, 81.0, None)] == ["regressed", "unchanged", "improved", "unknown"]
    ranges = spark.createDataFrame([("a", 1, 5), ("a", 3, 9), ("b", None, None)], "path string, start_line bigint, end_line bigint")
    hits = spark.createDataFrame([("a", 3, True), ("a", 4, False), ("a", 20, True), ("b", 1, True)], "path string, line bigint, covered boolean")
    same(R.changed_line_coverage(ranges, hits), [("a", 2, 1, 50.0)], ["path", "executable", "covered", "percent"])
    assert [value(R.declaration_only(F.lit(s))) for s in ("pub struct A\n{\n  x: u8,\n\n}", "pub struct A {\nfoo();")] == [True, False]
    assert [value(R.run_status(F.lit(e).cast("int"), F.lit(o).cast("string"), F.lit(t))) for e, o, t in ((0, "", False), (1, "error: could not compile", False), (1, "x", False), (None, None, False), (None, "x", False), (0, "", True))] == ["passed", "compile_failed", "failed", "unavailable", "incomplete", "timed_out"]
    assert value(R.test_failures(F.lit(None).cast("string"), F.lit(0))) == "test evidence is missing" and value(R.test_failures(F.lit("passed"), F.lit(0))) is None


def test_regressions_and_cache(spark):
    now = spark.createDataFrame([("a", 5.0, 4), ("b", 9.0, 4), ("n", 3.0, 4)], "m string, s double, risk_model_version int")
    old = spark.createDataFrame([("a", 5.0, 4), ("b", 5.0, 4), ("gone", 1.0, 4)], "m string, s double, risk_model_version int")
    same(R.score_regressions(now, old, "m", "s", 1.0), [("b", 4.0), ("n", 3.0)], ["m", "delta"])
    with pytest.raises(Exception, match="versions differ"):
        R.score_regressions(now, old.withColumn("risk_model_version", F.lit(3)), "m", "s", 1.0).collect()
    made, digest = [], uuid.uuid4().hex
    for _ in range(2):
        assert R.cached(spark, "t", digest, lambda: made.append(1) or now).count() == 3
    assert made == [1]
