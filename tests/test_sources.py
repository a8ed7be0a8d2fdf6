"""Readers over small files written here."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyweir.sources import artifacts, diffs, files, gitlog, reports
from tallyweir.streaming import signals

from .conftest import same

H = "a" * 40


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_numstat(spark, tmp_path):
    log = "commit:h1\tann\tfix a\tb\n\n10\t2\tsrc\\a.rs\n-\t-\tlogo.png\nodd line\ncommit:h2\tbob\tempty\n\n"
    same(gitlog.numstat_log(spark, put(tmp_path / "log", log)), [("h1", "ann", "fix a\tb", "src/a.rs", 10, 2), ("h1", "ann", "fix a\tb", "logo.png", 0, 0), ("h2", "bob", "empty", None, None, None)], ["hash", "author", "subject", "path", "added", "deleted"])
    same(gitlog.numstat_z(spark, put(tmp_path / "z", "1\t2\ta b\x003\t0\ta b\x000\t0\tc\x00")), [("a b", 6), ("c", 0)], ["path", "churn"])
    with pytest.raises(Exception, match="not a numstat row"):
        gitlog.numstat_z(spark, put(tmp_path / "bad", "-\t2\ta\x00")).collect()


def test_outcome_and_nul_logs(spark, tmp_path):
    log = "commit:h1\t2025-01-01T00:00:00Z\tRevert the bug fix\n\nsrc/a.rs\nsrc/a.rs\nREADME.md\ncommit:h2\t2025\tdocs\n\nx.rs\n"
    same(gitlog.outcome_log(spark, put(tmp_path / "o", log)), [("h1", "defect", ["README.md", "src/a.rs"], ["a"]), ("h1", "revert", ["README.md", "src/a.rs"], ["a"])], ["commit", "kind", "paths", "modules"])
    text = f"\x00{H}\x00e@x\x001700000000\x00\x00\na.rs\x00b c.rs\x00\x00{'b' * 40}\x00f@x\x001700000001\x00\x00"
    same(gitlog.nul_log(spark, put(tmp_path / "n", text)), [(H, "e@x", ["a.rs", "b c.rs"]), ("b" * 40, "f@x", [])], ["hash", "author", "paths"])
    for broken in ("short\x00a\x001\x00\x00", f"{H}\x00\x001\x00\x00", f"{H}\x00a\x00x\x00\x00"):
        with pytest.raises(ValueError):
            list(gitlog.parse_nul_log(broken))


def test_coverage(spark, tmp_path):
    m = lambda n, k: {"count": n, "covered": k}
    f = {"filename": "/p/src/a.rs", "segments": [[1, 1, 0, True, True], [1, 5, 3, True, False], [2, 1, 0, True, True], [3, 1, 9, False, True]], "summary": {"lines": m(3, 2), "regions": m(0, 0), "functions": m(1, 1), "branches": m(0, 0)}}
    doc = {"data": [{"files": [f, {**f, "filename": "/q/b.rs"}, {**f, "filename": "c.txt"}]}]}
    found = reports.coverage_files(spark, put(tmp_path / "c.json", doc), "/p")
    row = found.collect()
    assert [(r["path"], r["lines"]["percent"], r["regions"]["percent"], r["branches"]["percent"], r["branches"]["available"]) for r in row] == [("src/a.rs", 66.67, 100.0, None, False)]
    same(reports.line_hits(found), [("src/a.rs", 1, True), ("src/a.rs", 2, False)], ["path", "line", "covered"])
    f["summary"]["lines"] = m(1, 2)
    with pytest.raises(Exception, match="bad lines"):
        reports.coverage_files(spark, put(tmp_path / "d.json", doc), "/p").collect()


def test_benchmarks(spark, tmp_path):
    e = lambda n: {"point_estimate": n, "confidence_interval": {"confidence_level": 0.95, "lower_bound": n - 1, "upper_bound": n + 1}}
    put(tmp_path / "g/x/new/estimates.json", {"mean": e(5.0), "slope": e(4.0)})
    put(tmp_path / "g/x/new/sample.json", {"times": [1, 2, 3]})
    put(tmp_path / "g/x/base/estimates.json", {"mean": e(9.0)})
    put(tmp_path / "y/new/estimates.json", {"mean": e(-1.0), "slope": None})
    same(reports.benchmark_estimates(spark, str(tmp_path)), [("g/x", 4.0, 3.0, 3, None), ("y", -1.0, -2.0, None, "no positive finite estimate")], ["id", "estimate_nanoseconds", "low", "samples", "problem"])


def test_test_output(spark):
    text = ["     Running unittests src/lib.rs (target/x)", "test a::b ... ok", "test c ... FAILED", "   Running tests/it.rs (y)", "test c ... ignored, why", "noise"]
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(text)], "log string, n bigint, t string")
    same(reports.test_statuses(lines, "log", "n", "t"), [("src/lib.rs", "a::b", "passed", "passed"), ("src/lib.rs", "c", "failed", "unknown"), ("tests/it.rs", "c", "skipped", "unknown")], ["path", "name", "status", "name_status"])
    listing = lambda *t: reports.test_inventory(spark.createDataFrame([("l", x) for x in t], "log string, t string"), "log", "t")
    same(listing("a: test", "b: test", "", "2 tests, 0 benchmarks"), [("a", None), ("b", None)], ["name", "problem"])
    assert [listing(*t).first()["problem"] for t in (["a: test"], ["a: test", "2 tests, 0 benchmarks"], ["a: test", "a: test", "2 tests, 0 benchmarks"], ["a: test", "x", "1 test, 0 benchmarks"], ["a: test", "1 test, 1 benchmark"])] == ["inconsistent summary", "inconsistent summary", "duplicate names", "unsupported line", "benchmarks"]
    runs = spark.createDataFrame([(0, "test a ... ok"), (0, "test b ... ok"), (0, "test b ... FAILED"), (1, "test a ... ignored: slow"), (1, "x")], "iteration int, t string")
    same(reports.test_results(runs, ["iteration"], "t"), [(0, "a", "ok"), (1, "a", "ignored")], ["iteration", "qualified_name", "status"])


def test_mutants(spark, tmp_path):
    mutant = lambda s, line=3: {"summary": s, "scenario": {"Mutant": {"file": "a.rs", "package": "p", "function": {"function_name": "f"}, "span": {"start": {"line": line}}}}}
    base = {"summary": "Success", "scenario": "Baseline"}
    doc = {"total_mutants": 3, "outcomes": [base, mutant("CaughtMutant"), mutant("MissedMutant"), mutant("Timeout")]}
    found = reports.mutants(spark, put(tmp_path / "m.json", doc))
    same(reports.mutation_score(found, ["package"]), [("p", 1, 1, 1, 0, 50.0)], ["package", "killed", "survived", "timeout", "unviable", "score"])
    for i, bad in enumerate(({**doc, "total_mutants": 2}, {**doc, "outcomes": doc["outcomes"][1:]}, {**doc, "outcomes": [base, mutant("Odd"), mutant("Timeout"), mutant("Timeout")]}, {"total_mutants": 1, "outcomes": [base, mutant("Timeout", 0)]})):
        with pytest.raises(Exception, match="mutation baseline|unsupported mutant"):
            reports.mutants(spark, put(tmp_path / f"b{i}.json", bad)).collect()


def test_compiler_messages(spark, tmp_path):
    span = lambda f, p: {"file_name": f, "line_start": 4, "column_start": 2, "is_primary": p}
    msg = lambda level, code, spans: json.dumps({"reason": "compiler-message", "message": {"level": level, "message": "m", "rendered": "r", "code": code and {"code": code}, "spans": spans}})
    text = "\n".join([msg("warning", "clippy::too_many", [span("a", False), span("b", True)]), msg("error", "E0308", [span("a", False)]), msg("error", None, []), msg("note", None, []), "garbage", json.dumps({"reason": "compiler-artifact", "package_id": "p", "target": {"name": "t", "kind": ["lib"]}, "filenames": ["/x", "/y"]})])
    path = put(tmp_path / "c.jsonl", text)
    same(reports.compiler_diagnostics(spark, path), [("rust.clippy.too-many", "b", 4), ("rust.compiler.e0308", "a", 4), ("rust.compiler.diagnostic", None, None)], ["rule_id", "path", "line"])
    same(reports.build_artifacts(spark, path), [("p", "/x"), ("p", "/y")], ["package_id", "path"])


def test_build_metadata(spark, tmp_path):
    doc = {"packages": [{"name": "p", "manifest_path": "/w/p/Cargo.toml", "targets": [{"name": "p", "kind": ["lib"], "src_path": "/w/p/src/lib.rs"}, {"name": "b", "kind": ["bench"], "src_path": "/w/p/benches/b.rs"}]}]}
    targets = reports.build_targets(spark, put(tmp_path / "m.json", doc))
    same(targets, [("p", "lib"), ("b", "bench")], ["target_name", "target_kind"])
    same(reports.source_roots(targets), [("/w/p/src",), ("/w/p/benches",)], ["root"])


def test_telemetry_and_labels(spark, tmp_path):
    s = {"id": "i", "kind": "k", "status": "breached", "source": "s", "value": 1}
    doc = {"window": {"end": "2025-01-01T00:00:00Z"}, "signals": [s]}
    same(reports.telemetry(spark, put(tmp_path / "t.json", doc)), [("i", "breached", 1.0, [])], ["id", "status", "value", "modules"])
    for i, bad in enumerate(({**s, "status": "odd"}, {**s, "value": None}, {**s, "id": " "})):
        with pytest.raises(Exception, match="invalid signal"):
            reports.telemetry(spark, put(tmp_path / f"b{i}.json", {**doc, "signals": [bad]})).collect()
    with pytest.raises(Exception, match="window.end"):
        reports.telemetry(spark, put(tmp_path / "w.json", {**doc, "window": {"end": "soon"}})).collect()
    same(reports.outcome_labels(spark, put(tmp_path / "l.json", [{"commit": "c", "kind": "defect", "source": "x"}])), [("c", "defect", [], "x", False)], ["commit", "kind", "paths", "source", "review_required"])
    with pytest.raises(Exception, match="invalid outcome label"):
        reports.outcome_labels(spark, put(tmp_path / "m.json", [{"commit": "c", "kind": "d", "paths": [" "]}])).collect()


def test_external(spark, tmp_path):
    data = {"tool": {"name": "t", "version": "1"}, "status": "completed", "confidence": {"complete": True}, "input_fingerprint": {"digest": "d", "complete": True}, "findings": [{"rule_id": "r", "path": "a"}]}
    put(tmp_path / "external_ok.json", {"schema_version": 1, "adapter": "ok", "data": data})
    put(tmp_path / "external_old.json", {"schema_version": 1, "adapter": "old", "data": {**data, "input_fingerprint": {"digest": "e", "complete": True}}})
    put(tmp_path / "external_x.json", {"schema_version": 1, "adapter": "y", "data": data})
    found, reasons = reports.external_findings(spark, str(tmp_path), "d")
    same(found, [("external.ok.r", "a", 0)], ["rule_id", "path", "record_index"])
    same(reasons, [("external_old.json", "incomplete, stale or not linked to the sources"), ("external_x.json", "schema version or file name mismatch")], ["file", "reason"])


def test_small_readers(spark, tmp_path):
    x = {"id": "1", "behavior": "b", "baseline": "passed", "restored": "passed"}
    doc = {"experiments": [{**x, "faulted": "failed"}, {**x, "faulted": "passed"}, {**x, "faulted": "failed", "restored": "failed"}, x]}
    assert sorted(r["classification"] for r in reports.fault_evidence(spark, put(tmp_path / "f.json", doc)).collect()) == ["inconclusive", "not_run", "reported_detected", "survived"]
    same(reports.api_items(spark, put(tmp_path / "api", " pub fn a()\n\n// x\npub fn a()\n")), [("pub fn a()",)], ["item"])
    same(reports.peak_rss(spark.createDataFrame([("\tMaximum resident set size (kbytes): 54396",), ("x",)], "t string"), "t"), [(54396,)], ["peak_kb"])
    same(reports.budget_results(spark, {"ms": 5.0, "kb": 9.0, "n": 1.0}, spark.createDataFrame([("ms", 6.0), ("kb", 9.0)], "metric string, value double")), [("ms", "breached"), ("kb", "healthy"), ("n", "unknown")], ["metric", "status"])
    assert reports.toml_config(put(tmp_path / "c.toml", "a = 1"), {"a": int}) == {"a": 1}
    for text in ("b = 1", 'a = "x"'):
        with pytest.raises(ValueError):
            reports.toml_config(put(tmp_path / "d.toml", text), {"a": int})


def test_source_tree(spark, tmp_path):
    put(tmp_path / "src/a.rs", "// c\n\nfn x() {}\n  // d\n")
    put(tmp_path / "target/b.rs", "x")
    put(tmp_path / "src/c.txt", "x")
    tree = files.source_tree(spark, [str(tmp_path)])
    same(files.line_counts(tree), [(str(tmp_path / "src/a.rs"), 1, 2)], ["path", "source_nonblank_line_count", "source_comment_line_count"])
    one = files.content_fingerprint(tree, str(tmp_path))
    assert one == files.content_fingerprint(tree.repartition(3), str(tmp_path)) and one[1] == 1
    put(tmp_path / "src/a.rs", "changed")
    assert files.content_fingerprint(files.source_tree(spark, [str(tmp_path)]), str(tmp_path)) != one


def test_diffs(spark):
    good = 'diff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/x.rs\n@@ -1,2 +1,4 @@\n a\n+b\n+c\n d\n@@ -9 +11 @@\n-x\n+--- y\n\\ No newline at end of file\ndiff --git "a/\\303\\251.rs" b/z\n--- "a/\\303\\251.rs"\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\ndiff --git a/o b/n\nrename from o\nrename to n\n'
    assert diffs.parse_diff(good) == ({"x.rs", "é.rs", "n"}, {"x.rs": [[2, 3], [11, 11]]})
    for bad in ("--- a/x\n+++ b/x\n@@ -1,2 +1 @@\n a\n", "--- a/../x\n+++ b/x\n", "+++ /etc/x\n", "diff --cc x\n", "@@ -1 +1 @@\n", '+++ "b/x\n', "--- a/x\n+++ b/x\n@@ -1 +1 @@\nq\n"):
        with pytest.raises(diffs.DiffError):
            diffs.parse_diff(bad)
    df = spark.createDataFrame([("a", good), ("b", "diff --cc x"), ("c", None)], "k string, t string")
    same(diffs.diff_ranges(df, "k", "t"), [("a", "x.rs", 2, None), ("a", "x.rs", 11, None), ("a", "é.rs", None, None), ("a", "n", None, None), ("b", None, None, "combined diff")], ["k", "path", "start_line", "error"])


def test_artifacts(spark, tmp_path):
    ok = {"schema_version": 3, "tool": "hotspots", "risk_model_version": 4, "input_fingerprint": {"digest": "d", "complete": True}, "measurement_confidence": {"complete": True, "partial": False}, "records": []}
    put(tmp_path / "hotspots.json", ok)
    put(tmp_path / "clones.json", {**ok, "tool": "clones", "input_fingerprint": {"digest": "e", "complete": True}})
    put(tmp_path / "map.json", {**ok, "tool": "map"})
    put(tmp_path / "leverage.json", {**ok, "tool": "leverage", "measurement_confidence": {"complete": True, "partial": True}})
    put(tmp_path / "locality.json", {**ok, "tool": "locality", "measurement_confidence": {"complete": False, "partial": True}})
    put(tmp_path / "coverage.json", "{broken")
    found = artifacts.read_artifacts(spark, str(tmp_path), ["hotspots", "clones", "map", "leverage", "locality", "coverage", "cohesion"], "d")
    same(found, [("hotspots", "available", "[]"), ("clones", "stale", None), ("map", "incompatible", None), ("leverage", "incompatible", None), ("locality", "partial", "[]"), ("coverage", "unreadable", None), ("cohesion", "missing", None)], ["tool", "status", "payload"])
    with pytest.raises(Exception, match="clones.json: stale"):
        artifacts.read_artifacts(spark, str(tmp_path), ["clones"], "d", strict=True).collect()
    rows = artifacts.envelope("hotspots", spark.createDataFrame([("m", 1.0)], "module string, score double"), "d", 3, True, "now", [])
    assert rows.first()["records"]["score"] == 1.0 and rows.first()["measurement_confidence"]["complete"]
    assert artifacts.check_schema(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x", 1)], "a string, b int").schema) == ["a is int, not string", "missing b"]


def test_publish_and_sarif(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    artifacts.publish(spark, {"one": df}, str(tmp_path / "out"), lambda: True)
    with pytest.raises(RuntimeError):
        artifacts.publish(spark, {"one": df.union(df), "two": df}, str(tmp_path / "out"), lambda: False)
    assert spark.read.parquet(str(tmp_path / "out/one")).count() == 1 and not (tmp_path / "out/two").exists()
    rows = [("r.a", "m1", "a\\b.rs", 4, None, None, "warning", "i", None), ("r.a", "m2", "a.rs", None, None, "block", None, None, "known"), (None, "x", "y", 1, 1, None, None, None, None), ("r.b", None, None, 1, 1, None, None, None, None)]
    findings = spark.createDataFrame(rows, "rule_id string, message string, path string, line bigint, column bigint, disposition string, severity string, id string, waiver_reason string")
    artifacts.write_sarif(findings, str(tmp_path / "x.sarif"), "t")
    run = json.loads((tmp_path / "x.sarif").read_text())["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r.a", "r.b"] and len(run["results"]) == 3
    by = {r["message"]["text"]: r for r in run["results"]}
    assert by["m1"]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a/b.rs"}, "region": {"startLine": 4}}
    assert "region" not in by["m2"]["locations"][0]["physicalLocation"] and by["m2"]["suppressions"][0]["justification"] == "known" and by["m2"]["level"] == "error"
    assert "locations" not in by["r.b"] and by["r.b"]["level"] == "note"


def test_streams(spark, tmp_path):
    s = {"window_end": "2025-01-01T00:05:00Z", "id": "i", "kind": "k", "status": "breached", "source": "s", "value": 1, "service": "a"}
    put(tmp_path / "in/1.json", "\n".join(map(json.dumps, [s, s, {**s, "id": "j", "status": "healthy"}, {**s, "status": "odd"}])))
    q = signals.latest_breaches(signals.signal_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("breaches").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    same(spark.table("breaches"), [("a", 2, 1)], ["service", "n", "breached"])
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "ev"))
    q = signals.event_rates(spark, str(tmp_path / "ev")).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy(F.to_date("ts"), "event_type").count()
    assert sorted(r["n"] for r in spark.table("rates").collect()) == sorted(r["count"] for r in batch.collect())
