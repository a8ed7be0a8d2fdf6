"""Tool outputs as tables: coverage, benchmarks, tests, mutants, compiler messages, telemetry, labels, external reports."""

from __future__ import annotations

from collections.abc import Sequence

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import percent, round2
from ..functions.text import compiler_rule, path_module_key, relative_to, slashes
from ..operators.windows import carry_forward

_METRIC = "struct<count: bigint, covered: bigint>"
_COVERAGE = f"data array<struct<files: array<struct<filename: string, segments: array<array<string>>, summary: struct<lines: {_METRIC}, regions: {_METRIC}, functions: {_METRIC}, branches: {_METRIC}>>>>>"


def _json(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", mode).json(path)


def coverage_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """One row a covered .rs file below root: path, module_key, four metrics and its segments.

    A metric has count, covered, percent and available. Without branches the percent is
    unknown; without anything else to cover it is 100. More covered than counted fails.
    """
    files = _json(spark, path, _COVERAGE).select(F.explode("data").alias("d")).select(F.explode("d.files").alias("f")).select("f.*")
    inside = F.col("filename").endswith(".rs") & (~F.col("filename").startswith("/") | F.col("filename").startswith(root.rstrip("/") + "/"))

    def metric(name: str):
        c = F.col(f"summary.{name}")
        n, k = c["count"], c["covered"]
        ok = F.when(n.isNotNull() & k.isNotNull() & (k <= n), k).otherwise(F.raise_error(F.concat(F.lit(f"bad {name} of "), "filename")))
        p = round2(percent(ok, n, None if name == "branches" else 100.0))
        return F.struct(n.alias("count"), ok.alias("covered"), p.alias("percent"), (F.lit(name != "branches") | (n > 0)).alias("available")).alias(name)

    at = relative_to(F.col("filename"), root)
    return files.filter(inside).select(at.alias("path"), path_module_key(at).alias("module_key"), *map(metric, ("lines", "regions", "functions", "branches")), "segments")


def line_hits(files: DataFrame) -> DataFrame:
    """path, line, covered: a line is covered if any of its counted segments was executed."""
    s = files.select("path", F.explode("segments").alias("s"))
    item = lambda i, t: F.get("s", F.lit(i)).try_cast(t)
    rows = s.select("path", item(0, "bigint").alias("line"), item(2, "bigint").alias("n"), item(3, "boolean").alias("counted")).filter("counted and line is not null and n is not null")
    return rows.groupBy("path", "line").agg(F.bool_or(F.col("n") > 0).alias("covered"))


_ESTIMATE = "struct<point_estimate: double, confidence_interval: struct<confidence_level: double, lower_bound: double, upper_bound: double>>"


def benchmark_estimates(spark: SparkSession, root: str) -> DataFrame:
    """id, estimate, low, high, level and samples of every */new/estimates.json below root, with its sibling sample.json.

    The slope is the estimate if there is one, else the mean. A record without a
    positive finite estimate has problem set.
    """
    read = lambda name, schema: spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root).withColumn("_dir", F.regexp_extract(F.input_file_name(), r"^(?:file:)?/*(/.*)/new/[^/]+$", 1)).filter("_dir <> ''")
    est = read("estimates.json", f"slope {_ESTIMATE}, mean {_ESTIMATE}")
    sample = read("sample.json", "times array<double>").select(F.col("_dir").alias("_sdir"), F.size("times").cast("bigint").alias("samples"))
    best = F.when(F.col("slope.point_estimate").isNotNull(), F.col("slope")).otherwise(F.col("mean"))
    joined = est.withColumn("e", best).join(sample, F.col("_dir") == F.col("_sdir"), "left")
    n = F.col("e.point_estimate")
    problem = F.when(n.isNull() | F.isnan(n) | (n <= 0) | (n == float("inf")), "no positive finite estimate")
    return joined.select(relative_to(F.col("_dir"), root).alias("id"), n.alias("estimate_nanoseconds"), F.col("e.confidence_interval.lower_bound").alias("low"), F.col("e.confidence_interval.upper_bound").alias("high"), F.col("e.confidence_interval.confidence_level").alias("level"), "samples", problem.alias("problem"))


# Lines of the test runner's output.
RUNNING = r"\s*Running\s+(?:(?:unittests|tests?)\s+)?(.+?\.rs)(?:\s+\(|$)"
OUTCOME = r"test\s+(.+?)\s+\.\.\.\s+(ok|FAILED|ignored)"


def test_statuses(lines: DataFrame, log: str, number: str, text: str) -> DataFrame:
    """Statuses of test output lines: log, path (of the last header, if any), name, status, and name_status.

    Lines are numbered within a log. name_status is unknown when the bare name occurs
    more than once in the log, whichever result came last.
    """
    file = F.when(F.col(text).rlike(RUNNING), F.replace(F.regexp_extract(text, RUNNING, 1), F.lit("\\"), F.lit("/")))
    found = carry_forward(lines.withColumn("_file", F.regexp_replace(file, '^"|"$', "")), [log], number, "_file", "path").filter(F.col("_file").isNull() & F.col(text).rlike(OUTCOME))
    raw = F.regexp_extract(text, OUTCOME, 2)
    status = F.when(raw == "ok", "passed").when(raw == "FAILED", "failed").otherwise("skipped")
    rows = found.select(log, number, "path", F.regexp_extract(text, OUTCOME, 1).alias("name"), status.alias("status"))
    n = rows.groupBy(F.col(log).alias("_log"), F.col("name").alias("_name")).agg(F.count("*").alias("_n"))
    return rows.join(n, (F.col(log) == F.col("_log")) & (F.col("name") == F.col("_name"))).select(log, number, "path", "name", "status", F.when(F.col("_n") > 1, "unknown").otherwise(F.col("status")).alias("name_status"))


def test_inventory(lines: DataFrame, log: str, text: str) -> DataFrame:
    """Names of a test listing and its problem, if any: an odd line, a missing or wrong summary, benchmarks, repeated names."""
    summary = r"^(\d+) tests?, (\d+) benchmarks?$"
    kind = F.when(F.col(text) == "", "blank").when(F.col(text).endswith(": test"), "test").when(F.col(text).rlike(summary), "summary").otherwise("odd")
    rows = lines.select(log, F.regexp_replace(text, ": test$", "").alias("name"), kind.alias("kind"), F.col(text).alias("raw"))
    checks = rows.groupBy(log).agg(
        F.count_if(F.col("kind") == "odd").alias("odd"), F.count_if(F.col("kind") == "test").alias("n"), F.countDistinct(F.when(F.col("kind") == "test", F.col("name"))).alias("distinct"),
        F.max(F.when(F.col("kind") == "summary", F.regexp_extract("raw", summary, 1).cast("bigint"))).alias("expected"), F.max(F.when(F.col("kind") == "summary", F.regexp_extract("raw", summary, 2).cast("bigint"))).alias("benches"),
    )
    problem = F.when(F.col("odd") > 0, "unsupported line").when(F.col("benches") > 0, "benchmarks").when(~F.coalesce(F.col("expected") == F.col("n"), F.lit(False)), "inconsistent summary").when(F.col("distinct") < F.col("n"), "duplicate names")
    good = checks.select(F.col(log).alias("_log"), problem.alias("problem"))
    return rows.filter("kind = 'test'").join(good, F.col(log) == F.col("_log")).select(log, "name", "problem")


def test_results(lines: DataFrame, run: list[str], text: str) -> DataFrame:
    """run columns, qualified_name and status (ok, FAILED, ignored) of repeated runs; a name with two results in a run has neither."""
    pattern = r"^test (.*) \.\.\. (ok|FAILED|ignored.*)$"
    raw = F.regexp_extract(text, pattern, 2)
    rows = lines.filter(F.col(text).rlike(pattern)).select(*run, F.regexp_extract(text, pattern, 1).alias("qualified_name"), F.when(raw.startswith("ignored"), "ignored").otherwise(raw).alias("status"))
    return rows.groupBy(*run, "qualified_name").agg(F.count("*").alias("_n"), F.min("status").alias("status")).filter("_n = 1").drop("_n")


_MUTANTS = "total_mutants bigint, cargo_mutants_version string, outcomes array<struct<summary: string, scenario: string>>"


def mutants(spark: SparkSession, path: str) -> DataFrame:
    """status (killed, survived, timeout, unviable), path, line, package, function of each mutant.

    Fails without a successful baseline, on an unknown outcome, on a mutant without
    file or line, and if the stated total is not the number of mutants.
    """
    docs = _json(spark, path, _MUTANTS)
    is_base = lambda o: o["scenario"] == "Baseline"
    good = F.exists("outcomes", lambda o: is_base(o) & (o["summary"] == "Success")) & (F.col("total_mutants") == F.size(F.filter("outcomes", lambda o: ~is_base(o))))
    checked = docs.withColumn("outcomes", F.when(F.coalesce(good, F.lit(False)), F.col("outcomes")).otherwise(F.raise_error(F.lit("mutation baseline or total is wrong"))))
    o = checked.select(F.explode(F.filter("outcomes", lambda x: ~is_base(x))).alias("o")).select("o.summary", F.from_json("o.scenario", "Mutant struct<file: string, package: string, function: struct<function_name: string>, span: struct<start: struct<line: bigint>>>").alias("m"))
    kinds = {"CaughtMutant": "killed", "MissedMutant": "survived", "Timeout": "timeout", "Unviable": "unviable"}
    status = F.try_element_at(F.create_map(*(F.lit(x) for p in kinds.items() for x in p)), "summary")
    m = F.col("m.Mutant")
    valid = status.isNotNull() & (F.coalesce(m["file"], F.lit("")) != "") & (m["span"]["start"]["line"] > 0)
    return o.select(F.when(F.coalesce(valid, F.lit(False)), status).otherwise(F.raise_error(F.concat(F.lit("unsupported mutant: "), F.coalesce("summary", F.lit("null"))))).alias("status"), m["file"].alias("path"), m["span"]["start"]["line"].alias("line"), m["package"].alias("package"), m["function"]["function_name"].alias("function"))


def mutation_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and 100 * killed / (killed + survived); null when nothing was decided."""
    n = {s: F.count_if(F.col("status") == s) for s in ("killed", "survived", "timeout", "unviable")}
    return rows.groupBy(*keys).agg(*(c.cast("bigint").alias(s) for s, c in n.items()), round2(percent(n["killed"], n["killed"] + n["survived"], None)).alias("score"))


_SPAN = "struct<file_name: string, line_start: bigint, column_start: bigint, is_primary: boolean>"


def compiler_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Warnings and errors of compiler messages in JSON lines, at their primary span or else the first. Other lines are skipped."""
    rows = spark.read.schema(f"reason string, message struct<level: string, message: string, rendered: string, code: struct<code: string>, spans: array<{_SPAN}>>").option("mode", "DROPMALFORMED").json(path)
    rows = rows.filter((F.col("reason") == "compiler-message") & F.col("message.level").isin("warning", "error")).select("message.*")
    span = F.coalesce(F.get(F.filter("spans", lambda s: s["is_primary"]), F.lit(0)), F.get("spans", F.lit(0)))
    return rows.select(compiler_rule(F.col("code.code")).alias("rule_id"), F.col("code.code").alias("code"), F.col("level").alias("severity"), "message", "rendered", span["file_name"].alias("path"), span["line_start"].alias("line"), span["column_start"].alias("column"))


def build_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """package_id, target name and kinds, and each file of built artifacts; a file once."""
    rows = spark.read.schema("reason string, package_id string, target struct<name: string, kind: array<string>>, filenames array<string>").option("mode", "DROPMALFORMED").json(path).filter("reason = 'compiler-artifact'")
    return rows.select("package_id", F.col("target.name").alias("target"), F.array_join("target.kind", ",").alias("kind"), F.explode("filenames").alias("path")).dropDuplicates(["path"])


def artifact_bytes(artifacts: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Bytes of the built files of each key, each path once; files without a size are counted as unknown.

    ``sizes``: path, bytes.
    """
    own = artifacts.select(*keys, "path").distinct().join(sizes.select(F.col("path").alias("_p"), "bytes").dropDuplicates(["_p"]), F.col("path") == F.col("_p"), "left")
    return own.groupBy(*keys).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes").isNull()).alias("n_unknown"))


def build_targets(spark: SparkSession, path: str) -> DataFrame:
    """package, target, kind, crate kinds and source path of every target of build metadata, each once."""
    rows = _json(spark, path, "packages array<struct<name: string, manifest_path: string, targets: array<struct<name: string, kind: array<string>, src_path: string>>>>")
    p = rows.select(F.explode("packages").alias("p")).select("p.name", "p.manifest_path", F.explode("p.targets").alias("t"))
    known = ["bin", "test", "bench", "example", "custom-build", "proc-macro"]
    kind = F.coalesce(F.get(F.array_intersect(F.array(*map(F.lit, known)), F.col("t.kind")), F.lit(0)), F.lit("lib"))
    return p.select(F.col("name").alias("package_name"), F.col("t.name").alias("target_name"), kind.alias("target_kind"), slashes(F.col("t.src_path")).alias("src_path"), slashes(F.col("manifest_path")).alias("manifest_path")).dropDuplicates(["package_name", "target_name", "target_kind", "src_path"])


def source_roots(targets: DataFrame) -> DataFrame:
    """Distinct source roots: the package's src and the folders of its targets."""
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    both = targets.select(F.concat(parent(F.col("manifest_path")), F.lit("/src")).alias("root")).unionByName(targets.select(parent(F.col("src_path")).alias("root")))
    return both.distinct()


# Statuses of a signal.
SIGNAL_STATUSES = ("healthy", "breached", "unknown")
SIGNALS = "id string, kind string, status string, value double, unit string, threshold string, modules array<string>, service string, source string"


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Signals with window_end; a signal without id, kind, source, a known status or a number fails the read."""
    rows = _json(spark, path, f"window struct<end: string>, signals array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in SIGNALS.split(', '))}>>")
    end = F.try_to_timestamp("window.end")
    s = rows.select(F.when(end.isNotNull(), end).otherwise(F.raise_error(F.lit("telemetry needs window.end as RFC 3339"))).alias("window_end"), F.explode("signals").alias("s")).select("window_end", "s.*")
    return s.select(*(F.when(valid_signal(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("invalid signal "), F.coalesce("id", F.lit("without id"))))).alias(c) if c == "status" else F.col(c) for c in s.columns)).withColumn("modules", F.coalesce("modules", F.array().cast("array<string>")))


def valid_signal():
    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return text("id") & text("kind") & text("source") & F.col("status").isin(*SIGNAL_STATUSES) & F.col("value").isNotNull()


def outcome_labels(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed labels: commit and kind are required, lists hold no blank text."""
    rows = _json(spark, path, "commit string, kind string, timestamp string, subject string, source string, paths array<string>, modules array<string>")
    blank = lambda c: F.coalesce(F.exists(c, lambda x: x.isNull() | (F.trim(x) == "")), F.lit(False))
    ok = F.coalesce((F.trim("commit") != "") & (F.trim("kind") != ""), F.lit(False)) & ~blank("paths") & ~blank("modules")
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("paths", "modules")}
    return rows.withColumn("commit", F.when(ok, F.col("commit")).otherwise(F.raise_error(F.lit("invalid outcome label")))).withColumns(lists | {"source": F.coalesce("source", slashes(F.input_file_name())), "evidence_class": F.lit("reviewed-label"), "review_required": F.lit(False)})


_EXTERNAL = "schema_version int, adapter string, data struct<tool: struct<name: string, version: string>, status: string, confidence: struct<complete: boolean>, input_fingerprint: struct<digest: string, complete: boolean>, findings: array<struct<rule_id: string, severity: string, path: string, line: bigint, message: string>>>"


def external_findings(spark: SparkSession, folder: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Findings of imported reports that are complete and match the current inputs, and the reasons of the others."""
    rows = _json(spark, f"{folder.rstrip('/')}/external_*.json", _EXTERNAL, "PERMISSIVE").withColumn("file", F.regexp_extract(F.input_file_name(), "[^/]+$", 0))
    d = F.col("data")
    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("adapter").rlike("^[A-Za-z0-9_-]+$"), F.lit(False)), "bad adapter name")
        .when((F.col("schema_version") != 1) | (F.concat(F.lit("external_"), "adapter", F.lit(".json")) != F.col("file")), "schema version or file name mismatch")
        .when(~text(d["tool"]["name"]) | ~text(d["tool"]["version"]), "tool is not named")
        .when(~F.coalesce(d["status"].isin("completed", "failed", "partial", "unavailable"), F.lit(False)), "unknown status")
        .when(~F.coalesce((d["status"] == "completed") & d["confidence"]["complete"] & d["input_fingerprint"]["complete"] & (d["input_fingerprint"]["digest"] == digest), F.lit(False)), "incomplete, stale or not linked to the sources")
    )
    marked = rows.withColumn("reason", reason)
    found = marked.filter("reason is null").select("adapter", F.posexplode("data.findings").alias("record_index", "f")).select("adapter", "record_index", F.concat(F.lit("external."), "adapter", F.lit("."), F.coalesce("f.rule_id", F.lit(""))).alias("rule_id"), "f.severity", "f.path", "f.line", "f.message")
    return found, marked.filter("reason is not null").select("file", "adapter", "reason")


def fault_evidence(spark: SparkSession, path: str) -> DataFrame:
    """experiment id, behavior, baseline, faulted and restored status, classified: not_run, inconclusive, reported_detected or survived."""
    rows = _json(spark, path, "experiments array<struct<id: string, behavior: string, baseline: string, faulted: string, restored: string>>").select(F.explode("experiments").alias("x")).select("x.*")
    sound = (F.col("baseline") == "passed") & (F.col("restored") == "passed")
    kind = F.when(F.col("faulted").isNull() | (F.col("faulted") == "not_run"), "not_run").when(~F.coalesce(sound, F.lit(False)), "inconclusive").when(F.col("faulted") == "failed", "reported_detected").when(F.col("faulted") == "passed", "survived").otherwise("inconclusive")
    return rows.withColumn("classification", kind)


def api_items(spark: SparkSession, path: str) -> DataFrame:
    """Distinct items of a public-API listing: trimmed, without blank lines and comments."""
    return spark.read.text(path).select(F.trim("value").alias("item")).filter((F.col("item") != "") & ~F.col("item").startswith("//")).distinct()


def peak_rss(lines: DataFrame, text: str) -> DataFrame:
    """Peak resident set in kB of resource reports ("Maximum resident set size (kbytes): n")."""
    pattern = r"Maximum resident set size \(kbytes\):\s*(\d+)"
    return lines.filter(F.col(text).rlike(pattern)).select(F.regexp_extract(text, pattern, 1).cast("bigint").alias("peak_kb"))


def budget_results(spark: SparkSession, budgets: dict[str, float], metrics: DataFrame) -> DataFrame:
    """metric, budget, value and status: breached, healthy, or unknown without a value."""
    table = spark.createDataFrame(sorted(budgets.items()), "metric string, budget double")
    joined = F.broadcast(table).join(metrics.select(F.col("metric").alias("_m"), F.col("value").cast("double").alias("value")), F.col("metric") == F.col("_m"), "left")
    return joined.select("metric", "budget", "value", F.when(F.col("value").isNull(), "unknown").when(F.col("value") > F.col("budget"), "breached").otherwise("healthy").alias("status"))


def captures(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every capture of a folder with an explicit schema; a file that doesn't fit fails the read."""
    return _json(spark, f"{folder.rstrip('/')}/*.json", schema)


def toml_config(path: str, known: dict[str, type | tuple[type, ...]] | None = None) -> dict:
    """A TOML file on the driver; unknown keys and wrong types are errors."""
    config = tomllib.loads(Path(path).read_text())
    for key, value in config.items() if known is not None else ():
        if key not in known:
            raise ValueError(f"unknown field {key}")
        if not isinstance(value, known[key]):
            raise ValueError(f"field {key} has the wrong type")
    return config
