"""Steps of reviews and gates that work on whole tables: identities, references, regressions, changed lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import percent, round2
from ..functions.text import anchor
from ..storage import shared_dir
from .joins import longest_prefix_join, null_safe, prefixes, range_join
from .windows import occurrence

C = F.col


def finding_ids(findings: DataFrame) -> DataFrame:
    """id of each finding from rule, path and the collapsed source line, with an ordinal among equal ones.

    The id survives when lines move. ``findings``: rule_id, path, line, source_line.
    """
    keyed = findings.withColumn("_anchor", F.sha2(F.concat_ws("\x00", "rule_id", "path", F.coalesce(anchor(C("source_line")), F.lit(""))), 256))
    return occurrence(keyed, ["rule_id", "path", "_anchor"], ["line"], "occurrence").withColumn("id", F.concat(F.substring("_anchor", 1, 16), F.lit("-"), "occurrence")).drop("_anchor")


def declares(line: Column) -> Column:
    """Whether a stripped line only declares: a lone brace, an attribute, a public struct, a field, or nothing."""
    field = line.endswith(",") & line.contains(":") & ~line.contains("(")
    return line.isin("", "{", "}") | line.rlike(r"^(#\[|pub(\(crate\))? struct )") | field


def declaration_only(snippet: Column) -> Column:
    """Whether every line of a snippet only declares."""
    return F.forall(F.split(snippet, "\n"), lambda line: declares(F.regexp_replace(line, r"(?U)^\s+|\s+$", "")))


def semantic_candidates(references: DataFrame, modules: DataFrame) -> DataFrame:
    """References whose path looks local: crate, self or super, or a first segment that some module begins with."""
    first = modules.select(F.element_at(F.split("module_key", "::"), 1).alias("_f")).unionByName(modules.select(F.element_at(F.split("module_id", "::"), 1).alias("_f"))).filter("_f <> ''").distinct()
    own = references.withColumn("_first", F.element_at(F.split("raw_path", "::"), 1))
    local = own.filter(C("_first").isin("crate", "self", "super"))
    named = own.filter(~C("_first").isin("crate", "self", "super")).join(first, C("_first") == C("_f"), "left_semi")
    return local.unionByName(named).drop("_first")


def resolve_dependencies(references: DataFrame, modules: DataFrame, module_key: str = "module_id") -> DataFrame:
    """Edges src, dst from references to the longest module their path begins with.

    ``references``: module_id, raw_path. crate:: stands for the package and target of
    the reference's module, self:: and super:: for itself and its parent; for super the
    module's own ancestors don't count. Self edges are dropped.
    """
    own = C("module_id")
    base = F.array_join(F.slice(F.split(own, "::"), 1, 2), "::")
    parent = F.array_join(F.slice(F.split(own, "::"), F.lit(1), F.greatest(F.size(F.split(own, "::")) - 1, F.lit(1))), "::")
    raw = C("raw_path")
    absolute = F.when(raw.startswith("crate::"), F.concat(base, F.substring("raw_path", 6, 1 << 30))).when(raw.startswith("self::"), F.concat(own, F.substring("raw_path", 5, 1 << 30))).when(raw.startswith("super::"), F.concat(parent, F.substring("raw_path", 6, 1 << 30))).otherwise(F.concat(base, F.lit("::"), raw))
    rows = references.filter(~raw.rlike(r"::(use|self|super)$")).select("module_id", absolute.alias("_path"), F.when(raw.startswith("super::"), own).alias("_own")).distinct()
    found = longest_prefix_join(rows, "_path", modules, module_key, name="dst", unless_prefix_of=None)
    found = found.filter(~F.coalesce((C("_own") == C("dst")) | C("_own").startswith(F.concat("dst", F.lit("::"))), F.lit(False)))
    return found.filter("dst is not null and dst <> module_id").select(C("module_id").alias("src"), "dst").distinct()


def target_metadata(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Package, target and kind of each file: of the target at its very path, else of the nearest package folder, else by its place.

    ``targets``: src_path, manifest_path, package_name, target_name, target_kind.
    """
    exact = targets.dropDuplicates(["src_path"]).select(C("src_path").alias("_s"), *(C(c).alias(f"_e_{c}") for c in ("package_name", "target_name", "target_kind")))
    owners = targets.select(F.regexp_replace("manifest_path", "/[^/]*$", "").alias("_folder"), C("package_name").alias("_o_package")).dropDuplicates(["_folder"])
    near = longest_prefix_join(files.select("path").distinct(), "path", owners, "_folder", "/", "_near").withColumnRenamed("path", "_np")
    rows = files.join(exact, C("path") == C("_s"), "left").join(near, C("path") == C("_np"), "left").join(owners, C("_near") == C("_folder"), "left")
    place = F.when(C("path").contains("/tests/"), "test").when(C("path").contains("/benches/"), "bench").when(C("path").contains("/examples/"), "example").when(C("path").rlike("/src/bin/|/src/main\\.rs$"), "bin").otherwise("lib")
    return rows.select(*files.columns, F.coalesce("_e_package_name", "_o_package").alias("package_name"), C("_e_target_name").alias("target_name"), F.coalesce("_e_target_kind", place).alias("target_kind"))


def propagate_test_code(findings: DataFrame, test_modules: DataFrame) -> DataFrame:
    """test_code is set where the finding's module, or one it lies in, is a test module of the same package."""
    tests = test_modules.select(C("package_name").alias("_tp"), C("module_key").alias("_tm")).distinct()
    own = findings.select("package_name", "module_key").distinct()
    hit = own.select("package_name", "module_key", F.explode(prefixes(C("module_key"), "::")).alias("_p")).join(tests, (C("package_name") == C("_tp")) & (C("_p") == C("_tm")), "left_semi").select(C("package_name").alias("_hp"), C("module_key").alias("_hm")).distinct()
    return findings.join(hit, (C("package_name") == C("_hp")) & (C("module_key") == C("_hm")), "left").withColumn("test_code", F.coalesce("test_code", F.lit(False)) | C("_hm").isNotNull()).drop("_hp", "_hm")


def best_definition(definitions: DataFrame, reference: list[str], modules: DataFrame, local_roots: list[str], target_root: str) -> DataFrame:
    """The definition of each reference with the strongest evidence, its module and status.

    ``definitions``: the reference, path, position (its place in the answer); ``modules``:
    path, module_id. A path of an indexed module goes before a generated or unindexed
    one (or none at all), and that before an external one; of equals the first counts.
    """
    def below(path: Column, root: str) -> Column:
        return (path == root) | path.startswith(root.rstrip("/") + "/")

    own = modules.select(C("path").alias("_m_path"), C("module_id").alias("_m")).dropDuplicates(["_m_path"])
    rows = definitions.join(own, C("path") == C("_m_path"), "left").drop("_m_path")
    inside = F.lit(False)
    for root in local_roots:
        inside = inside | below(C("path"), root)
    unmapped = F.when(C("path").isNull() | below(C("path"), target_root), "unmapped_generated_definition").when(inside, "unindexed_project_definition")
    status = F.when(C("_m").isNotNull(), "resolved_local").otherwise(F.coalesce(unmapped, F.lit("resolved_external")))
    rank = F.when(C("_m").isNotNull(), 0).when(unmapped.isNotNull(), 1).otherwise(2)
    best = rows.withColumns({"_status": status, "_rank": rank}).groupBy(*reference).agg(F.min_by(F.struct("_m", "_status"), F.struct("_rank", "position")).alias("d"))
    return best.select(*reference, C("d._m").alias("target_module_id"), C("d._status").alias("status"))


def status_histogram(resolved: DataFrame) -> DataFrame:
    """References by status."""
    return resolved.groupBy("status").agg(F.count("*").alias("n_references"))


def resolve_references(references: DataFrame, declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from a reference's owner to its target's module, and the references that no or several declarations answer.

    ``references``: context, owner, target; ``declarations``: context, id, module.
    """
    n = Window.partitionBy("context", "id")
    unique = declarations.select("context", "id", "module").distinct().withColumn("_n", F.count("*").over(n))
    good = unique.filter("_n = 1")
    joined = references
    for side in ("owner", "target"):
        d = good.select(C("context").alias(f"_{side}_c"), C("id").alias(f"_{side}_i"), C("module").alias(f"{side}_module"))
        joined = joined.join(d, (C("context") == C(f"_{side}_c")) & (C(side) == C(f"_{side}_i")), "left").drop(f"_{side}_c", f"_{side}_i")
    known = C("owner_module").isNotNull() & C("target_module").isNotNull()
    edges = joined.filter(known & (C("owner_module") != C("target_module"))).select("context", C("owner_module").alias("src"), C("target_module").alias("dst")).distinct()
    return edges, joined.filter(~known).select(*references.columns, F.when(C("owner_module").isNull(), "owner").otherwise("target").alias("unresolved"))


def practice_summary(checks: DataFrame, diagnostics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of each key (or all): checks by status, failed ones by severity, distinct diagnostics, and whether it conforms.

    A check that timed out is unavailable as well. Diagnostics are equal by rule,
    message, path, line and column. It conforms if no check failed as an error, none is
    unavailable, and no metric is incomplete (``incomplete`` of the check).
    """
    n = lambda *s: F.count_if(C("status").isin(*s))
    failed = lambda severity: F.count_if((C("status") == "failed") & (C("severity") == severity))
    one = F.lit(1).alias("_one")
    own = checks.groupBy(*keys, one).agg(F.count("*").alias("check_count"), n("passed").alias("passed"), failed("error").alias("failed_errors"), failed("warning").alias("failed_warnings"), n("unavailable", "timed-out").alias("unavailable"), n("skipped").alias("skipped"), F.count_if("incomplete").alias("_incomplete"))
    distinct = diagnostics.select(*keys, F.struct("rule_id", "message", "path", "line", "column").alias("_d")).distinct().groupBy(*(C(k).alias(f"_k_{k}") for k in keys), F.lit(1).alias("_also")).agg(F.count("*").alias("_n"))
    joined = own.join(distinct, null_safe([("_one", "_also"), *((k, f"_k_{k}") for k in keys)]), "left")
    conforms = (C("failed_errors") == 0) & (C("unavailable") == 0) & (C("_incomplete") == 0)
    return joined.select(*keys, "check_count", F.coalesce("_n", F.lit(0)).alias("diagnostic_count"), "passed", "failed_errors", "failed_warnings", "unavailable", "skipped", conforms.alias("conformant"))


def coverage_change(current: Column, baseline: Column, allowed: float) -> Column:
    """regressed beyond the allowed decrease (to two decimals), improved, unchanged; unknown if a side is."""
    drop = round2(baseline - current)
    return F.when(drop.isNull(), "unknown").when(drop > allowed, "regressed").when(drop < 0, "improved").otherwise("unchanged")


def changed_line_coverage(ranges: DataFrame, hits: DataFrame) -> DataFrame:
    """Executable and covered changed lines of each path and their share; a line counts once even in overlapping ranges.

    ``ranges``: path, start_line, end_line; ``hits``: path, line, covered. Paths without
    an executable changed line have no row.
    """
    r = ranges.filter("start_line is not null").select(C("path").alias("_p"), C("start_line").alias("_s"), C("end_line").alias("_e"))
    inside = range_join(hits, "line", r, "_s", "_e", [("path", "_p")], 256, "left_semi")
    per = inside.groupBy("path").agg(F.count("*").alias("executable"), F.count_if("covered").alias("covered"))
    return per.withColumn("percent", round2(percent(C("covered"), C("executable"), None)))


def test_failures(summary: Column, failed: Column) -> Column:
    """Reason why the tests count as failed, if they do; missing evidence is a failure."""
    return F.when(summary.isNull(), "test evidence is missing").when(summary == "compile_failed", "tests did not compile").when(failed > 0, "tests failed").when(summary != "passed", "test run did not pass")


def run_status(exit_code: Column, output: Column, timed_out: Column) -> Column:
    """passed, compile_failed, failed, timed_out, unavailable or incomplete of a test run."""
    return F.when(timed_out, "timed_out").when(exit_code.isNull() & output.isNull(), "unavailable").when(exit_code.isNull(), "incomplete").when(exit_code == 0, "passed").when(output.contains("could not compile"), "compile_failed").otherwise("failed")


def score_regressions(current: DataFrame, baseline: DataFrame, key: str, score: str, allowed: float) -> DataFrame:
    """Rows that are worse than the baseline by more than allowed; new rows count against 0. Both sides need one risk model version."""
    b = baseline.select(C(key).alias("_b"), C(score).alias("_s"), C("risk_model_version").alias("_v"))
    joined = current.join(b, null_safe([(key, "_b")]), "left")
    same = F.when(C("_v").isNull() | (C("_v") == C("risk_model_version")), True).otherwise(F.raise_error(F.lit("risk model versions differ")))
    delta = C(score) - F.coalesce("_s", F.lit(0.0))
    return joined.filter(same & (delta > allowed)).select(key, C(score).alias("current"), C("_s").alias("baseline"), round2(delta).alias("delta"))


def cached(spark: SparkSession, name: str, digest: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name and digest from the shared folder, made and written at first use."""
    path = f"{shared_dir(spark)}/cache/{name}/{digest}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
