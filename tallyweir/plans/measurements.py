"""The measurements over fact tables that the project's own tables give, each with its SQL.

Scopes stand for the items of a module: functions, traits (as types) and impl blocks,
with their inner scopes for branches, fields and methods. Files, commits, calibration
batches and practice reports are what they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round2
from ..functions.text import is_defect_subject
from ..operators import review as R
from ..operators.nested import SQL as NESTED_SQL
from ..operators.nested import report_table
from ..tables import last_delivery, load
from . import producers as P
from .measures import _COMMITS_SQL, _DEFECTS, _PCT, _R2, _commits, _modules
from .relations import _EDGES_SQL, _LAYER_SQL, _OWN_SQL, _REACH_SQL, _module_edges

C = F.col


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last capture of each scope with the number of its children: n, n_functions, n_blocks."""
    raw = load(spark, sf_dir, "lexical").filter(C("id").isNotNull()).select("id", "parent_id", "kind", "module_key", "project_key", "start_line", "start_column", "captured_at")
    own = last_delivery(raw, ["id"], "captured_at").withColumn("parent", F.when(F.trim("parent_id") != "", F.trim("parent_id"))).drop("parent_id", "captured_at")
    kids = own.filter(C("parent").isNotNull()).groupBy(C("parent").alias("_p")).agg(F.count("*").alias("n"), F.count_if(C("kind") == "function").alias("n_functions"), F.count_if(C("kind") == "block").alias("n_blocks"))
    return own.join(kids, C("id") == C("_p"), "left").drop("_p").fillna(0, ["n", "n_functions", "n_blocks"])


def _in_files(rows: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    own = files.select(C("module_id").alias("_m"), *columns)
    return rows.withColumnRenamed("module_key", "_of").join(own, C("_of") == C("_m")).withColumnRenamed("_of", "module_id").drop("_m")


_FACTS_SQL = f"""{_OWN_SQL},
s0 as (select id, nullif(trim(parent_id), '') parent, kind, module_key, project_key, start_line, start_column from (select *, row_number() over (partition by id order by captured_at desc nulls last) rn from lexical where id is not null) where rn = 1),
kd as (select parent, count(*) n, count(*) filter (where kind = 'function') nf, count(*) filter (where kind = 'block') nb from s0 where parent is not null group by 1),
fx as (select s0.*, coalesce(n, 0) n, coalesce(nf, 0) nf, coalesce(nb, 0) nb from s0 left join kd on kd.parent = s0.id),
fns as (select o.module_id, o.path, id qualified_name, start_line, start_line + 5 * n + 3 end_line, n branch_pressure, nb path_pressure, start_column // 4 max_nesting_depth, 5 * n + 4 source_line_count, 1 + n cyclomatic_complexity, n * (start_column // 4) cognitive_complexity from fx join own o on o.module_id = fx.module_key where kind = 'function'),
fnh as (select *, round(1.12::double * (3.7::double * branch_pressure + 2.0::double * greatest(path_pressure - 1, 0) + 3.0::double * greatest(max_nesting_depth - 2, 0) + least(0.25::double * greatest(source_line_count - 20, 0), 20.0::double)) * 100) / 100 score from fns),
pts as (select o.path, start_line line, start_column % 8 = 0 covered from fx join own o on o.module_id = fx.module_key where kind = 'block')"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function scopes: inner scopes are branches, inner blocks paths, indentation nesting."""
    rows = _in_files(scopes(spark, sf_dir).filter(C("kind") == "function"), _modules(spark, sf_dir), "path")
    nesting = F.floor(C("start_column") / 4)
    return rows.select(
        "module_id", "path", C("id").alias("qualified_name"), "start_line", (C("start_line") + 5 * C("n") + 3).alias("end_line"), C("n").alias("branch_pressure"), C("n_blocks").alias("path_pressure"),
        nesting.alias("max_nesting_depth"), (5 * C("n") + 4).alias("source_line_count"), (1 + C("n")).alias("cyclomatic_complexity"), (C("n") * nesting).alias("cognitive_complexity"),
    )


def coverage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block scopes as executable lines; those at an even depth are covered."""
    return _in_files(scopes(spark, sf_dir).filter(C("kind") == "block"), _modules(spark, sf_dir), "path").select("path", C("start_line").alias("line"), (C("start_column") % 8 == 0).alias("covered"))


def function_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.function_hotspots(functions(spark, sf_dir))
    parts = [C("score_components")[i]["contribution"].alias(n) for i, n in enumerate(("branch_part", "path_part", "nesting_part", "length_part"))]
    return found.select("module_id", "qualified_name", "score", "risk_level", F.array_join("signals", ",").alias("signals"), *parts)


def module_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.module_hotspots(_modules(spark, sf_dir), functions(spark, sf_dir))
    return found.select("module_id", "parse_status", "score", "risk_level", "max_function_score", "p95_function_score", "mean_function_score", "size_score", C("function_count").cast("bigint").alias("function_count"), "cyclomatic_complexity_average", "cognitive_complexity_average", "signals", "complexity_density")


def function_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.function_risk(functions(spark, sf_dir), coverage_lines(spark, sf_dir))
    return found.select("qualified_name", "executable_lines", "covered_lines", "coverage_percent", "crap", "risk_level")


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.topology(_modules(spark, sf_dir), _module_edges(spark, sf_dir))
    return found.select("module_id", C("outbound").cast("bigint").alias("outbound"), C("inbound").cast("bigint").alias("inbound"), "layer", "locality_risk", "locality_score", "leverage_pressure", "leverage_score", "signals")


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function scopes of test targets as tests; the modules that their module depends on are the tested ones."""
    files = _modules(spark, sf_dir).filter(C("target_kind") == "test").withColumn("readable", C("module_key"))
    rows = _in_files(scopes(spark, sf_dir).filter(C("kind") == "function"), files, "package_name", "target_name", "path", "readable")
    tested = _module_edges(spark, sf_dir).groupBy(C("src").alias("_s")).agg(F.array_sort(F.collect_set("dst")).alias("tested_module_ids"))  # the edges of one module
    status = F.get(F.array(*map(F.lit, ("failed", "passed", "skipped", "ignored"))), (C("start_line") % 5).cast("int"))
    joined = rows.join(tested, C("module_id") == C("_s"), "left")
    return joined.select("package_name", "target_name", "path", C("id").alias("qualified_name"), C("start_line").alias("line"), C("readable").alias("module_key"), "tested_module_ids", F.lit(None).cast("array<string>").alias("tested_modules"), status.alias("last_status"), C("n").alias("assertion_count"), C("n_blocks").alias("sut_call_count"), (C("start_line") % 5 == 3).alias("ignored"))


_TESTS_SQL = """
tst as (select o.package_name, o.target_name, o.path, id qualified_name, start_line line, o.module_key, o.module_id own_id, case start_line % 5 when 0 then 'failed' when 1 then 'passed' when 2 then 'skipped' when 3 then 'ignored' end last_status, n assertion_count, nb sut_call_count, start_line % 5 = 3 ignored
  from fx join own o on o.module_id = fx.module_key where kind = 'function' and o.target_kind = 'test')"""
_CORRECT_SQL = """
tof as (select coalesce(dst, module_key) m, coalesce(last_status, 'unknown') s from tst left join ed on src = own_id),
cor as (select m "module", count(*) test_count, count(*) filter (where s = 'failed') failed_count, count(*) filter (where s in ('skipped', 'ignored')) skipped_count, count(*) filter (where s = 'unknown') unknown_count from tof where m is not null group by 1)"""


def correctness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.correctness_counts(_tests(spark, sf_dir))


def test_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _tests(spark, sf_dir).withColumns({"layer": P.module_layer(C("module_key"), F.lit(False)), "last_status": F.coalesce("last_status", F.lit("unknown"))})
    return P.layer_counts(tests)


def test_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.test_quality(_tests(spark, sf_dir))[1].select("qualified_name", "line", "rule_id")


def _types(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own, files = scopes(spark, sf_dir), _modules(spark, sf_dir)
    traits = _in_files(own.filter(C("kind") == "trait"), files, "package_name", "target_name")
    types = traits.select("package_name", "target_name", C("id").alias("qualified_name"), F.when(C("start_column") % 8 == 4, "tuple").otherwise("named").alias("shape"), C("n").alias("field_count"), C("n_functions").alias("variant_count"), C("n_blocks").alias("variant_field_count"), (5 * C("n") + 1).alias("declaration_span"))
    blocks = _in_files(own.filter(C("kind") == "impl"), files, "package_name", "target_name", "path")
    return types, blocks.select("package_name", "target_name", C("parent").alias("qualified_type_name"), "path", C("n_functions").alias("method_count"))


def type_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.type_health(*_types(spark, sf_dir))
    return found.select("qualified_name", "structural_risk", F.array_join("signals", ",").alias("signals"), C("observed_method_count").cast("bigint").alias("observed_method_count"), "observed_impl_block_count", "observed_impl_file_count")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_table(load(spark, sf_dir, "practices"), "checks/diagnostics")


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of practice reports in parsed files, with scope and severity."""
    found = P.reliability(_modules(spark, sf_dir), diagnostics(spark, sf_dir).withColumn("test_code", F.lit(None).cast("boolean")).drop("severity"))
    return found.select("report_id", "check_no", "diagnostic_no", "module_id", "scope", "severity", "policy_selected")


def api_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.api_health(_modules(spark, sf_dir)).select("module_id", "missing_docs", "documentation_percent", "has_crate_docs")


def _git(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _commits(spark, sf_dir)
    touched = own.select("hash", "churn", F.explode("modules").alias("module_id"))
    return P.git_facts(own.select("hash", "author", "subject"), touched, is_defect_subject(C("subject")))


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, edges = _modules(spark, sf_dir), _module_edges(spark, sf_dir)
    return P.risk_map(files, P.topology(files, edges), edges, P.module_hotspots(files, functions(spark, sf_dir)).select("module_id", "score"), _git(spark, sf_dir), correctness_counts(spark, sf_dir))


def risk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All risks of every module from files, edges, hotspots, history and tests."""
    return _risks(spark, sf_dir).select("module_id", "layer", "maintainability_risk", "change_risk", "correctness_risk", "architectural_risk", "quality_risk", "total_score", "risk_level", F.array_join("unknown_metrics", ",").alias("unknown_metrics"))


def map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the map with some of their raw facts and the colour of their layer."""
    found = P.map_nodes(_risks(spark, sf_dir), _modules(spark, sf_dir))
    return found.select("module_id", "path", "target_kind", "total_score", "layer_color", *(C(f"raw_facts.{c}").alias(c) for c in ("functions", "comment_lines", "churn", "test_count", "coverage_percent")))


def unknown_metric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unknown_counts(_risks(spark, sf_dir))


def map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies, and containment of each module in the one a segment above it."""
    own = _modules(spark, sf_dir).select("module_id")
    above = own.select("module_id", F.regexp_replace("module_id", "::[^:]+$", "").alias("_up"))
    inside = above.join(own.withColumnRenamed("module_id", "_p"), (C("_up") == C("_p")) & (C("_p") != C("module_id"))).select(C("_p").alias("src"), C("module_id").alias("dst"))
    return P.map_edges(_module_edges(spark, sf_dir), inside)


def structural_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function scopes of an impl block as its methods; the columns of their inner scopes are the fields they use."""
    own = scopes(spark, sf_dir).select("id", "parent", "kind", "start_column")
    blocks = own.filter(C("kind") == "impl").select(C("id").alias("type_id"))
    methods = own.filter(C("kind") == "function").select(C("id").alias("method"), C("parent").alias("_t")).join(blocks, C("_t") == C("type_id")).drop("_t")
    fields = own.filter(C("parent").isNotNull()).groupBy(C("parent").alias("_m")).agg(F.collect_set(C("start_column").cast("string")).alias("fields"))  # the few indentations of a scope
    rows = methods.join(fields, C("method") == C("_m"), "left").select("type_id", "method", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), F.array().cast("array<string>").alias("calls"), F.lit(True).alias("complete"))
    found = P.structural_cohesion(rows)
    return found.select("type_id", C("n").alias("methods"), "shared_pairs", "possible_pairs", "connected_pairs", "applicable", "field_sharing_percent", "connected_pair_percent", "component_count")


def module_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scopes(spark, sf_dir).filter(C("module_key").isNotNull())
    kinds = own.groupBy(C("module_key").alias("module_id")).agg(F.count_if(C("kind") == "trait").alias("n_types"), F.count_if(C("kind") == "impl").alias("n_impls"))
    files = _modules(spark, sf_dir)
    touched = _commits(spark, sf_dir).select("churn", F.explode("modules").alias("_m"))
    churn = touched.join(files.select("module_id", "path"), C("_m") == C("module_id")).groupBy("path").agg(F.coalesce(F.sum("churn"), F.lit(0)).alias("churn"))
    found = P.module_cohesion(files, kinds, churn)
    return found.select("module_id", C("declaration_categories").cast("bigint").alias("declaration_categories"), "responsibility_focus", C("changed_lines").cast("bigint").alias("changed_lines"), "change_share_percent", F.round("change_entropy_contribution", 2).alias("change_entropy_contribution"))


def calibration_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p90, p95 and p99 of function scores and complexities by project, and pooled; each batch once, measurements alone."""
    last = last_delivery(load(spark, sf_dir, "calibration").filter(C("batch_no").isNotNull()), ["batch_no"], "received_at")
    kinds = ("function_scores", "cyclomatic_complexities", "cognitive_complexities")
    lists = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), C(k).cast("array<double>").alias("v")) for k in kinds)))
    each = last.select("project_key", lists.alias("l")).select("project_key", "l.kind", F.explode("l.v").alias("score"))
    own = each.filter(C("score").isNotNull() & ~F.isnan("score") & (C("score") >= 0) & (C("score") < float("inf")))
    return P.calibrate(own, "project_key", "kind", "score")


def ranking_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the size of modules finds those that defect commits name; merges are only inferred labels."""
    modules = _modules(spark, sf_dir).select(C("project_key").alias("project"), C("module_id").alias("module"), C("source_nonblank_line_count").cast("double").alias("score"))
    own = _commits(spark, sf_dir).filter(F.coalesce(is_defect_subject(C("subject")), F.lit(False)))
    outcomes = own.select(C("repo_key").alias("project"), F.lit("defect").alias("kind"), "modules", F.when(F.coalesce("is_merge", F.lit(False)), "inferred").otherwise("reviewed-label").alias("evidence_class"))
    found = P.validate_rankings(modules, outcomes, ["defect"])
    return found.select("project", "n_ranked", "n_relevant", *(F.round(c, 6).alias(c) for c in ("precision_at_top", "recall_at_top", "mean_percentile_rank", "quarter_lift")), "status")


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of modules that commits of the last 30 days of their repository touched."""
    own = _commits(spark, sf_dir)
    head = own.groupBy(C("repo_key").alias("_r")).agg(F.max("committed_at").alias("head"))
    recent = own.join(head, C("repo_key") == C("_r")).filter(C("committed_at") > C("head") - F.expr("interval 30 days")).select(F.explode("modules").alias("_m")).distinct()
    return recent.join(_modules(spark, sf_dir).select("module_id", "path"), C("_m") == C("module_id")).select("path").distinct()


_CHANGED_SQL = "chg as (select distinct path from (select unnest(modules) m from cm join (select repo_key r, max(committed_at) head from cm group by 1) on r = repo_key where committed_at > head - interval 30 days) join own on module_id = m)"


def changed_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of changed files."""
    return P.changed_scope(functions(spark, sf_dir).select("path", "qualified_name"), _changed(spark, sf_dir))


def changed_line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executable and covered lines inside functions of changed files."""
    ranges = functions(spark, sf_dir).join(_changed(spark, sf_dir).withColumnRenamed("path", "_c"), C("path") == C("_c"), "left_semi").select("path", "start_line", "end_line")
    return R.changed_line_coverage(ranges, coverage_lines(spark, sf_dir))


def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all diagnostics by rule, path and message, which stay when lines move."""
    found = R.finding_ids(diagnostics(spark, sf_dir).select("rule_id", "path", "line", C("message").alias("source_line")))
    return found.select("id", "rule_id")


def practice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and distinct diagnostics of each report, and whether it conforms."""
    checks = report_table(load(spark, sf_dir, "practices"), "checks")
    incomplete = F.get_json_object("metrics", "$.measurement_confidence.complete") == "false"
    return R.practice_summary(checks.select("report_id", "status", "severity", incomplete.alias("incomplete")), diagnostics(spark, sf_dir), ["report_id"])


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge as a reference that begins with crate::."""
    return _module_edges(spark, sf_dir).select(C("src").alias("module_id"), F.concat(F.lit("crate::"), F.array_join(F.slice(F.split("dst", "::"), 3, 100), "::"), F.lit("::Item")).alias("raw_path"))


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved to the longest module of the same crate that they begin with."""
    return R.resolve_dependencies(_references(spark, sf_dir), _modules(spark, sf_dir))


def semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the first segment that look local: half are written with crate::, the others with their package."""
    refs = _references(spark, sf_dir).unionByName(_module_edges(spark, sf_dir).select(C("src").alias("module_id"), C("dst").alias("raw_path"))).unionByName(_modules(spark, sf_dir).select("module_id", F.concat(F.lit("std::"), C("module_key")).alias("raw_path")))
    return R.semantic_candidates(refs, _modules(spark, sf_dir))


def target_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package, target and kind of every path from the targets of entrypoints, the nearest manifest, or its place."""
    own = _modules(spark, sf_dir)
    targets = own.filter("is_entrypoint").select(C("path").alias("src_path"), F.regexp_replace("path", "/(src|tests|benches|examples)/.*$", "/Cargo.toml").alias("manifest_path"), "package_name", "target_name", "target_kind")
    return R.target_metadata(own.select("path").distinct(), targets)


def test_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that are test code: test modules of their package, and all below."""
    own = _modules(spark, sf_dir)
    rows = own.select("module_id", "package_name", "module_key", F.lit(None).cast("boolean").alias("test_code"))
    return R.propagate_test_code(rows, own.filter(C("target_kind") == "test").select("package_name", "module_key")).select("module_id", "test_code")


def definition_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the status of their best definition: an authored file, an unparsed or a generated one, an external one."""
    files = _modules(spark, sf_dir).select(C("module_id").alias("_d"), "path", "parse_status")
    edges = _module_edges(spark, sf_dir).join(files, C("dst") == C("_d"), "left").select("src", "dst", C("path").alias("_path"))
    outside = F.concat(F.lit("/registry/"), "dst")
    places = F.array(F.struct(outside.alias("path"), F.lit(0).alias("position")), F.struct(F.coalesce("_path", F.concat(F.lit("target/gen/"), "dst")).alias("path"), F.lit(1).alias("position")))
    rows = edges.select("src", "dst", F.explode(places).alias("p")).select("src", "dst", "p.*")
    modules = files.filter(C("parse_status") == "ok").select("path", C("_d").alias("module_id"))
    return R.status_histogram(R.best_definition(rows, ["src", "dst"], modules, ["crates", "src", "tests"], "target"))


def compiled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes as references to their parents within a project, resolved by declarations that name one module."""
    raw = load(spark, sf_dir, "lexical").filter(C("id").isNotNull())
    refs = scopes(spark, sf_dir).filter(C("parent").isNotNull()).select(C("project_key").alias("context"), C("id").alias("owner"), C("parent").alias("target"))
    declarations = raw.filter(C("module_key").isNotNull()).select(C("project_key").alias("context"), "id", C("module_key").alias("module"))
    edges, open_ = R.resolve_references(refs, declarations)
    return edges.groupBy("context").agg(F.count("*").alias("n_edges")).join(open_.groupBy(C("context").alias("_c")).agg(F.count_if(C("unresolved") == "owner").alias("n_owner"), F.count_if(C("unresolved") == "target").alias("n_target")), C("context").eqNullSafe(C("_c")), "full_outer").select(F.coalesce("context", "_c").alias("context"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_owner", F.lit(0)).alias("n_owner"), F.coalesce("n_target", F.lit(0)).alias("n_target"))


def artifact_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a measurement: its records, those with an unknown score, and the sum of what is known."""
    parts = [("hotspots", module_hotspots(spark, sf_dir), "score"), ("function-risk", function_risk(spark, sf_dir), "crap"), ("locality", topology(spark, sf_dir), "locality_risk"), ("type-health", type_health(spark, sf_dir), "structural_risk"), ("api-health", api_health(spark, sf_dir), "documentation_percent")]
    rows = [df.select(F.lit(tool).alias("tool"), C(score).cast("decimal(30,2)").alias("v")) for tool, df, score in parts]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole.groupBy("tool").agg(F.count("*").alias("record_count"), F.count_if(C("v").isNull()).alias("unknown_count"), round2(F.sum("v").cast("double")).alias("total"))


QUERIES = {f.__name__: f for f in (
    function_hotspots, module_hotspots, function_risk, topology, correctness_counts, test_layers, test_findings, type_health, reliability, api_health, risk_map, map_nodes, unknown_metric_counts, map_edges,
    structural_cohesion, module_cohesion, calibration_thresholds, ranking_validation, changed_scope, changed_line_coverage, finding_ids, practice_summary, dependency_edges, semantic_candidates,
    target_metadata, test_code, definition_statuses, compiled_edges, artifact_summaries,
)}

_BANDS = lambda c, a, b, d: f"case when {c} >= {d}::double then 'extreme' when {c} >= {b}::double then 'high' when {c} >= {a}::double then 'watch' when {c} is not null then 'stable' end"
_HOT_SQL = f"""
hm as (select module_id mid, count(*) k, max(score) largest, {_PCT(0.95, 'score')} p95, sum(score::decimal(30,2))::double / count(*) mean, sum(cyclomatic_complexity) cy, sum(cognitive_complexity) cg from fnh group by 1),
hf as (select module_id, parse_status, parse_status = 'ok' ok, source_nonblank_line_count sloc, coalesce(k, 0) k, coalesce(largest, 0) largest, coalesce(p95, 0) p95, coalesce(mean, 0) mean, coalesce(cy, 0) cy, coalesce(cg, 0) cg from own left join hm on mid = module_id where parse_status = 'ok' or source_metrics_available),
hs as (select *, case when ok then {_R2('0.55::double * largest + 0.25::double * p95 + 0.10::double * mean + 0.5::double * least(sloc / 10, 20.0::double)')} end score from hf)"""
_TOPO_SQL = f"""
to_ as (select src, count(*) n from ed group by 1), ti_ as (select dst, count(*) n from ed group by 1),
td as (select module_id, module_key, coalesce(is_entrypoint, false) ep, coalesce(to_.n, 0)::bigint o, coalesce(ti_.n, 0)::bigint i from own left join to_ on src = module_id left join ti_ on dst = module_id),
tp as (select *, case when ep then 'Entrypoint' when module_key is not null then {_LAYER_SQL('module_key')} end layer, {_R2('least(3.0::double * greatest(o - case when ep then 8 else 5 end, 0) + 0.75::double * greatest(i - 12, 0), 100)')} risk,
  {_R2('100 - greatest(least(68 + 2.5::double * i - case when ep then 1.5::double else 3.0::double end * o, 100), 0)')} lev from td)"""
_GITP_SQL = f"""
gp as (select module_id gm, coalesce(sum(churn), 0)::double churn, count(*)::double commits, count(distinct author)::double people, count(*) filter (where defect)::double defects
  from (select unnest(modules) module_id, churn, author, coalesce(list_has_any(regexp_split_to_array(lower(subject), '[^\\p{{L}}\\p{{N}}]+'), [{_DEFECTS}]), false) defect from cm) group by 1)"""
_RISK_SQL = f"""
with recursive {_FACTS_SQL}, {_EDGES_SQL}, e as (select * from ed), {_REACH_SQL}, {_COMMITS_SQL}, {_HOT_SQL}, {_TOPO_SQL}, {_TESTS_SQL}, {_CORRECT_SQL}, {_GITP_SQL},
vl as (select src, {_LAYER_SQL('src')} a, {_LAYER_SQL('dst')} b from ed), rk as (select unnest(['Interface', 'Application', 'Infrastructure', 'Domain']) n, unnest([4, 3, 3, 2]) k),
vi as (select src vs, count(*) v from vl join rk x on x.n = a join rk y on y.n = b where x.k < y.k group by 1), cy as (select distinct src cs from reach where src = dst),
j as (select o.module_id, tp.layer, hs.score cx, source_nonblank_line_count::double sloc, public_api_count::double api, ep, tp.o::double o, tp.i::double i, risk, lev, coalesce(v, 0) v, cs is not null cyc,
  coalesce(g.churn, g2.churn, 0) churn, coalesce(g.commits, g2.commits, 0) commits, coalesce(g.people, g2.people, 0) people, coalesce(g.defects, g2.defects, 0) defects,
  coalesce(c.test_count, c2.test_count, 0) tc, coalesce(c.failed_count, c2.failed_count, 0) fc, coalesce(c.skipped_count, c2.skipped_count, 0) sc, coalesce(c.unknown_count, c2.unknown_count, 0) uc
  from own o join tp on tp.module_id = o.module_id left join hs on hs.module_id = o.module_id left join vi on vs = o.module_id left join cy on cs = o.module_id
  left join gp g on g.gm = o.module_id left join gp g2 on g2.gm = o.module_key left join cor c on c."module" = o.module_id left join cor c2 on c2."module" = o.module_key),
k as (select *, case when ep then greatest(o - 8, 0) else o end ob, case when ep then greatest(v - 2, 0) else v end bv from j),
r as (select *, case when cx is not null and sloc is not null and api is not null then {_R2('least(cx + least(sloc * 0.12::double, 70) + least(api * 2.5::double, 30) + least(ob * 4, 35) + least(i, greatest(35 - least(ob * 4, 35), 0)), 400)')} end maintainability_risk,
  {_R2('least(least(churn / 12, 160) + least(commits * 2.5::double, 100) + least(people * 14, 80) + least(defects * 18, 90) + case when tc > 0 then 0 else 90 end, 520)')} change_risk,
  {_R2('least(case when fc > 0 then 140 else 0 end + least(fc * 45, 120) + least(uc * 4, 80) + least(sc * 10, 40) + case when tc = 0 then 90 else 0 end, 470)::double')} correctness_risk,
  case when sloc is not null then {_R2('least(least(ob * 10, 120) + least(i * 8, 120) + least(bv * 32, 120) + case when cyc then 110 else 0 end + case when sloc >= 250 then 60 else 0 end, 530)')} end architectural_risk from k),
q as (select *, {_R2('maintainability_risk + risk + lev')} quality_risk from r), w as (select *, {_R2('change_risk + correctness_risk + quality_risk + architectural_risk')} total_score from q),
rm as (select module_id, layer, maintainability_risk, change_risk, correctness_risk, architectural_risk, quality_risk, total_score, {_BANDS('total_score', 712.99, 838.64, 1028.20)} risk_level,
  concat_ws(',', case when maintainability_risk is null then 'maintainability_risk' end, case when change_risk is null then 'change_risk' end, case when correctness_risk is null then 'correctness_risk' end, case when quality_risk is null then 'quality_risk' end, case when total_score is null then 'total_score' end) unknown_metrics from w)"""
_TYPES_SQL = f"""
ty as (select o.package_name pn, o.target_name tn, id, start_column % 8 = 4 tup, n::double f, nf::double v, nb::double p, (5 * n + 1)::double span from fx join own o on o.module_id = fx.module_key where kind = 'trait'),
im as (select o.package_name pn, o.target_name tn, parent, o.path, nf from fx join own o on o.module_id = fx.module_key where kind = 'impl'),
ti as (select ty.id, sum(nf) m, count(*) b, count(distinct path) c from im join ty on ty.pn = im.pn and ty.tn = im.tn and ty.id = im.parent group by 1),
th as (select ty.*, coalesce(m, 0)::double m, coalesce(b, 0)::double b, coalesce(c, 0)::double c from ty left join ti on ti.id = ty.id),
tr as (select *, {_R2('greatest(least(least(greatest(f - 8, 0) * 2.5::double, 35) + least(greatest(v - 8, 0) * 1.8::double, 28) + least(greatest(p - 10, 0) * 1.4::double, 18) + least(greatest(m - 12, 0) * 0.85::double, 32) + least(greatest(span - 30, 0) * 0.35::double, 12) + least(4.5::double * greatest(c - 2, 0) + 1.2::double * greatest(b - 4, 0), 24), 100), 0)')} risk from th)"""
_FUNCTION_RISK_SQL = f"""
fr as (select f.qualified_name, f.cyclomatic_complexity cc, count(p.line) np, count(*) filter (where covered) nh from fns f left join pts p on p.path = f.path and line between start_line and end_line group by f.path, f.qualified_name, f.start_line, f.end_line, f.cyclomatic_complexity),
fq as (select *, {_R2('cc::double * cc * pow(1 - nh::double / nullif(np, 0), 3) + cc')} crap from fr)"""
_API_SQL = f"""
ah as (select module_id, public_api_count - documented_public_api_count missing_docs, case when public_api_count = 0 then 100.0::double else {_R2('100.0::double * documented_public_api_count / public_api_count')} end documentation_percent, has_crate_docs from own where parse_status = 'ok' and (public_api_count > 0 or is_entrypoint))"""
_DIAG_SQL = f"dg as ({NESTED_SQL['p4_diagnostics']})"
_TEST_PATH = r"(path like 'tests/%' or path like '%/tests/%' or path like 'benches/%' or path like 'examples/%' or regexp_matches(path, '(^|/)(tests?\.rs|[^/]*_tests\.rs)$'))"
_TEST_MODULE = "len(list_filter(string_split(module_key, '::'), lambda s: s in ('test', 'tests') or ends_with(s, '_tests'))) > 0"
_KINDS_SQL = " union all ".join(f"select project_key, '{k}' kind, unnest({k}) v from lb" for k in ("function_scores", "cyclomatic_complexities", "cognitive_complexities"))
_THREE = ", ".join(f"{_PCT(q, 'v')} p{round(q * 100)}" for q in (0.9, 0.95, 0.99))
_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SQL = {
    "function_hotspots": f"""
with {_FACTS_SQL} select module_id, qualified_name, score, {_BANDS('score', 19.15, 32.98, 80.08)} risk_level, coalesce(nullif(concat_ws(',', case when branch_pressure >= 8 then 'branch pressure' end, case when max_nesting_depth >= 4 then 'deep nesting' end, case when source_line_count >= 60 then 'long function' end), ''), 'stable') signals,
  {_R2('branch_pressure * 3.7::double * 1.12::double')} branch_part, {_R2('greatest(path_pressure - 1, 0) * 2.0::double * 1.12::double')} path_part, {_R2('greatest(max_nesting_depth - 2, 0) * 3.0::double * 1.12::double')} nesting_part, {_R2('least(greatest(source_line_count - 20, 0) * 0.25::double, 20.0::double) * 1.12::double')} length_part from fnh""",
    "module_hotspots": f"""
with {_FACTS_SQL}, {_HOT_SQL}
select module_id, parse_status, score, {_BANDS('score', 67.30, 95.51, 139.94)} risk_level, case when ok then {_R2('largest')} end max_function_score, case when ok then {_R2('p95')} end p95_function_score, case when ok then {_R2('mean')} end mean_function_score, case when ok then {_R2('least(sloc / 10, 20.0::double)')} end size_score,
  case when ok then k end function_count, case when ok then {_R2('case when k = 0 then 0 else cy::double / k end')} end cyclomatic_complexity_average, case when ok then {_R2('case when k = 0 then 0 else cg::double / k end')} end cognitive_complexity_average,
  case when sloc >= 250 or (ok and largest >= 60) then 'watch' when ok then 'stable' end signals, case when sloc > 0 then {_R2('score / sloc')} when ok then 0.0::double end complexity_density from hs""",
    "function_risk": f"""
with {_FACTS_SQL}, {_FUNCTION_RISK_SQL} select qualified_name, np executable_lines, nh covered_lines, {_R2('nh::double / nullif(np, 0) * 100')} coverage_percent, crap, case when crap is null then 'unknown' when crap > 30 then 'high' else 'normal' end risk_level from fq""",
    "topology": f"""
with {_OWN_SQL}, {_EDGES_SQL}, {_TOPO_SQL}
select module_id, o outbound, i inbound, layer, risk locality_risk, {_R2('100 - risk')} locality_score, lev leverage_pressure, least(i * 10.0::double, 100) leverage_score, case when risk > 0 then 'dependency spread' when ep then 'entrypoint orchestration' else 'stable' end signals from tp""",
    "correctness_counts": f"with {_FACTS_SQL}, {_EDGES_SQL}, {_TESTS_SQL}, {_CORRECT_SQL} select * from cor",
    "test_layers": f"""
with {_FACTS_SQL}, {_TESTS_SQL}, g as (select case when module_key is not null then {_LAYER_SQL('module_key')} end layer, coalesce(last_status, 'unknown') s from tst)
select layer, count(*) test_count, count(*) filter (where s = 'passed') passed_count, count(*) filter (where s = 'failed') failed_count, count(*) filter (where s = 'skipped') skipped_count, count(*) filter (where s = 'unknown') unknown_count, {_R2('''100.0::double * count(*) filter (where s = 'failed') / count(*)''')} failed_percent from g group by 1""",
    "test_findings": f"""
with {_FACTS_SQL}, {_TESTS_SQL}
select qualified_name, line, 'rust.test.no-assertion' rule_id from tst where assertion_count = 0 union all select qualified_name, line, 'rust.test.no-sut-call' from tst where sut_call_count = 0 union all select qualified_name, line, 'rust.test.ignored' from tst where ignored""",
    "type_health": f"""
with {_FACTS_SQL}, {_TYPES_SQL} select id qualified_name, risk structural_risk,
  concat_ws(',', case when f >= case when tup then 8 else 16 end then 'wide-fields' end, case when v >= 12 then 'many-variants' end, case when p >= 12 then 'large-payload' end, case when m >= 20 then 'many-methods' end, case when c >= 4 then 'scattered-files' end, case when b >= 6 then 'many-blocks' end, case when span >= 45 then 'long-declaration' end) signals,
  m::bigint observed_method_count, b::bigint observed_impl_block_count, c::bigint observed_impl_file_count from tr""",
    "reliability": f"""
with {_OWN_SQL}, {_DIAG_SQL}, j as (select report_id, check_no, diagnostic_no, module_id, rule_id, {_TEST_PATH} or coalesce({_TEST_MODULE}, false) test from dg join own using (path) where parse_status = 'ok')
select report_id, check_no, diagnostic_no, module_id, case when test then 'test' else 'production' end scope, case when test then 'advisory' when rule_id like 'rust.safety.%' then 'error' else 'warning' end severity, not test policy_selected from j""",
    "api_health": f"with {_OWN_SQL}, {_API_SQL} select * from ah",
    "risk_map": f"{_RISK_SQL} select * from rm",
    "map_nodes": f"""{_RISK_SQL}
select rm.module_id, path, target_kind, total_score, case rm.layer when 'Entrypoint' then '#dcdcaa' when 'Interface' then '#569cd6' when 'Application' then '#d7ba7d' when 'Domain' then '#4ec9b0' when 'Infrastructure' then '#c586c0' when 'Tests' then '#9cdcfe' else '#808080' end layer_color,
  function_count "functions", source_comment_line_count comment_lines, churn::double churn, tc::double test_count, null::double coverage_percent from rm join own on own.module_id = rm.module_id join k on k.module_id = rm.module_id""",
    "unknown_metric_counts": f"{_RISK_SQL} select metric, count(*) n_modules from (select unnest(string_split(unknown_metrics, ',')) metric from rm where unknown_metrics <> '') group by 1",
    "map_edges": f"""
with {_OWN_SQL}, {_EDGES_SQL} select src, dst, 'dependency' kind from ed union select p.module_id, c.module_id, 'containment' from own c join own p on p.module_id = regexp_replace(c.module_id, '::[^:]+$', '') and p.module_id <> c.module_id""",
    "structural_cohesion": f"""
with recursive {_FACTS_SQL}, me as (select b.id type_id, m.id from fx m join fx b on b.id = m.parent and b.kind = 'impl' where m.kind = 'function'), fi as (select distinct type_id, me.id, start_column from me join fx k on k.parent = me.id),
sh as (select distinct a.type_id, a.id a, b.id b from fi a join fi b on a.type_id = b.type_id and a.start_column = b.start_column and a.id < b.id), e as (select a src, b dst from sh union select b, a from sh), {_REACH_SQL},
co as (select src id, least(src, min(dst)) c from reach group by 1), mc as (select type_id, coalesce(c, me.id) c from me left join co on co.id = me.id), sz as (select type_id, c, count(*) k from mc group by all), cs as (select type_id, count(*) nc, sum(k * (k - 1) // 2) cp from sz group by 1),
n as (select type_id, count(*) n from me group by 1), st as (select distinct type_id from fi), sp as (select type_id, count(*) s from sh group by 1),
a as (select n.type_id, n.n methods, coalesce(s, 0) shared_pairs, n.n * (n.n - 1) // 2 possible_pairs, cp::bigint connected_pairs, nc, n.n > 1 and st.type_id is not null applicable from n join cs on cs.type_id = n.type_id left join sp on sp.type_id = n.type_id left join st on st.type_id = n.type_id)
select type_id, methods, shared_pairs, possible_pairs, connected_pairs, applicable, case when applicable then {_R2('100.0::double * shared_pairs / possible_pairs')} end field_sharing_percent, case when applicable then {_R2('100.0::double * connected_pairs / possible_pairs')} end connected_pair_percent, case when applicable then nc end component_count from a""",
    "module_cohesion": f"""
with {_FACTS_SQL}, {_COMMITS_SQL}, kn as (select module_key, count(*) filter (where kind = 'trait') t, count(*) filter (where kind = 'impl') i from s0 where module_key is not null group by 1),
ch as (select path, coalesce(sum(churn), 0) churn from (select unnest(modules) m, churn from cm) join own on module_id = m group by 1), wh as (select sum(churn)::double w from ch),
j as (select module_id, coalesce(ch.churn, 0) c, w, (coalesce(function_count, 0) > 0)::int + (coalesce(t, 0) > 0)::int + (coalesce(i, 0) > 0)::int + (coalesce(public_api_count, 0) > 0)::int n from own left join kn on kn.module_key = module_id left join ch on ch.path = own.path cross join wh where source_metrics_available)
select module_id, n::bigint declaration_categories, {_R2('greatest(1 - greatest(n - 1, 0) / 3.0::double, 0) * 100')} responsibility_focus, c::bigint changed_lines, {_R2('c / nullif(w, 0) * 100')} change_share_percent, round({_R2('case when w > 0 then case when c > 0 then -(c / w) * log2(c / w) else 0 end end')}, 2) change_entropy_contribution from j""",
    "calibration_thresholds": f"""
with lb as (select * from (select *, row_number() over (partition by batch_no order by received_at desc nulls last) rn from calibration where batch_no is not null) where rn = 1), ev as (select project_key, kind, v from ({_KINDS_SQL}) where v is not null and not isnan(v) and v >= 0 and v < 'infinity'::double)
select project_key, kind, count(*) n_values, {_THREE} from ev group by 1, 2 union all select null, kind, count(*), {_THREE} from ev group by kind""",
    "ranking_validation": f"""
with {_OWN_SQL}, {_COMMITS_SQL}, lab as (select distinct repo_key, unnest(modules) l from cm where not coalesce(is_merge, false) and list_has_any(regexp_split_to_array(lower(subject), '[^\\p{{L}}\\p{{N}}]+'), [{_DEFECTS}])),
d as (select project_key project, exists (select 1 from lab where repo_key = project_key and (l = module_id or ends_with(module_id, '::' || l))) hit, row_number() over (partition by project_key order by source_nonblank_line_count desc, module_id) - 1 p, count(*) over (partition by project_key) n from own where source_nonblank_line_count is not null),
g as (select project, any_value(n) n, count(*) filter (where hit) k, count(*) filter (where hit and p < 10) t, sum(case when hit then (case when n = 1 then 100.0::double else (1 - p::double / (n - 1)) * 100 end)::decimal(30,10) end)::double r, count(*) filter (where hit and p < greatest(ceil(n / 4.0), 1)) q, max(greatest(ceil(n / 4.0), 1)) qn from d group by 1)
select project, n n_ranked, k n_relevant, round(case when k > 0 then t::double / least(n, 10) end, 6) precision_at_top, round(t::double / nullif(k, 0), 6) recall_at_top, round(r / nullif(k, 0), 6) mean_percentile_rank, round((q::double / nullif(k, 0)) / (qn::double / n), 6) quarter_lift, case when k = 0 then 'no-labels' else 'validated' end status from g""",
    "changed_scope": f"with {_FACTS_SQL}, {_COMMITS_SQL}, {_CHANGED_SQL} select path, qualified_name from fns where path in (select path from chg)",
    "changed_line_coverage": f"""
with {_FACTS_SQL}, {_COMMITS_SQL}, {_CHANGED_SQL}, rg as (select path, start_line, end_line from fns where path in (select path from chg)), h as (select * from pts where exists (select 1 from rg where rg.path = pts.path and line between start_line and end_line))
select path, count(*) executable, count(*) filter (where covered) covered, {_R2('100.0::double * count(*) filter (where covered) / count(*)')} "percent" from h group by 1""",
    "finding_ids": f"""
with {_DIAG_SQL}, k as (select rule_id, sha256(concat_ws(chr(0), rule_id, path, coalesce(trim(regexp_replace(message, '{_WS}+', ' ', 'g')), ''))) a, path from dg)
select substr(a, 1, 16) || '-' || row_number() over (partition by rule_id, path, a) id, rule_id from k""",
    "practice_summary": f"""
with {_DIAG_SQL}, ck as ({NESTED_SQL['p4_checks']}),
c as (select report_id, count(*) check_count, count(*) filter (where status = 'passed') passed, count(*) filter (where status = 'failed' and severity = 'error') failed_errors, count(*) filter (where status = 'failed' and severity = 'warning') failed_warnings, count(*) filter (where status in ('unavailable', 'timed-out')) unavailable, count(*) filter (where status = 'skipped') skipped,
  count(*) filter (where json_valid(metrics) and json_extract_string(metrics, '$.measurement_confidence.complete') = 'false') inc from ck group by 1),
d as (select report_id, count(*) n from (select distinct report_id, rule_id, message, path, line, "column" from dg) group by 1)
select c.report_id, check_count, coalesce(n, 0) diagnostic_count, passed, failed_errors, failed_warnings, unavailable, skipped, failed_errors = 0 and unavailable = 0 and inc = 0 conformant from c left join d on d.report_id = c.report_id""",
    "dependency_edges": f"""
with {_OWN_SQL}, {_EDGES_SQL}, rf as (select distinct src, array_to_string(string_split(src, '::')[1:2], '::') || '::' || array_to_string(string_split(dst, '::')[3:], '::') p from ed)
select distinct src, dst from (select src, (select arg_max(module_id, length(module_id)) from own where p || '::Item' = module_id or starts_with(p || '::Item', module_id || '::')) dst from rf) where dst is not null and dst <> src""",
    "semantic_candidates": f"""
with {_OWN_SQL}, {_EDGES_SQL}, rf as (select src module_id, 'crate::' || array_to_string(string_split(dst, '::')[3:], '::') || '::Item' raw_path from ed union all select src, dst from ed union all select module_id, 'std::' || module_key from own),
fs as (select distinct string_split(module_key, '::')[1] f from own union select distinct string_split(module_id, '::')[1] from own)
select * from rf where string_split(raw_path, '::')[1] in ('crate', 'self', 'super') or string_split(raw_path, '::')[1] in (select f from fs where f <> '')""",
    "target_metadata": f"""
with {_OWN_SQL}, pt as (select distinct path from own), tg as (select path, regexp_replace(path, '/(src|tests|benches|examples)/.*$', '') folder, package_name, target_name, target_kind from own where is_entrypoint), fo as (select distinct folder, package_name from tg),
nr as (select pt.path, arg_max(package_name, length(folder)) pk from pt join fo on starts_with(pt.path, folder || '/') or pt.path = folder group by 1)
select pt.path, coalesce(tg.package_name, pk) package_name, tg.target_name, coalesce(tg.target_kind, case when contains(pt.path, '/tests/') then 'test' when contains(pt.path, '/benches/') then 'bench' when contains(pt.path, '/examples/') then 'example' when regexp_matches(pt.path, '/src/bin/|/src/main\\.rs$') then 'bin' else 'lib' end) target_kind
from pt left join tg on tg.path = pt.path left join nr on nr.path = pt.path""",
    "test_code": f"""
with {_OWN_SQL}, t as (select distinct package_name p, module_key m from own where target_kind = 'test') select module_id, exists (select 1 from t where p = package_name and (m = module_key or starts_with(module_key, m || '::'))) test_code from own""",
    "definition_statuses": f"""
with {_OWN_SQL}, {_EDGES_SQL}, j as (select coalesce(path, 'target/gen/' || dst) p, path in (select path from own where parse_status = 'ok') ok from ed left join own on module_id = dst)
select case when ok then 'resolved_local' when p like 'target/%' then 'unmapped_generated_definition' when p like 'crates/%' or p like 'src/%' or p like 'tests/%' then 'unindexed_project_definition' else 'resolved_external' end status, count(*) n_references from j group by 1""",
    "compiled_edges": f"""
with {_FACTS_SQL}, dc as (select project_key c, id, min(module_key) m from lexical where id is not null and module_key is not null group by 1, 2 having count(distinct module_key) = 1),
rf as (select project_key c, id, parent from s0 where parent is not null), j as (select rf.c, a.m o, b.m t from rf left join dc a on a.c = rf.c and a.id = rf.id left join dc b on b.c = rf.c and b.id = rf.parent),
e as (select c, count(*) n from (select distinct c, o, t from j where o is not null and t is not null and o <> t) group by 1), u as (select c, count(*) filter (where o is null) a, count(*) filter (where o is not null) b from j where o is null or t is null group by 1)
select coalesce(e.c, u.c) context, coalesce(n, 0) n_edges, coalesce(a, 0) n_owner, coalesce(b, 0) n_target from e full outer join u on e.c is not distinct from u.c""",
    "artifact_summaries": f"""
with {_FACTS_SQL}, {_EDGES_SQL}, {_HOT_SQL}, {_TOPO_SQL}, {_TYPES_SQL}, {_FUNCTION_RISK_SQL}, {_API_SQL},
u as (select 'hotspots' tool, score v from hs union all select 'function-risk', crap from fq union all select 'locality', risk from tp union all select 'type-health', risk from tr union all select 'api-health', documentation_percent from ah)
select tool, count(*) record_count, count(*) filter (where v is null) unknown_count, {_R2('sum(v::decimal(30,2))::double')} total from u group by 1""",
}
