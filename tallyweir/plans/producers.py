"""The measurements as functions from fact tables to result tables.

Fact tables have the columns that the functions name; further columns pass or are
ignored. Every producer keeps "unknown" apart from zero: a file that couldn't be parsed
has rows with null scores, a missing artifact makes the scores that need it null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.numeric import band, minus_floor, percent, ratio, round2
from ..functions.text import is_test_module, is_test_path, layer_color, module_layer
from ..operators.graph import components, cycle_members, degrees, layer_violations
from ..operators.joins import guarded_join, metric_or_default, null_safe, range_counts
from ..operators.ranking import ranked, ranking_metrics
from ..operators.stats import entropy_terms, exact_percentiles, exact_sum

C = F.col


def components_of(*terms: tuple[str, Column, Column]) -> Column:
    """score_components: array of signal, raw and contribution."""
    return F.array(*(F.struct(F.lit(name).alias("signal"), raw.cast("double").alias("raw"), round2(contribution).alias("contribution")) for name, raw, contribution in terms))


def with_identity(rows: DataFrame, files: DataFrame, key: str = "module_id") -> DataFrame:
    """Rows with the package, target and backend of their module."""
    own = files.select(C(key).alias("_id"), "package_name", "target_name", "identity_backend").dropDuplicates(["_id"])
    return rows.join(own, C(key) == C("_id"), "left").drop("_id")


def function_hotspots(functions: DataFrame) -> DataFrame:
    score = S.function_score(C("branch_pressure"), C("path_pressure"), C("max_nesting_depth"), C("source_line_count"))
    parts = components_of(
        ("branch_pressure", C("branch_pressure"), C("branch_pressure") * 3.7 * 1.12),
        ("path_pressure", C("path_pressure"), minus_floor(C("path_pressure"), 1) * 2.0 * 1.12),
        ("nesting_depth_over_2", minus_floor(C("max_nesting_depth"), 2), minus_floor(C("max_nesting_depth"), 2) * 3.0 * 1.12),
        ("lines_over_20", minus_floor(C("source_line_count"), 20), F.least(minus_floor(C("source_line_count"), 20) * 0.25, F.lit(20.0)) * 1.12),
    )
    return functions.withColumn("score", score).withColumns({"risk_level": band(C("score"), *S.FUNCTION_BANDS), "signals": S.function_signals(C("branch_pressure"), C("max_nesting_depth"), C("source_line_count")), "score_components": parts})


def module_hotspots(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Scores of modules from their functions and size.

    Files that weren't parsed but have line counts come with null scores; those without
    have no row. A module without functions scores by its size alone.
    """
    scored = function_hotspots(functions).select(C("module_id").alias("_m"), "score", "cyclomatic_complexity", "cognitive_complexity")
    p95 = exact_percentiles(scored, ["_m"], "score", [0.95], ["p95"]).select(C("_m").alias("_p"), "p95")
    per = scored.groupBy("_m").agg(F.count("*").alias("function_count"), F.max("score").alias("largest"), (exact_sum(C("score"), 2) / F.count("*")).alias("mean"), *(f(c).alias(f"{c}_{n}") for c in ("cyclomatic_complexity", "cognitive_complexity") for n, f in (("sum", F.sum), ("max", F.max))))
    ok = C("parse_status") == "ok"
    own = files.filter(ok | C("source_metrics_available")).select("module_id", "module_key", "path", "parse_status", C("source_nonblank_line_count").alias("sloc"))
    joined = own.join(per, C("module_id") == C("_m"), "left").join(p95, C("_m") == C("_p"), "left").drop("_m", "_p")
    known = {c: F.when(ok, F.coalesce(C(c), F.lit(0))) for c in ("function_count", "largest", "mean", "p95", "cyclomatic_complexity_sum", "cyclomatic_complexity_max", "cognitive_complexity_sum", "cognitive_complexity_max")}
    joined = joined.withColumns(known)
    pressure = F.when(ok, F.least(C("sloc") / 10.0, F.lit(20.0)))
    score = round2(S.module_score(C("largest"), C("p95"), C("mean"), F.when(ok, C("sloc"))))
    average = lambda c: round2(percent(C(f"{c}_sum"), C("function_count"), 0.0) / 100)
    return joined.withColumns({
        "score": score, "risk_level": band(score, *S.MODULE_BANDS),
        "max_function_score": round2(C("largest")), "p95_function_score": round2(C("p95")), "mean_function_score": round2(C("mean")), "size_score": round2(pressure),
        "cyclomatic_complexity_average": average("cyclomatic_complexity"), "cognitive_complexity_average": average("cognitive_complexity"),
        "signals": F.when((C("sloc") >= 250) | (C("largest") >= 60), "watch").when(ok, "stable"),
        "complexity_density": F.when(C("sloc") > 0, round2(score / C("sloc"))).when(ok, 0.0),
        "score_components": components_of(("max_function_score", C("largest"), C("largest") * 0.55), ("p95_function_score", C("p95"), C("p95") * 0.25), ("mean_function_score", C("mean"), C("mean") * 0.10), ("module_size_pressure", pressure, pressure * 0.5)),
    }).drop("largest", "mean", "p95")


def function_risk(functions: DataFrame, coverage_lines: DataFrame) -> DataFrame:
    """Coverage inside each function and the risk that follows; unknown without an executable line."""
    spans = functions.select("module_id", "qualified_name", "path", "start_line", "end_line", "cyclomatic_complexity")
    points = coverage_lines.select(C("path").alias("_path"), "line", "covered")
    found = range_counts(spans, ["path", "qualified_name", "start_line", "end_line"], "start_line", "end_line", points, "line", C("covered"), [("_path", "path")], 128)
    share = ratio(C("n_hits"), C("n_points"))
    score = S.crap(C("cyclomatic_complexity"), share)
    return found.withColumns({"coverage_percent": round2(share * 100), "crap": score, "risk_level": F.when(score.isNull(), "unknown").when(score > 30, "high").otherwise("normal")}).withColumnsRenamed({"n_points": "executable_lines", "n_hits": "covered_lines"})


#: Groups of escape kinds.
ESCAPE_GROUPS = {
    "unsafe_count": ["unsafe_block", "unsafe_fn", "unsafe_impl", "unsafe_trait"], "ffi_count": ["extern_block", "extern_fn", "linkage"],
    "raw_memory_count": ["raw_borrow", "transmute", "maybe_uninit", "union", "raw_memory_api"], "deref_count": ["deref", "deref_mut"], "layout_count": ["layout_repr"], "allow_count": ["clippy_suppression", "lint_suppression"],
}


def escape_hatches(escapes: DataFrame) -> DataFrame:
    """Counts, groups and weighted score of each module with any escape; ``escapes`` has module_id, kind, count."""
    each = escapes.groupBy("module_id", "kind").agg(F.sum("count").alias("n"))
    per = each.groupBy("module_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("counts"), F.sum("n").alias("total_count"), *(F.coalesce(F.sum(F.when(C("kind").isin(kinds), C("n"))), F.lit(0)).alias(g) for g, kinds in ESCAPE_GROUPS.items()))
    return per.filter("total_count > 0").withColumn("score", round2(S.escape_score(C("counts")).cast("double")))


def type_health(types: DataFrame, impls: DataFrame, complete: bool = True) -> DataFrame:
    """Structural risk of types. Impl blocks count for the one type of their name in the package and target; others abstain.

    With an incomplete inventory the observed counts stay and the risk is null.
    """
    keys = ["package_name", "target_name", "qualified_name"]
    owners = types.select(*(C(k).alias(f"t_{k}") for k in keys))
    joined, _ = guarded_join(impls.withColumnRenamed("path", "impl_path"), owners, [("package_name", "t_package_name"), ("target_name", "t_target_name"), ("qualified_type_name", "t_qualified_name")])
    per = joined.groupBy(*(f"t_{k}" for k in keys)).agg(F.sum("method_count").alias("methods"), F.count("*").alias("blocks"), F.countDistinct("impl_path").alias("files"))
    rows = types.join(per, null_safe([(k, f"t_{k}") for k in keys]), "left").drop(*(f"t_{k}" for k in keys)).fillna(0, ["methods", "blocks", "files"])
    risk = S.type_risk(C("field_count"), C("variant_count"), C("variant_field_count"), C("methods"), C("declaration_span"), C("files"), C("blocks"))
    signals = S.type_signals(C("field_count"), C("shape") == "tuple", C("variant_count"), C("variant_field_count"), C("methods"), C("files"), C("blocks"), C("declaration_span"))
    known = F.lit(complete)
    scored = rows.withColumns({"structural_risk": F.when(known, risk), "signals": F.when(known, signals).otherwise(F.array(F.lit("incomplete inventory"))), "method_count": F.when(known, C("methods"))})
    return scored.withColumnsRenamed({"methods": "observed_method_count", "blocks": "observed_impl_block_count", "files": "observed_impl_file_count"})


def reliability(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of parsed files with scope and severity: advisory in tests, error for safety rules, else warning."""
    own = files.filter("parse_status = 'ok'").select(C("path").alias("_path"), "module_id", "module_key")
    joined = findings.join(own, C("path") == C("_path")).drop("_path")
    test = is_test_path(C("path")) | F.coalesce(is_test_module(C("module_key")), F.lit(False)) | F.coalesce(C("test_code"), F.lit(False))
    severity = F.when(test, "advisory").when(C("rule_id").startswith("rust.safety."), "error").otherwise("warning")
    return joined.withColumns({"scope": F.when(test, "test").otherwise("production"), "severity": severity}).withColumn("policy_selected", (C("scope") == "production") & (C("severity") != "advisory"))


def api_health(files: DataFrame) -> DataFrame:
    """Documentation of public items; modules with API, and crate roots without."""
    own = files.filter((C("parse_status") == "ok") & ((C("public_api_count") > 0) | C("is_entrypoint")))
    return own.select("module_id", "module_key", "public_api_count", "documented_public_api_count", "has_crate_docs", (C("public_api_count") - C("documented_public_api_count")).alias("missing_docs"), round2(percent(C("documented_public_api_count"), C("public_api_count"), 100.0)).alias("documentation_percent"))


def test_quality(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct tests (package, target, path, name) and their findings."""
    own = tests.dropDuplicates(["package_name", "target_name", "path", "qualified_name"])
    rules = [("rust.test.no-assertion", C("assertion_count") == 0), ("rust.test.no-sut-call", C("sut_call_count") == 0), ("rust.test.ignored", C("ignored"))]
    found = own.select("path", "line", "qualified_name", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules)))).alias("rule_id"))
    return own, found


def topology(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees, layer, locality and leverage of every module."""
    own = degrees(files.select("module_id", "module_key", F.coalesce("is_entrypoint", F.lit(False)).alias("is_entrypoint")), "module_id", edges)
    out, into, entry = C("outbound"), C("inbound"), C("is_entrypoint")
    risk = S.locality_risk(out, into, entry)
    return own.withColumns({"layer": module_layer(C("module_key"), entry), "locality_risk": risk, "locality_score": round2(100.0 - risk), "leverage_pressure": S.leverage_pressure(out, into, entry), "leverage_score": S.reuse(into), "signals": F.when(risk > 0, "dependency spread").when(entry, "entrypoint orchestration").otherwise("stable")})


def correctness_counts(tests: DataFrame) -> DataFrame:
    """Tests of each module by status: a test counts for its module ids, else its module names, else its own module."""
    lists = F.coalesce(F.when(F.size("tested_module_ids") > 0, C("tested_module_ids")), F.when(F.size("tested_modules") > 0, C("tested_modules")), F.when(C("module_key").isNotNull(), F.array("module_key")))
    each = tests.select(F.explode(lists).alias("module"), F.coalesce("last_status", F.lit("unknown")).alias("s"))
    n = lambda *s: F.count_if(C("s").isin(*s))
    return each.groupBy("module").agg(F.count("*").alias("test_count"), n("failed").alias("failed_count"), n("skipped", "ignored").alias("skipped_count"), F.count_if(~C("s").isin("passed", "failed", "skipped", "ignored")).alias("unknown_count"))


def layer_counts(tests: DataFrame) -> DataFrame:
    """Tests of each layer by status and the share that failed."""
    n = {s: F.count_if(C("last_status") == s) for s in ("passed", "failed", "skipped", "unknown")}
    return tests.groupBy("layer").agg(F.count("*").alias("test_count"), *(c.alias(f"{s}_count") for s, c in n.items()), round2(percent(n["failed"], F.count("*"), 0.0)).alias("failed_percent"))


def git_facts(commits: DataFrame, commit_modules: DataFrame, subject_is_defect: Column) -> DataFrame:
    """Churn, commits, contributors, defect commits and co-changes of each module.

    ``commits``: hash, author, subject; ``commit_modules``: hash, module_id, churn (one row a changed path).
    """
    sizes = commit_modules.select("hash", "module_id").distinct().groupBy(C("hash").alias("_h")).agg(F.count("*").alias("_n"))
    rows = commit_modules.join(commits.select(C("hash").alias("_c"), "author", subject_is_defect.alias("_d")), C("hash") == C("_c")).join(sizes, C("hash") == C("_h"))
    once = rows.groupBy("module_id", "hash").agg(F.sum("churn").alias("churn"), F.first("author").alias("author"), F.first("_d").alias("_d"), F.first("_n").alias("_n"))
    return once.groupBy("module_id").agg(F.coalesce(F.sum("churn"), F.lit(0)).alias("churn"), F.count("*").alias("commit_count"), F.countDistinct("author").alias("contributor_count"), F.count_if("_d").alias("defect_commit_count"), F.sum(C("_n") - 1).alias("cochange_count"))


def risk_map(files: DataFrame, topology_rows: DataFrame, edges: DataFrame, hotspots: DataFrame | None, git: DataFrame | None, correctness: DataFrame | None, coverage: DataFrame | None = None, run_status: str = "passed") -> DataFrame:
    """All risks of every module and their total.

    An input that is None is a missing artifact and its scores are unknown; an input
    without a row for a module means zeros. Metrics are looked up by module id, else by
    the readable key. Coverage is optional: without it the coverage terms are 0.
    ``coverage``: module, percent.
    """
    own = files.select("module_id", "module_key", F.coalesce("is_entrypoint", F.lit(False)).alias("is_entrypoint"), C("source_nonblank_line_count").alias("sloc"), C("public_api_count").alias("api"))

    def lookup(rows: DataFrame, table: DataFrame | None, key: str, columns: Sequence[str], default: bool = True) -> DataFrame:
        if table is None:
            return rows.withColumns({c: F.lit(None).cast("double") for c in columns})
        for i, on in enumerate(("module_id", "module_key")):
            side = table.filter(C(key).isNotNull()).dropDuplicates([key]).select(C(key).alias(f"_k{i}"), *(C(c).cast("double").alias(f"_{c}{i}") for c in columns))
            rows = rows.join(side, C(on) == C(f"_k{i}"), "left")
        value = lambda c: F.coalesce(C(f"_{c}0"), C(f"_{c}1"))
        return rows.withColumns({c: metric_or_default(value(c), F.lit(True)) if default else value(c) for c in columns}).drop(*(f"_{c}{i}" for c in columns for i in (0, 1)), "_k0", "_k1")

    rows = lookup(own, hotspots, "module_id", ["score"], default=False).withColumnRenamed("score", "complexity")
    topo = topology_rows.select(C("module_id").alias("_t"), "outbound", "inbound", "locality_risk", "leverage_pressure", "layer")
    rows = rows.join(topo, C("module_id") == C("_t"), "left").drop("_t").fillna(0, ["outbound", "inbound"]).fillna(0.0, ["locality_risk", "leverage_pressure"])
    violations = layer_violations(edges).groupBy(C("src").alias("_v")).agg(F.count("*").alias("violations"))
    cyclic = cycle_members(edges).select(C("vertex").alias("_c"))
    rows = rows.join(violations, C("module_id") == C("_v"), "left").join(cyclic, C("module_id") == C("_c"), "left").withColumn("in_cycle", C("_c").isNotNull()).drop("_v", "_c").fillna(0, ["violations"])
    rows = lookup(rows, git, "module_id", ["churn", "commit_count", "contributor_count", "defect_commit_count"])
    rows = lookup(rows, correctness, "module", ["test_count", "failed_count", "skipped_count", "unknown_count"])
    rows = lookup(rows, coverage, "module", ["percent"], default=False)

    out = S.entrypoint_allowance(C("outbound"), C("is_entrypoint"), S.ENTRYPOINT_OUTBOUND)
    broken = S.entrypoint_allowance(C("violations"), C("is_entrypoint"), S.ENTRYPOINT_VIOLATIONS)
    tested = (C("test_count") > 0) | (F.coalesce(C("percent"), F.lit(0.0)) > 0)
    known_tests = C("test_count").isNotNull()
    rows = rows.withColumns({
        "maintainability_risk": S.maintainability(C("complexity"), C("sloc"), C("api"), out, C("inbound")),
        "change_risk": S.change(C("churn"), C("commit_count"), C("contributor_count"), C("defect_commit_count"), F.coalesce(tested, F.lit(False))),
        "correctness_risk": F.when(known_tests, S.correctness(C("failed_count"), C("unknown_count"), C("skipped_count"), C("test_count"), C("percent"), F.lit(run_status))),
        "architectural_risk": S.architecture(out, C("inbound"), broken, C("in_cycle"), C("sloc")),
    })
    rows = rows.withColumn("quality_risk", S.quality(C("maintainability_risk"), C("locality_risk"), C("leverage_pressure")))
    whole = C("change_risk") + C("correctness_risk") + C("quality_risk") + C("architectural_risk")
    rows = rows.withColumn("total_score", round2(whole))
    names = ("maintainability_risk", "change_risk", "correctness_risk", "quality_risk", "total_score")
    parts = components_of(*((n, C(n), C(n)) for n in ("change_risk", "correctness_risk", "quality_risk", "architectural_risk")))
    return rows.withColumns({"unknown_metrics": F.array_compact(F.array(*(F.when(C(n).isNull(), F.lit(n)) for n in names))), "risk_level": band(C("total_score"), *S.TOTAL_BANDS), "score_components": parts})


def map_nodes(risks: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of the map: identity, scores, and the raw facts that they came from in one struct."""
    own = files.select(C("module_id").alias("_n"), "path", "package_name", "target_name", "target_kind", "entrypoint_kind", "identity_backend", "parse_status", C("source_comment_line_count").alias("comment_lines"), C("function_count").alias("functions"), C("documented_public_api_count").alias("documented_api"))
    facts = F.struct("sloc", "comment_lines", "functions", "api", "documented_api", "outbound", "inbound", "violations", "in_cycle", "complexity", "churn", "commit_count", "contributor_count", "defect_commit_count", "test_count", "failed_count", "skipped_count", "unknown_count", C("percent").alias("coverage_percent"))
    scores = ["layer", "maintainability_risk", "change_risk", "correctness_risk", "quality_risk", "architectural_risk", "locality_risk", "leverage_pressure", "total_score", "risk_level", "unknown_metrics", "score_components"]
    joined = risks.join(own, C("module_id") == C("_n"), "left").drop("_n")
    return joined.select("module_id", "module_key", "path", "package_name", "target_name", "target_kind", "entrypoint_kind", "is_entrypoint", "identity_backend", "parse_status", *scores, layer_color(C("layer")).alias("layer_color"), facts.alias("raw_facts"))


def map_edges(edges: DataFrame, containment: DataFrame) -> DataFrame:
    """Dependency and containment edges in one table, each once, with its kind."""
    return edges.select("src", "dst", F.lit("dependency").alias("kind")).unionByName(containment.select("src", "dst", F.lit("containment").alias("kind"))).distinct()


def unknown_counts(risks: DataFrame) -> DataFrame:
    """How many modules lack each metric."""
    return risks.select(F.explode("unknown_metrics").alias("metric")).groupBy("metric").agg(F.count("*").alias("n_modules"))


def structural_cohesion(methods: DataFrame) -> DataFrame:
    """Shared-field pairs, connected pairs and components of the methods of each type.

    ``methods``: type_id, method, fields (array), calls (array), complete. Percentages
    are null unless every method is complete, there are two methods and some state.
    Methods meet through the fields they share and the calls they make, not in pairs of
    all; pairs are then counted from the distinct links.
    """
    m = methods.select("type_id", "method", F.array_distinct("fields").alias("fields"), F.array_distinct("calls").alias("calls"), "complete")
    f = m.select("type_id", "method", F.explode("fields").alias("field"))
    g = f.withColumnsRenamed({"type_id": "_t", "method": "other", "field": "_f"})
    shared = f.join(g, (C("type_id") == C("_t")) & (C("field") == C("_f")) & (C("method") < C("other"))).select("type_id", "method", "other").distinct()
    calls = m.select("type_id", "method", F.explode("calls").alias("other")).join(m.select(C("type_id").alias("_t"), C("method").alias("_m")), (C("type_id") == C("_t")) & (C("other") == C("_m"))).filter("method <> other")
    name = lambda c: F.concat_ws("\x00", "type_id", c)
    links = shared.select(name("method").alias("src"), name("other").alias("dst")).unionByName(calls.select(name("method").alias("src"), name("other").alias("dst")))
    found = components(links).select(C("vertex").alias("_v"), "component")
    member = m.select("type_id", name("method").alias("_n")).join(found, C("_n") == C("_v"), "left").select("type_id", F.coalesce("component", "_n").alias("component"))
    sizes = member.groupBy("type_id", "component").agg(F.count("*").alias("k")).groupBy(C("type_id").alias("_c")).agg(F.count("*").alias("n_components"), F.sum((C("k") * (C("k") - 1) / 2).cast("bigint")).alias("connected_pairs"))
    pairs = shared.groupBy(C("type_id").alias("_s")).agg(F.count("*").alias("shared_pairs"))
    per = m.groupBy("type_id").agg(F.count("*").alias("n"), F.bool_and("complete").alias("complete"), F.max(F.size("fields") > 0).alias("has_state"))
    rows = per.join(pairs, C("type_id") == C("_s"), "left").join(sizes, C("type_id") == C("_c"), "left").drop("_s", "_c").fillna(0, ["shared_pairs"])
    possible = (C("n") * (C("n") - 1) / 2).cast("bigint")
    rows = rows.withColumn("possible_pairs", possible).withColumn("applicable", (possible > 0) & C("has_state"))
    sure = C("complete") & C("applicable")
    return rows.withColumns({"field_sharing_percent": F.when(sure, round2(percent(C("shared_pairs"), C("possible_pairs"), None))), "connected_pair_percent": F.when(sure, round2(percent(C("connected_pairs"), C("possible_pairs"), None))), "component_count": F.when(sure, C("n_components"))})


def module_cohesion(files: DataFrame, kinds: DataFrame, churn: DataFrame) -> DataFrame:
    """Declaration categories, focus, and share and entropy of change of each module.

    ``kinds``: module_id, n_types, n_impls; ``churn``: path, churn.
    """
    own = files.filter("source_metrics_available").select("module_id", "path", "function_count", "public_api_count")
    rows = own.join(kinds.withColumnRenamed("module_id", "_k"), C("module_id") == C("_k"), "left").join(churn.withColumnRenamed("path", "_p"), C("path") == C("_p"), "left").fillna(0, ["n_types", "n_impls", "churn"])
    rows = rows.crossJoin(churn.agg(F.coalesce(F.sum("churn"), F.lit(0)).cast("double").alias("_whole")))  # one row
    n = reduce(lambda a, b: a + b, [(C(c) > 0).cast("int") for c in ("function_count", "n_types", "n_impls", "public_api_count")])
    focus = round2(F.greatest(1.0 - minus_floor(n, 1) / 3.0, F.lit(0.0)) * 100)
    share = ratio(C("churn"), C("_whole"))
    return rows.select("module_id", n.alias("declaration_categories"), focus.alias("responsibility_focus"), C("churn").alias("changed_lines"), round2(share * 100).alias("change_share_percent"), round2(entropy_terms(C("churn"), C("_whole"))).alias("change_entropy_contribution"))


def calibrate(scores: DataFrame, project: str, kind: str, score: str) -> DataFrame:
    """p90, p95 and p99 of each kind of score by project, and over all projects pooled (project null)."""
    qs, names = (0.9, 0.95, 0.99), ("p90", "p95", "p99")
    own = exact_percentiles(scores, [project, kind], score, qs, names)
    pool = exact_percentiles(scores, [kind], score, qs, names).withColumn(project, F.lit(None).cast("string"))
    return own.unionByName(pool)


def validate_rankings(modules: DataFrame, outcomes: DataFrame, kinds: Sequence[str], allow_inferred: bool = False) -> DataFrame:
    """How well each project's ranking finds the modules that outcomes name.

    ``modules``: project, module, score; ``outcomes``: project, kind, modules (array),
    evidence_class. Only reviewed labels count unless inferred ones are allowed. A label
    names a module by its id or by the end of it.
    """
    from ..operators.joins import suffixes

    picked = outcomes.filter(C("kind").isin(list(kinds)) & (F.lit(allow_inferred) | (C("evidence_class") == "reviewed-label")))
    labels = picked.select(C("project").alias("_lp"), F.explode("modules").alias("_label")).distinct()
    named = modules.select("project", "module").distinct().select("project", "module", F.explode(suffixes(C("module"), "::")).alias("_s"))
    hit = named.join(labels, (C("project") == C("_lp")) & (C("_s") == C("_label")), "left_semi").select(C("project").alias("_hp"), C("module").alias("_hm")).distinct()
    rows = modules.filter(C("score").isNotNull()).join(hit, (C("project") == C("_hp")) & (C("module") == C("_hm")), "left").withColumn("relevant", C("_hm").isNotNull()).drop("_hp", "_hm")
    return ranking_metrics(ranked(rows, ["project"], "score", "module"), ["project"], "relevant")


def changed_scope(rows: DataFrame, changed: DataFrame, columns: Sequence[str] = ("path",), instances: str | None = None) -> DataFrame:
    """Rows that touch a changed file in one of the columns, or in any element of an array of structs with ``path``."""
    key = [*(C(c) for c in columns)]
    paths = F.array_compact(F.array(*key)) if instances is None else F.concat(F.array_compact(F.array(*key)), F.coalesce(F.transform(instances, lambda x: x["path"]), F.array().cast("array<string>")))
    own = rows.withColumn("_paths", F.array_distinct(paths)).withColumn("_row", F.xxhash64("_paths"))
    touched = own.select("_row", "_paths").distinct().select("_row", "_paths", F.explode("_paths").alias("_p")).join(changed.select(C("path").alias("_c")).distinct(), C("_p") == C("_c"), "left_semi").select("_row", "_paths").distinct()
    return own.join(touched, ["_row", "_paths"], "left_semi").drop("_paths", "_row")


def gate(failures: dict[str, DataFrame]) -> list[str]:
    """Names of the policies that have a failing row; each is asked for one row only."""
    return sorted(name for name, df in failures.items() if df.limit(1).count())
