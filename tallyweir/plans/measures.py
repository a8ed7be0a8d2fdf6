"""Scores and statistics as queries over the tables, each with its SQL.

TPC-H-like tables stand for facts where the project's own tables have none:
lineitem for functions, suppliers for modules, orders for intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.numeric import band, bucket_count, percent, ratio, round2
from ..functions.text import is_defect_subject
from ..operators.evidence import first_per_key
from ..operators.graph import degrees
from ..operators.ranking import ranked, top_k
from ..operators.stats import concentration, confusion, distribution, entropy_terms, exact_percentiles, exact_sum, flakiness
from ..tables import last_delivery, load


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as functions: branch, path and nesting counts and lines, with the hotspot score."""
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    branch, path, nesting = F.col("l_linenumber"), F.floor(F.col("l_quantity") / 5), F.floor(F.col("l_linenumber") / 2)
    return items.select("l_orderkey", "l_linenumber", "l_suppkey", branch.alias("branch"), path.alias("path"), nesting.alias("nesting"), F.col("l_quantity").alias("lines"), S.function_score(branch, path, nesting, F.col("l_quantity")).alias("score"))


_FUNCTIONS_SQL = """
fn as (
  select l_orderkey, l_linenumber, l_suppkey, l_linenumber branch, floor(l_quantity / 5) path, floor(l_linenumber / 2) nesting, l_quantity lines,
         round(1.12::double * (3.7::double * l_linenumber + 2.0::double * greatest(floor(l_quantity / 5) - 1, 0) + 3.0::double * greatest(floor(l_linenumber / 2) - 2, 0) + least(0.25::double * greatest(l_quantity - 20, 0), 20.0::double)) * 100) / 100 score
  from lineitem
)"""


def module_hotspot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: scores of functions rolled up to their module, with band and position."""
    fn = _functions(spark, sf_dir)
    p95 = exact_percentiles(fn, ["l_suppkey"], "score", [0.95], ["p95"]).select(F.col("l_suppkey").alias("_s"), "p95")
    module = fn.groupBy("l_suppkey").agg(F.max("score").alias("largest"), (exact_sum(F.col("score")) / F.count("*")).alias("mean"), F.sum(F.col("lines").cast("decimal(20,2)")).cast("double").alias("lines"))
    module = module.join(p95, F.col("l_suppkey") == F.col("_s")).withColumn("score", round2(S.module_score(F.col("largest"), F.col("p95"), F.col("mean"), F.col("lines"))))
    return ranked(module, [], "score", "l_suppkey").select("l_suppkey", round2(F.col("largest")).alias("largest"), round2(F.col("p95")).alias("p95"), round2(F.col("mean")).alias("mean"), "score", band(F.col("score"), *S.MODULE_BANDS).alias("band"), F.col("position").cast("bigint").alias("position"))


def function_score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = _functions(spark, sf_dir)
    return fn.select("l_orderkey", "l_linenumber", round2(F.col("score")).alias("score"), band(F.col("score"), *S.FUNCTION_BANDS).alias("band"), F.array_join(S.function_signals(F.col("branch"), F.col("nesting"), F.col("lines")), ",").alias("signals"), bucket_count(F.col("branch")).alias("branch_bucket"))


def topk_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = _functions(spark, sf_dir)
    return top_k(fn, 10, "score", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", round2(F.col("score")).alias("score"))


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution(load(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice")


def pooled_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p90, p95 and p99 over two projects' values pooled."""
    pool = load(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v")).unionByName(load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v")))
    return exact_percentiles(pool, [], "v", [0.9, 0.95, 0.99], ["p90", "p95", "p99"])


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each commit, with its cleaned modules."""
    own = last_delivery(load(spark, sf_dir, "history").filter(F.col("hash").isNotNull()).withColumn("hash", F.lower(F.trim("hash"))), ["hash"], "ingested_at")
    clean = F.array_distinct(F.filter(F.transform("modules", lambda m: F.trim(m)), lambda m: m.isNotNull() & (m != "")))
    return own.withColumn("modules", F.coalesce(clean, F.array().cast("array<string>")))


_COMMITS_SQL = """
cm as (
  select * replace (lower(trim(hash)) as hash, coalesce(list_distinct(list_filter(list_transform(modules, lambda m: trim(m)), lambda m: m is not null and m <> '')), []) as modules)
  from (select *, row_number() over (partition by lower(trim(hash)) order by ingested_at desc nulls last) rn from history where hash is not null) where rn = 1
)"""
_DEFECTS = "'bug','bugs','bugfix','fix','fixes','fixed','defect','defects','regression','regressions','panic','crash'"


def _git_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = _commits(spark, sf_dir).withColumn("_n", F.size("modules")).select("hash", "author", "churn", is_defect_subject(F.col("subject")).alias("defect"), F.col("_n"), F.explode("modules").alias("module_id"))
    return touched.groupBy("module_id").agg(
        F.coalesce(F.sum("churn"), F.lit(0)).cast("bigint").alias("churn"), F.count("*").alias("commits"), F.countDistinct("author").alias("contributors"), F.count_if("defect").alias("defect_commits"), F.sum(F.col("_n") - 1).cast("bigint").alias("cochanges")
    )


def churn_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _git_facts(spark, sf_dir)


_GIT_SQL = f"""
git as (
  select module_id, coalesce(sum(churn), 0)::bigint churn, count(*)::bigint commits, count(distinct author)::bigint contributors, count(*) filter (where defect)::bigint defect_commits, sum(n - 1)::bigint cochanges
  from (select unnest(modules) module_id, churn, author, len(modules) n, coalesce(list_has_any(regexp_split_to_array(lower(subject), '[^\\p{{L}}\\p{{N}}]+'), [{_DEFECTS}]), false) defect from cm) group by 1
)"""


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_delivery(load(spark, sf_dir, "file_facts").filter(F.col("module_id").isNotNull()), ["module_id"], "scanned_at")


def risk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each module from its source and its history; an unknown input makes the scores that need it, and the total, null.

    A module without commits has zero change facts, as history is there; unparsed files have unknown lines.
    """
    own = _modules(spark, sf_dir).select("module_id", "is_entrypoint", F.col("source_nonblank_line_count").alias("sloc"), F.col("public_api_count").alias("api"), F.col("function_count").alias("functions"))
    joined = own.join(_git_facts(spark, sf_dir).withColumnRenamed("module_id", "_m"), F.col("module_id") == F.col("_m"), "left").drop("_m").fillna(0, ["churn", "commits", "contributors", "defect_commits", "cochanges"])
    outbound = S.entrypoint_allowance(F.col("cochanges"), F.coalesce("is_entrypoint", F.lit(False)), S.ENTRYPOINT_OUTBOUND)
    maintain = S.maintainability(F.col("functions") * 2, F.col("sloc"), F.col("api"), outbound, F.col("commits"))
    change = S.change(F.col("churn"), F.col("commits"), F.col("contributors"), F.col("defect_commits"), F.col("functions") > 3)
    arch = S.architecture(outbound, F.col("commits"), F.lit(0), F.lit(False), F.col("sloc"))
    scored = joined.select("module_id", maintain.alias("maintainability"), change.alias("change"), arch.alias("architectural"))
    whole = F.col("maintainability") + F.col("change") + F.col("architectural")
    unknown = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("maintainability", "change", "architectural"))))
    return scored.select("*", round2(whole).alias("total"), band(whole, *S.TOTAL_BANDS).alias("band"), F.array_join(unknown, ",").alias("unknown_metrics"))


def module_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = _commits(spark, sf_dir).select("author", F.explode("modules").alias("module_id"))
    found = concentration(touched, ["module_id"], "author")
    return found.select("module_id", F.col("total").cast("bigint").alias("commits"), "n_members", "primary", round2(F.col("primary_share") * 100).alias("primary_share"), F.round("hhi", 6).alias("hhi"), F.round(F.abs("entropy"), 6).alias("entropy"))


def change_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of a repository's churn over its modules; null without churn. Terms are summed before rounding."""
    each = _commits(spark, sf_dir).select("repo_key", F.explode("modules").alias("m"), "churn").groupBy("repo_key", "m").agg(F.coalesce(F.sum("churn"), F.lit(0)).alias("churn"))
    whole = each.groupBy(F.col("repo_key").alias("_r")).agg(F.sum("churn").alias("whole"))
    terms = each.join(whole, F.col("repo_key").eqNullSafe(F.col("_r"))).select("repo_key", "whole", entropy_terms(F.col("churn"), F.col("whole")).alias("t"))
    return terms.groupBy("repo_key").agg(F.max("whole").cast("bigint").alias("churn"), F.round(F.sum(F.col("t").cast("decimal(30,15)")).cast("double"), 6).alias("entropy"))


def amplification_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules per commit of each repository: mean, median (mean of the two middle ones) and largest."""
    own = _commits(spark, sf_dir).select("repo_key", F.size("modules").alias("n")).filter("n > 0")
    return own.groupBy("repo_key").agg(F.count("*").alias("commits"), round2(F.sum("n") / F.count("*")).alias("mean"), F.median("n").alias("median"), F.max("n").cast("bigint").alias("largest"))


def confusion_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain word rule against the reviews, by source; documents without text abstain."""
    labels = first_per_key(load(spark, sf_dir, "labels").select("doc_id", "toxic", "reviewed_at", "reviewer"), ["doc_id"], F.struct("reviewed_at", "reviewer"))
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), "source", F.lower("text").rlike(r"\b(idiot|fool|moron|stupid|naked|vermin)").alias("observed"))
    return confusion(labels.join(docs, F.col("doc_id") == F.col("_d")).withColumn("expected", F.col("toxic") == 1), ["source"], "expected", "observed")


def flaky_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tests, days as iterations, event types as outcomes."""
    events = load(spark, sf_dir, "events")
    runs = events.select("user_id", F.dayofmonth("ts").alias("iteration"), F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "ignored").otherwise("ok").alias("status"))
    return flakiness(events.select("user_id").distinct(), runs, ["user_id"], 31)


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n_all"), n("F").alias("n_failed"), n("O").alias("n_open"), n("P").alias("n_partial"), round2(percent(n("F"), F.count("*"), 0.0)).alias("failed_percent"))


def killed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score over decided rows alone, null if there are none."""
    killed, survived = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(killed.alias("killed"), survived.alias("survived"), round2(percent(killed, killed + survived, None)).alias("score"))


_KINDS = {"view": "deref", "signup": "unsafe_fn", "error": "lint_suppression", "click": "clippy_suppression", "purchase": "transmute"}


def escape_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted escape score of each user and day from a map of counts."""
    kinds = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    each = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), kinds[F.col("event_type")].alias("kind")).groupBy("user_id", "day", "kind").agg(F.count("*").alias("n"))
    counts = each.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("counts"))  # at most one entry a kind
    return counts.select("user_id", "day", S.escape_score(F.col("counts")).cast("bigint").alias("score")).filter("score > 0")


def type_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("_p")).agg(F.count("*").alias("methods"), F.countDistinct("l_suppkey").alias("files"), F.countDistinct("l_orderkey").alias("blocks"))
    part = load(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("_p"), "left")
    c = F.col
    return part.select("p_partkey", S.type_risk(c("p_size"), c("p_size") / 3, c("p_size") / 2, c("methods"), c("p_size"), c("files"), c("blocks")).alias("risk"), F.array_join(S.type_signals(c("p_size"), c("p_size") > 40, F.lit(3), F.lit(2), c("methods"), c("files"), c("blocks"), c("p_size")), ",").alias("signals"))


def locality_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of the supplier-part graph and the two scores that follow from them."""
    edges = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    vertices = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("module")).unionByName(load(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("module")))
    entry = F.col("module").endswith("7")
    return degrees(vertices, "module", edges).select("module", F.col("outbound").cast("bigint").alias("outbound"), F.col("inbound").cast("bigint").alias("inbound"), S.locality_risk(F.col("outbound"), F.col("inbound"), entry).alias("locality_risk"), S.leverage_pressure(F.col("outbound"), F.col("inbound"), entry).alias("leverage_pressure"), S.reuse(F.col("inbound")).alias("reuse"))


def halstead_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    h = S.halstead(F.col("p_size"), F.col("p_partkey") % 7, F.col("p_size") * 3, (F.col("p_partkey") % 7) * 4)
    return p.select("p_partkey", h.alias("h")).select("p_partkey", F.round("h.volume", 6).alias("volume"), F.round("h.difficulty", 6).alias("difficulty"), F.round("h.effort", 4).alias("effort"))


def api_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documented public items; 100 without any. Rows without API count if they are a crate root."""
    own = _modules(spark, sf_dir).filter((F.col("public_api_count") > 0) | F.col("has_crate_docs"))
    return own.select("module_id", (F.col("public_api_count") - F.col("documented_public_api_count")).alias("missing"), round2(percent(F.col("documented_public_api_count"), F.col("public_api_count"), 100.0)).alias("documented_percent"))


def entrypoint_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each project in one pass: parsed and unparsed files, comment ratio, identity backends."""
    own = _modules(spark, sf_dir)
    return own.groupBy("project_key").agg(
        F.count("*").alias("modules"), F.count_if(F.col("parse_status") == "ok").alias("parsed"), F.count_if(F.col("is_entrypoint")).alias("entrypoints"), F.countDistinct("identity_backend").alias("backends"),
        F.round(ratio(F.sum("source_comment_line_count"), F.sum("source_nonblank_line_count")), 6).alias("comment_ratio"),
    )


_R2 = lambda x: f"round(({x}) * 100) / 100"

QUERIES = {f.__name__: f for f in (
    module_hotspot_rollup, function_score_components, topk_hotspots, score_distribution, pooled_thresholds, churn_by_module, risk_totals, module_ownership, change_entropy, amplification_stats,
    confusion_by_source, flaky_users, status_pivot, killed_ratio, escape_scores, type_pressure, locality_leverage, halstead_metrics, api_documentation, entrypoint_density,
)}

_PCT = lambda q, x: f"list_sort(list({x}))[cast(ceil((count({x}) - 1) * {q}::double) as int) + 1]"
SQL = {
    "module_hotspot_rollup": f"""
with {_FUNCTIONS_SQL}, m as (
  select l_suppkey, max(score) largest, {_PCT(0.95, 'score')} p95, sum(score::decimal(30,6))::double / count(*) mean, sum(lines::decimal(20,2))::double lines from fn group by 1
), s as (select *, {_R2('0.55::double * largest + 0.25::double * p95 + 0.10::double * mean + 0.5::double * least(lines / 10, 20.0::double)')} score from m)
select l_suppkey, {_R2('largest')} largest, {_R2('p95')} p95, {_R2('mean')} mean, score, case when score >= 139.94::double then 'extreme' when score >= 95.51::double then 'high' when score >= 67.30::double then 'watch' else 'stable' end band,
       row_number() over (order by score desc, l_suppkey) - 1 as position from s""",
    "function_score_components": f"""
with {_FUNCTIONS_SQL}
select l_orderkey, l_linenumber, {_R2('score')} score, case when score >= 80.08::double then 'extreme' when score >= 32.98::double then 'high' when score >= 19.15::double then 'watch' else 'stable' end band,
  coalesce(nullif(concat_ws(',', case when branch >= 8 then 'branch pressure' end, case when nesting >= 4 then 'deep nesting' end, case when lines >= 60 then 'long function' end), ''), 'stable') signals,
  case when branch <= 0 then '0' when branch = 1 then '1' when branch <= 3 then '2-3' when branch <= 7 then '4-7' else '8+' end branch_bucket from fn""",
    "topk_hotspots": f"with {_FUNCTIONS_SQL} select l_orderkey, l_linenumber, {_R2('score')} score from (select * from fn order by score desc, l_orderkey, l_linenumber limit 10)",
    "score_distribution": f"select o_orderpriority, count(*) n_values, sum(o_totalprice::decimal(30,6))::double / count(*) mean, {', '.join(f'{_PCT(q, 'o_totalprice')} p{round(q * 100)}' for q in (0.5, 0.75, 0.9, 0.95, 0.99))}, max(o_totalprice) largest from orders group by 1",
    "pooled_thresholds": f"select count(*) n_values, {', '.join(f'{_PCT(q, 'v')} p{round(q * 100)}' for q in (0.9, 0.95, 0.99))} from (select c_acctbal v from customer union all select s_acctbal from supplier)",
    "churn_by_module": f"with {_COMMITS_SQL}, {_GIT_SQL} select * from git",
    "risk_totals": f"""
with {_COMMITS_SQL}, {_GIT_SQL},
own as (select * from (select *, row_number() over (partition by module_id order by scanned_at desc nulls last) rn from file_facts where module_id is not null) where rn = 1),
j as (select o.module_id, source_nonblank_line_count::double sloc, public_api_count::double api, function_count::double fc, coalesce(churn, 0)::double churn, coalesce(commits, 0)::double commits, coalesce(contributors, 0)::double people, coalesce(defect_commits, 0)::double defects,
  case when is_entrypoint then greatest(coalesce(cochanges, 0) - 8, 0) else coalesce(cochanges, 0) end::double ob from own o left join git g on g.module_id = o.module_id),
s as (select module_id,
  case when fc is not null and sloc is not null and api is not null then {_R2('least(fc * 2 + least(sloc * 0.12::double, 70) + least(api * 2.5::double, 30) + least(ob * 4, 35) + least(commits, greatest(35 - least(ob * 4, 35), 0)), 400)')} end maintainability,
  case when fc is not null then {_R2('least(least(churn / 12, 160) + least(commits * 2.5::double, 100) + least(people * 14, 80) + least(defects * 18, 90) + case when fc > 3 then 0 else 90 end, 520)')} end change,
  case when sloc is not null then {_R2('least(least(ob * 10, 120) + least(commits * 8, 120) + case when sloc >= 250 then 60 else 0 end, 530)')} end architectural from j)
select *, {_R2('maintainability + change + architectural')} total,
  case when maintainability + change + architectural >= 1028.20::double then 'extreme' when maintainability + change + architectural >= 838.64::double then 'high' when maintainability + change + architectural >= 712.99::double then 'watch' when maintainability + change + architectural is not null then 'stable' end band,
  concat_ws(',', case when maintainability is null then 'maintainability' end, case when change is null then 'change' end, case when architectural is null then 'architectural' end) unknown_metrics from s""",
    "module_ownership": f"""
with {_COMMITS_SQL}, e as (select module_id, author, count(*) w from (select unnest(modules) module_id, author from cm) where author is not null group by all), t as (select *, sum(w) over (partition by module_id) whole from e)
select module_id, max(whole)::bigint commits, count(*)::bigint n_members, arg_max(author, rk) as "primary", {_R2('max(w)::double / max(whole) * 100')} primary_share, round(sum((w::double / whole) * (w::double / whole)), 6) hhi, round(abs(sum(-(w::double / whole) * log2(w::double / whole))), 6) entropy
from (select *, -row_number() over (partition by module_id order by w desc, author) rk from t) group by 1""",
    "change_entropy": f"""
with {_COMMITS_SQL}, e as (select repo_key, m, coalesce(sum(churn), 0) churn from (select repo_key, unnest(modules) m, churn from cm) group by all), t as (select *, sum(churn) over (partition by repo_key) whole from e)
select repo_key, max(whole)::bigint churn, round(sum((case when whole = 0 then null when churn = 0 then 0 else -(churn::double / whole) * log2(churn::double / whole) end)::decimal(30,15))::double, 6) entropy from t group by 1""",
    "amplification_stats": f"with {_COMMITS_SQL} select repo_key, count(*) commits, {_R2('sum(n)::double / count(*)')} mean, median(n)::double as median, max(n)::bigint largest from (select repo_key, len(modules) n from cm where len(modules) > 0) group by 1",
    "confusion_by_source": """
with l as (select doc_id, toxic from (select *, row_number() over (partition by doc_id order by reviewed_at nulls first, reviewer nulls first) rn from labels) where rn = 1),
c as (select source, toxic = 1 e, regexp_matches(lower(text), '\\b(idiot|fool|moron|stupid|naked|vermin)') o from l join documents using (doc_id)),
g as (select source, count(*) labels, count(*) filter (where e and coalesce(o, false)) tp, count(*) filter (where not e and coalesce(o, false)) fp, count(*) filter (where e and not coalesce(o, false)) fn, count(*) filter (where not e and not coalesce(o, true)) tn, count(*) filter (where o is null) abstained from c group by 1)
select *, tp::double / nullif(tp + fp, 0) "precision", tp::double / nullif(tp + fn, 0) recall, (labels - abstained)::double / labels coverage, abstained::double / labels abstention from g""",
    "flaky_users": f"""
with r as (select user_id, day(ts) i, case event_type when 'error' then 'FAILED' when 'view' then 'ignored' else 'ok' end s from events),
g as (select user_id, count(*) filter (where s = 'ok') passed, count(*) filter (where s = 'FAILED') failed, count(*) filter (where s = 'ignored') ignored, 31 - count(distinct i) missing from r group by 1)
select *, {_R2('100.0::double * failed / nullif(passed + failed, 0)')} failure_rate, passed > 0 and failed > 0 flaky from g""",
    "status_pivot": f"select o_orderpriority, count(*) n_all, count(*) filter (where o_orderstatus = 'F') n_failed, count(*) filter (where o_orderstatus = 'O') n_open, count(*) filter (where o_orderstatus = 'P') n_partial, {_R2('''100.0::double * count(*) filter (where o_orderstatus = 'F') / count(*)''')} failed_percent from orders group by 1",
    "killed_ratio": f"select *, {_R2('100.0::double * killed / nullif(killed + survived, 0)')} score from (select o_custkey, count(*) filter (where o_orderstatus = 'F') killed, count(*) filter (where o_orderstatus = 'O') survived from orders group by 1)",
    "escape_scores": """
with c as (select user_id, ts::date as day, count(*) filter (where event_type = 'view') a, count(*) filter (where event_type = 'signup') b, count(*) filter (where event_type = 'error') l, count(*) filter (where event_type = 'click') k, count(*) filter (where event_type = 'purchase') t from events group by all)
select * from (select user_id, day, (a * 4 + b * 10 + case when k > 0 then 0 else l end * 2 + k * 3 + t * 12)::bigint score from c) where score > 0""",
    "type_pressure": f"""
with u as (select l_partkey, count(*) m, count(distinct l_suppkey) f, count(distinct l_orderkey) b from lineitem group by 1), j as (select p_partkey, p_size::double z, m::double m, f::double f, b::double b from part left join u on l_partkey = p_partkey)
select p_partkey, case when m is not null then {_R2('greatest(least(least(greatest(z - 8, 0) * 2.5::double, 35) + least(greatest(z / 3 - 8, 0) * 1.8::double, 28) + least(greatest(z / 2 - 10, 0) * 1.4::double, 18) + least(greatest(m - 12, 0) * 0.85::double, 32) + least(greatest(z - 30, 0) * 0.35::double, 12) + least(4.5::double * greatest(f - 2, 0) + 1.2::double * greatest(b - 4, 0), 24), 100), 0)')} end risk,
  concat_ws(',', case when z >= case when z > 40 then 8 else 16 end then 'wide-fields' end, case when m >= 20 then 'many-methods' end, case when f >= 4 then 'scattered-files' end, case when b >= 6 then 'many-blocks' end, case when z >= 45 then 'long-declaration' end) signals from j""",
    "locality_leverage": f"""
with e as (select distinct 's' || l_suppkey src, 'p' || l_partkey dst from lineitem), v as (select 's' || s_suppkey m from supplier union all select 'p' || p_partkey from part),
eo as (select src, count(*) n from e group by 1), ei as (select dst, count(*) n from e group by 1),
d as (select m, coalesce(eo.n, 0) o, coalesce(ei.n, 0) i, m like '%7' ep from v left join eo on src = m left join ei on dst = m)
select m "module", o::bigint outbound, i::bigint inbound, {_R2('least(3.0::double * greatest(o - case when ep then 8 else 5 end, 0) + 0.75::double * greatest(i - 12, 0), 100)')} locality_risk, {_R2('100 - greatest(least(68 + 2.5::double * i - case when ep then 1.5::double else 3.0::double end * o, 100), 0)')} leverage_pressure, least(i * 10.0::double, 100) reuse from d""",
    "halstead_metrics": """
with p as (select p_partkey, p_size::double n1, (p_partkey % 7)::double n2, p_size * 3.0::double m1, (p_partkey % 7) * 4.0::double m2 from part),
v as (select *, case when n1 + n2 > 0 then (m1 + m2) * log2(n1 + n2) else 0 end v, case when n2 > 0 then n1 / 2 * (m2 / n2) end d from p)
select p_partkey, round(v, 6) volume, round(d, 6) difficulty, round(d * v, 4) effort from v""",
    "api_documentation": f"""
select module_id, public_api_count - documented_public_api_count missing, case when public_api_count = 0 then 100.0::double else {_R2('100.0::double * documented_public_api_count / public_api_count')} end documented_percent
from (select *, row_number() over (partition by module_id order by scanned_at desc nulls last) rn from file_facts where module_id is not null) where rn = 1 and (public_api_count > 0 or has_crate_docs)""",
    "entrypoint_density": """
select project_key, count(*) modules, count(*) filter (where parse_status = 'ok') parsed, count(*) filter (where is_entrypoint) entrypoints, count(distinct identity_backend) backends, round(sum(source_comment_line_count)::double / nullif(sum(source_nonblank_line_count), 0), 6) comment_ratio
from (select *, row_number() over (partition by module_id order by scanned_at desc nulls last) rn from file_facts where module_id is not null) where rn = 1 group by 1""",
}
