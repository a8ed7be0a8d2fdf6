"""Evidence, freshness and gates as queries over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round2
from ..operators import evidence as E
from ..operators.sets import is_disjoint, is_subset, sorted_set
from ..operators.stats import exact_sum
from ..tables import load
from .measures import _R2, _commits, _COMMITS_SQL

WAIVERS = [
    {"rule_id": "click", "path": "u/1/**", "expires": "2030-01-01"},
    {"rule_id": "click", "path": "u/1/**", "expires": "2031-01-01"},
    {"rule_id": "error", "expires": "2020-01-01"},
    {"rule_id": "error", "path": "u/2/3", "expires": "2030-01-01"},
    {"rule_id": "view", "path": "u/3/**", "expires": "soon"},
]
RULES = [
    {"rule_id": "click", "level": "error", "max": 10, "exclude_paths": ["u/1/**"]},
    {"rule_id": "error", "level": "warning", "max": 10**6},
    {"rule_id": "view", "level": "off"},
    {"rule_id": "purchase", "level": "error", "max": 0, "available": False},
    {"rule_id": "never", "level": "error", "max": 0},
]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as findings: the rule is the type, the path comes from the user."""
    return load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule_id"), F.concat(F.lit("u/"), F.col("user_id") % 4, F.lit("/"), F.col("user_id") % 10).alias("path"))


def waiver_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.apply_waivers(_findings(spark, sf_dir), WAIVERS, "2025-01-01")
    return found.groupBy("rule_id", "bucket", "waiver").agg(F.count("*").alias("n"))


def rule_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rule_limits(_findings(spark, sf_dir), RULES)


def threshold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose score exceeds 400; a supplier without items has an unknown score."""
    n = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("_s")).agg(exact_sum(F.col("l_quantity"), 2).alias("q"))
    s = load(spark, sf_dir, "supplier").join(n, F.col("s_suppkey") == F.col("_s"), "left")
    return E.threshold_violations(s.select("s_suppkey", round2(F.col("q") / 40).alias("score")), "s_suppkey", "score", 400.0)


def freshness_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of each user's last event against an anchor, with its age in hours and the exact expiry."""
    last = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max("value").isNotNull().alias("whole"), F.count("*").alias("n"))
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return last.select("user_id", E.freshness(F.col("n") % 2, F.lit(0), F.col("whole"), F.col("n") > 3).alias("freshness"), E.age_hours(F.col("ts"), now).alias("age_hours"), E.expired(F.col("ts"), now, 24).alias("expired"))


def confidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of each source's reviews: missing and unsupported inputs make it partial."""
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d")).distinct(), F.col("doc_id") == F.col("_d"), "left")
    per = docs.groupBy("source").agg(F.count("*").alias("required"), F.count("_d").alias("observed"), F.count_if(F.col("text").isNull()).alias("nulls"), F.count_if(F.col("lang").isNull()).alias("langless"))
    reasons = F.array_compact(F.array(F.when(F.col("observed") < F.col("required"), F.lit("labels")), F.when(F.col("nulls") > 0, F.lit("text"))))
    odd = F.array_compact(F.array(F.when(F.col("langless") > 0, F.lit("lang"))))
    c = E.confidence(F.col("required"), F.col("observed"), reasons, odd)
    c = F.when(F.col("langless") > 5, E.mark_partial(c, F.lit("review"))).otherwise(c)
    return per.select("source", c.alias("c")).select("source", "c.complete", "c.partial", "c.required_inputs", "c.observed_inputs", F.array_join("c.missing_input", ",").alias("missing_input"), F.array_join("c.unsupported_pattern", ",").alias("unsupported_pattern"))


def artifact_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as artifacts: the six-way status by first failing condition."""
    f = load(spark, sf_dir, "file_facts")
    s = E.artifact_status(F.col("path").isNotNull(), F.col("parse_status").isin("ok", "recovered"), F.col("syntax_backend").isNotNull(), F.col("source_metrics_available"), F.col("has_crate_docs").isNotNull(), F.col("target_kind").isNotNull())
    return f.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


def json_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number among several fields of a JSON text, summed by event type."""
    first = F.coalesce(*(F.get_json_object("props", p).try_cast("double") for p in ("$.score", "$.k", "$.v")))
    return load(spark, sf_dir, "events").select("event_type", first.alias("m")).groupBy("event_type").agg(F.count("m").alias("n"), exact_sum(F.col("m")).alias("total"))


def diagnostic_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of equal payload: how often, by how many users, and the first. Payloads are hashed before the shuffle."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.md5(F.to_json(F.struct("event_type", "props"))).alias("payload"), "event_type", "props")
    return e.groupBy("payload").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("event_id").alias("first_event"), F.first("event_type").alias("event_type")).drop("payload")


def module_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set tests on each commit's modules against its repository's most common ones."""
    own = _commits(spark, sf_dir).filter(F.size("modules") > 0)
    top = own.select("repo_key", F.explode("modules").alias("m")).groupBy("repo_key", "m").agg(F.count("*").alias("n")).groupBy(F.col("repo_key").alias("_r")).agg(F.max_by("m", F.struct("n", "m")).alias("top"))
    joined = own.join(top, F.col("repo_key") == F.col("_r"))
    one = F.array("top")
    return joined.groupBy("repo_key").agg(F.count_if(is_subset(F.col("modules"), one)).alias("only_top"), F.count_if(is_disjoint(F.col("modules"), one)).alias("without_top"), F.max(F.size(sorted_set(F.col("modules")))).cast("bigint").alias("largest"))


QUERIES = {f.__name__: f for f in (waiver_split, rule_limits, threshold_violations, freshness_by_user, confidence_rollup, artifact_statuses, json_metric, diagnostic_payloads, module_sets)}

_FINDINGS_SQL = "fi as (select event_id, event_type rule_id, 'u/' || (user_id % 4) || '/' || (user_id % 10) path from events)"
SQL = {
    "waiver_split": f"""
with {_FINDINGS_SQL}, w as (select rule_id, case when rule_id = 'click' and path like 'u/1/%' then 0 when rule_id = 'error' and path = 'u/2/3' then 3 end waiver from fi)
select rule_id, case when waiver is null then 'active' else 'waived' end bucket, waiver, count(*) n from w group by all""",
    "rule_limits": f"""
with {_FINDINGS_SQL}, c as (select rule_id, count(*) filter (where rule_id = 'click' and path like 'u/1/%') o, count(*) n from fi group by 1), r as (select * from (values ('click', 'error', 10, true), ('error', 'warning', 1000000, true), ('view', 'off', 0, true), ('purchase', 'error', 0, false), ('never', 'error', 0, true)) t(rule_id, level, mx, av)),
j as (select r.*, coalesce(o, 0) o, case when av and level <> 'off' then coalesce(n - o, 0) end ob from r left join c using (rule_id))
select rule_id, level, ob observed, o excluded, case when ob is null then 0 else greatest(ob - mx, 0) end excess, case when level = 'off' then 'disabled' when not av then 'incomplete' when ob > mx then 'exceeded' else 'passed' end status from j""",
    "threshold_violations": f"""
with q as (select l_suppkey, sum(l_quantity::decimal(30,2))::double q from lineitem group by 1), s as (select s_suppkey, {_R2('q / 40')} score from supplier left join q on l_suppkey = s_suppkey)
select s_suppkey, score, case when score is null then 'unknown' else 'violation' end outcome from s where score is null or score > 400""",
    "freshness_by_user": """
with l as (select user_id, max(ts) ts, max(value) is not null whole, count(*) n from events group by 1)
select user_id, case when not (whole and n > 3) then 'incomplete' when n % 2 <> 0 then 'stale' else 'current' end freshness,
  case when epoch(timestamp '2024-01-30') - epoch(date_trunc('second', ts)) >= -300 then floor(greatest(epoch(timestamp '2024-01-30') - epoch(date_trunc('second', ts)), 0) / 3600)::bigint end age_hours, timestamp '2024-01-30' - ts > interval 24 hours expired from l""",
    "confidence_rollup": """
with p as (select source, count(*) r, count(l.doc_id) o, count(*) filter (where text is null) nu, count(*) filter (where lang is null) la from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id group by 1),
m as (select *, concat_ws(',', case when o < r then 'labels' end, case when nu > 0 then 'text' end, case when la > 5 then 'review' end) mi, case when la > 0 then 'lang' else '' end un from p)
select source, mi = '' and un = '' complete, not (mi = '' and un = '') partial, r required_inputs, o observed_inputs, mi missing_input, un unsupported_pattern from m""",
    "artifact_statuses": """
select case when path is null then 'missing' when not coalesce(parse_status in ('ok', 'recovered'), false) then 'unreadable' when syntax_backend is null then 'incompatible' when not coalesce(source_metrics_available, false) then 'stale' when has_crate_docs is null or target_kind is null then 'partial' else 'available' end status, count(*) n from file_facts group by 1""",
    "json_metric": "select event_type, count(m) n, sum(m::decimal(30,6))::double total from (select event_type, coalesce(try_cast(props ->> '$.score' as double), try_cast(props ->> '$.k' as double), try_cast(props ->> '$.v' as double)) m from events) group by 1",
    "diagnostic_payloads": "select count(*) n, count(distinct user_id) users, min(event_id) first_event, any_value(event_type) event_type from events group by events.event_type, props",
    "module_sets": f"""
with {_COMMITS_SQL}, c as (select repo_key, hash, modules from cm where len(modules) > 0), t as (select repo_key, m from (select repo_key, m, row_number() over (partition by repo_key order by count(*) desc, m desc) r from (select repo_key, unnest(modules) m from c) group by repo_key, m) where r = 1)
select c.repo_key, count(*) filter (where modules = [m]) only_top, count(*) filter (where not list_contains(modules, m)) without_top, max(len(modules))::bigint largest from c join t on t.repo_key = c.repo_key group by 1""",
}
