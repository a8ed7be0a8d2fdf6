"""Gates, evidence contracts and ownership reviews as queries over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy as P
from ..operators import review as R
from ..operators.nested import SQL as NESTED_SQL
from ..operators.nested import report_table
from ..tables import last_delivery, load
from .measurements import _CHANGED_SQL, _FACTS_SQL, _TESTS_SQL, _changed, _tests, diagnostics
from .measures import _COMMITS_SQL, _R2, _modules
from .relations import _EDGES_SQL, _OWN_SQL, _module_edges

C = F.col


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each project's last snapshot."""
    own = last_delivery(load(spark, sf_dir, "policy_snapshots").filter(C("project_key").isNotNull()), ["project_key", "snapshot_no"], "delivered_at")
    last = own.groupBy(C("project_key").alias("_p")).agg(F.max("snapshot_no").alias("_n"))
    return own.join(last, (C("project_key") == C("_p")) & (C("snapshot_no") == C("_n"))).drop("_p", "_n")


_SNAP_SQL = """
ps as (select * from (select *, row_number() over (partition by project_key, snapshot_no order by delivered_at desc nulls last) rn from policy_snapshots where project_key is not null) where rn = 1),
sn as (select * from ps where snapshot_no = (select max(snapshot_no) from ps q where q.project_key = ps.project_key))"""


def _checks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Projects with their latest report, and the checks of all reports with their project."""
    raw = load(spark, sf_dir, "practices").filter(C("report_id").isNotNull())
    reports = last_delivery(raw.select("report_id", "project_key", "generated_at", "received_at"), ["report_id"], "received_at").filter(C("project_key").isNotNull())
    latest = reports.groupBy("project_key").agg(F.max(F.struct("generated_at", "report_id"))["report_id"].alias("latest"))
    checks = report_table(load(spark, sf_dir, "practices"), "checks").join(reports.select(C("report_id").alias("_r"), "project_key"), C("report_id") == C("_r")).drop("_r")
    return latest, checks


_REPORTS_SQL = f"""
rp as (select report_id, project_key, generated_at from (select *, row_number() over (partition by report_id order by received_at desc nulls last) rn from practices where report_id is not null) where rn = 1 and project_key is not null),
lt as (select project_key, report_id latest from (select *, row_number() over (partition by project_key order by generated_at desc nulls last, report_id desc) r from rp) where r = 1),
pc as ({NESTED_SQL["p4_checks"]}), ck as (select pc.*, rp.project_key from pc join rp on rp.report_id = pc.report_id),
av as (select project_key, 'rust_practices.json' artifact, case when exists (select 1 from ck where ck.report_id = latest) then 'available' else 'unreadable' end status from lt)"""


def _practice_status(latest: DataFrame, checks: DataFrame) -> DataFrame:
    seen = checks.select(C("report_id").alias("_r")).distinct()
    return latest.join(seen, C("latest") == C("_r"), "left").select("project_key", F.lit("rust_practices.json").alias("artifact"), F.when(C("_r").isNotNull(), "available").otherwise("unreadable").alias("status"))


def rule_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each project and rule, whether the absence of findings in its latest report means anything."""
    latest, checks = _checks(spark, sf_dir)
    found = diagnostics(spark, sf_dir).select(C("report_id").alias("_d"), C("rule_id")).join(latest, C("_d") == C("latest")).select("project_key", "rule_id")
    rules = checks.select("project_key", "rule_id").unionByName(found).filter(C("rule_id").isNotNull())
    contracts = checks.filter(C("rule_id").isNotNull()).select("rule_id", F.lit("rust_practices.json").alias("artifact"), F.lit(True).alias("by_check")).distinct()
    own = checks.join(latest.select(C("latest").alias("_l")), C("report_id") == C("_l"), "left_semi").filter(C("rule_id").isNotNull()).select("project_key", "rule_id", "status")
    return P.rule_availability(rules, contracts, _practice_status(latest, checks), own, ["project_key"])


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of four artifacts by project: a section that wasn't evaluated is partial, an empty one stale."""
    state = lambda c: F.when(C(c).isNull(), "partial").when(F.size(c) == 0, "stale").otherwise("available")
    snaps = _snapshots(spark, sf_dir)
    parts = F.explode(F.array(*(F.struct(F.lit(a).alias("artifact"), state(c).alias("status")) for a, c in (("map.json", "score_deltas"), ("coverage.json", "evidence_deltas"), ("performance.json", "regressions")))))
    return snaps.select("project_key", parts.alias("s")).select("project_key", "s.*").unionByName(_practice_status(*_checks(spark, sf_dir)))


_STATUS_SQL = """
st as (select project_key, 'map.json' artifact, case when score_deltas is null then 'partial' when len(score_deltas) = 0 then 'stale' else 'available' end status from sn
  union all select project_key, 'coverage.json', case when evidence_deltas is null then 'partial' when len(evidence_deltas) = 0 then 'stale' else 'available' end from sn
  union all select project_key, 'performance.json', case when regressions is null then 'partial' when len(regressions) = 0 then 'stale' else 'available' end from sn
  union all select * from av)"""


def required_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that the policies need and that a project doesn't have available."""
    return P.required_failures(_status(spark, sf_dir), ["threshold", "regression", "practice-failure", "test-failure"], True, ["project_key"])


def input_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of each project's result from the statuses of its inputs."""
    found = P.merged_confidence(_status(spark, sf_dir), ["map.json", "rust_practices.json"], ["project_key"])
    return found.select("project_key", "complete", *(F.array_join(c, ",").alias(c) for c in ("missing_input", "stale_input", "unsupported_pattern")))


def evidence_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and benchmark records of each project's last snapshot, judged again."""
    each = _snapshots(spark, sf_dir).select("project_key", F.explode("evidence_deltas").alias("e")).select("project_key", "e.metric", "e.benchmark", C("e.baseline_value").alias("baseline"), C("e.current_value").alias("current"), C("e.status").alias("direction"))
    return P.evidence_regressions(each, 1.0, 10.0).select("project_key", "metric", "benchmark", "change", "verdict")


def report_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score records of last snapshots whose direction isn't what their numbers say."""
    each = _snapshots(spark, sf_dir).select("project_key", F.explode("score_deltas").alias("r")).select("project_key", "r.*").distinct()
    each = each.withColumn("k", F.to_json(F.struct("project_key", "module", "baseline_score", "current_score", "delta", "direction", "new_module")))
    delta = C("current_score") - C("baseline_score")
    direction = F.when(C("new_module"), "new").when(delta > 0, "regressed").when(delta < 0, "improved").when(delta.isNotNull(), "unchanged")
    wrong = P.disagreements(each.select("k", "direction"), each.select("k", direction.alias("direction")), "k", ["direction"])
    return each.join(wrong, "k", "left_semi").groupBy("project_key", "direction").agg(F.count("*").alias("n_records"))


def waivable_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by whether a waiver could cover them."""
    return _checks(spark, sf_dir)[1].groupBy("project_key").agg(F.count_if(P.waivable(C("status"))).alias("waivable"), F.count_if(~P.waivable(C("status"))).alias("not_waivable"))


def identity_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges of each project lead to an authored, parsed file."""
    files = _modules(spark, sf_dir)
    edges = _module_edges(spark, sf_dir).join(files.select(C("module_id").alias("_s"), "project_key"), C("src") == C("_s"))
    rows = edges.join(files.select(C("module_id").alias("_d"), "path"), C("dst") == C("_d"), "left").select("project_key", "src", "dst", "path", F.lit(0).alias("position"))
    found = R.best_definition(rows, ["project_key", "src", "dst"], files.filter(C("parse_status") == "ok").select("path", "module_id"), ["crates", "src", "tests"], "target")
    return P.identity_confidence(found, ["project_key"])


def _behaviors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Modules outside tests as behaviours, and the tests of modules that depend on them as their owners."""
    own = _modules(spark, sf_dir).filter(~(F.coalesce("target_kind", F.lit("")) == "test")).select(C("module_id").alias("behavior"), (F.coalesce("public_api_count", F.lit(0)) > 0).alias("required"))
    owners = _tests(spark, sf_dir).select(F.explode("tested_module_ids").alias("behavior"), C("package_name").alias("package"), C("target_name").alias("target"), "path", C("qualified_name").alias("name"))
    return own, owners


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, owners = _behaviors(spark, sf_dir)
    tests = _tests(spark, sf_dir).select(C("package_name").alias("package"), C("target_name").alias("target"), "path", C("qualified_name").alias("name"), "last_status")
    observed = P.selector_statuses(owners, tests.drop("last_status"), tests)
    return P.owner_statuses(own, observed, F.lit("passed"))


def owner_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tests that own each module's behaviour are observed to pass."""
    return _reviewed(spark, sf_dir).select("behavior", "required", "status")


def owner_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.owner_findings(_reviewed(spark, sf_dir)).groupBy("rule_id", "reason").agg(F.count("*").alias("n_behaviors"))


def _experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _tests(spark, sf_dir)
    injected = F.when(C("last_status") == "failed", "assertion_failed").when(C("last_status") == "passed", "passed").when(C("last_status").isNull(), "not_run").otherwise("timed_out")
    return tests.select(F.explode("tested_module_ids").alias("behavior"), F.lit("passed").alias("baseline"), injected.alias("injected"), F.when(C("assertion_count") > 0, "passed").otherwise("inconclusive").alias("restored"))


def fault_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests as fault experiments on the modules they reach, by class."""
    return P.fault_classes(_experiments(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n_experiments"))


def undetected_behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with public items for which no experiment reports a detected fault."""
    return P.undetected(_behaviors(spark, sf_dir)[0], _experiments(spark, sf_dir)).select("behavior")


def changed_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _modules(spark, sf_dir).select("path", "module_key", "target_kind", "entrypoint_kind", "is_entrypoint")
    test = F.coalesce("target_kind", F.lit("")) == "test"
    return P.changed_entrypoints(own.filter(~test), own.filter(test), _changed(spark, sf_dir))


def nested_finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of findings inside one JSON document a report: checks that hold their diagnostics."""
    d = diagnostics(spark, sf_dir)
    name = lambda *c: F.concat_ws("-", *(C(x).cast("string") for x in c))
    inner = d.groupBy("report_id", "check_no").agg(F.collect_list(F.struct("rule_id", name("report_id", "check_no", "diagnostic_no").alias("id"), F.struct(F.lit("x").alias("id")).alias("inner"))).alias("found"))  # those of one check
    docs = inner.groupBy("report_id").agg(F.to_json(F.collect_list(F.struct(F.lit("check").alias("rule_id"), name("report_id", "check_no").alias("id"), F.struct("found").alias("data")))).alias("doc"))
    return P.nested_finding_ids(docs, "report_id", "doc")


def evidence_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the tagged evidence union made from diagnostics and snapshots, by kind and validity."""
    texts, one = "array<string>", F.lit(1.0)
    empty = {"schema_version": one, "rule_id": F.lit(None).cast("string"), "locations": F.lit(None).cast("array<struct<file: string, line: double>>"), "value": F.lit(None).cast("double"), "limitations": F.lit(None).cast(texts), "uncertainty": F.lit(None).cast("struct<lower: double, upper: double>"), "status": F.lit(None).cast("string"), "baseline_run": F.lit(None).cast("string"), "reasons": F.lit(None).cast(texts)}

    def record(kind: str, **fields):
        return F.struct(F.lit(kind).alias("kind"), *((fields.get(n, c)).alias(n) for n, c in empty.items())).alias("e")

    found = diagnostics(spark, sf_dir).select(record("finding", rule_id=C("rule_id"), locations=F.array(F.struct(C("path").alias("file"), C("line").cast("double").alias("line")))))
    deltas = _snapshots(spark, sf_dir).select(F.explode("evidence_deltas").alias("d")).select("d.*")
    measured = deltas.select(record("measurement", value=C("current_value"), limitations=F.array_compact(F.array("reason")), uncertainty=F.when(C("baseline_value").isNotNull(), F.struct(C("baseline_value").alias("lower"), C("current_value").alias("upper")))))
    compared = deltas.select(record("comparison", status=F.when(C("status") == "incomparable", "incompatible").otherwise("compatible"), baseline_run=F.when(C("baseline_value").isNotNull(), C("benchmark")), reasons=F.array_compact(F.array("reason"))))
    rows = found.unionByName(measured).unionByName(compared)
    return rows.groupBy(C("e.kind").alias("kind")).agg(F.count("*").alias("n_records"), F.count_if(P.valid_wire(C("e"))).alias("n_valid"))


def capability_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks as capability records, by status and whether they keep the contract."""
    checks = _checks(spark, sf_dir)[1]
    status = F.when(C("status") == "passed", "completed").when(C("status") == "failed", "partial").when(C("status") == "timed-out", "failed").otherwise(C("status"))
    e = F.struct(F.lit(1).alias("schema_version"), C("rule_id").alias("capability"), C("project_key").alias("scope"), status.alias("status"), (C("metrics").isNotNull()).cast("bigint").alias("evaluated"), (C("status") != "passed").cast("bigint").alias("skipped"), F.array_compact(F.array(F.when(C("status") != "passed", C("title")))).alias("reasons"))
    return checks.select(status.alias("status"), P.valid_capability(e).alias("ok")).groupBy("status").agg(F.count("*").alias("n_records"), F.count_if("ok").alias("n_valid"))


QUERIES = {f.__name__: f for f in (
    rule_availability, required_inputs, input_confidence, evidence_regressions, report_disagreements, waivable_checks, identity_confidence, owner_statuses, owner_findings, fault_classes,
    undetected_behaviors, changed_entrypoints, nested_finding_ids, evidence_validity, capability_validity,
)}

_DIAG_SQL = f"dg as ({NESTED_SQL['p4_diagnostics']})"
_OWNER_SQL = """
bh as (select module_id behavior, coalesce(public_api_count, 0) > 0 required from own where coalesce(target_kind, '') <> 'test'), se as (select dst behavior, last_status s, assertion_count from tst join ed on src = own_id),
ob as (select behavior, bool_or(s = 'failed') f, bool_and(coalesce(s, '') = 'passed') p from se group by 1),
os as (select bh.behavior, required, case when ob.behavior is null then 'unresolved' when f then 'observed_failure' when p then 'observed_pass' else 'unknown' end status from bh left join ob on ob.behavior = bh.behavior),
ex as (select behavior, case when s is null then 'not_run' when assertion_count = 0 then 'inconclusive' when s = 'failed' then 'reported_detected' when s = 'passed' then 'survived' else 'inconclusive' end k from se)"""
_EV_SQL = "ev as (select project_key, unnest(evidence_deltas) e from sn)"
SQL = {
    "rule_availability": f"""
with {_REPORTS_SQL}, {_DIAG_SQL}, ru as (select project_key, rule_id from ck where rule_id is not null union select project_key, rule_id from dg join lt on latest = report_id where rule_id is not null),
ct as (select distinct rule_id from ck where rule_id is not null), cs as (select ck.project_key, rule_id, count(*) filter (where not coalesce(status in ('passed', 'failed'), false)) odd from ck join lt on latest = report_id where rule_id is not null group by all)
select ru.project_key, ru.rule_id, case when ct.rule_id is not null then 'rust_practices.json' end artifact,
  case when ct.rule_id is null then 'no evaluation coverage' when coalesce(av.status, 'missing') <> 'available' then 'rust_practices.json: ' || coalesce(av.status, 'missing') when odd is null or odd > 0 then 'check is absent or its status unknown' end reason
from ru left join ct on ct.rule_id = ru.rule_id left join av on av.project_key = ru.project_key left join cs on cs.project_key = ru.project_key and cs.rule_id = ru.rule_id""",
    "required_inputs": f"""
with {_SNAP_SQL}, {_REPORTS_SQL}, {_STATUS_SQL}, w(policy, artifact, opt) as (values ('threshold', 'map.json', false), ('regression', 'map.json', false), ('practice-failure', 'rust_practices.json', false), ('test-failure', 'correctness_review.json', false), ('regression', 'coverage.json', true), ('regression', 'performance.json', true)),
j as (select p.project_key, policy, w.artifact, coalesce(status, 'missing') status, opt from (select distinct project_key from st) p cross join w left join st on st.project_key = p.project_key and st.artifact = w.artifact)
select project_key, policy, artifact, status from j where status <> 'available' and not (opt and status = 'missing')""",
    "input_confidence": f"""
with {_SNAP_SQL}, {_REPORTS_SQL}, {_STATUS_SQL}, g as (select project_key, coalesce(string_agg(artifact, ',' order by artifact) filter (where artifact in ('map.json', 'rust_practices.json') and status in ('missing', 'incompatible', 'unreadable')), '') missing_input,
  coalesce(string_agg(artifact, ',' order by artifact) filter (where status = 'stale'), '') stale_input, coalesce(string_agg(artifact, ',' order by artifact) filter (where artifact in ('map.json', 'rust_practices.json') and status = 'partial'), '') unsupported_pattern from st group by 1)
select *, missing_input = '' and stale_input = '' and unsupported_pattern = '' complete from g""",
    "evidence_regressions": f"""
with {_SNAP_SQL}, {_EV_SQL}, r as (select project_key, e.metric metric, e.benchmark benchmark, e.status s, e.metric = 'line_coverage_percent' cov, e.baseline_value b, e.current_value c from ev),
d as (select *, case when cov then {_R2('b - c')} else {_R2('100.0::double * (c - b) / nullif(b, 0)')} end "change" from r)
select project_key, metric, benchmark, "change", case when b is null or c is null then 'incomparable' when cov then case when "change" > 1.0 then 'regressed' when "change" < 0 then 'improved' else 'unchanged' end
  when s = 'regressed' and "change" > 10.0 then 'regressed' when s = 'improved' then 'improved' when s in ('regressed', 'within_noise', 'unchanged') then 'unchanged' else 'incomparable' end verdict from d""",
    "report_disagreements": f"""
with {_SNAP_SQL}, r as (select distinct project_key, unnest(score_deltas) r from sn), d as (select project_key, r.direction direction, case when r.new_module then 'new' when r.current_score - r.baseline_score > 0 then 'regressed' when r.current_score - r.baseline_score < 0 then 'improved' when r.current_score - r.baseline_score is not null then 'unchanged' end derived from r)
select project_key, direction, count(*) n_records from d where direction is distinct from derived group by all""",
    "waivable_checks": f"with {_REPORTS_SQL} select project_key, count(*) filter (where not w) waivable, count(*) filter (where w) not_waivable from (select project_key, coalesce(status in ('unavailable', 'timed-out', 'failed_execution', 'incomplete'), false) w from ck) group by 1",
    "identity_confidence": f"""
with {_OWN_SQL}, {_EDGES_SQL}, j as (select distinct a.project_key, src, dst, b.path, b.path in (select path from own where parse_status = 'ok') ok from ed join own a on a.module_id = src left join own b on b.module_id = dst),
k as (select project_key, coalesce(ok, false) or not (path is null or path like 'target/%' or path like 'crates/%' or path like 'src/%' or path like 'tests/%') res from j)
select project_key, count(*) reference_count, count(*) filter (where res) resolved_count, {_R2('100.0::double * count(*) filter (where res) / count(*)')} resolution_percent, bool_and(res) complete from k group by 1""",
    "owner_statuses": f"with {_FACTS_SQL}, {_EDGES_SQL}, {_TESTS_SQL}, {_OWNER_SQL} select * from os",
    "owner_findings": f"""
with {_FACTS_SQL}, {_EDGES_SQL}, {_TESTS_SQL}, {_OWNER_SQL}
select 'rust.testing.owner-review' rule_id, case status when 'unresolved' then 'no owner resolves' when 'observed_failure' then 'the owner failed' else 'execution is unknown' end reason, count(*) n_behaviors from os where required and status <> 'observed_pass' group by all""",
    "fault_classes": f"with {_FACTS_SQL}, {_EDGES_SQL}, {_TESTS_SQL}, {_OWNER_SQL} select k as class, count(*) n_experiments from ex group by 1",
    "undetected_behaviors": f"with {_FACTS_SQL}, {_EDGES_SQL}, {_TESTS_SQL}, {_OWNER_SQL} select behavior from bh where required and behavior not in (select behavior from ex where k = 'reported_detected')",
    "changed_entrypoints": f"""
with {_OWN_SQL}, {_COMMITS_SQL}, {_CHANGED_SQL}, r as (select path, module_key, target_kind, entrypoint_kind, row_number() over (partition by path order by (coalesce(target_kind, '') = 'test')::int, module_key) k from own where is_entrypoint and path in (select path from chg))
select path, module_key, target_kind, entrypoint_kind from r where k = 1 and entrypoint_kind is not null""",
    "nested_finding_ids": f"with {_DIAG_SQL} select report_id, concat_ws('-', report_id, check_no, diagnostic_no) finding_id from dg where rule_id is not null union select report_id, concat_ws('-', report_id, check_no) from dg",
    "evidence_validity": f"""
with {_SNAP_SQL}, {_EV_SQL}, {_DIAG_SQL}, v as (
  select 'finding' kind, coalesce(regexp_matches(rule_id, '[./:]') and line >= 1 and trim(path) <> '', false) ok from dg
  union all select 'measurement', (e.current_value is not null or trim(e.reason) <> '') and (e.baseline_value is null or coalesce(e.baseline_value <= e.current_value, false)) from ev
  union all select 'comparison', case when e.status is distinct from 'incomparable' then coalesce(e.baseline_value is not null and trim(e.benchmark) <> '', false) and e.reason is null else e.reason is not null end from ev)
select kind, count(*) n_records, count(*) filter (where ok) n_valid from v group by 1""",
    "capability_validity": f"""
with {_REPORTS_SQL}, c as (select case status when 'passed' then 'completed' when 'failed' then 'partial' when 'timed-out' then 'failed' else status end s, rule_id, title, metrics is not null m from ck)
select s status, count(*) n_records, count(*) filter (where trim(rule_id) <> '' and s in ('completed', 'partial', 'unavailable', 'failed', 'skipped') and (s = 'completed' or trim(title) <> '') and (s in ('completed', 'partial') or not m)) n_valid from c group by 1""",
}
