"""Gates over statuses and findings, validity of evidence records, and reviews of test ownership.

Statuses, contracts, behaviours and selectors are tables; several projects are judged at
once by the key columns in ``scope``. Unknown never passes for negative.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import percent, round2
from .joins import null_safe

C = F.col

# Artifacts that each policy needs, and statuses that can't be waived.
REQUIRED = {
    "test-failure": ["correctness_review.json"], "practice-failure": ["rust_practices.json"], "reliability-finding": ["reliability_findings.json"],
    "operational-failure": ["operational_evidence.json"], "threshold": ["map.json"], "regression": ["map.json"],
}
REGRESSION_INPUTS = ["coverage.json", "performance.json"]
NOT_WAIVABLE = ["unavailable", "timed-out", "failed_execution", "incomplete"]
LARGEST_COUNT = 9007199254740991


def waivable(status: Column) -> Column:
    """Whether a waiver may cover a finding; one that only says that nothing was measured can't be waived."""
    return ~F.coalesce(status.isin(NOT_WAIVABLE), F.lit(False))


def required_failures(status: DataFrame, policies: Sequence[str], baseline: bool, scope: Sequence[str] = (), every: Sequence[str] = ()) -> DataFrame:
    """scope, policy, artifact, status of each input that a policy needs and doesn't have available.

    ``status``: scope, artifact, status; an artifact without a row is missing. ``partial``
    needs ``every`` artifact. regression also needs coverage and benchmarks as soon as
    they exist, and a baseline.
    """
    needs = [(p, a, False) for p in policies for a in (every if p == "partial" else REQUIRED[p])]
    needs += [("regression", a, True) for a in REGRESSION_INPUTS if "regression" in policies]
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(a).alias("artifact"), F.lit(o).alias("optional")) for p, a, o in needs)))  # a few lines of configuration
    places = status.select(*scope).distinct() if scope else status.sparkSession.range(1).select()
    asked = places.select(*scope, wanted.alias("_w")).select(*scope, "_w.*")
    have = status.select(*(C(k).alias(f"_s_{k}") for k in scope), C("artifact").alias("_a"), C("status").alias("_status"))
    on = null_safe([(k, f"_s_{k}") for k in scope]) & (C("artifact") == C("_a"))
    state = F.coalesce("_status", F.lit("missing"))
    failed = asked.join(have, on, "left").select(*scope, "policy", "artifact", state.alias("status"), "optional").filter((C("status") != "available") & ~(C("optional") & (C("status") == "missing"))).drop("optional")
    if "regression" in policies and not baseline:
        failed = failed.unionByName(places.select(*scope, F.lit("regression").alias("policy"), F.lit("baseline").alias("artifact"), F.lit("missing").alias("status")))
    return failed


def rule_availability(rules: DataFrame, contracts: DataFrame, status: DataFrame, checks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """scope, rule_id, artifact and why the absence of findings says nothing (null: it does say that there are none).

    ``rules``: scope, rule_id; ``contracts``: rule_id, artifact, by_check (whether a check
    of the rule's own must have passed or failed); ``status``: scope, artifact, status;
    ``checks``: scope, rule_id, status.
    """
    known = contracts.select(C("rule_id").alias("_r"), "artifact", "by_check").dropDuplicates(["_r"])
    rows = rules.select(*scope, "rule_id").distinct().join(known, C("rule_id") == C("_r"), "left").drop("_r")
    have = status.select(*(C(k).alias(f"_s_{k}") for k in scope), C("artifact").alias("_a"), C("status").alias("_status"))
    rows = rows.join(have, null_safe([(k, f"_s_{k}") for k in scope]) & (C("artifact") == C("_a")), "left").drop("_a", *(f"_s_{k}" for k in scope))
    odd = F.count_if(~F.coalesce(C("status").isin("passed", "failed"), F.lit(False)))
    seen = checks.groupBy(*(C(k).alias(f"_c_{k}") for k in scope), C("rule_id").alias("_c_rule")).agg(odd.alias("_odd"))
    rows = rows.join(seen, null_safe([(k, f"_c_{k}") for k in scope]) & (C("rule_id") == C("_c_rule")), "left")
    state = F.coalesce("_status", F.lit("missing"))
    reason = F.when(C("artifact").isNull(), "no evaluation coverage").when(state != "available", F.concat("artifact", F.lit(": "), state)).when(C("by_check") & (C("_odd").isNull() | (C("_odd") > 0)), "check is absent or its status unknown")
    return rows.select(*scope, "rule_id", "artifact", reason.alias("reason"))


def evidence_regressions(pairs: DataFrame, most_decrease: float, most_increase: float) -> DataFrame:
    """Coverage and benchmark changes with their size and status.

    ``pairs``: metric (line_coverage_percent or benchmark_estimate_percent), baseline,
    current, direction (of benchmarks, by intervals). Coverage regresses when it falls by
    more than allowed; a benchmark when its intervals say so and it grew by more than
    allowed. A missing side or an unknown direction is incomparable.
    """
    coverage = C("metric") == "line_coverage_percent"
    fall, growth = round2(C("baseline") - C("current")), round2(percent(C("current") - C("baseline"), C("baseline"), None))
    known = C("baseline").isNotNull() & C("current").isNotNull()
    of_coverage = F.when(~known, "incomparable").when(fall > most_decrease, "regressed").when(fall < 0, "improved").otherwise("unchanged")
    of_benchmark = F.when(~known, "incomparable").when((C("direction") == "regressed") & (growth > most_increase), "regressed").when(C("direction") == "improved", "improved").when(C("direction").isin("regressed", "within_noise", "unchanged"), "unchanged").otherwise("incomparable")
    return pairs.withColumns({"change": F.when(coverage, fall).otherwise(growth), "verdict": F.when(coverage, of_coverage).otherwise(of_benchmark)})


def _told(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def valid_capability(e: Column) -> Column:
    """Whether a capability record (schema_version, capability, scope, status, evaluated, skipped, reasons) keeps its contract.

    completed has nothing skipped and no reasons; any other status has reasons; only
    completed and partial may have evaluated anything.
    """
    texts = F.coalesce(F.forall(e["reasons"], _told), F.lit(False))
    n = F.size(e["reasons"])
    counts = (e["evaluated"] >= 0) & (e["evaluated"] <= LARGEST_COUNT) & (e["skipped"] >= 0) & (e["skipped"] <= LARGEST_COUNT)
    done = F.when(e["status"] == "completed", (e["skipped"] == 0) & (n == 0)).otherwise(n > 0)
    known = e["status"].isin("completed", "partial", "unavailable", "failed", "skipped")
    return F.coalesce((e["schema_version"] == 1) & _told(e["capability"]) & _told(e["scope"]) & known & texts & counts & done & (e["status"].isin("completed", "partial") | (e["evaluated"] == 0)), F.lit(False))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid_measurement(m: Column) -> Column:
    """A finite value, or none with a limitation; an interval only beside a value, finite and in order."""
    observed = _finite(m["value"])
    limits = F.size(F.filter(m["limitations"], _told)) > 0
    span = m["uncertainty"]
    ordered = F.when(span.isNull(), True).otherwise(observed & _finite(span["lower"]) & _finite(span["upper"]) & (span["lower"] <= span["upper"]))
    return F.coalesce((observed | (m["value"].isNull() & limits)) & ordered, F.lit(False))


def valid_wire(e: Column) -> Column:
    """Whether a record of the tagged union (kind: run, finding, measurement, comparison) keeps the rules of its variant.

    A finding's rule id has a separator and its lines are whole numbers from 1; a
    compatible comparison has a baseline run and no reasons, any other has reasons.
    """
    line = lambda x: (x["line"] >= 1) & (x["line"] <= LARGEST_COUNT) & (x["line"] == F.floor(x["line"]))
    finding = e["rule_id"].rlike("[./:]") & F.coalesce(F.forall(e["locations"], lambda x: F.coalesce(line(x) & _told(x["file"]), F.lit(False))), F.lit(False))
    reasons = F.coalesce(F.size(e["reasons"]) > 0, F.lit(False))
    comparison = F.when(e["status"] == "compatible", _told(e["baseline_run"]) & ~reasons).otherwise(e["status"].isin("incompatible", "unknown") & reasons)
    body = F.when(e["kind"] == "run", True).when(e["kind"] == "finding", finding).when(e["kind"] == "measurement", valid_measurement(e)).when(e["kind"] == "comparison", comparison)
    return F.coalesce((e["schema_version"] == 1) & body, F.lit(False))


def identity_confidence(references: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """References and resolved ones of each scope, their percentage, and whether identities are complete.

    ``references``: scope, status; statuses that begin with resolved_ are resolved. Without
    references everything is resolved.
    """
    n, k = F.count("*"), F.count_if(C("status").startswith("resolved_"))
    return references.groupBy(*scope).agg(n.alias("reference_count"), k.alias("resolved_count")).withColumns({"resolution_percent": round2(percent(C("resolved_count"), C("reference_count"), 100.0)), "complete": C("resolved_count") == C("reference_count")})


def merged_confidence(status: DataFrame, required: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """complete, missing_input, stale_input and unsupported_pattern of a result from the statuses of its inputs.

    Required inputs that are missing, incompatible or unreadable are missing; stale ones
    count whether required or not; partial ones only if required.
    """
    need = C("artifact").isin(list(required))
    named = lambda cond: F.array_sort(F.collect_set(F.when(cond, C("artifact"))))
    found = status.groupBy(*scope).agg(named(need & C("status").isin("missing", "incompatible", "unreadable")).alias("missing_input"), named(C("status") == "stale").alias("stale_input"), named(need & (C("status") == "partial")).alias("unsupported_pattern"))
    return found.withColumn("complete", (F.size("missing_input") == 0) & (F.size("stale_input") == 0) & (F.size("unsupported_pattern") == 0))


def composite_fingerprint(parts: dict[str, Column]) -> Column:
    """SHA-256 over named digests in the order of their names; null (unknown) if any is."""
    known = F.lit(True)
    for c in parts.values():
        known = known & c.isNotNull()
    return F.when(known, F.sha2(F.concat_ws("\n", *(F.concat(F.lit(f"{n}:"), c.cast("string")) for n, c in sorted(parts.items()))), 256))


def nested_finding_ids(documents: DataFrame, key: str, document: str) -> DataFrame:
    """key and every distinct finding id inside a JSON document, however deep: objects with a text rule_id and a text id.

    Broken and null documents have none. The nesting is unbounded, so documents are
    walked in Arrow batches with a stack.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    stack = [json.loads(text)] if text is not None else []
                except (ValueError, RecursionError):
                    continue
                found = set()
                while stack:
                    value = stack.pop()
                    if isinstance(value, dict):
                        if isinstance(value.get("rule_id"), str) and isinstance(value.get("id"), str):
                            found.add(value["id"])
                        stack += value.values()
                    elif isinstance(value, list):
                        stack += value
                rows += [i] * len(found)
                ids += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.string())], names=[key, "finding_id"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, document).mapInArrow(run, f"`{key}` {kind}, finding_id string").distinct()


def changed_entrypoints(source: DataFrame, tests: DataFrame, changed: DataFrame) -> DataFrame:
    """Entrypoints among changed files: of a path that both fact tables have, the source's row counts."""
    rows = source.withColumn("_o", F.lit(0)).unionByName(tests.withColumn("_o", F.lit(1)), allowMissingColumns=True).filter("is_entrypoint")
    first = rows.join(changed.select(C("path").alias("_c")).distinct(), C("path") == C("_c"), "left_semi").groupBy("path").agg(F.min_by(F.struct("module_key", "target_kind", "entrypoint_kind"), F.struct("_o", "module_key")).alias("e"))
    return first.select("path", "e.*").filter(C("entrypoint_kind").isNotNull())


def selector_statuses(selectors: DataFrame, tests: DataFrame, executions: DataFrame) -> DataFrame:
    """selectors with resolution (unresolved, resolved, ambiguous) and execution.

    ``selectors``, ``tests``: package, target, path, name; ``executions``: the same and
    last_status. A resolved selector has the status of its test, if the test's name is
    unique among all executions; otherwise it is unknown.
    """
    keys = ["package", "target", "path", "name"]
    on = lambda p: null_safe([(k, f"{p}{k}") for k in keys])
    n = tests.groupBy(*(C(k).alias(f"_n_{k}") for k in keys)).agg(F.count("*").alias("_n"))
    rows = selectors.join(n, on("_n_"), "left").drop(*(f"_n_{k}" for k in keys))
    names = executions.groupBy(C("name").alias("_u")).agg(F.count("*").alias("_names"))
    rows = rows.join(names, C("name") == C("_u"), "left").drop("_u")
    ran = executions.groupBy(*(C(k).alias(f"_r_{k}") for k in keys)).agg(F.min("last_status").alias("_status"))
    rows = rows.join(ran, on("_r_"), "left").drop(*(f"_r_{k}" for k in keys))
    resolution = F.when(C("_n").isNull(), "unresolved").when(C("_n") == 1, "resolved").otherwise("ambiguous")
    execution = F.when((resolution == "resolved") & (C("_names") == 1), F.coalesce("_status", F.lit("unknown"))).otherwise("unknown")
    return rows.withColumns({"resolution": resolution, "execution": execution}).drop("_n", "_names", "_status")


def owner_statuses(behaviors: DataFrame, observed: DataFrame, run: Column) -> DataFrame:
    """behaviors with the status of their owners: unresolved, observed_failure, observed_pass or unknown.

    ``behaviors`` and ``observed`` share ``behavior``; ``run`` is the status of the whole
    test run (a column of behaviors). A behaviour without a selector is unresolved.
    """
    per = observed.groupBy(C("behavior").alias("_b")).agg(F.bool_or(C("resolution") != "resolved").alias("_open"), F.bool_or(C("execution") == "failed").alias("_failed"), F.bool_and(C("execution") == "passed").alias("_passed"))
    status = F.when(C("_open").isNull() | C("_open"), "unresolved").when(C("_failed"), "observed_failure").when((run == "passed") & C("_passed"), "observed_pass").otherwise("unknown")
    return behaviors.join(per, C("behavior") == C("_b"), "left").withColumn("status", status).drop("_b", "_open", "_failed", "_passed")


def owner_findings(reviewed: DataFrame) -> DataFrame:
    """One row a required behaviour whose owner isn't observed to pass, and why its absence of faults is unknown."""
    why = F.when(C("status") == "unresolved", "no owner resolves").when(C("status") == "observed_failure", "the owner failed").otherwise("execution is unknown")
    return reviewed.filter(C("required") & (C("status") != "observed_pass")).select("behavior", F.lit("rust.testing.owner-review").alias("rule_id"), why.alias("reason"))


def fault_classes(experiments: DataFrame) -> DataFrame:
    """experiments (baseline, injected, restored statuses) with class: not_run, inconclusive, reported_detected or survived."""
    calm = (C("baseline") == "passed") & (C("restored") == "passed")
    kind = F.when(C("injected") == "not_run", "not_run").when(~F.coalesce(calm, F.lit(False)), "inconclusive").when(C("injected") == "assertion_failed", "reported_detected").when(C("injected") == "passed", "survived").otherwise("inconclusive")
    return experiments.withColumn("class", kind)


def undetected(behaviors: DataFrame, experiments: DataFrame) -> DataFrame:
    """Required behaviours for which no experiment reports a detected fault."""
    hit = fault_classes(experiments).filter(C("class") == "reported_detected").select(C("behavior").alias("_b")).distinct()
    return behaviors.filter("required").join(hit, C("behavior") == C("_b"), "left_anti")


def consolidation_candidates(dispositions: DataFrame) -> DataFrame:
    """Dispositions (id, behavior, tests, hours) by falling registrations an hour, then id; nulls and hours of 0 have no leverage."""
    leverage = F.try_divide(F.size("tests").cast("double"), C("hours"))
    return dispositions.withColumns({"estimated_removable": F.size("tests"), "leverage": leverage}).orderBy(C("leverage").desc_nulls_last(), "id")


def disagreements(report: DataFrame, derived: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose reported columns differ from the ones derived again, or that one side lacks."""
    a = report.select(C(key).alias("_r"), *(C(c).alias(f"_r_{c}") for c in columns), F.lit(True).alias("_here"))
    b = derived.select(C(key).alias("_k"), *(C(c).alias(f"_d_{c}") for c in columns), F.lit(True).alias("_there"))
    joined = a.join(b, C("_r").eqNullSafe(C("_k")), "full_outer")
    same = F.coalesce(C("_here") & C("_there"), F.lit(False))
    for c in columns:
        same = same & C(f"_r_{c}").eqNullSafe(C(f"_d_{c}"))
    return joined.filter(~same).select(F.coalesce("_r", "_k").alias(key))
