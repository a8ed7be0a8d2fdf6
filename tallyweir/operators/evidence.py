"""Evidence semantics: completeness, freshness and gates over findings.

Completeness follows from the status of inputs, never from row counts: an empty table
that is complete is not a missing one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_pattern


def confidence(required: Column, observed: Column, missing: Column, unsupported: Column) -> Column:
    """complete or partial with its counts and reasons; complete only without missing inputs and unsupported patterns."""
    gaps = (F.size(missing) > 0) | (F.size(unsupported) > 0)
    return F.struct((~gaps).alias("complete"), gaps.alias("partial"), required.alias("required_inputs"), observed.alias("observed_inputs"), missing.alias("missing_input"), unsupported.alias("unsupported_pattern"))


def mark_partial(evidence: Column, reason: Column) -> Column:
    """Downgrade, with the reason listed once. Never an upgrade."""
    return evidence.withField("complete", F.lit(False)).withField("partial", F.lit(True)).withField("missing_input", F.array_union(evidence["missing_input"], F.array(reason)))


def freshness(digest: Column, current_digest: Column, complete: Column, current_complete: Column) -> Column:
    """incomplete goes before stale, stale before current."""
    whole = F.coalesce(complete & current_complete, F.lit(False))
    return F.when(~whole, "incomplete").when(~F.coalesce(digest == current_digest, F.lit(False)), "stale").otherwise("current")


def artifact_status(exists: Column, readable: Column, compatible: Column, fresh: Column, fingerprint_complete: Column, complete: Column) -> Column:
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(no(exists), "missing").when(no(readable), "unreadable").when(no(compatible), "incompatible").when(no(fresh), "stale").when(no(fingerprint_complete) | no(complete), "partial").otherwise("available")


def age_hours(ts: Column, now: Column, skew_seconds: int = 300) -> Column:
    """Whole hours of age; null for a time that lies too far in the future."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    return F.when(seconds >= -skew_seconds, F.floor(F.greatest(seconds, F.lit(0)) / 3600))


def expired(ts: Column, now: Column, max_age_hours: int) -> Column:
    """By the exact interval, not by whole hours."""
    return (now - ts) > F.expr(f"interval {int(max_age_hours)} hours")


def waiver_expired(expires: Column, today: Column) -> Column:
    """Before today, or no date at all."""
    return F.coalesce(F.try_to_date(expires, "yyyy-MM-dd") < today, F.lit(True))


def apply_waivers(findings: DataFrame, waivers: Sequence[dict], today: str) -> DataFrame:
    """Findings with waiver (index of the first active one that matches, or null) and bucket (active or waived).

    Waivers are configuration: few, and turned into one expression. A waiver matches
    its rule and, if it has one, its path pattern.
    """
    found = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(waivers))):
        active = ~waiver_expired(F.lit(w.get("expires")).cast("string"), F.lit(today).cast("date"))
        where = matches_pattern(F.col("path"), F.lit(w["path"])) if w.get("path") else F.lit(True)
        found = F.when((F.col("rule_id") == w["rule_id"]) & where & active, F.lit(i)).otherwise(found)
    return findings.withColumn("waiver", found).withColumn("bucket", F.when(F.col("waiver").isNotNull(), "waived").otherwise("active"))


def rule_limits(findings: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """rule_id, level, observed, excluded, excess, status of each configured rule.

    A rule with ``available`` False has observed null and status incomplete; level off
    is disabled. Findings outside a rule's scope (exclude_paths) are excluded, not
    observed. All rules are counted in one pass over the findings.
    """
    spark = findings.sparkSession
    outside = F.lit(False)
    for r in rules:
        for pattern in r.get("exclude_paths", []):
            outside = outside | ((F.col("rule_id") == r["rule_id"]) & matches_pattern(F.col("path"), F.lit(pattern)))
    counts = findings.groupBy("rule_id").agg(F.count_if(~outside).alias("_in"), F.count_if(outside).alias("_out")).withColumnRenamed("rule_id", "_r")
    table = spark.createDataFrame([(r["rule_id"], r["level"], int(r.get("max", 0)), bool(r.get("available", True))) for r in rules], "rule_id string, level string, max bigint, available boolean")
    joined = F.broadcast(table).join(counts, F.col("rule_id") == F.col("_r"), "left")
    observed = F.when(F.col("available") & (F.col("level") != "off"), F.coalesce("_in", F.lit(0)))
    status = F.when(F.col("level") == "off", "disabled").when(~F.col("available"), "incomplete").when(observed > F.col("max"), "exceeded").otherwise("passed")
    return joined.select("rule_id", "level", observed.alias("observed"), F.coalesce("_out", F.lit(0)).alias("excluded"), F.greatest(observed - F.col("max"), F.lit(0)).alias("excess"), status.alias("status"))


def threshold_violations(scores: DataFrame, key: str, score: str, limit: float) -> DataFrame:
    """Rows above the limit; a null score is no violation but an unknown input."""
    return scores.filter((F.col(score) > limit) | F.col(score).isNull()).select(key, score, F.when(F.col(score).isNull(), "unknown").otherwise("violation").alias("outcome"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first row of each key by ``order``; an aggregate, so a hot key is folded before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def index_by_last(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """key and value of the last row of each key (a later row replaces an earlier one)."""
    return df.groupBy(key).agg(F.max_by(value, position).alias(value))
