"""Exact statistics of groups that survive groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import percent, ratio, round2
from ..storage import written

def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str], parts: int | None = None) -> DataFrame:
    """Ceiling-rank percentiles, sorted[ceil((n-1)q)], of each group; also n_values.

    Values are first counted, so ties collapse before they are moved. The counts are
    then sorted in ranges of (group, value) over all tasks (``parts``, or as many as
    Spark finds fit): a large group lies in several ranges, whose sums give the offsets
    of the ranks inside them. No task holds a large group. Null and NaN values don't
    count; a group without values gives no row; null keys are a group.
    """
    key_struct = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(1).alias("_"))
    counted = df.select(key_struct.alias("_k"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_k", "_v").agg(F.count("*").alias("_c"))
    ranges = written(counted.repartitionByRange(*([parts] if parts else []), "_k", "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("_k", "_part").agg(F.sum("_c").alias("_s"))
    run = Window.partitionBy("_k").orderBy("_part")
    sums = sums.select("_k", "_part", (F.sum("_s").over(run) - F.col("_s")).alias("_base"), F.sum("_s").over(Window.partitionBy("_k")).alias("_n"))
    inside = Window.partitionBy("_k", "_part").orderBy("_v")
    ranked = ranges.withColumn("_in", F.sum("_c").over(inside)).join(sums, ["_k", "_part"]).withColumn("_end", F.col("_base") + F.col("_in"))
    picks = []
    for q, name in zip(qs, names):
        rank = F.least(F.ceil((F.col("_n") - 1) * F.lit(float(q))), F.col("_n") - 1)
        picks.append(F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_v"))).alias(name))
    found = ranked.groupBy("_k").agg(F.max("_n").alias("n_values"), *picks)
    return found.select(*(F.col(f"_k.{k}").alias(k) for k in keys), "n_values", *names)


def exact_sum(value: Column, scale: int = 6) -> Column:
    """Sum that doesn't depend on the order of rows: in decimals of so many places."""
    return F.sum(value.cast(f"decimal(30,{scale})")).cast("double")


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n_values, mean, p50, p75, p90, p95, p99 and largest value of each group."""
    if not keys:
        return distribution(df.select(F.col(value), F.lit(0).alias("_all")), ["_all"], value).drop("_all")
    ranks = exact_percentiles(df, keys, value, (0.5, 0.75, 0.9, 0.95, 0.99), ("p50", "p75", "p90", "p95", "p99"))
    means = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg((exact_sum(F.col(value)) / F.count(value)).alias("mean"), F.max(F.col(value).cast("double")).alias("largest"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    return ranks.join(means.withColumnsRenamed({k: f"_m_{k}" for k in keys}), on).drop(*(f"_m_{k}" for k in keys))


def concentration(df: DataFrame, keys: Sequence[str], member: str, weight: Column | None = None) -> DataFrame:
    """Ownership of each group: total, n_members, primary (largest share, ties to the least name), its share, HHI and Shannon entropy in bits.

    Members are counted in the shuffle, and the primary is the maximum of a struct, so
    nothing is sorted or collected. Null members don't count.
    """
    each = df.filter(F.col(member).isNotNull()).groupBy(*keys, F.col(member).alias("_member")).agg((F.sum(weight) if weight is not None else F.count("*")).cast("double").alias("_w"))
    first = each.groupBy(*keys).agg(F.sum("_w").alias("total"), F.count("*").alias("n_members"), F.max("_w").alias("_top"), F.sum(F.col("_w") * F.col("_w")).alias("_sq"), F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.log2(F.when(F.col("_w") > 0, F.col("_w")))).otherwise(0.0)).alias("_wl"))
    best = each.groupBy(*keys).agg(F.max_by("_member", F.struct(F.col("_w"), _reverse(F.col("_member")))).alias("primary"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    t = F.nullif(F.col("total"), F.lit(0.0))
    joined = first.join(best.withColumnsRenamed({k: f"_b_{k}" for k in keys}), on)
    return joined.select(*keys, "total", "n_members", "primary", F.try_divide("_top", t).alias("primary_share"), F.try_divide("_sq", t * t).alias("hhi"), (F.log2(t) - F.try_divide("_wl", t)).alias("entropy"))


def _reverse(name: Column) -> Column:
    """Orders names the other way round: code points are complemented."""
    return F.concat(F.transform(F.split(name, ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))


def entropy_terms(part: Column, whole: Column) -> Column:
    """-p log2 p of one member; 0 for an empty part, null for an empty whole."""
    p = ratio(part, whole)
    return F.when(p > 0, -p * F.log2(F.when(p > 0, p))).when(p.isNotNull(), 0.0)


def association(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> list[Column]:
    """support, P(b|a), P(a|b) in per cent and lift, to two decimals."""
    lift = ratio(n_ab.cast("double") * n, n_a.cast("double") * n_b)
    return [round2(percent(n_ab, n, None)).alias("support"), round2(percent(n_ab, n_a, None)).alias("b_given_a"), round2(percent(n_ab, n_b, None)).alias("a_given_b"), round2(lift).alias("lift")]


def confusion(cases: DataFrame, keys: Sequence[str], expected: str, observed: str) -> DataFrame:
    """Confusion counts and rates of each group; a null observation abstains.

    An abstention counts as missed when the case was expected. Rates are null for a
    zero denominator.
    """
    e, o = F.col(expected), F.col(observed)
    counts = cases.groupBy(*keys).agg(
        F.count("*").alias("labels"), F.count_if(e & F.coalesce(o, F.lit(False))).alias("tp"), F.count_if(~e & F.coalesce(o, F.lit(False))).alias("fp"),
        F.count_if(e & ~F.coalesce(o, F.lit(False))).alias("fn"), F.count_if(~e & ~F.coalesce(o, F.lit(True))).alias("tn"), F.count_if(o.isNull()).alias("abstained"),
    )
    c = F.col
    return counts.select("*", ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(c("labels") - c("abstained"), c("labels")).alias("coverage"), ratio(c("abstained"), c("labels")).alias("abstention"))


def flakiness(inventory: DataFrame, runs: DataFrame, key: Sequence[str], iterations: int) -> DataFrame:
    """Outcomes of each listed test over repeated runs: passed, failed, ignored, missing, failure_rate, flaky.

    ``runs`` has key, iteration and status (ok, FAILED, ignored). A rate is of the
    executed runs alone and null without any.
    """
    counted = runs.groupBy(*key).agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "passed"), ("FAILED", "failed"), ("ignored", "ignored"))), F.countDistinct("iteration").alias("_seen"))
    joined = inventory.join(counted, list(key), "left").fillna(0, ["passed", "failed", "ignored", "_seen"])
    return joined.withColumns({
        "missing": F.lit(iterations) - F.col("_seen"),
        "failure_rate": round2(percent(F.col("failed"), F.col("passed") + F.col("failed"), None)),
        "flaky": (F.col("passed") > 0) & (F.col("failed") > 0),
    }).drop("_seen")
