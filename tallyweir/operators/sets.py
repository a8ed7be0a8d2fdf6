"""Comparisons of sets of ids and of arrays as sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_sets(current: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """key and disposition: introduced, resolved or inherited. One shuffle: presence is aggregated on both sides first."""
    both = current.select(key, F.lit(True).alias("_c"), F.lit(False).alias("_b")).unionByName(base.select(key, F.lit(False).alias("_c"), F.lit(True).alias("_b")))
    seen = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.bool_or("_c").alias("_c"), F.bool_or("_b").alias("_b"))
    return seen.select(key, F.when(F.col("_c") & F.col("_b"), "inherited").when(F.col("_c"), "introduced").otherwise("resolved").alias("disposition"))


def comparison_state(configured: Column, complete: Column, same_identity: Column) -> Column:
    """Whether two snapshots may be compared: not_configured, incomplete, incomparable or compared."""
    return F.when(~configured, "not_configured").when(~F.coalesce(complete, F.lit(False)), "incomplete").when(~F.coalesce(same_identity, F.lit(False)), "incomparable").otherwise("compared")


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_disjoint(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def union_all(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p, allowMissingColumns=True)
    return result
