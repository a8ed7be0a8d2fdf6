"""Sequences, islands and windows over ordered rows, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 8192


def _on(keys: Sequence[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """The last non-null value at or before each row of its group, in the order of a unique bigint.

    Runs in blocks of ``block`` order numbers; a block hands its last value on through
    one row, so a file of any length is read by many tasks.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    ends = rows.groupBy(*keys, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(k).alias(f"_e_{k}") for k in keys), F.col("_block").alias("_e_block"), F.last("_end", ignorenulls=True).over(over).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    joined = here.join(ends, _on(keys, "_e_") & (F.col("_block") == F.col("_e_block")), "left")
    return joined.select(*df.columns, F.coalesce("_here", "_before").alias(name))


def group_numbers(df: DataFrame, keys: Sequence[str], order: str, starts: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Running count of the rows that start a record (headers in a log), in blocks like carry_forward."""
    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_start", F.coalesce(starts.cast("bigint"), F.lit(0)))
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_start").alias("_sum"))
    sums = sums.select(*(F.col(k).alias(f"_e_{k}") for k in keys), F.col("_block").alias("_e_block"), (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.sum("_start").over(inside))
    joined = here.join(sums, _on(keys, "_e_") & (F.col("_block") == F.col("_e_block")), "left")
    return joined.select(*df.columns, (F.col("_here") + F.col("_before")).alias(name))


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: keys, first, last, n. Repeats count once; nulls don't.

    Runs are found within blocks of numbers and joined where one block's run meets the
    next block's; only such border runs go through a window over the group.
    """
    rows = df.filter(F.col(number).isNotNull()).select(*keys, F.col(number).cast("bigint").alias("_x")).distinct().withColumn("_b", F.floor(F.col("_x") / BLOCK))
    inside = Window.partitionBy(*keys, "_b").orderBy("_x")
    runs = rows.withColumn("_g", F.col("_x") - F.row_number().over(inside)).groupBy(*keys, "_b", "_g").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    border = (F.pmod("lo", F.lit(BLOCK)) == 0) | (F.pmod("hi", F.lit(BLOCK)) == BLOCK - 1)
    inner = runs.filter(~border).select(*keys, F.col("lo").alias("first"), F.col("hi").alias("last"))
    edge = runs.filter(border)
    over = Window.partitionBy(*keys).orderBy("lo")
    edge = edge.withColumn("_new", F.when(F.lag("hi").over(over) == F.col("lo") - 1, 0).otherwise(1)).withColumn("_id", F.sum("_new").over(over))
    joined = edge.groupBy(*keys, "_id").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).drop("_id")
    return inner.unionByName(joined).withColumn("n", F.col("last") - F.col("first") + 1)


def two_windows(ts: Column, end: Column, width: str) -> Column:
    """recent for (end - w, end], previous for (end - 2w, end - w]; else null. Half open on the left."""
    w = F.expr(f"interval {width}")
    return F.when((ts <= end) & (ts > end - w), "recent").when((ts <= end - w) & (ts > end - w - w), "previous")


def occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1, 2, ... of rows with equal keys, in document order.

    One key here is one anchor text of one file and rule. Keys that may be hot need a
    further column, such as the file, among them.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def token_windows(tokens: Column, lines: Column, size: int) -> Column:
    """Windows of ``size`` tokens, stride 1: structs of at, window (tokens joined by a bar), first and last line."""
    n = F.size(tokens) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        i.alias("at"), F.array_join(F.slice(tokens, i + 1, size), "|").alias("window"),
        F.element_at(lines, i + 1).alias("first_line"), F.element_at(lines, i + size).alias("last_line"),
    )))


def greedy_disjoint(spans: Sequence[tuple[int, int]]) -> list[bool]:
    """In order of (start, end): keep a span that doesn't overlap the last one kept."""
    keep, end = [], None
    for s, e in spans:
        keep.append(end is None or s > end)
        if keep[-1]:
            end = e
    return keep


def non_overlapping(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Greedy choice of spans of each group that don't overlap, by (start, end).

    The choice depends on the one before it, which no window frame can express. Groups
    arrive sorted and are streamed, one state a group, so a group of any size passes
    through without being held.
    """
    if not keys:
        raise ValueError("spans are chosen group by group: without a key one task would get all of them")
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            owners = list(zip(*(pdf[k].astype(object).where(pdf[k].notna(), None) for k in keys)))
            for i, (own, s, e) in enumerate(zip(owners, pdf[start], pdf[end])):
                if own != key:
                    key, last = own, None
                if last is None or s > last:
                    keep[i], last = True, e
            yield pdf[keep]

    return df.repartition(*keys).sortWithinPartitions(*keys, start, end).select(*names).mapInPandas(run, df.schema)


def adjacent_changes(values: Column) -> Column:
    """How often neighbours in an array differ."""
    n = F.size(values)
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda acc, i: acc + F.when(F.get(values, i) != F.get(values, i - 1), 1).otherwise(0))).otherwise(F.when(n >= 0, F.lit(0)))
