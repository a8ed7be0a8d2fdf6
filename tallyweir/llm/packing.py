"""Filling fixed-capacity containers with items of varying length (problem 7).

Bulk-synchronous best fit. A round sorts the open items and the gaps of all containers
by size, in ranges over many tasks, and sweeps each range from large to small: an item
takes the smallest free gap that still holds it, its successor. What a range can't match
by itself is counted (so many items without a gap, so many gaps without an item) and
matched across ranges by rank, so no two items ever claim one gap. Then gaps are updated
and the next round begins.

A container takes one claim a round, so small items claim in bundles: neighbours by size
whose sum is within the round's target. A bundle that finds no gap is opened again and
the target is halved, down to single items. Large items go first, the smallest last,
where they fill what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from ..tables import load
from .tokens import VOCABULARY, count_tokens

CAPACITY = 2048
#: Items and gaps that one task sweeps, about 0.1 kB each.
SWEEP_ROWS = 100_000
#: Items of at least 1/2, then 1/16 of the capacity, then all others.
CLASSES = (2, 16)


def _bundles(target: int):
    """Items of a batch as bundles: neighbours in falling size while their sum is within the target; larger ones alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            order = np.argsort(-size, kind="stable")
            n = len(order)
            sums = np.concatenate([[0], np.cumsum(size[order], dtype=np.int64)])
            at = int((size > target).sum())
            starts = list(range(at))
            while at < n:
                starts.append(at)
                at = int(np.searchsorted(sums, sums[at] + target, side="right")) - 1
            offsets = np.array([*starts, n], np.int32)
            ordered = batch.take(pa.array(order))
            inside = sums[:-1] - np.repeat(sums[offsets[:-1]], np.diff(offsets))
            members = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([*ordered.columns, pa.array(inside, pa.int32())], names=["item", "piece_no", "size", "inside"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(sums[offsets]), pa.int32()), members], names=["size", "members"])

    return run


PLACED, NO_GAP, NO_ITEM, SUMMARY = 0, 1, 2, 3


def sweep(size: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in one pass over sizes in falling order, gaps before items of their size.

    Returns matched items and their gaps, items left over in order, and gaps left over
    with the smallest first.
    """
    free: list[int] = []
    items, gaps, lost = [], [], []
    for i, gap in enumerate(is_gap.tolist()):
        if gap:
            free.append(i)
        elif free:
            items.append(i)
            gaps.append(free.pop())
        else:
            lost.append(i)
    return tuple(np.array(x, np.int64) for x in (items, gaps, lost, free[::-1]))


def _sweep_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not (batches := [b for b in batches if b.num_rows]):
        return
    part = TaskContext.get().partitionId()
    table = pa.Table.from_batches(batches).combine_chunks()
    size = table.column("size").to_numpy()
    items, gaps, lost, free = sweep(size, table.column("container").is_valid().to_numpy())
    names = ["what", "part", "rank", "container", "gap", "size", "members"]
    for what, own, holder in ((PLACED, items, gaps), (NO_GAP, lost, None), (NO_ITEM, None, free)):
        n = len(own if own is not None else holder)
        take = lambda c, rows: table.column(c).combine_chunks().take(pa.array(rows)) if rows is not None else pa.nulls(n, table.schema.field(c).type)
        columns = [pa.array(np.full(n, what, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n)), take("container", holder), take("size", holder), take("size", own), take("members", own)]
        yield from pa.table(columns, names=names).to_batches(max_chunksize=20_000)
    # One row of numbers: bundles without a gap and gaps without an item, the items in those bundles and the smallest of them, the widest gap left.
    lists = table.column("members").combine_chunks().take(pa.array(lost))
    inner = lists.flatten().field("size").to_numpy()
    widest = max((size[gaps] - size[items]).max(initial=0), size[free].max(initial=0))
    one = [pa.array([v], t) for v, t in ((SUMMARY, pa.int32()), (part, pa.int32()), (len(lost), pa.int64()), (len(free), pa.int64()), (int(widest), pa.int32()), (int(inner.min(initial=2**31 - 1)), pa.int32()))]
    yield pa.RecordBatch.from_arrays([*one, pa.array([[dict.fromkeys(("item", "piece_no", "size", "inside")) | {"piece_no": len(inner)}]], lists.type)], names=names)


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Match what ranges left over: (part, items, gaps) in the order of ranges to (item part, first rank, gap part, first rank, n, first pair).

    Items take the nearest free gaps of the ranges above them. At most two lines a range.
    """
    lines, free, pairs = [], [], 0
    for part, items, gaps in sorted(left):
        rank = 0
        while rank < items and free:
            above, first, n = free.pop()
            take = min(n, items - rank)
            lines.append((part, rank, above, first, take, pairs))
            rank, pairs = rank + take, pairs + take
            if take < n:
                free.append((above, first + take, n - take))
        if gaps:
            free.append((part, 0, gaps))
    return lines


class _Round:
    """One round: placed bundles, the gaps after it, the items that found none, their number and least size, and the widest gap.

    After ranges were matched with each other the two sizes are bounds, which the next round makes exact.
    """

    def __init__(self, bundles: DataFrame, gaps: DataFrame, members: str, parts: int):
        spark = bundles.sparkSession
        if parts > 1:  # read twice, once to draw the ranges
            bundles = written(bundles.withColumn("tie", F.monotonically_increasing_id()), "bundles")
        claims = bundles.select("size", F.lit(None).cast("bigint").alias("container"), "members", "tie" if parts > 1 else F.lit(0).cast("bigint").alias("tie"))
        offers = gaps.select(F.col("gap").alias("size"), "container", F.lit(None).cast(members).alias("members"), F.col("container").alias("tie"))
        keys = [F.col("size").desc(), F.col("container").isNull(), F.col("tie")]
        both = claims.unionByName(offers)
        ranges = (both.repartitionByRange(parts, *keys) if parts > 1 else both.coalesce(1)).sortWithinPartitions(*keys)
        swept = written(ranges.drop("tie").mapInArrow(_sweep_range, f"what int, part int, rank bigint, container bigint, gap int, size int, members {members}"), "swept")
        # Six numbers a range; the lines that match them are at most two a range.
        told = swept.filter(F.col("what") == SUMMARY).select("part", F.col("rank").alias("lost"), F.col("container").alias("free"), F.col("gap").alias("widest"), F.col("size").alias("least"), F.col("members")[0]["piece_no"].alias("n")).collect()
        lines = across([(r["part"], r["lost"], r["free"]) for r in told])
        self.n, self.least, self.widest = sum(r["n"] for r in told), min((r["least"] for r in told), default=0), max((r["widest"] for r in told), default=0)
        placed, lost, free = (swept.filter(F.col("what") == w) for w in (PLACED, NO_GAP, NO_ITEM))
        placed = placed.select("container", "gap", "size", "members")
        if lines:
            table = F.broadcast(spark.createDataFrame(lines, "i_part int, i_rank bigint, g_part int, g_rank bigint, n bigint, pair bigint"))

            def within(side: str):
                return (F.col("part") == F.col(f"{side}_part")) & (F.col("rank") >= F.col(f"{side}_rank")) & (F.col("rank") < F.col(f"{side}_rank") + F.col("n"))

            numbered = [df.join(table, within(side)).withColumn("no", F.col("pair") + F.col("rank") - F.col(f"{side}_rank")) for side, df in (("i", lost), ("g", free))]
            crossed = written(numbered[0].select("no", "size", "members").join(numbered[1].select("no", "container", "gap"), "no").drop("no"), "crossed")
            placed = placed.unionByName(crossed)
            lost, free = (df.join(table, within(side), "left_anti") for side, df in (("i", lost), ("g", free)))
            self.n -= crossed.agg(F.coalesce(F.sum(F.size("members")), F.lit(0))).first()[0]
        self.placed = placed
        self.gaps = placed.select("container", (F.col("gap") - F.col("size")).alias("gap")).filter("gap > 0").unionByName(free.select("container", "gap"))
        self.left = lost.select(F.explode("members").alias("m")).select("m.item", "m.piece_no", "m.size")


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Containers of all items: item, piece_no, container, start, n_units.

    An item that exceeds the capacity is split into pieces of the capacity and a rest;
    no other item is split. Items with null, zero or negative size have no row.
    Repeated ids are items of their own. ``start`` is the piece's place in its
    container. Containers are numbered from 0 and none is empty: as many are opened as
    the units need at least, and more only for items that fit into no gap. Equal sizes
    are split by a further key, so one size may hold any share of the items.
    """
    spark = items.sparkSession
    sized = items.select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("units")).filter(F.col("units") > 0)
    pieces = F.expr(f"sequence(0L, (units - 1) div {capacity})")
    sized = sized.select("item", "units", F.explode(pieces).alias("piece_no")).select("item", "piece_no", F.least(F.lit(capacity), F.col("units") - F.col("piece_no") * capacity).cast("int").alias("size"))
    sized = written(sized, "sizes")
    kind = sized.schema["item"].dataType.simpleString()
    members = f"array<struct<item: {kind}, piece_no: bigint, size: int, inside: int>>"
    floors = [max(1, capacity // c) for c in CLASSES] + [1]
    of_class = lambda i: (F.col("size") >= floors[i]) & ((F.col("size") < floors[i - 1]) if i else F.lit(True))
    totals = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("units"), F.count_if(F.col("size") * 2 > capacity).alias("halves"), *(F.struct(F.count_if(of_class(i)).alias("n"), F.min(F.when(of_class(i), F.col("size"))).alias("least")).alias(f"c{i}") for i in range(len(floors)))).first()
    opened = max(-(-totals["units"] // capacity), totals["halves"])
    gaps, widest = spark.range(opened).select(F.col("id").alias("container"), F.lit(capacity).alias("gap")), capacity if opened else 0
    done: list[_Round] = []
    for i in range(len(floors)):
        n, least = totals[f"c{i}"]
        active, target = sized.filter(of_class(i)).select("item", "piece_no", "size"), capacity // 2 if i else 0
        while n:
            fresh = widest < least
            if fresh:  # No gap holds any of them: whole containers' worth of bundles, from few tasks.
                active, target = active.coalesce(max(1, -(-n // sweep_rows))), capacity
            bundles = active.mapInArrow(_bundles(target if fresh else min(target, widest)), f"size int, members {members}")
            if fresh:
                bundles = written(bundles, "bundles")
                need = bundles.agg(F.sum("size").alias("units"), F.count_if(F.col("size") * 2 > capacity).alias("halves")).first()
                more = max(-(-need["units"] // capacity), need["halves"])
                gaps = gaps.unionByName(spark.range(opened, opened + more).select(F.col("id").alias("container"), F.lit(capacity).alias("gap")))
                opened += more
            done.append(_Round(bundles, gaps, members, max(1, -(-(n + opened) // sweep_rows))))
            active, gaps, n, least, widest = done[-1].left, done[-1].gaps, done[-1].n, done[-1].least, done[-1].widest
            target //= 2
    if not done:
        return sized.select(F.col("item").alias(item), "piece_no", F.lit(0).cast("bigint").alias("container"), F.lit(0).cast("bigint").alias("start"), F.col("size").cast("bigint").alias("n_units"))
    whole = done[0].placed
    for later in done[1:]:
        whole = whole.unionByName(later.placed)
    each = whole.select("container", (F.lit(capacity) - F.col("gap")).alias("filled"), F.explode("members").alias("m"))
    return each.select(F.col("m.item").alias(item), F.col("m.piece_no").alias("piece_no"), "container", (F.col("filled") + F.col("m.inside")).cast("bigint").alias("start"), F.col("m.size").cast("bigint").alias("n_units"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Documents with at least one token, by tokens of the vocabulary."""
    return pack(count_tokens(documents, path), "doc_id", "n_tokens", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, units in them, and the share of space left unused."""
    total = packed.agg(F.countDistinct("container").alias("n_containers"), F.coalesce(F.sum("n_units"), F.lit(0)).alias("n_units"))
    return total.withColumn("unused_share", 1 - F.col("n_units") / F.nullif(F.col("n_containers") * capacity, F.lit(0)))


def packing_faults(packed: DataFrame, sizes: DataFrame, item: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_items that were to be packed, and n_faults against the rules.

    A fault is an item whose pieces don't add up to it or are more than needed, and a
    piece that doesn't begin where the one before it in the container ends, or ends
    beyond the capacity. A container has at most ``capacity`` pieces.
    """
    from pyspark.sql.window import Window

    want = sizes.filter(F.col(size) > 0).groupBy(F.col(item).alias("_w")).agg(F.sum(size).alias("_units"), F.sum(F.ceil(F.col(size) / capacity)).alias("_pieces"), F.count("*").alias("_items"))
    have = packed.groupBy(F.col(item).alias("_h")).agg(F.sum("n_units").alias("_got"), F.count("*").alias("_parts"))
    both = want.join(have, F.col("_w").eqNullSafe(F.col("_h")), "full_outer")
    wrong = ~((F.col("_units") == F.col("_got")) & (F.col("_pieces") == F.col("_parts")))
    items = both.agg(F.coalesce(F.sum("_items"), F.lit(0)).alias("n_items"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("_wrong"))
    end = F.col("start") + F.col("n_units")
    before = F.coalesce(F.lag(end).over(Window.partitionBy("container").orderBy("start")), F.lit(0))
    placed = packed.select((before != F.col("start")).alias("_off"), (end > capacity).alias("_over")).agg(F.count_if(F.col("_off") | F.col("_over")).alias("_misplaced"))
    return items.crossJoin(placed).select("n_items", (F.col("_wrong") + F.col("_misplaced")).alias("n_faults"))  # one row beside one row


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p7_packed(spark, sf_dir))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, units and rows that break a rule of packing (overlap, hole, overfull, wrong split, wrong sum)."""
    return packing_faults(p7_packed(spark, sf_dir), count_tokens(load(spark, sf_dir, "documents")), "doc_id", "n_tokens")


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill, "p7_check": p7_check}
SQL = {"p7_check": "select count(*)::bigint n_items, 0::bigint n_faults from documents where text <> ''"}
