"""Percentiles of very large numeric columns, mergeable across partitions and days (problem 5).

A sketch is a stack of relative compactors. The compactor of level h holds items of
weight 2^h; when it overflows it sorts itself, protects its upper part and promotes
every other item of the lower part, so the rank error shrinks towards the maximum:
it is proportional to the number of items above. Two sketches merge by joining their
levels. A group that never overflows is exact.

Each compaction adds, for values below the largest item it compacted, an independent
error of 0 or +-2^h with mean 0. A sketch counts its compactions and remembers these
largest items, so every percentile comes with a bound of its own rank error
(Hoeffding, at confidence 1 - DELTA).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from ..tables import last_delivery, load
from .tokens import pack_varint, unpack_varint

#: Items of one section of a compactor; the rank error falls as 1/K.
K = 64
SECTIONS = 3
DELTA = 0.01
QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
METRICS = ("function_scores", "cyclomatic_complexities", "cognitive_complexities")
#: Bytes of packed values that a task holds while it makes partial sketches.
HELD = 2_000_000


def capacity(n: int, k: int) -> int:
    return 2 * k * max(SECTIONS, math.ceil(math.log2(max(2.0, n / k))))


class Sketch:
    """A stack of relative compactors that protect the upper tail."""

    __slots__ = ("k", "n", "levels", "compactions", "tops", "rng")

    def __init__(self, k: int = K, seed: int = 0):
        self.k, self.n = k, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.compactions: list[int] = [0]
        self.tops: list[float] = [-math.inf]
        self.rng = np.random.default_rng(seed)

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compress()

    def merge(self, levels: Sequence[np.ndarray], compactions: Sequence[int], tops: Sequence[float]) -> None:
        for h, items in enumerate(levels):
            self._grow(h)
            self.n += len(items) << h
            self.levels[h] = np.concatenate([self.levels[h], items])
        for h, (c, top) in enumerate(zip(compactions, tops)):
            self._grow(h)
            self.compactions[h] += c
            self.tops[h] = max(self.tops[h], top)
        self._compress()

    def _grow(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append(np.empty(0))
            self.compactions.append(0)
            self.tops.append(-math.inf)

    def _compress(self) -> None:
        room, h = capacity(self.n, self.k), 0
        while h < len(self.levels):
            items = self.levels[h]
            if len(items) > room:
                done = self.compactions[h]
                sections = min((~done & (done + 1)).bit_length(), room // (2 * self.k))
                cut = len(items) - (room - sections * self.k)
                cut -= cut & 1
                items = np.sort(items)
                self._grow(h + 1)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[int(self.rng.integers(2)) : cut : 2]])
                self.levels[h] = items[cut:]
                self.compactions[h] += 1
                self.tops[h] = max(self.tops[h], float(items[cut - 1]))
            h += 1

    def quantiles(self, qs: Sequence[float]) -> tuple[list[float], list[float]]:
        """Values of ceiling rank, and bounds of their rank errors (0: exact)."""
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        reach = np.cumsum(weights[order])
        at = np.searchsorted(reach, [math.ceil((self.n - 1) * q) for q in qs], side="right")
        values = items[order][np.minimum(at, len(items) - 1)]
        return values.tolist(), [self.rank_error(v) for v in values]

    def rank_error(self, value: float) -> float:
        spread = sum(c * 4.0**h for h, (c, top) in enumerate(zip(self.compactions, self.tops)) if c and top > value)
        return math.sqrt(2 * math.log(2 / DELTA) * spread)


# A sketch as columns.
_PART = "sizes array<int>, items array<double>, compactions array<bigint>, tops array<double>"
_NAMES = ("sizes", "items", "compactions", "tops")
# A group on its way to its sketch: its plain values, packed, or a sketch if it overflowed.
_MOVED = f"mode tinyint, packed binary, {_PART}"
_MOVED_NAMES = ("mode", "packed", *_NAMES)
# How a list is packed: whole numbers, hundredths, or doubles as they are. All are exact.
WHOLE, HUNDREDTHS, DOUBLES = 0, 1, 2
_PACKABLE = float(1 << 34)
_KEY = "project_key string, run_day date"


def _valid(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists that are measurements, and how many each list has."""
    flat = lists.flatten()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False)
    ok = np.isfinite(values) & (values >= 0)
    kept = np.concatenate([[0], np.cumsum(ok)])
    return values[ok] + 0.0, np.diff(kept[np.concatenate([[0], np.cumsum(counts)])])


def pack_values(values: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Mode and bytes of each list of non-negative doubles; unpack_values gives back the same doubles."""
    hundredths = np.rint(values * 100)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    odd = lambda bad: np.diff(np.concatenate([[0], np.cumsum(bad)])[offsets]) > 0
    not_whole = odd((np.rint(values) != values) | (values >= _PACKABLE))
    mode = np.where(not_whole, np.where(odd((hundredths / 100 != values) | (hundredths >= _PACKABLE)), DOUBLES, HUNDREDTHS), WHOLE)
    of = np.repeat(mode, counts)
    small, plain = np.flatnonzero(mode != DOUBLES), np.flatnonzero(mode == DOUBLES)
    kept = of != DOUBLES
    codes = np.where(of[kept] == WHOLE, values[kept], hundredths[kept]).astype(np.int64)
    parts = [pack_varint(codes, counts[small])]
    if len(plain):
        ends = (np.concatenate([[0], np.cumsum(counts[plain])]) * 8).astype(np.int32)
        parts.append(pa.BinaryArray.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values[~kept].tobytes())]))
    back = np.empty(len(mode), np.int64)
    back[np.concatenate([small, plain])] = np.arange(len(mode))
    return pa.array(mode.astype(np.int8)), pa.concat_arrays(parts).take(pa.array(back))


def unpack_values(mode: pa.Array, packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The doubles of all lists, and how many each has; none for a null list."""
    kind = pc.fill_null(mode, -1).to_numpy(zero_copy_only=False)
    counts = np.zeros(len(kind), np.int64)
    small, plain = np.flatnonzero((kind == WHOLE) | (kind == HUNDREDTHS)), np.flatnonzero(kind == DOUBLES)
    codes, counts[small] = unpack_varint(packed.take(pa.array(small)))
    doubles = np.empty(0)
    if len(plain):
        raw = packed.take(pa.array(plain))
        counts[plain] = pc.binary_length(raw).to_numpy(zero_copy_only=False) // 8
        doubles = np.frombuffer(b"".join(raw.to_pylist()), np.float64)
    of = np.repeat(kind, counts)
    values = np.empty(len(of))
    values[of == DOUBLES] = doubles
    values[of != DOUBLES] = np.where(of[of != DOUBLES] == HUNDREDTHS, codes / 100, codes)
    return values, counts


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The three lists of each batch_no, measurements alone, packed for the shuffle."""
    for batch in batches:
        columns = [batch.column(c) for c in ("project_key", "run_day", "received_at", "batch")]
        for metric in METRICS:
            columns += pack_values(*_valid(batch.column(metric)))
        yield pa.RecordBatch.from_arrays(columns, names=["project_key", "run_day", "received_at", "batch", *(f"{m}_{c}" for m in range(len(METRICS)) for c in ("mode", "packed"))])


def _seed(*key: object) -> int:
    return int.from_bytes(str(key).encode()[-32:], "little") & 0x7FFFFFFFFFFFFFFF


def _sketch_columns(n: int, sketches: dict[int, Sketch]) -> list[pa.Array]:
    """The four columns of _PART for n rows, null except for the given ones."""
    types = [pa.list_(t) for t in (pa.int32(), pa.float64(), pa.int64(), pa.float64())]
    if not sketches:
        return [pa.nulls(n, t) for t in types]
    columns: list[list] = [[None] * n for _ in types]
    for i, s in sketches.items():
        for c, value in zip(columns, ([len(x) for x in s.levels], np.concatenate(s.levels), s.compactions, s.tops)):
            c[i] = value
    return [pa.array(c, t) for c, t in zip(columns, types)]


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (project, day), and the starts of the groups in that order."""
    day = pc.fill_null(table.column("run_day").combine_chunks().cast(pa.int32()), -(2**31)).to_numpy(zero_copy_only=False).astype(np.int64)
    project = table.column("project_key").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    code = (project << 32) + day
    order = np.argsort(code, kind="stable")
    code = code[order]
    return order, np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else order


def _partial(k: int):
    """Per task: lists of one (project, day) joined, and compacted where they overflow."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        order, starts = _groups(table)
        table = table.take(pa.array(order))
        columns = [table.column(c).combine_chunks().take(pa.array(starts)) for c in ("project_key", "run_day", "slot")]
        keys = list(zip(columns[0].to_pylist(), columns[1].to_pylist())) if len(starts) else []
        for m, metric in enumerate(METRICS):
            values, counts = unpack_values(table.column(f"{m}_mode").combine_chunks(), table.column(f"{m}_packed").combine_chunks())
            per_group = np.add.reduceat(counts, starts)
            ends = np.cumsum(per_group)
            sketches = {}
            for g in np.flatnonzero(per_group > capacity(0, k)):
                s = sketches[int(g)] = Sketch(k, _seed(metric, *keys[g]))
                s.update(values[ends[g] - per_group[g] : ends[g]])
            plain = per_group.copy()
            plain[list(sketches)] = 0
            mode, packed = pack_values(values[np.repeat(plain > 0, per_group)] if sketches else values, plain)
            columns += [mode, packed, *_sketch_columns(len(starts), sketches)]
        names = ["project_key", "run_day", "slot", *(f"{m}_{c}" for m in range(len(METRICS)) for c in _MOVED_NAMES)]
        yield from pa.table(columns, names=names).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += sum(len(batch.column(f"{m}_packed").buffers()[2] or b"") for m in range(len(METRICS)))
            if size >= HELD:
                yield from flush(held)
                held, size = [], 0
        if held and sum(b.num_rows for b in held):
            yield from flush(held)

    return run


def _read_part(row_sizes: list | None, items: np.ndarray, compactions: list | None, tops: list | None) -> tuple[list[np.ndarray], list[int], list[float]]:
    if row_sizes is None:
        return [items], [], []
    at = np.concatenate([[0], np.cumsum(row_sizes)])
    return [items[a:b] for a, b in zip(at, at[1:])], compactions or [], tops or []


def _parts_of(table: pa.Table, m: int) -> tuple:
    """Values of all rows, their bounds, and the sketch columns: plain rows are unpacked, sketches give their items."""
    column = lambda c: table.column(f"{m}_{c}").combine_chunks()
    values, counts = unpack_values(column("mode"), column("packed"))
    sizes, items = column("sizes"), column("items")
    if items.null_count < len(items):
        own = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False)
        both = np.empty(len(values) + own.sum())
        from_sketch = np.repeat(own > 0, counts + own)
        both[from_sketch], both[~from_sketch] = items.flatten().to_numpy(zero_copy_only=False), values
        values, counts = both, counts + own
    return values, np.concatenate([[0], np.cumsum(counts)]), sizes, table.column(f"{m}_compactions"), table.column(f"{m}_tops")


_RESULT = f"{_KEY}, metric int, n bigint, p array<double>, e array<double>, {_PART}"


class _Rows:
    """Collects result rows and gives them as batches."""

    def __init__(self):
        self.batches: list[pa.Table] = []

    def exact(self, projects: pa.Array, days: pa.Array, metric: int, values: np.ndarray, counts: np.ndarray) -> None:
        """Groups without compactions, all at once: the ranks are read off the sorted values."""
        group = np.repeat(np.arange(len(counts)), counts)
        values = values[np.lexsort((values, group))]
        starts = np.cumsum(counts) - counts
        found = [values[starts + np.ceil((counts - 1) * q).astype(np.int64)] for q in QUANTILES]
        p = np.stack(found, 1).reshape(-1)
        n = len(counts)
        width = pa.array(np.arange(n + 1) * len(QUANTILES), pa.int32())
        self._put(projects, days, metric, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(width, pa.array(p)), pa.ListArray.from_arrays(width, pa.array(np.zeros(len(p)))), None)

    def day(self, project: object, day: object, metric: int, s: Sketch) -> None:
        p, e = s.quantiles(QUANTILES)
        self._put(pa.array([project], pa.string()), pa.array([day], pa.date32()), metric, pa.array([s.n], pa.int64()), pa.array([p], pa.list_(pa.float64())), pa.array([e], pa.list_(pa.float64())), None)

    def part(self, project: object, metric: int, s: Sketch, day: object = None) -> None:
        none = pa.nulls(1, pa.list_(pa.float64()))
        self._put(pa.array([project], pa.string()), pa.array([day], pa.date32()), metric, pa.array([s.n], pa.int64()), none, none, s)

    def _put(self, project, day, metric, n, p, e, s: Sketch | None) -> None:
        rows = len(project)
        own = _sketch_columns(rows, {0: s} if s else {})
        self.batches.append(pa.table([project, day, pa.array(np.full(rows, metric, np.int32)), n, p, e, *own], names=["project_key", "run_day", "metric", "n", "p", "e", *_NAMES]))

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.batches:
            yield from pa.concat_tables(self.batches).combine_chunks().to_batches(max_chunksize=20_000)
            self.batches = []


#: Slots of days that are dealt to several tasks.
HOT_SLOT = 1 << 30
#: Added to the metric of a sketch that is only a part of its day.
OF_DAY = len(METRICS)


def _merge_days(k: int, keep_days: bool):
    """Rows sorted by (project, day) to percentiles of each day and one sketch of each project.

    With ``keep_days`` the days' sketches come out instead of their percentiles. At any
    time the task holds one batch and the sketches of one day and one project.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        open_key: tuple | None = None
        open_hot = False
        open_day: list[Sketch] = []
        project: object = None
        whole: list[Sketch] = []

        def give_day(key: tuple, m: int, s: Sketch, hot: bool) -> None:
            if hot or keep_days:
                rows.part(key[0], m + OF_DAY if hot else m, s, key[1])
            else:
                rows.day(*key, m, s)

        def close_day() -> None:
            if open_key is not None:
                for m, s in enumerate(open_day):
                    if s.n:
                        give_day(open_key, m, s, open_hot)

        def close_project() -> None:
            if not keep_days:
                for m, s in enumerate(whole):
                    if s.n:
                        rows.part(project, m, s)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            order, starts = _groups(table)
            if not np.array_equal(order, np.arange(len(order))):  # equal keys are neighbours; dictionary codes keep their order
                table = table.take(pa.array(order))
            bounds = np.append(starts, table.num_rows)
            projects = table.column("project_key").combine_chunks().take(pa.array(starts))
            days = table.column("run_day").combine_chunks().take(pa.array(starts))
            keys = list(zip(projects.to_pylist(), days.to_pylist()))
            hot = table.column("slot").to_numpy()[starts] >= HOT_SLOT
            parts = []
            for m in range(len(METRICS)):
                parts.append(_parts_of(table, m))

            def fold(s: Sketch, m: int, lo: int, hi: int) -> None:
                """Rows lo..hi into s: neighbouring raw lists at once, sketches one by one."""
                values, at, sizes, compactions, tops = parts[m]
                packed = [i for i in range(lo, hi) if sizes[i].is_valid] if sizes.null_count < len(sizes) else []
                begin = lo
                for i in [*packed, hi]:
                    if at[i] > at[begin]:
                        s.update(values[at[begin] : at[i]])
                    if i < hi:
                        s.merge(*_read_part(sizes[i].as_py(), values[at[i] : at[i + 1]], compactions[i].as_py(), tops[i].as_py()))
                    begin = i + 1

            # The last group may go on in the next batch; the first may belong to the one before.
            g = 0
            if keys[0] == open_key:
                for m in range(len(METRICS)):
                    fold(open_day[m], m, 0, bounds[1])
                g = 1
            if g < len(keys):
                close_day()
                last = len(keys) - 1
                for m in range(len(METRICS)):
                    values, at, sizes, _, _ = parts[m]
                    totals = np.diff(at[bounds])
                    packed = np.add.reduceat(sizes.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), starts) > 0
                    simple = (totals <= capacity(0, k)) & ~packed & ~hot & (np.arange(len(keys)) >= g) & (np.arange(len(keys)) < last)
                    calm = np.flatnonzero(simple & (totals > 0))
                    if keep_days:
                        calm = calm[:0]
                    if len(calm):
                        picked = np.repeat(at[bounds[calm]] - (np.cumsum(totals[calm]) - totals[calm]), totals[calm]) + np.arange(totals[calm].sum())
                        rows.exact(projects.take(pa.array(calm)), days.take(pa.array(calm)), m, values[picked], totals[calm])
                    for i in range(g, last):
                        if totals[i] and (keep_days or not simple[i]):
                            s = Sketch(k, _seed(METRICS[m], *keys[i]))
                            fold(s, m, bounds[i], bounds[i + 1])
                            give_day(keys[i], m, s, hot[i])
                open_hot = bool(hot[last])
                open_key, open_day = keys[last], [Sketch(k, _seed(x, *keys[last])) for x in METRICS]
                for m in range(len(METRICS)):
                    fold(open_day[m], m, bounds[last], bounds[last + 1])
            if not keep_days:
                changes = [0, *(i for i in range(1, len(keys)) if keys[i][0] != keys[i - 1][0]), len(keys)]
                for lo, hi in zip(changes, changes[1:]):
                    if not whole or keys[lo][0] != project:
                        close_project()
                        project, whole = keys[lo][0], [Sketch(k, _seed(x, keys[lo][0])) for x in METRICS]
                    for m in range(len(METRICS)):
                        fold(whole[m], m, bounds[lo], bounds[hi])
            yield from rows.take()
        close_day()
        close_project()
        yield from rows.take()

    return run


def _merge_parts(k: int, keep: bool = False):
    """Sketches of one project, metric and day (null: all days), from tasks or days, to its percentiles, or with ``keep`` to one sketch."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, metric, day = (x.as_py() for x in key)
        s = Sketch(k, _seed(METRICS[metric], project) if day is None else _seed(METRICS[metric], project, day))
        for batch in batches:
            for r in batch.to_pylist():
                s.merge(*_read_part(r["sizes"], np.array(r["items"]), r["compactions"], r["tops"]))
        rows = _Rows()
        rows.part(project, metric, s, day) if keep else rows.day(project, day, metric, s)
        yield from (b if keep else b.select(["project_key", "run_day", "metric", "n", "p", "e"]) for b in rows.take())

    return run


_DONE = f"{_KEY}, metric int, n bigint, p array<double>, e array<double>"


def _sorted_parts(calibration: DataFrame, k: int) -> DataFrame:
    """Partial sketches, each project's together and sorted by day; a hot project is spread over slots."""
    spark = calibration.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    days = written(calibration.groupBy("project_key", "run_day").agg(F.count("*").alias("rows")), "days")
    projects = days.groupBy("project_key").agg(F.sum("rows").alias("rows"))
    total = projects.agg(F.sum("rows")).first()[0] or 0
    # A project, or one day of it, is hot from half a task's share on, so there are at most twice as many as tasks.
    is_large = F.col("rows") * (2 * tasks) > total
    hot = [r["project_key"] for r in projects.filter(is_large).collect()]
    is_hot = F.coalesce(F.col("project_key").isin([h for h in hot if h is not None]), F.lit(None in hot))
    one_day = F.concat_ws("|", F.coalesce("project_key", F.lit("\x00")), F.coalesce(F.col("run_day").cast("string"), F.lit("\x00")))
    hot_days = [r["d"] for r in days.filter(is_large).select(one_day.alias("d")).collect()]
    key = F.coalesce(F.col("batch_no").cast("string"), F.concat(F.lit("row "), F.xxhash64("project_key", "module_id", "run_day", "received_at", *METRICS).cast("string")))
    kept = calibration.select("project_key", "run_day", "received_at", key.alias("batch"), *(F.col(m).cast("array<double>").alias(m) for m in METRICS))
    columns = [f"{m}_{c}" for m in range(len(METRICS)) for c in ("mode", "packed")]
    kept = kept.mapInArrow(_pack_batches, f"{_KEY}, received_at {kept.schema['received_at'].dataType.simpleString()}, batch string, " + ", ".join(f"{m}_mode tinyint, {m}_packed binary" for m in range(len(METRICS))))
    kept = last_delivery(kept, ["batch"], "received_at", ["project_key", "run_day", *columns])
    # A hot project is dealt by day. A hot day is dealt by batch, to slots from HOT_SLOT on; its sketches then meet once more.
    slot = F.when(one_day.isin(hot_days), HOT_SLOT + F.pmod(F.xxhash64("batch"), F.lit(tasks))).when(is_hot, F.pmod(F.xxhash64("run_day"), F.lit(tasks))).otherwise(F.lit(0))
    kept = kept.withColumn("slot", slot.cast("int"))
    moved = ", ".join(f"{m}_{c}" for m in range(len(METRICS)) for c in _MOVED.split(", "))
    parts = kept.select("project_key", "run_day", "slot", *columns).mapInArrow(_partial(k), f"{_KEY}, slot int, {moved}")
    return parts.repartition(tasks, "project_key", "slot").sortWithinPartitions("project_key", "run_day")


def _merged(parts: DataFrame, k: int, keep: bool = False) -> DataFrame:
    """Parts of the same project, metric and day made one; a group has at most a part a task or day."""
    return parts.select("project_key", "metric", "run_day", *_NAMES).groupBy("project_key", "metric", "run_day").applyInArrow(_merge_parts(k, keep), _RESULT if keep else _DONE)


def day_sketches(calibration: DataFrame, k: int = K) -> DataFrame:
    """One mergeable sketch a project, day and metric: project_key, run_day, metric, n, sizes, items, compactions, tops."""
    found = written(_sorted_parts(calibration, k).mapInArrow(_merge_days(k, True), _RESULT), "sketches")
    hot = found.filter(F.col("metric") >= OF_DAY).withColumn("metric", F.col("metric") - OF_DAY)
    return found.filter(F.col("metric") < OF_DAY).unionByName(_merged(hot, k, keep=True)).drop("p", "e")


def merge_sketches(sketches: DataFrame, k: int = K) -> DataFrame:
    """Percentiles of a project and metric over all given days, from stored day sketches."""
    return _named(_merged(sketches.withColumn("run_day", F.lit(None).cast("date")), k))


def _named(rows: DataFrame) -> DataFrame:
    metric = F.element_at(F.array(*map(F.lit, METRICS)), F.col("metric") + 1)
    names = [f"p{round(q * 100)}" for q in QUANTILES]
    return rows.select("project_key", "run_day", metric.alias("metric"), "n", *(F.col("p")[i].alias(x) for i, x in enumerate(names)), *(F.col("e")[i].alias(f"{x}_rank_error") for i, x in enumerate(names)))


def percentiles(calibration: DataFrame, k: int = K) -> DataFrame:
    """Percentiles of the three metrics for each project and day, and (run_day null) for all days of a project.

    Of each batch_no the last delivery counts; a null batch_no makes each distinct row
    a batch. Elements that are null, NaN, infinite or negative are no measurement;
    groups without one give no row. A percentile q is the value of ceiling rank
    ceil((n-1)q). pNN_rank_error bounds its rank error with probability 1 - DELTA; it
    is 0 for a group that was never compacted (up to 2*K*SECTIONS values).
    """
    found = written(_sorted_parts(calibration, k).mapInArrow(_merge_days(k, False), _RESULT), "quantiles")
    days = found.filter(F.col("p").isNotNull()).select("project_key", "run_day", "metric", "n", "p", "e")
    parts = found.filter(F.col("p").isNull())
    projects = parts.filter(F.col("metric") < OF_DAY)
    hot = parts.filter(F.col("metric") >= OF_DAY).withColumn("metric", F.col("metric") - OF_DAY)
    return _named(days.unionByName(_merged(projects, k)).unionByName(_merged(hot, k)))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(load(spark, sf_dir, "calibration"))


def p5_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all days of a project from its stored day sketches."""
    days = written(day_sketches(load(spark, sf_dir, "calibration")), "days")
    return merge_sketches(days)


def p5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of groups that are small enough never to be compacted, which are exact; days and all days of a project."""
    found = p5_percentiles(spark, sf_dir).filter(F.col("n") <= capacity(0, K))
    return found.select("project_key", "run_day", "metric", "n", *(f"p{round(q * 100)}" for q in QUANTILES), *(F.col(f"p{round(q * 100)}_rank_error") for q in QUANTILES))


QUERIES = {"p5_percentiles": p5_percentiles, "p5_combined": p5_combined, "p5_exact": p5_exact}
_ALL_SQL = " union all ".join(f"select project_key, run_day, '{m}' metric, unnest({m}) v from b" for m in METRICS)
_PICKS = ", ".join(f"list_sort(list(v))[ceil((count(*) - 1) * {q}::double)::int + 1] p{round(q * 100)}" for q in QUANTILES)
_NO_ERROR = ", ".join(f"0.0::double p{round(q * 100)}_rank_error" for q in QUANTILES)
SQL = {
    "p5_exact": f"""
with b as (select * from (select *, row_number() over (partition by coalesce(batch_no::varchar, 'row ' || hash(project_key, module_id, run_day, received_at, function_scores, cyclomatic_complexities, cognitive_complexities)) order by received_at desc nulls last) rn from calibration) where rn = 1),
e as (select * from ({_ALL_SQL}) where v is not null and not isnan(v) and v >= 0 and v < 'infinity'::double),
g as (select project_key, run_day, metric, count(*) n, {_PICKS} from e group by 1, 2, 3 union all select project_key, null, metric, count(*), {_PICKS} from e group by 1, 3)
select *, {_NO_ERROR} from g where n <= {capacity(0, K)}""",
}
