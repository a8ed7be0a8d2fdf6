"""Duplicate code: token windows, equal bodies, equal responsibilities."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import percent, round2
from ..functions.text import KEYWORDS, TOKEN
from ..storage import written
from .joins import contained_semi_join
from .review import declares
from .windows import non_overlapping

WINDOW_TOKENS = 50
LEAST_WINDOW_LINES = 3
LEAST_LINES = 5


_PATTERN, _DIGITS = re.compile("(" + TOKEN.replace(r"\p{Nd}", r"\d") + ")|(\n)"), re.compile(r"[0-9]+")
_KEPT = frozenset(KEYWORDS)


def normal_tokens(content: str) -> tuple[list[str], list[int]]:
    """The normalised tokens of a text and the line of each."""
    tokens, lines, line = [], [], 1
    for token, end in _PATTERN.findall(content):
        if end:
            line += 1
            continue
        first = token[0]
        tokens.append(token if token in _KEPT else "LIT" if _DIGITS.fullmatch(token) else "ID" if (first.isascii() and first.isalpha()) or first == "_" else token)
        lines.append(line)
    return tokens, lines


def file_windows(files: DataFrame, file: str, text: str, size: int = WINDOW_TOKENS, least_lines: int = LEAST_WINDOW_LINES) -> DataFrame:
    """file, at, window_hash, first_line, last_line of every window of normalised tokens over enough lines.

    A text is tokenised once; a window is a slice of the joined tokens, and only its
    16-byte hash leaves the task. Null texts and texts of fewer tokens have none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(1).to_pylist()):
                tokens, lines = normal_tokens(content or "")
                n = len(tokens) - size + 1
                if n < 1:
                    continue
                joined = "|".join(tokens)
                starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])]).tolist()
                at = [k for k in range(n) if lines[k + size - 1] - lines[k] + 1 >= least_lines]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))), pa.array(at, pa.int64()),
                    pa.array([hashlib.md5(joined[starts[k] : starts[k + size] - 1].encode(), usedforsecurity=False).hexdigest() for k in at], pa.string()),
                    pa.array([lines[k] for k in at], pa.int64()), pa.array([lines[k + size - 1] for k in at], pa.int64()),
                ], names=[file, "at", "window_hash", "first_line", "last_line"])

    return files.select(file, text).mapInArrow(run, f"`{file}` {files.schema[file].dataType.simpleString()}, at bigint, window_hash string, first_line bigint, last_line bigint")


def window_groups(windows: DataFrame, file: str) -> DataFrame:
    """Hashes that occur more than once: n_windows, n_files, longest span; score 5 a window."""
    return (
        windows.groupBy("window_hash")
        .agg(F.count("*").alias("n_windows"), F.countDistinct(file).alias("n_files"), F.max(F.col("last_line") - F.col("first_line") + 1).alias("span"))
        .filter("n_windows >= 2")
        .withColumn("score", (F.col("n_windows") * 5).cast("double"))
    )


def within_functions(windows: DataFrame, file: str, spans: DataFrame) -> DataFrame:
    """Windows whose lines lie inside one function; ``spans``: file, start_line, end_line."""
    own = spans.select(F.col(file).alias("_f"), F.col("start_line").alias("_lo"), F.col("end_line").alias("_hi"))
    return contained_semi_join(windows, "first_line", "last_line", own, "_lo", "_hi", [(file, "_f")], 64)


def disjoint_instances(windows: DataFrame, file: str) -> DataFrame:
    """Of each hash and file, the windows that don't overlap, taken greedily from the top; hashes with less than two are dropped."""
    windows = written(windows.select(file, "at", "window_hash", "first_line", "last_line"), "windows")  # read twice, tokenised once
    repeated = windows.groupBy("window_hash").agg(F.count("*").alias("_n")).filter("_n >= 2").select("window_hash")
    own = windows.join(repeated, "window_hash", "left_semi")
    picked = non_overlapping(own, ["window_hash", file], "first_line", "last_line")
    enough = picked.groupBy("window_hash").agg(F.count("*").alias("_n")).filter("_n >= 2").select("window_hash")
    return picked.join(enough, "window_hash", "left_semi")


def window_texts(files: DataFrame, file: str, text: str, places: DataFrame, size: int = WINDOW_TOKENS) -> DataFrame:
    """window_hash and its normalised tokens joined by bars; ``places`` names one place (file, at) of each hash."""
    per_file = places.groupBy(F.col(file).alias("_f")).agg(F.collect_list(F.struct("at", "window_hash")).alias("_p"))  # at most a place a token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, texts = [], []
            for content, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, _ = normal_tokens(content or "")
                for place in wanted:
                    hashes.append(place["window_hash"])
                    texts.append("|".join(tokens[place["at"] : place["at"] + size]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names=["window_hash", "window"])

    return files.join(per_file, F.col(file) == F.col("_f")).select(text, "_p").mapInArrow(run, "window_hash string, window string")


def absorb(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge groups (columns, in key order) whose every place (row) overlaps or touches: the first existing group that does absorbs the next.

    Returns the columns that stay, and their widened starts and ends.
    """
    n = starts.shape[1]
    kept, s, e = np.empty(n, np.int64), starts.copy(), ends.copy()
    found = 0
    for g in range(n):
        lo, hi = starts[:, g : g + 1], ends[:, g : g + 1]
        meets = ((s[:, :found] <= hi + 1) & (lo <= e[:, :found] + 1)).all(axis=0)
        at = int(meets.argmax()) if meets.any() else found
        if at == found:
            kept[found], s[:, found], e[:, found] = g, starts[:, g], ends[:, g]
            found += 1
        else:
            s[:, at], e[:, at] = np.minimum(s[:, at], starts[:, g]), np.maximum(e[:, at], ends[:, g])
    return kept[:found], s[:, :found], e[:, :found]


def coalesce_groups(instances: DataFrame, file: str, files: DataFrame, text: str) -> DataFrame:
    """Merge clone groups that run on into each other: group_id, file, first_line, last_line.

    Groups are taken in the order of their windows' text. One whose every instance
    overlaps or touches, place by place, that of an existing group is absorbed by the
    first such group, which grows. Only groups with the same files (as often) can meet,
    so each such family is merged by itself; it has at most as many groups as a file of
    it has tokens. Places of a family whose lines differ by a constant alone behave
    alike and are merged once, so a licence header in a million files is one column of
    numbers, not a million.
    """
    name = F.col(file).cast("string")
    ranked = instances.withColumn("_k", F.row_number().over(Window.partitionBy("window_hash", file).orderBy("first_line", "last_line")))
    ranked = written(ranked.select("window_hash", file, "at", "_k", "first_line", "last_line"), "instances")
    digest = [F.sum(F.xxhash64(name, F.lit(seed)).cast("decimal(20,0)")).cast("string") for seed in (1, 2)]
    groups = ranked.groupBy("window_hash").agg(F.concat_ws("/", F.count("*").cast("string"), *digest).alias("_family"), F.min(F.struct(F.col(file), F.col("at"))).alias("_one"))
    groups = written(groups.select("window_hash", "_family", F.col(f"_one.{file}").alias(file), "_one.at"), "groups")
    texts = window_texts(files, file, text, groups.select(file, "at", "window_hash"))
    order = Window.partitionBy("_family").orderBy("window")
    groups = written(groups.select("window_hash", "_family").join(texts, "window_hash").select("window_hash", "_family", (F.row_number().over(order) - 1).alias("_rank")), "families")
    places = ranked.join(groups, "window_hash").groupBy("_family", file, "_k").agg(F.min("first_line").alias("_base"), F.array_sort(F.collect_list(F.struct("_rank", F.col("first_line").alias("s"), F.col("last_line").alias("e")))).alias("_v"))
    rest = lambda c: F.transform("_v", lambda x: (x[c] - F.col("_base")).cast("int"))
    places = places.select("_family", file, "_base", rest("s").alias("s"), rest("e").alias("e")).withColumn("_sig", F.md5(F.to_json(F.struct("s", "e"))))
    places = written(places, "places")
    alike = places.groupBy("_family", "_sig").agg(F.first("s").alias("s"), F.first("e").alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def merged(family: str, rows: list) -> pd.DataFrame:
            kept, s, e = absorb(np.stack([r[1] for r in rows]), np.stack([r[2] for r in rows]))
            sigs = np.repeat(np.array([r[0] for r in rows], object), len(kept))
            return pd.DataFrame({"_family": family, "_sig": sigs, "_rank": np.tile(kept, len(rows)).astype(np.int32), "s": s.ravel().astype(np.int32), "e": e.ravel().astype(np.int32)})

        family, rows, out = None, [], []
        for pdf in batches:
            for f, sig, s, e in zip(pdf["_family"], pdf["_sig"], pdf["s"], pdf["e"]):
                if f != family and rows:
                    out.append(merged(family, rows))
                    rows = []
                family = f
                rows.append((sig, s, e))
            if out:
                yield pd.concat(out)
                out = []
        if rows:
            yield merged(family, rows)

    merged = alike.repartition("_family").sortWithinPartitions("_family", "_sig").mapInPandas(run, "_family string, _sig string, _rank int, s int, e int")
    found = merged.join(places.select("_family", "_sig", file, "_base"), ["_family", "_sig"]).join(groups, ["_family", "_rank"])
    return found.select(F.col("window_hash").alias("group_id"), file, (F.col("_base") + F.col("s")).alias("first_line"), (F.col("_base") + F.col("e")).alias("last_line"))


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def with_line_counts(instances: DataFrame, file: str, files: DataFrame, text: str) -> DataFrame:
    """Instances with nonblank (array of their lines that aren't blank) and code (whether a line does more than declare)."""
    lines = F.transform(F.split(text, "\n"), _stripped)
    own = files.select(F.col(file).alias("_f"), F.transform(lines, lambda c: F.when(c == "", 0).when(declares(c), 1).otherwise(2)).alias("_kinds"))
    n = F.col("last_line") - F.col("first_line") + 1
    kinds = F.slice("_kinds", F.col("first_line").cast("int"), n.cast("int"))
    joined = instances.join(own, F.col(file) == F.col("_f")).withColumn("_here", kinds)
    nonblank = F.filter(F.transform("_here", lambda k, i: F.when(k > 0, F.col("first_line") + i)), lambda x: x.isNotNull())
    return joined.select(*instances.columns, nonblank.alias("nonblank"), F.exists("_here", lambda k: k == 2).alias("code"))


def clone_rows(groups: DataFrame, file: str, files: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Token clones as rows, and their instances.

    Instances that only declare don't count; a row needs two of them and a span of five
    lines, and scores 5 an instance.
    """
    counted = written(with_line_counts(groups, file, files, text).filter("code"), "counted")
    n_files = F.countDistinct(file)
    rows = counted.groupBy("group_id").agg(F.count("*").alias("instance_count"), n_files.alias("file_count"), F.max(F.col("last_line") - F.col("first_line") + 1).alias("max_line_span")).filter(f"instance_count >= 2 and max_line_span >= {LEAST_LINES}")
    rows = rows.withColumns({"engine": F.lit("token"), "score": F.col("instance_count") * 5.0, "signals": F.when(F.col("file_count") >= 2, F.concat(F.lit("cross-file x"), F.col("file_count"))).otherwise("same-file repeat")})
    return rows, counted.join(rows.select("group_id"), "group_id", "left_semi")


def clone_summary(rows: DataFrame, instances: DataFrame, file: str, files: DataFrame, text: str) -> DataFrame:
    """One row: records, duplicated nonblank lines (each once), nonblank lines of all files, and the percentage."""
    lines = duplicated_lines(instances, file).agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("duplicated_line_count"))
    whole = files.agg(F.coalesce(F.sum(F.size(F.filter(F.split(text, "\n"), lambda c: _stripped(c) != ""))), F.lit(0)).alias("source_nonblank_line_count"))
    share = round2(percent(F.col("duplicated_line_count"), F.col("source_nonblank_line_count"), 0.0))
    return rows.agg(F.count("*").alias("record_count")).crossJoin(lines).crossJoin(whole).withColumn("duplication_percent", share)  # one row each


def equal_bodies(bodies: DataFrame, body: str, file: str, start: str, end: str, is_test: bool = False) -> DataFrame:
    """Bodies that occur twice or more over at least five lines.

    score = n * span, times 1.5 across files; test bodies: 2 * n * span.
    """
    span = F.col(end) - F.col(start) + 1
    found = bodies.filter(F.col(body).isNotNull()).groupBy(body).agg(F.count("*").alias("n"), F.countDistinct(file).alias("n_files"), F.max(span).alias("span")).filter(f"n >= 2 and span >= {LEAST_LINES}")
    factor = F.lit(2.0) if is_test else F.when(F.col("n_files") >= 2, 1.5).otherwise(1.0)
    return found.withColumn("score", F.col("n") * F.col("span") * factor)


def equal_responsibilities(modules: DataFrame, signature: str, api: str, functions: str) -> DataFrame:
    """Modules with one signature: n, and score n * (8 + max api + 1.5 * max functions)."""
    found = modules.groupBy(signature).agg(F.count("*").alias("n"), F.max(api).alias("max_api"), F.max(functions).alias("max_functions")).filter("n >= 2")
    return found.withColumn("score", F.col("n") * (8.0 + F.col("max_api") + 1.5 * F.col("max_functions")))


def duplicated_lines(instances: DataFrame, file: str) -> DataFrame:
    """Nonblank lines of each file that any instance covers, counted once: file, n_lines. ``instances`` come from with_line_counts."""
    return instances.select(file, F.explode("nonblank").alias("_l")).distinct().groupBy(file).agg(F.count("*").alias("n_lines"))


def source_bodies(bodies: DataFrame, sources: DataFrame, path: str = "file") -> DataFrame:
    """Bodies that lie in source files."""
    own = sources.select(F.col("path").alias("_p")).distinct()
    return bodies.join(own, F.col(path) == F.col("_p"), "left_semi")


def test_bodies(bodies: DataFrame, tests: DataFrame, path: str = "file", name: str = "qualified_name") -> DataFrame:
    """Bodies that are those of test functions, by path and name."""
    own = tests.select(F.col("path").alias("_p"), F.col("qualified_name").alias("_n")).distinct()
    return bodies.join(own, (F.col(path) == F.col("_p")) & (F.col(name) == F.col("_n")), "left_semi")


def all_engines(token: DataFrame, body: DataFrame, responsibility: DataFrame, test: DataFrame) -> DataFrame:
    """Clones of the four engines as engine, hash, instance_count, max_line_span and score."""
    parts = [
        token.select(F.lit("token").alias("engine"), F.col("group_id").alias("hash"), "instance_count", F.col("max_line_span").alias("max_line_span"), "score"),
        *(df.select(F.lit(engine).alias("engine"), F.col("body").alias("hash"), F.col("n").alias("instance_count"), F.col("span").alias("max_line_span"), "score") for engine, df in (("ast", body), ("test-ast", test))),
        responsibility.select(F.lit("module-responsibility").alias("engine"), F.col("signature").alias("hash"), F.col("n").alias("instance_count"), F.lit(None).cast("bigint").alias("max_line_span"), "score"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
