"""Version-control logs as tables.

The line-oriented logs are read with the commit header as record separator, so a log
is split among tasks at commit borders and no state runs from line to line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import outcome_kinds, path_module_key, slashes

HEADER = "commit:"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a commit: head (the rest of its header line) and body (array of further lines)."""
    raw = spark.read.option("lineSep", "\n" + HEADER).text(path)
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), f"^{HEADER}", "")
    lines = F.split(text, "\n")
    return raw.select(F.get(lines, F.lit(0)).alias("head"), F.slice(lines, 2, 1 << 30).alias("body")).filter("head <> ''")


def _field(head: Column, i: int) -> Column:
    return F.coalesce(F.get(F.split(head, "\t", 3), F.lit(i)), F.lit(""))


def numstat_log(spark: SparkSession, path: str) -> DataFrame:
    """hash, author, subject, path, added, deleted of ``commit:%H<tab>%an<tab>%s`` logs with --numstat.

    Binary files (-) have 0 lines; rows of less than three fields are no change. A
    commit without changes has one row with a null path.
    """
    changes = F.filter(F.transform("body", lambda l: F.split(l, "\t")), lambda p: F.size(p) >= 3)
    rows = read_records(spark, path).select(*(_field(F.col("head"), i).alias(n) for i, n in enumerate(("hash", "author", "subject"))), F.explode_outer(changes).alias("c"))
    number = lambda i: F.coalesce(F.get("c", F.lit(i)).try_cast("bigint"), F.lit(0))
    return rows.select("hash", "author", "subject", slashes(F.get("c", F.lit(2))).alias("path"), F.when(F.col("c").isNotNull(), number(0)).alias("added"), F.when(F.col("c").isNotNull(), number(1)).alias("deleted"))


def numstat_z(spark: SparkSession, path: str) -> DataFrame:
    """path and churn of NUL-separated numstat rows; a row that isn't one fails the read."""
    rows = spark.read.option("lineSep", "\x00").text(path).filter("value <> ''").select(F.split("value", "\t", 3).alias("c"))
    good = (F.size("c") == 3) & F.get("c", F.lit(0)).rlike(r"^\d+$") & F.get("c", F.lit(1)).rlike(r"^\d+$")
    part = lambda i: F.when(good, F.get("c", F.lit(i))).otherwise(F.raise_error(F.concat(F.lit("not a numstat row: "), F.array_join("c", " "))))
    return rows.select(part(2).alias("path"), (part(0).cast("bigint") + part(1).cast("bigint")).alias("churn")).groupBy("path").agg(F.sum("churn").alias("churn"))


def outcome_log(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of ``commit:%H<tab>%cI<tab>%s`` logs with --name-only: one row a commit and kind.

    commit, timestamp, kind, subject, paths and the modules of .rs paths (sorted,
    distinct). These are inferred, so a review is required.
    """
    paths = F.array_sort(F.array_distinct(F.transform(F.filter("body", lambda l: F.trim(l) != ""), lambda l: slashes(F.trim(l)))))
    rows = read_records(spark, path).select(*(_field(F.col("head"), i).alias(n) for i, n in enumerate(("commit", "timestamp", "subject"))), paths.alias("paths"))
    modules = F.array_sort(F.array_distinct(F.transform(F.filter("paths", lambda p: p.endswith(".rs")), lambda p: path_module_key(p))))
    return rows.filter("commit <> ''").select("commit", "timestamp", F.explode(outcome_kinds(F.col("subject"))).alias("kind"), "subject", "paths", modules.alias("modules"), F.lit("repository-inferred").alias("evidence_class"), F.lit(True).alias("review_required"))


def parse_nul_log(text: str) -> Iterator[tuple[str, str, int, list[str]]]:
    """Commits of a log framed by NULs: hash, author, epoch seconds, paths. Raises on a broken frame."""
    tokens = text.split("\x00")
    at = 0
    while at < len(tokens):
        if not tokens[at]:
            at += 1
            continue
        head = tokens[at : at + 4]
        if len(head[0]) < 40 or any(c not in "0123456789abcdefABCDEF" for c in head[0]):
            raise ValueError("not a commit header")
        if len(head) < 4 or not head[1] or head[3] or not head[2].lstrip("-").isdigit():
            raise ValueError(f"incomplete header of {head[0]}")
        at += 4
        paths = []
        while at < len(tokens) and tokens[at]:
            name = tokens[at] if paths else tokens[at].removeprefix("\n")
            if not name:
                raise ValueError(f"empty path in {head[0]}")
            paths.append(name)
            at += 1
        yield head[0], head[1], int(head[2]), paths


def nul_log(spark: SparkSession, path: str) -> DataFrame:
    """hash, author, committed_at and paths of NUL-framed logs, one file a task.

    The frame has no separator that a reader could split at; logs are one file a
    repository, so repositories are read in parallel.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                yield pd.DataFrame(list(parse_nul_log(text)), columns=["hash", "author", "epoch", "paths"])

    rows = spark.read.text(path, wholetext=True).mapInPandas(run, "hash string, author string, epoch bigint, paths array<string>")
    return rows.select("hash", "author", F.timestamp_seconds("epoch").alias("committed_at"), "paths")
