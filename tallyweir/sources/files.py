"""Source trees: listing, line counts and content fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import relative_to

PRUNED = (".git", ".direnv", "target")


def source_tree(spark: SparkSession, roots: list[str], glob: str = "*.rs") -> DataFrame:
    """path, text and length of each source file below the roots, once; pruned folders are left out.

    Listing and reading are Spark's; no file goes through the driver.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    path = F.regexp_replace("path", "^file:/*", "/")
    kept = raw.filter(~path.rlike("/(?:" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/"))
    return kept.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), "length").dropDuplicates(["path"])


def line_counts(files: DataFrame) -> DataFrame:
    """nonblank (not blank, not a // comment) and comment (// at the start) lines of each file; null for a null text."""
    lines = F.transform(F.split("text", "\n"), lambda l: F.trim(l))
    comment = F.filter(lines, lambda l: l.startswith("//"))
    code = F.filter(lines, lambda l: (l != "") & ~l.startswith("//"))
    known = F.col("text").isNotNull()
    return files.select("path", F.when(known, F.size(code)).cast("bigint").alias("source_nonblank_line_count"), F.when(known, F.size(comment)).cast("bigint").alias("source_comment_line_count"))


def content_fingerprint(files: DataFrame, root: str, buckets: int = 4096) -> tuple[str, int]:
    """Digest and number of files, over sorted (path, content hash).

    Hashes are folded in buckets of the path hash on the executors; the driver sees
    one digest a bucket, whatever the number of files.
    """
    each = files.select(relative_to(F.col("path"), root).alias("p"), F.sha2("text", 256).alias("h"))
    folded = each.groupBy(F.pmod(F.xxhash64("p"), F.lit(buckets)).alias("b")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("p", "h")))), 256).alias("d"), F.count("*").alias("n"))
    rows = sorted((r["b"], r["d"], r["n"]) for r in folded.collect())
    return hashlib.sha256("".join(f"{b}:{d}" for b, d, _ in rows).encode()).hexdigest(), sum(n for *_, n in rows)
