"""Rankings and how well they find labelled outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written


def ranked(df: DataFrame, keys: list[str], score: str, tie: str, name: str = "position", parts: int | None = None) -> DataFrame:
    """Zero-based position by (score falling, nulls last, tie rising) and n of each group.

    Rows are sorted in ranges of (group, score, tie) over all tasks and numbered there;
    the ranges' sizes give the offsets. A group of any size, or a score that most of its
    rows share, is so ranked by many tasks.
    """
    k = F.struct(*(F.col(c) for c in keys)) if keys else F.struct(F.lit(1).alias("_"))
    order = [F.col("_k"), F.col(score).desc_nulls_last(), F.col(tie)]
    rows = df.withColumn("_k", k)
    # The upper bits of the number are the range's, the lower ones count its rows in order.
    rows = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows, "ranked").withColumn("_part", F.shiftright("_id", 33))
    sums = rows.groupBy("_k", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_s"))
    run = Window.partitionBy("_k").orderBy("_part")
    sums = sums.select("_k", "_part", "_first", (F.sum("_s").over(run) - F.col("_s")).alias("_base"), F.sum("_s").over(Window.partitionBy("_k")).alias("n"))
    joined = rows.join(sums, ["_k", "_part"])
    return joined.select(*df.columns, (F.col("_base") + F.col("_id") - F.col("_first")).alias(name), "n")


def ranking_metrics(rows: DataFrame, keys: list[str], relevant: str, top: int = 10) -> DataFrame:
    """Of ranked rows: precision and recall at ``top``, mean percentile rank of the relevant, and lift of the top quarter.

    Percentile rank is (1 - position / (n - 1)) * 100, and 100 for a single row. The
    quarter is ceil(n / 4) rows. Rates without relevant rows are null; status tells
    no-scores, no-labels or validated.
    """
    p, n, hit = F.col("position"), F.col("n"), F.col(relevant)
    quarter = F.greatest(F.ceil(n / 4), F.lit(1))
    rank = F.when(n == 1, 100.0).otherwise((1 - p / (n - 1)) * 100)
    a = rows.groupBy(*keys).agg(
        F.count("*").alias("n_ranked"), F.count_if(hit).alias("n_relevant"), F.count_if(hit & (p < top)).alias("_top"), F.sum(F.when(hit, rank.cast("decimal(30,10)"))).alias("_rank"), F.count_if(hit & (p < quarter)).alias("_q"), F.max(quarter).alias("_quarter")
    )
    some = F.nullif(F.col("n_relevant"), F.lit(0))
    share = F.col("_q") / some
    return a.select(
        *keys, "n_ranked", "n_relevant",
        F.when(F.col("n_relevant") > 0, F.col("_top") / F.least(F.col("n_ranked"), F.lit(top))).alias("precision_at_top"),
        F.try_divide("_top", some).alias("recall_at_top"),
        F.try_divide(F.col("_rank").cast("double"), some).alias("mean_percentile_rank"),
        (share / (F.col("_quarter") / F.col("n_ranked"))).alias("quarter_lift"),
        F.when(F.col("n_relevant") == 0, "no-labels").otherwise("validated").alias("status"),
    )


def top_k(df: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    """The k rows with the greatest score; every task keeps k rows, no sort of the whole."""
    return df.orderBy(F.col(score).desc_nulls_last(), *ties).limit(k)


#: Order of the rows of each report: columns, falling ones with a minus; nulls come last, or (with ?) count as -1.
ORDERS = {
    "escape-hatches": ["-score", "-total_count", "module_id"],
    "type-health": ["-structural_risk?", "-observed_method_count", "-field_count", "package_name", "target_name", "qualified_name", "path", "line"],
    "api-health": ["-missing_docs", "module_id"],
    "reliability": ["path", "line", "rule_id"],
    "architecture-rules": ["rule_id", "source", "target"],
    "outcomes": ["commit", "kind"],
    "consolidation": ["-leverage", "id"],
    "expansion-sites": ["path", "line", "column"],
}


def in_report_order(rows: DataFrame, report: str) -> DataFrame:
    """Rows in the order of their report, sorted in ranges by all tasks."""
    keys = []
    for name in ORDERS[report]:
        c = F.col(name.strip("-?"))
        c = F.coalesce(c, F.lit(-1)) if name.endswith("?") else c
        keys.append(c.desc_nulls_last() if name.startswith("-") else c.asc_nulls_last())
    return rows.orderBy(*keys)


def canonical_order(rows: DataFrame) -> DataFrame:
    """Rows in the order of their canonical JSON (fields by name)."""
    return rows.orderBy(F.to_json(F.struct(*sorted(rows.columns))))
