"""Table loading and the rule that the last delivery of a thing counts alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have in any spelling."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def last_delivery(df: DataFrame, key: Sequence[str | Column], at: str, content: Sequence[str] | None = None) -> DataFrame:
    """Keep, of each key, the row with the greatest ``at``.

    A null ``at`` counts as the oldest. Rows that tie are ordered by a hash of
    ``content`` (all columns of hashable type if not given), so the choice does not
    depend on the order of input; exact repeats collapse to one. Rows with a null in
    the key form a group of their own, like any other value.

    The rows of a key are streamed through one sort; nothing is collected, and a key
    here is one delivered thing, so its group is the number of its deliveries.
    """
    content = content or [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    rn = fresh_name(df, "_rn")
    window = Window.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*content).desc())
    return df.withColumn(rn, F.row_number().over(window)).filter(F.col(rn) == 1).drop(rn)
