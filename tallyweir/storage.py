"""Tables written between the steps of an iterative operator.

They go to the shared folder named by ``spark.checkpoint.dir``, so they outlive
any executor, cut the lineage and are read back as columnar, prunable parquet.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for an unset local master."""
    conf = spark.sparkContext.getConf()
    path = conf.get(SHARED_DIR)
    if path:
        return path.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {SHARED_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallyweir-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as parquet in the shared folder and return a DataFrame that reads it.

    The folder is removed when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
    finally:  # the file system only marks what exists
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
