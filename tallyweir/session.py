"""SparkSession factory used by the bench, the tests and stand-alone runs."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build_session(cpus: int | None = None, app: str = "tallyweir", **extra: str) -> SparkSession:
    """A session with the settings the operators rely on.

    What spark-submit (or a running context) has set stays: the master, memory, the
    number of shuffle partitions and ``spark.checkpoint.dir``. Only what is unset is
    filled in, for a run on this machine; ``extra`` goes before both.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    given = SparkConf()  # what spark-submit and the defaults file say
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if given.get("spark.master", "local").startswith("local"):
        settings |= {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        if given.get(key) is None:
            builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
