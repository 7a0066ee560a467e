"""Session factory with the settings that the engine expects."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides, dots written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows of an Arrow batch: texts are wide, and a batch exists several times on its way to Python.
BATCH_ROWS = "500"


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, with batches fit for texts.

    Enough where executors see the driver's folders; elsewhere install the package or
    send it with ``--py-files``.  A batch size that the session was given, or any other than
    Spark's own, is left alone.
    """
    stated = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(stated) == "10000" and not spark.sparkContext.getConf().contains(stated):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deal out a scan that has fewer partitions than the session has cores; larger ones stay as they are.

    For small files only: one row group is one task, however many cores are idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checked_broadcast(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A table to be broadcast if it has at most ``rows`` rows; a larger one is left to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
