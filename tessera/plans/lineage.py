"""Cutting lineage so that iterative jobs survive the loss of executors.

A cut writes the rows as Parquet below ``spark.checkpoint.dir`` and reads them back.
Parquet, unlike an RDD checkpoint, is compressed, prunable, and carries the size that
lets the planner choose (or refuse) a broadcast.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a single-machine session (``local`` or ``local[...]``) that names none gets a
    temporary folder; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId in _ROOTS:
        return _ROOTS[sc.applicationId]
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/tessera-{sc.applicationId}"
    _ROOTS[sc.applicationId] = root
    atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; a stopped session leaves it in place."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` below the shared folder and return the written rows."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._tessera_path = path  # for drop()
    return kept


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; nothing may read it afterwards."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _remove(df.sparkSession, path)
