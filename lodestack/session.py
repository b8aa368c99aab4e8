"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


_kept: dict[str, tuple] = {}


def get_session(app: str = "lodestack", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one in ``spark.checkpoint.dir``; only where neither that setting nor a
    folder of the context exists (single-machine runs, tests) a folder of its own is made."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="lodestack-", dir=os.environ.get("TMPDIR"))
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that its lineage ends here."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: lineage ends here, and what reads it reads only its columns.

    Smaller than a checkpoint of texts; the table is deleted by :func:`release`, or when the application ends.
    """
    spark = df.sparkSession
    folder = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    _kept[folder] = path, files = _path(spark, folder)
    files.deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(folder)
    table.lodestack_folder = folder
    return table


def release(table: DataFrame) -> None:
    """Delete a table of :func:`keep` that nothing reads any more."""
    folder = getattr(table, "lodestack_folder", None)
    if folder in _kept:
        path, files = _kept.pop(folder)
        files.delete(path, True)


def sweep(spark: SparkSession, rdd: RDD | None = None) -> None:
    """Delete the shuffle files below ``rdd``, which nothing may read again, and those of plans that nothing holds any more;
    else they stay until the driver happens to collect its garbage."""
    if rdd is not None:
        rdd._jrdd.rdd().cleanShuffleDependencies(True)
    gc.collect()
    for _ in range(2):  # what just ended is still held by events on their way
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def _path(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
