"""Staged tables: written to the shared folder, reread; lineage ends there and lost executors cost nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inputs of fewer bytes are spread over all cores; larger ones are read as their files are split, without a shuffle.
SPREAD_BYTES = 64 << 20
#: Tables of ids of so many rows at most go to all executors.
SENT = 500_000
_UNITS = {"B": 0, "KiB": 10, "MiB": 20, "GiB": 30, "TiB": 40, "PiB": 50, "EiB": 60}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only in local mode, where nothing else is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{tempfile.gettempdir()}/kinfold-staging"
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/kinfold-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def sent(staged: DataFrame) -> DataFrame:
    """A staged table of ids; one of SENT rows at most goes to all executors, so that what it joins is not shuffled."""
    return F.broadcast(staged) if staged.count() <= SENT else staged


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more; other tables stay."""
    path = getattr(df, "_staged_path", None)
    if path:
        remove(df.sparkSession, path)


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of `df`: for files, what they hold."""
    plan = df.sparkSession.sql("EXPLAIN COST SELECT * FROM {df}", df=df).first()[0]
    found = re.search(r"sizeInBytes=([0-9.]+(?:E[+-]?[0-9]+)?) ([KMGTPE]?i?B)", plan)
    return int(float(found[1]) * (1 << _UNITS.get(found[2], 0))) if found else 1 << 60


def spread(df: DataFrame) -> DataFrame:
    """A small table (SPREAD_BYTES) of fewer files than cores over all cores, since its rows may be much work each; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < SPREAD_BYTES and len(df.inputFiles()) < cores else df
