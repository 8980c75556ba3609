"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of fewer bytes are spread over all cores; larger ones are read as their files are split, without a shuffle.
SPREAD_BYTES = 64 << 20
_UNITS = {"B": 0, "KiB": 10, "MiB": 20, "GiB": 30, "TiB": 40, "PiB": 50, "EiB": 60}


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of `df`: for files, what they hold."""
    plan = df.sparkSession.sql("EXPLAIN COST SELECT * FROM {df}", df=df).first()[0]
    found = re.search(r"sizeInBytes=([0-9.]+(?:E[+-]?[0-9]+)?) ([KMGTPE]?i?B)", plan)
    return int(float(found[1]) * (1 << _UNITS.get(found[2], 0))) if found else 1 << 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one (SPREAD_BYTES) of fewer files than cores over all cores, since its rows are much work each."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < SPREAD_BYTES and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "kinfold-staging")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` as compressed Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more; other tables stay."""
    path = getattr(df, "_staged_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def hash_sample(df: DataFrame, total: int, want: int, *columns: str) -> DataFrame:
    """About 1.5 * want of the `total` rows, those of the smallest hashes of these columns; all if they are few.

    A filter only, so that a bounded choice among them does not see a row of each partition.
    """
    share = 1.5 * want / max(1, total)
    return df if share >= 1 else df.where(F.xxhash64(*columns) < F.lit(int(-(2**63) + share * 2**64)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int):
    """True where crc32 of doc_id as text leaves this remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
