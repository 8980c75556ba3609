"""The ranked, paged report and scan progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scoring import percent
from kinfold.plans.config import PAGE_SIZE


def reported(pairs: DataFrame, scan: int, show_all: bool = False) -> DataFrame:
    """A scan's pairs for the report: analysed and not unrelated, or with show_all all analysed and failed ones."""
    own = pairs.where(F.col("lastscanid") == scan)
    return own.where(F.col("state").isin("analysed", "aierror")) if show_all else own.where((F.col("state") == "analysed") & (F.col("classification") != "unrelated"))


def report(pairs: DataFrame, snaps: DataFrame, scan: int, show_all: bool = False) -> DataFrame:
    """Report rows with both snapshots' names and types; failed pairs show their error instead of a verdict. pairs needs id."""
    side = lambda x: snaps.select(F.col("entry").alias(x), F.col("name").alias(f"name_{x}"), F.col("qtype").alias(f"type_{x}"))
    failed = F.col("state") == "aierror"
    blank = lambda c: F.when(~failed, c)
    return reported(pairs, scan, show_all).join(side("a"), "a").join(side("b"), "b").select(
        "id", "a", "b", "name_a", "name_b", "type_a", "type_b", failed.alias("failed"), blank(F.col("classification")).alias("classification"),
        blank(F.round(F.col("confidence").cast("double") * 100).cast("int")).alias("confidence_percent"), blank(F.round(F.col("heuristicscore").cast("double") * 100).cast("int")).alias("heuristic_percent"),
        F.when(failed, F.col("aierror")).otherwise(F.col("reason")).alias("reason"), "confidence", "heuristicscore",
    )


def page(rows: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page in the order confidence, score (both descending, none last), id; a negative page is the first."""
    number = max(0, number)
    return rows.orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("heuristicscore"), "id").offset(number * size).limit(size)


def progress(pairs: DataFrame, scan: int) -> DataFrame:
    """total, pending, processed, percent, status, phase of a scan in its comparing phase; decided pairs do not count."""
    own = pairs.where((F.col("lastscanid") == scan) & ~F.col("state").isin("ignored", "notduplicate"))
    counts = own.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("state") == "candidate", 1)).alias("pending"), F.count(F.when(F.col("state") == "aierror", 1)).alias("errors"))
    done = F.col("pending") == 0
    processed = F.greatest(F.lit(0), F.col("total") - F.col("pending"))
    return counts.select(
        "total", "pending", processed.cast("long").alias("processed"), percent(processed, F.col("total"), done).alias("percent"),
        F.when(~done, "comparing").when(F.col("errors") > 0, "completedwitherrors").otherwise("completed").alias("status"), F.when(done, "done").otherwise("semantic").alias("phase"),
    )
