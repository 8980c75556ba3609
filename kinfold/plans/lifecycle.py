"""The life of a scan as rows of a scan table: queued, running, comparing, completed (with errors or not) or failed.

Every step takes the whole table and returns the next one, so that a step is one
plan over many scans and can be written as a new version of the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "running", "comparing")
#: Only scans in these states take verdicts.
COMPARABLE = ("running", "comparing")
COUNTERS = ("totalquestions", "processedquestions", "totalcandidates", "processedcandidates", "aicalls", "aierrors")
SCAN = f"id long, category string, status string, phase string, {', '.join(f'{c} long' for c in COUNTERS)}, message string, timecreated long, timestarted long, timefinished long, timemodified long"


def _at(value: int) -> Column:
    return F.lit(value).cast("long")


def active_scan(scans: DataFrame, category: str) -> DataFrame:
    """The scan in flight of a category, if any: a second one is not queued beside it."""
    return scans.where((F.col("category") == category) & F.col("status").isin(*ACTIVE)).orderBy("id").limit(1)


def latest_scans(scans: DataFrame) -> DataFrame:
    """The newest scan of each category."""
    return scans.groupBy("category").agg(F.max_by("status", "id").alias("status"), F.max("id").alias("id"))


def queue(scans: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """`scans` with a queued scan for each wanted category (column category) that has none in flight, in the order of categories.

    The new rows are ranked in one task: a request names categories, not items.
    """
    busy = scans.where(F.col("status").isin(*ACTIVE)).select("category")
    new = wanted.select("category").where("category IS NOT NULL").distinct().join(busy, "category", "left_anti")
    last = scans.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy("category"))).join(F.broadcast(last), how="inner", on=F.lit(True))
    zero = {c: F.lit(0).cast("long") for c in (*COUNTERS, "timestarted", "timefinished")}
    rows = numbered.withColumns({"id": F.col("last") + F.col("n"), "status": F.lit("queued"), "phase": F.lit("queued"), "message": F.lit(None).cast("string"), "timecreated": _at(now), "timemodified": _at(now), **zero})
    return scans.unionByName(rows.select(*scans.columns))


def step(scans: DataFrame, scan: int, now: int, **changes) -> DataFrame:
    """`scans` with columns of one scan changed."""
    own = F.col("id") == scan
    set_to = {c: F.when(own, F.lit(v).cast(scans.schema[c].dataType)).otherwise(F.col(c)) for c, v in {**changes, "timemodified": now}.items()}
    return scans.withColumns(set_to)


def start(scans: DataFrame, scan: int, now: int) -> DataFrame:
    """running, in its snapshot phase; a scan that is started again keeps when it began."""
    began = F.when((F.col("id") == scan) & (F.col("timestarted") == 0), _at(now)).otherwise(F.col("timestarted"))
    return step(scans, scan, now, status="running", phase="snapshot").withColumn("timestarted", began)


def fail(scans: DataFrame, scan: int, message: str, now: int) -> DataFrame:
    """failed with its message; a scan that has ended stays as it is."""
    open_ = scans.where((F.col("id") == scan) & F.col("status").isin(*ACTIVE)).isEmpty()
    return scans if open_ else step(scans, scan, now, status="failed", phase="failed", message=message, timefinished=now)


def refresh(scans: DataFrame, pairs: DataFrame, now: int) -> DataFrame:
    """`scans` with candidate counts from the pair table; comparing scans without open candidates end.

    Decided pairs do not count. Partial sums by scan id meet, so a scan of many pairs is no hot key.
    """
    counted = pairs.where(~F.col("state").isin("ignored", "notduplicate")).groupBy(F.col("lastscanid").alias("id")).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("state") == "candidate", 1)).alias("pending"))
    both = scans.join(counted, "id", "left").withColumns({"total": F.coalesce("total", F.lit(0)), "pending": F.coalesce("pending", F.lit(0))})
    ends = (F.col("status") == "comparing") & (F.col("pending") == 0)
    pick = lambda c, value: F.when(ends, value).otherwise(F.col(c)).alias(c)
    new = {
        "totalcandidates": F.col("total").alias("totalcandidates"), "processedcandidates": F.greatest(F.lit(0), F.col("total") - F.col("pending")).cast("long").alias("processedcandidates"),
        "status": pick("status", F.when(F.col("aierrors") > 0, "completedwitherrors").otherwise("completed")), "phase": pick("phase", F.lit("done")),
        "timefinished": pick("timefinished", _at(now)), "timemodified": _at(now).alias("timemodified"),
    }
    return both.select(*[new.get(c, F.col(c)) for c in scans.columns])


def comparable(batches: DataFrame, scans: DataFrame) -> DataFrame:
    """Batches (column scan) whose scan still takes verdicts; those of ended scans are nothing to do."""
    return batches.join(scans.where(F.col("status").isin(*COMPARABLE)).select(F.col("id").alias("scan")), "scan", "left_semi")
