"""The whole scan: snapshots, candidates, selection, merge, comparison and report as one chain of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import candidates as cand
from kinfold.operators import greedy, pairs, report, verdicts, versions
from kinfold.plans import lifecycle
from kinfold.plans.config import Config
from kinfold.plans.lifecycle import SCAN, active_scan, latest_scans  # noqa: F401
from kinfold.sources.staging import stage
from kinfold.sources.state import SNAPSHOT, read_pairs, read_snapshots  # noqa: F401
from kinfold.sources.tables import Store

@dataclass
class Scan:
    snapshots: DataFrame
    pairs: DataFrame
    stats: DataFrame
    calls: DataFrame


def prepare(items: DataFrame, old_snapshots: DataFrame, old_pairs: DataFrame, number: int, now: int, config: Config = Config()) -> Scan:
    """Snapshots, candidates and selection of all categories that `items` holds; candidates stay open."""
    fresh = stage(versions.snapshots(items), "snapshots")
    gone = versions.stale_entries(old_snapshots, fresh)
    edited = versions.changed_entries(old_snapshots, fresh).where("change <> 'same'").select("entry")
    known = stage(pairs.invalidate(old_pairs, edited.unionByName(gone)), "pairs")
    # Texts are not written a second time where nothing is merged.
    merged = versions.first_snapshots(fresh, number, now) if old_snapshots.isEmpty() else stage(versions.merge_snapshots(old_snapshots, fresh, number, now), "snapshots")
    found = stage(pairs.classify(cand.candidates(fresh, config), known), "candidates")
    results = stage(greedy.select_pairs(found, config.item_limit, config.budget), "results")
    now_pairs = stage(pairs.merge(found, results, known, number, now), "pairs")
    calls = now_pairs.select("category").limit(0).withColumns({"calls": F.lit(0).cast("long"), "errors": F.lit(0).cast("long")})
    return Scan(merged, now_pairs, pairs.scan_stats(results), calls)


def compare(done: Scan, number: int, now: int, config: Config = Config(), comparator: verdicts.Comparator = verdicts.local_comparator) -> Scan:
    """The scan with a verdict of every open candidate of its own, asked for in batches."""
    numbered = stage(pairs.batches(done.pairs, number, config.batch).repartition("category", "batch"), "batches")
    answers = stage(verdicts.compare(numbered, done.snapshots, comparator), "verdicts")
    return Scan(done.snapshots, stage(verdicts.apply_verdicts(done.pairs, answers, now), "pairs"), done.stats, verdicts.verdict_stats(answers))


def scan(items: DataFrame, old_snapshots: DataFrame, old_pairs: DataFrame, number: int, now: int, config: Config = Config(), comparator: verdicts.Comparator | None = verdicts.local_comparator) -> Scan:
    """One scan of all categories that `items` holds; without a comparator, candidates stay open."""
    done = prepare(items, old_snapshots, old_pairs, number, now, config)
    return done if comparator is None else compare(done, number, now, config, comparator)


def run(spark: SparkSession, root: str, items: DataFrame, number: int, now: int, config: Config = Config(), comparator: verdicts.Comparator | None = verdicts.local_comparator) -> Scan:
    """A scan over the state kept under `root`; its results become the current versions."""
    store = Store(spark, root)
    done = scan(items, read_snapshots(store), read_pairs(store), number, now, config, comparator)
    return Scan(store.write("snapshot", done.snapshots), store.write("pair", done.pairs), done.stats, done.calls)


def queue_scan(spark: SparkSession, root: str, category: str, now: int) -> int:
    """The id of the category's scan in flight, else of a new queued one."""
    store = Store(spark, root)
    scans = store.read("scan", SCAN)
    active = active_scan(scans, category).first()
    if active:
        return active["id"]
    scans = store.write("scan", lifecycle.queue(scans, spark.createDataFrame([(category,)], "category string"), now))
    return active_scan(scans, category).first()["id"]


def run_queued(spark: SparkSession, root: str, scan_id: int, items: DataFrame, now: int, config: Config = Config(), comparator: verdicts.Comparator | None = verdicts.local_comparator) -> Scan | None:
    """Run a queued scan over its category's items, with its states and counters in the scan table.

    A failure is written to the scan and raised again. Between generating and
    comparing the scan table is read anew: a scan that was ended meanwhile takes no verdicts.
    """
    store = Store(spark, root)
    change = lambda f, *args, **named: store.write("scan", f(store.read("scan", SCAN), *args, **named))
    row = store.read("scan", SCAN).where(F.col("id") == scan_id).first()
    if row is None or row["status"] not in lifecycle.ACTIVE:
        return None
    try:
        change(lifecycle.start, scan_id, now)
        own = items.where(F.col("category") == row["category"])
        done = prepare(own, read_snapshots(store), read_pairs(store), scan_id, now, config)
        done = Scan(store.write("snapshot", done.snapshots), store.write("pair", done.pairs), done.stats, done.calls)
        total = done.snapshots.where(F.col("category") == row["category"]).count()
        change(lifecycle.step, scan_id, now, totalquestions=total, processedquestions=total, status="comparing", phase="semantic")
        change(lifecycle.refresh, done.pairs, now)
        waiting = lifecycle.comparable(spark.createDataFrame([(scan_id,)], "scan long"), store.read("scan", SCAN))
        if comparator is not None and not waiting.isEmpty():
            done = compare(done, scan_id, now, config, comparator)
            done = Scan(done.snapshots, store.write("pair", done.pairs), done.stats, done.calls)
            counts = done.calls.agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors")).first()
            change(lifecycle.step, scan_id, now, aicalls=row["aicalls"] + (counts["calls"] or 0), aierrors=row["aierrors"] + (counts["errors"] or 0))
            change(lifecycle.refresh, done.pairs, now)
        return done
    except Exception as e:
        change(lifecycle.fail, scan_id, str(e) or type(e).__name__, now)
        raise


def numbered(pair_table: DataFrame) -> DataFrame:
    """`pair_table` with a stable id for the report's last tie-break."""
    return pair_table.withColumn("id", F.xxhash64("category", "a", "b"))


def report_page(done: Scan, number: int, page: int = 0, show_all: bool = False) -> DataFrame:
    return report.page(report.report(numbered(done.pairs), done.snapshots, number, show_all), page)
