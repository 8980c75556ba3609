"""Pair state: merging candidates with earlier verdicts and human decisions, invalidation, decisions, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.greedy import NEW, REUSED, STILL

KEY = ["category", "a", "b"]
DECISIONS = ("notduplicate", "ignored")
HEURISTICS = "struct<exact_normalized_text:boolean,same_answer_signature:boolean,same_question_type:boolean,token_jaccard:double>"
SCHEMA = f"category string, a long, b long, hasha string, hashb string, heuristicscore decimal(6,5), heuristics {HEURISTICS}, classification string, confidence decimal(6,5), reason string, evidence array<string>, state string, aierror string, lastscanid long, timecreated long, timemodified long"


def kind_of(state, same_hashes) -> F.Column:
    """What an existing pair does when it comes up again: still (ignored, or an unchanged notduplicate), reused (an unchanged verdict), new (anything else)."""
    return F.when(state == "ignored", STILL).when(same_hashes & (state == "notduplicate"), STILL).when(same_hashes & (state == "analysed"), REUSED).otherwise(NEW)


def classify(found: DataFrame, existing: DataFrame) -> DataFrame:
    """`found` (category, a, b, sourcehash_a, sourcehash_b, ...) with was (the existing state or null) and kind."""
    old = existing.select(*KEY, F.col("state").alias("was"), F.col("hasha").alias("old_a"), F.col("hashb").alias("old_b"))
    same = F.coalesce((F.col("old_a") == F.col("sourcehash_a")) & (F.col("old_b") == F.col("sourcehash_b")), F.lit(False))
    return found.join(old, KEY, "left").withColumn("kind", F.coalesce(kind_of(F.col("was"), same), F.lit(NEW))).drop("old_a", "old_b")


def merge(found: DataFrame, results: DataFrame, existing: DataFrame, scan: int, now: int) -> DataFrame:
    """The next pair table. found: scored candidates; results: category, a, b, result.

    active: (re)set to candidate, verdict cleared; reused and unchanged
    notduplicate: score, heuristics and scan refreshed; ignored, capped, budget
    and pairs that did not come up: untouched.
    """
    hit = results.where(F.col("result").isin("active", "reused", "still")).select(*KEY, "result")
    heuristics = F.struct(F.col("exact").alias("exact_normalized_text"), F.col("same_answer").alias("same_answer_signature"), F.col("same_type").alias("same_question_type"), F.round("jaccard", 5).alias("token_jaccard"))
    fresh = found.join(hit, KEY).select(*KEY, "result", "sourcehash_a", "sourcehash_b", F.col("score").cast("decimal(6,5)").alias("new_score"), heuristics.alias("new_heuristics"))
    both = existing.join(fresh, KEY, "full")
    active, kept = F.col("result") == "active", F.col("result").isNull() | ((F.col("result") == "still") & (F.col("state") == "ignored"))
    pick = lambda new, old: F.when(kept, F.col(old)).otherwise(new)
    cleared = lambda c: F.when(active, F.lit(None)).otherwise(F.col(c)).alias(c)
    at = lambda value: F.lit(value).cast("long")
    return both.select(
        *KEY, F.when(active, F.col("sourcehash_a")).otherwise(F.col("hasha")).alias("hasha"), F.when(active, F.col("sourcehash_b")).otherwise(F.col("hashb")).alias("hashb"),
        pick(F.col("new_score"), "heuristicscore").alias("heuristicscore"), pick(F.col("new_heuristics"), "heuristics").alias("heuristics"),
        *[cleared(c) for c in ("classification", "confidence", "reason", "evidence")], F.when(active, F.lit("candidate")).otherwise(F.col("state")).alias("state"), cleared("aierror"),
        pick(at(scan), "lastscanid").alias("lastscanid"), F.coalesce("timecreated", at(now)).alias("timecreated"), pick(at(now), "timemodified").alias("timemodified"),
    )


def invalidate(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """`pairs` without those, ignored ones excepted, that touch an entry, in any category: two anti-joins, no OR."""
    gone = entries.select("entry").distinct()
    rest = pairs.where(F.col("state") != "ignored")
    for side in ("a", "b"):
        rest = rest.join(gone.withColumnRenamed("entry", side), side, "left_anti")
    return rest.select(*pairs.columns).unionByName(pairs.where(F.col("state") == "ignored"))


def decide(pairs: DataFrame, decisions: DataFrame, now: int) -> DataFrame:
    """`pairs` under human decisions (category, a, b, decision); other words than notduplicate and ignored are refused."""
    bad = decisions.where(~F.col("decision").isin(*DECISIONS) | F.col("decision").isNull())
    if not bad.isEmpty():
        raise ValueError(f"a decision must be one of {DECISIONS}")
    joined = pairs.join(decisions.select(*KEY, "decision"), KEY, "left")
    return joined.withColumns({"state": F.coalesce("decision", "state"), "timemodified": F.when(F.col("decision").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("timemodified"))}).select(*pairs.columns)


#: Items a with ids of the same higher bits are counted together.
RANGE_BITS = 16


def batches(pairs: DataFrame, scan: int, size: int) -> DataFrame:
    """category, a, b, batch: this scan's candidates, by a and b, in batches of `size` within their category.

    A pair's place is its place at its item a, after the pairs of smaller items in
    the same range of ids, after those of smaller ranges. So no window holds a
    category's pairs: the largest hold a range's items, or a category's ranges.
    """
    waiting = pairs.where((F.col("state") == "candidate") & (F.col("lastscanid") == scan)).select(*KEY)
    items = waiting.groupBy("category", "a").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.shiftright("a", RANGE_BITS))
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = items.groupBy("category", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("category", "range", before(["category"], "range").alias("smaller"))
    places = items.select("category", "a", "range", before(["category", "range"], "a").alias("first")).join(ranges, ["category", "range"])
    own = F.row_number().over(Window.partitionBy("category", "a").orderBy("b")) - 1
    ranked = waiting.withColumn("own", own).join(places, ["category", "a"])
    return ranked.select(*KEY, F.floor((F.col("own") + F.col("first") + F.col("smaller")) / size).cast("long").alias("batch"))


def stale(pairs: DataFrame, snaps: DataFrame) -> DataFrame:
    """category, a, b of candidates one of whose snapshots is missing or in another category."""
    side = lambda x: snaps.select(F.col("entry").alias(x), F.col("category").alias(f"category_{x}"))
    both = pairs.where("state = 'candidate'").join(side("a"), "a", "left").join(side("b"), "b", "left")
    fine = (F.col("category_a") == F.col("category")) & (F.col("category_b") == F.col("category"))
    return both.where(~F.coalesce(fine, F.lit(False))).select(*KEY)


def scan_stats(results: DataFrame) -> DataFrame:
    """category, active, reused, suppressed, newpending."""
    n = lambda *r: F.count(F.when(F.col("result").isin(*r), 1))
    return results.groupBy("category").agg(n("active").alias("active"), n("reused").alias("reused"), n("still").alias("suppressed"), n("active").alias("newpending"))
