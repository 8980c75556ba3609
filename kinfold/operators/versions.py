"""Version selection, snapshots and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import hashing as H
from kinfold.functions import text as T
from kinfold.functions.features import features


def visible(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("status") != "hidden")


def latest_visible(versions: DataFrame) -> DataFrame:
    """The newest version of each entry that is not hidden (drafts count); of equal numbers the larger versionid.

    Spark cuts each input partition to its first row by entry before the shuffle.
    """
    order = Window.partitionBy("entry").orderBy(F.desc("version"), F.desc("versionid"))
    return visible(versions).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def answer_features(answers: str = "answers") -> dict[str, F.Column]:
    """Columns from an item's answers: parts, correct, summary."""
    texts = F.transform(answers, lambda a: F.struct(a["fraction"].alias("fraction"), T.normalize(a["answer"]).alias("text")))
    parts = F.transform(texts, lambda a: H.answer_part(a["fraction"], a["text"]))
    correct = F.transform(F.filter(texts, lambda a: (a["fraction"] > 0) & (a["text"] != "")), lambda a: a["text"])
    payload = F.transform(answers, lambda a: F.struct((-a["fraction"]).alias("less"), T.plain(a["answer"]).alias("text")))
    summary = F.transform(F.array_sort(payload), lambda a: F.struct((-a["less"]).alias("fraction"), a["text"].alias("text")))
    return {"parts": parts, "correct": correct, "answersummary": summary}


def snapshots(items: DataFrame) -> DataFrame:
    """Normalised features of items: hashes, keywords, MinHash; one row in, one row out, without a shuffle."""
    made = features("questiontext", "plain", "normalized", "tokens", "keywords", "minhash")
    first = items.withColumns(answer_features() | {"made": made}).withColumns({"semantictext": F.col("made.plain"), "normalizedtext": F.col("made.normalized")})
    second = first.withColumns({
        "sourcehash": H.source_hash(F.col("qtype"), F.col("name"), F.col("questiontext"), F.col("generalfeedback"), F.col("parts")),
        "texthash": H.sha(F.col("normalizedtext")),
        "answerhash": H.answer_hash(F.col("correct")),
    })
    return second.select("entry", "category", "qtype", "name", "sourcehash", "texthash", "answerhash", "answersummary", "semantictext", "normalizedtext", "made.tokens", "made.keywords", "made.minhash")


def changed_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """entry, change (added, changed, same): by source hash, of all entries of `new`."""
    before = old.select("entry", F.col("sourcehash").alias("was"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("was") != F.col("sourcehash"), "changed").otherwise("same")
    return new.join(before, "entry", "left").select("entry", change.alias("change"))


def stale_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries that a scan of the same categories no longer found."""
    scanned = new.select("category").distinct()
    return old.join(scanned, "category", "left_semi").join(new.select("entry"), "entry", "left_anti").select("entry")


def first_snapshots(new: DataFrame, scan: int, now: int) -> DataFrame:
    """The snapshot table after a scan that found none before."""
    at = lambda n: F.lit(n).cast("long")
    return new.withColumns({"lastscanid": at(scan), "timecreated": at(now), "timemodified": at(now)})


def merge_snapshots(old: DataFrame, new: DataFrame, scan: int, now: int) -> DataFrame:
    """The next snapshot table: scanned entries replaced (creation time kept), stale ones dropped, other categories kept."""
    born = old.select("entry", F.col("timecreated").alias("born"))
    fresh = new.join(born, "entry", "left").withColumns({"lastscanid": F.lit(scan).cast("long"), "timecreated": F.coalesce("born", F.lit(now).cast("long")), "timemodified": F.lit(now).cast("long")}).drop("born")
    gone = stale_entries(old, new)
    return old.join(new.select("entry"), "entry", "left_anti").join(gone, "entry", "left_anti").unionByName(fresh)
