"""Change events invalidate entries: a Structured Streaming path with an idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.sources.state import drop_entries
from kinfold.sources.tables import Store

#: Kinds of changes that invalidate what is known of a question.
CHANGES = ("created", "updated", "moved", "deleted")


def affected(events: DataFrame, versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """entry of each event (questionid): from its version, or from the snapshot where the version is gone. Both tables: questionid, entry."""
    now = versions.select("questionid", F.col("entry").alias("now")).distinct()
    kept = snapshots.select("questionid", F.col("entry").alias("kept")).distinct()
    found = events.select("questionid").distinct().join(now, "questionid", "left").join(kept, "questionid", "left")
    return found.select(F.coalesce("now", "kept").alias("entry")).where("entry IS NOT NULL").distinct()


def invalidate_stream(entries: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Drop what a stream of entries names, batch by batch, until the source has no more."""
    sink = lambda batch, _: drop_entries(store, batch)
    return entries.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def invalidate_changes(changes: DataFrame, versions: DataFrame, snapshots: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """The same for a stream of changes (kind, questionid): of kinds in CHANGES, by the entries that `affected` finds."""
    found = lambda batch: affected(batch.where(F.col("kind").isin(*CHANGES)), versions, snapshots)
    sink = lambda batch, _: drop_entries(store, found(batch))
    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
