"""The engine's pair and snapshot tables in a store, and what changes have taken from them since they were written.

A change appends the entries that it drops, with the versions of the tables that
it holds for; readers leave those entries out, and the next scan, which writes
what it read, starts with none. So a micro-batch writes its own entries only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.pairs import SCHEMA as PAIR
from kinfold.operators.pairs import invalidate
from kinfold.sources.tables import Store

SNAPSHOT = "entry long, category string, qtype string, name string, sourcehash string, texthash string, answerhash string, answersummary array<struct<fraction:double,text:string>>, semantictext string, normalizedtext string, tokens array<string>, keywords array<string>, minhash array<bigint>, lastscanid long, timecreated long, timemodified long"
GONE = "entry long, name string, version long"


def drop_entries(store: Store, entries: DataFrame) -> None:
    """Drop the snapshots (and with them the buckets) of `entries`, and their pairs but the ignored ones. Twice is as good as once."""
    tables = [(n, store.version(n)) for n in ("pair", "snapshot")]
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).cast("long").alias("version")) for n, v in tables])
    gone = entries.select(F.col("entry").cast("long").alias("entry")).where("entry IS NOT NULL").distinct()
    store.append("gone", gone.select("entry", F.inline(each)))


def _gone(store: Store, name: str) -> DataFrame:
    return store.appended("gone", GONE).where((F.col("name") == name) & (F.col("version") == store.version(name))).select("entry").distinct()


def read_pairs(store: Store) -> DataFrame:
    """The current pair table."""
    return invalidate(store.read("pair", PAIR), _gone(store, "pair"))


def read_snapshots(store: Store) -> DataFrame:
    """The current snapshot table."""
    return store.read("snapshot", SNAPSHOT).join(_gone(store, "snapshot"), "entry", "left_anti")
