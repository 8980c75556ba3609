"""Input tables as the engine's items, versions and answers, and a versioned Parquet store for its own state.

An item has: entry, category, qtype, name, questiontext, generalfeedback and
answers array<struct<id, answer, fraction>>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.sources.staging import remove, spread  # noqa: F401

ANSWERS = "array<struct<id:bigint,answer:string,fraction:double>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_items(documents: DataFrame) -> DataFrame:
    """Documents as items without answers; the language is the category, the source the type."""
    return documents.select(
        F.col("doc_id").alias("entry"), F.coalesce("lang", F.lit("")).alias("category"), F.coalesce("source", F.lit("")).alias("qtype"),
        F.lit("").alias("name"), F.coalesce("text", F.lit("")).alias("questiontext"), F.lit("").alias("generalfeedback"), F.array().cast(ANSWERS).alias("answers"),
    )


def conversation_items(conversations: DataFrame) -> DataFrame:
    """Conversations as items: the first user turn asks, assistant turns answer (the first is right), system turns are feedback."""
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("turn")))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = conversations.groupBy("conv_id").agg(turns.alias("turns"), first("user").alias("asked"), first("assistant").alias("replied"))
    text_of = lambda keep, by: F.array_join(F.transform(F.filter("turns", keep), lambda x: F.coalesce(x["text"], F.lit(""))), by)
    answers = F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["turn"].cast("long").alias("id"), F.coalesce(x["text"], F.lit("")).alias("answer"), F.when(x["turn"] == F.col("replied"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("fraction")))
    return grouped.select(
        F.col("conv_id").alias("entry"), (F.col("conv_id") % 5).cast("string").alias("category"), F.lit("chat").alias("qtype"), F.lit("").alias("name"),
        text_of(lambda x: (x["role"] == "user") & (x["turn"] == F.col("asked")), " ").alias("questiontext"), text_of(lambda x: x["role"] == "system", "\n").alias("generalfeedback"), answers.alias("answers"),
    )


def event_versions(events: DataFrame) -> DataFrame:
    """Events as versions of their user's entry: versionid, entry, version (order of events), status (hidden for errors)."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    return events.select(F.col("event_id").alias("versionid"), F.col("user_id").alias("entry"), F.row_number().over(order).alias("version"), F.when(F.col("event_type") == "error", "hidden").when(F.col("event_type") == "view", "draft").otherwise("ready").alias("status"))


def join_question_tables(entries: DataFrame, versions: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Host tables (see the store's schemas) as items of each entry's latest visible version."""
    from kinfold.operators.versions import latest_visible

    newest = latest_visible(versions.select(F.col("id").alias("versionid"), F.col("questionbankentryid").alias("entry"), "questionid", "version", "status"))
    per_question = answers.groupBy(F.col("question").alias("questionid")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("fraction", F.lit(0.0)).cast("double").alias("fraction")))).alias("answers"))
    return (
        entries.select(F.col("id").alias("entry"), F.col("questioncategoryid").cast("string").alias("category"))
        .join(newest, "entry").join(questions.withColumnRenamed("id", "questionid"), "questionid").join(per_question, "questionid", "left")
        .select("entry", "category", "qtype", "name", "questiontext", "generalfeedback", F.coalesce("answers", F.array().cast(ANSWERS)).alias("answers"))
    )


class Store:
    """State tables as directories of Parquet versions. One writer.

    A new version is written whole and is current once it is complete, so a lost
    driver leaves the old one; the KEPT newest stay, for readers under way.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        """The complete versions, oldest first."""
        fs, path = self._fs(f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(x[1:]) for x in done if x[:1] == "v" and x[1:].isdigit())

    def version(self, name: str) -> int:
        """The newest complete version, 0 if none."""
        return max(self.versions(name), default=0)

    def read(self, name: str, schema: str) -> DataFrame:
        n = self.version(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{n}") if n else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/v{self.version(name) + 1}"
        df.write.mode("overwrite").parquet(path)
        for old in self.versions(name)[: -self.KEPT]:
            remove(self.spark, f"{self.root}/{name}/v{old}")
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def appended(self, name: str, schema: str) -> DataFrame:
        fs, path = self._fs(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)
