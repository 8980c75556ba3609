"""A corpus pipeline of five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it
as Parquet in the shared folder and rereads it as the next stage's docs. All
stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import langid, neardup, packing, quality, suffixdedup
from kinfold.llm.common import held_out, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose quality score is under one half; null and empty texts have the score of the intercept. Without labels all stay. The model comes from all labelled rows that may be learned from."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn=~held_out(3, 1), train_rows=None)
    return quality.accept(docs, model, threshold=0.5)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without letters (null and empty ones, too), and those that resemble no language learned. Profiles and floors come from all rows that may be learned from."""
    return langid.accept(docs, langid.train(docs, learn=~held_out(5, 0), per_lang=None, floors=True))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by five-word shingles at 0.8 or more: that of the smallest doc_id.

    A doc_id that several texts share names each of them, and all that are no near copies stay. Rows without a
    doc_id are compared like any other and stay only where no group has a doc_id. Texts without words all stay,
    but repeated rows (equal doc_id and text) count once.
    """
    return neardup.representatives(docs, shingle=5, percent=80)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte that a 200-byte string repeated in the input covers; n_chars follows the text. Texts of which nothing is left go; null and empty ones stay."""
    cut = suffixdedup.without_repeats(docs, length=200)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document (null text: length 0) in a length bucket and a token-budget batch."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("packing", packing_stage),
]

#: The trained stages can't be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
