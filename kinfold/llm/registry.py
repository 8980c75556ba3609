"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import table


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import maxscore

    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, multiplier=256)


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import crosspolytope

    return crosspolytope.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import suffixdedup

    return suffixdedup.digests(table(spark, sf_dir, "documents"), length=200)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import bpe

    return bpe.round_trips(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import langid

    return langid.language_ids(table(spark, sf_dir, "documents"))


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import html

    return html.extract(table(spark, sf_dir, "pages"))


def op8_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import licences

    return licences.scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm import quality

    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score FROM p
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_maxscore": OP1_SQL}
