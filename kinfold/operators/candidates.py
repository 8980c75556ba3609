"""Buckets, exact chains, candidate pairs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import hashing as H
from kinfold.functions import scoring as S
from kinfold.operators import inbuckets
from kinfold.plans.config import Config
from kinfold.sources.staging import sent, stage

#: Columns of snapshots that candidates and their scores come from.
COLUMNS = ("entry", "category", "qtype", "sourcehash", "texthash", "answerhash", "tokens", "keywords", "minhash")


def buckets(snaps: DataFrame) -> DataFrame:
    """category, bucketkey, entry: the inverted index."""
    full = F.when(F.col("texthash") == H.sha(F.lit("")), F.lit("")).otherwise(F.col("texthash"))
    keys = H.bucket_keys(full, F.col("texthash"), F.col("qtype"), F.col("answerhash"), F.col("keywords"), F.col("minhash"))
    return snaps.select("category", F.explode(keys).alias("bucketkey"), "entry")


def bucket_sizes(index: DataFrame, limit: int) -> DataFrame:
    """Buckets of two or more, without those over the limit unless they hold equal texts."""
    sizes = index.groupBy("category", "bucketkey").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")
    return sizes.where((F.col("entries") <= limit) | F.col("bucketkey").startswith("tx:"))


def class_rank(key: str = "bucketkey") -> F.Column:
    k = F.col(key)
    return F.when(k.startswith("tx:"), 1).when(k.startswith("an:"), 2).when(k.startswith("mh:"), 3).otherwise(4)


def exact_clusters(snaps: DataFrame) -> DataFrame:
    """category, texthash, entries: equal non-empty texts."""
    full = snaps.where(F.col("texthash") != H.sha(F.lit("")))
    return full.groupBy("category", "texthash").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")


def exact_chain(snaps: DataFrame) -> DataFrame:
    """category, texthash, position, a, b: neighbours in each cluster in the order of answer hash (none first) and entry.

    Only ids and hashes are shuffled.
    """
    order = Window.partitionBy("category", "texthash").orderBy(F.coalesce("answerhash", F.lit("")), "entry")
    full = snaps.select("category", "texthash", "answerhash", "entry").where(F.col("texthash") != H.sha(F.lit("")))
    chain = full.withColumns({"before": F.lag("entry").over(order), "position": F.row_number().over(order)}).where("before IS NOT NULL")
    return chain.select("category", "texthash", "position", F.least("before", "entry").alias("a"), F.greatest("before", "entry").alias("b"))


def _members(snaps: DataFrame, limit: int) -> DataFrame:
    """category, bucketkey, entry of buckets that are compared; those of equal texts bring nothing but the chains again."""
    index = buckets(snaps)
    small = bucket_sizes(index, limit).where(~F.col("bucketkey").startswith("tx:")).select("category", "bucketkey")
    return index.join(small, ["category", "bucketkey"])


def _first(snaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chains and `pairs` (category, bucketkey, a, b), each once with the first place at which it comes up."""
    chains = exact_chain(snaps).select("category", "a", "b", F.struct(F.lit(0).alias("rank"), F.col("texthash").alias("key"), F.col("position").cast("long").alias("i"), F.lit(0).cast("long").alias("j")).alias("position"))
    found = pairs.select("category", "a", "b", F.struct(class_rank().alias("rank"), F.col("bucketkey").alias("key"), F.col("a").cast("long").alias("i"), F.col("b").cast("long").alias("j")).alias("position"))
    return chains.unionByName(found).groupBy("category", "a", "b").agg(F.min("position").alias("position"))


def positions(snaps: DataFrame, limit: int) -> DataFrame:
    """category, a, b, position: every distinct candidate pair with the first place at which it comes up.

    Oversized buckets go before the self-join, which carries ids only; pairs of
    chains of equal texts are linear in the cluster.
    """
    members = _members(snaps, limit)
    other = members.withColumnRenamed("entry", "b")
    return _first(snaps, members.withColumnRenamed("entry", "a").join(other, ["category", "bucketkey"]).where("a < b"))


def measured(snaps: DataFrame, limit: int) -> DataFrame:
    """category, a, b, exact, same_answer, same_type, jaccard, score of every distinct candidate pair, counted in its buckets."""
    order = Window.partitionBy("category", "texthash").orderBy(F.coalesce("answerhash", F.lit("")), "entry")
    before = lambda c: F.lag(c).over(order)
    chain = snaps.select("category", "texthash", "answerhash", "qtype", "entry", F.size("tokens").cast("long").alias("n")).where(F.col("texthash") != H.sha(F.lit("")))
    chain = chain.withColumns({"before": before("entry"), "same_answer": S.same_answer(F.col("answerhash"), before("answerhash")), "same_type": F.col("qtype") == before("qtype")}).where("before IS NOT NULL")
    chain = chain.select("category", F.least("before", "entry").alias("a"), F.greatest("before", "entry").alias("b"), F.col("n").alias("shared"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit(True).alias("exact"), "same_answer", "same_type")
    rows = inbuckets.member_rows(_members(snaps, limit), snaps, inbuckets.token_ids())
    every = chain.unionByName(inbuckets.measured(rows).drop("bucketkey")).dropDuplicates(["category", "a", "b"])
    both = F.col("n_a") + F.col("n_b") - F.col("shared")
    jaccard = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), S.dbl(0)).otherwise(F.col("shared").cast("double") / F.greatest(both, F.lit(1)).cast("double"))
    scored_ = every.withColumn("jaccard", jaccard)
    return scored_.withColumn("score", S.score(F.col("exact"), F.col("jaccard"), F.col("same_answer"), F.col("same_type"))).drop("shared", "n_a", "n_b")


def bucket_pairs(snaps: DataFrame, limit: int) -> DataFrame:
    return positions(snaps, limit).select("category", "a", "b")


def passing(pairs: DataFrame, snaps: DataFrame) -> DataFrame:
    """Those of `pairs` that reach their threshold, with heuristics, score and threshold; snapshots in no pair stay where they are."""
    used = sent(stage(pairs.select(F.explode(F.array("a", "b")).alias("entry")).distinct(), "used"))
    columns = ("qtype", "sourcehash", "texthash", "answerhash")
    side = lambda x: snaps.join(used, "entry", "left_semi").select(F.col("entry").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns], inbuckets.token_ids().alias(f"tokens_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumns({
        "exact": (F.col("texthash_a") == F.col("texthash_b")) & (F.col("texthash_a") != H.sha(F.lit(""))),
        "same_answer": S.same_answer(F.col("answerhash_a"), F.col("answerhash_b")),
        "same_type": F.col("qtype_a") == F.col("qtype_b"), "jaccard": S.jaccard(F.col("tokens_a"), F.col("tokens_b")),
    })
    flags = F.col("same_answer"), F.col("same_type")
    total = both.withColumns({"score": S.score(F.col("exact"), F.col("jaccard"), *flags), "threshold": S.threshold(*flags)}).where("score >= threshold")
    return total.select(*pairs.columns, "sourcehash_a", "sourcehash_b", "exact", "same_answer", "same_type", "jaccard", "score", "threshold")


def candidates(snaps: DataFrame, config: Config = Config()) -> DataFrame:
    """category, a, b, position, score and heuristics of each pair that passes its threshold.

    Bounds from sketches come first, so that token sets join few other pairs. A
    pair passes the bound in all of its buckets or in none, so its place is whole.
    """
    rows = inbuckets.member_rows(_members(snaps, config.bucket_limit), snaps, inbuckets.sketch(inbuckets.token_ids()))
    return passing(stage(_first(snaps, inbuckets.passable(rows)), "passable"), snaps)
