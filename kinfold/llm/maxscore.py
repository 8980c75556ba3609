"""Exact top-k inner-product search with MaxScore over sharded postings.

Each dimension is a term. A shard keeps, for each term, its impacts (the
components) and the documents in order of impact from either end. For a query,
a term's bound is the most it can add to a score in this shard. Terms are put
in order of bounds; a threshold comes from the documents at the heads of the
strongest postings. The non-essential terms are the longest tail whose bounds
together stay under the threshold: a document that gains nothing from the
essential terms cannot reach it. The essential postings are traversed; the
non-essential ones are probed block by block, only for documents that are still
competitive. Shards' bests are merged by query.

Queries and documents meet in a grid of query blocks and shards, each of
bounded size; every cell is one group, so no group grows with the data.

Components are integers floor(multiplier * x). Scores are exact: sums stay in
doubles while they are under 2^53 and in 64-bit integers beyond.

Edge cases: null ids, null or empty vectors and vectors with null or non-finite
components take no part; shorter vectors count as filled with zeros; repeated
rows count once; ties go to the smaller vec_id; fewer candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm import vectors as V

SHARD_ROWS = 4096
QUERY_ROWS = 8192
#: Non-essential terms are probed so many at a time.
PROBE = 8
HEADS = 24


class Shard:
    """Postings of one block of documents."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.lexsort((*rows.T[::-1], ids)) if len(ids) else np.zeros(0, np.int64)
        ids, rows = ids[order], rows[order]
        if len(ids):
            new = np.append(True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]).any(1))
            ids, rows = ids[new], rows[new]
        self.ids = ids
        self.impacts = np.ascontiguousarray(rows.T)
        self.high = self.impacts.max(1, initial=np.iinfo(np.int64).min)
        self.low = self.impacts.min(1, initial=np.iinfo(np.int64).max)
        by_impact = np.argsort(self.impacts, axis=1, kind="stable")
        self.heads = by_impact[:, -HEADS:], by_impact[:, :HEADS]
        self.floats = self.impacts.astype(np.float64)
        self.bound = float(np.abs(self.floats).max(initial=0))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first."""
        small = self.bound * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, len(query)) < 2.0**53
        impacts, q = (self.floats, query.astype(np.float64)) if small else (self.impacts, query)
        bounds = np.maximum(np.maximum(q * self.high.astype(q.dtype), q * self.low.astype(q.dtype)), 0)
        terms = np.argsort(-bounds, kind="stable")
        bounds = bounds[terms]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what terms[i:] can add
        other = self.ids != query_id
        seeds = np.unique(np.concatenate([self.heads[0 if q[t] > 0 else 1][t] for t in terms[:3]]))
        seeds = seeds[other[seeds]]
        threshold = None
        if len(seeds) >= k:
            threshold = np.partition(q @ impacts[:, seeds], len(seeds) - k)[len(seeds) - k]
        # The essential terms: without any of them the rest stays under the threshold.
        split = len(terms) if threshold is None else int(np.argmax(rest < threshold)) if (rest < threshold).any() else len(terms)
        essential = terms[:split]
        partial = q[essential] @ impacts[essential]
        live = np.flatnonzero(other) if threshold is None else np.flatnonzero(other & (partial + rest[split] >= threshold))
        score = partial[live]
        for at in range(split, len(terms), PROBE):
            part = terms[at : at + PROBE]
            score = score + q[part] @ impacts[np.ix_(part, live)]
            fine = score + rest[min(at + PROBE, len(terms))] >= threshold
            live, score = live[fine], score[fine]
        if len(live) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            live, score = live[score >= least], score[score >= least]
        order = np.lexsort((self.ids[live], -score))[:k]
        return self.ids[live[order]], score[order].astype(np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 5, multiplier: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row under `is_query` with all others."""
    spark = vectors.sparkSession
    rows = V.valid(vectors)
    n, dims = V.extent(rows)
    asked = rows.where(is_query).count()
    shards = V.blocks(n, SHARD_ROWS, 2 * spark.sparkContext.defaultParallelism)
    query_blocks = V.blocks(asked, QUERY_ROWS)
    numbers = rows.withColumn(V.VECTOR, F.transform(V.VECTOR, lambda x: F.floor(x * F.lit(float(multiplier))).cast("double")))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    documents = numbers.select(every(query_blocks).alias("block"), V.salt(shards).alias("shard"), F.lit(False).alias("asks"), V.ID, V.VECTOR)
    queries = numbers.where(is_query).select(V.salt(query_blocks).alias("block"), every(shards).alias("shard"), F.lit(True).alias("asks"), V.ID, V.VECTOR)

    def cell(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        ids = group.column(V.ID).to_numpy()
        numbers = V.matrix(group.column(V.VECTOR), dims).astype(np.int64)
        shard = Shard(ids[~asks], numbers[~asks])
        out_q, out_i, out_s = [], [], []
        if len(shard.ids):
            for i in np.flatnonzero(asks):
                found, scores = shard.top(ids[i], numbers[i], k)
                out_q.append(np.full(len(found), ids[i]))
                out_i.append(found)
                out_s.append(scores)
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table([join(out_q), join(out_i), join(out_s)], ["query_id", V.ID, "score"])

    found = documents.unionByName(queries).groupBy("block", "shard").applyInArrow(cell, f"query_id long, {V.ID} long, score long")
    return V.best(found, k, "long")
