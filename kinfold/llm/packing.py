"""Optimal length buckets and token-budget batches.

One pass makes the global histogram of lengths. Dynamic programming over it
chooses the bucket boundaries whose total padding (each text filled up to its
bucket's boundary) is smallest. Inside a bucket, texts form batches whose
padded size stays within the token budget.

A length is the number of tokens of the default byte tokenizer, one for each
UTF-8 byte; any integer Column may take its place. The histogram holds lengths
under 2^BITS exactly and longer ones to BITS significant bits (a boundary is the
largest length in a bin, so one part in 2^(BITS - 1) at most is left), at any
number of rows; boundaries are optimal among its lengths.

Batches are numbered without gathering a bucket in one task: rows are ranked
within salted parts of a bucket, and each part's offset comes from counted part
sizes, so only a bucket's last batch can be short.

Edge cases: a null or empty text has length 0; a text over the budget is a batch
by itself; ties in length are ordered by doc_id; repeated rows are packed each;
an empty table gives no rows; null and repeated doc_ids are packed like others.
Of other columns only those that `length` names are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import materialize

BITS = 14
PART_ROWS = 50_000
#: So many part sizes at most are broadcast.
BROADCAST_PARTS = 100_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` boundaries (the last is the largest length) with the least total padding.

    lengths: distinct, ascending. Padding of a bucket over lengths i..j is lengths[j] * count - sum of lengths.
    """
    n = len(lengths)
    if n == 0:
        return []
    # Lengths drop out of the sum as a constant: minimise the sum of boundary * count, in exact integers.
    x, total = lengths.tolist(), [0, *np.cumsum(counts).tolist()]
    buckets = min(buckets, n)
    alone = [x[j] * total[j + 1] for j in range(n)]
    cost = alone
    choice = np.zeros((buckets, n), np.int64)
    for k in range(1, buckets):
        # A last bucket i + 1..j costs cost[i] - x[j] * total[i + 1] + alone[j]: a line in x[j] for each i.
        # Slopes fall with i and x grows, so the lower hull is walked once.
        hull: list[tuple[int, int, int]] = []
        head, now = 0, alone.copy()
        for j in range(n):
            while head + 1 < len(hull) and hull[head + 1][1] + hull[head + 1][0] * x[j] <= hull[head][1] + hull[head][0] * x[j]:
                head += 1
            if hull and (saved := hull[head][1] + hull[head][0] * x[j]) < 0:
                now[j], choice[k, j] = alone[j] + saved, hull[head][2] + 1
            slope, at = -total[j + 1], cost[j]
            while len(hull) - head > 1 and (at - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, at, j))
        cost = now
    out, j = [], n - 1
    for k in range(buckets - 1, -1, -1):
        out.append(x[j])
        j = int(choice[k, j]) - 1
        if j < 0:
            break
    return out[::-1]


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths (the largest of each bin) and their counts. lengths: column n_tokens."""
    bits = F.greatest(F.length(F.bin("n_tokens")) - BITS, F.lit(0))
    bins = lengths.withColumn("bits", bits).groupBy("bits", F.expr("shiftright(n_tokens, bits)").alias("bin"))
    # Bounded: at most 2^BITS exact lengths and 2^(BITS - 1) for each further bit of the longest.
    found = sorted((r["top"], r["n"]) for r in bins.agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n")).collect())
    return np.array([t for t, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def pack(documents: DataFrame, length: Column | None = None, token_budget: int = 1 << 17, buckets: int = 16) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding of every document."""
    length = F.octet_length("text") if length is None else length
    rows = documents.select("doc_id", F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"))
    lengths, counts = histogram(rows)
    bounds = optimal_boundaries(lengths, counts, buckets) or [0]
    number, size, capacity = F.lit(len(bounds) - 1), F.lit(bounds[-1]), F.lit(max(1, token_budget // max(1, bounds[-1])))
    for k in range(len(bounds) - 2, -1, -1):
        inside = F.col("n_tokens") <= bounds[k]
        number, size, capacity = F.when(inside, F.lit(k)).otherwise(number), F.when(inside, F.lit(bounds[k])).otherwise(size), F.when(inside, F.lit(max(1, token_budget // max(1, bounds[k])))).otherwise(capacity)
    parts = max(16, -(-int(counts.sum()) // PART_ROWS))
    placed = rows.withColumns({"bucket": number.cast("int"), "bucket_len": size.cast("long"), "capacity": capacity.cast("long"), "part": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")})
    # Written once, so that the parts, which follow the places of rows, stay: null and repeated doc_ids are spread, too.
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if parts * len(bounds) <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    order = Window.partitionBy("bucket", "part").orderBy("n_tokens", "doc_id")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["bucket", "part"])
    place = F.col("offset") + F.col("rank")
    batch = F.floor(place / F.col("capacity")).cast("long")
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_len", (F.shiftleft(F.col("bucket").cast("long"), 40) + batch).alias("batch_id"), (place % F.col("capacity")).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
