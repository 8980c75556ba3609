"""Approximate nearest neighbours by cosine with cross-polytope hashing.

A hash rotates unit vectors by three rounds of random signs and a fast Hadamard
transform, and assigns each to the nearest signed axis. A table's key joins
several hashes: the first take all axes (2 * dims values each), the last one
only the first 4 or 16 of them, so that the number of buckets can follow the
number of rows. A query probes in each table the keys nearest to it, best first
(multiprobe). Its candidates are ranked by the exact cosine of the original
vectors in double precision.

The number of joined hashes and of probes is fitted, at every size alike: the
true neighbours of at most SAMPLE queries are found by brute force in one pass
over all rows, and of all joins under one row a bucket the cheapest pair that
finds TARGET of them is taken. So the share of the rows that a query visits
falls as the table grows, while recall holds.

Equal vectors are one query, and of equal vectors only the k + 1 smallest ids
are indexed, which changes no result. Bucket keys are dealt to cells of bounded
size; a key with over PART_ROWS rows is split over several cells, all of which a
query visits that probes it. A query whose probes meet fewer than k others
probes all axes of one table, that is, all rows.

Edge cases: null ids, null, empty or zero vectors and vectors with null or
non-finite components take no part; shorter vectors count as filled with zeros;
repeated rows count once; an id with several vectors stands by its nearest, and
asks with each; ties go to the smaller vec_id; fewer candidates give fewer rows.
Other columns are read by `is_query` only if they are named vec_id or embedding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import vectors as V
from kinfold.llm.common import arrow_map, hash_sample, materialize

TABLES = 8
#: Share of the sample's true neighbours that the fitted probes must find, and the size of the sample.
TARGET, SAMPLE = 0.95, 200
MAX_PROBES = 512
#: What a probe costs besides the rows it meets, in rows.
PROBE_COST = 16
CELL_ROWS = 1 << 15
PART_ROWS = 4096
#: So many split keys at most; parts grow beyond (rows * TABLES / SPLIT_KEYS rows each).
SPLIT_KEYS = 200_000
PAIRS = 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each column, scaled to keep lengths."""
    d, n = x.shape
    step = 1
    while step < d:
        y, out = x.reshape(d // (2 * step), 2, step, n), np.empty((d // (2 * step), 2, step, n), x.dtype)
        np.add(y[:, 0], y[:, 1], out=out[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=out[:, 1])
        x = out.reshape(d, n)
        step *= 2
    return x * x.dtype.type(1 / np.sqrt(d))


def rotate(unit: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-random rotation `number` of the rows, filled up to a power of two, as columns."""
    d = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((d, len(unit)), np.float32)
    x[: unit.shape[1]] = unit.T
    for s in np.random.default_rng([20150901, number, d]).choice([-1.0, 1.0], (3, d)).astype(np.float32):
        x = hadamard(x * s[:, None])
    return x


def joins(dims: int, rows: int) -> Iterator[tuple[int, ...]]:
    """The axes of each joined hash, from the fewest keys to one row a key."""
    d = 1 << max(0, dims - 1).bit_length()
    steps = [x for x in (4, 16) if x < d] + [d]
    whole: tuple[int, ...] = (d,)
    yield whole
    while True:
        for s in steps:
            if keys_of((*whole, s)) > max(rows, 2 * d):
                return
            yield (*whole, s)
        whole = (*whole, d)


def keys_of(axes: tuple[int, ...]) -> int:
    return int(np.prod([2 * a for a in axes], dtype=object))


def probes(unit: np.ndarray, table: int, axes: tuple[int, ...], count: int) -> np.ndarray:
    """The `count` nearest keys of each row in a table, nearest first (fewer if there are fewer)."""
    key = cost = None
    for k, a in enumerate(axes):
        x = rotate(unit, table * 64 + k)[:a].T
        both = np.concatenate([x, -x], 1)
        if count == 1:
            found, less = both.argmax(1)[:, None], np.zeros((len(both), 1), np.float32)
        else:
            found = np.argsort(-both, axis=1, kind="stable")[:, : min(count, 2 * a)]
            less = both.max(1, keepdims=True) - np.take_along_axis(both, found, 1)
            less = less * less
        if key is None:
            key, cost = found.astype(np.int64), less
            continue
        n = min(count, key.shape[1] * found.shape[1])
        cost, key = (cost[:, :, None] + less[:, None]).reshape(len(unit), -1), (key[:, :, None] * (2 * a) + found[:, None]).reshape(len(unit), -1)
        if n < key.shape[1]:
            best = np.argpartition(cost, n - 1, axis=1)[:, :n]
            key, cost = np.take_along_axis(key, best, 1), np.take_along_axis(cost, best, 1)
        order = np.lexsort((key, cost), axis=1)
        key, cost = np.take_along_axis(key, order, 1), np.take_along_axis(cost, order, 1)
    return key


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with that of y; equal rows give equal results wherever they stand."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best ids, each by its best row; ties to the smaller id."""
    order = np.lexsort((-score, ids, query))
    q, i = query[order], ids[order]
    order = order[np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))] if len(order) else order
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    return order[np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k]


def _nearest(indexed: DataFrame, ids: np.ndarray, x: np.ndarray, dims: int, k: int) -> DataFrame:
    """query_id, vec_id, embedding, score: by brute force, the k nearest rows to each of a few vectors, of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = units(x)
        q = i = s = np.zeros(0, np.int64)
        rows = np.zeros((0, dims))
        for b in batches:
            own, new = b.column(V.ID).to_numpy(), V.matrix(b.column(V.VECTOR), dims)
            rough = unit @ units(new).T
            rough[ids[:, None] == own[None]] = -2
            top = np.argpartition(-rough, min(k, len(own)) - 1, axis=1)[:, :k]
            q, i, s = np.append(q, np.repeat(ids, top.shape[1])), np.append(i, own[top.ravel()]), np.append(s, np.take_along_axis(rough, top, 1).ravel())
            rows = np.concatenate([rows, new[top.ravel()]])
            keep = best_of(q, i, s, k)
            q, i, s, rows = q[keep], i[keep], s[keep], rows[keep]
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(list(rows), pa.list_(pa.float64())), pa.array(s, pa.float64())], ["query_id", V.ID, V.VECTOR, "score"])

    return indexed.mapInArrow(run, f"query_id long, {V.ID} long, {V.VECTOR} array<double>, score double")


def fit(indexed: DataFrame, asked: DataFrame, n: int, dims: int, k: int, tables: int = TABLES) -> tuple[tuple[int, ...], int]:
    """Axes of the joined hashes, and the number of probes."""
    widest = next(joins(dims, n))
    sample = hash_sample(asked, asked.count(), SAMPLE, V.ID).orderBy(F.xxhash64(V.ID), V.ID).limit(SAMPLE).collect()
    ids = np.array([r[V.ID] for r in sample], np.int64)
    x = V.matrix(pa.array([r[V.VECTOR] for r in sample], pa.list_(pa.float64())), dims)
    near = _nearest(indexed, ids, x, dims, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), V.ID)
    # At most SAMPLE * k rows.
    near = near.withColumn("r", F.row_number().over(order)).where((F.col("r") <= k) & (F.col("score") > -1.5)).collect()
    if not near:
        return widest, keys_of(widest)
    place = {q: j for j, q in enumerate(ids.tolist())}
    who = np.array([place[r["query_id"]] for r in near])
    to = units(V.matrix(pa.array([r[V.VECTOR] for r in near], pa.list_(pa.float64())), dims))
    unit = units(x)
    least = int(np.ceil(TARGET * len(near))) - 1
    options = []
    for axes in joins(dims, n):
        first = np.full(len(near), MAX_PROBES)
        for t in range(tables):
            hit = probes(unit, t, axes, MAX_PROBES)[who] == probes(to, t, axes, 1)
            first = np.minimum(first, np.where(hit.any(1), hit.argmax(1), MAX_PROBES))
        need = int(np.sort(first)[least]) + 1
        if need <= MAX_PROBES:
            options.append((need * (n / keys_of(axes) + PROBE_COST), axes, need))
    return min(options)[1:] if options else (widest, keys_of(widest))


def _spread(x: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit mix of keys."""
    h = x.astype(np.uint64) + np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(31)


def _probe(indexed: DataFrame, asked: DataFrame, n: int, dims: int, tables: int, axes: tuple[int, ...], count: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each cell that a query visits."""
    size, spark = keys_of(axes), indexed.sparkSession

    def keys(batch: pa.RecordBatch, width: int) -> np.ndarray:
        x = V.matrix(batch.column(V.VECTOR), dims)
        if not len(x):
            return np.zeros((0, 1), np.int64)
        return np.concatenate([probes(units(x), t, axes, width) + t * size for t in range(tables)], 1)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, times = np.unique(keys(batch, 1), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["key", "n"])

    part_rows = max(PART_ROWS, n * tables // SPLIT_KEYS)
    hot = arrow_map(indexed, counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > part_rows)
    # At most rows * tables / part_rows <= SPLIT_KEYS keys.
    hot = sorted((r["key"], -(-r["n"] // part_rows)) for r in hot.collect())
    hot_keys, hot_parts = np.array([h for h, _ in hot] or [-1], np.int64), np.array([p for _, p in hot] or [1], np.int64)
    shared = spark.sparkContext.broadcast((hot_keys, hot_parts))
    cells = V.blocks(n * tables, CELL_ROWS, spark.sparkContext.defaultParallelism)

    def dealt(width: int, asks: bool):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hot_keys, hot_parts = shared.value
            found = keys(batch, width)
            row, key = np.repeat(np.arange(len(found)), found.shape[1]), found.ravel()
            at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
            parts = np.where(hot_keys[at] == key, hot_parts[at], 1)
            if asks:
                part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                row, key = np.repeat(row, parts), np.repeat(key, parts)
            else:
                part = (_spread(batch.column(V.ID).to_numpy()[row], 1) % parts.astype(np.uint64)).astype(np.int64)
            cell = (_spread(key, part + 2) % np.uint64(cells)).astype(np.int64)
            order = np.lexsort((key, cell, row))
            row, key, cell = row[order], key[order], cell[order]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]))) if len(row) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(key)).astype(np.int32)), pa.array(key))
            take = pa.array(row[new])
            return pa.RecordBatch.from_arrays([pa.array(cell[new]), pa.array(np.full(len(new), asks)), batch.column(V.ID).take(take), batch.column(V.VECTOR).take(take), lists], ["cell", "asks", V.ID, V.VECTOR, "keys"])

        return run

    kind = dict(indexed.dtypes)[V.VECTOR]
    schema = f"cell long, asks boolean, {V.ID} long, {V.VECTOR} {kind}, keys array<long>"
    documents = arrow_map(indexed.select(V.ID, V.VECTOR), dealt(1, False), schema)
    queries = arrow_map(asked.select(V.ID, V.VECTOR), dealt(count, True), schema)

    def visit(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        ids, x = group.column(V.ID).to_numpy(), V.matrix(group.column(V.VECTOR), dims)
        lists = group.column("keys").combine_chunks()
        key, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        asking = asks[who]
        order = np.argsort(key[~asking], kind="stable")
        doc_key, doc = key[~asking][order], who[~asking][order]
        query_key, query = key[asking], who[asking]
        low, high = np.searchsorted(doc_key, query_key), np.searchsorted(doc_key, query_key, "right")
        query, low, size = query[high > low], low[high > low], (high - low)[high > low]
        out: list[list[np.ndarray]] = [[], [], []]
        unit = units(x).astype(np.float32)
        # An id may have several vectors: so many rows hold k ids.
        least = k * int(np.unique(ids[~asks], return_counts=True)[1].max(initial=1))
        # Whole queries at a time, with about PAIRS pairs.
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        edges = np.append(starts, len(query))
        before = np.append(0, np.cumsum(size))
        at = 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(before[edges], before[starts[at]] + PAIRS, "right")) - 1)
            a, b = edges[at], edges[end]
            met = np.repeat(query[a:b], size[a:b])
            met = np.unique(met * len(ids) + doc[np.repeat(low[a:b] - (before[a:b] - before[a]), size[a:b]) + np.arange(len(met))])
            who, met = met // len(ids), met % len(ids)
            cut = np.flatnonzero(np.append(True, who[1:] != who[:-1])).tolist()
            q, d = [], []
            for j, m in zip(cut, [*cut[1:], len(who)]):
                near = met[j:m]
                if m - j > least:  # cosines good to 1e-6 choose whose exact ones are taken
                    rough = unit[near] @ unit[who[j]]
                    near = near[rough >= np.partition(rough, m - j - least)[m - j - least] - 1e-5]
                q.append(np.full(len(near), who[j]))
                d.append(near)
            q, d = np.concatenate(q), np.concatenate(d)
            score = np.concatenate([cosines(x[q[j : j + PAIRS]], x[d[j : j + PAIRS]]) for j in range(0, len(q), PAIRS)])
            keep = best_of(ids[q], ids[d], score, k)
            for column, values in zip(out, (ids[q], ids[d], score)):
                column.append(values[keep])
            at = end
        q, i, s = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64)))
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", V.ID, "score"])

    return documents.unionByName(queries).groupBy("cell").applyInArrow(visit, f"query_id long, {V.ID} long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: about the k nearest of each row under `is_query` among all others."""
    rows = V.valid(vectors, exact=True).where(F.exists(V.VECTOR, lambda x: x != 0)).dropDuplicates([V.ID, V.VECTOR])
    rows = materialize(rows, "vectors")
    n, dims = V.extent(rows)
    same = Window.partitionBy(V.VECTOR).orderBy(V.ID)
    indexed = materialize(rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select(V.ID, V.VECTOR), "indexed")
    asked = rows.where(is_query)
    # Equal vectors ask once, for one more than k, as each id leaves itself out.
    once = materialize(asked.groupBy(V.VECTOR).agg(F.min(V.ID).alias(V.ID)), "asked")
    axes, count = fit(indexed, once, n, dims, k, tables) if n else ((1,), 2)
    found = materialize(V.best(_probe(indexed, once, n, dims, tables, axes, count, k + 1), k + 1, "double"), "found")
    widest = next(joins(dims, n))
    if (axes, count) != (widest, keys_of(widest)):
        enough = found.where(F.col("rank") == k + 1).select(F.col("query_id").alias(V.ID))
        short = materialize(once.join(enough, V.ID, "left_anti"), "short")
        if not short.isEmpty():
            more = V.best(_probe(indexed, short, n, dims, 1, widest, keys_of(widest), k + 1), k + 1, "double")
            found = found.join(short.select(F.col(V.ID).alias("query_id")), "query_id", "left_anti").unionByName(more)
    whose = asked.join(once.withColumnRenamed(V.ID, "first"), V.VECTOR).select("first", F.col(V.ID).alias("asker"))
    answers = found.select(F.col("query_id").alias("first"), V.ID, "score").join(whose, "first").where(F.col("asker") != F.col(V.ID))
    return V.best(answers.select(F.col("asker").alias("query_id"), V.ID, "score"), k, "double")
