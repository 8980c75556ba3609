"""MinHash near-duplicate detection with odd sketches.

Each text's set of distinct word shingles gets MINHASHES minima. BANDS bands of
ROWS minima block the sets: at Jaccard 0.8 a pair misses all bands with
probability (1 - 0.8^5)^32 = 3e-6. The minima are also folded into a parity
bitmap of SKETCH_BITS bits (odd sketch); the population count of two bitmaps'
XOR estimates the Jaccard similarity, and only pairs whose estimate is within
SLACK of the threshold are confirmed, exactly, on the full sets.

No bucket's pairs are written out. Equal sets are one class, and classes, not
doc_ids, are what is linked. Star rounds link the members of a bucket to one of
them, by classes that are not yet connected; what remains unconnected inside a
bucket after them is compared in blocks: first by sketches alone, then, with
full sets, those members that have a partner by their sketches. The blocks emit
only confirmed links that join components. So links may be skipped between texts
that are connected already, and components are complete.

Edge cases: null, empty or word-free texts have an empty set and are linked
with nothing, nor with each other; a text of fewer words than a shingle has its
whole sequence as the one shingle; long texts are read whole; repeated rows are
equal sets. A doc_id that several texts share names each of them and links none:
each row has the component of its own text. A null doc_id is linked like any
other but names no component; component_id is null where no doc_id is reachable
(kept is false there). Other columns than doc_id and text are not read by
near_duplicates, and passed on by representatives, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import textvec as tv
from kinfold.llm.common import arrow_map, materialize
from kinfold.llm.components import connected_components

BANDS, ROWS = 32, 5
MINHASHES = BANDS * ROWS
SKETCH_BITS = 1024
#: Five standard deviations of an estimate from 160 minima at 0.8, with room for the bitmap's collisions.
SLACK = 0.18
STAR_ROUNDS = 2
BLOCK_ROWS = 1024
#: Pairs of a cell that are looked at together.
CELL_PAIRS = 1 << 16
#: Stands for a null doc_id in the names of rows (doc_id, hash of the text).
NAMELESS = -(2**63)

_rng = np.random.default_rng(97)
_FACTOR = _rng.integers(0, 2**63, MINHASHES, dtype=np.uint64) * tv.U64(2) + tv.U64(1)
_ADD = _rng.integers(0, 2**63, MINHASHES, dtype=np.uint64)


def identities(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit identities of each set (n x 2); empty sets have zeros."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, 2), np.uint64)
    if len(full):
        out[full, 0] = np.add.reduceat(sets, at[full])
        out[full, 1] = np.bitwise_xor.reduceat(tv.mix(sets + tv.BASE), at[full])
    return out


def signatures(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit identities of each set (n x 2), its band keys (n x BANDS) and its odd sketch (n x SKETCH_BITS / 64). Empty sets have zeros."""
    n = len(at) - 1
    full = np.flatnonzero(np.diff(at) > 0)
    identity, bands, sketch = identities(sets, at), np.zeros((n, BANDS), np.uint64), np.zeros((n, SKETCH_BITS // 64), np.uint64)
    if len(full):
        starts = at[full]
        minima = np.empty((len(full), MINHASHES), np.uint64)
        for k in range(MINHASHES):
            minima[:, k] = np.minimum.reduceat(sets * _FACTOR[k] + _ADD[k], starts)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), BANDS))
        for r in range(ROWS):
            key = tv.mix(key * tv.BASE + minima[:, r::ROWS])
        bands[full] = key
        place = tv.mix(minima + np.arange(MINHASHES, dtype=np.uint64) * tv.BASE) % tv.U64(SKETCH_BITS)
        flat = (np.arange(len(full))[:, None] * SKETCH_BITS + place.astype(np.int64)).ravel()
        parity = (np.bincount(flat, minlength=len(full) * SKETCH_BITS) & 1).astype(np.uint8)
        sketch[full] = np.packbits(parity.reshape(len(full), -1), axis=1, bitorder="little").view(np.uint64)
    return identity, bands, sketch


def _named(documents: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def features(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, s1, s2, bands, sketch of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tv.raw_bytes(batch.column("text"))
        parts = []
        for i, j in tv.slices(offsets):
            sets, at = tv.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
            parts.append((np.diff(at), *signatures(sets, at)))
        n, identity, bands, sketch = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH_BITS // 64), np.uint64))
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
        whole = identity.view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n.astype(np.int64)), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), lists(bands), lists(sketch)], ["doc_id", "th", "n_shingles", "s1", "s2", "bands", "sketch"])

    return arrow_map(_named(documents).select("doc_id", "th", "text"), run, "doc_id long, th long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>")


def full_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """s1, s2, n_shingles, items: the sorted distinct shingle hashes of every document, by the identity of the set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tv.raw_bytes(batch.column("text"))
        parts, ends, identity, base = [], [np.zeros(1, np.int64)], [], 0
        for i, j in tv.slices(offsets):
            sets, at = tv.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
            identity.append(identities(sets, at).view(np.int64))
            parts.append(sets.view(np.int64))
            ends.append(at[1:] + base)
            base += len(sets)
        ends = np.concatenate(ends)
        items = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        whole = np.concatenate(identity) if identity else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), pa.array(np.diff(ends)), items], ["s1", "s2", "n_shingles", "items"])

    return arrow_map(documents.select("text"), run, "s1 long, s2 long, n_shingles long, items array<long>")


def estimate(x: Column, y: Column) -> Column:
    """Jaccard similarity estimated from two odd sketches: |difference| = -(bits / 2) ln(1 - 2 z / bits) of 2 * MINHASHES * (1 - J)."""
    z = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)
    left = F.greatest(F.lit(1.0) - 2.0 * z / SKETCH_BITS, F.lit(1e-9))
    return 1.0 + F.log(left) * (SKETCH_BITS / 4.0 / MINHASHES)


def confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= percent * union. nodes: node, n_shingles, sketch, items."""
    light = nodes.select("node", "n_shingles", "sketch")
    of = lambda side, df: df.select(*[F.col(c).alias(c if c == "node" else f"{c}_{side}") for c in df.columns]).withColumnRenamed("node", side)
    near = (
        pairs.join(of("a", light), "a").join(of("b", light), "b")
        .where(F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * percent)
        .where(estimate(F.col("sketch_a"), F.col("sketch_b")) >= percent / 100 - SLACK)
        .select("a", "b")
    )
    sets = nodes.select("node", "items")
    both = near.join(of("a", sets), "a").join(of("b", sets), "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(shared * 100 >= (F.size("items_a") + F.size("items_b") - shared) * percent).select("a", "b")


def _labels(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """`nodes` with label: the component of its node, or the node itself."""
    return nodes.join(components, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _open(members: DataFrame) -> DataFrame:
    """Members (key, node, label) of buckets that hold more than one label, with the bucket's size and its commonest label.

    Both sides are written out, so that the join is a stage by itself, whose hot buckets AQE splits.
    """
    members = materialize(members, "labelled")
    counts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    return members.join(materialize(mixed.select("key", "size", F.col("top.label").alias("most"), F.col("top.n").alias("n_most")), "mixed"), "key")


def _cells(members: DataFrame) -> DataFrame:
    """key, i, j, own, node, label: the members of each pair of blocks of a bucket.

    Members of the commonest label are linked already, so their blocks meet only
    those of the others: one large group and some strangers make no square of cells.
    """
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    many, few = blocks(F.col("n_most")), blocks(F.col("size") - F.col("n_most"))
    common, spread = F.col("label") == F.col("most"), F.xxhash64("node")
    own = F.when(common, F.pmod(spread, many)).otherwise(many + F.pmod(spread, few)).cast("int")
    others = F.sequence(F.when(common, many).otherwise(F.lit(0)), many + few - 1)
    cells = members.withColumns({"own": own, "others": others}).withColumn("other", F.explode("others"))
    return cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")


def _partners(group: pa.Table, percent: int):
    """Row numbers r, s of the pairs of a cell that may be linked, each pair once, in the first band that it shares; some rows at a time."""
    key = group.column("key")[0].as_py()
    label, node, own, n = (group.column(c).to_numpy() for c in ("label", "node", "own", "n_shingles"))
    wide = lambda c: group.column(c).combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    bands, sketch = wide("bands"), wide("sketch").view(np.uint64)
    band = int(np.flatnonzero((bands == key).all(0))[0])
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    floor = math.floor(percent * 10) / 1000 - SLACK
    step = max(1, CELL_PAIRS // len(node))
    for at in range(0, len(node), step):
        r = slice(at, at + step)
        fine = (label[r, None] != label) & (np.minimum(n[r, None], n) * 100 >= np.maximum(n[r, None], n) * percent)
        fine &= (node[r, None] < node) if i == j else (own[r, None] == i) & (own != i)
        x, y = np.nonzero(fine)
        x += at
        rough = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1)
        near = 1 + np.log(np.maximum(1 - 2.0 * rough / SKETCH_BITS, 1e-9)) * (SKETCH_BITS / 4 / MINHASHES) >= floor
        x, y = x[near], y[near]
        first = ~(bands[x, :band] == bands[y, :band]).any(1)
        if first.any():
            yield x[first], y[first]


def _rest(members: DataFrame, nodes: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Confirmed links a, b between members of different labels, by blocks of each bucket; links inside a joined group are left out.

    First the blocks meet with their sketches only and tell who has a partner; full sets are sent for those.
    """

    def hopeful(group: pa.Table) -> pa.Table:
        hit = np.zeros(len(group), bool)
        for r, s in _partners(group, percent):
            hit[r] = True
            hit[s] = True
        return group.select(["key", "i", "j", "own", "node", "label"]).filter(pa.array(hit))

    def compare(group: pa.Table) -> pa.Table:
        label, node = group.column("label").to_numpy(), group.column("node").to_numpy()
        items = [np.asarray(x.values, np.int64) for x in group.column("items")]
        root = {x: x for x in label.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for rows in _partners(group, percent):
            for r, s in zip(*(x.tolist() for x in rows)):
                x, y = find(label[r]), find(label[s])
                if x == y:
                    continue
                shared = len(np.intersect1d(items[r], items[s], assume_unique=True))
                if shared * 100 >= (len(items[r]) + len(items[s]) - shared) * percent:
                    root[x] = y
                    out.append((node[r], node[s]))
        a = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    schema = "key long, i int, j int, own int, node long, label long"
    light = reps.select("node", "n_shingles", "bands", "sketch")
    cells = materialize(_cells(members).join(light, "node").groupBy("key", "i", "j").applyInArrow(hopeful, schema), "hopeful")
    full = cells.join(light, "node").join(nodes.select("node", "items"), "node")
    return full.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _placed(documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, th, n_shingles, component_id, label (of the component; null for empty sets) of every document."""
    found = materialize(features(documents, shingle), "features")
    name = F.struct(F.coalesce("doc_id", F.lit(NAMELESS)).alias("id"), "th")
    same = found.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.min(name).alias("own"), F.first(F.struct("bands", "sketch")).alias("x"))
    # Written once, so that the numbers stay.
    reps = materialize(same.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n_shingles", "doc", "own", "x.bands", "x.sketch"), "classes")
    rows = reps.select(F.explode("bands").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead")).where("size > 1")
    members = materialize(rows.join(materialize(shared.select("key", "lead"), "shared"), "key"), "members")
    wanted = reps.join(members.select("node").distinct(), "node", "left_semi")
    names = wanted.select("own.id", "own.th").distinct()
    texts = _named(documents).withColumn("id", F.coalesce("doc_id", F.lit(NAMELESS))).join(names, ["id", "th"], "left_semi")
    sets = full_sets(texts, shingle).groupBy("s1", "s2", "n_shingles").agg(F.first("items").alias("items"))
    nodes = materialize(sets.join(wanted, ["s1", "s2", "n_shingles"]).select("node", "n_shingles", "sketch", "items"), "sets")

    tested = members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    edges = materialize(confirmed(tested, nodes, percent), "links")
    components = materialize(connected_components(edges), "components")
    left = materialize(_open(_labels(members.select("key", "node"), components)), "open")
    for turn in range(1, STAR_ROUNDS):
        if left.isEmpty():
            break
        lead = left.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("lead"))
        lead = materialize(lead, "leads")
        pairs = left.join(lead, "key").where("label <> lead.label").select(F.greatest("node", "lead.node").alias("a"), F.least("node", "lead.node").alias("b")).distinct()
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
        more = materialize(confirmed(pairs, nodes, percent), "links")
        if more.isEmpty():
            continue
        edges = edges.unionByName(more)
        components = materialize(connected_components(edges), "components")
        left = materialize(_open(_labels(members.select("key", "node"), components)), "open")
    if not left.isEmpty():
        more = materialize(_rest(left, nodes, reps, percent), "links")
        if not more.isEmpty():
            components = materialize(connected_components(edges.unionByName(more)), "components")

    classes = _labels(reps.select("node", "s1", "s2", "n_shingles", "doc"), components)
    classes = materialize(classes, "placed-classes")
    least = materialize(classes.groupBy("label").agg(F.min("doc").alias("component_id")), "least")
    classes = classes.join(least, "label").select("s1", "s2", "n_shingles", "label", "component_id")
    out = found.select("doc_id", "th", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    # An empty set is a component by itself.
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    out = _placed(documents, shingle, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def representatives(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of `documents`, with all its columns, of each component: that of the smallest doc_id (none last), then of the smallest text hash.

    Texts without words are components by themselves; of repeated (doc_id, text) rows one stays, the smallest by the other columns.
    """
    placed = materialize(_placed(documents, shingle, percent), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(NAMELESS)).alias("_kf_id"), F.col("th").alias("_kf_th"))
    first = placed.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("x")).select("x._kf_id", "x._kf_th")
    empty = placed.where("label IS NULL").select(F.coalesce("doc_id", F.lit(NAMELESS)).alias("_kf_id"), F.col("th").alias("_kf_th"))
    rows = placed.groupBy(F.coalesce("doc_id", F.lit(NAMELESS)).alias("_kf_id"), F.col("th").alias("_kf_th")).agg(F.count(F.lit(1)).alias("_kf_n"))
    chosen = materialize(rows.join(first.unionByName(empty).distinct(), ["_kf_id", "_kf_th"], "left_semi"), "chosen")
    named = documents.withColumns({"_kf_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)), "_kf_th": F.xxhash64("text")})
    single = named.join(chosen.where("_kf_n = 1"), ["_kf_id", "_kf_th"], "left_semi").select(*documents.columns)
    # Rows that are there several times: the window is cut to one row a name in each input partition before the shuffle.
    by = Window.partitionBy("_kf_id", "_kf_th").orderBy(*[F.col(f"`{c}`").cast("string") for c in documents.columns if c not in ("doc_id", "text")], F.lit(0))
    several = named.join(chosen.where("_kf_n > 1").select("_kf_id", "_kf_th"), ["_kf_id", "_kf_th"], "left_semi").withColumn("_kf_r", F.row_number().over(by)).where("_kf_r = 1")
    return single.unionByName(several.select(*documents.columns))
