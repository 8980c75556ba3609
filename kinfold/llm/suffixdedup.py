"""Exact removal of repeated byte strings with a distributed difference-cover suffix array.

A byte goes if a string of `length` bytes that covers it also starts anywhere
else in the table. The suffix array is distributed by content:

1. Every window of `length` bytes is dealt to its anchor, the leftmost smallest
   hash of the GRAM-byte strings in it. Equal windows have equal anchors at
   equal places, so they meet under one anchor key; windows of one anchor are
   neighbours and form one block of at most 2 * length bytes.
2. Only blocks under an anchor key seen twice or more go on. Equal blocks
   become one block with a count.
3. Blocks are dealt to buckets of bounded size by anchor key. In a bucket the
   difference-cover algorithm (DC3) builds the suffix array: it sorts the
   triples at two of three places, recurses on their names, and merges the
   remaining suffixes. The recursion ends where names are unique or stand for
   `length` bytes, as no longer prefix matters. All places are named, but only
   the starts of windows (and what their order needs) are merged.
4. Adjacent suffixes of the array are compared on their first `length` bytes; a
   window repeats if its neighbour is equal or its block stands for several.
5. Repeated windows return to all places of their block, and texts are cut.

An anchor key with more than HOT_BLOCKS different blocks (a passage shared by
very many texts, each with surroundings of its own) would exceed a bucket; its
windows are counted by 128-bit fingerprints instead, aggregated before and
after the shuffle, which is exact and spreads over all tasks.

Edge cases: null text is empty; texts under `length` bytes keep all; repeated
rows count as other places; matches never cross texts; (doc_id, text) names a
row, so null or repeated doc_ids do no harm; long texts are searched whole, in
overlapping pieces; an empty table gives none. Other columns than doc_id and
text are passed on by `without_repeats` and not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import textvec as tv
from kinfold.llm.common import arrow_map, materialize, partitions

GRAM = 32
#: Bytes of block text in one bucket, on average, and at most in one anchor key's blocks.
BUCKET_BYTES = 1 << 20
HOT_BLOCKS = 8000
BROADCAST_KEYS = 200_000
#: A text is searched for anchors in pieces of so many bytes, which overlap by one window.
PIECE = 8 << 20
#: Bytes of short texts that are searched at once: their hashes stay in the processor's cache.
SLICE = 1 << 18
_PLACE = tv.U64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on (the last GRAM - 1 places are left out)."""
    h, width = tv.BYTE_KEYS[data], 1
    while width < GRAM:
        h = h[:-width] * tv.BASE + h[width:]
        h ^= h >> tv.U64(29)
        width *= 2
    return tv.mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor, and the first and last window start dealt to it; places count from the start of `data`."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(data)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    grams, width = length - GRAM + 1, 1
    while 2 * width <= grams:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if grams > width:
        key = np.minimum(key[: len(key) - (grams - width)], key[grams - width :])
    starts = np.arange(len(key))
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(key)]
    starts = starts[starts + length <= ends]
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    place = (key[starts] & _PLACE).astype(np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return place[first], h[place[first]], starts[first], starts[last]


def _sorted(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of `keys` (0 to bound - 1; ties in any order), and `keys` in that order."""
    bits = max(1, len(keys) - 1).bit_length()
    if bound << bits < 1 << 63:  # Numbers with their places in the low bits sort faster than places do.
        packed = keys << bits | np.arange(len(keys))
        packed.sort()
        return packed & ((1 << bits) - 1), packed >> bits
    order = np.argsort(keys)
    return order, keys[order]


def dc3(s: np.ndarray, reach: int, length: int, need: np.ndarray | None = None) -> np.ndarray:
    """Places of `s` in the order of their suffixes, judged by the first `length` or more characters.

    s: int64 >= 0, a multiple of three long. reach: characters of the text that one symbol of `s` stands for.
    need: flags of the places that are asked for (all, if none); the others are named, as they are part of
    suffixes, but not merged.
    """
    n, third = len(s), len(s) // 3
    padded = np.append(s, np.zeros(3, np.int64))
    need = np.ones(n, bool) if need is None else need
    size = int(s.max(initial=0)) + 1
    # Sort the triples at 1 mod 3, then those at 2 mod 3, and name them by their order.
    a, b, c, d = (padded[k : k + n : 3][:third] for k in (1, 2, 3, 4))
    if size <= 1 << 21:
        triple = np.concatenate([(a * size + b) * size + c, (b * size + c) * size + d])
        order, ordered = _sorted(triple, size**3)
        new = ordered[1:] != ordered[:-1]
        del triple, ordered
    else:
        columns = [np.concatenate(x) for x in ((a, b), (b, c), (c, d))]
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order) - 1, bool)
        for column in columns:
            column = column[order]
            new |= column[1:] != column[:-1]
    names = np.empty(2 * third, np.int64)
    names[order] = np.append(1, 1 + np.cumsum(new)) if len(order) else 0
    if len(order) and not new.all() and 3 * reach < length:
        # Recurse on the names. Merging a place takes the ranks of the two behind it.
        fill = -len(names) % 3
        want = np.append(need, [False, False])
        want[1:] |= np.append(need, False)
        want[2:] |= need
        below = np.concatenate([want[1:n:3], want[2:n:3], np.zeros(fill, bool)])
        order = dc3(np.append(names, np.zeros(fill, np.int64)), 3 * reach, length, below)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[1:n:3] = names[:third]
    rank[2:n:3] = names[third:]
    # Sort the remaining suffixes by their first character and the rank behind it, then merge.
    width = 2 * third + 2
    zeros = 3 * np.flatnonzero(need[::3])
    by_rest, rest = _sorted(padded[zeros] * width + rank[zeros + 1], size * width)
    zeros = zeros[by_rest]
    first = order < third
    ordered = np.where(first, 3 * order + 1, 3 * (order - third) + 2)
    asked = need[ordered]
    ordered, first = ordered[asked], first[asked]
    one, two = ordered[first], ordered[~first]
    before_one = np.searchsorted(padded[one] * width + rank[one + 1], rest)
    pair = lambda at: padded[at] * size + padded[at + 1]
    of_two, of_zeros = pair(two), pair(zeros)
    if size * size * width >= 1 << 63:
        index = np.unique(np.concatenate([of_two, of_zeros]), return_inverse=True)[1]
        of_two, of_zeros = index[: len(two)], index[len(two) :]
    before_two = np.searchsorted(of_two * width + rank[two + 2], of_zeros * width + rank[zeros + 2])
    out = np.empty(len(zeros) + len(ordered), np.int64)
    taken = np.zeros(len(out), bool)
    at = before_one + before_two + np.arange(len(zeros))
    # Counts in the merged sample never fall; equal prefixes may give equal places in any order.
    at = np.maximum.accumulate(at - np.arange(len(zeros))) + np.arange(len(zeros))
    out[at] = zeros
    taken[at] = True
    out[~taken] = ordered
    return out


def repeated(blocks: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each block a flag for each of its window starts: does the window also start elsewhere?"""
    sizes = np.array([len(b) for b in blocks], np.int64)
    # A zero byte ends each block; as a symbol it is less than all bytes.
    raw = np.frombuffer(b"\0".join(blocks) + bytes(2 * length + 1), np.uint8)
    raw = np.append(raw, np.zeros(-len(raw) % 3, np.uint8))
    at = np.cumsum(sizes + 1) - sizes - 1
    text = raw.astype(np.int64) + 1
    text[at + sizes] = 0
    text[int(sizes.sum()) + len(blocks) :] = 0
    edge = np.zeros(len(text) + 1, np.int32)
    edge[at] = 1
    edge[at + sizes - length + 1] = -1
    starts = np.cumsum(edge[:-1]).astype(bool)
    edge[at] = counts > 1
    edge[at + sizes - length + 1] = -(counts > 1).astype(np.int32)
    many = np.cumsum(edge[:-1]).astype(bool)
    array = dc3(text, 1, length, starts)
    # Compare adjacent prefixes eight bytes at a time; most pairs end at the first word.
    wide = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,)).copy()
    a, b = array[:-1], array[1:]
    for k in [*range(0, length - 8, 8), length - 8]:
        same = wide[a + k] == wide[b + k]
        a, b = a[same], b[same]
    many[a] = True
    many[b] = True
    return [many[x : x + n - length + 1] for x, n in zip(at.tolist(), sizes.tolist())]


def runs_of(flags: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Byte ranges that the flagged windows cover, as starts and ends."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] + length - 1).tolist()


def _blocks(texts: DataFrame, length: int) -> DataFrame:
    """h (anchor key), c (block), id, th, at (place << 16 | windows before the anchor << 8 | windows - 1) of each block of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tv.raw_bytes(batch.column("text"))
        rows, hs, cs, ats = [], [], [], []
        for i, j in tv.slices(offsets, SLICE):
            base, end = int(offsets[i]), int(offsets[j])
            for start in range(base, max(base + 1, end - length + 1), PIECE):
                part = data[start : min(end, start + PIECE + length - 1)]
                off = np.clip(offsets[i : j + 1] - start, 0, len(part))
                place, h, lo, hi = anchors(part, off, length)
                row = np.searchsorted(off, lo, "right") - 1
                raw = part.tobytes()
                cs.append(np.array([xxhash.xxh3_64_intdigest(raw[a : b + length], p - a) for p, a, b in zip(place.tolist(), lo.tolist(), hi.tolist())], np.uint64))
                rows.append(row + i)
                hs.append(h)
                ats.append((lo + start - offsets[row + i]) << 16 | (place - lo) << 8 | (hi - lo))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        row = pa.array(join(rows, np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(join(hs, np.uint64).view(np.int64)), pa.array(join(cs, np.uint64).view(np.int64)), batch.column("id").take(row), batch.column("th").take(row), pa.array(join(ats, np.int64).astype(np.int64))],
            ["h", "c", "id", "th", "at"],
        )

    return arrow_map(texts.select("id", "th", "text"), run, "h long, c long, id long, th long, at long")


#: Columns that name a row beside those of the input.
ID, TH, SPANS = "_kf_id", "_kf_th", "_kf_spans"


def _named(documents: DataFrame) -> DataFrame:
    """`documents` with a key that is never null: ID and TH."""
    return documents.withColumns({ID: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), TH: F.xxhash64(F.coalesce("text", F.lit("")))})


def covered(documents: DataFrame, length: int = 200) -> DataFrame:
    """id, th, spans: for each row with repeated strings the (begin, end) byte ranges that they cover, not merged."""
    if not GRAM + 1 <= length <= GRAM + 255:
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + 255}")
    named = _named(documents).select(F.col(ID).alias("id"), F.col(TH).alias("th"), "text")
    places = materialize(_blocks(named, length), "blocks")
    # Written out, so that the join is a stage by itself, whose hot keys AQE splits.
    twice = materialize(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "keys")
    places = materialize(places.join(twice, "h", "left_semi"), "twice")
    block = materialize(places.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "at")).alias("own")), "block")
    kinds = block.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    hot = materialize(kinds.where(F.col("kinds") > HOT_BLOCKS).select("h", F.lit(True).alias("hot")), "hot")
    if hot.count() <= BROADCAST_KEYS:  # 9 bytes each; beyond, an equi-join whose large side AQE can split
        hot = F.broadcast(hot)
    # Each block's bytes are taken from the first text that has it.
    owners = block.join(hot, "h", "left").groupBy("own.id", "own.th").agg(F.collect_list(F.struct("h", "c", "n", F.col("own.at").alias("at"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("blocks"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for text, blocks in zip(batch.column("text"), batch.column("blocks").to_pylist()):
            raw = (text.as_py() or "").encode("utf-8")
            for b in blocks:
                lo, windows = b["at"] >> 16, (b["at"] & 255) + 1
                for column, value in zip(out, (b["h"], b["c"], b["n"], b["hot"], raw[lo : lo + windows + length - 1])):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["h", "c", "n", "hot", "data"])

    bytes_of = arrow_map(named.join(owners, ["id", "th"]).select("text", "blocks"), cut, "h long, c long, n long, hot boolean, data binary")
    # Repeated (id, text) rows hand in the same block again.
    bytes_of = materialize(bytes_of, "bytes")
    total, any_hot = bytes_of.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.coalesce(F.max("hot"), F.lit(False))).first()
    buckets = max(partitions(documents.sparkSession), -(-int(total) // BUCKET_BYTES))
    where = F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")

    def sort(group: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], int] = {}
        for k, key in enumerate(zip(group.column("h").to_pylist(), group.column("c").to_pylist())):
            seen.setdefault(key, k)
        rows = group.take(list(seen.values()))
        flags = repeated(rows.column("data").to_pylist(), rows.column("n").to_numpy(), length)
        spans = [runs_of(f, length) for f in flags]
        keep = [k for k, s in enumerate(spans) if s[0]]
        ints = pa.list_(pa.int32())
        return pa.table([rows.column("h").take(keep), rows.column("c").take(keep), pa.array([spans[k][0] for k in keep], ints), pa.array([spans[k][1] for k in keep], ints)], ["h", "c", "begins", "ends"])

    found = bytes_of.where("NOT hot").groupBy(where).applyInArrow(sort, "h long, c long, begins array<int>, ends array<int>")
    if any_hot:
        found = found.unionByName(_hot_windows(bytes_of.where("hot").dropDuplicates(["h", "c"]), length))
    found = materialize(found, "repeats")
    hits = places.join(found, ["h", "c"]).select("id", "th", F.shiftright("at", 16).alias("lo"), "begins", "ends").distinct()
    return hits.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "begins", "ends")).alias("spans"))


def _hot_windows(blocks: DataFrame, length: int) -> DataFrame:
    """h, c, begins, ends of the repeated windows of blocks under hot anchor keys, by counted fingerprints."""

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[int]] = [[], [], [], [], [], []]
        for h, c, n, data in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "n", "data"))):
            for k in range(len(data) - length + 1):
                f = xxhash.xxh3_128_intdigest(data[k : k + length])
                for column, value in zip(out, (h, c, n, k, (f >> 64) - (1 << 63), (f & (1 << 64) - 1) - (1 << 63))):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["h", "c", "n", "k", "f1", "f2"])

    each = arrow_map(blocks.select("h", "c", "n", "data"), windows, "h long, c long, n long, k long, f1 long, f2 long")
    again = each.groupBy("f1", "f2").agg(F.sum("n").alias("n")).where("n > 1").select("f1", "f2")
    hit = each.join(again, ["f1", "f2"], "left_semi").groupBy("h", "c").agg(F.array_sort(F.collect_list(F.col("k").cast("int"))).alias("begins"))
    return hit.select("h", "c", "begins", F.transform("begins", lambda k: k + length).alias("ends"))


def _ranges(spans: pa.Array) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of a column of spans: each row's first range (n + 1), and begin and end of every range in its text."""
    each = spans.flatten()
    count = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    begins, ends = pc.struct_field(each, "begins"), pc.struct_field(each, "ends")
    inner = pc.list_value_length(begins).to_numpy(zero_copy_only=False)
    lo = np.repeat(pc.struct_field(each, "lo").to_numpy(zero_copy_only=False), inner)
    at = np.append(0, np.cumsum(inner))[np.append(0, np.cumsum(count))]
    return at.tolist(), lo + begins.flatten().to_numpy(zero_copy_only=False), lo + ends.flatten().to_numpy(zero_copy_only=False)


def _mask(size: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.cumsum(np.bincount(begins, minlength=size + 1) - np.bincount(ends, minlength=size + 1))[:-1] > 0


def _apply(documents: DataFrame, length: int) -> DataFrame:
    """`documents` with SPANS: what is covered of each row."""
    spans = covered(documents, length).withColumnsRenamed({"id": ID, "th": TH, "spans": SPANS})
    return _named(documents).join(spans, [ID, TH], "left")


def digests(documents: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, runs, hashes = [], [], [], []
        at, begins, ends = _ranges(batch.column("spans"))
        for text, i, j in zip(batch.column("text"), at[:-1], at[1:]):
            raw = (text.as_py() or "").encode("utf-8")
            if j > i:
                gone = _mask(len(raw), begins[i:j], ends[i:j])
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            else:
                kept = raw
                removed.append(0)
                runs.append(0)
            sizes.append(len(raw))
            hashes.append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(hashes, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(_apply(documents, length).select("doc_id", "text", F.col(SPANS).alias("spans")), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, length: int = 200) -> DataFrame:
    """`documents` with the repeated bytes cut from `text` (broken characters at the cuts go, too); texts left empty are dropped, empty ones kept."""
    columns = documents.columns
    joined = _apply(documents, length).select(*columns, SPANS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = columns.index("text")
        texts, keep = [], []
        at, begins, ends = _ranges(batch.column(len(columns)))
        for text, i, j in zip(batch.column(place), at[:-1], at[1:]):
            value = text.as_py()
            if j > i:
                raw = value.encode("utf-8")
                value = np.frombuffer(raw, np.uint8)[~_mask(len(raw), begins[i:j], ends[i:j])].tobytes().decode("utf-8", "ignore")
            keep.append(j == i or bool(value.strip()))
            texts.append(value)
        out = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(len(columns))]
        return pa.RecordBatch.from_arrays(out, columns).filter(pa.array(keep, pa.bool_()))

    return arrow_map(joined, run, documents.schema)
