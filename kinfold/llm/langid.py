"""Language identification with hyperdimensional profiles.

Each letter symbol has a random vector of +-1. A trigram binds its letters:
the product of the first vector, the second rotated by one place and the third
rotated by two. A text's vector bundles (sums) the vectors of all its trigrams;
a language's prototype bundles the unit vectors of its training texts. The
prediction is the prototype of the largest cosine.

Texts that resemble no learned language are told by a floor under the cosine.
It depends on the number of trigrams, since short texts are noisier, and is
calibrated on the training texts and on pieces of them: FLOOR_SHARE of the
FLOOR_QUANTILE-quantile of their cosines with the rest of their own language,
and at least LEAST_FLOOR.

Symbols: runs of anything but letters are one blank; a-z have a symbol each,
other lower-cased letters share the remaining symbols by code point.

Edge cases: a null text, or one without any letter, is `und` with score 0;
ties between languages go to the smaller name; a null doc_id is not held out, so
its row is learned from if it has a lang; a lang `und` is never learned; repeated
rows repeat (and may all be in the sample); texts are read whole, however long;
without training rows all is `und`. Other columns than doc_id, text and lang are
not read, and passed on by `accept`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import textvec as tv
from kinfold.llm.common import arrow_map, held_out, materialize

DIMENSIONS = 1024
SYMBOLS = 64
UND = "und"
#: Training texts taken of each language at most, unless all are asked for: those of the smallest hashes of doc_id and text. Every language is learned.
TRAIN_PER_LANG = 800
#: Bytes and texts, and different trigrams, that are turned into vectors at once.
STEP_BYTES, STEP_ROWS, STEP_TRIGRAMS = 1 << 19, 512, 2048
#: Whole numbers in one, for sums of vectors (exact up to 2^33 texts of a language) and for the cosines that floors are chosen among.
UNIT, GRID = 1 << 30, 1 << 20
#: The floor of `accept`, by the power of two of the number of trigrams.
FLOOR_QUANTILE, FLOOR_SHARE, LEAST_FLOOR = 0.005, 0.75, 0.05
SIZES = 24
#: Bytes of the pieces of training texts, for the floors of short texts.
PIECES = (24, 48, 96, 192, 400, 800, 1600)
#: Rows that a size needs for a floor of its own; else it has that of the next smaller size.
LEAST_ROWS = 50
BROADCAST_LANGS = 50_000


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its symbol, 0 for what is no letter; and the +-1 vectors of the symbols."""
    symbol = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()[0]
            symbol[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 7) % (SYMBOLS - 27)
    vectors = np.random.default_rng(11).integers(0, 2, (SYMBOLS, DIMENSIONS)).astype(np.int8) * 2 - 1
    return symbol, vectors


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    vectors = letters()[1]
    first, second, third = codes >> 12, codes >> 6 & 63, codes & 63
    return (vectors[first] * np.roll(vectors, 1, 1)[second] * np.roll(vectors, 2, 1)[third]).astype(np.float32)


def decode(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about STEP_BYTES and at most STEP_ROWS texts, so that the memory for vectors does not grow with a batch."""
    for i, j in tv.slices(offsets, STEP_BYTES):
        for a in range(i, j, STEP_ROWS):
            yield a, min(a + STEP_ROWS, j)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vector of every text (float32; zero without letters), whether it has a letter, and its number of trigrams."""
    n = len(offsets) - 1
    out, has, size = np.zeros((n, DIMENSIONS), np.float32), np.zeros(n, bool), np.zeros(n, np.int64)
    for i, j in steps(offsets):
        part = data[offsets[i] : offsets[j]]
        # Count the code points before each offset: those bytes that are not continuations.
        lead = np.append(0, np.cumsum((part & 0xC0) != 0x80))
        at = lead[offsets[i : j + 1] - offsets[i]]
        symbol = letters()[0][decode(part)].astype(np.int32)
        if len(symbol) != at[-1]:  # invalid UTF-8: decode each text by itself
            pieces = [letters()[0][decode(data[offsets[k] : offsets[k + 1]])].astype(np.int32) for k in range(i, j)]
            at = np.append(0, np.cumsum([len(p) for p in pieces]))
            symbol = np.concatenate(pieces)
        owner = np.repeat(np.arange(j - i), np.diff(at))
        has[i:j] = np.bincount(owner, symbol > 0, j - i) > 0
        # One blank for each run without letters, and one around each text.
        first = np.ones(len(symbol), bool)
        first[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0) | (owner[1:] != owner[:-1])
        symbol, owner = symbol[first], owner[first]
        grown = np.zeros(len(symbol) + 2 * (j - i), np.int32)
        place = np.arange(len(symbol)) + 2 * owner + 1
        grown[place] = symbol
        who = np.repeat(np.arange(j - i), np.bincount(owner, minlength=j - i) + 2)
        code = grown[:-2] << 12 | grown[1:-1] << 6 | grown[2:]
        fine = (who[2:] == who[:-2]) & (grown[1:-1] > 0)
        code, who = code[fine], who[2:][fine]
        size[i:j] = np.bincount(who, minlength=j - i)
        if not len(code):
            continue
        # A code has 18 bits: a table of them numbers those that occur, without a sort.
        there = np.zeros(1 << 18, np.int32)
        there[code] = 1
        found = np.flatnonzero(there)
        there[found] = np.arange(len(found))
        index = there[code]
        # Whole numbers under 2^24, so the sums are the same in any order.
        for low in range(0, len(found), STEP_TRIGRAMS):
            table = trigram_vectors(found[low : low + STEP_TRIGRAMS])
            fine = slice(None) if len(found) <= STEP_TRIGRAMS else (index >= low) & (index < low + STEP_TRIGRAMS)
            at, text, width = index[fine] - low, who[fine], len(table)
            step = max(1, (1 << 20) // width)
            cut = np.searchsorted(text, np.arange(j - i + 1))
            for a in range(0, j - i, step):
                b = min(a + step, j - i)
                own = slice(cut[a], cut[b])
                counts = np.bincount((text[own] - a) * width + at[own], minlength=(b - a) * width).reshape(b - a, -1)
                out[i + a : i + b] += counts.astype(np.float32) @ table
        norm = np.sqrt(np.einsum("ij,ij->i", out[i:j], out[i:j], dtype=np.float64))
        out[i:j] /= np.where(norm > 0, norm, 1)[:, None].astype(np.float32)
    return out, has, size


def sizes(n: np.ndarray) -> np.ndarray:
    """The power of two of a number of trigrams, from 0 to SIZES - 1."""
    return np.minimum(np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1, SIZES - 1)


@dataclass
class Profiles:
    names: list[str]
    prototypes: np.ndarray
    floors: np.ndarray

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predicted name, cosine (clipped to 0..1), and whether the cosine reaches the floor, of every text."""
        rows = len(offsets) - 1
        name, score, fine = np.full(rows, UND, object), np.zeros(rows), np.zeros(rows, bool)
        names = np.array(self.names, object)
        for i, j in steps(offsets) if self.names else ():
            vectors, has, n = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            cos = vectors @ self.prototypes.T
            best = cos.argmax(1)
            name[i:j] = np.where(has, names[best], UND)
            score[i:j] = np.where(has, np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1), 0.0)
            fine[i:j] = has & (score[i:j] >= self.floors[sizes(n)])
        return name, score, fine


def training_rows(documents: DataFrame, learn=None) -> DataFrame:
    """The rows of `documents` that `learn` admits, with a text and a language."""
    rows = documents.where(F.col("lang").isNotNull() & (F.col("lang") != UND) & F.col("text").isNotNull())
    return rows if learn is None else rows.where(learn)


def training_sample(documents: DataFrame, learn=None, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """lang, text of at most `per_lang` rows of each language."""
    rows = training_rows(documents, learn)
    order = F.xxhash64("doc_id", "text").alias("_order")
    rows = rows.select("doc_id", "lang", "text", order)
    # Rows under a threshold that follows from the language's count: about 1.5 * per_lang of them, so the ranking sees few rows, however many there are.
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "counts")
    if counts.count() <= BROADCAST_LANGS:  # else an equi-join, which AQE can split where a language is hot
        counts = F.broadcast(counts)
    share = F.least(F.lit(1.0), 1.5 * per_lang / F.col("_n"))
    few = rows.join(counts, "lang").where((F.col("_order").cast("double") + 2.0**63) / 2.0**64 < share)
    first = Window.partitionBy("lang").orderBy("_order", "doc_id", "text")
    return few.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_lang).select("lang", "text")


def train(documents: DataFrame, learn=None, per_lang: int | None = TRAIN_PER_LANG, floors: bool = False) -> Profiles:
    """Prototypes from at most `per_lang` texts of each language, or from all of them (None); with `floors`, those of `accept`, too."""
    rows = training_rows(documents, learn).select("lang", "text") if per_lang is None else materialize(training_sample(documents, learn, per_lang), "languages")
    sums = _sums(rows)
    names = sorted(k for k, v in sums.items() if np.any(v))
    prototypes = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names], np.float32).reshape(len(names), DIMENSIONS)
    return Profiles(names, prototypes, _floors(rows, {k: sums[k] for k in names}) if floors else np.full(SIZES, LEAST_FLOOR))


def _sums(rows: DataFrame) -> dict[str, np.ndarray]:
    """The sum of the unit vectors of each language's texts. Summed as whole numbers, so it does not depend on the order."""

    def batch_of(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "total"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            (data, offsets), langs = tv.raw_bytes(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
            for i, j in steps(offsets):
                vectors = np.rint(encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0] * np.float32(UNIT)).astype(np.int64)
                found, index = np.unique(langs[i:j].astype(str), return_inverse=True)
                for k, lang in enumerate(found.tolist()):
                    sums[lang] = sums.get(lang, 0) + vectors[index == k].sum(0)
                if len(sums) > STEP_ROWS:
                    yield batch_of(sums)
                    sums = {}
        if sums:
            yield batch_of(sums)

    # A vector for each task and language meets the others place by place, summed before and after the shuffle.
    each = rows.mapInArrow(bundle, "lang string, total array<long>").select("lang", F.posexplode("total").alias("place", "total"))
    whole = each.groupBy("lang", "place").agg(F.sum("total").alias("total")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("of"))
    return {r["lang"]: np.array(r["total"], np.float64) / UNIT for r in whole.select("lang", F.col("of.total").alias("total")).collect()}


def _floors(rows: DataFrame, sums: dict[str, np.ndarray]) -> np.ndarray:
    """The floor of each size, from the training texts and their pieces."""
    shared = rows.sparkSession.sparkContext.broadcast(sums)

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, out = shared.value, []
        (data, offsets), langs = tv.raw_bytes(batch.column("text")), batch.column("lang").to_pylist()
        for i, j in steps(offsets):
            raw = data[offsets[i] : offsets[j]].tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i])]
            whole = join(texts)
            rest = np.array([sums.get(k, np.zeros(DIMENSIONS)) for k in langs[i:j]]).reshape(j - i, DIMENSIONS) - whole[0]
            norm = np.linalg.norm(rest, axis=1)
            for length in (*PIECES, None):
                vectors, has, n = whole if length is None else join([t[:length].decode("utf-8", "ignore").encode() for t in texts])
                fine = has & (norm > 1e-6)
                cos = np.einsum("ij,ij->i", vectors, rest)[fine] / norm[fine]
                out.append(sizes(n)[fine].astype(np.int64) << 32 | np.floor((cos + 1) * GRID).astype(np.int64))
        key, n = np.unique(np.concatenate(out) if out else np.zeros(0, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & (1 << 32) - 1).astype(np.int32)), pa.array(n.astype(np.int64))], ["size", "cos", "n"])

    def join(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return encode(np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts])))

    counts = materialize(arrow_map(rows, own, "size int, cos int, n long").groupBy("size", "cos").agg(F.sum("n").alias("n")), "cosines")
    told = {k: max(LEAST_FLOOR, FLOOR_SHARE * (q / GRID - 1)) for k, (q, n) in _quantiles(counts).items() if n >= LEAST_ROWS}
    floors, now = np.full(SIZES, LEAST_FLOOR), LEAST_FLOOR
    for k in range(SIZES):
        floors[k] = now = told.get(k, now)
    return floors


def _quantiles(counts: DataFrame) -> dict[int, tuple[float, int]]:
    """For each size its FLOOR_QUANTILE-quantile, between the two nearest of all its values, and their number.

    First the counts of coarse cells, bounded by the grid, then the values of the two cells at most that hold the two ranks.
    """
    cell = F.shiftright("cos", 10).alias("cell")

    def at(rows: list, key: str, rank: int) -> tuple[int, int]:
        """The key at a rank, and the ranks before it."""
        before = 0
        for r in sorted(rows, key=lambda r: r[key]):
            if rank < before + r["n"]:
                return r[key], before
            before += r["n"]
        raise ValueError(rank)

    coarse: dict[int, list] = {}
    for r in counts.groupBy("size", cell).agg(F.sum("n").alias("n")).collect():
        coarse.setdefault(r["size"], []).append(r)
    want = {}
    for size, rows in coarse.items():
        total = sum(r["n"] for r in rows)
        rank = (total - 1) * FLOOR_QUANTILE
        low = int(rank)
        want[size] = total, rank - low, [(*at(rows, "cell", k), k) for k in (low, min(low + 1, total - 1))]
    cells = {(size, c) for size, (_, _, ends) in want.items() for c, _, _ in ends}
    if not cells:
        return {}
    chosen = F.struct("size", cell.alias("cell")).isin([F.struct(F.lit(a).alias("size"), F.lit(b).alias("cell")) for a, b in sorted(cells)])
    near: dict[tuple[int, int], list] = {}
    for r in counts.where(chosen).collect():
        near.setdefault((r["size"], r["cos"] >> 10), []).append(r)
    out = {}
    for size, (total, part, ends) in want.items():
        low, high = (at(near[size, c], "cos", k - before)[0] for c, before, k in ends)
        out[size] = low + part * (high - low), total
    return out


def predict(documents: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, score, _ = shared.value.predict(*tv.raw_bytes(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def language_ids(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only where crc32(doc_id) mod 5 is not 0."""
    out = held_out(5, 0)
    model = train(documents, learn=~out)
    return predict(documents, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def accept(documents: DataFrame, model: Profiles) -> DataFrame:
    """The rows, with all their columns, whose language is identified: letters, and a cosine that reaches the floor of the text's size."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.predict(*tv.raw_bytes(batch.column(place)))[2]))

    return arrow_map(documents, run, documents.schema)
