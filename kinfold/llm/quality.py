"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal, scored as sparse dot products.

A text is cut into word runs and punctuation runs. Its features are hashed
into 2^18 slots: n-grams (1 and 2) of the lowered tokens, and n-grams (1 and 2)
of their shapes (case, digits, or the punctuation itself; a repeat of the token
before has a shape of its own). A feature's value is its count divided by the
token count, times a constant, so that the dot product is a mean of weights.

Where all labelled rows are learned from, each shard of about TRAIN_ROWS rows
(by the hash of doc_id) has a model of its own, and the weights are their mean
(parameter mixture), so training spreads over the tasks.

Edge cases: null, empty or token-free texts score from the intercept alone; a
null doc_id is never learned from and is not held out; repeated rows give
repeated results; of a labelled doc_id that several rows share, the text of the
smallest hash is learned, with each of its labels; texts are read whole, however
long; without a labelled row the score is 0.5 everywhere. Other columns than
doc_id and text are not read, and passed on by `accept`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import textvec as tv
from kinfold.llm.common import arrow_map, hash_sample, held_out

BITS = 18
SCALE = 12.0
#: At most this many labelled rows, those of the smallest hash of doc_id, are learned from; where all are asked for, about as many by one task.
TRAIN_ROWS = 6000
#: Whole numbers in one, for sums of weights (within 64 bits up to some 10^9 rows while weights stay under 8).
UNIT = 1 << 30

_KIND = np.full(256, 2, np.int8)
_KIND[tv.WHITE] = 0
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_lo:_hi] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_SMALL = np.zeros(256, np.int32)
_SMALL[97:123] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of every n-gram of every text, the row each belongs to, and each row's token count."""
    kind = _KIND[data]
    starts = tv.runs(kind, offsets)
    at = np.searchsorted(starts, offsets)
    count = np.diff(at)
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    token = tv.run_hashes(tv.LOWER[data], kind != 0, starts)
    word = kind[starts] == 1
    upper, small, digit = (np.add.reduceat(t[data], starts) for t in (_UPPER, _SMALL, _DIGIT))
    code = np.minimum(upper, 2) + 3 * np.minimum(small, 1) + 6 * np.minimum(digit, 1)
    shape = np.where(word, code.astype(np.uint64) + tv.U64(7), token)
    owner = np.repeat(np.arange(len(count)), count)
    joined = owner[1:] == owner[:-1]
    same = np.zeros(len(token), bool)
    same[1:] = joined & (token[1:] == token[:-1])
    shape = np.where(same, tv.U64(3), shape)
    pair = np.flatnonzero(joined)
    grams = [
        token,
        tv.mix(token[pair] * tv.BASE + token[pair + 1]),
        tv.mix(shape + tv.U64(1 << 40)),
        tv.mix(shape[pair] * tv.U64(0x2545F4914F6CDD1D) + shape[pair + 1] + tv.U64(1)),
    ]
    slots = np.concatenate(grams) >> tv.U64(64 - BITS)
    rows = np.concatenate([owner, owner[pair], owner, owner[pair]])
    return slots.astype(np.int64), rows, count


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every text."""
        out = np.full(len(offsets) - 1, self.bias)
        for i, j in tv.slices(offsets):
            slots, rows, count = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            dot = np.bincount(rows, self.weights[slots], j - i)
            out[i:j] += SCALE * dot / np.maximum(count, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2) -> Model:
    """Follow-the-regularised-leader (proximal, per coordinate) over (slots, values, label) rows. Slot 2^BITS is the intercept."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(7)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            slots, values, label = samples[k]
            values = values.astype(np.float64, copy=False)
            zi, ni = z[slots], n[slots]
            w = weight(zi, ni)
            p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ values)))))
            g = (p - label) * values
            more = ni + g * g
            z[slots] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[slots] = more
    w = weight(z, n)
    return Model(w[:size].astype(np.float32), float(w[size]))


def each_sparse_row(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots and values of each text, with the intercept last."""
    for i, j in tv.slices(offsets):
        slots, rows, count = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        key, tf = np.unique(rows << BITS | slots, return_counts=True)
        cut = np.searchsorted(key >> BITS, np.arange(j - i + 1))
        for r in range(j - i):
            part = slice(cut[r], cut[r + 1])
            yield np.append(key[part] & ((1 << BITS) - 1), 1 << BITS), np.append(tf[part] * (SCALE / max(1, count[r])), 1.0)


def sparse_rows(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """All of `each_sparse_row`."""
    return list(each_sparse_row(data, offsets))


def samples_of(shard: pa.Table) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(slots, values, label) of the rows of `shard` (doc_id, y, text), by doc_id and label, which name a row. Held in 8 bytes a slot."""
    texts = each_sparse_row(*tv.raw_bytes(shard.column("text")))
    rows = [(d, y, s.astype(np.int32), v.astype(np.float32)) for d, y, (s, v) in zip(shard.column("doc_id").to_pylist(), shard.column("y").to_pylist(), texts)]
    rows.sort(key=lambda x: x[:2])
    return [(s, v, y) for _, y, s, v in rows]


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", learn=None, train_rows: int | None = TRAIN_ROWS) -> Model:
    """Fit on at most `train_rows` labelled rows that `learn` (a Column over doc_id) admits, or on all of them (None)."""
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if learn is not None:
        chosen = chosen.where(learn)
    chosen, shards = chosen.distinct(), 1
    if train_rows is None:
        shards = max(1, -(-chosen.count() // TRAIN_ROWS))
    else:
        # A threshold by the count leaves about 1.5 * train_rows ids, of which the smallest hashes are taken.
        chosen = hash_sample(chosen, chosen.count(), train_rows, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)
        chosen = F.broadcast(chosen)  # bounded by train_rows
    one = Window.partitionBy("doc_id", "y").orderBy(F.xxhash64("text"), "text")
    sample = documents.select("doc_id", "text").join(chosen, "doc_id").withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")

    def fit(shard: pa.Table) -> pa.Table:
        samples = samples_of(shard)
        m = ftrl(samples)
        used = np.flatnonzero(m.weights)
        weights = np.append(m.weights[used].astype(np.float64), m.bias) * len(samples)
        # Whole numbers, so that sums do not depend on their order; the last slot has the bias, the one before the rows.
        out = np.append(np.rint(weights * UNIT).astype(np.int64), len(samples))
        return pa.table([pa.array(np.append(used, [1 << BITS, (1 << BITS) + 1]).astype(np.int32)), pa.array(out)], ["slot", "total"])

    # A task fits a shard of about TRAIN_ROWS rows, however many there are; the model is the mean of the shards' models by rows. It is bounded by 2^BITS.
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard")
    found = sample.groupBy(shard).applyInArrow(fit, "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total"))
    got = found.toArrow()
    slots, total = got.column("slot").to_numpy(), got.column("total").to_numpy()
    model = Model(np.zeros(1 << BITS, np.float32), 0.0)
    if len(slots):
        n = int(total[slots == (1 << BITS) + 1][0])
        model.bias = float(total[slots == 1 << BITS][0]) / UNIT / n
        model.weights[slots[slots < 1 << BITS]] = total[slots < 1 << BITS] / UNIT / n
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """`documents` (columns doc_id, text) as doc_id, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.scores(*tv.raw_bytes(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, score double")


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns only where crc32(doc_id) mod 3 is not 1."""
    out = held_out(3, 1)
    model = train(documents, labels, learn=~out)
    return score(documents, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `documents`, with all their columns, whose score reaches the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.scores(*tv.raw_bytes(batch.column(place))) >= threshold))

    return arrow_map(documents, run, documents.schema)
