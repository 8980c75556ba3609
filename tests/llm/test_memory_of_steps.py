"""The work on a batch takes memory for a step of it, not for the batch; a shard of labelled rows is held in 8 bytes a slot."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import langid, neardup, quality
from kinfold.llm import textvec as tv


@pytest.fixture(scope="module")
def batch():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü", k=rng.randint(2, 9))) for _ in range(5000)]
    return pa.array([" ".join(rng.choices(words, k=500)) for _ in range(1200)])


def peak_mb(work) -> tuple[float, float, object]:
    """Peak and kept MB of `work`, and its result."""
    tracemalloc.start()
    try:
        result = work()
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return peak / 2**20, kept / 2**20, result


def test_steps_of_a_batch_bound_its_memory(batch):
    data, offsets = tv.raw_bytes(batch)
    assert len(data) > 3 << 20
    model = quality.Model(np.ones(1 << quality.BITS, np.float32), 0.0)
    langs = langid.Profiles(["a", "b"], np.ones((2, langid.DIMENSIONS), np.float32), np.zeros(langid.SIZES))
    langs.predict(data[: offsets[1]], offsets[:2])  # the tables of letters
    first = lambda: [neardup.signatures(*tv.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 5))[0].sum() for i, j in tv.slices(offsets)]
    for work, most in ((lambda: model.scores(data, offsets), 60), (lambda: langs.predict(data, offsets), 60), (first, 40)):
        assert peak_mb(work)[0] < most


def test_a_shard_holds_8_bytes_a_slot(batch):
    n = 400
    rows = list(range(n, 0, -1))
    shard = pa.table({"doc_id": rows, "y": [r % 2 for r in rows], "text": batch[:n]})
    plain = quality.sparse_rows(*tv.raw_bytes(batch[:n]))
    slots = sum(len(s) for s, _ in plain)
    _, kept, samples = peak_mb(lambda: quality.samples_of(shard))
    assert kept < (8 * slots + 600 * n) / 2**20 * 1.1
    # Ascending doc_ids, and the model of the same rows in whole precision of the slots.
    assert [y for _, _, y in samples] == [r % 2 for r in sorted(rows)]
    before = quality.ftrl([(s, v.astype(np.float32).astype(float), r % 2) for r, (s, v) in sorted(zip(rows, plain), key=lambda x: x[0])], epochs=1)
    after = quality.ftrl(samples, epochs=1)
    assert np.array_equal(before.weights, after.weights) and before.bias == after.bias
