"""Comparison inside buckets: exact counts, bounds that lose no pair, and sets that go to buckets and not to pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.operators import candidates as cand
from kinfold.operators import inbuckets, versions
from kinfold.plans.config import Config
from kinfold.sources import tables as src


def sets(rng, n, most):
    return [rng.sample(range(-(2**62), 2**62, 2**52 + 1), k=rng.randint(0, most)) + list(range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("cells", [1 << 20, 50])
def test_counts_and_bounds(monkeypatch, cells):
    monkeypatch.setattr(inbuckets, "CELLS", cells)
    rng = random.Random(3)
    for most in (3, 40, 400):
        made = sets(rng, 9, most)
        true = np.array([[len(set(x) & set(y)) for y in made] for x in made])
        ids, lengths = np.array(sum(made, []), np.int64), np.array([len(x) for x in made])
        bits = np.zeros((9, inbuckets.SKETCH), bool)
        for k, x in enumerate(made):
            bits[k, np.array(x, np.int64) & (inbuckets.SKETCH - 1)] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for at, end in ((0, 9), (2, 5)):
            others = np.arange(at, end)[:, None] != np.arange(9)
            assert (inbuckets.shared_counts(ids, lengths, at, end) == true[at:end])[others].all()
            assert (inbuckets.possible(words, lengths, at, end) >= true[at:end]).all()


def test_buckets_that_span_batches():
    batch = lambda rows: pa.RecordBatch.from_pylist([{"category": c, "bucketkey": k, "entry": e} for c, k, e in rows])
    parts = [batch([("x", "1", 1), ("x", "1", 2)]), batch([("x", "1", 3)]), batch([("x", "2", 4), ("y", "2", 5)]), batch([("y", "2", 6)])]
    got = [b.column("entry").to_pylist()[i:j] for b, i, j in inbuckets._groups(iter(parts))]
    assert got == [[1, 2, 3], [4], [5, 6]]


def snapshots(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(70)]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 2}", len(t)) for i, t in enumerate(texts + texts[:9] + ["the of", "the of", "", ""])]
    return versions.snapshots(src.document_items(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))).localCheckpoint()


def test_pairs_equal_those_scored_one_by_one(spark):
    snaps = snapshots(spark)
    each = {r.entry: r for r in snaps.collect()}
    places = {(r.a, r.b): tuple(r.position) for r in cand.positions(snaps, 40).collect()}

    def score(a, b):
        x, y = each[a], each[b]
        exact, share = x.texthash == y.texthash and x.normalizedtext != "", len(set(x.tokens) & set(y.tokens))
        jaccard = share / len(set(x.tokens) | set(y.tokens)) if x.tokens and y.tokens else 0.0
        return jaccard, 1.0 if exact else min(1.0, 0.80 * jaccard + 0.05 * (x.qtype == y.qtype))

    wanted = {ab: score(*ab) for ab in places}
    assert {(r.a, r.b): (r.jaccard, r.score) for r in cand.measured(snaps, 40).collect()} == wanted
    found = {(r.a, r.b): (tuple(r.position), r.score) for r in cand.candidates(snaps, Config(max_bucket=40)).collect()}
    least = lambda a, b: 0.28 if each[a].qtype == each[b].qtype else 0.38
    assert found == {ab: (places[ab], s) for ab, (_, s) in wanted.items() if s >= least(*ab)} and 0 < len(found) < len(wanted)


def test_sets_go_to_buckets_and_not_to_pairs(spark):
    """Thirty members of one bucket are 435 pairs; before, each pair carried a set through an exchange."""
    rows = [(i, "shared shared shared shared " + " ".join(f"own{i}x{j}" for j in range(20)), "en", "web", 9) for i in range(30)]
    snaps = versions.snapshots(src.document_items(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))).localCheckpoint()
    plan = cand.measured(snaps, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and cand.measured(snaps, 40).count() == 435
    rows = inbuckets.member_rows(cand._members(snaps, 40), snaps, inbuckets.token_ids())
    assert rows.count() == 30 and rows.where(F.size("content") == 21).count() == 30
    assert cand.candidates(snaps, Config()).count() == 0
    assert inbuckets.passable(inbuckets.member_rows(cand._members(snaps, 40), snaps, inbuckets.sketch(inbuckets.token_ids()))).count() == 0
