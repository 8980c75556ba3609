"""Repeated rows, and several vectors of one id, in the cross-polytope search."""

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import crosspolytope


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=16)
    far = [(100 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 16)))]
    near = [(1, v.tolist())] * 6 + [(i, v.tolist()) for i in (2, 3, 4, 5)]
    # One id with many vectors close to the query's.
    many = [(6, (v + 1e-3 * rng.normal(size=16)).tolist()) for _ in range(8)]
    df = spark.createDataFrame([*near, *many, *far, *far, *far, (7, v.tolist())], "vec_id long, embedding array<double>")
    got = {r["rank"]: r.vec_id for r in crosspolytope.search(df, F.col("vec_id") == 7).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    got = {r["rank"]: r.vec_id for r in crosspolytope.search(df.where("vec_id > 3"), F.col("vec_id") == 7).collect()}
    assert [got[k] for k in (1, 2, 3)] == [4, 5, 6] and len(set(got.values())) == 5


def brute(rows, k=5):
    """The k nearest ids of each id divisible by 50, each id by its nearest vector."""
    want = {}
    for q, x in rows:
        if q % 50 == 0:
            best = want.setdefault(q, {})
            for i, y in rows:
                if i != q:
                    c = float(crosspolytope.cosines(np.array([x]), np.array([y]))[0])
                    best[i] = max(best.get(i, -2), c)
    return {q: sorted(((-c, i) for i, c in b.items()))[:k] for q, b in want.items()}


def test_tables_with_repeats_and_ties_against_brute_force(spark):
    """200 vectors with copies under other ids, repeated rows and ids of several vectors; none is met by brute force."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + 0.3 * (i >= 40) * rng.normal(size=16)).tolist()) for i in range(200)]
    rows += [(500 + i, rows[100][1]) for i in range(9)] + [(550 + i, rows[100][1]) for i in range(3)] + [(7, rows[100][1]), (50, rows[3][1])]
    df = spark.createDataFrame([*rows, *rows[90:120], *rows[90:95]], "vec_id long, embedding array<double>")
    got = {}
    for r in crosspolytope.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id, r["rank"]))
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        found = sorted(got[q])
        assert [r for *_, r in found] == [1, 2, 3, 4, 5] and len({i for _, i, _ in found}) == 5 and q not in {i for _, i, _ in found}
        hits += len({i for _, i, _ in found} & {i for _, i in best})
    assert [i for _, i, _ in sorted(got[100])] == [7, 500, 501, 502, 503]
    assert [i for _, i, _ in sorted(got[550])] == [7, 100, 500, 501, 502]
    assert hits >= 0.9 * 5 * len(want)


def test_split_keys_and_cells_lose_nothing(spark, monkeypatch):
    """One hot key over many cells: with all axes probed the search is exact."""
    monkeypatch.setattr(crosspolytope, "PART_ROWS", 16)
    monkeypatch.setattr(crosspolytope, "CELL_ROWS", 40)
    rng = np.random.default_rng(2)
    center = rng.normal(size=12)
    rows = [(i, (center + 0.05 * rng.normal(size=12)).tolist()) for i in range(150)] + [(i, rng.normal(size=12).tolist()) for i in range(150, 220)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("keys", "cell", "asks", "query_id")})
    widest = next(crosspolytope.joins(12, len(rows)))
    monkeypatch.setattr(crosspolytope, "fit", lambda *_: (widest, crosspolytope.keys_of(widest)))
    got = {}
    for r in crosspolytope.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: [i for _, i in sorted(f)] for q, f in got.items()} == {q: [i for _, i in b] for q, b in brute(rows).items()}


def test_the_visited_share_falls_with_the_table(spark):
    rng = np.random.default_rng(4)
    shares = []
    for n in (1000, 16000):
        df = spark.createDataFrame(list(enumerate(rng.normal(size=(n, 32)).tolist())), "vec_id long, embedding array<double>").repartition(4)
        axes, count = crosspolytope.fit(df, df.where("vec_id % 50 = 0"), n, 32, 5)
        shares.append(count / crosspolytope.keys_of(axes))
    assert shares[1] < 0.6 * shares[0]
