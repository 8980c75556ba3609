"""The pipeline's models come from all rows that may be learned from."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import langid, quality
from kinfold.llm import textvec as tv


def letters_rows(n):
    rng = random.Random(3)
    return [(i, " ".join("".join(rng.choices("abcdeäö中", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 60))), "aa" if i % 9 else "bb", "z") for i in range(n)]


def test_language_profiles_and_floors_of_all_rows(spark):
    rows = letters_rows(langid.TRAIN_PER_LANG + 400)
    unit = lambda t: langid.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    whole = {i: unit(t.encode())[0][0].astype(float) for i, t, _, _ in rows}
    sums = {k: sum(whole[i] for i, _, lang, _ in rows if lang == k) for k in ("aa", "bb")}
    cos = {}
    for i, t, lang, _ in rows:
        rest = sums[lang] - whole[i]
        for length in (*langid.PIECES, len(t.encode())):
            vector, _, n = unit(t.encode()[:length].decode("utf-8", "ignore").encode())
            cos.setdefault(int(langid.sizes(n)[0]), []).append(float(vector[0] @ rest) / np.linalg.norm(rest))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = langid.train(df, per_lang=None, floors=True)
    assert model.names == ["aa", "bb"]
    for name, prototype in zip(model.names, model.prototypes):
        assert np.abs(prototype - sums[name] / np.linalg.norm(sums[name])).max() < 1e-6
    now = langid.LEAST_FLOOR
    for size, floor in enumerate(model.floors):
        if len(cos.get(size, [])) >= langid.LEAST_ROWS:
            now = max(langid.LEAST_FLOOR, langid.FLOOR_SHARE * np.quantile(cos[size], langid.FLOOR_QUANTILE))
        assert abs(floor - now) < 1e-5, size
    again = langid.train(df.repartition(5), per_lang=None, floors=True)
    assert np.array_equal(model.prototypes, again.prototypes) and np.array_equal(model.floors, again.floors)


def test_the_language_stage_learns_from_every_row(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = letters_rows(60)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    seen = []
    real = langid.accept
    monkeypatch.setattr(langid, "TRAIN_PER_LANG", 5)
    monkeypatch.setattr(langid.training_sample, "__defaults__", (None, 5))
    monkeypatch.setattr(langid.train, "__defaults__", (None, 5, False))
    monkeypatch.setattr(langid, "accept", lambda docs, model: seen.append(model) or real(docs, model))
    pipeline.language_stage(spark, df, "").count()
    want = langid.train(df.where(~pipeline.held_out(5, 0)), per_lang=1000, floors=True)
    assert np.array_equal(seen[0].prototypes, want.prototypes) and np.array_equal(seen[0].floors, want.floors)


def test_vectors_of_many_trigrams_and_rows_equal_single_ones(monkeypatch):
    texts = [t.encode() for _, t, _, _ in letters_rows(40)]
    alone = np.concatenate([langid.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts])
    monkeypatch.setattr(langid, "STEP_ROWS", 7)
    monkeypatch.setattr(langid, "STEP_TRIGRAMS", 10)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    assert np.array_equal(langid.encode(np.frombuffer(b"".join(texts), np.uint8), offsets)[0], alone)


def quality_tables(spark, n):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(50)]
    rows = [(i, (" ".join if i % 2 else "!! ".join)(rng.choices(words, k=rng.randint(1, 12))), "s") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, y string"), spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_quality_model_of_all_rows_is_the_mean_of_its_shards(spark, monkeypatch):
    rows, df, labels = quality_tables(spark, 100)
    whole = quality.train(df, labels)
    plain = quality.ftrl([(s, v.astype(np.float32).astype(float), i % 2) for (i, _, _), (s, v) in zip(rows, quality.sparse_rows(*tv.raw_bytes(pa.array([t for _, t, _ in rows]))))])
    assert np.abs(whole.weights - plain.weights).max() < 1e-6 and abs(whole.bias - plain.bias) < 1e-6
    monkeypatch.setattr(quality, "TRAIN_ROWS", 30)
    got = quality.train(df, labels, train_rows=None)
    shard = {r[0]: r[1] for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'shard'), 4)").collect()}
    parts = []
    for k in range(4):
        own = [r for r in rows if shard[r[0]] == k]
        made = quality.sparse_rows(*tv.raw_bytes(pa.array([t for _, t, _ in own])))
        parts.append((len(own), quality.ftrl([(s, v.astype(np.float32).astype(float), i % 2) for (i, _, _), (s, v) in zip(own, made)])))
    assert np.abs(got.weights - sum(n * m.weights.astype(float) for n, m in parts) / 100).max() < 1e-6
    assert abs(got.bias - sum(n * m.bias for n, m in parts) / 100) < 1e-6


def test_the_quality_stage_learns_from_every_labelled_row(spark, monkeypatch, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, df, labels = quality_tables(spark, 90)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    monkeypatch.setattr(quality, "TRAIN_ROWS", 20)
    monkeypatch.setattr(quality.train, "__defaults__", ("quality", None, 20))
    monkeypatch.setattr(quality, "accept", lambda docs, model, threshold: seen.append(model) or docs)
    pipeline.quality_stage(spark, df, str(tmp_path))
    learned = df.where(~pipeline.held_out(3, 1))
    want = quality.train(learned, labels.where(~pipeline.held_out(3, 1)), train_rows=None)
    sampled = quality.train(learned, labels.where(~pipeline.held_out(3, 1)), train_rows=20)
    assert np.array_equal(seen[0].weights, want.weights) and not np.array_equal(seen[0].weights, sampled.weights)
