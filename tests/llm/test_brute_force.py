"""Languages, quality, licences, packing and the pipeline's stages against plain versions of them, with hard rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from kinfold.llm import langid, licences, packing, quality, suffixdedup
from kinfold.llm.common import hash_sample

WORDS = {"aa": "lorem ipsum dolor sit amet elit", "bb": "über straße schön groß grün", "cc": "que los niños año mañana vez"}


def test_language_vectors_equal_a_plain_version():
    """Every trigram by itself: bind, bundle, compare."""
    symbol, vectors = langid.letters()
    texts = ["Hello, wörld", "", "a", "漢字 kana 12", "  x y  ", "....", "x" * 300_000, None]

    def plain(text):
        codes = []
        for ch in text or "":
            c = int(symbol[ord(ch)])
            if c or not codes or codes[-1]:
                codes.append(c)
        codes = [0, *codes, 0]
        total, n = np.zeros(langid.DIMENSIONS), 0
        for x, y, z in zip(codes, codes[1:], codes[2:]):
            if y:
                total += vectors[x].astype(int) * np.roll(vectors[y].astype(int), 1) * np.roll(vectors[z].astype(int), 2)
                n += 1
        norm = math.sqrt((total**2).sum())
        return total / norm if norm else total, n

    import pyarrow as pa

    from kinfold.llm import textvec as tv

    got, has, n = langid.encode(*tv.raw_bytes(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        want, count = plain(t)
        assert np.abs(got[k] - want).max() < 1e-4 and n[k] == count and has[k] == (count > 0)


def language_rows(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(3, 60))), lang, "z"))
    return rows


def test_every_language_is_learned_and_strange_texts_are_refused(spark):
    rng = random.Random(5)
    rows = language_rows(rng, 600)
    rows += [(1000 + i, f"{a}{b} " * 9, f"l{i:03d}", "z") for i, (a, b) in enumerate([(a, b) for a in "dfghjklmnprstvwz" for b in ("aba", "ebo", "iku", "oru", "uti", "axe", "ezi", "opu", "ydy", "ulo", "amo", "esi", "ira", "oja", "ubu", "eke", "imi", "oto")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(df, per_lang=200, floors=True)
    assert len(model.names) == 3 + 288
    model = langid.train(df.where("doc_id < 1000"), floors=True)
    letters = "abcdefghijklmnopqrstuvwxyz"
    polish = "wszystkie dzieci poszły jutro szybko przez zielony most nad rzeką gdzie często łowią ryby".split()
    strange = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(100)) for _ in range(40)]
    strange += ["".join(rng.choices(letters + letters.upper() + "0123456789+/", k=700)) for _ in range(20)]
    strange += [" ".join(rng.choices(polish, k=100)) for _ in range(20)] + ["".join(rng.choices("的一是不了人我在有他这为之大来以个中上们", k=300)) for _ in range(20)]
    fine = [r for r in language_rows(rng, 300)]
    test = spark.createDataFrame([(5000 + i, t, None, "z") for i, t in enumerate(strange)] + [(i, t, None, s) for i, t, _, s in fine] + [(9000, None, None, "z"), (9001, "", None, "z"), (9002, "12 34", None, "z"), (None, fine[0][1], None, "z"), (0, fine[0][1], None, "q")], df.schema)
    kept = collections.Counter((r.doc_id, r.score) for r in langid.accept(test, model).collect())
    assert sum(n for (i, _), n in kept.items() if i is not None and i >= 5000) <= 0.05 * len(strange)
    assert sum(n for (i, s), n in kept.items() if i is not None and i < 5000 and s == "z") >= 0.99 * len(fine) and kept[None, "z"] == 1 and kept[0, "q"] == 1
    assert langid.accept(test.limit(0), model).count() == 0


def test_predictions_equal_plain_cosines(spark):
    rows = language_rows(random.Random(6), 200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    unit = lambda t: langid.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0][0].astype(float)
    profile = {k: sum(unit(t) for _, t, lang, _ in learned if lang == k) for k in WORDS}
    profile = {k: v / np.linalg.norm(v) for k, v in profile.items()}
    for r in langid.language_ids(df).collect():
        cos = {k: float(unit(rows[r.doc_id][1]) @ v) for k, v in profile.items()}
        assert r.lang_pred == max(cos, key=cos.get) and abs(r.score - max(cos.values())) < 1e-4


def test_samples_are_bounded_and_whole_when_small(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    n = hash_sample(df, 20000, 1000, "doc_id").count()
    assert 1000 <= n <= 2000 and hash_sample(df, 20000, 15000, "doc_id") is df
    rows = spark.createDataFrame([(7, f"word{i} and more", "aa", "z") for i in range(3000)] + [(None, "x y z", "bb", "z")] * 50, "doc_id long, text string, lang string, score string")
    got = collections.Counter(r.lang for r in langid.training_sample(rows, per_lang=100).collect())
    assert got == {"aa": 100, "bb": 50}


def test_quality_scores_equal_a_plain_model(spark):
    """n-grams counted one by one, and follow-the-regularised-leader over dictionaries."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(60):
        w = ["".join(rng.choices("abcdef", k=3)) for _ in range(12)]
        rows.append((i, " ".join(w) + "." if i % 2 else " ".join(x.upper() for x in w) + "!!", "s"))
        labels.append((i, i % 2, 0))
    rows += [(100, None, "s"), (101, "", "s"), (102, "?! ..", "s"), (3, "another text of three", "s"), (103, "long words " * 30_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(df, table)
    import pyarrow as pa

    from kinfold.llm import textvec as tv

    sparse = lambda t: dict(zip(*(x.tolist() for x in quality.sparse_rows(*tv.raw_bytes(pa.array([t], pa.string())))[0])))
    best = {}
    for i, t, _ in rows:  # one text a doc_id, as the training takes it
        best.setdefault(i, []).append(t)
    chosen = {r.doc_id: r.text for r in df.where("doc_id < 60").orderBy("doc_id", quality.F.xxhash64("text")).dropDuplicates(["doc_id"]).collect()}
    chosen[3] = min(best[3], key=lambda t: spark.createDataFrame([(t,)], "t string").select(quality.F.xxhash64("t")).first()[0])
    samples = [(sparse(chosen[i]), y) for i, y, _ in labels]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.2
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(4):
        for k in order.permutation(len(samples)):
            x, y = samples[k]
            w = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[j] * np.float32(v) for j, v in x.items())))))
            for j, v in x.items():
                g = (p - y) * np.float32(v)
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * w[j]
                n[j] += g * g
    for i, s in [(r.doc_id, r.score) for r in quality.score(df, model).collect()]:
        if i != 3:
            t = next(t for k, t, _ in rows if k == i)
            want = 1 / (1 + math.exp(-max(-35, min(35, sum(weight(j) * v for j, v in sparse(t).items())))))
            assert abs(s - want) < 1e-3, i


def test_quality_sample_takes_one_text_of_a_repeated_doc_id(spark):
    df = spark.createDataFrame([(1, f"text {i}", "s") for i in range(50)] + [(2, "GOOD!!", "s"), (2, "GOOD!!", "s")], "doc_id long, text string, y string")
    table = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.accept(df, quality.train(df, table)).columns == df.columns


def test_licence_scores_equal_a_plain_model(spark):
    """The probabilities of the trained model, recomputed from its coefficients, and overlaps from sets of words."""
    lines = ["Released under the MIT License.", "Licensed under CC BY-SA 4.0.", "All rights reserved.", "The sea was calm.", "x" * 50_000, "", "Licensed under the Apache License, Version 2.0."]
    rows = [(i, f"Some prose is here.\n{t}\nAnd here.", "c", "d") for i, t in enumerate(lines)] + [(50, None, "c", "d"), (None, "All rights reserved.", "c", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string, row string")
    scanner = licences.train(df)
    split = lambda t: [w for w in re.split(r"[^\w.-]+", t.lower().replace("_", " ")) if w]
    hashed = spark.createDataFrame([(t, split(t)) for t in lines if t], "t string, w array<string>")
    got = {r.t: list(r.p) for r in scanner.probabilities(hashed).select("t", "p").collect()}
    coefficients, intercept = scanner.model.coefficientMatrix.toArray(), scanner.model.interceptVector.toArray()
    for t, p in got.items():
        w = split(t)
        grams = set(w) | {f"{a} {b}" for a, b in zip(w, [*w[1:], "$"])}
        slots = {scanner.hashing.indexOf(g) for g in grams}
        margin = coefficients[:, sorted(slots)].sum(1) + intercept
        want = np.exp(margin - margin.max())
        assert np.allclose(p, want / want.sum(), atol=1e-9)
    found = {(r.doc_id, r.paragraph): (r.family, r.overlap) for r in licences.scan(df, scanner).collect()}
    families = {0: "mit", 1: "cc-by-sa-4.0", 2: "all-rights-reserved", 6: "apache-2.0"}
    assert {k: f for k, (f, _) in found.items()} == {**{(i, 1): f for i, f in families.items()}, (None, 0): "all-rights-reserved"}
    for (i, _), (family, overlap) in found.items():
        own = set(split(lines[i] if i is not None else "All rights reserved."))
        assert overlap == round(max(len(own & set(split(t))) / len(set(split(t))) for t in licences.TEMPLATES[family]), 4)
    assert licences.scan(df.limit(0), scanner).count() == 0


def test_packing_equals_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, i]), "x" * rng.choice([0, 1, 5, 9, 30, 31, 500]), "n") for i in range(300)] + [(1, None, "n"), (2, "y" * 200_000, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    out = packing.pack(df, token_budget=100, buckets=3).collect()
    sizes = [len(t or "") for _, t, _ in rows]
    values = sorted(set(sizes))
    import itertools

    cost = lambda bounds: sum(min(b for b in bounds if b >= s) - s for s in sizes)
    best = min(cost([*c, values[-1]]) for m in range(3) for c in itertools.combinations(values[:-1], m))
    assert sum(r.padding for r in out) == best
    bounds = sorted({r.bucket_len for r in out})
    assert collections.Counter((r.doc_id, r.n_tokens, r.bucket_len) for r in out) == collections.Counter((i, len(t or ""), min(b for b in bounds if b >= len(t or ""))) for i, t, _ in rows)
    batches = collections.Counter(r.batch_id for r in out)
    for b in bounds:
        own = sorted((n for k, n in batches.items() if k in {r.batch_id for r in out if r.bucket_len == b}), reverse=True)
        capacity, total = max(1, 100 // max(1, b)), sum(r.bucket_len == b for r in out)
        assert own == [capacity] * (total // capacity) + [total % capacity] * (total % capacity > 0)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, th string, spans string, bands string, s1 string, label string, keys string, size string, y string, score string, bucket string, part string, _n string"


def test_repeated_strings_with_clashing_columns(spark):
    a = "".join(random.Random(1).choices("abcdef", k=300))
    rest = ["q"] * 11
    rows = [(1, a, "en", "s", 1, 9, *rest), (2, a + "tail", "en", "s", 1, 8, *rest), (None, None, None, None, None, None, *rest), (3, "", "en", "s", 0, 7, *rest)]
    df = spark.createDataFrame([(*r, "z")[: len(CLASH.split(", "))] for r in rows], CLASH)
    assert sorted((r.n_bytes, r.n_removed) for r in suffixdedup.digests(df).collect()) == [(0, 0), (0, 0), (300, 300), (304, 300)]
    assert sorted((r.doc_id or 0, r.text, r.id) for r in suffixdedup.without_repeats(df).collect()) == [(0, None, None), (2, "tail", 8), (3, "", 7)]


def test_pipeline_stages_with_hard_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, no labels, and an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    width = len(CLASH.split(", "))
    row = lambda i, t, lang="en": (*(i, t, lang, "s", len(t) if t else 0, 1, *["q"] * width),)[:width]
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(80)]
    rows = [row(i, t) for i, t in enumerate(texts)]
    rows += [row(5, texts[6]), row(5, " ".join(rng.choices(words, k=40))), row(7, texts[7]), row(None, " ".join(rng.choices(words, k=30))), row(None, texts[9]), row(200, " ".join(rng.choices(words, k=30_000))), row(201, "aaaa"), row(201, "aaaa")]
    hard = [row(300, None), row(301, ""), row(302, "12 34"), (*[None] * width,)]
    docs = spark.createDataFrame(rows + hard, CLASH)
    spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = collections.Counter
    texts_of = lambda df: kept((r.doc_id, r.text) for r in df.collect())
    every = kept((r[0], r[1]) for r in rows + hard)
    steps = dict(pipeline.STAGES)
    first = steps["quality"](spark, docs, str(tmp_path))
    assert texts_of(first) == every and first.columns == docs.columns  # only good labels: nothing is rejected
    second = steps["language"](spark, docs, str(tmp_path))
    assert texts_of(second) == kept((r[0], r[1]) for r in rows) and second.columns == docs.columns
    third = steps["near_duplicates"](spark, docs, str(tmp_path))
    want = kept((r[0], r[1]) for r in rows[:80]) + kept([(5, rows[81][1]), (None, rows[83][1]), (200, rows[85][1]), (201, "aaaa")]) + kept((r[0], r[1]) for r in hard)
    want -= kept([(6, texts[6])])
    want += kept([(5, texts[6])])
    assert texts_of(third) == want and third.columns == docs.columns
    fourth = steps["repeated_passages"](spark, docs, str(tmp_path))
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.where("text IS NULL").collect()} == {300, None}
    last = steps["packing"](spark, docs, str(tmp_path)).collect()
    assert kept((r.doc_id, r.n_tokens) for r in last) == kept((r[0], len(r[1] or "")) for r in rows + hard)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
