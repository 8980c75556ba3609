"""Near duplicates, repeated strings and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from kinfold.llm import components, neardup, suffixdedup

DOC = "doc_id long, text string, kept string, node string"


def table(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts, first)], DOC)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


def corpus(rng, n):
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.55:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(1, 120))))
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = random.Random(size)
    texts = corpus(rng, 220) + ["", None, " \t\n", "one", "ONE", "one two", "two one", "é É", "x" * 5000, "x" * 5000]
    base = ["w%d" % i for i in range(100)]  # a hot group of near copies
    texts += [" ".join(base[:k] + ["q%d" % k] + base[k + 1 :]) for k in range(0, 100, 2)]
    sets, want = brute_components(texts, size, 80)
    got = {r.doc_id: r for r in neardup.near_duplicates(table(spark, texts), shingle=size).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i), texts[i]


def test_rest_stage_alone_finds_all(spark, monkeypatch):
    """Without the star rounds, the blocks do the whole job."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    none = neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, nodes, percent: none(pairs, nodes, percent).limit(0))
    texts = corpus(random.Random(12), 80)
    _, want = brute_components(texts, 2, 80)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, texts), shingle=2).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_empty_table_and_repeated_rows(spark):
    assert neardup.near_duplicates(table(spark, []).limit(0)).count() == 0
    twice = table(spark, ["a b c d e f"] * 2).unionByName(table(spark, ["a b c d e f"]))
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(twice).collect()) == [(0, 0, True), (0, 0, True), (1, 0, False)]


def test_doc_ids_of_several_texts_and_null_ids_keep_their_links(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    a, b = rng.choices(words, k=80), rng.choices(words, k=80)
    text = lambda w, extra="": " ".join([*w, extra]).strip()
    df = spark.createDataFrame([(1, text(a), "x", None), (1, text(b), "x", None), (2, text(a, "zz"), "x", None), (3, text(b, "zz"), "x", None)], DOC)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert sorted((r.doc_id, r.text) for r in neardup.representatives(df).collect()) == sorted([(1, text(a)), (1, text(b))])
    rows = [(None, text(a), "x", None), (None, text(a, "zz"), "x", None), (7, text(b), "x", None), (None, text(b, "yy"), "x", None), (None, None, "x", None), (None, "", "y", None), (7, text(b), "w", None)]
    df = spark.createDataFrame(rows, DOC)
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()]
    assert collections.Counter(got) == {(None, None, False): 4, (None, 7, False): 1, (7, 7, True): 2}
    kept = [tuple(r) for r in neardup.representatives(df).collect()]
    assert collections.Counter(kept) == collections.Counter([next(r for r in sorted(kept, key=str) if r[1] in (text(a), text(a, "zz"))), (7, text(b), "w", None), (None, None, "x", None), (None, "", "y", None)])
    assert neardup.representatives(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, **{k: 200 for k in (200, 201, 202)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dc3_sorts_suffixes():
    rng = random.Random(9)
    for n in (3, 50, 700):
        for letters in (1, 2, 200):
            s = np.array([rng.randint(1, letters) for _ in range(n)] + [0] * (6 - n % 3), np.int64)
            s = np.append(s, np.zeros(-len(s) % 3, np.int64))
            order = suffixdedup.dc3(s, 1, 10**9)
            full = [s[i:].tolist() for i in order if i < n]
            assert sorted(order.tolist()) == list(range(len(s))) and full == sorted(full)


def brute_spans(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def passages(rng):
    letters = "abcdefghijklmnop éß"
    make = lambda n: "".join(rng.choices(letters, k=n))
    shared = [make(150), make(260), make(90)]
    texts = [make(rng.randint(0, 300)) + rng.choice(shared) + make(rng.randint(0, 200)) for _ in range(60)]
    texts += [shared[1], shared[1], texts[0], "z" * 500, "ab" * 200, make(99), make(100), "", None]
    texts += [shared[0] + shared[0], make(50) + "y" * 260 + make(50)]
    return texts


@pytest.mark.parametrize("hot", [10**6, 3])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, hot):
    """Also with a limit so low that most anchor keys take the way of hot ones."""
    monkeypatch.setattr(suffixdedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffixdedup, "PIECE", 4096)
    texts = passages(random.Random(7))
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.digests(table(spark, texts), length=100).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, 100)


def test_repeated_strings_with_null_and_repeated_ids(spark):
    a, b = "".join(random.Random(1).choices("abcdef", k=300)), "".join(random.Random(2).choices("abcdef", k=300))
    rows = [(None, a, "x", None), (None, a, "x", None), (1, b, "x", None), (1, "short", "x", None)]
    got = sorted((r.n_bytes, r.n_removed) for r in suffixdedup.digests(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(5, 0), (300, 0), (300, 300), (300, 300)]
    assert suffixdedup.digests(table(spark, []).limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage's rows equal a plain version of it, from trained models on; the columns stay."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        w = rng.choices(words, k=60)
        good = i % 4 > 0
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "en", "s", 1))
        labels.append((i, int(good), 0))
    passage = "".join(rng.choices("klmnopq ", k=240))
    rows[1] = (1, rows[1][1] + passage, "en", "s", 1)
    rows[2] = (2, passage + rows[2][1], "en", "s", 1)
    rows[5] = (5, rows[3][1] + " more", "en", "s", 1)
    rows[7] = (7, rows[6][1], "en", "s", 1)
    rows.append((300, "12345 67890", "en", "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        ids.append({r.doc_id: r.text for r in docs.collect()})
    good = {i for i in range(240) if i % 4 > 0}
    assert set(ids[0]) - {300} == good and set(ids[1]) == good
    texts = [ids[1].get(i, "") for i in range(240)]
    _, want = brute_components(texts, 5, 80)
    assert set(ids[2]) == {i for i in good if want[i] == i} == good - {5, 7}
    assert ids[3][1] == rows[1][1][: -len(passage)] and ids[3][2] == rows[2][1][len(passage) :]
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(t.encode()) for i, t in ids[3].items()}
