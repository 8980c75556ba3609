"""Searches, tokens, packing, pages, languages, licences and quality against brute force, round trips and held-out rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import bpe, crosspolytope, html, langid, licences, maxscore, packing, quality, textvec

VEC = "vec_id long, embedding array<double>, query_id string, label string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], "x", None) for i, v in rows], VEC)


EDGE = [(None, [1, 1]), (7001, None), (7002, []), (7003, [None, 1]), (7004, [float("nan"), 1]), (7005, [float("inf"), 1])]


def test_maxscore_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 9)) * rng.choice([0.01, 1, 3], 9)
    x[300:] = x[200:300]  # ties
    rows = [(i, list(v)) for i, v in enumerate(x)]
    df = vectors(spark, [*rows, rows[5], (900, [0] * 9), (901, [0.5]), *EDGE])
    got = {}
    for r in maxscore.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    full = {i: np.floor(256 * np.array(v)) for i, v in [*rows, (900, [0] * 9), (901, [0.5] + [0] * 8)]}
    assert set(got) == {i for i in full if i % 50 == 0}
    for q, found in got.items():
        best = sorted((-int(full[q] @ v), i) for i, v in full.items() if i != q)[:5]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_maxscore_beyond_doubles_and_few_candidates(spark):
    big = 1.1e7
    df = vectors(spark, [(0, [big, 1]), (1, [big, 1 / 256]), (2, [big, 2 / 256])])
    got = sorted((r["rank"], r.vec_id, r.score) for r in maxscore.search(df, F.col("vec_id") == 0).collect())
    a = int(math.floor(256 * big)) ** 2
    assert got == [(1, 2, a + 512), (2, 1, a + 256)]
    assert maxscore.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_cross_polytope_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    x[1000:] = x[rng.integers(0, 50, 500)] + 0.1 * rng.normal(size=(500, 24))
    x[700:720] = x[700]
    df = vectors(spark, [*enumerate(x.tolist()), (2000, [0.0] * 24), *EDGE])
    got = {}
    for r in crosspolytope.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 1500, 50):
        cos = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        best = sorted((-c, i) for i, c in enumerate(cos) if i != q)[:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - cos[i]) < 1e-12 for _, i, s in found)
        hit += len({i for _, i in best} & {i for _, i, _ in found})
        total += 5
    assert hit >= 0.9 * total
    assert [i for _, i, _ in sorted(got[700])] == [701, 702, 703, 704, 705]


def test_cross_polytope_small_tables_are_exact(spark):
    df = vectors(spark, [(0, [1, 0]), (50, [0, -1]), (3, [-1, 0]), *EDGE])
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in crosspolytope.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 50, 0.0), (0, 2, 3, -1.0), (50, 1, 0, 0.0), (50, 2, 3, 0.0)]
    assert crosspolytope.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_optimal_boundaries_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 9)
        lengths = np.array(sorted(rng.sample(range(40), n)))
        counts = np.array([rng.randint(1, 5) for _ in range(n)])
        k = rng.randint(1, 5)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))

        best = min(padding([*c, lengths[-1]]) for m in range(min(k, n)) for c in itertools.combinations(lengths[:-1], m))
        got = packing.optimal_boundaries(lengths, counts, k)
        assert len(got) <= k and got == sorted(set(got)) and padding(got) == best


def test_packing_keeps_all_rows_within_the_budget(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([0, 1, 5, 9, 30, 31, 500]), "n") for i in range(400)] + [(None, None, "n"), (5, "x", "n"), (5, "x", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    out = packing.pack(df, token_budget=100, buckets=3).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in out) == sorted((i is None, i, len(t or "")) for i, t, _ in rows)
    batches = {}
    for r in out:
        assert r.n_tokens + r.padding == r.bucket_len and r.padding >= 0
        batches.setdefault((r.bucket, r.batch_id), []).append(r)
    by_bucket = {}
    for (b, _), rs in batches.items():
        assert len(rs) == 1 or len(rs) * rs[0].bucket_len <= 100
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        by_bucket.setdefault(b, []).append(len(rs))
    for sizes in by_bucket.values():  # only one batch of a bucket is short
        assert sum(s < max(sizes) for s in sizes) <= 1
    assert packing.pack(df.limit(0)).count() == 0


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    codec = bpe.Codec(bpe.codec(path, pattern).ranks, pattern)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", " ", "hello  world\n\n", "it's 12,345 — ¡ñandú! 漢字 😀", "a" * 3000, "<|endoftext|>", "=" * 777 + " x"]
    texts += ["".join(rng.choice("abc  é1\n'漢") for _ in range(rng.randint(1, 200))) for _ in range(50)]
    for t in texts:
        assert codec.encode(t) == known.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate([*texts, None, texts[3]])], "doc_id long, text string, ids long")
    for r in bpe.round_trips(df).collect():
        ids = known.encode_ordinary([*texts, "", texts[3]][r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256([*texts, "", texts[3]][r.doc_id].encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in back} == dict(enumerate([*texts, "", texts[3]]))
    assert bpe.round_trips(df.limit(0)).count() == 0


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy {k}</div><article><h1>Title&nbsp;{k} &amp; &copy;</h1><p>One <b>bold</b>\n  text {k}<br><p>two &amp x</p><div class="tip">Follow us</div><script>if (1<2) "</p>"</script><div id="comments"><p>nice {k}</p></div></article><aside>side</aside><form>Name</form><footer>foot {k}</footer></body></html>'


def test_site_style_tree(spark):
    pages = [(i, "http://a.example/x", PAGE.replace("{k}", str(i)), "c") for i in range(20)]
    pages += [(50, None, None, "c"), (51, "http://b.example", "", "c"), (52, "http://b.example", "plain <", "c"), (53, "http://b.example", "<p>a<p>b<ul><li>c<li>d</ul><!-- x", "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    for i in range(20):  # "Follow us" is the same on every page: its branch goes
        assert got[i].text == f"Title {i} & ©\nOne bold text {i}\ntwo & x" and got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (50, 51, 52, 53)] == ["", "", "plain <", "a\nb\nc\nd"]
    assert html.extract(df.limit(0)).count() == 0
    assert "Follow us" in html.main_text(html.Page(PAGE))


LANGS = {"aa": "lorem ipsum dolor sit amet", "bb": "über straße schön groß", "cc": "que los niños año mañana"}


def test_language_profiles(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(LANGS))
        rows.append((i, " ".join(rng.choices(LANGS[lang].split(), k=30)).capitalize() + ".", lang, "z"))
    rows += [(400, None, "aa", "z"), (401, "", None, "z"), (402, "123 !? \n", "bb", "z"), (None, "lorem ipsum dolor", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.language_ids(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == lang for i, _, lang, _ in rows[:300])
    assert [by[i].lang_pred for i in (400, 401, 402, None)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert langid.language_ids(df.limit(0)).count() == 0
    nothing = langid.language_ids(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]


def test_encoding_does_not_depend_on_the_batch():
    texts = ["Hello, wörld", "", "a", "漢字 kana", "  x y  "]
    import pyarrow as pa

    whole, has, _ = langid.encode(*textvec.raw_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        alone, *_ = langid.encode(*textvec.raw_bytes(pa.array([t])))
        assert np.allclose(alone[0], whole[k], atol=1e-6)
    assert has.tolist() == [True, False, True, True, True]


def test_licences(spark):
    lines = {
        0: "Licensed under the Apache License, Version 2.0.", 1: "Released under the MIT License.", 2: "All rights reserved.",
        3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.",
        5: "This software is licensed, not sold, under the terms of the enclosed agreement.", 6: "Cats and dogs slept in the garden all day.",
    }
    rows = [(i, f"Some words first.\n{t}\nMore of them follow here.", "c") for i, t in lines.items()] + [(7, None, "c"), (8, "", "c"), (9, "\n\n", "c"), (1, f"Some words first.\n{lines[1]}\n", "c")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, family string"))
    plan = got._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    found = sorted((r.doc_id, r.paragraph, r.family) for r in got.collect())
    assert found == [(0, 1, "apache-2.0"), (1, 1, "mit"), (1, 1, "mit"), (2, 1, "all-rights-reserved"), (3, 1, "gpl-3.0"), (4, 1, "cc-by-nc-4.0"), (5, 1, "unknown")]


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(vocabulary, k=40)
        y = i % 3 > 0
        rows.append((i, " ".join(w) + "." if y else " ".join(x.upper() + "!!" for x in w), "s"))
        if i % 2:
            labels.append((i, int(y), 0))
    rows += [(500, None, "s"), (501, "", "s"), (None, "x", "s"), (3, rows[3][1], "s")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame([*labels, (None, 1, 0), (600, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(documents, table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 3 > 0)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert {r.score for r in quality.quality_scores(documents, table.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(documents.limit(0), table).count() == 0
