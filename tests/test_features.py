"""Features of whole batches equal the row-by-row functions, and a word is hashed once in a worker."""

import re

import pytest
from pyspark.sql import functions as F

from kinfold.functions import features as E
from kinfold.functions import hashing as H
from kinfold.functions import text as T

TEXTS = ["<p>Hello\u00a0 WORLD!</p>\tÉÀb 3/4 <= 50% \u200bx", "a\x1cb \x85 c\u2003d\u2028e\u00b2 <i\nx>y\u00adz", "R&amp;D &lt;b&gt; a\ufeffb", "a\u0301 \u1680 \u3000x", "", "the of", "é 7 x planet the planet 12 o", "bb aa ccc bb dddd", " ".join(f"w{i}" for i in range(700)), "ÿ ÿ 漢字 漢字 = => 5% a", None]


@pytest.mark.parametrize("kept", [1 << 17, 8])
def test_features_equal_the_functions(spark, monkeypatch, kept):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "n long, x string")
    tokens = T.tokens(T.normalize("x"))
    wanted = df.select("n", T.plain("x").alias("plain"), T.normalize("x").alias("normalized"), F.array_distinct(tokens).alias("tokens"), T.keywords(tokens).alias("keywords"), H.minhash(tokens).alias("minhash"))
    monkeypatch.setattr(E, "KEPT", kept)
    hashes, kinds = E.Hashes(), tuple(E.KINDS)
    for r in wanted.where("tokens IS NOT NULL").collect():
        text = TEXTS[r.n % len(TEXTS)].encode()
        easy = not re.search("[^\x00-\u024f\u2000-\u206f]|&", text.decode())
        arrays = E._step([text if easy else None], [None if easy else r.normalized.encode()], [None if easy else r.plain.encode()], kinds, hashes)
        assert [a.to_pylist()[0] for a in arrays] == [r[k] for k in kinds]
        assert len(hashes) <= kept
    got = df.select("n", E.features("x", *kinds).alias("f")).select("n", "f.*")
    assert sorted(got.where("tokens IS NOT NULL").collect()) == sorted(wanted.where("tokens IS NOT NULL").collect())
    assert got.where("tokens IS NULL AND minhash IS NULL AND keywords IS NULL AND plain IS NULL").count() == 3


def test_a_recurring_word_is_hashed_once(monkeypatch):
    made = []
    monkeypatch.setattr(E, "sha256", lambda b, f=E.sha256: made.append(b) or f(b))
    hashes = E.Hashes()
    E._step([b"red green blue", b"red blue green red", b"green"] * 50, [None] * 150, [None] * 150, ("minhash",), hashes)
    assert len(made) == 3 * 12


def test_queries_hash_outside_of_the_row_by_row_functions(spark, tmp_path):
    from kinfold.plans import queries as Q

    spark.createDataFrame([(1, "a b c", "en", "web", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("q_minhash", "q_bands", "q_keywords", "q_buckets"):
        plan = Q.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString()
        assert "ArrowEvalPython" in plan and "array_min" not in plan
