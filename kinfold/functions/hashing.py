"""Content hashes, MinHash signatures and bucket keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.text import _col, let
from kinfold.plans import config as C


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def answer_part(fraction: Column, text: Column) -> Column:
    return F.format_string("%.7f:%s", fraction, text)


def source_hash(qtype: Column, name: Column, text: Column, feedback: Column, parts: Column) -> Column:
    """Over the raw fields and the sorted answer parts (joined by |), one to a line; null counts as empty."""
    fields = [F.coalesce(x, F.lit("")) for x in (qtype, name, text, feedback)]
    return sha(F.concat_ws("\n", *fields, F.array_join(F.array_sort(parts), "|")))


def answer_hash(correct: Column) -> Column:
    """Over the distinct sorted correct answers; null if there is none."""
    return F.when(F.size(correct) > 0, sha(F.array_join(F.array_sort(F.array_distinct(correct)), "|")))


def minhash(words: Column | str) -> Column:
    """For each seed the least of the first 32 bits of sha256('seed:token') over the tokens; empty without tokens."""

    def least(distinct: Column) -> Column:
        hexes = F.transform(F.sequence(F.lit(0), F.lit(C.SIGNATURES - 1)), lambda s: F.array_min(F.transform(distinct, lambda t: F.substring(sha(F.concat(s.cast("string"), F.lit(":"), t)), 1, 8))))
        return F.when(F.size(distinct) > 0, F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))

    return let(F.array_distinct(_col(words)), least)


def bands(signature: Column | str) -> Column:

    def keys(sig: Column) -> Column:
        band = lambda b: F.array_join(F.transform(F.slice(sig, b * C.BAND_ROWS + 1, C.BAND_ROWS), lambda x: x.cast("string")), ":")
        made = F.transform(F.sequence(F.lit(0), F.lit(C.SIGNATURES // C.BAND_ROWS - 1)), lambda b: F.concat(F.lit(C.BAND_PREFIX), b.cast("string"), F.lit(":"), F.substring(sha(band(b)), 1, 32)))
        return F.when(F.size(sig) == C.SIGNATURES, made).otherwise(F.array().cast("array<string>"))

    return let(_col(signature), keys)


def bucket_keys(normalized: Column, text_hash: Column, qtype: Column, ans_hash: Column, kw: Column, signature: Column) -> Column:
    none = F.array().cast("array<string>")
    whole = F.when(normalized != "", F.array(F.concat(F.lit(C.WHOLE_TEXT_PREFIX), F.substring(text_hash, 1, 40)))).otherwise(none)
    answer = F.when(ans_hash.isNotNull(), F.array(F.concat(F.lit(C.ANSWER_PREFIX), F.substring(sha(F.concat(F.coalesce(qtype, F.lit("")), F.lit(":"), ans_hash)), 1, 40)))).otherwise(none)
    words = F.transform(F.slice(kw, 1, C.BUCKETED_KEYWORDS), lambda k: F.concat(F.lit(C.KEYWORD_PREFIX), F.substring(sha(k), 1, 40)))
    return F.array_distinct(F.concat(whole, answer, words, bands(signature)))
