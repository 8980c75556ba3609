"""Text normalisation, tokens and keywords as Column functions (JVM side only)."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.plans.config import KEYWORDS

ENTITY = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INVISIBLE = " ​‌‍﻿"
# The stop words (Portuguese, English and Spanish).
STOP_WORDS = (
    "a an and ao aos are as be com como con cual da das de do dos e el em en es for how in is la las los na nas no nos o of on or os para por quais qual que se ser son that the this to um uma un una what which with y"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row: lambdas would compute what they mention at every element."""
    return F.get(F.transform(F.array(value), body), 0)


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "<[^>]*>", " ")


def _reference(body: Column) -> Column:
    """What one character reference (without & and ;) stands for; itself where it names nothing that is allowed."""
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")
    whole = F.concat(F.lit("&"), body, F.lit(";"))
    is_hex = F.lower(F.substring(body, 1, 2)) == "#x"
    digits = F.when(is_hex, F.regexp_replace(body, "^#[xX]0*", "")).otherwise(F.regexp_replace(body, "^#0*", ""))
    code = F.when(F.length(digits).between(1, 7), F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
    low = F.pmod(code, F.lit(65536))
    fine = code.between(0x20, 0x7E) | code.isin(0x09, 0x0A, 0x0C) | (code.between(0xA0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & ~code.between(0xFDD0, 0xFDEF) & (low < 0xFFFE))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(body.startswith("#"), F.when(F.coalesce(fine, F.lit(False)), char).otherwise(whole)).otherwise(F.coalesce(F.try_element_at(names, body), whole))


def decode_references(c: Column | str) -> Column:
    """Named and numeric references with a semicolon, decoded once."""
    c = _col(c)
    between = F.split(c, ENTITY, -1)
    bodies = F.regexp_extract_all(c, F.lit(ENTITY), 1)
    joined = F.array_join(F.zip_with(between, bodies, lambda t, b: F.concat(t, F.when(b.isNull(), "").otherwise(_reference(b)))), "")
    return F.when(c.contains("&"), joined).otherwise(c)


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def plain(html: Column | str) -> Column:
    """Tags out, references decoded, invisible characters and white space to single blanks; case and punctuation stay."""
    return collapse(F.translate(decode_references(strip_tags(html)), INVISIBLE, " " * len(INVISIBLE)))


def lower_ascii(c: Column | str) -> Column:
    return F.translate(_col(c), UPPER, LOWER)


def normalize(html: Column | str) -> Column:
    """Lowered (A-Z only) text of letters, numbers, marks and + - / = < > % . with single blanks."""
    return collapse(F.regexp_replace(lower_ascii(plain(html)), r"[^\p{L}\p{N}\p{M}+\-/=<>%.]+", " "))


def tokens(normalized: Column | str) -> Column:
    """Words but stop words and single bytes that are no digit; repeats stay."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(_col(normalized), " "), lambda t: (t != "") & ~F.array_contains(stop, t) & ((F.octet_length(t) >= 2) | t.rlike("^[0-9]$")))


def keywords(words: Column | str, limit: int = KEYWORDS) -> Column:
    """The most frequent tokens; ties by more bytes, then by byte order. One sort per row, no shuffle."""

    def ranked(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (n > 0) & ((i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2))))
        items = let(starts, lambda at: F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), n + 1)).alias("less"), (-F.octet_length(F.get(ordered, i - 1))).alias("shorter"), F.get(ordered, i - 1).alias("token"))))
        return F.transform(F.slice(F.array_sort(items), 1, limit), lambda x: x["token"])

    return let(F.array_sort(_col(words)), ranked)
