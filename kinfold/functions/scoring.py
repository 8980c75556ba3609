"""Pair similarity, scores, thresholds and progress arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(x: float) -> Column:
    return F.lit(float(x))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if either has none."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), dbl(0)).otherwise(shared.cast("double") / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)).cast("double"))


def same_answer(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (a == b), F.lit(False))


def score(exact: Column, j: Column, answer: Column, qtype: Column) -> Column:
    """1 for equal texts, else 0.80 j + 0.15 [answer] + 0.05 [type], in doubles from left to right."""
    total = dbl(0.80) * j + dbl(0.15) * answer.cast("double") + dbl(0.05) * qtype.cast("double")
    return F.when(exact, dbl(1)).otherwise(F.least(dbl(1), total))


def threshold(answer: Column, qtype: Column) -> Column:
    return F.when(qtype & answer, dbl(0.20)).when(qtype, dbl(0.28)).otherwise(dbl(0.38))


def percent(done: Column, total: Column, finished: Column) -> Column:
    """Whole percent done of at least one; 100 when finished."""
    most = F.greatest(total, F.lit(1))
    return F.when(finished, F.lit(100)).otherwise(F.floor(F.least(done, most) / most * 100)).cast("int")
