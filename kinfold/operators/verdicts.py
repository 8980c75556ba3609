"""Strict verdict parsing, and a pluggable comparator over bounded batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.plans.config import EVIDENCE_ITEMS
from kinfold.sources.staging import sent, stage

CLASSES = ("same_question", "strongly_overlapping", "related_but_distinct", "unrelated")
VERDICT = "struct<classification:string,confidence:double,reason:string,evidence:array<string>>"
KEYS = {"classification", "confidence", "evidence", "reason"}
BLANK = " \t\n\r\0\x0b"
Comparator = Callable[[dict, dict], str]


def _refuse(token: str):
    raise ValueError(token)


def parse_verdict(raw: str | None) -> dict | None:
    """The verdict, or None where the text is not exactly one valid JSON object of the four keys."""
    try:
        data = json.loads((raw or "").strip(BLANK), parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    if not isinstance(data, dict) or set(data) != KEYS:
        return None
    confidence, reason, evidence = data["confidence"], data["reason"], data["evidence"]
    if not isinstance(data["classification"], str) or data["classification"] not in CLASSES:
        return None
    if isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
        return None
    if not isinstance(reason, str) or not reason.strip(BLANK):
        return None
    if evidence == {}:
        evidence = []
    if not isinstance(evidence, list) or len(evidence) > EVIDENCE_ITEMS or not all(isinstance(e, str) for e in evidence):
        return None
    items = [e.strip(BLANK) for e in evidence]
    return {"classification": data["classification"], "confidence": float(confidence), "reason": reason.strip(BLANK), "evidence": [e for e in items if e]}


def verdict(raw: Column | str) -> Column:
    """Arrow-batched `parse_verdict`; a null classification marks a refusal."""
    empty = {"classification": None, "confidence": None, "reason": None, "evidence": None}

    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_verdict(x) or empty for x in texts], columns=list(empty))

    return F.pandas_udf(parse, VERDICT)(raw)


def local_comparator(a: dict, b: dict) -> str:
    """A deterministic stand-in for a service: equal texts, else the overlap of words. Its reason says that it is local."""
    x, y = set((a["text"] or "").lower().split()), set((b["text"] or "").lower().split())
    share = len(x & y) / len(x | y) if x | y else 0.0
    kind = "same_question" if a["text"] == b["text"] else "strongly_overlapping" if share >= 0.6 else "related_but_distinct" if share >= 0.3 else "unrelated"
    return json.dumps({"classification": kind, "confidence": round(1.0 if kind == "same_question" else share, 5), "reason": "local word overlap", "evidence": sorted(x & y)[:3]})


def payload(snaps: DataFrame) -> DataFrame:
    """entry, category and item: what a comparator sees of a snapshot."""
    return snaps.select("entry", "category", F.struct(F.col("entry").alias("id"), F.col("qtype").alias("type"), F.col("semantictext").alias("text"), F.to_json(F.coalesce("answersummary", F.array())).alias("answers")).alias("item"))


def compare(numbered: DataFrame, snaps: DataFrame, comparator: Comparator = local_comparator) -> DataFrame:
    """category, a, b, classification, confidence, reason, evidence, error, calls. numbered: category, a, b, batch.

    A pair without both snapshots in its category is an error without a call.
    Texts of snapshots in no pair stay where they are. `numbered` is read twice.
    """
    used = sent(stage(numbered.select(F.explode(F.array("a", "b")).alias("entry")).distinct(), "used"))
    side = lambda x: payload(snaps.join(used, "entry", "left_semi")).toDF(x, f"category_{x}", f"item_{x}")
    both = numbered.join(side("a"), "a", "left").join(side("b"), "b", "left")
    fresh = F.coalesce((F.col("category_a") == F.col("category")) & (F.col("category_b") == F.col("category")), F.lit(False))
    rows = both.select("category", "a", "b", fresh.alias("fresh"), F.to_json("item_a").alias("item_a"), F.to_json("item_b").alias("item_b"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                found, error = None, None
                if r.fresh:
                    try:
                        found = parse_verdict(comparator(json.loads(r.item_a), json.loads(r.item_b)))
                        error = None if found else "invalid response"
                    except Exception as e:  # a comparator's failure is the pair's, not the scan's
                        error = str(e) or type(e).__name__
                else:
                    error = "stale pair"
                found = found or {"classification": None, "confidence": None, "reason": None, "evidence": None}
                out.append((r.category, r.a, r.b, *found.values(), error, int(r.fresh)))
            yield pd.DataFrame(out, columns=["category", "a", "b", "classification", "confidence", "reason", "evidence", "error", "calls"])

    return rows.mapInPandas(ask, "category string, a long, b long, classification string, confidence double, reason string, evidence array<string>, error string, calls long")


def apply_verdicts(pairs: DataFrame, verdicts: DataFrame, now: int) -> DataFrame:
    """`pairs` with verdicts written: analysed, or aierror with its message (earlier verdict columns stay)."""
    new = verdicts.select("category", "a", "b", *[F.col(c).alias(f"new_{c}") for c in ("classification", "confidence", "reason", "evidence", "error")], F.lit(True).alias("asked"))
    both = pairs.join(new, ["category", "a", "b"], "left")
    good, bad = F.col("asked") & F.col("new_error").isNull(), F.col("asked") & F.col("new_error").isNotNull()
    pick = lambda c, kind: F.when(good, F.col(f"new_{c}").cast(kind)).otherwise(F.col(c))
    return both.withColumns({
        "state": F.when(good, "analysed").when(bad, "aierror").otherwise(F.col("state")), "aierror": F.when(good, F.lit(None)).when(bad, F.col("new_error")).otherwise(F.col("aierror")),
        "classification": pick("classification", "string"), "confidence": pick("confidence", "decimal(6,5)"), "reason": pick("reason", "string"), "evidence": pick("evidence", "array<string>"),
        "timemodified": F.when(F.col("asked"), F.lit(now).cast("long")).otherwise(F.col("timemodified")),
    }).select(*pairs.columns)


def verdict_stats(verdicts: DataFrame) -> DataFrame:
    """category, calls, errors: stale pairs are errors but no calls."""
    return verdicts.groupBy("category").agg(F.coalesce(F.sum("calls"), F.lit(0)).cast("long").alias("calls"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("errors"))
