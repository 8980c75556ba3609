"""Registered queries of the engine, each with the DuckDB SQL of the same result.

Roles of the driver's tables: documents are items (lang: category, source:
type), conversations are items with answers, events are versions (by user) and
changes, pages are HTML. Pair history is made from ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import hashing as H
from kinfold.functions import text as T
from kinfold.functions.features import features
from kinfold.operators import candidates as cand
from kinfold.operators import greedy, pairs, report, verdicts, versions
from kinfold.plans import engine, lifecycle
from kinfold.plans.config import Config
from kinfold.sources import tables as src
from kinfold.sources.staging import shared_dir, stage
from kinfold.sources.state import read_pairs

#: Limits of the queries: the defaults, and tight ones that bind on small tables, too.
DEFAULT, TIGHT = Config(), Config(max_per_item=5, max_new_pairs=25)
OPEN = Config(max_per_item=1_000_000, max_new_pairs=1_000_000_000)


def _texts(spark, d, name="documents"):
    """A table whose rows are much work each."""
    return src.spread(src.table(spark, d, name))


def _documents(spark, d):
    return src.document_items(_texts(spark, d))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return versions.snapshots(_documents(spark, d))


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return versions.snapshots(src.conversation_items(src.table(spark, d, "conversations")))


def _history(spark: SparkSession, d: str) -> DataFrame:
    """A pair table made from document ids."""
    n = F.col("doc_id")
    state = F.element_at(F.array(*[F.lit(s) for s in ("candidate", "analysed", "aierror", "notduplicate", "ignored")]), (n % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(s) for s in verdicts.CLASSES]), (n % 4 + 1).cast("int"))
    done = n % 5 == 1
    return src.table(spark, d, "documents").select(
        "doc_id", n.alias("id"), F.col("source").alias("category"), n.alias("a"), (n + 7).alias("b"), F.lit("x").alias("hasha"), F.lit("y").alias("hashb"),
        (n % 97 / F.lit(96)).cast("decimal(6,5)").alias("heuristicscore"), F.when(done, kind).alias("classification"), F.when(done, (n % 101 / F.lit(100)).cast("decimal(6,5)")).alias("confidence"),
        F.when(done, F.lit("because")).alias("reason"), state.alias("state"), F.when(n % 5 == 2, F.lit("failed")).alias("aierror"), (n % 2 + 1).alias("lastscanid"), F.lit(1).cast("long").alias("timemodified"),
    )


def _light(spark: SparkSession, d: str, every: str = "doc_id >= 0") -> DataFrame:
    return src.table(spark, d, "documents").where(every).select(F.col("doc_id").alias("entry"), F.col("source").alias("category"), F.concat(F.lit("n"), F.col("doc_id")).alias("name"), F.col("lang").alias("qtype"))


def q_latest_visible(spark, d):
    return versions.latest_visible(src.event_versions(src.table(spark, d, "events"))).select("entry", "versionid", "version", "status")


def q_visible_count(spark, d):
    seen = versions.visible(src.event_versions(src.table(spark, d, "events")))
    return seen.groupBy("entry").agg(F.count(F.lit(1)).alias("visible_versions"))


def q_plain_html(spark, d):
    return _texts(spark, d, "pages").select("page_id", T.plain("html").alias("plain"))


def q_normalize(spark, d):
    return _texts(spark, d).select("doc_id", T.normalize("text").alias("normalized"))


def q_tokens(spark, d):
    return _texts(spark, d).select("doc_id", T.tokens(T.normalize("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_hash"))


def q_keywords(spark, d):
    return _texts(spark, d).select("doc_id", F.array_join(features("text", "keywords")["keywords"], ",").alias("keywords"))


def q_text_hash(spark, d):
    return _texts(spark, d).select("doc_id", H.sha(T.normalize("text")).alias("texthash"))


def q_source_hash(spark, d):
    return _conversations(spark, d).select("entry", "sourcehash")


def q_answer_hash(spark, d):
    return _conversations(spark, d).select("entry", "answerhash")


def q_answer_summary(spark, d):
    shown = F.transform("answersummary", lambda a: F.concat(F.format_string("%.1f", a["fraction"]), F.lit(":"), a["text"]))
    return _conversations(spark, d).select("entry", F.array_join(shown, "|").alias("summary"))


def q_minhash(spark, d):
    return _texts(spark, d).select("doc_id", F.array_join(F.transform(features("text", "minhash")["minhash"], lambda x: x.cast("string")), ",").alias("minhash"))


def q_bands(spark, d):
    return _texts(spark, d).select("doc_id", F.explode(H.bands(features("text", "minhash")["minhash"])).alias("band"))


def q_buckets(spark, d):
    return cand.buckets(_snapshots(spark, d))


def q_answer_buckets(spark, d):
    return cand.buckets(_conversations(spark, d)).where(F.col("bucketkey").startswith("an:"))


def q_bucket_sizes(spark, d):
    return cand.bucket_sizes(cand.buckets(_snapshots(spark, d)), DEFAULT.bucket_limit)


def q_exact_clusters(spark, d):
    return cand.exact_clusters(_snapshots(spark, d).select("category", "texthash"))


def q_exact_chain(spark, d):
    texts = _documents(spark, d).select("category", "entry", H.sha(T.normalize("questiontext")).alias("texthash"), F.lit(None).cast("string").alias("answerhash"))
    return cand.exact_chain(texts).select("category", "texthash", "a", "b")


def q_bucket_pairs(spark, d):
    return cand.bucket_pairs(stage(_snapshots(spark, d).select(*cand.COLUMNS).drop("tokens", "sourcehash"), "snapshots"), DEFAULT.bucket_limit)


def q_scored_pairs(spark, d):
    snaps = stage(_snapshots(spark, d).select(*cand.COLUMNS), "snapshots")
    return cand.measured(snaps, DEFAULT.bucket_limit).select("category", "a", "b", "exact", "same_answer", "same_type", F.round("jaccard", 5).alias("token_jaccard"), F.round("score", 5).alias("score"))


def _candidates(spark, d, config=DEFAULT):
    return stage(cand.candidates(stage(_snapshots(spark, d).select(*cand.COLUMNS), "snapshots"), config), "candidates")


def q_thresholded(spark, d):
    return _candidates(spark, d).select("category", "a", "b", F.round("score", 5).alias("score"))


def q_answer_pairs(spark, d):
    snaps = stage(_conversations(spark, d).select(*cand.COLUMNS), "snapshots")
    return cand.measured(snaps, DEFAULT.bucket_limit).select("category", "a", "b", "exact", "same_answer", F.round("score", 5).alias("score"))


def _kinds(found):
    n = F.col("a") + F.col("b")
    return found.withColumn("kind", F.when(n % 7 == 0, "reused").when(n % 11 == 0, "still").otherwise("new"))


def _greedy(spark, d, config):
    return greedy.select_pairs(_kinds(_candidates(spark, d, config)), config.item_limit, config.budget).select("category", "a", "b", "result")


def q_greedy(spark, d):
    return _greedy(spark, d, DEFAULT)


def q_greedy_tight(spark, d):
    """Under a cap and a budget that bind."""
    return _greedy(spark, d, TIGHT)


def q_greedy_unbound(spark, d):
    return greedy.select_pairs(_candidates(spark, d).withColumn("kind", F.lit("new")), OPEN.item_limit, OPEN.budget).select("category", "a", "b", "result")


def q_greedy_dense(spark, d):
    """All pairs of a nation's suppliers: long chains of pairs that wait for one another."""
    s = src.table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("k"), F.col("s_suppkey").alias("n"))
    # Pairs are made anew at each reading, from ids that go to all executors, and never written.
    first = s.select("k", F.col("k").cast("string").alias("category"), F.col("n").alias("a")).repartition(8 * spark.sparkContext.defaultParallelism, "a")
    pairs_ = first.join(F.broadcast(s.withColumnRenamed("n", "b")), "k").where("a < b").withColumn("position", F.struct(F.expr("(a * 31 + b * 17) % 101").alias("x"), F.col("a").alias("i"), F.col("b").alias("j")))
    return greedy.select_pairs(_kinds(pairs_), TIGHT.item_limit, TIGHT.budget).select("category", "a", "b", "result")


def _old_pairs(found: DataFrame) -> DataFrame:
    """Earlier states of two thirds of the found pairs; one in four has an outdated hash."""
    n = F.col("a") + F.col("b")
    state = F.element_at(F.array(*[F.lit(s) for s in ("candidate", "analysed", "aierror", "notduplicate", "ignored")]), (n % 5 + 1).cast("int"))
    hashed = F.when(n % 4 == 0, F.lit("old")).otherwise(F.col("sourcehash_a"))
    empty = F.lit(None)
    return found.where(n % 3 != 0).select("category", "a", "b", hashed.alias("hasha"), F.col("sourcehash_b").alias("hashb"), F.lit(0.5).cast("decimal(6,5)").alias("heuristicscore"), empty.cast(pairs.HEURISTICS).alias("heuristics"), F.lit("unrelated").alias("classification"), F.lit(0.9).cast("decimal(6,5)").alias("confidence"), F.lit("old").alias("reason"), F.array(F.lit("e")).alias("evidence"), state.alias("state"), empty.cast("string").alias("aierror"), F.lit(1).cast("long").alias("lastscanid"), F.lit(10).cast("long").alias("timecreated"), F.lit(10).cast("long").alias("timemodified"))


def _merged(spark, d, config=DEFAULT):
    found = _candidates(spark, d, config)
    old = _old_pairs(found)
    kinds = stage(pairs.classify(found, old), "kinds")
    return kinds, greedy.select_pairs(kinds, config.item_limit, config.budget), old


def _pair_merge(spark, d, config):
    kinds, results, old = _merged(spark, d, config)
    return pairs.merge(kinds, results, old, 2, 20).select("category", "a", "b", "state", "classification", F.col("heuristicscore").cast("double").alias("score"), "lastscanid", "timecreated", "timemodified")


def q_pair_merge(spark, d):
    return _pair_merge(spark, d, DEFAULT)


def q_pair_merge_tight(spark, d):
    return _pair_merge(spark, d, TIGHT)


def q_scan_stats(spark, d):
    return pairs.scan_stats(_merged(spark, d)[1])


def q_scan_stats_tight(spark, d):
    return pairs.scan_stats(_merged(spark, d, TIGHT)[1])


def q_conversation_chain(spark, d):
    """Chains of equal questions in the order of their answers."""
    return cand.exact_chain(_conversations(spark, d)).select("category", "texthash", "position", "a", "b")


def _host_tables(spark, d):
    """Customers as entries of their nation's category, orders as their versions and questions, order lines as answers."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = src.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "hidden").when(F.col("o_orderstatus") == "O", "draft").otherwise("ready")
    entries = src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("questioncategoryid"))
    versions_ = orders.select((F.col("o_orderkey") + 1_000_000).alias("id"), F.col("o_custkey").alias("questionbankentryid"), F.col("o_orderkey").alias("questionid"), F.row_number().over(order).alias("version"), status.alias("status"))
    questions = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("qtype"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("name"), F.concat(F.lit("<p>"), F.col("o_orderstatus"), F.lit("</p>")).alias("questiontext"), F.lit("").alias("generalfeedback"))
    # An order has repeated line numbers, which part and supplier tell apart.
    answers = src.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("id")).agg(F.min("l_returnflag").alias("answer"), F.max("l_discount").alias("fraction"))
    return entries, versions_, questions, answers


def q_question_items(spark, d):
    """Host tables as items: the newest version of each entry that is not hidden, with its question and answers."""
    items = src.join_question_tables(*_host_tables(spark, d))
    shown = F.transform("answers", lambda a: F.concat_ws(":", a["id"], a["answer"], F.format_string("%.2f", a["fraction"])))
    return items.select("entry", "category", "qtype", "name", "questiontext", F.array_join(shown, "|").alias("answers"))


def q_affected(spark, d):
    """Entries that changes of orders (as questions) name: by their version, or by a snapshot where the version is gone."""
    from kinfold.streaming.invalidation import affected

    link = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("questionid"), F.col("o_custkey").alias("entry"))
    changes = src.table(spark, d, "events").select((F.col("event_id") % 997 * 13).alias("questionid"))
    return affected(changes, link.where("questionid % 3 <> 0"), link.where("questionid % 2 = 0").withColumn("entry", F.col("entry") + 5_000_000))


def q_snapshot_merge(spark, d):
    """The snapshot table after a second scan of the sources that still have documents: replaced, added, dropped, and kept ones."""
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.coalesce("source", F.lit("")).alias("category"), F.md5("text").alias("sourcehash"))
    at = lambda n: F.lit(n).cast("long")
    old = docs.where("entry % 10 <> 3").withColumns({"lastscanid": at(1), "timecreated": F.col("entry") % 4 + 10, "timemodified": at(10)})
    elsewhere = old.withColumns({"entry": F.col("entry") + 10_000_000, "category": F.lit("another")})
    return versions.merge_snapshots(old.unionByName(elsewhere), docs.where("entry % 6 <> 1"), 2, 20)


def q_limits(spark, d):
    """Settings and what they take effect as."""
    rows = []
    for k in (r[0] for r in src.table(spark, d, "nation").select(F.col("n_nationkey").cast("long")).collect()):
        c = Config(k * 9, k * 3, k * 40 - 100, k * 6)
        rows.append((k, c.bucket_limit, c.item_limit, c.budget, c.batch))
    return spark.createDataFrame(rows, "n long, bucket_limit long, item_limit long, budget long, batch long")


def _scan_rows(spark, d):
    """Events as scans of their user's category."""
    one = lambda c: F.lit(0).cast("long").alias(c)
    status = F.when(F.col("event_id") % 400 == 1, "comparing").when(F.col("event_id") % 400 == 2, "queued").otherwise("completed")
    return src.table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 40).cast("string").alias("category"), status.alias("status"), F.lit("x").alias("phase"),
        *[one(c) for c in lifecycle.COUNTERS[:-1]], (F.col("event_id") % 3).alias("aierrors"), F.lit(None).cast("string").alias("message"), F.lit(5).cast("long").alias("timecreated"), *[one(c) for c in ("timestarted", "timefinished", "timemodified")],
    )


def q_queue_scans(spark, d):
    """A scan is wanted of every category; those with one in flight get none."""
    wanted = src.table(spark, d, "events").select((F.col("user_id") % 50).cast("string").alias("category"))
    return lifecycle.queue(_scan_rows(spark, d), wanted, 9).where("timecreated = 9").select("id", "category", "status", "phase", "totalquestions", "timecreated", "timestarted")


def q_refresh_scans(spark, d):
    """Scans with counts from the pair history; comparing ones without open candidates end."""
    history = _history(spark, d).withColumn("lastscanid", F.col("doc_id") % 500)
    return lifecycle.refresh(_scan_rows(spark, d), history, 9).select("id", "status", "phase", "totalcandidates", "processedcandidates", "timefinished")


def q_comparable(spark, d):
    """Batches of scans that still take verdicts."""
    return lifecycle.comparable(src.table(spark, d, "documents").select(F.col("doc_id").alias("batch"), (F.col("doc_id") % 500).alias("scan")), _scan_rows(spark, d)).select("batch", "scan")


def q_changed(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.col("source").alias("category"), F.md5("text").alias("sourcehash"))
    old = docs.where("entry % 10 <> 3").withColumn("sourcehash", F.when(F.col("entry") % 4 == 0, F.lit("old")).otherwise(F.col("sourcehash")))
    return versions.changed_entries(old, docs)


def q_stale(spark, d):
    return versions.stale_entries(_light(spark, d), _light(spark, d, "doc_id % 6 <> 1"))


def q_invalidated(spark, d):
    gone = src.table(spark, d, "documents").where("doc_id % 9 = 2").select(F.col("doc_id").alias("entry"))
    return pairs.invalidate(_history(spark, d), gone).select("a", "b", "state")


def q_decisions(spark, d):
    h = _history(spark, d)
    decided = h.where("doc_id % 8 = 5").select("category", "a", "b", F.when(F.col("doc_id") % 16 == 5, "ignored").otherwise("notduplicate").alias("decision"))
    return pairs.decide(h, decided, 30).select("a", "b", "state", "timemodified")


def q_batches(spark, d):
    return pairs.batches(_history(spark, d), 1, 3).select("category", "a", "b", "batch")


def q_stale_pairs(spark, d):
    return pairs.stale(_history(spark, d), _light(spark, d, "doc_id % 6 <> 1"))


VERDICT_CASES = [
    '{"classification":"same_question","confidence":0.97,"reason":" same ","evidence":["a"," ","b "]}',
    '```json\n{"classification":"unrelated","confidence":1,"reason":"r","evidence":[]}\n```',
    '{"classification":"unrelated","confidence":1,"reason":"r","evidence":[]}',
    '{"classification":"unrelated","confidence":true,"reason":"r","evidence":[]}',
    '{"classification":"unrelated","confidence":"1","reason":"r","evidence":[]}',
    '{"classification":"unrelated","confidence":1.01,"reason":"r","evidence":[]}',
    '{"classification":"other","confidence":0.5,"reason":"r","evidence":[]}',
    '{"classification":"unrelated","confidence":0.5,"reason":" ","evidence":[]}',
    '{"classification":"unrelated","confidence":0.5,"reason":"r","evidence":[1]}',
    '{"classification":"unrelated","confidence":0.5,"reason":"r","evidence":["1","2","3","4","5","6","7","8","9"]}',
    '{"classification":"unrelated","confidence":0.5,"reason":"r","evidence":[],"more":1}',
    '{"classification":"unrelated","confidence":0.5,"reason":"r","evidence":[]} x',
    "[]", "{}", "null", "",
]


def q_verdict_parse(spark, d):
    cases = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in VERDICT_CASES])).alias("case", "raw"))
    v = cases.select("case", verdicts.verdict("raw").alias("v"))
    return v.select("case", "v.classification", "v.confidence", "v.reason", F.array_join("v.evidence", "|").alias("evidence"))


def q_verdict_stats(spark, d):
    n = F.col("doc_id")
    rows = src.table(spark, d, "documents").select(F.col("source").alias("category"), F.when(n % 4 == 0, F.lit("failed")).alias("error"), F.when(n % 8 == 0, 0).otherwise(1).cast("long").alias("calls"))
    return verdicts.verdict_stats(rows)


def q_compare(spark, d):
    snaps = stage(_snapshots(spark, d).select(*cand.COLUMNS, "semantictext", "answersummary"), "snapshots")
    found = cand.candidates(snaps, DEFAULT).select("category", "a", "b", F.lit(0).cast("long").alias("batch"))
    return verdicts.compare(stage(found, "candidates"), snaps).select("a", "b", "classification", "confidence", "calls")


def q_scan_progress(spark, d):
    return report.progress(_history(spark, d), 1)


def _report(spark, d, show_all):
    return report.report(_history(spark, d), _light(spark, d), 1, show_all)


def q_report_default(spark, d):
    return _report(spark, d, False).drop("confidence", "heuristicscore")


def q_report_all(spark, d):
    return _report(spark, d, True).drop("confidence", "heuristicscore")


def q_report_page(spark, d):
    return report.page(_report(spark, d, True), 1, 10).select("id")


def q_report_count(spark, d):
    return report.reported(_history(spark, d), 1).agg(F.count(F.lit(1)).alias("total"))


def _scans(spark, d):
    return src.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).cast("string").alias("category"), F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "queued").otherwise("completed").alias("status"))


def q_latest_scan(spark, d):
    return lifecycle.latest_scans(_scans(spark, d))


def q_active_scan(spark, d):
    return lifecycle.active_scan(_scans(spark, d), "3")


def q_event_invalidation(spark, d):
    """The history's pairs after a stream of changes (purchases) has run to its end."""
    import uuid

    from kinfold.streaming.invalidation import invalidate_stream

    root = f"{shared_dir(spark)}/kinfold-stream-{uuid.uuid4().hex}"
    store = src.Store(spark, root)
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    history = _history(spark, d).withColumns({"heuristics": empty("h", pairs.HEURISTICS), "evidence": empty("e", "array<string>"), "timecreated": F.col("timemodified")})
    store.write("pair", history.select(*[c.split()[0] for c in pairs.SCHEMA.replace(pairs.HEURISTICS, "h").replace("(6,5)", "").split(", ")]))
    snaps = _light(spark, d).withColumns({c: empty(c, kind) for c, kind in (("sourcehash", "string"), ("texthash", "string"), ("answerhash", "string"), ("answersummary", "array<struct<fraction:double,text:string>>"), ("semantictext", "string"), ("normalizedtext", "string"), ("tokens", "array<string>"), ("keywords", "array<string>"), ("minhash", "array<bigint>"), ("lastscanid", "long"), ("timecreated", "long"), ("timemodified", "long"))})
    store.write("snapshot", snaps)
    events = src.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("long").alias("entry"))
    for k in (0, 1):
        events.where(F.col("entry") % 2 == k).coalesce(1).write.mode("append").parquet(f"{root}/events")
    stream = spark.readStream.schema("entry long").option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
    invalidate_stream(stream, store, f"{root}/checkpoint").awaitTermination()
    return read_pairs(store).select("a", "b", "state")


def _scan(spark, d, config):
    none = lambda schema: spark.createDataFrame([], schema)
    done = engine.scan(_documents(spark, d), none(engine.SNAPSHOT), none(pairs.SCHEMA), 1, 1, config)
    return done.pairs.select("category", "a", "b", F.col("heuristicscore").cast("double").alias("score"), "state", "classification")


def q_scan(spark, d):
    """The flagship: a whole scan of all documents with the local comparator, under the default limits."""
    return _scan(spark, d, DEFAULT)


def q_scan_open(spark, d):
    """The same with a cap and a budget that cannot bind."""
    return _scan(spark, d, OPEN)


def q_scan_tight(spark, d):
    """The same with a cap and a budget that bind."""
    return _scan(spark, d, TIGHT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("q_")}


# ---- the same in DuckDB's SQL -------------------------------------------------------------------

# Fixed values, written out here and not taken from the engine: its stop words, in its order of letters.
_STOP_WORDS = "a an and ao aos are as be com como con cual da das de do dos e el em en es for how in is la las los na nas no nos o of on or os para por quais qual que se ser son that the this to um uma un una what which with y"
_STOP = "[" + ",".join(f"'{w}'" for w in _STOP_WORDS.split()) + "]"


def _norm(c: str) -> str:
    plain = rf"trim(regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
    low = f"translate({plain}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"trim(regexp_replace(regexp_replace({low}, '[^\p{{L}}\p{{N}}\p{{M}}+\-/=<>%.]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _toks(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '' AND NOT list_contains({_STOP}, t) AND (octet_length(encode(t)) >= 2 OR regexp_matches(t, '^[0-9]$')))"


_MINHASH = "list_transform(range(12), lambda s: list_min(list_transform(list_distinct(toks), lambda t: substr(sha256(s::VARCHAR || ':' || t), 1, 8))))"
_PLAIN = r"trim(regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_CONV = f"""
t AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS asked, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS replied FROM conversations),
an AS (SELECT conv_id AS entry, turn, CASE WHEN turn = replied THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fraction, {_norm('text')} AS ntext, {_PLAIN.format(c='text')} AS ptext FROM t WHERE role = 'assistant'),
ah AS (SELECT entry, sha256(string_agg(DISTINCT ntext, '|' ORDER BY ntext)) AS answerhash FROM an WHERE fraction > 0 AND ntext <> '' GROUP BY entry),
cv AS (SELECT conv_id AS entry, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user' AND turn = asked), '') AS q, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS fb FROM t GROUP BY conv_id)"""
_TK = f"tk AS (SELECT *, {_toks('norm')} AS toks, sha256(norm) AS texthash FROM base)"
_DOC = f"""
base AS (SELECT doc_id, doc_id AS entry, lang AS category, source AS qtype, {_norm('text')} AS norm, {_PLAIN.format(c='text')} AS plain, NULL::VARCHAR AS answerhash FROM documents),
{_TK}"""
_CONV_DOC = f"""{_CONV},
base AS (SELECT cv.entry, (cv.entry % 5)::VARCHAR AS category, 'chat' AS qtype, {_norm('q')} AS norm, answerhash FROM cv LEFT JOIN ah USING (entry)),
{_TK}"""
_KW = """
kwc AS (SELECT entry, t, count(*) AS n FROM (SELECT entry, unnest(toks) AS t FROM tk) GROUP BY ALL),
kwr AS (SELECT entry, t, row_number() OVER (PARTITION BY entry ORDER BY n DESC, octet_length(encode(t)) DESC, t) AS r FROM kwc)"""
_SIG = f"""
sig AS (SELECT entry, category, CASE WHEN len(toks) > 0 THEN list_transform({_MINHASH}, lambda h: ('0x' || h)::BIGINT) ELSE [] END AS sig FROM tk),
bnd AS (SELECT entry, category, 'mh:' || b || ':' || substr(sha256(array_to_string(sig[3 * b + 1 : 3 * b + 3], ':')), 1, 32) AS bucketkey FROM sig, range(4) r(b) WHERE len(sig) = 12)"""


def _buckets_sql(base: str) -> str:
    return f"""WITH RECURSIVE {base}, {_KW}, {_SIG},
bk AS (
  SELECT DISTINCT category, bucketkey, entry FROM (
    SELECT category, 'tx:' || substr(texthash, 1, 40) AS bucketkey, entry FROM tk WHERE norm <> ''
    UNION ALL SELECT category, 'an:' || substr(sha256(qtype || ':' || answerhash), 1, 40), entry FROM tk WHERE answerhash IS NOT NULL
    UNION ALL SELECT tk.category, 'kw:' || substr(sha256(t), 1, 40), kwr.entry FROM kwr JOIN tk USING (entry) WHERE r <= 6
    UNION ALL SELECT category, bucketkey, entry FROM bnd)),
bs AS (SELECT category, bucketkey, count(*) AS entries FROM bk GROUP BY ALL HAVING count(*) > 1 AND (count(*) <= 120 OR bucketkey LIKE 'tx:%'))"""


_CHAIN = "ch AS (SELECT category, texthash, lag(entry) OVER (PARTITION BY category, texthash ORDER BY coalesce(answerhash, ''), entry) AS x, entry AS y FROM tk WHERE norm <> '')"


def _pairs_sql(base: str) -> str:
    return f"""{_buckets_sql(base)}, {_CHAIN},
pr AS (
  SELECT category, least(x, y) AS a, greatest(x, y) AS b FROM ch WHERE x IS NOT NULL
  UNION SELECT x.category, x.entry, y.entry FROM bk x JOIN bk y ON x.category = y.category AND x.bucketkey = y.bucketkey AND x.entry < y.entry
    JOIN bs ON bs.category = x.category AND bs.bucketkey = x.bucketkey WHERE x.bucketkey NOT LIKE 'tx:%'),
ft AS (SELECT *, list_distinct(toks) AS ts FROM tk),
j AS (
  SELECT pr.*, f.texthash = g.texthash AND f.norm <> '' AS exact, f.qtype = g.qtype AS same_type, coalesce(f.answerhash = g.answerhash, false) AS same_answer,
    len(f.ts) AS n, len(g.ts) AS m, len(list_intersect(f.ts, g.ts)) AS i
  FROM pr JOIN ft f ON f.entry = a JOIN ft g ON g.entry = b),
jj AS (SELECT *, CASE WHEN n = 0 OR m = 0 THEN 0::DOUBLE ELSE i::DOUBLE / (n + m - i)::DOUBLE END AS jac FROM j),
sc AS (SELECT *, CASE WHEN exact THEN 1::DOUBLE ELSE least(1::DOUBLE, 0.80::DOUBLE * jac + 0.15::DOUBLE * same_answer::INT::DOUBLE + 0.05::DOUBLE * same_type::INT::DOUBLE) END AS score FROM jj),
ok AS (SELECT * FROM sc WHERE score >= CASE WHEN same_type AND same_answer THEN 0.20::DOUBLE WHEN same_type THEN 0.28::DOUBLE ELSE 0.38::DOUBLE END)"""


#: ok with pos, the first place at which a pair comes up.
_POSITIONS = """,
cp0 AS (SELECT category, texthash, lag(entry) OVER w AS x, entry AS y, row_number() OVER w AS i FROM tk WHERE norm <> '' WINDOW w AS (PARTITION BY category, texthash ORDER BY coalesce(answerhash, ''), entry)),
ps AS (
  SELECT category, a, b, min(pos) AS pos FROM (
    SELECT category, least(x, y) AS a, greatest(x, y) AS b, {'rank': 0, 'key': texthash, 'i': i, 'j': 0::BIGINT} AS pos FROM cp0 WHERE x IS NOT NULL
    UNION ALL SELECT x.category, x.entry, y.entry, {'rank': CASE WHEN x.bucketkey LIKE 'an:%' THEN 2 WHEN x.bucketkey LIKE 'mh:%' THEN 3 ELSE 4 END, 'key': x.bucketkey, 'i': x.entry, 'j': y.entry}
      FROM bk x JOIN bk y ON x.category = y.category AND x.bucketkey = y.bucketkey AND x.entry < y.entry JOIN bs ON bs.category = x.category AND bs.bucketkey = x.bucketkey WHERE x.bucketkey NOT LIKE 'tx:%')
  GROUP BY ALL),
op AS (SELECT ok.*, ps.pos FROM ok JOIN ps USING (category, a, b))"""


def _fold_sql(source: str, cap: int, budget: int) -> str:
    """gr: category, a, b, result. The sequential rule, one pair of each category at a step. source: category, a, b, kind, pos."""
    full = " OR ".join(f"len(list_filter(f.taken, lambda z: z = p.{x})) >= {cap}" for x in "ab")
    return f""",
gp AS (SELECT category, a, b, kind, row_number() OVER (PARTITION BY category ORDER BY pos) AS k FROM {source}),
fo AS (
  SELECT DISTINCT category, 0::BIGINT AS k, NULL::BIGINT AS a, NULL::BIGINT AS b, ''::VARCHAR AS result, []::BIGINT[] AS taken, 0::BIGINT AS fresh FROM gp
  UNION ALL
  SELECT category, k, a, b, result, CASE WHEN result IN ('active', 'reused') THEN list_concat(taken, [a, b]) ELSE taken END, fresh + (result = 'active')::BIGINT
  FROM (SELECT f.category, p.k, p.a, p.b, f.taken, f.fresh, CASE WHEN {full} THEN 'capped' WHEN p.kind = 'still' THEN 'still' WHEN p.kind = 'reused' THEN 'reused' WHEN f.fresh >= {budget} THEN 'budget' ELSE 'active' END AS result
    FROM fo f JOIN gp p ON p.category = f.category AND p.k = f.k + 1) s),
gr AS (SELECT category, a, b, result FROM fo WHERE k > 0)"""


_KIND = "CASE WHEN (a + b) % 7 = 0 THEN 'reused' WHEN (a + b) % 11 = 0 THEN 'still' ELSE 'new' END AS kind"
_BUCKETS, _PAIRS = _buckets_sql(_DOC), _pairs_sql(_DOC)
_WORDS = "list_filter(list_distinct(string_split(lower({c}), ' ')), lambda w: w <> '')"
#: The local comparator's classes and confidences of the pairs `ok`.
_COMPARED = f"""{_PAIRS},
wd AS (SELECT entry, plain, {_WORDS.format(c='plain')} AS ws FROM tk),
sh AS (SELECT ok.*, f.plain = g.plain AS equal, CASE WHEN len(f.ws) + len(g.ws) = 0 THEN 0::DOUBLE ELSE len(list_intersect(f.ws, g.ws))::DOUBLE / (len(f.ws) + len(g.ws) - len(list_intersect(f.ws, g.ws)))::DOUBLE END AS share
  FROM ok JOIN wd f ON f.entry = a JOIN wd g ON g.entry = b),
cd AS (SELECT *, CASE WHEN equal THEN 'same_question' WHEN share >= 0.6::DOUBLE THEN 'strongly_overlapping' WHEN share >= 0.3::DOUBLE THEN 'related_but_distinct' ELSE 'unrelated' END AS classification, CASE WHEN equal THEN 1::DOUBLE ELSE round(share, 5) END AS confidence FROM sh)"""
_STATES = "['candidate', 'analysed', 'aierror', 'notduplicate', 'ignored']"
_HIST = f"""
h AS (SELECT doc_id, doc_id AS id, source AS category, doc_id AS a, doc_id + 7 AS b, round((doc_id % 97) / 96.0::DOUBLE, 5) AS score,
  CASE WHEN doc_id % 5 = 1 THEN ['same_question', 'strongly_overlapping', 'related_but_distinct', 'unrelated'][doc_id % 4 + 1] END AS classification,
  CASE WHEN doc_id % 5 = 1 THEN (doc_id % 101) / 100.0::DOUBLE END AS confidence, {_STATES}[doc_id % 5 + 1] AS state, doc_id % 2 + 1 AS scan FROM documents)"""

def _report_sql(where: str) -> str:
    failed = "state = 'aierror'"
    return f"""WITH {_HIST}, r AS (SELECT h.*, x.lang AS type_a, y.lang AS type_b FROM h JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE scan = 1 AND {where})
SELECT id, a, b, 'n' || a AS name_a, 'n' || b AS name_b, type_a, type_b, {failed} AS failed, CASE WHEN NOT {failed} THEN classification END AS classification,
  CASE WHEN NOT {failed} THEN round(confidence * 100)::INT END AS confidence_percent, CASE WHEN NOT {failed} THEN round(score * 100)::INT END AS heuristic_percent,
  CASE WHEN {failed} THEN 'failed' ELSE 'because' END AS reason FROM r"""


_DEFAULT, _ALL = "state = 'analysed' AND classification <> 'unrelated'", "state IN ('analysed', 'aierror')"
_EVENTS = "v AS (SELECT event_id AS versionid, user_id AS entry, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS version, CASE event_type WHEN 'error' THEN 'hidden' WHEN 'view' THEN 'draft' ELSE 'ready' END AS status FROM events)"
_MERGE = f"""{_PAIRS}{_POSITIONS}, mg AS (
  SELECT *, CASE WHEN was = 'ignored' OR (same AND was = 'notduplicate') THEN 'still' WHEN same AND was = 'analysed' THEN 'reused' ELSE 'new' END AS kind
  FROM (SELECT op.*, CASE WHEN (a + b) % 3 <> 0 THEN {_STATES}[(a + b) % 5 + 1] END AS was, (a + b) % 4 <> 0 AS same FROM op))"""


def _greedy_sql(cap: int, budget: int) -> str:
    return f"{_PAIRS}{_POSITIONS}, ki AS (SELECT category, a, b, pos, {_KIND} FROM op){_fold_sql('ki', cap, budget)} SELECT category, a, b, result FROM gr"


def _merge_sql(cap: int, budget: int) -> str:
    """Capped pairs, and those beyond the budget, stay as they were, if they were."""
    return f"""{_MERGE}{_fold_sql('mg', cap, budget)}, rs AS (SELECT mg.*, gr.result, gr.result IN ('capped', 'budget') OR (gr.result = 'still' AND was = 'ignored') AS kept FROM mg JOIN gr USING (category, a, b))
SELECT category, a, b, CASE result WHEN 'active' THEN 'candidate' ELSE was END AS state, CASE WHEN result <> 'active' THEN 'unrelated' END AS classification,
  CASE WHEN kept THEN 0.5::DOUBLE ELSE round(score::VARCHAR::DECIMAL(22, 18), 5)::DOUBLE END AS score, CASE WHEN kept THEN 1 ELSE 2 END::BIGINT AS lastscanid, CASE WHEN was IS NULL THEN 20 ELSE 10 END::BIGINT AS timecreated, CASE WHEN kept THEN 10 ELSE 20 END::BIGINT AS timemodified
FROM rs WHERE NOT (kept AND was IS NULL)"""


def _stats_sql(cap: int, budget: int) -> str:
    return f"{_MERGE}{_fold_sql('mg', cap, budget)} SELECT category, count(*) FILTER (result = 'active') AS active, count(*) FILTER (result = 'reused') AS reused, count(*) FILTER (result = 'still') AS suppressed, count(*) FILTER (result = 'active') AS newpending FROM gr GROUP BY category"


def _scan_sql(cap: int, budget: int) -> str:
    return f"{_COMPARED}{_POSITIONS}, ki AS (SELECT category, a, b, pos, 'new' AS kind FROM op){_fold_sql('ki', cap, budget)} SELECT category, a, b, round(score::VARCHAR::DECIMAL(22, 18), 5)::DOUBLE AS score, 'analysed' AS state, classification FROM cd JOIN gr USING (category, a, b) WHERE result = 'active'"


_SCANS = "s AS (SELECT event_id AS id, (user_id % 10)::VARCHAR AS category, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' ELSE 'completed' END AS status FROM events)"
_SCAN_ROWS = "sr AS (SELECT event_id AS id, (user_id % 40)::VARCHAR AS category, CASE WHEN event_id % 400 = 1 THEN 'comparing' WHEN event_id % 400 = 2 THEN 'queued' ELSE 'completed' END AS status, event_id % 3 AS aierrors FROM events)"
_VERDICT_ROWS = "(0, 'same_question', 0.97::DOUBLE, 'same', 'a|b'), (2, 'unrelated', 1.0::DOUBLE, 'r', '')"


def oracle_sql() -> dict[str, str]:
    bad = [k for k in range(len(VERDICT_CASES)) if k not in (0, 2)]
    return {
        "q_latest_visible": f"WITH {_EVENTS} SELECT a.entry, a.versionid, a.version, a.status FROM v a LEFT JOIN v n ON n.entry = a.entry AND n.status <> 'hidden' AND n.version > a.version WHERE a.status <> 'hidden' AND n.entry IS NULL",
        "q_visible_count": f"WITH {_EVENTS} SELECT entry, count(*) AS visible_versions FROM v WHERE status <> 'hidden' GROUP BY entry",
        "q_plain_html": r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages",
        "q_normalize": f"SELECT doc_id, {_norm('text')} AS normalized FROM documents",
        "q_tokens": f"WITH {_DOC} SELECT doc_id, len(toks)::BIGINT AS n_tokens, sha256(array_to_string(toks, ' ')) AS tokens_hash FROM tk",
        "q_keywords": f"WITH {_DOC}, {_KW} SELECT entry AS doc_id, coalesce(string_agg(t, ',' ORDER BY r) FILTER (r <= 8), '') AS keywords FROM base LEFT JOIN kwr USING (entry) GROUP BY entry",
        "q_text_hash": f"SELECT doc_id, sha256({_norm('text')}) AS texthash FROM documents",
        "q_source_hash": f"WITH {_CONV} SELECT entry, sha256(concat_ws(chr(10), 'chat', '', q, fb, coalesce((SELECT string_agg(p, '|' ORDER BY p) FROM (SELECT printf('%.7f:%s', fraction, ntext) AS p FROM an WHERE an.entry = cv.entry)), ''))) AS sourcehash FROM cv",
        "q_answer_hash": f"WITH {_CONV} SELECT entry, answerhash FROM cv LEFT JOIN ah USING (entry)",
        "q_answer_summary": f"WITH {_CONV} SELECT cv.entry, coalesce(string_agg(printf('%.1f:%s', fraction, ptext), '|' ORDER BY fraction DESC, ptext), '') AS summary FROM cv LEFT JOIN an ON an.entry = cv.entry GROUP BY cv.entry".replace("printf('%.1f:%s', fraction, ptext)", "CASE WHEN an.entry IS NOT NULL THEN printf('%.1f:%s', fraction, ptext) END"),
        "q_minhash": f"WITH {_DOC}, {_SIG} SELECT entry AS doc_id, array_to_string(sig, ',') AS minhash FROM sig",
        "q_bands": f"WITH {_DOC}, {_SIG} SELECT entry AS doc_id, bucketkey AS band FROM bnd",
        "q_buckets": f"{_BUCKETS} SELECT category, bucketkey, entry FROM bk",
        "q_answer_buckets": f"WITH {_CONV} SELECT (entry % 5)::VARCHAR AS category, 'an:' || substr(sha256('chat:' || answerhash), 1, 40) AS bucketkey, entry FROM ah",
        "q_bucket_sizes": f"{_BUCKETS} SELECT category, bucketkey, entries FROM bs",
        "q_exact_clusters": f"WITH {_DOC} SELECT category, texthash, count(*) AS entries FROM tk WHERE norm <> '' GROUP BY ALL HAVING count(*) > 1",
        "q_exact_chain": f"WITH {_DOC}, {_CHAIN} SELECT category, texthash, x AS a, y AS b FROM ch WHERE x IS NOT NULL",
        "q_bucket_pairs": f"{_PAIRS} SELECT category, a, b FROM pr",
        "q_scored_pairs": f"{_PAIRS} SELECT category, a, b, exact, false AS same_answer, same_type, round(jac::VARCHAR::DECIMAL(22, 18), 5)::DOUBLE AS token_jaccard, round(score::VARCHAR::DECIMAL(22, 18), 5)::DOUBLE AS score FROM sc",
        "q_thresholded": f"{_PAIRS} SELECT category, a, b, round(score::VARCHAR::DECIMAL(22, 18), 5)::DOUBLE AS score FROM ok",
        "q_answer_pairs": f"{_pairs_sql(_CONV_DOC)} SELECT category, a, b, exact, same_answer, round(score::VARCHAR::DECIMAL(22, 18), 5)::DOUBLE AS score FROM sc",
        "q_compare": f"{_COMPARED} SELECT a, b, classification, confidence, 1::BIGINT AS calls FROM cd",
        "q_scan": _scan_sql(30, 5000),
        "q_scan_tight": _scan_sql(5, 25),
        "q_scan_open": f"{_COMPARED} SELECT category, a, b, round(score::VARCHAR::DECIMAL(22, 18), 5)::DOUBLE AS score, 'analysed' AS state, classification FROM cd",
        "q_greedy": _greedy_sql(30, 5000),
        "q_greedy_tight": _greedy_sql(5, 25),
        "q_greedy_dense": f"""WITH RECURSIVE su AS (SELECT (s_nationkey % 5)::VARCHAR AS category, s_suppkey AS n FROM supplier),
ki AS (SELECT x.category, x.n AS a, y.n AS b, {{'x': (x.n * 31 + y.n * 17) % 101, 'i': x.n, 'j': y.n}} AS pos, {_KIND.replace('(a + b)', '(x.n + y.n)')} FROM su x JOIN su y ON x.category = y.category AND x.n < y.n){_fold_sql('ki', 5, 25)} SELECT category, a, b, result FROM gr""",
        "q_conversation_chain": f"WITH {_CONV_DOC}, c AS (SELECT category, texthash, lag(entry) OVER w AS x, entry AS y, (row_number() OVER w)::INT AS position FROM tk WHERE norm <> '' WINDOW w AS (PARTITION BY category, texthash ORDER BY coalesce(answerhash, ''), entry)) SELECT category, texthash, position, least(x, y) AS a, greatest(x, y) AS b FROM c WHERE x IS NOT NULL",
        "q_question_items": """WITH v AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders o),
n AS (SELECT a.* FROM v a LEFT JOIN v b ON b.o_custkey = a.o_custkey AND b.o_orderstatus <> 'P' AND b.version > a.version WHERE a.o_orderstatus <> 'P' AND b.o_custkey IS NULL),
l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, max(l_discount) AS d FROM lineitem GROUP BY ALL),
x AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || f || ':' || printf('%.2f', d), '|' ORDER BY l_linenumber) AS answers FROM l GROUP BY l_orderkey)
SELECT c_custkey AS entry, c_nationkey::VARCHAR AS category, o_orderpriority AS qtype, 'order ' || o_orderkey AS name, '<p>' || o_orderstatus || '</p>' AS questiontext, coalesce(answers, '') AS answers
FROM customer JOIN n ON o_custkey = c_custkey LEFT JOIN x ON l_orderkey = o_orderkey""",
        "q_affected": """WITH c AS (SELECT DISTINCT event_id % 997 * 13 AS q FROM events)
SELECT DISTINCT CASE WHEN q % 3 <> 0 THEN o_custkey ELSE o_custkey + 5000000 END AS entry FROM c JOIN orders ON o_orderkey = q WHERE q % 3 <> 0 OR q % 2 = 0""",
        "q_snapshot_merge": """WITH t AS (SELECT doc_id AS entry, coalesce(source, '') AS category, md5(text) AS sourcehash FROM documents), s AS (SELECT DISTINCT category FROM t WHERE entry % 6 <> 1)
SELECT entry, category, sourcehash, 2::BIGINT AS lastscanid, CASE WHEN entry % 10 <> 3 THEN entry % 4 + 10 ELSE 20 END::BIGINT AS timecreated, 20::BIGINT AS timemodified FROM t WHERE entry % 6 <> 1
UNION ALL SELECT entry, category, sourcehash, 1, entry % 4 + 10, 10 FROM t WHERE entry % 10 <> 3 AND entry % 6 = 1 AND category NOT IN (SELECT category FROM s)
UNION ALL SELECT entry + 10000000, 'another', sourcehash, 1, entry % 4 + 10, 10 FROM t WHERE entry % 10 <> 3""",
        "q_limits": "SELECT n_nationkey::BIGINT AS n, CASE WHEN n_nationkey = 0 THEN 120 ELSE greatest(10, n_nationkey * 9) END::BIGINT AS bucket_limit, CASE WHEN n_nationkey = 0 THEN 30 ELSE greatest(5, n_nationkey * 3) END::BIGINT AS item_limit, greatest(1, n_nationkey * 40 - 100)::BIGINT AS budget, CASE WHEN n_nationkey = 0 THEN 20 ELSE least(100, n_nationkey * 6) END::BIGINT AS batch FROM nation",
        "q_queue_scans": f"""WITH {_SCAN_ROWS}, w AS (SELECT DISTINCT (user_id % 50)::VARCHAR AS category FROM events), n AS (SELECT category FROM w WHERE category NOT IN (SELECT category FROM sr WHERE status IN ('queued', 'running', 'comparing')))
SELECT (SELECT max(id) FROM sr) + row_number() OVER (ORDER BY category) AS id, category, 'queued' AS status, 'queued' AS phase, 0::BIGINT AS totalquestions, 9::BIGINT AS timecreated, 0::BIGINT AS timestarted FROM n""",
        "q_refresh_scans": f"""WITH {_SCAN_ROWS}, {_HIST}, c AS (SELECT doc_id % 500 AS id, count(*) AS total, count(*) FILTER (state = 'candidate') AS pending FROM h WHERE state NOT IN ('ignored', 'notduplicate') GROUP BY 1),
j AS (SELECT sr.*, coalesce(total, 0) AS total, coalesce(pending, 0) AS pending FROM sr LEFT JOIN c USING (id))
SELECT id, CASE WHEN status <> 'comparing' OR pending > 0 THEN status WHEN aierrors > 0 THEN 'completedwitherrors' ELSE 'completed' END AS status, CASE WHEN status = 'comparing' AND pending = 0 THEN 'done' ELSE 'x' END AS phase,
  total::BIGINT AS totalcandidates, (total - pending)::BIGINT AS processedcandidates, CASE WHEN status = 'comparing' AND pending = 0 THEN 9 ELSE 0 END::BIGINT AS timefinished FROM j""",
        "q_comparable": f"WITH {_SCAN_ROWS} SELECT doc_id AS batch, doc_id % 500 AS scan FROM documents WHERE doc_id % 500 IN (SELECT id FROM sr WHERE status IN ('running', 'comparing'))",
        "q_greedy_unbound": f"{_PAIRS} SELECT category, a, b, 'active' AS result FROM ok",
        "q_pair_merge": _merge_sql(30, 5000),
        "q_pair_merge_tight": _merge_sql(5, 25),
        "q_scan_stats": _stats_sql(30, 5000),
        "q_scan_stats_tight": _stats_sql(5, 25),
        "q_changed": "SELECT doc_id AS entry, CASE WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 4 = 0 THEN 'changed' ELSE 'same' END AS change FROM documents",
        "q_stale": "SELECT doc_id AS entry FROM documents WHERE doc_id % 6 = 1 AND source IN (SELECT source FROM documents WHERE doc_id % 6 <> 1)",
        "q_invalidated": f"WITH {_HIST}, g AS (SELECT doc_id AS e FROM documents WHERE doc_id % 9 = 2) SELECT a, b, state FROM h WHERE state = 'ignored' OR (a NOT IN (SELECT e FROM g) AND b NOT IN (SELECT e FROM g))",
        "q_decisions": f"WITH {_HIST} SELECT a, b, CASE WHEN doc_id % 16 = 5 THEN 'ignored' WHEN doc_id % 8 = 5 THEN 'notduplicate' ELSE state END AS state, CASE WHEN doc_id % 8 = 5 THEN 30 ELSE 1 END::BIGINT AS timemodified FROM h",
        "q_batches": f"WITH {_HIST} SELECT category, a, b, ((row_number() OVER (PARTITION BY category ORDER BY a, b) - 1) // 3)::BIGINT AS batch FROM h WHERE state = 'candidate' AND scan = 1",
        "q_stale_pairs": f"WITH {_HIST}, s AS (SELECT doc_id, source FROM documents WHERE doc_id % 6 <> 1) SELECT h.category, a, b FROM h LEFT JOIN s x ON x.doc_id = a LEFT JOIN s y ON y.doc_id = b WHERE state = 'candidate' AND NOT coalesce(x.source = h.category AND y.source = h.category, false)",
        "q_verdict_parse": f"SELECT k::INT AS \"case\", c AS classification, p AS confidence, r AS reason, e AS evidence FROM (VALUES {_VERDICT_ROWS}, {', '.join(f'({k}, NULL, NULL, NULL, NULL)' for k in bad)}) AS t(k, c, p, r, e)",
        "q_verdict_stats": "SELECT source AS category, count(*) FILTER (doc_id % 8 <> 0) AS calls, count(*) FILTER (doc_id % 4 = 0) AS errors FROM documents GROUP BY source",
        "q_scan_progress": f"""WITH {_HIST}, c AS (SELECT count(*) AS total, count(*) FILTER (state = 'candidate') AS pending FROM h WHERE scan = 1 AND state NOT IN ('ignored', 'notduplicate'))
SELECT total, pending, total - pending AS processed, CASE WHEN pending = 0 THEN 100 ELSE floor((total - pending) / greatest(total, 1)::DOUBLE * 100) END::INT AS percent, CASE WHEN pending > 0 THEN 'comparing' ELSE 'completedwitherrors' END AS status, CASE WHEN pending > 0 THEN 'semantic' ELSE 'done' END AS phase FROM c""",
        "q_report_default": _report_sql(_DEFAULT),
        "q_report_all": _report_sql(_ALL),
        "q_report_page": f"WITH {_HIST}, r AS (SELECT h.* FROM h JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE scan = 1 AND {_ALL}) SELECT id FROM r ORDER BY confidence DESC NULLS LAST, score DESC NULLS LAST, id LIMIT 10 OFFSET 10",
        "q_report_count": f"WITH {_HIST} SELECT count(*) AS total FROM h WHERE scan = 1 AND {_DEFAULT}",
        "q_latest_scan": f"WITH {_SCANS} SELECT category, arg_max(status, id) AS status, max(id) AS id FROM s GROUP BY category",
        "q_active_scan": f"WITH {_SCANS} SELECT * FROM s WHERE category = '3' AND status IN ('queued', 'running', 'comparing') ORDER BY id LIMIT 1",
        "q_event_invalidation": f"WITH {_HIST}, g AS (SELECT DISTINCT user_id AS e FROM events WHERE event_type = 'purchase') SELECT a, b, state FROM h WHERE state = 'ignored' OR (a NOT IN (SELECT e FROM g) AND b NOT IN (SELECT e FROM g))",
    }
