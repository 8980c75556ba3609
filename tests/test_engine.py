"""Whole-scan behaviours: chains, thresholds, caps, decisions, invalidation, verdicts, report, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import greedy, pairs, report, verdicts, versions
from kinfold.plans import engine
from kinfold.plans.config import Config
from kinfold.sources.tables import Store

ITEM = "entry long, category string, qtype string, name string, questiontext string, generalfeedback string, answers array<struct<id:bigint,answer:string,fraction:double>>"


def items(spark, *rows):
    return spark.createDataFrame([(e, c, "short", "", text, "", [(1, a, 1.0)] if a else []) for e, c, text, a in rows], ITEM)


def scan(spark, root, rows, number, comparator=None, **config):
    return engine.run(spark, root, items(spark, *rows), number, 100 + number, Config(**config), comparator)


def states(done):
    return {(r.a, r.b): r.state for r in done.pairs.collect()}


#: Two that ask for one river in other words, and one on something else.
RIVERS = [(1, "c", "Name the longest river that flows through the Iberian lowlands into the Atlantic", "Tagus"), (2, "c", "Through the Iberian lowlands flows which longest river into the Atlantic? Name it", "Tagus"), (3, "c", "Describe how yeast makes dough rise", "gas")]
COPIES = "How many legs does a garden spider walk on?"


def test_config_clamps():
    c = Config(max_bucket=3, max_per_item=0, max_new_pairs=None, batch_size=1000)
    assert (c.bucket_limit, c.item_limit, c.budget, c.batch) == (10, 30, 5000, 100)


def test_exact_cluster_is_a_chain_only_when_oversized(spark, tmp_path):
    copies = [(10 * i, "c", COPIES, None) for i in range(17)]
    done = scan(spark, str(tmp_path), copies, 1, max_bucket=14)
    assert sorted(states(done)) == [(10 * i, 10 * i + 10) for i in range(16)]
    assert len(states(scan(spark, f"{tmp_path}/b", copies[:5], 1))) == 10


def test_decisions_reuse_invalidation_and_retry(spark, tmp_path):
    root = str(tmp_path)
    done = scan(spark, root, RIVERS, 1, verdicts.local_comparator)
    assert states(done) == {(1, 2): "analysed"}
    again = scan(spark, root, RIVERS, 2, verdicts.local_comparator)
    assert states(again) == {(1, 2): "analysed"} and again.stats.first().reused == 1
    store = Store(spark, root)
    said = lambda word: store.write("pair", pairs.decide(store.read("pair", pairs.SCHEMA), spark.createDataFrame([("c", 1, 2, word)], "category string, a long, b long, decision string"), 5))
    said("notduplicate")
    kept = scan(spark, root, RIVERS, 3)
    assert states(kept) == {(1, 2): "notduplicate"} and kept.pairs.first().lastscanid == 3 and kept.stats.first().suppressed == 1
    edited = [(1, "c", RIVERS[0][2] + " Name it.", "Mars"), *RIVERS[1:]]
    assert states(scan(spark, root, edited, 4)) == {(1, 2): "candidate"}
    said("ignored")
    ignored = scan(spark, root, RIVERS, 5)
    assert states(ignored) == {(1, 2): "ignored"} and ignored.pairs.first().lastscanid == 4
    with pytest.raises(ValueError):
        said("maybe")

    def broken(a, b):
        raise RuntimeError("no service")

    root = f"{tmp_path}/retry"
    failed = scan(spark, root, RIVERS, 1, broken)
    assert states(failed) == {(1, 2): "aierror"} and failed.pairs.first().aierror == "no service" and failed.calls.first()[1:] == (1, 1)
    assert states(scan(spark, root, RIVERS, 2, verdicts.local_comparator)) == {(1, 2): "analysed"}
    assert states(scan(spark, root, RIVERS[1:], 3)) == {}  # a stale entry takes its pairs along


def test_same_answer_lowers_the_threshold_and_empty_text_needs_answers(spark, tmp_path):
    rows = [(1, "c", "alpha beta gamma", "Oslo"), (2, "c", "delta epsilon", "oslo "), (3, "c", "", "oslo"), (4, "c", "", None), (5, "d", "alpha beta gamma", "Oslo")]
    assert set(states(scan(spark, str(tmp_path), rows, 1))) == {(1, 2), (1, 3), (2, 3)}


def fold(rows, cap, budget):
    """The sequential selection of one category: rows of (a, b, kind) in order."""
    counts, new, out = {}, 0, {}
    for a, b, kind in rows:
        if counts.get(a, 0) >= cap or counts.get(b, 0) >= cap:
            out[a, b] = "capped"
        elif kind == "still":
            out[a, b] = "still"
        elif kind == "new" and new >= budget:
            out[a, b] = "budget"
        else:
            out[a, b] = "active" if kind == "new" else "reused"
            new += kind == "new"
            for x in (a, b):
                counts[x] = counts.get(x, 0) + 1
    return out


def test_parallel_rounds_equal_the_sequential_fold(spark):
    rng = random.Random(5)
    for cap, budget in ((1, 4), (2, 7), (3, 1), (2, 1000)):
        cases, rows = {}, []
        for c in range(25):
            n = rng.randint(2, 12)
            every = [(a, b) for a in range(n) for b in range(a + 1, n)]
            rng.shuffle(every)
            cases[str(c)] = [(a, b, rng.choice(["new", "new", "reused", "still"])) for a, b in every]
            rows += [(str(c), a, b, k, kind) for k, (a, b, kind) in enumerate(cases[str(c)])]
        df = spark.createDataFrame(rows, "category string, a long, b long, position long, kind string")
        got = {(r.category, r.a, r.b): r.result for r in greedy.select_pairs(df, cap, budget).collect()}
        assert got == {(c, *ab): r for c, case in cases.items() for ab, r in fold(case, cap, budget).items()}


def test_latest_visible_takes_drafts_and_skips_hidden(spark):
    v = spark.createDataFrame([(1, 1, 1, "ready"), (2, 1, 2, "draft"), (3, 1, 3, "hidden"), (4, 2, 1, "hidden")], "versionid long, entry long, version int, status string")
    assert [(r.entry, r.versionid) for r in versions.latest_visible(v).collect()] == [(1, 2)]


@pytest.mark.parametrize(
    "raw,fine",
    [
        ('{"classification":"same_question","confidence":0.97,"reason":"r","evidence":["a","b"]}', True),
        ('{"classification":"unrelated","confidence":1,"reason":"r","evidence":{}}', True),
        ('{"classification":"unrelated","confidence":0,"confidence":1,"reason":"r","evidence":[]}', True),
        ('{"classification":"unrelated","confidence":NaN,"reason":"r","evidence":[]}', False),
        ('{"classification":["unrelated"],"confidence":1,"reason":"r","evidence":[]}', False),
        ("{", False), (None, False), ("[" * 100000, False),
    ],
)
def test_verdicts(raw, fine):
    assert (verdicts.parse_verdict(raw) is not None) == fine


def test_batches_and_stale_pairs_at_compare_time(spark, tmp_path):
    done = scan(spark, str(tmp_path), [(i, "c", COPIES, None) for i in range(15)], 1, max_bucket=13)
    numbered = pairs.batches(done.pairs, 1, 6)
    assert sorted(r.batch for r in numbered.collect()) == [0] * 6 + [1] * 6 + [2] * 2
    out = verdicts.compare(numbered, done.snapshots.where("entry <> 8"))
    assert verdicts.verdict_stats(out).first()[1:] == (12, 2)


def test_report_order_paging_and_errors(spark):
    rows = [(i, "c", i, i + 100, "analysed" if i % 3 else "aierror", "related_but_distinct" if i % 3 else None, 0.5 if i % 3 else None, "x", "bad") for i in range(60)]
    table = spark.createDataFrame(rows, "id long, category string, a long, b long, state string, classification string, confidence double, reason string, aierror string")
    table = table.withColumns({"confidence": F.col("confidence").cast("decimal(6,5)"), "heuristicscore": F.lit(0.5).cast("decimal(6,5)"), "lastscanid": F.lit(1)})
    snaps = spark.range(200).select(F.col("id").alias("entry"), F.lit("n").alias("name"), F.lit("t").alias("qtype"))
    assert report.report(table, snaps, 1).count() == 40
    rest = report.page(report.report(table, snaps, 1, True), 1).collect()
    assert len(rest) == 10 and all(r.failed and r.reason == "bad" and r.confidence_percent is None for r in rest)
    assert [r.id for r in report.page(report.report(table, snaps, 1, True), -4).limit(3).collect()] == [1, 2, 4]
    assert report.progress(table, 1).first().status == "completedwitherrors"


def test_change_stream_is_idempotent(spark, tmp_path):
    from kinfold.sources.state import drop_entries, read_pairs, read_snapshots
    from kinfold.streaming.invalidation import affected, invalidate_changes, invalidate_stream

    root = str(tmp_path)
    scan(spark, root, RIVERS, 1)
    store = Store(spark, root)
    spark.createDataFrame([(1,)], "entry long").write.parquet(f"{root}/events")
    stream = spark.readStream.schema("entry long").parquet(f"{root}/events")
    invalidate_stream(stream, store, f"{root}/check").awaitTermination()
    assert read_pairs(store).count() == 0 and read_snapshots(store).count() == 2 and store.version("pair") == 1
    drop_entries(store, spark.createDataFrame([(1,)], "entry long"))
    assert read_snapshots(store).count() == 2
    # A scan writes what it read and finds; what was dropped before it does not hold for it.
    assert states(scan(spark, root, RIVERS, 2)) == {(1, 2): "candidate"} and read_snapshots(store).count() == 3 and read_pairs(store).count() == 1
    spark.createDataFrame([("viewed", 12), ("deleted", 11), ("updated", 77)], "kind string, questionid long").write.parquet(f"{root}/changes")
    stream = spark.readStream.schema("kind string, questionid long").parquet(f"{root}/changes")
    links = [spark.createDataFrame(x, "questionid long, entry long") for x in ([(12, 3)], [(11, 2)])]
    invalidate_changes(stream, *links, store, f"{root}/check2").awaitTermination()
    assert sorted(r.entry for r in read_snapshots(store).collect()) == [1, 3] and read_pairs(store).count() == 0
    link = "questionid long, entry long"
    found = affected(spark.createDataFrame([(10,), (11,), (12,)], "questionid long"), spark.createDataFrame([(10, 1)], link), spark.createDataFrame([(11, 2)], link))
    assert sorted(r.entry for r in found.collect()) == [1, 2]


def test_scan_life_cycle(spark, tmp_path):
    root = str(tmp_path)
    rows = items(spark, *RIVERS, (9, "d", "Describe how yeast makes dough rise", "gas"))
    first = engine.queue_scan(spark, root, "c", 5)
    assert engine.queue_scan(spark, root, "c", 6) == first  # none is queued beside one in flight
    other = engine.queue_scan(spark, root, "d", 6)
    assert other != first
    table = lambda: {r.id: r for r in Store(spark, root).read("scan", engine.SCAN).collect()}
    assert table()[first].status == "queued"
    done = engine.run_queued(spark, root, first, rows, 7)
    assert states(done) == {(1, 2): "analysed"}
    r = table()[first]
    assert (r.status, r.phase, r.totalquestions, r.processedquestions, r.totalcandidates, r.processedcandidates, r.aicalls, r.aierrors) == ("completed", "done", 3, 3, 1, 1, 1, 0)
    assert (r.timecreated, r.timestarted, r.timefinished) == (5, 7, 7) and table()[other].status == "queued"
    assert engine.run_queued(spark, root, first, rows, 8) is None  # it has ended

    def broken(a, b):
        raise RuntimeError("no service")

    again = engine.queue_scan(spark, root, "c", 9)
    assert again not in (first, other)
    store = Store(spark, root)
    store.write("pair", store.read("pair", pairs.SCHEMA).limit(0))
    engine.run_queued(spark, root, again, rows, 9, comparator=broken)
    assert (table()[again].status, table()[again].aierrors) == ("completedwitherrors", 1)
    bad = engine.queue_scan(spark, root, "c", 10)
    with pytest.raises(Exception):
        engine.run_queued(spark, root, bad, rows.drop("questiontext"), 10)
    r = table()[bad]
    assert (r.status, r.phase, r.timefinished) == ("failed", "failed", 10) and r.message
    assert len(Store(spark, root).versions("scan")) <= Store.KEPT


def test_small_tables_are_spread_and_large_ones_left(spark, monkeypatch):
    from kinfold.sources import staging

    df = staging.stage(spark.range(1000).coalesce(1), "small")
    assert 0 < staging.planned_bytes(df) < 100_000
    assert "RoundRobin" in staging.spread(df)._jdf.queryExecution().toString()
    monkeypatch.setattr(staging, "SPREAD_BYTES", 10)
    assert staging.spread(df) is df
    staging.release(df)
    with pytest.raises(Exception):
        df.count()


def test_only_texts_of_pairs_move_and_a_first_scan_writes_texts_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(engine, "stage", lambda df, name, f=engine.stage: written.append(name) or f(df, name))
    none = lambda schema: spark.createDataFrame([], schema)
    done = engine.prepare(items(spark, *RIVERS), none(engine.SNAPSHOT), none(pairs.SCHEMA), 1, 5)
    assert written.count("snapshots") == 1
    assert sorted((r.entry, r.lastscanid, r.timecreated, r.timemodified) for r in done.snapshots.collect()) == [(e, 1, 5, 5) for e in (1, 2, 3)]
    assert done.snapshots.columns == [c.split()[0] for c in engine.SNAPSHOT.split(", ")]
    plan = verdicts.compare(pairs.batches(done.pairs, 1, 6), done.snapshots)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2
