"""The queries without SQL run under the default limits: 120 items a bucket, 30 pairs an item, 5000 new pairs."""

import collections
import itertools

from kinfold.plans import queries as Q

N = 45


def test_buckets_of_over_forty_items_are_compared(spark, tmp_path):
    shared = "applecart bluebells cornfield dragonfly evergreen"
    texts = [f"{shared} {shared} " + " ".join(f"own{i}x{j}" for j in range(6)) for i in range(N)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = Q.q_greedy(spark, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in found} == set(itertools.combinations(range(N), 2))
    scanned = Q.q_scan(spark, str(tmp_path)).collect()
    each = collections.Counter(x for r in scanned for x in (r.a, r.b))
    assert set(each) == set(range(N)) and max(each.values()) == 30
    assert {r.state for r in scanned} == {"analysed"} and None not in {r.classification for r in scanned}
