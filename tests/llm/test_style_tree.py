"""The site style tree without any word lists, hard pages, and a plain version of the importances."""

import collections
import math
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinfold.llm import html

DATA = "/root/testdata/sf0.1/pages.parquet"
LISTS = ("NOISE_TAGS", "NOISE_ROLES", "PAGE_TAGS", "MAIN", "NAMES", "INNER_NAMES", "WRAPPERS")


def blank(monkeypatch):
    """No list tells main text from the rest; only head, whose end is parsed, stays."""
    for name in LISTS:
        monkeypatch.setattr(html, name, frozenset(["head"]) if name == "NOISE_TAGS" else frozenset())
    monkeypatch.setattr(html._Style, "known", {})


def known_of(spark, urls, pages):
    batch = html.count_styles(pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(pages, pa.string())], ["url", "html"]))
    counts = spark.createDataFrame(batch.to_pandas(), html.COUNTS)
    counts = counts.groupBy("host", "node", "kind", "value").agg({c: "sum" for c in ("n", "chars", "links")}).withColumnsRenamed({f"sum({c})": c for c in ("n", "chars", "links")})
    rows = {r["host"]: html._pairs(r) for r in html.known_nodes(counts).collect()}
    return counts, lambda url: html.Known(rows.get(html.host_of(url), {}), rows.get(html.ANY_HOST, {}))


def texts_of(spark, urls, pages):
    _, known = known_of(spark, urls, pages)
    return [html.main_text(html.Page(p or ""), known(u)) for u, p in zip(urls, pages)]


@pytest.mark.skipif(not __import__("os").path.exists(DATA), reason="no test data")
def test_entropies_alone_clean_the_given_pages(spark, monkeypatch):
    rows = pq.read_table(DATA).to_pylist()
    urls, pages = [r["url"] for r in rows], [r["html"] for r in rows]
    plain = [html.main_text(html.Page(p or "")) for p in pages]
    blank(monkeypatch)
    got = texts_of(spark, urls, pages)
    unknown = [html.main_text(html.Page(p or "")) for p in pages]
    assert sum(a != b for a, b in zip(got, unknown)) >= 0.99 * len(rows)  # all pages hold boilerplate
    assert sum(a == b for a, b in zip(got, plain)) >= 0.99 * len(rows)


def site(rng, k, body="div", extra=""):
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    links = "".join(f'<li><a href="/{words(1)}">{words(2)}</a></li>' for _ in range(rng.randint(3, 7)))
    paragraphs = [words(rng.randint(5, 90)) for _ in range(rng.randint(1, 9))]
    title = words(4)
    page = f'<div class="x-top"><ul>{links}</ul></div><div class="box">{words(rng.randint(4, 9))}</div><{body} class="k17">' + f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f'{extra}</{body}><div class="x-bottom">&copy; {words(6)}</div>'
    return page, "\n".join([title, *paragraphs])


@pytest.mark.parametrize("body", ["div", "article"])
def test_varying_boilerplate_without_telling_names(spark, body):
    """Menu, advert and footer say something else on each page, and nothing names them."""
    rng = random.Random(3)
    made = [site(rng, k, body, "<p>Read more tomorrow.</p>") for k in range(30)] + [site(rng, 0, body)]
    urls = ["http://one.example/p"] * 30 + ["http://two.example/"]
    got = texts_of(spark, urls, [p for p, _ in made])
    assert got == [f"{t}\nRead more tomorrow." for _, t in made[:30]] + [made[30][1]]  # the second host takes what all hosts tell


def test_branches_that_repeat_go_from_articles(spark):
    rng = random.Random(4)
    made = [site(rng, k, "article", '<div class="tip">Follow us today</div>') for k in range(12)]
    assert texts_of(spark, ["http://a.example/"] * 12, [p for p, _ in made]) == [t for _, t in made]


def test_a_host_of_equal_pages_teaches_nothing(spark):
    page = "<div><p>One two three</p></div><div>four</div>"
    assert texts_of(spark, ["http://a.example/"] * 9, [page] * 9) == ["One two three\nfour"] * 9


CASES = [
    ("<html><head><title>t</title><body><p>Hello world</p>", "Hello world"),
    ('<div class="layout has-sidebar"><article><p>x</p></article></div>', "x"),
    ('<article class="post no-comments"><p>x</p></article>', "x"),
    ('<div class="with-nav"><main>abc</main></div>', "abc"),
    ('<form id="aspnetForm"><div><p>Long text here for all</p></div></form>', "Long text here for all"),
    ('<article><p>x</p><p class="notice">legal body</p></article>', "x\nlegal body"),
    ("<body><h1>T</h1><div>side</div><article>" + "word " * 50 + "</article>", "T\n" + "word " * 49 + "word"),
    ("<head>Text <b>bold", "Text bold"), ("plain <", "plain <"), ("a &amp b<br>c", "a & b c"),
    ('<p>one <button>x</button>two</p><div hidden>no</div><nav>n</nav><p title="class=ad">y</p>', "one two\ny"),
    ("<table><tr><td>a<td>b<tr><td><p>c</p></table>d", "a\nb\nc\nd"),
    ("<article><p>x</p><div id=comments><p>" + "nice " * 30 + "</p></div></article><footer>f</footer>", "x"),
    ("", ""), (None, ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_single_pages(page, want):
    assert html.main_text(html.Page(page or "")) == want


@pytest.mark.parametrize("part,times", [("<div>", 60000), ("<b>", 90000), ("<x><div>", 40000), ('<a "', 120000), ("<a ", 200000), ("</b>", 100000), ("<!--", 100000), ("<ul><li>", 40000), ("<p><table>", 30000), ('<a x="', 90000), ("<b><table></b>", 30000)])
def test_time_is_linear(part, times):
    def took(n):
        began = time.process_time()
        page = html.Page(part * n + "<p>end")
        page.stats()
        html.main_text(page)
        return time.process_time() - began

    assert took(times) < 16 * took(times // 4) / 2 + 0.5 and took(times) < 4


def test_importances_equal_a_plain_version(spark):
    rng = random.Random(9)
    made = [site(rng, k, "div", "<p>Same line.</p>") for k in range(9)]
    urls = [f"http://{'ab'[k % 2]}.example/" for k in range(9)]
    counts, _ = known_of(spark, urls, [p for p, _ in made])
    got = {(r.host, r.node): (r.pages, r.importance) for r in html.node_importance(counts).collect()}
    seen = collections.defaultdict(lambda: ([], [], [], [], set()))
    for k, (u, (p, _)) in enumerate(zip(urls, made)):
        for node, parent, shape, text, chars, links in html.Page(p).stats():
            for host in (html.host_of(u), html.ANY_HOST):
                at = seen[host, html.signed(node)]
                at[0].append(shape), at[1].append(text), at[2].append(chars), at[3].append(links), at[4].add((k, html.signed(parent)))

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in collections.Counter(values).values()) / math.log(n) if n > 1 else 1.0

    want = {}
    for (host, node), (shapes, texts, chars, links, where) in seen.items():
        root, above = seen[host, 0], seen[host, next(iter(where))[1]]
        if len(where) >= html.MIN_SEEN:
            keep = 0.9 ** len(set(shapes))
            below = min(1, entropy(texts) / entropy(root[1])) * (1 - sum(links) / sum(chars)) * min(1, sum(chars) / sum(above[2]) / 0.25)
            want[host, node] = len(where), (1 - keep) * entropy(shapes) + keep * below
    assert set(got) == set(want) and len(want) > 10
    for key, (pages, importance) in want.items():
        assert got[key][0] == pages and abs(got[key][1] - importance) < 1e-9


def test_empty_table_and_clashing_columns(spark):
    rows = [(1, "http://a.example/", "<p>x</p>", "t", "h", "n"), (1, "http://a.example/", "<p>x</p>", "t", "h", "n"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, nodes string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract(df).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert html.extract(df.limit(0)).count() == 0
