"""Main-text extraction with site style trees.

The pages of one host are merged into a style tree. A style node is a block
element's path of tags with their class, id and role (digits in names count as
one); text that stands beside block elements is a node of its own. Over a
host's pages each node has

* presentation: the entropy of its sequences of child tags, scaled to 0..1, and
  the number l of different ones,
* content: the entropy of the text of its whole branch, scaled by the host's,
* links: the share of its text that is link text,
* mass: the share of its parent's text that it holds.

Its importance is (1 - g^l) * presentation + g^l * content * (1 - links) *
min(1, mass / FULL_MASS), g = 0.9. A node whose child sequence hardly varies
(presentation under VARIED) is layout, that is, made by a template; one that
varies is written by authors. A branch directly under layout goes if its
importance is under MIN_IMPORTANCE; a heading goes only if its text repeats.
Elsewhere a branch goes if it says the same on all pages, in the same shape.
Inside of article and main everything counts as written by authors.

What is known of a node needs MIN_SEEN pages of its host; other nodes take what
is known of the same path over all hosts. Where nothing is known, nothing goes,
but on a page with an article or main element what stands beside it and holds
little text (by the formula above, with the page's own mass).

HTML itself says that scripts, styles, nav, aside, dialogs, controls, hidden
elements and some roles are no main text, nor are page headers and footers, nor
forms (a form round most of the page is layout). Names tell what no entropy can
tell (varying adverts, reader comments): a branch of which a whole class or id
is in NAMES goes, if it holds no article or main and not most of the text.
Inside of an article only containers go so, by INNER_NAMES, however long they
are (reader comments may be longer than their article).

Blocks: text between the borders of block elements; references are decoded by
the rules of HTML5, white space in a block becomes one space, blocks are joined
by one newline. Parsing is linear in the page, however tags nest.

Edge cases: null or empty html gives an empty text; a null url belongs to the
host ''; repeated pages are kept, each with its own row, and a host of equal
pages only teaches nothing; unclosed and stray tags, comments and scripts
follow HTML5's recovery in what they hide; an omitted head end tag is implied.
Other columns than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Mapping
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import arrow_map, materialize

MIN_SEEN = 4
MIN_IMPORTANCE = 0.3
VARIED = 0.5
DAMPING = 0.9
#: A branch with this share of its parent's text has full mass.
FULL_MASS = 0.25
#: A node is known if it is on one page in so many; so at most KNOWN_SHARE * (nodes a page) nodes of a host are known.
KNOWN_SHARE = 1000
#: Up to so many known nodes (9 bytes each and the host) are broadcast; beyond, the pages are joined by host.
BROADCAST_NODES = 200_000
ANY_HOST = "*"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
HEAD = VOID | RAW | frozenset(["head"])
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NOISE_TAGS = frozenset("nav aside head select option button object svg dialog menu canvas audio video datalist map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: No main text outside of an article.
PAGE_TAGS = frozenset(["header", "footer"])
WRAPPERS = frozenset(["form"])
MAIN = frozenset(["article", "main"])
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe comment comments respond replies disqus share sharing social breadcrumb breadcrumbs related recommended widget pagination pager login signup search header footer masthead".split()
)
INNER_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo comments respond replies disqus share sharing newsletter subscribe breadcrumb breadcrumbs pagination pager".split())
CONTAINERS = frozenset("div section ul ol dl table aside footer details".split())
#: A start tag of the key ends an open element of these tags, unless one of the borders stands between.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
SCOPE = frozenset("table td th caption button object".split())
STRONG = frozenset("table td th caption button object div article main section".split())

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>|</[^a-zA-Z>][^>]*+>|</>""", re.S)
OPENS = re.compile(r"</?[a-zA-Z!?]")
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
READ = frozenset("class id role hidden aria-hidden".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)")

#: What the style of an element says.
HIDES, PAGE, WRAPS, NAMED, INNER, IS_MAIN = 1, 2, 4, 8, 16, 32
#: What is known of a style node: low importance, the same on all pages, made by a template, most of its parent's text.
LOW, REPEATED, LAYOUT, HEAVY = 1, 2, 4, 8
_MASK = 0xFFFFFFFFFFFFFFFF


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def _hash(parent: int, key: str) -> int:
    return xxhash.xxh3_64_intdigest(key, parent)


class _Style:
    """What an element's own tag and attributes say; the same for each page, so kept."""

    known: dict[tuple[str, str], tuple[str, int]] = {}

    @classmethod
    def of(cls, tag: str, attrs: str) -> tuple[str, int]:
        """Key and what the style says."""
        found = cls.known.get((tag, attrs))
        if found is None:
            key, names, hidden, role = tag, set(), False, ""
            for name, *values in ATTR.findall(attrs) if attrs.strip() else ():
                name, value = name.lower(), unescape("".join(values)).lower()
                if name not in READ:
                    continue
                if name in ("hidden", "aria-hidden"):
                    hidden |= name == "hidden" or value == "true"
                else:
                    key += f" {name}={' '.join(sorted(DIGITS.sub('#', value).split()))}"
                    if name == "role":
                        role = value.strip()
                    else:
                        names |= set(value.split())
            is_main = tag in MAIN or role in MAIN
            bits = HIDES * (tag in NOISE_TAGS or hidden or (role in NOISE_ROLES and tag not in WRAPPERS)) | PAGE * (tag in PAGE_TAGS) | WRAPS * (tag in WRAPPERS) | IS_MAIN * is_main
            if not is_main:
                bits |= NAMED * bool(names & NAMES) | INNER * (tag in CONTAINERS and bool(names & INNER_NAMES))
            found = key, bits
            if len(cls.known) < 10_000 and len(attrs) < 1000:
                cls.known[tag, attrs] = found
        return found


class Page:
    """Block elements in page order (tag, parent, style node, style, child tags), and pieces of text: block number, element, text, link?"""

    def __init__(self, html: str):
        self.tags: list[str] = [""]
        self.parents: list[int] = [0]
        self.nodes: list[int] = [0]
        self.styles: list[int] = [0]
        self.shapes: list[list[str]] = [[]]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self._parse(html)
        n = len(self.tags)
        self.chars, self.links = [0] * n, [0] * n
        for _, el, text, link in self.pieces:
            size = len(text.strip())
            self.chars[el] += size
            if link:
                self.links[el] += size
        self.own = self.chars.copy()
        self.has_main, self.has_blocks = [s & IS_MAIN > 0 for s in self.styles], [False] * n
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            self.chars[p] += self.chars[i]
            self.links[p] += self.links[i]
            self.has_blocks[p] = True
            if self.has_main[i]:
                self.has_main[p] = True

    def _parse(self, html: str) -> None:
        # Open elements: tag, block element, hidden?, in a link?
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        open_at: dict[str, list[int]] = defaultdict(list)
        scopes, strong = [0], [0]
        block, at, n, pieces = 0, 0, len(html), self.pieces
        # Behind the last > no tag ends, so nothing is searched there.
        limit = html.rfind(">") + 1

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                tag = stack.pop()[0]
                open_at[tag].pop()
                if scopes[-1] == len(stack):
                    scopes.pop()
                if strong[-1] == len(stack):
                    strong.pop()

        def text(part: str) -> None:
            if open_at["head"] and not part.isspace():
                pop_to(open_at["head"][-1])
            _, el, hidden, link = stack[-1]
            if not hidden:
                pieces.append((block, el, part, link))

        while at < n:
            found = TOKEN.search(html, at, limit) if at < limit else None
            if found is None:
                cut = OPENS.search(html, max(at, limit))
                rest = html[at : cut.start()] if cut else html[at:]
                if rest:
                    text(rest)
                break
            if found.start() > at:
                text(html[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                if tag in ("html", "body"):
                    continue
                places = open_at.get(tag)
                # Inline end tags do not reach out of a block container, nor any but containers out of a table cell.
                border = strong[-1] if tag not in BLOCK else scopes[-1] if tag not in SCOPE else 0
                if places and places[-1] >= border:
                    if tag in BLOCK:
                        block += 1
                    pop_to(places[-1])
                elif tag in ("article", "main", "div") and places:
                    block += 1
                    pop_to(places[-1])
                continue
            if open_at["head"] and tag not in HEAD:
                pop_to(open_at["head"][-1])
            if tag in ("html", "body"):
                continue
            _, el, hidden, link = stack[-1]
            if tag in VOID:
                if not hidden:
                    if tag == "br":
                        pieces.append((block, el, " ", link))
                    elif tag == "hr":
                        block += 1
                    self.shapes[el].append(tag)
                continue
            if tag in RAW:
                end = RAW_END[tag].search(html, at)
                at = end.end() if end else n
                continue
            if tag in ENDS:
                tags, borders = ENDS[tag]
                place = max((open_at[t][-1] for t in tags if open_at[t]), default=0)
                if place > max((open_at[t][-1] for t in borders if open_at[t]), default=0):
                    pop_to(place)
            is_block = tag in BLOCK
            if is_block:
                block += 1
                if open_at["p"] and open_at["p"][-1] > scopes[-1]:
                    pop_to(open_at["p"][-1])
            _, el, hidden, link = stack[-1]
            key, style = _Style.of(tag, found[3])
            if not is_block and found[3].rstrip().endswith("/"):
                continue
            if not hidden and style & HIDES:
                hidden = True
            if is_block and not hidden:
                self.shapes[el].append(tag)
                self.tags.append(tag)
                self.parents.append(el)
                self.nodes.append(_hash(self.nodes[el], key))
                self.styles.append(style)
                self.shapes.append([])
                el = len(self.tags) - 1
            if tag in SCOPE:
                scopes.append(len(stack))
            if tag in STRONG:
                strong.append(len(stack))
            open_at[tag].append(len(stack))
            stack.append((tag, el, hidden, link or tag == "a"))

    def runs(self):
        """Element, begin and end in `pieces` of the pieces of each block that has text."""
        at, pieces = 0, self.pieces
        while at < len(pieces):
            block, el = pieces[at][:2]
            end = at + 1
            while end < len(pieces) and pieces[end][0] == block and pieces[end][1] == el:
                end += 1
            yield el, at, end
            at = end

    def stats(self):
        """node, parent node, hash of the child tags, hash of the text, characters, link characters of each element, and of text beside elements."""
        n = len(self.tags)
        hashes, extra = [0] * n, []
        for el, a, b in self.runs():
            own = "".join([p[2] for p in self.pieces[a:b]]).strip()
            if own:
                h = xxhash.xxh3_64_intdigest(own)
                hashes[el] = (hashes[el] * 0x9E3779B97F4A7C15 + h) & _MASK
                if self.has_blocks[el]:
                    extra.append((_hash(self.nodes[el], "#text"), self.nodes[el], 0, h, len(own), sum(len(p[2].strip()) for p in self.pieces[a:b] if p[3])))
        for i in range(n - 1, 0, -1):
            if hashes[i]:
                p = self.parents[i]
                hashes[p] = (hashes[p] * 0x9E3779B97F4A7C15 + (hashes[i] ^ hashes[i] >> 29)) & _MASK
        return extra + [(self.nodes[i], self.nodes[self.parents[i]], _hash(1, " ".join(self.shapes[i])), hashes[i], self.chars[i], self.links[i]) for i in range(n) if self.chars[i]]


def main_text(page: Page, known: Mapping[int, int] | None = None) -> str:
    """The page's main text. known: what is known of style nodes."""
    known = {} if known is None else known
    n, total = len(page.tags), max(1, page.chars[0])
    least = FULL_MASS * MIN_IMPORTANCE * total
    alive, inside = [True] * n, [False] * n
    # What an element's children are part of: content, layout, or, where nothing is known, what stands beside the article.
    content, layout, beside = 0, 1, 2
    mode = [content] * n

    def mode_of(i: int) -> int:
        bits = known.get(page.nodes[i])
        if inside[i]:
            return content
        if bits is None:
            return beside if page.has_main[i] else content
        return layout if bits & LAYOUT else content

    def goes(node: int, under: int, chars: int, heading: bool = False) -> bool:
        bits = known.get(node)
        if under == beside and bits is None:
            return chars < least and not heading
        return bits is not None and bool(bits & REPEATED or (under == layout and bits & LOW and not heading))

    mode[0] = mode_of(0)
    for i in range(1, n):
        p, style = page.parents[i], page.styles[i]
        if not alive[p]:
            alive[i] = False
            continue
        inside[i] = inside[p] or style & IS_MAIN > 0
        mode[i] = mode_of(i)
        if page.has_main[i]:
            continue
        most = page.chars[i] * 2 > total
        if (style & PAGE and not inside[p]) or (style & WRAPS and not most):
            alive[i] = False
        elif style & INNER if inside[p] else style & NAMED and not (known[page.nodes[i]] & HEAVY if page.nodes[i] in known else most):
            alive[i] = False
        elif goes(page.nodes[i], mode[p], page.chars[i], page.tags[i] in HEADINGS):
            alive[i] = False
    out: list[str] = []
    now, parts = -1, []

    def flush() -> None:
        if parts:
            whole = SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if whole:
                out.append(whole)

    for el, a, b in page.runs():
        if page.pieces[a][0] != now:
            flush()
            now = page.pieces[a][0]
        if alive[el]:
            own = [p[2] for p in page.pieces[a:b]]
            if page.has_blocks[el] and not inside[el] and (known or mode[el] == beside) and goes(_hash(page.nodes[el], "#text"), mode[el], sum(len(x.strip()) for x in own)):
                continue
            parts.extend(own)
    flush()
    return "\n".join(out)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


COUNTS = "host string, node long, kind string, value long, n long, chars long, links long"


def count_styles(batch: pa.RecordBatch) -> pa.RecordBatch:
    """COUNTS of a batch of pages (url, html).

    kind p: child tags, n elements; c: text of the branch, n elements; s: the
    parent node, n pages, chars and links.
    """
    counts: Counter[tuple[str, int, str, int]] = Counter()
    chars: Counter[tuple[str, int, str, int]] = Counter()
    links: Counter[tuple[str, int, str, int]] = Counter()
    for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
        host, seen = host_of(url), set()
        for node, parent, shape, text, size, linked in Page(html or "").stats():
            counts[host, node, "p", shape] += 1
            counts[host, node, "c", text] += 1
            own = host, node, "s", parent
            seen.add(own)
            chars[own] += size
            links[own] += linked
        counts.update(seen)
    keys = list(counts)
    longs = lambda values: pa.array(values, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), longs([signed(k[1]) for k in keys]), pa.array([k[2] for k in keys], pa.string()), longs([signed(k[3]) for k in keys]), longs([counts[k] for k in keys]), longs([chars[k] for k in keys]), longs([links[k] for k in keys])],
        ["host", "node", "kind", "value", "n", "chars", "links"],
    )


def style_counts(pages: DataFrame) -> DataFrame:
    """host, node, kind, value, n, chars, links: the merged style trees."""
    rows = arrow_map(pages.select("url", "html"), count_styles, COUNTS)
    return rows.groupBy("host", "node", "kind", "value").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")])


def node_importance(counts: DataFrame) -> DataFrame:
    """host, node, pages, presentation, content, link_share, mass, importance of every known style node that has text.

    The host ANY_HOST stands for all hosts together.
    """
    counts = counts.unionByName(counts.groupBy("node", "kind", "value").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")]).withColumn("host", F.lit(ANY_HOST)))
    total, logs = F.sum("n"), F.sum(F.col("n") * F.log(F.col("n").cast("double")))
    each = counts.groupBy("host", "node", "kind").agg(
        total.alias("seen"), F.count(F.lit(1)).alias("kinds"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("value").alias("value"),
        F.when(total > 1, F.greatest(F.lit(0.0), (F.log(total.cast("double")) - logs / total) / F.log(total.cast("double")))).otherwise(1.0).alias("entropy"),
    )
    of = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col(name)))
    nodes = each.groupBy("host", "node").agg(
        of("s", "value").alias("parent"), of("s", "seen").alias("pages"), of("s", "chars").alias("chars"), of("s", "links").alias("links"),
        of("p", "kinds").alias("l"), of("p", "entropy").alias("presentation"), of("c", "entropy").alias("varies"),
    )
    nodes = materialize(nodes, "nodes")
    roots = nodes.where("node = 0").select("host", F.col("pages").alias("host_pages"), F.col("varies").alias("host_varies"))
    above = nodes.select("host", F.col("node").alias("parent"), F.col("chars").alias("parent_chars"))
    told = nodes.where(F.col("pages") >= MIN_SEEN).join(roots, "host").where((F.col("pages") * KNOWN_SHARE >= F.col("host_pages")) & (F.col("host_varies") > 0))
    told = told.join(above, ["host", "parent"]).withColumns({
        "content": F.least(F.lit(1.0), F.col("varies") / F.col("host_varies")), "link_share": F.col("links") / F.col("chars"), "mass": F.col("chars") / F.col("parent_chars"),
    })
    keep = F.pow(F.lit(DAMPING), F.col("l"))
    importance = (1 - keep) * F.col("presentation") + keep * F.col("content") * (1 - F.col("link_share")) * F.least(F.lit(1.0), F.col("mass") / FULL_MASS)
    return told.select("host", "node", "pages", "presentation", "content", "link_share", "mass", importance.alias("importance"), ((1 - keep) * F.col("presentation")).alias("shape"))


def known_nodes(counts: DataFrame) -> DataFrame:
    """host, nodes, bits: what is known of the style nodes of each host."""
    told = node_importance(counts)
    when = lambda test, bit: F.when(test, bit).otherwise(0)
    bits = (
        when(F.col("importance") < MIN_IMPORTANCE, LOW) + when((F.col("content") < MIN_IMPORTANCE) & (F.col("shape") < MIN_IMPORTANCE), REPEATED)
        + when(F.col("presentation") < VARIED, LAYOUT) + when(F.col("mass") >= 0.5, HEAVY)
    )
    both = F.collect_list(F.struct("node", bits.cast("int").alias("bits")))
    return told.groupBy("host").agg(both.alias("x")).select("host", F.col("x.node").alias("nodes"), F.col("x.bits").alias("bits"))


class Known(Mapping):
    """What is known of a host's nodes, else of all hosts'."""

    def __init__(self, own: dict[int, int], every: dict[int, int]):
        self.own, self.every = own, every

    def __getitem__(self, node: int) -> int:
        found = self.own.get(node)
        return self.every[node] if found is None else found

    def get(self, node: int, default=None):
        found = self.own.get(node)
        return self.every.get(node, default) if found is None else found

    def __contains__(self, node) -> bool:
        return node in self.own or node in self.every

    def __iter__(self):
        return iter({**self.every, **self.own})

    def __len__(self) -> int:
        return len(self.own) or len(self.every)


def _pairs(row) -> dict[int, int]:
    return {} if row is None or row["nodes"] is None else {x & _MASK: b for x, b in zip(row["nodes"], row["bits"])}


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", HOST.pattern, 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select("page_id", "url", "html")
    known = materialize(known_nodes(materialize(style_counts(pages), "style")), "known")
    # At most KNOWN_SHARE times the nodes of a page.
    every = _pairs(known.where(F.col("host") == ANY_HOST).first())
    own = known.where(F.col("host") != ANY_HOST)
    size = own.agg(F.coalesce(F.sum(F.size("nodes")), F.lit(0)), F.count(F.lit(1))).first()
    small = size[0] + size[1] <= BROADCAST_NODES
    if small:
        joined = pages.withColumns({"nodes": F.lit(None).cast("array<long>"), "bits": F.lit(None).cast("array<int>")})
    else:  # an equi-join whose large side AQE can split where a host is hot
        joined = pages.withColumn("host", _host()).join(own, "host", "left")
    hosts = {r["host"]: _pairs(r) for r in own.collect()} if small else {}
    shared = pages.sparkSession.sparkContext.broadcast((every, hosts))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        every, hosts = shared.value
        texts = []
        for url, html, nodes, bits in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "nodes", "bits"))):
            mine = hosts.get(host_of(url), {}) if small else _pairs({"nodes": nodes, "bits": bits})
            texts.append(main_text(Page(html or ""), Known(mine, every)))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(joined.select("page_id", "url", "html", "nodes", "bits"), run, "page_id long, url string, text string, n_chars long")
