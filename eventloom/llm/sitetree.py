"""Main text of pages by a site style tree (operator 11).

The pages of a host are merged into one tree.  Its nodes are places in a page (the tags, classes and ids
from the body down); a node has the styles it comes in (the kinds of its children) and the texts it
holds.  Importance is entropy over the host's pages: a place is important in its presentation if its
styles vary, and in its content if its texts are spread over few pages,
    presentation = -sum p_i log_m p_i,   content = 1 - mean over texts of log_m (pages with the text),
for m pages.  A branch's importance is (1 - g^l) presentation + g^l mean content below it, l its number
of styles.  Branches of little importance go from every page of the host.

What a place is named is evidence of its own, and all there is on a host of few pages: names of menus,
adverts, comments and the like mark a branch as noise, article and main mark the text that stays; in a
page with such a landmark only that counts.  Statistics decide about all else: every branch of a page
without a landmark, and those inside one that carry a class, an id or a role.

Pages are parsed once, each by itself; statistics are distinct narrow rows (host, node, text hash, page)
combined by aggregation, so a host may hold any share of the pages.  Texts cross the network only for pages
that statistics have to decide about.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialize
from .urls import host_of

#: Pages with different titles that a place needs before statistics count.
MIN_PAGES = 5
#: A branch of less importance goes.
MIN_IMPORTANCE = 0.3
#: What a step up the tree keeps of the importance below.
GAMMA = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object select".split())
#: Elements nested deeper count as part of the one at this depth; their text stays.
MAX_DEPTH = 256
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Open elements that a tag of the same group closes, up to one of the second group.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}
NOISE_TAGS = frozenset("nav footer aside form button dialog".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer "
    "cookie cookies notice notices consent gdpr popup modal overlay alert newsletter subscribe subscription signup login search share sharing social related recommended "
    "comment comments disqus reply replies respond widget widgets toolbar pagination pager masthead hidden complementary contentinfo dialog form skip".split()
)
HEAD_NAMES = frozenset(["header"])
#: Before a noise name these words say that a wrapper has, or hasn't, such a part beside its content.
BESIDE = frozenset("has no with without show hide is".split())
LANDMARK_TAGS = frozenset(["article", "main"])
#: Their ids are anchors.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD_BREAK = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


def _key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Node:
    """An open element.  noise: it or one around it is named so; cut: inline noise within a block; landmark: it is
    one or lies in one; marked: inside a landmark, with a presentation of its own; holds: a landmark lies in it."""

    __slots__ = ("tag", "label", "parent", "key", "noise", "cut", "landmark", "marked", "children", "holds")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.parent = tag, parent
        named = " ".join(attributes.get(a, "") for a in (("class", "role") if tag in HEADINGS else ("id", "class", "role")))
        self.label = f"{tag} {' '.join(sorted(re.sub(r'[0-9]+', '0', named).split()))}".strip()
        words = [[w.lower() for w in WORD_BREAK.split(n) if w] for n in named.split()]
        noisy = any(w in NOISE_NAMES and not (k and ws[k - 1] in BESIDE) for ws in words for k, w in enumerate(ws))
        heads = tag == "header" or any(w in HEAD_NAMES for ws in words for w in ws)
        unseen = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        inside = parent is not None and (parent.landmark or parent.noise)
        self.noise = bool(parent and parent.noise) or unseen or tag in NOISE_TAGS or noisy or (heads and not inside)
        self.cut = tag in INLINE and parent is not None and (parent.cut or self.noise and not parent.noise)
        own = not self.noise and (tag in LANDMARK_TAGS or "main" in attributes.get("role", "").split() or "articlebody" in attributes.get("itemprop", "").lower().split())
        self.landmark = own or bool(parent and parent.landmark)
        self.marked = not own and bool(parent) and (parent.marked or parent.landmark and bool(named.strip()))
        self.holds = own
        self.children: list[str] = []
        self.key = _key(f"{parent.key if parent else ''}/{self.label}")
        if own:
            up = parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(raw)} if raw else {}


def parse(html: str) -> tuple[list[tuple[Node, str]], str]:
    """(blocks in page order: (node, text), title) of a page; text has its white space turned into single spaces."""
    root = Node("body", {}, None)
    stack = [root]
    blocks: list[tuple[Node, str]] = []
    pending: list[str] = []
    unclosed: set[str] = set()
    title, at, end = "", 0, len(html)

    def flush():
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            pending.clear()
            if text:
                blocks.append((next(n for n in reversed(stack) if n.tag not in INLINE), text))

    def skip(tag: str) -> int:
        """Where the content of an element that is passed over ends; without an end tag only scripts and styles run on."""
        stop = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
        if stop is None:
            unclosed.add(tag)
        return stop.end() if stop else end if tag in ("script", "style") else at

    def close(k: int):
        """Closes the element at place k of the stack and all in it."""
        if any(n.tag not in INLINE for n in stack[k:]):
            flush()
        del stack[k:]

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            pending.append(" " if stack[-1].cut else html[at:])
            break
        if m.start() > at:
            pending.append(" " if stack[-1].cut else html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        slash, raw = (m[1], m[3]) if m[2] else (m[4], m[6])
        if slash:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k and not (tag in INLINE and any(n.tag not in INLINE for n in stack[k:])):
                close(k)
            elif tag not in INLINE and tag != "body" and tag != "html":
                flush()
            continue
        if tag == "title" and not title:
            stop = re.compile(r"</title\s*>", re.I).search(html, at)
            title = " ".join(unescape(html[at : stop.start() if stop else end]).split())
            at = stop.end() if stop else end
            continue
        if tag == "head" or tag == "html" or tag == "body":
            continue
        if tag in RAW:
            at = skip(tag)
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            p = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"), 0)
            if p and not any(n.tag in ("table", "button") for n in stack[p:]):
                close(p)
            if tag in CLOSES:
                own, limit = (set(x.split()) for x in CLOSES[tag])
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in limit:
                        break
                    if stack[k].tag in own:
                        close(k)
                        break
        if len(stack) >= MAX_DEPTH:
            continue
        node = Node(tag, _attributes(raw), stack[-1])
        if tag not in INLINE:
            parent = next(n for n in reversed(stack) if n.tag not in INLINE)
            if not parent.children or parent.children[-1] != node.label:
                parent.children.append(node.label)
        if not raw.endswith("/") or tag in INLINE:
            stack.append(node)
    flush()
    return blocks, title


def page_nodes(html: str) -> dict:
    """What a page gives: texts that may stay, with the key of their place and whether statistics decide about
    them; (place, feature, is style) rows; chains of places from the body to each text's."""
    blocks, title = parse(html)
    has_landmark = any(node.landmark for node, _ in blocks)
    texts, places, open_ = [], [], []
    rows: set[tuple[int, int, bool]] = set()
    chains: dict[int, list[int]] = {}
    nodes: dict[int, Node] = {}
    for node, text in blocks:
        rows |= {(node.key, 0, False), (node.key, _key(text), False)}
        if not node.noise and (node.landmark or not has_landmark):
            texts.append(text)
            places.append(node.key)
            open_.append(node.marked or not node.landmark)
        if id(node) not in nodes:
            up, n = [], node
            while n is not None:
                up.append(n.key)
                nodes[id(n)] = n
                n = n.parent
            chains[node.key] = up[::-1]
    for node in nodes.values():
        rows |= {(node.key, 0, True), (node.key, _key("\n".join(node.children)), True)}
    held = sorted({n.key for n in nodes.values() if n.holds})
    own = sorted(rows)
    return {
        "unit": _key(title) if title else _key(html), "texts": texts, "places": places, "open": open_, "nodes": [r[0] for r in own], "features": [r[1] for r in own],
        "styles": [r[2] for r in own], "chains": list(chains.values()), "held": held,
    }


def parsed_pages(pages: DataFrame) -> DataFrame:
    """The pages' blocks and places, written; one row for each page, named by row."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    kind = own.schema["page_id"].dataType.simpleString()
    lists = {"texts": pa.list_(pa.string()), "places": pa.list_(pa.int64()), "open": pa.list_(pa.bool_()), "nodes": pa.list_(pa.int64()), "features": pa.list_(pa.int64())}
    lists |= {"styles": pa.list_(pa.bool_()), "chains": pa.list_(pa.list_(pa.int64())), "held": pa.list_(pa.int64())}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_nodes(h or "") for h in batch.column("html").to_pylist()]
            arrays = [batch.column(c) for c in ("page_id", "url", "host")] + [pa.array([p["unit"] for p in found], pa.int64())]
            arrays += [pa.array([p[c] for p in found], t) for c, t in lists.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "unit", *lists])

    schema = f"page_id {kind}, url string, host string, unit long, texts array<string>, places array<long>, open array<boolean>, nodes array<long>, features array<long>, styles array<boolean>, chains array<array<long>>, held array<long>"
    return materialize(in_batches(own, emit, schema).withColumn("row", F.monotonically_increasing_id()), "parsed", compression="zstd")


def site_tree(parsed: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content, importance) of every place of the hosts' merged trees.

    Pages of one host with one title are copies of a page and count once.  A place on a single page has
    importance 1."""
    sites = parsed.where("host != ''")
    each = sites.select("host", "unit", F.explode(F.arrays_zip("nodes", "features", "styles")).alias("x"))
    each = each.select("host", "unit", F.col("x.nodes").alias("node"), F.col("x.features").alias("feature"), F.col("x.styles").alias("style")).distinct()
    counts = each.groupBy("host", "node", "style", "feature").agg(F.count("*").alias("k"))
    real, k = F.col("feature") != 0, F.col("k")
    places = counts.groupBy("host", "node").agg(
        F.max(F.when(~real & F.col("style"), k)).alias("pages"), F.max(F.when(~real & ~F.col("style"), k)).alias("held"),
        F.sum(F.when(real & ~F.col("style"), F.log(k))).alias("logs"), F.count_if(real & ~F.col("style")).alias("texts"),
        F.sum(F.when(real & F.col("style"), k)).alias("shown"), F.sum(F.when(real & F.col("style"), k * F.log(k))).alias("shown_logs"), F.count_if(real & F.col("style")).alias("l"),
    )
    content = F.when(F.col("texts") == 0, None).when(F.col("held") <= 1, 1.0).otherwise(1.0 - F.col("logs") / F.col("texts") / F.log("held"))
    shape = F.when(F.col("pages") <= 1, 1.0).otherwise((F.log("shown") - F.col("shown_logs") / F.col("shown")) / F.log("pages"))
    places = places.select("host", "node", "pages", "l", shape.alias("presentation"), content.alias("content"))
    chains = sites.select("host", F.explode("chains").alias("chain")).distinct()
    below = chains.select("host", F.element_at("chain", -1).alias("leaf"), F.explode("chain").alias("node"))
    leaves = places.where("content IS NOT NULL").select("host", F.col("node").alias("leaf"), F.col("content").alias("leaf_content"))
    under = below.join(leaves, ["host", "leaf"]).groupBy("host", "node").agg(F.avg("leaf_content").alias("under"))
    weight = F.pow(F.lit(GAMMA), F.col("l"))
    # a place without children has its content alone
    importance = F.when(F.col("presentation").isNull() | (F.col("l") <= 1) & (F.col("under") == F.col("content")), F.col("under"))
    importance = importance.otherwise((1 - weight) * F.col("presentation") + weight * F.col("under"))
    return places.join(under, ["host", "node"]).select("host", "node", "pages", "presentation", "content", importance.alias("importance"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """(page_id, url, text) of every page: its main text, blocks joined by an empty line.

    pages: page_id, url, html.  Character references are decoded and white space within a block becomes one
    space.  A null or empty html, or one without text, gives an empty text; a page whose branches would all
    go keeps what isn't named as noise.  Pages without a host take part in no statistics.  Repeated pages
    give a row each; further columns are ignored.
    """
    parsed = parsed_pages(pages)
    tree = site_tree(parsed)
    held = parsed.where("host != ''").select("host", F.explode("held").alias("node")).distinct()
    low = tree.where((F.col("pages") >= min_pages) & (F.col("importance") < min_importance)).select("host", "node").join(held, ["host", "node"], "left_anti")
    chains = parsed.where("host != ''").select("host", F.explode("chains").alias("chain")).distinct()
    gone = chains.select("host", F.element_at("chain", -1).alias("place"), F.explode("chain").alias("node")).join(low, ["host", "node"], "left_semi").select("host", "place").distinct()
    # only pages with places that statistics decide about are joined with the decisions
    asked = parsed.where("exists(open, x -> x)").select("row", "page_id", "url", "host", "texts", "places", "open")
    doubted = F.array_distinct(F.transform(F.filter(F.arrays_zip("places", "open"), lambda b: b.open), lambda b: b.places))
    cuts = asked.select("row", "host", F.explode(doubted).alias("place")).join(gone, ["host", "place"]).groupBy("row").agg(F.collect_set("place").alias("cut"))
    stays = F.filter(F.arrays_zip("texts", "places", "open"), lambda b: ~(b.open & F.array_contains(F.coalesce("cut", F.array().cast("array<bigint>")), b.places)))
    kept = F.transform(stays, lambda b: b.texts)
    judged = asked.join(cuts, "row", "left").select("page_id", "url", F.when(F.size(kept) > 0, kept).otherwise(F.col("texts")).alias("texts"))
    settled = parsed.where("NOT exists(open, x -> x)").select("page_id", "url", "texts")
    return settled.unionByName(judged).select("page_id", "url", F.array_join("texts", "\n\n").alias("text"))
