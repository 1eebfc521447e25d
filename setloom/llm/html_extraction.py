"""Main text of web pages by wrapper induction: align pages of one host, keep what varies.

Pages become trees of block elements, whose leaves are blocks of text. Each page is aligned with the reference page of
its host (its least page_id) by simple tree matching: nodes match if their tags and classes do, child lists are
aligned by dynamic programming in order, and equal texts count for more. The wrapper of a host has two parts, both
learnt from all of its pages.

Where the content is: over the host's pages every container (of the reference, or a path of tags and classes that a page
has once) is given the text that varies in what is aligned with it. The region is the uppermost container with ``region_share`` of all of it that holds headings
or paragraphs of its own, or the lowest such container if none does; what stands outside of it is template. If that is
the body itself, the wrapper leaves the region open, and what the page marks as its article decides.

What is constant: a reference leaf that enough different pages are aligned with and that has the same text in
``constant_share`` of them is template. Leaves that no reference leaf is aligned with are merged over the pages by their
path: a text that ``constant_share`` of the different pages with such a leaf there have is template as well. Enough is
``min_votes``; where the region is open, on a host with few pages more than half of them, two at least. Pages with equal
content vote once, so an article that a host repeats stays content.

Tags, roles and names (navigation, headers, footers, asides, forms, adverts, notices, comments) break ties: containers
named so are no content wherever they stand, since hosts rotate their boilerplate, and don't count as varying text.
``named=False`` does without them and without marked articles.

Votes are summed before they are shuffled. References are broadcast up to ``broadcast_bytes`` in all; beyond that they
are joined by host and salt, so a host with a third of the pages is spread over ``salts`` tasks.

Defined cases: null or empty html has no text; a page without a host is aligned with the others without one; broken
markup is closed as browsers do in the cases that matter here (paragraphs, list items, cells), and elements nested deeper
than ``DEPTH`` are flattened as they do; a page of any length is aligned whole; repeated rows are pages of their own;
extra columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm._store import stash

#: Elements that make blocks, elements without text, what starts close, and names of what is no article.
BLOCKS = frozenset("html head body title div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside form fieldset blockquote pre figure figcaption address hr details summary dialog menu center".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}
CELLS = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}
OUTSIDE = frozenset("head title nav footer aside form fieldset dialog menu".split())
OUTSIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|foot|masthead|topbar|comments?|disqus|replies|respond|related|recommend\w*|share|sharing|social|pagination|pager|tags|toolbar|skip|login|search)(?:$|[\s_-])", re.I)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post-content|entry-content|story-body|main-content|post-body|article-body|content-body)(?:$|[\s_-])", re.I)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|math|iframe|select|button|object|video|audio|canvas|label)\b(?:[^'\">]|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that are a block of text themselves, whatever their names say, and those that carry prose.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption tr tbody thead tfoot html body main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre #text".split())
FRAME = frozenset("#root html body".split())
DEPTH = 512
#: Cells of a table of alignment that are held at once, and scores of pairs of subtrees.
CELLS_AT_ONCE, KNOWN_AT_ONCE = 4_000_000, 500_000
Memo = dict[tuple[bytes, bytes], int]


class Node:
    """A block element, or (``text`` set) a leaf."""

    __slots__ = ("tag", "key", "children", "outside", "article", "text", "leaf", "digest", "most", "path")

    def __init__(self, tag: str, key: str, outside: bool, article: bool, text: str | None = None):
        self.tag, self.key, self.outside, self.article, self.text = tag, key, outside, article, text
        self.children: list[Node] = []
        self.leaf, self.digest, self.most, self.path = -1, b"", 1, 0


def _child(parent: Node, tag: str, attributes: str, named: bool) -> Node:
    names: dict[str, str] = {}
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            names.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    label = f"{names.get('class', '')} {names.get('id', '')}".strip()
    role = names.get("role", "").lower()
    article = outside = False
    if named:
        article = parent.article or tag in ("article", "main") or role in ("main", "article") or names.get("itemprop", "").lower() == "articlebody" or bool(label and ARTICLE_NAMES.search(label))
        outside = parent.outside or tag in OUTSIDE or role in OUTSIDE_ROLES or (tag == "header" and not parent.article) or (tag not in TEXTS and bool(label and OUTSIDE_NAMES.search(label)))
    outside = outside or parent.outside or tag in ("head", "title") or "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()
    return Node(tag, f"{tag}.{names.get('class', '')}", outside, article and not outside)


def parse(source: str, named: bool = True) -> Node:
    """The tree of block elements of a page."""
    root = Node("#root", "#root", False, False)
    stack, held, at = [root], [], 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[-1]
                top.children.append(Node("#text", "#text", top.outside, top.article, text))

    for m in MARKUP.finditer(source):
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        tag = m[3] and m[3].lower()
        if not tag:
            continue
        if tag not in BLOCKS:
            if tag in ("br", "img"):
                held.append(" ")
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1].tag == "p" or (len(stack) > 1 and stack[-1].tag == tag and tag[0] == "h" and tag[1:].isdigit()):
            stack.pop()
        if tag in CLOSES:
            own, until = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in (own, CELLS.get(tag)):
                    del stack[i:]
                    break
        node = _child(stack[-1], tag, m[4], named)
        if len(stack) < DEPTH:
            stack[-1].children.append(node)
        else:  # too deep: what it holds is its parent's
            node.children = stack[-1].children
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
    held.append(source[at:])
    flush()
    return root


def folded(node: Node) -> Node:
    """The tree with elements that hold nothing but one text as leaves, with digests of subtrees and their scores with themselves."""
    if node.text is None:
        node.children = [folded(c) for c in node.children]
        if len(node.children) == 1 and node.children[0].tag == "#text":
            node.text = node.children[0].text
            node.children = []
    own = hashlib.blake2b(f"{node.key}\0{'' if node.text is None else node.text}\0{node.text is None}\0".encode("utf-8", "surrogatepass"), digest_size=16)
    for c in node.children:
        own.update(c.digest)
    node.digest = own.digest()
    node.most = 1 + (node.text is not None) + sum(c.most for c in node.children)
    return node


def leaves(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.text is not None:
            out.append(x)
        todo.extend(reversed(x.children))
    return out


def boxes(node: Node) -> list[Node]:
    """The nodes that aren't leaves."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.text is None:
            out.append(x)
            todo.extend(reversed(x.children))
    return out


def _middle(x: list[Node], y: list[Node]) -> tuple[int, int, int]:
    """How many children at the front and at the back are the same whole subtrees, and their score. No alignment does better than to pair these."""
    least = min(len(x), len(y))
    front = back = score = 0
    while front < least and x[front].digest == y[front].digest:
        score += x[front].most
        front += 1
    while back < least - front and x[-1 - back].digest == y[-1 - back].digest:
        score += x[-1 - back].most
        back += 1
    return front, back, score


def _weights(x: list[Node], y: list[Node], memo: Memo) -> Callable[[int], np.ndarray]:
    """The function that gives the scores of the i-th of ``x`` with all of ``y``."""
    keys: dict[str, list[int]] = {}
    texts: dict[tuple[str, str], list[int]] = {}
    for j, q in enumerate(y):
        keys.setdefault(q.key, []).append(j)
        if q.text is not None:
            texts.setdefault((q.key, q.text), []).append(j)

    def row(i: int) -> np.ndarray:
        p, out = x[i], np.zeros(len(y), np.int32)
        at = keys.get(p.key, [])
        if p.text is not None:
            out[at] = 1
            out[texts.get((p.key, p.text), [])] = 2
        else:
            for j in at:
                out[j] = _score(p, y[j], memo)
        return out

    return row


def _next(above: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = above.copy()
    np.maximum(out[1:], above[:-1] + weight, out=out[1:])
    return np.maximum.accumulate(out, out=out)


def _score(a: Node, b: Node, memo: Memo) -> int:
    """The size of the best matching of two trees, equal texts counted twice."""
    if a.key != b.key:
        return 0
    if a.digest == b.digest:
        return a.most
    if a.text is not None or b.text is not None:
        return 1
    at = (a.digest, b.digest)
    found = memo.get(at)
    if found is None:
        front, back, found = _middle(a.children, b.children)
        found += 1
        x, y = a.children[front : len(a.children) - back], b.children[front : len(b.children) - back]
        if x and y:
            weight, table = _weights(x, y, memo), np.zeros(len(y) + 1, np.int32)
            for i in range(len(x)):
                table = _next(table, weight(i))
            found += int(table[-1])
        if len(memo) >= KNOWN_AT_ONCE:
            memo.clear()
        memo[at] = found
    return found


def _aligned(x: list[Node], y: list[Node], memo: Memo) -> list[tuple[Node, Node]]:
    """The pairs of the best alignment of two child lists. Of a table beyond ``CELLS_AT_ONCE`` only every n-th row is kept, and the rows between are made again from the end on."""
    weight, width = _weights(x, y, memo), len(y) + 1
    step = len(x) if len(x) * width <= CELLS_AT_ONCE else max(1, math.isqrt(len(x)))
    marks, table = [], np.zeros(width, np.int32)
    for i in range(len(x)):
        if i % step == 0:
            marks.append(table)
            if i + step >= len(x):
                break
        table = _next(table, weight(i))
    pairs, j = [], len(y)
    for begin in range((len(marks) - 1) * step, -1, -step):
        rows = [marks.pop()]
        for i in range(begin, min(begin + step, len(x))):
            rows.append(_next(rows[-1], weight(i)))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x[begin + i], y[j]))
    return pairs


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]], memo: Memo | None = None, around: list[tuple[Node, Node]] | None = None) -> int:
    """Simple tree matching of two trees; ``pairs`` gets the leaves that are aligned, ``around`` the others."""
    memo, around = {} if memo is None else memo, [] if around is None else around
    if a.key == b.key:
        if a.text is not None and b.text is not None:
            pairs.append((a, b))
        elif a.digest == b.digest:
            pairs.extend(zip(leaves(a), leaves(b), strict=True))
            around.extend(zip(boxes(a), boxes(b), strict=True))
        elif a.text is None and b.text is None:
            around.append((a, b))
            x, y = a.children, b.children
            front, back, _ = _middle(x, y)
            inner = _aligned(x[front : len(x) - back], y[front : len(y) - back], memo) if front + back < min(len(x), len(y)) else []
            for p, q in [*zip(x[:front], y[:front], strict=True), *inner, *zip(x[len(x) - back :], y[len(y) - back :], strict=True)]:
                match(p, q, pairs, memo, around)
    return _score(a, b, memo)


def _short(*parts: str) -> int:
    """A 64-bit hash of texts."""
    own = hashlib.blake2b(digest_size=8)
    for part in parts:
        data = part.encode("utf-8", "surrogatepass")
        own.update(len(data).to_bytes(8, "little") + data)
    return int.from_bytes(own.digest(), "little", signed=True)


def placed(root: Node) -> Node:
    """The tree with a hash of the path from the root in every node."""
    todo = [root]
    while todo:
        x = todo.pop()
        for c in x.children:
            c.path = _short(str(x.path), c.key)
        todo.extend(x.children)
    return root


def _reference(source: str, named: bool) -> Node:
    root = folded(parse(source, named))
    for i, leaf in enumerate(leaves(root)):
        leaf.leaf = i
    for i, box in enumerate(boxes(root)):
        box.leaf = i
    return root


def _regions(root: Node, of: dict[int, int], varies: Callable[[Node], bool]) -> list[dict]:
    """The containers, by what they are aligned with, else by a path that the page has once: the leaves that they hold, their varying text, whether some of it is prose of their own, or they are the article that the page marks."""
    found: dict[int, dict | None] = {}
    count = 0

    def visit(node: Node, depth: int, marked: bool) -> int:
        nonlocal count
        if node.text is not None:
            count += 1
            return len(node.text) if varies(node) else 0
        first, chars = count, 0
        for c in node.children:
            chars += visit(c, depth + 1, marked or node.article)
        prose = (node.article and not marked) or any(c.text is not None and c.tag in PROSE and varies(c) for c in node.children)
        path = of.get(id(node), node.path)
        found[path] = None if path in found else {"path": path, "depth": depth, "frame": node.tag in FRAME, "chars": chars, "prose": prose, "first": first, "last": count}
        return chars

    visit(root, 0, False)
    return [x for x in found.values() if x and (x["chars"] or x["frame"])]


_REGION = pa.struct([("path", pa.int64()), ("depth", pa.int32()), ("frame", pa.bool_()), ("chars", pa.int64()), ("prose", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])
_BLOCK = pa.struct([("node", pa.int32()), ("same", pa.bool_()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("path", pa.int64()), ("text", pa.string())])


def _align(batches: Iterator[pa.RecordBatch], named: bool) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEPTH))  # trees are matched depth first
    known: dict[str, Node] = {}
    for batch in batches:
        for begin in range(0, len(batch), 512):
            part = batch.slice(begin, 512)
            out, votes, regions = [], [], []
            for page, source, host, first, least in zip(*(part[c].to_pylist() for c in ("page_id", "html", "host", "reference", "least")), strict=True):
                root = placed(folded(parse(source or "", named)))
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = _reference(first or "", named)
                pairs: list[tuple[Node, Node]] = []
                around: list[tuple[Node, Node]] = []
                match(known[host], root, pairs, around=around)
                at = {id(b): (a.leaf, a.text == b.text) for a, b in pairs}
                mine = leaves(root)
                marked = any(x.article for x in mine)
                out.append([{"node": at[id(x)][0] if id(x) in at else -1, "same": id(x) in at and at[id(x)][1], "outside": x.outside, "inside": not x.outside and (x.article or not marked), "path": 0 if id(x) in at else x.path, "text": x.text} for x in mine])
                votes.append(_short(*(x["text"] for x in out[-1] if x["inside"])))
                own = page == least  # the reference can't tell what varies from itself
                regions.append(_regions(root, {id(b): -1 - a.leaf for a, b in around}, lambda x, at=at, own=own: not x.outside and (own or id(x) not in at or not at[id(x)][1])))
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], part["host"], pa.array(votes, pa.int64()), pa.array(out, pa.list_(_BLOCK)), pa.array(regions, pa.list_(_REGION))], names=["page_id", "url", "host", "content", "blocks", "regions"])


def html_extraction(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_votes: int = 5, constant_share: float = 0.9, region_share: float = 0.75, broadcast_bytes: int = 32 << 20, salts: int = 64, named: bool = True) -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points), n_template (blocks left out by the wrapper: outside of the region, or constant)."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    least = pages.where("length(html) > 0").groupBy("host").agg(F.min("page_id").alias("page_id"))
    least = F.broadcast(least) if least.count() <= 100_000 else least
    first = pages.where("length(html) > 0").join(least, ["host", "page_id"]).groupBy("host").agg(F.min(F.struct(F.sha2("html", 256).alias("digest"), "html", "page_id")).alias("r")).select("host", F.col("r.html").alias("reference"), F.col("r.page_id").alias("least"))
    first = stash(first, "references")
    small = (first.agg(F.sum(F.octet_length("reference") + 100)).first()[0] or 0) <= broadcast_bytes
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    spread = lambda t: F.broadcast(t.withColumn("salt", F.lit(None).cast("int")).drop("salt")) if small else t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = ["host"] if small else ["host", "salt"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, content bigint, blocks array<struct<node:int,same:boolean,outside:boolean,inside:boolean,path:bigint,text:string>>, regions array<struct<path:bigint,depth:int,frame:boolean,chars:bigint,prose:boolean,first:int,last:int>>"
    aligned = stash(salted.join(spread(first), on, "left").select("page_id", "url", "html", "host", "reference", "least").mapInArrow(lambda it: _align(it, named), schema), "aligned")

    held = aligned.select("host", F.explode("regions").alias("r")).groupBy("host", "r.path", "r.depth", "r.frame").agg(F.sum("r.chars").alias("chars"), F.count("*").alias("times"), F.count_if("r.prose").alias("prose"))
    whole = held.where("depth = 0").select("host", F.col("chars").alias("all_chars"), F.col("times").alias("pages"))
    place = F.struct("depth", "frame", "path")
    wide = held.join(whole, "host").where((F.col("all_chars") > 0) & (F.col("chars") >= region_share * F.col("all_chars")) & (2 * F.col("times") > F.col("pages")))
    region = wide.groupBy("host").agg(F.coalesce(F.min(F.when(2 * F.col("prose") > F.col("times"), place)), F.max(place)).alias("r")).where("not r.frame").select("host", F.col("r.path").alias("region"))

    voted = aligned.select("host", "content", F.explode("blocks").alias("b"))
    hosts = aligned.where(F.size("blocks") > 0).groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages")).join(region, "host", "left")
    few = F.least(F.lit(min_votes), F.greatest(F.lit(2), F.floor(F.col("pages") / 2) + 1))
    hosts = hosts.select("host", F.when(F.col("region").isNull(), few).otherwise(F.lit(min_votes)).alias("enough"))
    constant = lambda t: t.join(hosts, "host").where((F.col("n") >= F.col("enough")) & (F.col("same") >= constant_share * F.col("n"))).groupBy("host")
    each = voted.where("b.node >= 0").groupBy("host", "b.node", "content").agg(F.max("b.same").alias("same"))
    slots = constant(each.groupBy("host", "node").agg(F.count("*").alias("n"), F.count_if("same").alias("same"))).agg(F.collect_set("node").alias("constant"))
    said = voted.where("b.node < 0 and b.inside").select("host", "b.path", F.xxhash64("b.path", "b.text").alias("said"), "content").distinct()
    pages_at = said.groupBy("host", "path", "content").agg(F.lit(1).alias("one")).groupBy("host", "path").agg(F.count("*").alias("n"))
    repeated = said.groupBy("host", "path", "said").agg(F.count("*").alias("same")).where("same > 1")
    merged = constant(repeated.join(pages_at, ["host", "path"])).agg(F.collect_set("said").alias("merged"))
    wrapper = stash(slots.join(merged, "host", "full").join(region, "host", "full"), "wrapper")
    back = aligned.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread(wrapper), on, "left")
    of_slots, of_merged = F.coalesce("constant", F.array().cast("array<int>")).alias("of_slots"), F.coalesce("merged", F.array().cast("array<bigint>")).alias("of_merged")
    placed_in = back.select("page_id", "url", "blocks", F.try_element_at(F.filter("regions", lambda r: r["path"] == F.col("region")), F.lit(1)).alias("own"), of_slots, of_merged)
    inside = F.filter("blocks", lambda b, i: F.when(F.col("own").isNotNull(), ~b["outside"] & (i >= F.col("own")["first"]) & (i < F.col("own")["last"])).otherwise(b["inside"]))
    kept = F.filter("inside", lambda b: ~(F.array_contains("of_slots", b["node"]) | ((b["node"] < 0) & F.array_contains("of_merged", F.xxhash64(b["path"], b["text"])))))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n")
    return placed_in.select("page_id", "url", F.size("blocks").alias("blocks"), inside.alias("inside"), "of_slots", "of_merged").select("page_id", "url", "blocks", kept.alias("kept")).select("page_id", "url", text.alias("text"), F.greatest(F.col("blocks") - F.size("kept"), F.lit(0)).alias("n_template")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return html_extraction(spark.read.parquet(f"{sf_dir}/pages.parquet"))
