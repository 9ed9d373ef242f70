"""Main text of web pages by wrapper induction.

``REFERENCES`` pages a host, not empty, the least ids of as many hash classes, are its reference trees. Every page of the host is
aligned with each by simple tree matching (equal roots; children matched in order so that the matched nodes are most).
Counted over all pages are, by reference node, how many pages have a match, and how many of these with the very same
text: nodes that keep their text are template, varying ones are slots of content. A page most of whose text is a
reference's is a copy of it and says nothing about the template, so it isn't counted. Counts are added up before they are
shuffled, so a host with a third of all pages sends no more rows than another.

A page's text is what stands in its content slots: blocks under ``article``, ``main`` or ``role=main``, else anywhere in
the page without template nodes; and always without elements that by tag, role, class or id are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or comments. What a page itself marks as its article is never
template, however often it repeats: introductions of a series and licence paragraphs stay.

Defined results: a null or empty page, or one without content, has an empty text; pages without url form a host of
their own; a host with one page, or whose other pages are copies of its references, has no template; repeated rows are
treated alike; null ids are extracted too, though never a reference; other columns are not looked at.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import sys
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import checkpointed, map_arrow

#: A matched node is template if it has the reference's text in at least this share of the other pages.
CONSTANT = 0.5
#: Pages that serve a host as references, and the share of equal text from which a page counts as a copy of one.
REFERENCES, COPY = 3, 0.8
#: Parts that a host's pages are spread over where they are joined with the references by a shuffle.
SALT = 64
#: References beyond so many bytes in all are joined by a shuffle instead of a broadcast.
BROADCAST = 16 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?][^>]*+|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+))>""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {t: re.compile(f"</{t}[\\s>/]", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object")}
_RAW_TO_END = frozenset("script style textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "body": {"html"}}
_DROPPED = frozenset("head nav aside footer form button select input textarea dialog menu script style noscript template iframe svg math object canvas audio video map datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_SURE_WORDS = (
    r"ad|ads|advert\w*|advertisement|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|footer|cookies?|consent|gdpr|notices?|notification|"
    r"popup|overlay|newsletter|subscri\w*|signup|login|shar(?:e|ing)\w*|comments?|commentlist|repl(?:y|ies)|disqus|respond|widgets?|toolbar|paginat\w*|pager"
)
#: Within an article only what surely names none of its text; elsewhere more.
_WORDS_INSIDE = re.compile(rf"(?:^|[\s_-])(?:{_SURE_WORDS})(?:$|[\s_-])")
_WORDS = re.compile(rf"(?:^|[\s_-])(?:{_SURE_WORDS}|nav\w*|side|foot|masthead|topbar|alert|modal|search|social|related|recommend\w*|discussion|copyright|legal|skip|hidden|tags|byline-ad)(?:$|[\s_-])")
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|head|top)(?:$|[\s_-])")


class Node:
    __slots__ = ("attrs", "depth", "kids", "open", "parts", "sig", "size", "tag")

    def __init__(self, tag: str, attrs: str, depth: int):
        self.tag, self.attrs, self.depth = tag, attrs, depth
        #: strings and nodes in order
        self.parts: list = []
        self.kids: list[Node] = []

    def finish(self) -> None:
        """Size and signature of the subtree's tags; children first."""
        self.size = 1 + sum(k.size for k in self.kids)
        self.sig = hash((self.tag, self.size, *(k.sig for k in self.kids)))


def parse(page: str) -> Node:
    """A tree of the page's elements under a root; unclosed and stray tags are borne."""
    root = Node("", "", 0)
    stack, made = [root], [root]
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "article", "body") and tag not in ("html", "body", "main", "article", "div", "section"):
                    break
            else:
                if tag == "br":
                    stack[-1].parts.append(" ")
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _SIBLINGS[tag]:
                    del stack[i:]
                    if tag != "tr":
                        break
                elif stack[i].tag in _SCOPE[tag]:
                    break
        node = Node(tag, m[3], len(stack))
        made.append(node)
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            if end is None:
                if tag in _RAW_TO_END:
                    break
                continue  # unclosed: taken for empty
            close = page.find(">", end.start())
            at = n if close < 0 else close + 1
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.append(node)
    for node in reversed(made):
        node.finish()
    return root


def own_text(node: Node) -> str:
    return " ".join(" ".join(p for p in node.parts if type(p) is str).split())


def preorder(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed(x.kids))
    return out


def _scores(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that can be matched of all of x with each prefix of y, in order; w: weights by class."""
    line = np.zeros(len(y) + 1, np.int64)
    for row in w[x][:, y] if len(x) * len(y) < 1 << 16 else (w[k, y] for k in x):
        line[1:] = np.maximum(line[1:], np.where(row > 0, line[:-1] + row, 0))
        np.maximum.accumulate(line, out=line)
    return line


def _paired(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Positions of a heaviest matching in order, in memory linear in the numbers of children."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if b == a or c == d:
            continue
        if b - a == 1:
            row = w[x[a], y[c:d]]
            if row.max() > 0:
                out.append((a, c + int(row.argmax())))
            continue
        mid = (a + b) // 2
        total = _scores(w, x[a:mid], y[c:d]) + _scores(w, x[mid:b][::-1], y[c:d][::-1])[::-1]
        cut = c + int(total.argmax())
        todo += [(a, mid, c, cut), (mid, b, cut, d)]
    return out


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of nodes of the two trees, equal tags, order and descent kept, as many as can be."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6 * max(max(x.depth for x in preorder(t)) for t in (a, b)) + 1000))
    #: by the two subtrees' signatures, as weights depend on nothing else
    memo: dict[tuple[int, int], int] = {}

    def weight(x: Node, y: Node) -> int:
        if x.tag != y.tag:
            return 0
        if x.sig == y.sig:
            return x.size
        if not x.kids or not y.kids:
            return 1
        key = (x.sig, y.sig)
        if key not in memo:
            ends, p, q = trimmed(x.kids, y.kids)
            if p and q:
                w, i, j = classed(p, q)
                total = int(_scores(w, i, j)[-1])
            else:
                total = 0
            memo[key] = 1 + total + sum(u.size for u, _ in ends)
        return memo[key]

    def trimmed(p: list[Node], q: list[Node]) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
        """Pairs of equal children at either end, and what lies between."""
        lo, pe, qe, ends = 0, len(p), len(q), []
        while lo < min(pe, qe) and p[lo].sig == q[lo].sig:
            ends.append((p[lo], q[lo]))
            lo += 1
        while pe > lo and qe > lo and p[pe - 1].sig == q[qe - 1].sig:
            pe, qe = pe - 1, qe - 1
            ends.append((p[pe], q[qe]))
        return ends, p[lo:pe], q[lo:qe]

    def classed(p: list[Node], q: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights between the distinct shapes of either side, and each child's shape."""
        us, vs = {x.sig: x for x in p}, {y.sig: y for y in q}
        ui, vi = {k: n for n, k in enumerate(us)}, {k: n for n, k in enumerate(vs)}
        w = np.array([[weight(x, y) for y in vs.values()] for x in us.values()], np.int64)
        return w, np.array([ui[x.sig] for x in p]), np.array([vi[y.sig] for y in q])

    out, todo = [], [(a, b)] if a.tag == b.tag else []
    while todo:
        x, y = todo.pop()
        if x.sig == y.sig:
            out.extend(zip(preorder(x), preorder(y)))
            continue
        out.append((x, y))
        if x.kids and y.kids:
            ends, p, q = trimmed(x.kids, y.kids)
            todo += ends
            if p and q:
                todo += [(p[i], q[j]) for i, j in _paired(*classed(p, q))]
    return out


def skeleton(page: str) -> str:
    """A page's tree with hashes of its texts, as a reference."""
    root = parse(page)
    return json.dumps([crc32(page.encode()), [[x.tag, x.depth, crc32(own_text(x).encode())] for x in preorder(root)]], separators=(",", ":"))


def rebuilt(reference: str) -> tuple[int, Node, list[int]]:
    """The reference's page hash, its tree (each node's ``open`` is its number) and the hashes of its texts."""
    page, rows = json.loads(reference)
    nodes: list[Node] = []
    path: list[Node] = []
    for number, (tag, depth, _) in enumerate(rows):
        node = Node(tag, "", depth)
        node.open = number
        del path[depth:]
        if path:
            path[-1].kids.append(node)
        path.append(node)
        nodes.append(node)
    for node in reversed(nodes):
        node.finish()
    return page, nodes[0], [r[2] for r in rows]


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip() else {}


def extract(root: Node, template: set[int]) -> str:
    """The text of the content slots; template: ids of nodes whose text is boilerplate."""

    def dropped(node: Node, inside: bool) -> bool:
        if node.tag in _DROPPED or node.tag == "header" and not inside:
            return True
        if not node.attrs.strip():
            return False
        a = _attributes(node.attrs)
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("role", "").lower() in _ROLES:
            return True
        if node.tag in ("html", "body"):
            return False
        names = f"{a.get('class', '')} {a.get('id', '')}".lower()
        return bool((_WORDS_INSIDE if inside else _WORDS).search(names)) or not inside and bool(_HEADER.search(names))

    # the outermost content elements, else the whole page
    roots, todo = [], [root]
    while todo:
        x = todo.pop()
        if x is not root and dropped(x, False):
            continue
        if x.tag in ("article", "main") or x.attrs and 'role="main"' in x.attrs:
            roots.append(x)
        else:
            todo.extend(reversed(x.kids))
    inside = bool(roots)
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = html_lib.unescape("".join(line)) if line else ""
        line.clear()
        if text := " ".join(text.split()):
            blocks.append(text)

    for top in roots or [root]:
        stack: list = [(top, iter(top.parts))]
        end_block()
        while stack:
            node, rest = stack[-1]
            for part in rest:
                if type(part) is str:
                    if inside or id(node) not in template:
                        line.append(part)
                elif part.tag in ("br", "wbr"):
                    line.append(" " if part.tag == "br" else "")
                elif not dropped(part, inside):
                    if part.tag in _BLOCK:
                        end_block()
                    stack.append((part, iter(part.parts)))
                    break
                elif part.tag in _BLOCK:
                    end_block()
            else:
                if node.tag in _BLOCK:
                    end_block()
                stack.pop()
        end_block()
    return "\n\n".join(blocks)


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def _joined(pages: DataFrame, small: DataFrame, size: int) -> DataFrame:
    """Pages with their host's row of a small table: broadcast if it is small enough, else spread, so that no host's pages
    come together in one task."""
    if size <= BROADCAST:
        return pages.join(F.broadcast(small), "host", "left")
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def induce(pages: DataFrame) -> tuple[DataFrame, int]:
    """host, references, templates (by reference the numbers of its constant nodes), and the table's size in bytes."""
    hosted = _with_host(pages)
    usable = hosted.where(F.col("page_id").isNotNull() & (F.length(F.trim("html")) > 0))
    # one of each of so many hash classes, so that a host's ids are added up and never come together
    ranked = usable.withColumn("class", F.pmod(F.xxhash64("page_id"), F.lit(REFERENCES)))
    first = checkpointed(ranked.groupBy("host", "class").agg(F.min("page_id").alias("page_id")).drop("class"))
    length = first.agg(F.coalesce(F.sum(F.length("host") + 80), F.lit(0))).first()[0]
    source = usable.select("host", "page_id", "html").join(F.broadcast(first) if length <= BROADCAST else first, ["host", "page_id"], "left_semi")

    def refer(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([skeleton(x) for x in batch.column(1).to_pylist()])], ["host", "reference"])

    made = map_arrow(source.select("host", "html"), "html", refer, "host string, reference string")
    references = checkpointed(made.groupBy("host").agg(F.slice(F.sort_array(F.collect_set("reference")), 1, REFERENCES).alias("references")))
    size = references.agg(F.coalesce(F.sum(F.aggregate("references", F.lit(0), lambda n, r: n + F.length(r)) + F.length("host")), F.lit(0))).first()[0]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        same: Counter = Counter()
        known: dict = {}
        for host, page, listed in zip(*(c.to_pylist() for c in batch.columns)):
            if not page or not listed:
                continue
            if host not in known:
                known[host] = [rebuilt(r) for r in listed]
            tree_of_page = parse(page)
            for k, (page_hash, tree, texts) in enumerate(known[host]):
                if crc32(page.encode()) == page_hash:
                    continue
                found = [(x.open, text, bool(text) and crc32(text.encode()) == texts[x.open]) for x, y in match(tree, tree_of_page) if (text := own_text(y)) or texts[x.open]]
                if sum(len(t) for _, t, equal in found if equal) >= COPY * sum(len(t) for _, t, _ in found):
                    continue
                for node, _, equal in found:
                    seen[host, k, node] += 1
                    same[host, k, node] += equal
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.string()), pa.array([x[1] for x in keys], pa.int32()), pa.array([x[2] for x in keys], pa.int32()), pa.array([seen[x] for x in keys], pa.int64()), pa.array([same[x] for x in keys], pa.int64())], ["host", "k", "node", "n", "same"])

    counted = map_arrow(_joined(hosted.select("host", "html"), references, size).select("host", "html", "references"), "html", count, "host string, k int, node int, n long, same long")
    constant = counted.groupBy("host", "k", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).where(F.col("same") >= F.greatest(F.lit(2.0), CONSTANT * F.col("n")))
    template = constant.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "node"))).alias("template"))
    return checkpointed(references.join(template, "host", "left")), size


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row."""
    wrappers, size = induce(pages)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, known = [], {}
        for page, host, listed, template in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            if not page:
                out.append("")
                continue
            root, boring = parse(page), set()
            if template:
                if host not in known:
                    known[host] = [(*rebuilt(r), {t["node"] for t in template if t["k"] == k}) for k, r in enumerate(listed)]
                for _, tree, texts, constant in known[host]:
                    if constant:
                        boring |= {id(y) for x, y in match(tree, root) if x.open in constant and crc32(own_text(y).encode()) == texts[x.open]}
            out.append(extract(root, boring))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    source = _joined(_with_host(pages), wrappers, 2 * size).select("page_id", "url", "html", "host", "references", "template")
    return map_arrow(source, "html", kernel, "page_id long, url string, text string")


def text_digest(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
