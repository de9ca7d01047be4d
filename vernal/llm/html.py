"""Main text of web pages by composite text density.

A page becomes a small tree (own tokenizer: implied ends of paragraphs, list items and cells, raw text
elements, unclosed and stray tags). For each node, with C characters, T tags, LC characters in links and LT
links below it (Cb, LCb: of the body; all but Cb and LCb 1 at least),

    density = C/T * log(1 + C/LC * T/LT) / log(ln(C/(C-LC) * LC + LCb/Cb * C + e))

which is high for long texts with few tags and few links (the 1 keeps texts of a few characters above 0). A node's
density sum is the sum of its children's densities; text right in a node counts like a child that holds it. The node
with the greatest sum is the main one, and the least density on the path from it to the body is the threshold. All of
the main node is taken. Beside the path, an element is taken if its density reaches the threshold, if it is built like
the path's own child or like one that reaches it (same name and class, children of the same names), if it lies
between such ones, or if it is a heading right before them; text beside the path is taken too; what is links for the
most part is not. Where the body itself is the main node and none of its elements reaches the threshold, the one with
the greatest sum stands for those that do. A semantic container (article, or else main) on the path bounds the article: all in it is taken,
nothing beside it.

Elements and roles that hold no article text (navigation, headers, footers, asides, forms, scripts, hidden ones),
and reader comments by class words, are pruned before. Adverts, notices, sharing boxes and the like, known by class
words alone, are counted but can't hold the main node unless most of the text is in them, and are pruned after it is
found. A class name marks such an element only if all its words are of that kind or mere qualifiers ("ad-box", not
"notice-of-motion"), and no other class name of the element says that it is content ("post").

Blocks are joined in page order by one newline; white space inside a block (including br) is one space;
character references are decoded. Defined cases: a null or empty page gives the empty text, as does one
without text; a page without markup is one block; of equal sums the first node in page order counts; repeated rows
are extracted alike; an empty table gives no rows; columns named like those added come back as name_in; pages of any
length are parsed whole, in time that grows with their length, without recursion.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.llm.common import Hidden, appended

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("script style xmp iframe noembed noframes textarea title noscript head nav header footer aside form button select option input svg canvas object embed audio video template dialog menu math".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
#: Words of class and id that mark what is not the article.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond replies disqus pagination pager toolbar widget tags copyright skip".split())
COMMENTS = frozenset("comment comments respond replies disqus".split())
#: Words that may stand beside those in one class name, and words that mark content.
QUALIFIERS = frozenset("accept area bar block bottom box button buttons col column container content fixed form global group header icon icons inner item items left link links list local message module outer page panel post posts primary reader right secondary section site slot sticky story stories text thread title to top unit user wrap wrapper zone".split())
CONTENT = frozenset("article body content entry hentry main page post story text".split())
# What an opening tag closes, and what it doesn't look beyond.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
CLOSES = {k: (("p", *v.split()), tuple(stop.split())) for k, (v, stop) in CLOSES.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)?\s*(?:(=)\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("chars", "children", "density", "kind", "label", "link_chars", "links", "name", "parent", "tags", "total")

    def __init__(self, name: str, parent: Node | None, kind: str, label: str = "") -> None:
        self.name, self.parent, self.kind, self.label, self.children = name, parent, kind, label, []


def _class_kind(value: str) -> str:
    """comments, soft (noise by class words), content, or empty."""
    found = ""
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name) if not w.isdigit()}
        if words & NOISE and words <= NOISE | QUALIFIERS:
            found = "comments" if words & COMMENTS or found == "comments" else "soft"
        elif words and words <= CONTENT:
            return "content"
    return found


def _kind(name: str, attributes: list[tuple[str, str]]) -> str:
    """noise, comments, soft, or empty."""
    if name in SKIP:
        return "noise"
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    kinds = set()
    for key, value in attributes:
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            return "noise"
        if key == "role" and value.lower() in ROLES:
            return "noise"
        if key in ("class", "id"):
            kinds.add(_class_kind(value))
    return "" if "content" in kinds else "comments" if "comments" in kinds else "soft" if "soft" in kinds else ""


class _Scanner:
    """Goes through a page once, forwards."""

    def __init__(self, page: str) -> None:
        self.page, self.at = page, 0
        self.last = {'"': page.rfind('"'), "'": page.rfind("'")}

    def past(self, mark: str, at: int) -> int:
        """The place after the next mark; the page's end where there is none."""
        end = self.page.find(mark, at)
        return len(self.page) if end < 0 else end + len(mark)

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """Attributes of a tag from the end of its name, whether it closes itself, and the place after it."""
        page, found = self.page, []
        while at < len(page):
            m = _ATTRIBUTE.match(page, at)
            at, name = m.end(), m[1]
            value = ""
            if m[2] and at < len(page) and name:
                if (quote := page[at]) in self.last and self.last[quote] > at:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    u = _UNQUOTED.match(page, at)
                    value, at = u[0], u.end()
            if name:
                found.append((name.lower(), value))
            if at < len(page) and page[at] == ">":
                return found, page[at - 1] == "/" and not value.endswith("/"), at + 1
        return found, False, at


class _Open:
    """The open elements, with the places of each name and of blocks, so that none is searched for."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, n: Node) -> None:
        self.places.setdefault(n.name, []).append(len(self.stack))
        if n.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(n)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            n = self.stack.pop()
            self.places[n.name].pop()
            if n.name in BLOCK:
                self.blocks.pop()

    def last(self, name: str) -> int:
        """The deepest place of a name; 0 if it isn't open."""
        found = self.places.get(name)
        return found[-1] if found else 0

    def end(self, name: str) -> None:
        """An end tag; an inline one doesn't close blocks."""
        depth = self.last(name)
        if depth and (name in BLOCK or not self.blocks or depth > self.blocks[-1]):
            self.cut(depth)

    def begin(self, name: str) -> None:
        """What the beginning of a block ends."""
        if name in CLOSES:
            closes, stop = CLOSES[name]
            barrier = max(map(self.last, stop))
            above = [x[i] for x in map(self.places.get, closes) if x and (i := bisect_right(x, barrier)) < len(x)]
            if above:
                self.cut(min(above))
        elif self.blocks and self.stack[self.blocks[-1]].name == "p":
            self.cut(self.blocks[-1])


def parse(page: str) -> Node:
    """The tree under a root; strings are texts as written."""
    root = Node("#root", None, "")
    scan, now, at = _Scanner(page), _Open(root), 0
    text = 0  # where the text begins that isn't in the tree yet
    ends = {}
    while (begin := page.find("<", at)) >= 0:
        after = page[begin + 1 : begin + 2]
        m = _NAME.match(page, begin + 1) if after not in ("!", "?") else None
        if m is None and after not in ("!", "?"):
            at = begin + 1  # a mere sign
            continue
        if begin > text:
            now.stack[-1].children.append(page[text:begin])
        if m is None:
            if page.startswith("<!--", begin):
                at = scan.past("-->", begin + 4)
            elif page.startswith("<![CDATA[", begin):
                at = scan.past("]]>", begin + 9)
                now.stack[-1].children.append(html.escape(page[begin + 9 : at].removesuffix("]]>"), quote=False))
            else:
                at = scan.past(">", begin)
            text = at
            continue
        name = m[1].lower()
        if after == "/":
            text = at = scan.past(">", m.end())
            now.end(name)
            continue
        attributes, closed, at = scan.attributes(m.end())
        if name in BLOCK:
            now.begin(name)
        node = Node(name, now.stack[-1], _kind(name, attributes), next((v for k, v in attributes if k == "class"), ""))
        now.stack[-1].children.append(node)
        if name in RAW:
            if name not in ends:
                ends[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)
            end = ends[name].search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not closed:
            now.push(node)
        text = at
    if text < len(page):
        now.stack[-1].children.append(page[text:])
    return root


def _length(text: str) -> int:
    return len(" ".join((html.unescape(text) if "&" in text else text).split()))


def _measure(root: Node) -> list[Node]:
    """Counts below each node, in page order; noise and comments count nothing."""
    order: list[Node] = []
    todo = [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in reversed(n.children) if not isinstance(c, str))
    for n in reversed(order):  # children first
        chars = links = link_chars = 0
        tags = 0
        for c in n.children:
            if isinstance(c, str):
                chars += _length(c)
            elif c.kind in ("", "soft"):
                chars, links, link_chars, tags = chars + c.chars, links + c.links, link_chars + c.link_chars, tags + c.tags + 1
        if n.name == "a":
            links, link_chars = links + 1, chars
        n.chars, n.links, n.link_chars, n.tags = chars, links, link_chars, tags
    return order


def _settle(order: list[Node], body: Node) -> None:
    """Class words are overruled where an element holds an article, or, on pages without, most of the text."""
    named = any(n.name in ("article", "main") and n.chars and not n.kind for n in order)
    holds: set[int] = set()
    for n in reversed(order):  # children first
        if n.name in ("article", "main", "body") or id(n) in holds:
            if n.parent is not None:
                holds.add(id(n.parent))
        if (n.kind in ("soft", "comments") and id(n) in holds) or (n.kind == "soft" and not named and 2 * n.chars > body.chars):
            n.kind = ""


def _density(chars: int, tags: int, link_chars: int, links: int, share: float) -> float:
    """Composite text density; share: that of the body's characters which is in links."""
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(links, 1)
    inner = math.log(chars / max(chars - lc, 1) * lc + share * chars + math.e)
    # the base must be above 1, as in an ordinary text
    return chars / t * math.log1p(chars * t / (lc * lt)) / max(math.log(max(inner, math.e)), 1.0)


def main_nodes(root: Node) -> list[Node | str]:
    """The nodes whose text is the article's, in page order; their noise is marked by kind."""
    order = _measure(root)
    body = next((n for n in order if n.name == "body"), root)
    if body.chars == 0:
        body = root
    _settle(order, body)
    _measure(root)  # comments that hold an article count now
    share = body.link_chars / max(body.chars, 1)
    best, todo = body, [(body, False)]
    body.total = -1.0
    while todo:
        n, soft = todo.pop()  # in page order
        n.density = _density(n.chars, n.tags, n.link_chars, n.links, share)
        live = [c for c in n.children if not isinstance(c, str) and c.kind in ("", "soft")]
        own = sum(_length(c) for c in n.children if isinstance(c, str))
        total = sum(_density(c.chars, c.tags, c.link_chars, c.links, share) for c in live) + _density(own, 1, 0, 0, share)
        n.total = total
        if not soft and (n is body or total > best.total):
            best = n
        todo.extend((c, soft or c.kind == "soft") for c in reversed(live))
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    for name in ("article", "main"):
        held = [n for n in path if n.name == name]
        if held:
            return held[-1:]
    threshold = min(n.density for n in path)
    if best is body:
        return _beside(body, None, threshold)
    before, after = [], []
    for inner, parent in zip(path, path[1:], strict=False):
        around = _beside(parent, inner, threshold)
        at = next(i for i, c in enumerate(around) if c is inner)
        before.append(around[:at])
        after += around[at + 1 :]
    return [*(c for part in reversed(before) for c in part), best, *after]


def _built(n: Node) -> frozenset:
    """The names of the blocks in a node, or nothing's own name."""
    return frozenset(c.name for c in n.children if not isinstance(c, str) and c.name in BLOCK) or frozenset([""])


def _beside(parent: Node, inner: Node | None, threshold: float) -> list[Node | str]:
    """The children of a node of the path that belong to the article; inner: the child on the path."""
    runs: list[list] = []  # a block each, or text and inline elements in a row
    open_run = False
    for c in parent.children:
        if not isinstance(c, str) and c.kind:
            continue
        flows = c is not inner and (isinstance(c, str) or c.name not in BLOCK)
        if flows and open_run:
            runs[-1].append(c)
        else:
            runs.append([c])
        open_run = flows
    linked, dense = [], []
    for run in runs:
        chars = sum(_length(c) if isinstance(c, str) else c.chars for c in run)
        linked.append(2 * sum(c.link_chars for c in run if not isinstance(c, str)) > chars)
        block = run[0] if not isinstance(run[0], str) and run[0].name in BLOCK else None
        dense.append(run[0] is inner or (block is not None and 0 < block.density >= threshold))
    if not any(dense):  # the greatest density sum stands in
        sums = [0.0 if isinstance(run[0], str) or run[0].name not in BLOCK else run[0].total for run in runs]
        top = max(sums, default=0.0)
        dense = [s > 0 and s == top for s in sums]
    models: dict[tuple[str, str], frozenset] = {}  # by name and class: the names of blocks in those that are taken for sure
    for run, d, li in zip(runs, dense, linked, strict=True):
        if d and (run[0] is inner or not li):
            key = (run[0].name, run[0].label)
            models[key] = models.get(key, frozenset()) | _built(run[0])
    keep = []
    for run, d, li in zip(runs, dense, linked, strict=True):
        block = run[0] if not isinstance(run[0], str) and run[0].name in BLOCK else None
        keep.append(run[0] is inner or (not li and (block is None or d or bool(_built(block) & models.get((block.name, block.label), frozenset())))))
    sure = [i for i, (k, run) in enumerate(zip(keep, runs, strict=True)) if k and not isinstance(run[0], str) and run[0].name in BLOCK]
    if sure:
        first = sure[0]
        while first > 0 and not linked[first - 1] and not isinstance(runs[first - 1][0], str) and runs[first - 1][0].name in HEADINGS:
            first -= 1
        for i in range(first, sure[-1]):
            keep[i] = keep[i] or not linked[i]
    return [c for run, k in zip(runs, keep, strict=True) if k for c in run]


def blocks(nodes: list[Node | str]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = [(n, True) for n in reversed(nodes)]
    while todo:
        n, top = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            run.append(html.unescape(n) if "&" in n else n)
        elif n.kind and not top:
            continue
        elif n.name == "br":
            run.append(" ")
        else:
            if n.name in BLOCK:
                flush()
                todo.append((None, False))
            todo.extend((c, False) for c in reversed(n.children))
    flush()
    return out


def extract(page: str | None) -> str:
    """The article's text."""
    if not page:
        return ""
    return "\n".join(blocks(main_nodes(parse(page))))


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars."""
    h = Hidden(pages)
    own = h.name(column)

    def make():
        def columns(batch: pa.RecordBatch) -> list:
            texts = [extract(p) for p in batch.column(batch.schema.get_field_index(own)).to_pylist()]
            return [pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))]

        return columns

    found = appended(h.df.withColumn(own, F.col(own).cast("string")), "text string, n_chars long", make, keep=[c for c in h.df.columns if c != own])
    return h.shown(found, "text", "n_chars", without=(own,))


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
