"""Main text of web pages by wrapper induction.

Every page is parsed to a tree whose leaves are text blocks. Each layout of a host (pages whose outer sections are alike)
and each host as a whole has a reference page, that with the least hash of its source, and every page's tree is aligned
with both by simple tree matching: the ordered pairing of equal elements, from the root down, that pairs most nodes. A
block of the reference that is paired with an equal text on nearly all pages is constant: template. One that is paired
with other texts is a slot: content. The pages count these pairs, so no host's pages meet in one task, and a page
drops its blocks that are paired with constant ones. This holds inside all article and main elements, where a page
has any, and over the whole page elsewhere. Navigation, notices and the like are told by element and by the words of
class, id and role; a form that holds most of a page's text is content, as is prose under a soft word.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, slices

#: A block is constant if it is on this share of a layout's different pages, and on so many at least: outside and
#: inside content elements (two pages alone may be two versions of one article).
SHARE, LEAST, LEAST_INSIDE = 0.9, 2, 3
#: It is so as well if a host's pages that have its path, of all layouts, hold it to that share: so many pages, and
#: this share of the host's, at least.
HOST_LEAST, HOST_SHARE = 5, 0.1
#: References of up to so many bytes in all, and so many rows of constant blocks, are sent to every executor.
SENT_BYTES, SENT_ROWS = 32_000_000, 100_000
#: Siblings are paired by dynamic programming over up to so many pairs; beyond, equal subtrees part the lists first.
PAIRS = 40_000
#: Elements below this depth stand at it when trees are aligned.
DEEPEST = 100

# HTML's void, raw-text, inline and paragraph-like elements, and what is never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
CHROME = frozenset("nav footer aside form head button select input dialog svg canvas object audio video map menu".split()) | RAW
CONTENT = frozenset(["article", "main"])
#: Elements that make a layout, of so many levels below the body.
SECTIONS, DEPTH = frozenset("html body div section header footer nav main article aside".split()), 3
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup "
    "promo promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget widgets".split()
)
#: Words that an element with prose may bear: so many words in paragraphs, few of them links.
SOFT_WORDS, PROSE_WORDS, LINKED = frozenset("notice notices promo recommended related share sharing social".split()), 60, 0.3
# quotes count after = only, and a tag holds no <, so that a bad tag is left after a few steps
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=\s|/|$)", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_NUMBER = re.compile(r"[0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    marks: tuple[str, ...] = ()
    role: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)  # nodes and strings

    @property
    def step(self) -> str:
        """The element's part of a path; numbers in names, which differ from page to page, count as equal."""
        return f"{self.tag}.{_NUMBER.sub('#', ' '.join(self.marks))}" if self.marks else self.tag


@lru_cache(maxsize=50_000)
def _marked(attributes: str) -> tuple[tuple[str, ...], str, bool]:
    """(class and id names, role, hidden) out of a tag's attributes."""
    names: list[str] = []
    role, hidden = "", False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = entities.unescape(a or b or c)
        name = name.lower()
        if name in ("class", "id"):
            names += value.lower().split()
        elif name == "role":
            role = value.lower().strip()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
    return tuple(names), role, hidden


def parse(source: str) -> Node:
    """The page's tree; closes what HTML lets stay open, and takes bad markup as text or ignores it."""
    top = Node("#page")
    path = [top]
    open_: Counter[str] = Counter()  # open elements by tag
    at, end = 0, len(source)

    def cut(i: int) -> None:
        open_.subtract(n.tag for n in path[i:])
        del path[i:]

    while at < end:
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else end]
        if text:
            path[-1].children.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                path[-1].children.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag] > 0:
                cut(next(i for i in range(len(path) - 1, 0, -1) if path[i].tag == tag))
            continue
        if (tag not in INLINE and tag not in VOID or tag == "hr") and any(open_[t] > 0 for t in CLOSED_BY_BLOCK):
            for i in range(len(path) - 1, 0, -1):  # a block ends an open paragraph and the inline elements in it
                if path[i].tag in CLOSED_BY_BLOCK:
                    cut(i)
                    break
                if path[i].tag not in INLINE:
                    break
        if tag in SIBLINGS and any(open_[t] > 0 for t in SIBLINGS[tag]):
            for i in range(len(path) - 1, 0, -1):
                if path[i].tag in SIBLINGS[tag]:
                    cut(i)
                    break
                if path[i].tag in LIMITS[tag]:
                    break
        node = Node(tag, *_marked(m[3]) if m[3] else ((), "", False))
        path[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag not in VOID and tag in ("p", "div", "a", "span"):
            path.append(node)
            open_[tag] += 1
    return top


def _has_prose(node: Node) -> bool:
    """Whether an element's paragraphs say enough, and not in links."""
    words = linked = 0
    todo: list[tuple[Node, bool, bool]] = [(node, False, False)]
    while todo:
        n, paragraph, link = todo.pop()
        for c in n.children:
            if isinstance(c, str):
                k = len(c.split()) if paragraph else 0
                words, linked = words + k, linked + (k if link else 0)
            elif c.tag not in RAW:
                todo.append((c, paragraph or c.tag == "p", link or c.tag == "a"))
    return words >= PROSE_WORDS and linked < LINKED * words


def is_chrome(node: Node, inside: bool, forms: bool = False) -> bool:
    """Whether the element can't hold main text. ``inside``: of an article, whose own header holds its title. ``forms``: a form can."""
    if node.tag == "form" and forms and not node.hidden:
        return False
    if node.tag in CHROME or node.hidden or node.role in CHROME_ROLES and not (node.role == "banner" and inside):
        return True
    if node.tag == "header":
        return not inside
    if node.tag in ("html", "body", "article", "main"):
        return False
    soft = False
    for name in node.marks:
        words = _NAME.findall(name)
        met = CHROME_WORDS.intersection(words)
        if met - SOFT_WORDS or not inside and "header" in words:
            return True
        soft = soft or bool(met)
    return soft and not _has_prose(node)


def forms_hold_text(page: Node) -> bool:
    """Whether most of a page's text stands in forms, as some servers wrap whole pages in one."""
    total = within = 0
    todo: list[tuple[Node, bool]] = [(page, False)]
    while todo:
        n, form = todo.pop()
        for c in n.children:
            if isinstance(c, str):
                k = len(c.split())
                total, within = total + k, within + (k if form else 0)
            elif c.tag not in RAW and c.tag not in ("nav", "footer", "select", "button"):
                todo.append((c, form or c.tag == "form"))
    return 2 * within > total


def content_roots(top: Node, forms: bool = False) -> list[Node]:
    """The page's outermost article and main elements outside navigation and the like, in page order. What they hold is
    kept whole: a main with its articles and what is beside them, and all sibling articles."""
    found: list[Node] = []
    todo: list[Node] = [c for c in reversed(top.children) if not isinstance(c, str)]
    while todo:
        node = todo.pop()
        content = node.tag in CONTENT or node.role in CONTENT
        if is_chrome(node, content, forms):
            continue
        if content:
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return found


class Tree:
    """An element or, without a tag, a text block. ``hash`` tells equal subtrees, ``weight`` is a subtree's match with itself."""

    __slots__ = ("tag", "text", "no", "kids", "hash", "weight")

    def __init__(self, tag: str, text: str = "", no: int = -1):
        self.tag, self.text, self.no, self.kids = tag, text, no, []
        self.hash, self.weight = (hash(("", text)), 2) if no >= 0 else (0, 1)

    def close(self) -> None:
        self.hash = hash((self.tag, *(k.hash for k in self.kids)))
        self.weight = 1 + sum(k.weight for k in self.kids)


def tree_of(roots: list[Node], inside: bool, forms: bool = False) -> tuple[Tree, list[str]]:
    """The tree of ``roots`` without chrome, and the texts of its blocks in page order; ``no`` of a block is its place there."""
    top, texts = Tree("#page"), []
    stack, now = [top], []

    def flush() -> None:
        if now:
            text = " ".join(entities.unescape("".join(now)).split())
            if text:
                stack[-1].kids.append(Tree("", text, len(texts)))
                texts.append(text)
            now.clear()

    todo: list = list(reversed(roots))
    own = {id(r) for r in roots}
    while todo:
        n = todo.pop()
        if n is None:  # the end of a block element
            flush()
            stack.pop().close()
        elif n is False:  # the end of one below the deepest
            flush()
        elif isinstance(n, str):
            now.append(n)
        elif n.tag == "br":
            now.append(" ")
        elif id(n) not in own and is_chrome(n, inside, forms):
            if n.tag not in INLINE and n.tag not in RAW:
                flush()
        elif n.tag in INLINE:
            todo += reversed(n.children)
        else:
            flush()
            if len(stack) < DEEPEST:
                stack.append(Tree(n.tag))
                stack[-2].kids.append(stack[-1])
                todo.append(None)
            else:
                todo.append(False)
            todo += reversed(n.children)
    flush()
    top.close()
    return top, texts


def _parted(a: list[Tree], b: list[Tree]) -> list[tuple[list[Tree], list[Tree]]]:
    """Long lists of siblings cut at subtrees that are equal and stand once in each list, in one order."""
    once = lambda x: {h for h, n in Counter(t.hash for t in x).items() if n == 1}
    both = once(a) & once(b)
    place = {t.hash: i for i, t in enumerate(b) if t.hash in both}
    ends: list[tuple[int, int]] = []  # the longest rising run of places, by patience
    tails: list[int] = []
    back: dict[int, tuple[int, int] | None] = {}
    for i, t in enumerate(a):
        if t.hash in place:
            j = place[t.hash]
            k = bisect_left(tails, j)
            back[j] = ends[k - 1] if k else None
            tails[k:], ends[k:] = [j], [(i, j)]
    found, step = [], ends[-1] if ends else None
    while step:
        found.append(step)
        step = back[step[1]]
    parts, x, y = [], 0, 0
    for i, j in reversed(found):
        parts += [(a[x:i], b[y:j]), ([a[i]], [b[j]])]
        x, y = i + 1, j + 1
    return [*parts, (a[x:], b[y:])]


class Matcher:
    """Simple tree matching (Yang, 1991): elements of one tag pair, texts pair, children keep their order, most pairs win.

    Pairs of equal texts weigh double, so of equally large matchings that with most constant texts is taken.
    """

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def weight(self, a: Tree, b: Tree) -> int:
        if a.tag != b.tag:
            return 0
        if a.hash == b.hash:
            return a.weight
        if a.no >= 0:
            return 1
        if len(a.kids) == len(b.kids) == 1:
            return 1 + self.weight(a.kids[0], b.kids[0])
        key = (id(a), id(b))
        if key not in self.known:
            self.known[key] = 1 + self._siblings(a.kids, b.kids, None)
        return self.known[key]

    def _siblings(self, a: list[Tree], b: list[Tree], pairs: list[tuple[Tree, Tree]] | None) -> int:
        """The weight of the best ordered pairing of two lists; adds its pairs to ``pairs``."""
        x = 0
        while x < len(a) and x < len(b) and a[x].hash == b[x].hash:
            x += 1
        y = 0
        while y < min(len(a), len(b)) - x and a[-1 - y].hash == b[-1 - y].hash:
            y += 1
        equal = [*zip(a[:x], b[:x], strict=True), *zip(a[len(a) - y :], b[len(b) - y :], strict=True)]
        a, b = a[x : len(a) - y], b[x : len(b) - y]
        if pairs is not None:
            pairs += equal
        total = sum(t.weight for t, _ in equal)
        if not a or not b:
            return total
        if len(a) * len(b) > PAIRS:
            parts = _parted(a, b)
            if len(parts) > 1:
                return total + sum(self._siblings(p, q, pairs) for p, q in parts)
            rows = list(zip(a, b, strict=False))  # nothing parts them: by place alone
            if pairs is not None:
                pairs += [(p, q) for p, q in rows if self.weight(p, q)]
            return total + sum(self.weight(p, q) for p, q in rows)
        table = [[0] * (len(b) + 1)]
        for p in a:
            last, row = table[-1], [0]
            for j, q in enumerate(b):
                best = last[j + 1] if last[j + 1] > row[j] else row[j]
                w = last[j] + self.weight(p, q)
                row.append(w if w > best else best)
            table.append(row)
        if pairs is not None:
            i, j = len(a), len(b)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((a[i], b[j]))
        return total + table[-1][-1]

    def blocks(self, a: Tree, b: Tree) -> list[tuple[int, int, bool]]:
        """(block of a, block of b, whether their texts are equal) of each two blocks that the best matching pairs."""
        out: list[tuple[int, int, bool]] = []
        todo: list[tuple[Tree, Tree]] = [(a, b)]
        while todo:
            p, q = todo.pop()
            if p.tag != q.tag:
                continue
            if p.no >= 0:
                out.append((p.no, q.no, p.text == q.text))
            else:
                self._siblings(p.kids, q.kids, todo)
        return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def layout_of(page: Node, inside: bool) -> int:
    """Hash of the paths of a page's outer sections; pages of one layout are counted together."""
    paths: set[str] = set()
    todo: list[tuple[Node, str, int]] = [(page, str(inside), 0)]
    while todo:
        node, path, depth = todo.pop()
        for c in node.children:
            if isinstance(c, str) or c.tag not in SECTIONS:
                continue
            below = f"{path}/{c.step}"
            if c.tag in ("html", "body"):
                todo.append((c, path, depth))
                continue
            paths.add(below)
            if c.tag not in CONTENT and depth + 1 < DEPTH:
                todo.append((c, below, depth + 1))
    return _hash("\n".join(sorted(paths)) + f"\n{inside}")


def read(source: str | None) -> tuple[bool, int, Tree, list[str]]:
    """Whether a page has content elements with text, its layout, its tree and its blocks: of those, or else of the whole page."""
    if not source or "<" not in source:
        tree, text = Tree("#page"), " ".join(entities.unescape(source or "").split())
        if text:
            tree.kids.append(Tree("", text, 0))
        tree.close()
        return False, 0, tree, [text] if text else []
    page = parse(source)
    forms = "<form" in source.lower() and forms_hold_text(page)
    tree, texts = tree_of(content_roots(page, forms), True, forms)
    inside = bool(texts)
    if not inside:
        tree, texts = tree_of([page], False, forms)
    return inside, layout_of(page, inside), tree, texts


_LAYOUTS = pa.schema([("host", pa.string()), ("h", pa.int64()), ("layout", pa.int64())])
_ALIGNED_DDL = "page_id long, url string, host string, h long, layout long, least int, blocks array<string>, own array<int>, own_paired array<int>, other array<int>, other_paired array<int>"
_ALIGNED = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("h", pa.int64()), ("layout", pa.int64()), ("least", pa.int32()), ("blocks", pa.list_(pa.string())),
    *((n, pa.list_(pa.int32())) for n in ("own", "own_paired", "other", "other_paired")),
])


def host_of(url: str = "url"):
    """The host of a url, without user and port, in lower case; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        yield pa.RecordBatch.from_arrays([batch["host"], batch["h"], pa.array([read(x)[1] for x in batch["html"].to_pylist()], pa.int64())], schema=_LAYOUTS)


@lru_cache(maxsize=256)
def _reference(source: str) -> Tree:
    return read(source)[2]


def _paired(tree: Tree, n: int, source: str | None) -> tuple[list[int], list[int]]:
    """For each of a page's ``n`` blocks the block of the reference that has its text and is paired with it, or -1; and all blocks of the reference that are paired."""
    equal, paired = [-1] * n, []
    if source is not None:
        for mine, theirs, same in Matcher().blocks(tree, _reference(source)):
            paired.append(theirs)
            if same:
                equal[mine] = theirs
    return equal, paired


def _aligned(batch: pa.RecordBatch, own: Callable[[int, int], str | None], other: list[str | None]) -> pa.RecordBatch:
    """Each page aligned with the reference of its layout, ``own`` of (row, layout), and that of its host, once if they are one."""
    rows = []
    for i, (source, b) in enumerate(zip(batch["html"].to_pylist(), other, strict=True)):
        inside, layout, tree, texts = read(source)
        a = own(i, layout)
        first = _paired(tree, len(texts), a)
        rows.append((layout, LEAST_INSIDE if inside else LEAST, texts, *first, *(first if b == a else _paired(tree, len(texts), b))))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    made = [pa.array(list(c), f.type) for c, f in zip(columns, list(_ALIGNED)[4:], strict=True)]
    return pa.RecordBatch.from_arrays([*(batch[c] for c in ("page_id", "url", "host", "h")), *made], schema=_ALIGNED)


def references(pages: DataFrame, store: Store) -> DataFrame:
    """(host, layout, source) of ``pages`` (host, h, html): the source with the least hash of each layout and, with a null layout, of each host."""
    at = store.put(pages.where("host is not null").mapInArrow(_layouts, "host string, h long, layout long").distinct(), "layouts")
    least = at.groupBy("host", "layout").agg(F.min("h").alias("h"))
    least = store.put(least.union(least.groupBy("host").agg(F.min("h").alias("h")).select("host", F.lit(None).cast("long").alias("layout"), "h")), "least")
    wanted = least.select("host", "h").distinct()
    few = wanted.count() <= SENT_ROWS
    sources = pages.select("host", "h", "html").join(F.broadcast(wanted) if few else wanted, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.min("html").alias("source"))
    return store.put(least.join(sources, ["host", "h"]).select("host", "layout", "source"), "references")


def align(pages: DataFrame, known: DataFrame, store: Store, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Each of ``pages`` (page_id, url, host, h, html) with its blocks and what of the references they are paired with."""
    size, n = known.agg(F.sum(F.octet_length("source")), F.count(F.lit(1))).first()
    if (size or 0) <= sent_bytes and n <= SENT_ROWS:
        table = pages.sparkSession.sparkContext.broadcast({(r["host"], r["layout"]): r["source"] for r in known.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 64):
                hosts = batch["host"].to_pylist()
                yield _aligned(batch, lambda i, layout, hosts=hosts: table.value.get((hosts[i], layout)), [table.value.get((h, None)) for h in hosts])

        return store.put(pages.mapInArrow(run, _ALIGNED_DDL), "aligned")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            yield _aligned(batch, lambda i, _, own=batch["own"].to_pylist(): own[i], batch["other"].to_pylist())

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            layout = pa.array([read(x)[1] for x in batch["html"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, layout], names=[*batch.schema.names, "layout"])

    wide = pages.mapInArrow(marked, "page_id long, url string, host string, h long, html string, layout long")
    wide = wide.join(known.where("layout is not null").withColumnRenamed("source", "own"), ["host", "layout"], "left").join(
        known.where("layout is null").select("host", F.col("source").alias("other")), "host", "left"
    )
    return store.put(wide.select("page_id", "url", "host", "h", "html", "own", "other").mapInArrow(joined, _ALIGNED_DDL), "aligned")


def templates(aligned: DataFrame, store: Store) -> DataFrame:
    """(host, layout, constant): the reference's blocks that are constant, of each layout and, with a null layout, of each host.

    Equal sources of a host count once. Of a layout a block must have its text on SHARE of the pages; of a host on SHARE of
    those pages where it is paired at all, which must be HOST_LEAST and HOST_SHARE of the host's.
    """
    small = aligned.where("host is not null").select("host", "h", "layout", "least", "own", "other", "other_paired")
    one = store.put(small.dropDuplicates(["host", "h"]), "once")
    share = lambda of: F.col("n") >= SHARE * F.col(of)
    sizes = one.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"), F.max("least").alias("least"))
    met = lambda column, *keys: one.select(*keys, F.explode(F.array_distinct(column)).alias("block")).where("block >= 0").groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"))
    by_layout = met("own", "host", "layout").join(sizes, ["host", "layout"]).where((F.col("n") >= F.col("least")) & share("pages")).select("host", "layout", "block")
    paired = met("other_paired", "host").withColumnRenamed("n", "paired")
    by_host = met("other", "host").where(F.col("n") >= HOST_LEAST).join(paired, ["host", "block"]).join(one.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host")
    by_host = by_host.where(share("paired") & (F.col("n") >= HOST_SHARE * F.col("pages"))).select("host", F.lit(None).cast("long").alias("layout"), "block")
    return store.put(by_layout.union(by_host).groupBy("host", "layout").agg(F.collect_set("block").alias("constant")), "templates")


def extract(pages: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(page_id, url, text) of ``pages`` (page_id, url, html, more).

    A null or empty source gives an empty text; a page without a host, or of a host with one page only, is read without a
    template; a page whose blocks are all constant keeps them; repeated rows are read each; no rows give no rows; further
    columns are not read. Sources are read whole.
    """
    store = Store(pages.sparkSession, "wrapper")
    rows = pages.select("page_id", "url", host_of().alias("host"), F.xxhash64("html").alias("h"), "html")
    aligned = align(rows, references(rows.where("html is not null"), store), store, sent_bytes)
    known = templates(aligned, store)
    few = known.count() <= SENT_ROWS
    sent = lambda df: F.broadcast(df) if few else df
    x = aligned.join(sent(known.where("layout is not null").withColumnRenamed("constant", "_own")), ["host", "layout"], "left").join(
        sent(known.where("layout is null").select("host", F.col("constant").alias("_other"))), "host", "left"
    )
    none = F.array().cast("array<int>")
    # a block of -1 is paired with none, and no template has it
    slot = F.filter("blocks", lambda _, i: ~F.array_contains(F.coalesce("_own", none), F.get("own", i)) & ~F.array_contains(F.coalesce("_other", none), F.get("other", i)))
    return x.select("page_id", "url", F.array_join(F.when(F.size(slot) > 0, slot).otherwise(F.col("blocks")), "\n").alias("text"))
