"""HTML extraction by wrapper induction over the pages of a host.

The pages of a host fall into groups of one shape (the labels of the first levels); shapes with few pages join the
host's commonest one. Each group has two reference pages, those of the smallest and the largest page_id of its shape,
and a template of its own: every page's DOM tree is aligned with the references by simple tree matching (the largest
ordered, top-down mapping of equal labels), and a text node of a reference that at least `constant` of the group's
pages carry with the same text is template. Texts in varying slots, and texts without a partner, are content; only what
is never shown (head, script, style, template), and what pages themselves mark as navigation or footer (`marked`),
isn't. Copies of a reference page are no evidence: they are left out of the counting, so that repeated pages don't
turn each other into template.

References are joined by host and shape: broadcast while their size, which is counted first, is at most
`broadcast_bytes`, else by a shuffle of the pages, whose hot groups adaptive execution splits.

Defined results: a page whose url is null or has no host, and a group's only page, have no template: all shown text
is content. Null or empty html gives an empty content and title. Pages of any length are parsed whole; unclosed,
misnested and unknown tags are tolerated; elements nested deeper than max_depth (as deep as browsers go) become
children of the last level. Every input row gives one row, repeated rows as well; ties of shapes go to the smaller
hash; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import html as H
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class WrapperConfig:
    """constant: share of a group's pages that carry a template text; group_pages: pages that a shape needs for a group of its own; marked: elements that are never content."""

    constant: float = 0.8
    group_pages: int = 4
    shape_depth: int = 4
    max_depth: int = 512
    marked: tuple[str, ...] = ("head", "nav", "footer")
    broadcast_bytes: int = 32 << 20


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)", re.S | re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {t: frozenset(x.split()) for t, x in {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"}.items()}
_P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = frozenset("html body div article section table ul ol dl td th blockquote main nav footer header aside".split())
_INLINE = frozenset("a abbr b cite code em i q small span strong sub sup u".split())


class Page:
    """A DOM tree in preorder: label, children, text and signature of the subtree's structure by node."""

    def __init__(self, source: str, cfg: WrapperConfig) -> None:
        self.label, self.kids, self.text, self.skip, self.block = ["#root"], [[]], [""], [False], [0]
        self.title = ""
        stack, tags = [0], ["#root"]
        for m in _TOKEN.finditer(source or ""):
            closing, tag, attrs, text = m[2], m[3], m[4], m[5]
            if text is not None:
                text = " ".join(H.unescape(text).split())
                if text:
                    if tags[-1] == "title" and not self.title:
                        self.title = text
                    self._add(stack[-1], "#text", text, self.skip[stack[-1]])
            elif tag is None:
                continue
            elif closing:
                tag = tag.lower()
                if tag in tags:
                    k = len(tags) - 1 - tags[::-1].index(tag)
                    del stack[max(k, 1) :], tags[max(k, 1) :]
            else:
                tag = tag.lower()
                ends = _CLOSES.get(tag, frozenset()) | (frozenset("p") if tag in _P_ENDS else frozenset())
                if ends:
                    k = len(tags) - 1
                    while k > 0 and tags[k] not in _SCOPE and tags[k] not in ends:
                        k -= 1
                    if k > 0 and tags[k] in ends:
                        del stack[k:], tags[k:]
                c = _CLASS.search(attrs) if "class" in attrs.lower() else None
                at = self._add(stack[-1], tag + "." + (c[1] or c[2] or c[3] or "").strip() if c else tag, "", self.skip[stack[-1]] or tag in cfg.marked)
                self.block[at] = self.block[stack[-1]] if tag in _INLINE else at
                if tag not in _VOID and not attrs.endswith("/") and len(stack) < cfg.max_depth:
                    stack.append(at)
                    tags.append(tag)
        self.sig, self.size = [0] * len(self.label), [1] * len(self.label)
        for i in range(len(self.label) - 1, -1, -1):
            self.sig[i] = hash((self.label[i], *[self.sig[k] for k in self.kids[i]]))
            self.size[i] = 1 + sum(self.size[k] for k in self.kids[i])

    def _add(self, parent: int, label: str, text: str, skip: bool) -> int:
        at = len(self.label)
        self.label.append(label)
        self.kids.append([])
        self.text.append(text)
        self.skip.append(skip)
        self.block.append(self.block[parent])
        self.kids[parent].append(at)
        return at

    def shape(self, depth: int) -> int:
        """A hash of the set of label paths of the first levels."""
        paths, level = set(), [(0, "")]
        for _ in range(depth):
            level = [(k, p + "/" + self.label[k]) for i, p in level for k in self.kids[i] if self.label[k] != "#text"]
            paths.update(p for _, p in level)
        return zlib.crc32("\n".join(sorted(paths)).encode())


class Matcher:
    """Simple tree matching; weights and alignments are kept by the structure of the two subtrees."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], tuple[int, tuple]] = {}

    def align(self, a: Page, i: int, b: Page, j: int) -> tuple[int, tuple]:
        """(nodes that map, pairs of positions among the children) of two subtrees with equal labels."""
        key = (a.sig[i], b.sig[j])
        if key not in self.known:
            if key[0] == key[1]:
                n = len(a.kids[i])
                self.known[key] = (a.size[i], tuple((k, k) for k in range(n)))
            else:
                pairs = self._sequence(a, a.kids[i], b, b.kids[j])
                score = 1 + sum(self.weight(a, a.kids[i][x], b, b.kids[j][y]) for x, y in pairs)
                self.known[key] = (score, tuple(pairs))
        return self.known[key]

    def weight(self, a: Page, i: int, b: Page, j: int) -> int:
        return self.align(a, i, b, j)[0] if a.label[i] == b.label[j] else 0

    def _sequence(self, a: Page, x: list[int], b: Page, y: list[int]) -> list[tuple[int, int]]:
        lo, m, n = 0, len(x), len(y)
        while lo < min(m, n) and a.sig[x[lo]] == b.sig[y[lo]]:  # equal subtrees at the ends match in some best mapping
            lo += 1
        while lo < min(m, n) and a.sig[x[m - 1]] == b.sig[y[n - 1]]:
            m, n = m - 1, n - 1
        ends = [(k, k) for k in range(lo)] + [(m + k, n + k) for k in range(len(x) - m)]
        return ends + [(p + lo, q + lo) for p, q in self._middle(a, x[lo:m], b, y[lo:n])]

    def _rows(self, a: Page, x: list[int], b: Page, y: list[int]) -> Iterator[np.ndarray]:
        """Rows of the table of best weights; one row of weights by distinct structure of a child."""
        known: dict[int, np.ndarray] = {}
        row = np.zeros(len(y) + 1, np.int64)
        yield row
        for i in x:
            s = a.sig[i]
            if s not in known:
                by: dict[int, int] = {}
                for j in y:
                    if b.sig[j] not in by:
                        by[b.sig[j]] = self.weight(a, i, b, j)
                known[s] = np.array([by[b.sig[j]] for j in y], np.int64)
            new = row.copy()
            new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + known[s]))
            row = new
            yield row

    def _middle(self, a: Page, x: list[int], b: Page, y: list[int]) -> list[tuple[int, int]]:
        if not x or not y:
            return []
        if len(x) * len(y) > 4_000_000 and len(x) > 1:  # divide, so that memory stays linear
            h = len(x) // 2
            for top in self._rows(a, x[:h], b, y):
                pass
            for low in self._rows(a, x[h:][::-1], b, y[::-1]):
                pass
            k = int((top + low[::-1]).argmax())
            return self._middle(a, x[:h], b, y[:k]) + [(p + h, q + k) for p, q in self._middle(a, x[h:], b, y[k:])]
        table = np.stack(list(self._rows(a, x, b, y)))
        i, j, out = len(x), len(y), []
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def mapping(self, a: Page, b: Page) -> dict[int, int]:
        """Nodes of b by the nodes of a that they map to."""
        if len(self.known) > 200_000:
            self.known.clear()
        out, todo = {}, [(0, 0)]
        while todo:
            i, j = todo.pop()
            out[i] = j
            todo += [(a.kids[i][p], b.kids[j][q]) for p, q in self.align(a, i, b, j)[1]]
        return out


def content_of(page: Page, template: set[int]) -> str:
    """The shown texts that aren't template, a line for each block."""
    lines: list[str] = []
    last = None
    for i, text in enumerate(page.text):
        if text and not page.skip[i] and i not in template:
            if page.block[i] == last:
                lines[-1] += " " + text
            else:
                lines.append(text)
                last = page.block[i]
    return "\n".join(lines)


def _hosted(pages: DataFrame, cfg: WrapperConfig) -> DataFrame:
    """(page_id, url, html, host, shape); the shape is that of the page's tree, null without a host or html."""

    @F.arrow_udf("long")
    def shape(sources: pa.Array) -> pa.Array:
        return pa.array([None if x is None else Page(x, cfg).shape(cfg.shape_depth) for x in sources.to_pylist()], pa.int64())

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    hosted = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))
    return hosted.withColumn("shape", shape(F.when(F.col("host") != "", F.col("html"))))


def _sized(df: DataFrame, n: int, cfg: WrapperConfig) -> DataFrame:
    """df of n bytes, to be broadcast if they are few."""
    return F.broadcast(df) if n <= cfg.broadcast_bytes else df


def groups(pages: DataFrame, cfg: WrapperConfig) -> DataFrame:
    """(host, shape, lo, hi, main): shapes that are groups, the page_ids of their references, and whether it is the host's commonest."""
    usable = _hosted(pages, cfg).where("host <> '' AND page_id IS NOT NULL AND html IS NOT NULL")
    by = usable.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("page_id").alias("lo"), F.max("page_id").alias("hi"))
    by = C.durable(by, "shapes")
    first = by.groupBy("host").agg(F.max(F.struct("n", (-F.col("shape")).alias("s"))).alias("x")).selectExpr("host", "-x.s AS shape", "true AS main")
    both = by.join(first, ["host", "shape"], "left").select("host", "shape", "lo", "hi", F.coalesce("main", F.lit(False)).alias("main"), "n")
    return C.durable(both.where(f"main OR n >= {cfg.group_pages}").drop("n"), "groups")


def _grouped(pages: DataFrame, found: DataFrame, cfg: WrapperConfig) -> DataFrame:
    """(page_id, url, html, host, shape): the shape is the group's now."""
    n = 64 * found.count()
    own = found.select("host", "shape", F.lit(True).alias("own"))
    main = found.where("main").select("host", F.col("shape").alias("main"))
    met = _hosted(pages, cfg).join(_sized(own, n, cfg), ["host", "shape"], "left").join(_sized(main, n, cfg), "host", "left")
    return met.select("page_id", "url", "html", "host", F.when(F.col("own"), F.col("shape")).otherwise(F.col("main")).alias("shape"))


def references(pages: DataFrame, found: DataFrame, cfg: WrapperConfig) -> DataFrame:
    """(host, shape, one, two): html of the two reference pages of each group; two is null if they are equal."""
    ends = found.select("host", "shape", F.explode(F.array(F.struct(F.col("lo").alias("page_id"), F.lit(1).alias("k")), F.struct(F.col("hi").alias("page_id"), F.lit(2).alias("k")))).alias("e")).select("host", "shape", "e.*")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id", "html", F.coalesce(host, F.lit("")).alias("host"))
    met = rows.join(_sized(ends, 128 * found.count(), cfg), ["host", "page_id"])
    of = lambda k: F.min(F.when(F.col("k") == k, F.col("html")))
    both = met.groupBy("host", "shape").agg(of(1).alias("one"), of(2).alias("two"))
    return C.durable(both.withColumn("two", F.when(F.col("two") != F.col("one"), F.col("two"))), "references")


class References:
    """Parsed reference pages by group, and mappings to them."""

    def __init__(self, cfg: WrapperConfig) -> None:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * cfg.max_depth))
        self.cfg, self.kept, self.matcher = cfg, {}, Matcher()

    def pages(self, host: str, shape: int, sources: tuple[str | None, str | None]) -> list[Page]:
        if (host, shape) not in self.kept:
            if len(self.kept) > 2000:
                self.kept.clear()
            self.kept[host, shape] = [Page(x, self.cfg) for x in sources if x is not None]
        return self.kept[host, shape]


def templates(pages: DataFrame, found: DataFrame, cfg: WrapperConfig) -> DataFrame:
    """(host, shape, one, two, constant): the nodes of the references, 2 * node + 0 or 1, whose text is the same on enough pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = References(cfg)
        for b in batches:
            same: dict[tuple[str, int, int], int] = defaultdict(int)
            for host, shape, source, *both in zip(*(b.column(c).to_pylist() for c in ("host", "shape", "html", "one", "two")), strict=True):
                p = None
                for k, (r, ref) in enumerate(zip(refs.pages(host, shape, both), both, strict=False)):
                    if source == ref:
                        continue
                    p = p or Page(source, cfg)
                    same[host, shape, k - 2] += 1
                    for i, j in refs.matcher.mapping(r, p).items():
                        if r.text[i] and r.text[i] == p.text[j]:
                            same[host, shape, 2 * i + k] += 1
            if same:
                yield C.batch_of(host=[h for h, _, _ in same], shape=[s for _, s, _ in same], node=[i for _, _, i in same], n=list(same.values()))

    refs = references(pages, found, cfg)
    size = refs.agg(F.sum(F.length("one") + F.coalesce(F.length("two"), F.lit(0)))).first()[0] or 0
    met = _grouped(pages, found, cfg).where("html IS NOT NULL").select("host", "shape", "html").join(_sized(refs, size, cfg), ["host", "shape"])
    counts = met.mapInArrow(count, "host string, shape long, node long, n long").groupBy("host", "shape", "node").agg(F.sum("n").alias("n"))
    others = lambda k: F.coalesce(F.max(F.when(F.col("node") == k - 2, F.col("n"))), F.lit(0))
    nodes = counts.groupBy("host", "shape").agg(others(0).alias("n0"), others(1).alias("n1"), F.collect_list(F.when(F.col("node") >= 0, F.struct("node", "n"))).alias("c"))
    # the reference itself has its texts as well
    enough = f"x -> x.n + 1 >= {cfg.constant} * (1 + if(x.node % 2 = 0, n0, n1))"
    constant = nodes.select("host", "shape", F.expr(f"array_sort(transform(filter(c, {enough}), x -> x.node))").alias("constant"))
    return C.durable(refs.join(constant, ["host", "shape"]), "templates")


def extract(pages: DataFrame, cfg: WrapperConfig = WrapperConfig()) -> DataFrame:
    """(page_id, url, host, title, content, template_nodes) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = References(cfg)
        for b in batches:
            titles, contents, counts = [], [], []
            for host, shape, source, one, two, constant in zip(*(b.column(c).to_pylist() for c in ("host", "shape", "html", "one", "two", "constant")), strict=True):
                p, template = Page(source, cfg), set()
                if constant:
                    for k, r in enumerate(refs.pages(host, shape, (one, two))):
                        mine = [n >> 1 for n in constant if n & 1 == k]
                        m = refs.matcher.mapping(r, p) if mine else {}
                        template.update(m[i] for i in mine if i in m and p.text[m[i]] == r.text[i])
                titles.append(p.title)
                contents.append(content_of(p, template))
                counts.append(len(template))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), pa.array(titles, pa.string()), pa.array(contents, pa.string()), pa.array(counts, pa.int64())], names=["page_id", "url", "host", "title", "content", "template_nodes"])

    found = groups(pages, cfg)
    known = templates(pages, found, cfg)
    size = known.agg(F.sum(F.length("one") + F.coalesce(F.length("two"), F.lit(0)) + 8 * F.size("constant"))).first()[0] or 0
    met = _grouped(pages, found, cfg).join(_sized(known, size, cfg), ["host", "shape"], "left")
    return met.mapInArrow(run, "page_id long, url string, host string, title string, content string, template_nodes long")
