"""HTML extraction by wrapper induction.

Pages of one host come from one template, or a few. The seed of a host is the tree of all its pages: each page is aligned
with it by simple tree matching, the largest mapping of nodes that keeps labels, parents and order, and its nodes that
match none are grafted in where they stand. Tasks fold their pages, and then the trees of a host are folded.
A text node of the seed whose aligned texts are the same on at least ``constant`` of the host's pages that have it
is template; slots that vary are content. Support is counted over all pages.

Trees are interned by shape, so that a subtree (and a pair of subtrees) that many pages share is matched once.
Three scans of the pages, to fold, to count, to extract; what shuffles is counts by (host, node, text hash). A wrapper
(seed and constant nodes) is a row a host; wrappers are broadcast if they are small, else joined.
"""

from __future__ import annotations

import html
import json
import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._common import cut, pick, sized

CONSTANT, MIN_PAGES = 0.8, 3
BROADCAST_HOSTS = 2000
#: Trees are walked by recursion, as deep as pages nest; calls from Python to Python take no room on the C stack.
_DEEP = 1 << 24
#: Children lists with more pairs than this are matched in blocks of rows, from rows that are kept between them.
MAX_PAIRS = 4_000_000

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/<>]*)|[!?])")
_MARK = re.compile(r"[\"'>]")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe"))
_HIDDEN = frozenset(("script", "style", "noscript", "template", "iframe", "head", "textarea"))
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCK = frozenset("p div ul ol dl table article section header footer nav aside main h1 h2 h3 h4 h5 h6 pre blockquote form hr".split())
_SPACE = re.compile(r"\s+")


class Scanner:
    """The tags of a page, in time linear in its length, however broken it is."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.dead = page, page.rfind(">"), set()

    def end(self, at: int) -> int:
        """Where the tag whose attributes begin at this place ends: its first > outside quotes, or -1. From a quote that led
        nowhere once, no other tag gets anywhere."""
        page, seen = self.page, []
        while at <= self.last:
            m = _MARK.search(page, at)
            if m is None or m.start() in self.dead:
                break
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            close = page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(seen)
        return -1

    def tags(self) -> Iterator[tuple[int, int, bool, str | None, str]]:
        """(start, end, closing, name, attributes) of each tag, without a name for comments and declarations; send() where to
        go on."""
        page, at = self.page, 0
        while m := _TAG.search(page, at):
            if m[1]:
                end = page.find("-->", m.end())
                end = len(page) if end < 0 else end + 3
            else:
                end = (self.end(m.end()) if m[3] else page.find(">", m.end()) if m.end() <= self.last else -1) + 1
            if not end:
                at = m.start() + 1
                continue
            go_on = yield m.start(), end, bool(m[2]), m[3].lower() if m[3] else None, page[m.end() : end - 1]
            at = end if go_on is None else go_on


class Trees:
    """Parsed pages with interned shapes, and matches of shapes; forgotten when they grow too many."""

    def __init__(self) -> None:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _DEEP))
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.shapes: list[tuple] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.maps: dict[tuple[int, int], list[int]] = {}
        self.sizes: list[int] = []

    def intern(self, label: str, kids: tuple[int, ...]) -> int:
        key = (label, kids)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.shapes)
            self.shapes.append(key)
            self.sizes.append(1 + sum(self.sizes[k] for k in kids))
        return found

    def parse(self, page: str) -> tuple:
        """(shape, children, text) of the root; text nodes have no children, and hidden elements no node."""
        stack: list[tuple[str, str, list]] = [("#root", "#root", [])]
        open_: Counter = Counter()

        def text(s: str) -> None:
            s = _SPACE.sub(" ", html.unescape(s)).strip()
            if s:
                stack[-1][2].append((self.intern("#text", ()), (), s))

        def close() -> None:
            label, name, kids = stack.pop()
            open_[name] -= 1
            if name not in _HIDDEN:
                stack[-1][2].append((self.intern(label, tuple(k[0] for k in kids)), kids, None))

        done, tags, go_on = 0, Scanner(page).tags(), None
        while True:
            try:
                start, end, closing, name, attributes = tags.send(go_on)
            except StopIteration:
                break
            go_on = None
            if start > done:
                text(page[done:start])
            done = end
            if name is None:
                continue
            if closing:
                while open_[name] > 0:
                    last = stack[-1][1] == name
                    close()
                    if last:
                        break
                continue
            if name in _BLOCK and any(s[1] == "p" for s in stack[-8:]):
                while any(s[1] == "p" for s in stack[-8:]):
                    close()
            elif name in _CLOSES and stack[-1][1] in _CLOSES[name]:
                close()
            if name in _VOID:
                continue
            if name in _RAW:  # up to its own end tag
                over = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, end)
                if name == "title" and over and not open_["head"]:
                    stack[-1][2].append((self.intern("title", ()), (), None))
                done = go_on = over.end() if over else len(page)
                continue
            if not attributes.endswith("/"):
                c = _CLASS.search(attributes) if "class" in attributes else None
                stack.append((f"{name}.{next(filter(None, c.groups()), '')}" if c else name, name, []))
                open_[name] += 1
        if done < len(page):
            text(page[done:])
        while len(stack) > 1:
            close()
        kids = stack[0][2]
        return self.intern("#root", tuple(k[0] for k in kids)), kids, None

    def weight(self, a: int, b: int) -> int:
        """Nodes in the largest match of two shapes."""
        if a == b:
            return self.sizes[a]
        (la, ka), (lb, kb) = self.shapes[a], self.shapes[b]
        if la != lb:
            return 0
        found = self.weights.get((a, b))
        if found is None:
            found = self.weights[a, b] = 1 + self._match(ka, kb)[0]
        return found

    def map(self, a: int, b: int) -> list[int]:
        """For each child of shape a, the child of shape b that it matches, or -1."""
        found = self.maps.get((a, b))
        if found is None:
            found = self.maps[a, b] = self._match(self.shapes[a][1], self.shapes[b][1])[1]
        return found

    def _match(self, ka: tuple[int, ...], kb: tuple[int, ...]) -> tuple[int, list[int]]:
        m, n = len(ka), len(kb)
        lo = 0
        while lo < m and lo < n and ka[lo] == kb[lo]:
            lo += 1
        tail = 0
        while tail < m - lo and tail < n - lo and ka[m - 1 - tail] == kb[n - 1 - tail]:
            tail += 1
        out = [*range(lo), *repeat(-1, m - lo - tail), *range(n - tail, n)]
        total = sum(self.sizes[k] for k in ka[:lo]) + sum(self.sizes[k] for k in ka[m - tail :] if tail)
        a, b = ka[lo : m - tail], kb[lo : n - tail]
        if a and b:
            ia, ib = {k: i for i, k in enumerate(dict.fromkeys(a))}, {k: i for i, k in enumerate(dict.fromkeys(b))}
            each = np.array([[self.weight(x, y) for y in ib] for x in ia], np.int64)
            cols = np.array([ib[y] for y in b])
            step = len(a) if len(a) * len(b) <= MAX_PAIRS else math.isqrt(len(a)) + 1
            starts = range(0, len(a), step)

            def table(first: np.ndarray, start: int) -> np.ndarray:
                part = a[start : start + step]
                best = np.zeros((len(part) + 1, len(b) + 1), np.int64)
                best[0] = first
                for i, x in enumerate(part):
                    row = np.maximum(best[i, 1:], best[i, :-1] + each[ia[x]][cols])
                    best[i + 1, 1:] = np.maximum.accumulate(row)
                return best

            marks = [np.zeros(len(b) + 1, np.int64)]
            for start in starts:
                best = table(marks[-1], start)
                marks.append(best[-1].copy())
            j = len(b)
            total += int(best[-1, j])
            for at in reversed(range(len(starts))):
                if at + 1 < len(starts):
                    best = table(marks[at], starts[at])
                i = len(best) - 1
                while i and j:
                    if best[i, j] == best[i - 1, j]:
                        i -= 1
                    elif best[i, j] == best[i, j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        out[lo + starts[at] + i] = lo + j
        return total, out

    def graft(self, tree: int, page: int) -> int:
        """The shape of a tree with the nodes of a page, of the same label, that match none of its own."""
        if tree == page:
            return tree
        label, kids = self.shapes[tree]
        out, at = [], 0
        for kid, j in zip(self.shapes[page][1], self.map(page, tree)):
            if j < 0:
                out.append(kid)
            else:
                out += [*kids[at:j], self.graft(kids[j], kid)]
                at = j + 1
        return self.intern(label, (*out, *kids[at:]))

    def dump(self, shape: int) -> str:
        """Labels and numbers of children, parents first."""
        labels, many, todo = [], [], [shape]
        while todo:
            label, kids = self.shapes[todo.pop()]
            labels.append(label)
            many.append(len(kids))
            todo += reversed(kids)
        return json.dumps([labels, many], separators=(",", ":"))

    def load(self, stored: str) -> tuple:
        """The tree of a dump, with nodes as in parse()."""
        labels, many = json.loads(stored)
        held: list[tuple] = []  # finished nodes, the first child last
        for label, n in zip(reversed(labels), reversed(many)):
            kids = tuple(reversed(held[len(held) - n :])) if n else ()
            del held[len(held) - n :]
            held.append((self.intern(label, tuple(k[0] for k in kids)), kids, None))
        return held[0]

    def full(self) -> bool:
        return len(self.shapes) > 200_000 or len(self.weights) + len(self.maps) > 500_000

    def number(self, root: tuple) -> tuple:
        """The tree with each node numbered: (shape, children, number)."""
        n = -1

        def walk(node: tuple) -> tuple:
            nonlocal n
            n += 1
            own = n
            return node[0], [walk(k) for k in node[1]], own

        return walk(root)

    def align(self, page: tuple, seed: tuple | None) -> list[tuple[str, int]]:
        """The texts of a page in order, each with the number of the seed's node that it matches, or -1."""
        out: list[tuple[str, int]] = []

        def walk(p: tuple, s: tuple | None) -> None:
            if p[2] is not None:
                out.append((p[2], -1 if s is None else s[2]))
            elif s is None:
                for k in p[1]:
                    walk(k, None)
            elif p[0] == s[0]:
                for k, t in zip(p[1], s[1]):
                    walk(k, t)
            else:
                for k, j in zip(p[1], self.map(p[0], s[0])):
                    walk(k, s[1][j] if j >= 0 else None)

        walk(page, seed)
        return out


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[str, int]] | None]]]:
    """Batches with columns html and seed, and the aligned texts of each row, null for a null page."""
    trees, seeds = Trees(), {}
    for batch in batches:
        if trees.full() or len(seeds) > 2000:
            trees, seeds = Trees(), {}
        out: list = []
        for page, seed in zip(batch.column("html").to_pylist(), batch.column("seed").to_pylist()):
            if page is None:
                out.append(None)
                continue
            tree = None
            if seed is not None:
                tree = seeds.get(seed)
                if tree is None:
                    tree = seeds[seed] = trees.number(trees.load(seed))
            out.append(trees.align(trees.parse(page), tree))
        yield batch, out


def _folded(trees: Trees, held: dict[str, int], rows: Iterator[tuple[str, Callable[[], int]]]) -> None:
    """Graft the trees of rows into those of their hosts."""
    for host, shape in rows:
        if trees.full():
            stored = {h: trees.dump(s) for h, s in held.items()}
            trees.clear()
            held.update({h: trees.load(s)[0] for h, s in stored.items()})
        new = shape()
        held[host] = trees.graft(held[host], new) if host in held else new


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees, held = Trees(), {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([trees.dump(s) for s in held.values()], pa.string())], ["host", "seed"])

    for batch in batches:
        pages = zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())
        _folded(trees, held, ((h, lambda page=page: trees.parse(page)[0]) for h, page in pages))
        if len(held) > BROADCAST_HOSTS:
            yield out()
            held.clear()
    yield out()


def _merge(parts: pa.Table) -> pa.Table:
    trees, held = Trees(), {}
    host = parts["host"][0].as_py()
    stored = sorted(parts["seed"].to_pylist(), key=lambda s: (-len(s), s))
    _folded(trees, held, ((host, lambda s=s: trees.load(s)[0]) for s in stored))
    return pa.table({"host": pa.array([host], pa.string()), "seed": pa.array([trees.dump(held[host])], pa.string())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows in _aligned(batches):
        seen: Counter = Counter()
        for host, texts in zip(batch.column("host").to_pylist(), rows):
            for t, node in texts or ():
                if node >= 0:
                    seen[host, node, _hash(t)] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["host", "node", "text", "n"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows in _aligned(batches):
        known: dict = {}
        contents, dropped = [], []
        for host, nodes, hashes, texts in zip(*(batch.column(c).to_pylist() for c in ("host", "nodes", "texts")), rows):
            constant = known.get(host)
            if constant is None:
                constant = known[host] = dict(zip(nodes or (), hashes or ()))
            kept = [t for t, node in texts or () if node not in constant or constant[node] != _hash(t)]
            contents.append(None if texts is None else "\n".join(kept))
            dropped.append(None if texts is None else len(texts) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), pa.array(contents, pa.string()), pa.array(dropped, pa.int32())], ["id", "host", "content", "template_nodes"])


def _hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pick(pages, id=id_col, url=url_col, html=html_col).select("id", F.when(host != "", host).alias("host"), "html")


def induce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", constant: float = CONSTANT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, seed, nodes, texts): the tree of all pages of each host of at least min_pages pages, and of its text nodes
    those that are template, with the hash of their text. Where several largest matches exist, the tree depends on the
    order in which pages are folded. Pages without a host or without HTML take no part; an id, null or not, plays none."""
    hosted = _hosted(pages, id_col, url_col, html_col).where("host is not null and html is not null")
    chosen = cut(hosted.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages).select("host"))
    folded = hosted.join(sized(chosen), "host", "left_semi").select("host", "html").mapInArrow(_fold, "host string, seed string")
    seeds = cut(folded.groupBy("host").applyInArrow(_merge, "host string, seed string"))
    counted = hosted.join(sized(seeds, BROADCAST_HOSTS), "host").select("host", "html", "seed").mapInArrow(_count, "host string, node int, text bigint, n bigint")
    each = counted.groupBy("host", "node", "text").agg(F.sum("n").alias("n"))
    nodes = each.groupBy("host", "node").agg(F.sum("n").alias("total"), F.max(F.struct("n", "text")).alias("top"))
    nodes = nodes.where((F.col("top.n") >= min_pages) & (F.col("top.n") >= F.col("total") * constant))
    found = nodes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "top.text"))).alias("c"))
    return cut(seeds.join(found.select("host", F.col("c.node").alias("nodes"), F.col("c.text").alias("texts")), "host", "left"))


def extract(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, content, template_nodes) for every page: its texts that are not template, a line each, and how
    many were.

    Of a page without a host, or whose host has no wrapper, all visible text is content. Scripts, styles, comments
    and the head are never content. A null page has null content, an empty one the empty text. Repeated rows
    give repeated rows, a null id stays, extra columns, whatever their names, are ignored, and an empty table
    gives an empty table. Malformed HTML is read as far as it goes.
    """
    hosted = _hosted(pages, id_col, url_col, html_col)
    kind = hosted.schema["id"].dataType.simpleString()
    joined = hosted.join(sized(wrappers, BROADCAST_HOSTS), "host", "left").select("id", "host", "html", "seed", "nodes", "texts")
    return joined.mapInArrow(_extract, f"id {kind}, host string, content string, template_nodes int").withColumnRenamed("id", id_col)
