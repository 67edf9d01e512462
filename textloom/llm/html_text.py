"""Main text of pages by wrapper induction.

A page becomes a tree of block elements whose leaves are runs of text; markup inside a run, comments, scripts and styles
go, character references are decoded, white space becomes one space. A host's pages are sorted into layouts by the
places of their leaves; a page of each of its most frequent layouts is a wrapper. Every page is aligned with the wrappers
of its host by simple tree matching: the largest set of node pairs that keeps tags, parents and the order of siblings,
where a pair of leaves with the same text counts twice if that text recurs on the host. A leaf is template where most of the host's different pages have the same text at what is aligned with the same leaf of a
wrapper; slots that vary are content.

Menus, forms, adverts, notices and comments that vary from page to page go by their tags, roles or whole class names.
Where a page marks its article, only leaves in it count.

A page of which template would leave nothing (a copy of other pages' article) keeps its text. A null or empty html gives
the empty text; a null url is a host of its own; pages of one host only need no others. Repeated rows are each extracted.
Extra columns are not read. An empty table gives no rows. Depth and number of elements are not limited: trees are walked
without recursion, and lists of siblings of any length are matched in full, by vectors.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.hashing import chunks
from textloom.session import written

#: A leaf is template where its text is found on this share of the host's different pages, MIN_PAGES at least.
SHARE, MIN_PAGES = 0.6, 3
#: Wrappers of a host: one page of each of so many layouts, the most frequent ones.
WRAPPERS = 3
#: Labels that a subtree lists; one of more may share a label with any that has some, which costs time only.
LISTED = 8
#: An article element within an element that is merely called content is the article if it holds this share of the text.
INNER_SHARE = 0.7
#: Tables by host are broadcast up to so many bytes, after a sum of their sizes.
FEW_BYTES = 32 << 20

# Fixed tables of HTML: what the elements are.
BLOCKS = frozenset(
    "html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption"
    " nav header footer aside form fieldset address details summary dialog menu hgroup search center title hr".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("head nav footer aside form dialog menu button select textarea iframe object canvas svg math audio video template noscript search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag of the key ends, if it is the innermost open block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu menubar toolbar".split())
# Class and id names of what is not article text, alone or with a word for a part of a page.
_NAMES = (
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar breadcrumb breadcrumbs nav navbar navigation menu cookie cookies consent"
    " gdpr comment comments respond disqus discussion replies related recommended recommendations share sharing social subscribe subscription newsletter popup modal overlay footer"
    " masthead toolbar widget login signup search pagination pager paywall copyright disclaimer"
)
_PARTS = "box block list links link bar banner section area wrap wrapper container widget unit slot panel form button buttons icons notice message thread item inner body header title text content menu"
NOISE = re.compile(rf"(?:^|\s)(?:{'|'.join(_NAMES.split())})(?:[-_]+(?:{'|'.join(_PARTS.split())}|\d+))*(?:\s|$)", re.I)
BODY_WORDS = re.compile(r"(?:^|[-_\s])(?:article|post|entry|story|content|main)[-_]?(?:body|content|text|main)?(?:$|[-_\s])", re.I)
_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.I | re.S)
_TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"\s+")


class Mark(int):
    """The number of a marked element, negative for marks other than the article tag, with what it is called."""

    kind: str


class Leaf:
    __slots__ = ("text", "place", "where", "links", "top")

    def __init__(self, place: int, where: tuple[int, ...] | None, text: str, links: float, top: bool):
        #: place: hash of the tags from the root on; top: in an h1.
        self.place, self.where, self.text, self.links, self.top = place, where, text, links, top


def _noise(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROPPED or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return tag not in ("html", "body", "article", "main") and names != " " and bool(NOISE.search(names))


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}


def parse(page: str) -> tuple[list, list[Leaf]]:
    """(tree, leaves). A node is [tag, children]; a leaf in it is its number. Leaf.where: None for noise, else the numbers
    of the marked elements around it from outside in, negative ones for marks other than the article tag."""
    root: list = ["#root", []]
    # Open blocks: (tag, node, noise, marked elements, inside a header, place, inside a heading)
    stack: list = [("#root", root, False, (), False, 0, False)]
    leaves: list[Leaf] = []
    # Elements within text that are noise, by tag: how many of that tag are open in the innermost one.
    inline: dict[str, list[int]] = {}
    held: list[str] = []
    linked, in_link, articles = 0, 0, 0

    def flush():
        nonlocal linked
        if held:
            text = _BLANK.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                tag, node, noise, marks, head, place, heading = stack[-1]
                kept = not noise and (not head or heading)
                node[1].append(len(leaves))
                leaves.append(Leaf(place, marks if kept else None, text, linked / max(len(text), 1), tag == "h1"))
            held.clear()
        linked = 0

    for close, name, rest, text in _TOKEN.findall(_GONE.sub("", page)):
        if not name:
            held.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        tag = name.lower()
        if tag == "a":
            in_link = 0 if close else 1
        if tag in ("br", "wbr", "img", "input"):
            held.append(" " if tag == "br" else "")
        if tag not in BLOCKS and tag not in DROPPED:
            if tag in VOID:
                continue
            if inline.get(tag):
                inline[tag][-1] += -1 if close else 1
                if inline[tag][-1]:
                    continue
                inline[tag].pop()
            elif close or not rest.strip(" /") or rest.endswith("/") or not _noise(tag, _attributes(rest)):
                continue
            else:
                inline.setdefault(tag, []).append(1)
        flush()
        if close:
            open_at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if open_at:
                for gone in stack[open_at:]:
                    if inline.get(gone[0]) and gone[0] != tag:
                        inline[gone[0]].clear()
                del stack[open_at:]
            continue
        attributes = _attributes(rest)
        if stack[-1][0] == "p" or stack[-1][0] in HEADINGS and tag in HEADINGS or stack[-1][0] in CLOSES.get(tag, ()):
            stack.pop()
        _, parent, noise, marks, head, place, heading = stack[-1]
        marked = tag in ("article", "main") or attributes.get("itemprop") == "articleBody" or attributes.get("role") in ("main", "article")
        marked = marked or tag in ("div", "section") and bool(BODY_WORDS.search(f"{attributes.get('class', '')} {attributes.get('id', '')}"))
        noise = noise or _noise(tag, attributes)
        if marked and not noise:
            articles += 1
            mark = Mark(articles if tag == "article" else -articles)
            named = BODY_WORDS.search(f"{attributes.get('class', '')} {attributes.get('id', '')}")
            mark.kind = f"{tag} {re.split('[-_]', named.group().strip('-_ \t\r\n').lower())[0] if named else ''}"
            marks = (*marks, mark)
        node = [tag, []]
        parent[1].append(node)
        if tag not in VOID:
            stack.append((tag, node, noise, marks, head or tag == "header", _code(f"{place} {tag}"), heading or tag in HEADINGS))
    flush()
    return root, leaves


def main_leaves(leaves: list[Leaf]) -> list[int]:
    """Numbers of the leaves that may be article text: those of the outer marked element that holds most text and of all
    others of its kind, as parts of one text; of an article element in it, with the first heading beside it, where that
    holds the text. Separate article elements are separate articles. Without marks all but noise and link lists."""
    size: dict[Mark, int] = {}
    inner: dict[Mark | int, set[Mark]] = {}
    for leaf in leaves:
        for i, mark in enumerate(leaf.where or ()):
            size[mark] = size.get(mark, 0) + len(leaf.text)
            inner.setdefault(leaf.where[i - 1] if i else 0, set()).add(mark)
    if not size:
        return [i for i, leaf in enumerate(leaves) if leaf.where == () and leaf.links < 0.6]
    most = lambda marks: max(marks, key=lambda m: (size[m], -abs(m)))
    at, around = most(inner[0]), set()
    parts = {m for m in inner[0] if m < 0 and m.kind == at.kind} | {at}
    total = sum(size[m] for m in parts)
    # What is merely called content is left only for an article element, at any depth of such marks.
    below, todo = set(), [m for m in parts if m < 0]
    outer: dict[Mark, tuple] = {m: (m,) for m in todo}
    while todo:
        mark = todo.pop()
        for m in inner.get(mark, ()):
            if m > 0:
                below.add(m)
            else:
                todo.append(m)
            outer[m] = (*outer[mark], m)
    if below and size[most(below)] >= INNER_SHARE * total:
        at = most(below)
        parts, around = {at}, set(outer[at][:-1])
    heading = lambda leaf: leaf.top and bool(leaf.where) and leaf.where[-1] in around
    return [i for i, leaf in enumerate(leaves) if leaf.where and (not parts.isdisjoint(leaf.where) or heading(leaf))]


def _code(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


class Tree:
    """A page's shape: for each node in order its tag and its children; leaves of text have the tag `#`, and a label after
    it in the shape where their text recurs."""

    def __init__(self, shape: str):
        self.tags, self.children, self.tokens = ["#root"], [[]], ["#root"]
        open_ = [0]
        for token in shape.split():
            if token == "/":
                open_.pop()
                continue
            self.children[open_[-1]].append(len(self.tags))
            if token[0] != "#":
                open_.append(len(self.tags))
            self.tags.append("#" if token[0] == "#" else token)
            self.tokens.append(token)
            self.children.append([])
        # What a subtree weighs when matched with an equal one, and its code; nodes and code of the subtree without labels.
        self.size, self.code = [1 + (t[0] == "#" and 1 < len(t) and t != "#root") for t in self.tokens], [0] * len(self.tags)
        self.count, self.bare = [1] * len(self.tags), [0] * len(self.tags)
        #: Labels of a subtree, None for more than LISTED.
        self.labels: list = [frozenset([t] if size > 1 else ()) for t, size in zip(self.tokens, self.size, strict=True)]
        for n in range(len(self.tags) - 1, -1, -1):  # children have larger numbers
            below = self.children[n]
            self.size[n] += sum(self.size[c] for c in below)
            self.count[n] += sum(self.count[c] for c in below)
            self.code[n] = hash((self.tokens[n], tuple(self.code[c] for c in below)))
            self.bare[n] = hash((self.tags[n], tuple(self.bare[c] for c in below)))
            for c in below:
                both = None if self.labels[n] is None or self.labels[c] is None else self.labels[n] | self.labels[c]
                self.labels[n] = both if both is None or len(both) <= LISTED else None
        #: Number among the leaves of each leaf node.
        self.leaf = {n: i for i, n in enumerate(n for n, t in enumerate(self.tags) if t == "#")}


def shape_of(root: list) -> str:
    """The tree in one line: tags that open, `/` that closes, `#` for text."""
    out, todo = [], list(reversed(root[1]))
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out.append("#")
        elif node == "/":
            out.append("/")
        else:
            out.append(node[0])
            todo.append("/")
            todo.extend(reversed(node[1]))
    return " ".join(out)


def labelled(shape: str, labels: list[int], recurring: frozenset[int]) -> str:
    """The shape with the labels of its leaves that recur."""
    if recurring.isdisjoint(labels):
        return shape
    each = iter(labels)
    return " ".join(f"#{c}" if t == "#" and (c := next(each)) in recurring else t for t in shape.split())


def _share(one: frozenset | None, other: frozenset | None) -> bool:
    """Whether two subtrees may have a label in common."""
    if one is None or other is None:
        return one != frozenset() and other != frozenset()
    return not one.isdisjoint(other)


def _kinds(codes: list[int], nodes: list[int]) -> tuple[list[int], list[int]]:
    """(one node of each code, the number of each node's code)."""
    numbers: dict[int, int] = {}
    which = [numbers.setdefault(codes[n], len(numbers)) for n in nodes]
    first = dict(zip(reversed(which), reversed(nodes), strict=True))
    return [first[k] for k in range(len(numbers))], which


def _heaviest(m: int, n: int, row: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of the heaviest matching of two sequences that keeps order, last ones first; row(i): weights of i with all of the
    other. Of the table every isqrt(m)-th row is kept, and those between are made again on the way back."""
    step = isqrt(m) + 1

    def after(best: np.ndarray, i: int) -> np.ndarray:
        new = best.copy()
        np.maximum(new[1:], best[:-1] + row(i), out=new[1:])
        return np.maximum.accumulate(new, out=new)

    kept = [best := np.zeros(n + 1, np.int32)]
    for i in range((m - 1) // step * step):
        best = after(best, i)
        if (i + 1) % step == 0:
            kept.append(best)
    out, i, j = [], m, n
    while i and j:
        low = (i - 1) // step * step
        table = [kept[low // step]]
        for k in range(low, i):
            table.append(after(table[-1], k))
        while i > low and j:
            here = table[i - low][j]
            if here == table[i - low - 1][j]:
                i -= 1
            elif here == table[i - low][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
    return out


def _siblings(a: Tree, b: Tree, x: int, y: int, bare: bool, weigh, need: list) -> list[tuple[int, int]]:
    """Pairs of children of x and y of the heaviest matching that keeps their order; none if `need` says that weights lack.
    Equal subtrees at both ends belong to some heaviest matching; what is between is found by the usual table. Subtrees
    without a common label weigh what they weigh without labels."""
    one, other = (a.bare, b.bare) if bare else (a.code, b.code)
    left, right = a.children[x], b.children[y]
    first, m, n, out = 0, len(left), len(right), []
    while first < m and first < n and one[left[first]] == other[right[first]]:
        out.append((left[first], right[first]))
        first += 1
    while m > first and n > first and one[left[m - 1]] == other[right[n - 1]]:
        m, n = m - 1, n - 1
        out.append((left[m], right[n]))
    left, right = left[first:m], right[first:n]
    if not left or not right:
        return out
    (mine, left_kind), (theirs, right_kind) = _kinds(one, left), _kinds(other, right)
    (my_bare, left_bare), (their_bare, right_bare) = _kinds(a.bare, mine), _kinds(b.bare, theirs)
    weights = np.array([[weigh(u, v, True, need) for v in their_bare] for u in my_bare], np.int32)
    known: list = [([], [])] * len(mine)
    if not bare:
        # Which kinds have a label, and which more than are listed.
        having: dict[str, list[int]] = {}
        some, many = [], []
        for k, v in enumerate(theirs):
            if b.labels[v] is None:
                many.append(k)
            elif b.labels[v]:
                some.append(k)
            for label in b.labels[v] or ():
                having.setdefault(label, []).append(k)
        for k, u in enumerate(mine):
            if a.labels[u] is None:
                near = some + many
            elif a.labels[u]:
                near = list({j for label in a.labels[u] for j in having.get(label, ())}) + many
            else:
                continue
            known[k] = near, [weigh(u, theirs[j], False, need) for j in near]
    if need:
        return []
    right_kind, right_bare = np.array(right_kind), np.array(right_bare)

    def row(i: int) -> np.ndarray:
        k = left_kind[i]
        by_kind = weights[left_bare[k]].take(right_bare)
        by_kind[known[k][0]] = known[k][1]
        return by_kind.take(right_kind)

    return out + [(left[i], right[j]) for i, j in _heaviest(len(left), len(right), row)]


def match_trees(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: node of a -> node of b, the heaviest set of pairs of equal tags under paired parents."""
    codes: dict[tuple[int, int], int] = {}

    def code(u, v, bare):
        return (a.bare[u], b.bare[v]) if bare else (a.code[u], b.code[v])

    def weigh(u, v, bare, need):
        """The weight of the matching of two subtrees, known or simple; else what must be found first."""
        if a.tags[u] != b.tags[v]:
            return 0
        bare = bare or not _share(a.labels[u], b.labels[v])
        key = code(u, v, bare)
        if key[0] == key[1]:
            return a.count[u] if bare else a.size[u]
        if not a.children[u] or not b.children[v]:
            return 1
        if key not in codes:
            need.append((u, v, bare))
        return codes.get(key, 0)

    def pairs_of(u, v):
        """Paired children, after the weights of all pairs of subtrees that they need."""
        todo = [(u, v, False)]
        while True:
            x, y, bare = todo[-1]
            need: list = []
            pairs = _siblings(a, b, x, y, bare, weigh, need)
            total = 1 + sum(weigh(p, q, bare, need) for p, q in pairs)
            if need:
                todo.extend(dict.fromkeys(need))
                continue
            if len(todo) == 1:
                return pairs
            codes[code(x, y, bare)] = total
            todo.pop()
            while len(todo) > 1 and code(*todo[-1]) in codes:
                todo.pop()

    out, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        if a.code[x] == b.code[y]:
            todo.extend(zip(a.children[x], b.children[y], strict=True))
        elif a.children[x] and b.children[y]:
            todo.extend(pairs_of(x, y))
    return out


class Aligner:
    """Leaves of pages by their place in wrappers, with a bounded memory of pairs of shapes."""

    KEPT = 1 << 12

    def __init__(self):
        self.trees: dict[str, Tree] = {}
        self.known: dict[tuple[str, str], list[int]] = {}

    def _tree(self, shape: str) -> Tree:
        if shape not in self.trees:
            if len(self.trees) >= self.KEPT:
                self.trees.clear()
            self.trees[shape] = Tree(shape)
        return self.trees[shape]

    def places(self, shape: str, wrapper: str) -> list[int]:
        """For each leaf of the page the wrapper's leaf that it is aligned with, -1 for none."""
        if (shape, wrapper) not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            a, b = self._tree(shape), self._tree(wrapper)
            pairs = match_trees(a, b)
            self.known[shape, wrapper] = [b.leaf.get(pairs.get(n, -1), -1) for n in a.leaf]
        return self.known[shape, wrapper]


PARSED = "page_id long, url string, host string, shape string, layout long, texts array<string>, leaves array<int>, labels array<long>, print long"


def parsed(pages: DataFrame) -> DataFrame:
    """Each page's shape, and its leaves that may be article text with their numbers among all leaves."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("host", F.lower(F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.lit(""))))
    rows = pages.select("page_id", "url", "host", "html")

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for first, last in chunks(columns[3]):
                shapes, layouts, texts, numbers, labels, prints = [], [], [], [], [], []
                for page in columns[3][first:last]:
                    root, leaves = parse(page)
                    numbers.append(main_leaves(leaves))
                    shapes.append(shape_of(root))
                    layouts.append(_code(" ".join(map(str, sorted({leaf.place for leaf in leaves})))))
                    texts.append([leaves[i].text for i in numbers[-1]])
                    labels.append([_code(leaf.text) for leaf in leaves])
                    prints.append(_code("\n".join(texts[-1])))
                some = [batch.column(c).slice(first, last - first) for c in range(3)]
                kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
                made = [pa.array(c, k) for c, k in zip((shapes, layouts, texts, numbers, labels, prints), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(some + made, [c.split()[0] for c in PARSED.split(", ")])

    return rows.mapInArrow(run, PARSED)


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, wrappers): shapes of a page of each of the most frequent layouts, for hosts of MIN_PAGES different pages."""
    layouts = rows.groupBy("host", "layout").agg(F.count_distinct("print").alias("n"), F.min_by(F.struct("shape", "labels"), F.struct("page_id", "shape", "print")).alias("page"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "layout"))
    every = F.sum("n").over(Window.partitionBy("host"))
    most = layouts.withColumn("rank", rank).withColumn("all", every).where((F.col("rank") <= WRAPPERS) & (F.col("all") >= MIN_PAGES))
    return most.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"]).alias("wrappers"))


def _by_host(rows: DataFrame, table: DataFrame, size: Column) -> DataFrame:
    small = (table.agg(F.sum(size)).first()[0] or 0) <= FEW_BYTES
    return rows.join(F.broadcast(table) if small else table, "host", "left")


ALIGNED = "page_id long, url string, host string, texts array<string>, codes array<array<long>>, print long"


def recurring(rows: DataFrame, column: Column, name: str, prints: DataFrame) -> DataFrame:
    """(host, name): the codes that most of the host's different pages have, MIN_PAGES at least. Copies of a page are one.

    prints: (host, pages), how many different ones. At most as many codes a host as 1 / SHARE times what one page has."""
    codes = rows.select("host", "print", F.explode(F.array_distinct(column)).alias("code")).distinct()
    counts = codes.groupBy("host", "code").agg(F.count("*").alias("c")).where(F.col("c") >= MIN_PAGES)
    return counts.join(prints, "host").where(F.col("c") >= SHARE * F.col("pages")).groupBy("host").agg(F.collect_list("code").alias(name))


def aligned(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The pages with, for each of their leaves, codes of text and place in each wrapper of the host that has a place for it.

    table: (host, wrappers, labels that recur)."""
    both = _by_host(rows, table, F.aggregate("wrappers", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x["shape"]) + 8 * F.size(x["labels"])))

    def run(batches):
        aligner = Aligner()
        for batch in batches:
            codes = []
            for shape, texts, leaves, own, some, again in zip(*(batch.column(c).to_pylist() for c in ("shape", "texts", "leaves", "labels", "wrappers", "again")), strict=True):
                again = frozenset(again or ())
                # Without a text that recurs there is no template, so there is nothing to align.
                places = [aligner.places(labelled(shape, own, again), labelled(w["shape"], w["labels"], again)) for w in some or []] if again else []
                codes.append([[_code(f"{k} {p[leaf]}\n{text}") for k, p in enumerate(places) if p[leaf] >= 0] for text, leaf in zip(texts, leaves, strict=True)])
            columns = [batch.column(c) for c in ("page_id", "url", "host", "texts")] + [pa.array(codes, pa.list_(pa.list_(pa.int64()))), batch.column("print")]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])

    return both.mapInArrow(run, ALIGNED)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    rows = written(parsed(pages), "parsed")
    prints = written(rows.select("host", "print").distinct().groupBy("host").agg(F.count("*").alias("pages")), "prints")
    again = recurring(rows, F.col("labels"), "again", prints)
    table = written(wrappers(rows).join(again, "host"), "wrappers")
    # Aligned twice, for the counts and for the result: storing texts and codes again would cost more than the time.
    places = aligned(rows, table)
    fixed = written(recurring(places, F.flatten("codes"), "fixed", prints), "templates")
    both = _by_host(places, fixed, 8 * F.size("fixed"))
    pairs = F.arrays_zip("texts", "codes")
    kept = F.transform(F.filter(pairs, lambda x: ~F.arrays_overlap(F.col("fixed"), x["codes"])), lambda x: x["texts"])
    part = F.when(F.col("fixed").isNotNull(), F.array_join(kept, "\n"))
    text = F.when(part != "", part).otherwise(F.array_join("texts", "\n"))
    out = both.select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
