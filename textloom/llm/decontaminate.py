"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Text is taken as a sequence of words (ASCII letters and digits and all non-ASCII characters, lower-cased). A document
leaks an item where some run of its words is within floor(TOLERANCE * words of the item) word edits of the
whole item. A null, empty or wordless text leaks nothing; a null, empty or wordless item is leaked by nothing; equal
items are reported each; repeated rows are each reported once per item. Extra columns are not read. Empty tables give
no rows.

Items are held in groups by length, from a power of two to the next. Windows of a group start at every STRIDE-th part of
its least length, at every word for short items, all over every text. The CGK walk turns a window into symbols: step j
emits the word under the pointer, whose hash with j says whether the pointer moves on; pointers of two near sequences part
at an edit and meet again, so that edits become few differing places. Keys of a few sampled places, drawn for many walks
and tables, meet the items' keys; where the two walks agree on at least AGREE of the places, the words around the window
are checked by exact edit distance. Windows are no longer than LONGEST words: a longer item is searched by its pieces of
that length, one of which has no more than its share of the edits, and checked as a whole.

Candidates come from no other place. An exact copy is always found where windows start at every word, else with the
recall of its nearest window; README has measured recall. No document is shuffled; the benchmark is read in blocks of
bounded size, each a pass over the documents.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.session import written

TOLERANCE = 0.2
#: Walks, tables per walk, places per table.
WALKS, TABLES, PLACES = 8, 8, 3
#: Steps of the walk in least lengths of the group: early places lie after few edits.
REACH = 1.0
#: Share of the places of a walk that must agree before edits are counted.
AGREE = 0.25
#: Windows start at every so-manieth part of the group's least length.
STRIDE = 8
LONGEST = 64
#: Words that a window may stand off an item's place beside what its edits allow.
SLACK = 16
#: Characters of benchmark text held at a time.
BLOCK_CHARS = 32 << 20
#: Windows, and meetings of windows with items, that are looked at together.
PART, MEETINGS = 1 << 14, 1 << 16
#: The matcher of a worker process, kept from task to task.
_MATCHERS: dict = {}
FOUND = "doc_id long, item_id long, start_word long, n_edits long, n_item_words long"


def allowed(length: int) -> int:
    return int(TOLERANCE * length + 1e-9)


class _Group:
    """Items of similar length: their walks and keys."""

    def __init__(self, low: int, items: list[tuple[int, int, np.ndarray]], limits: list[int]):
        """items: (item, offset of the piece in it, words); limits: edits allowed to each one's item."""
        self.low, self.stride = low, max(1, low // STRIDE)
        self.steps = max(1, int(REACH * low))
        self.item = np.array([i for i, _, _ in items], np.int64)
        self.offset = np.array([o for _, o, _ in items], np.int64)
        # Bits of a piece's words, and how many of them may be missing: the piece's share is not known, so the item's edits.
        self.marks = np.stack([np.bitwise_or.reduce(_bits(w), axis=0) for _, _, w in items])
        self.most = np.array(limits, np.int64)
        self.slack = int(self.most.max(initial=0)) + SLACK if low < LONGEST else low
        # Pieces one after the other; a walk that runs over its end meets zeros.
        gap = np.zeros(self.steps, np.uint32)
        flat = np.concatenate([part for _, _, w in items for part in (_short(w), gap)])
        starts = np.cumsum([0] + [len(w) + self.steps for _, _, w in items])[:-1]
        self.walks = np.stack([self.walk(flat, starts, walk) for walk in range(WALKS)])
        self.bits = int(np.clip(np.log2(len(items)) + 7, 12, 24))
        self.sampled = [self.samples(table) for table in range(WALKS * TABLES)]
        # By table which first bits of keys there are; by walk the keys of its tables in order, a table's number above each.
        self.firsts, self.tables = [], []
        for walk in range(WALKS):
            found = [self.key(self.walks[walk], table, np.empty(len(items), np.uint32)) for table in range(walk * TABLES, (walk + 1) * TABLES)]
            for keys in found:
                self.firsts.append(np.zeros(1 << self.bits, bool))
                self.firsts[-1][keys >> np.uint32(32 - self.bits)] = True
            stored = np.concatenate([_of_table(keys, table) for table, keys in enumerate(found)])
            order = np.argsort(stored, kind="stable")
            self.tables.append((stored[order], order % len(items)))

    def meetings(self, walk: int, symbols: np.ndarray) -> Iterator[np.ndarray]:
        """window * pieces + piece, for windows that have a piece's key and a walk that agrees with the piece's."""
        stored, order = self.tables[walk]
        n = symbols.shape[1]
        # Rows of whole eights of windows, so that those without a key are passed over by eights.
        keys, has = np.empty((TABLES, n + -n % 8), np.uint32), np.zeros((TABLES, n + -n % 8), bool)
        for table in range(TABLES):
            key = self.key(symbols, walk * TABLES + table, keys[table, :n])
            self.firsts[walk * TABLES + table].take(key >> np.uint32(32 - self.bits), mode="clip", out=has[table, :n])
        eights = np.flatnonzero(has.view(np.uint64))
        which, one = np.nonzero(has.reshape(-1, 8)[eights])
        where = eights[which] * 8 + one
        table, some = np.divmod(where, has.shape[1])
        keys = _of_table(keys.ravel()[where], table)
        left = np.searchsorted(stored, keys)
        real = stored.take(left, mode="clip") == keys
        some, keys, left = some[real], keys[real], left[real]
        n = np.searchsorted(stored, keys, "right") - left
        ends = np.cumsum(n)
        for low in range(0, int(ends[-1]) if len(ends) else 0, MEETINGS):
            pair = np.arange(low, min(low + MEETINGS, int(ends[-1])))
            of = np.searchsorted(ends, pair, "right")
            window, piece = some[of], order[left[of] + pair - (ends[of] - n[of])]
            near = (symbols.take(window, axis=1) == self.walks[walk].take(piece, axis=1)).sum(axis=0, dtype=np.uint8) >= AGREE * self.steps
            yield window[near] * len(self.item) + piece[near]

    def walk(self, words: np.ndarray, starts: np.ndarray, walk: int) -> np.ndarray:
        """(steps, windows): CGK symbols of the windows from `starts` on; words reach on by as many as there are steps."""
        moves = (H.mix(np.arange(self.steps, dtype=np.uint64), 1000 + walk) >> np.uint64(33)).astype(np.uint32) | np.uint32(1)
        out, at, turn = np.empty((self.steps, len(starts)), np.uint32), starts.astype(np.int32), np.empty(len(starts), np.uint32)
        for symbol, move in zip(out, moves, strict=True):
            words.take(at, out=symbol, mode="clip")
            np.multiply(symbol, move, out=turn)
            np.right_shift(turn, 31, out=turn)
            np.add(at, turn.view(np.int32), out=at)
        return out

    def samples(self, table: int) -> list[tuple[int, np.uint32]]:
        """Sampled places of a table, with a factor each."""
        number = np.arange(PLACES, dtype=np.uint64) + np.uint64(table * PLACES)
        places = np.unique((H.mix(number, 5000).astype(np.float64) / 2.0**64 * self.steps).astype(np.int64)).tolist()
        return list(zip(places, (H.mix(number, 9) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), strict=False))

    def key(self, symbols: np.ndarray, table: int, out: np.ndarray) -> np.ndarray:
        """Hash of the sampled places of each walk."""
        (place, factor), *more = self.sampled[table]
        np.multiply(symbols[place], factor, out=out)
        for place, factor in more:
            out += symbols[place] * factor
        return out


def _of_table(keys: np.ndarray, table: int | np.ndarray) -> np.ndarray:
    """Keys with the number of their table above."""
    return keys.astype(np.int64) | (table << 32)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct values of the parts."""
    values = np.sort(np.concatenate(parts))
    return values[np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]])]


def _bits(words: np.ndarray) -> np.ndarray:
    """(words, 4): one bit of 256 for each word."""
    out = np.zeros((len(words), 4), np.uint64)
    out[np.arange(len(words)), (words & np.uint64(3)).astype(np.int64)] = np.uint64(1) << ((words >> np.uint64(2)) & np.uint64(63))
    return out


def _short(words: np.ndarray) -> np.ndarray:
    """Words as 32-bit symbols."""
    return (words >> np.uint64(32)).astype(np.uint32)


def least_edits(item: list[int], text: list[int]) -> tuple[int, int]:
    """(edits, end) of the run of `text` nearest to `item`, by Myers' bit vectors."""
    m = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text, 1):
        eq = places.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(xv | up)), up & xv
        if score < best[0]:
            best = (score, j)
    return best


class Matcher:
    """A block of items, by groups of length."""

    def __init__(self, items: list[tuple[int, str | None]]):
        words, at = H.words_by_text([t and t.lower() for _, t in items], H.MARKS)
        kept = [(i, words[at[n] : at[n + 1]]) for n, (i, _) in enumerate(items) if at[n + 1] > at[n]]
        self.ids = [i for i, _ in kept]
        self.lists = [w.tolist() for _, w in kept]
        self.sets = [frozenset(w) for w in self.lists]
        self.lengths = np.array([len(w) for _, w in kept], np.int64)
        groups = defaultdict(list)
        for n, (_, w) in enumerate(kept):
            size = min(len(w), LONGEST)
            for offset in [*range(0, len(w) - size, LONGEST), len(w) - size] if len(w) > size else [0]:
                groups[1 << size.bit_length() - 1].append((n, offset, w[offset : offset + size]))
        self.groups = [_Group(low, pieces, [allowed(len(self.lists[n])) for n, _, _ in pieces]) for low, pieces in sorted(groups.items())]

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item number, first word, edits) of the best place of each item in each text."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for first, last in H.chunks(texts):
            words, at = H.words_by_text([t and t.lower() for t in texts[first:last]], H.MARKS)
            if self.ids and len(words):
                self._find(words, at, first, out)
        return [(row, item, start, edits) for (row, item), (edits, start) in out.items()]

    def _find(self, words: np.ndarray, at: np.ndarray, base: int, out: dict) -> None:
        marks = _bits(words)
        for group in self.groups:
            flat = np.concatenate([_short(words), np.zeros(group.steps, np.uint32)])
            every = np.arange(0, len(words), group.stride)
            for part in range(0, len(every), PART):
                starts = every[part : part + PART]
                met, new = [np.zeros(0, np.int64)], 0
                for walk in range(WALKS):
                    for found in group.meetings(walk, group.walk(flat, starts, walk)):
                        met.append(found)
                        new += len(found)
                        if new > max(MEETINGS, len(met[0])):
                            met, new = [_distinct(met)], 0
                if len(met := _distinct(met)):
                    self._verify(self._likely(group, met, starts, marks, at), words, at, base, out)

    def _likely(self, group: _Group, met: np.ndarray, starts: np.ndarray, marks: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, where the item begins by the window) of the meetings that words allow: an item's word that is not
        around the window is an edit, and a bit that no word there has is such a word's."""
        out: set[tuple[int, int, int]] = set()
        begin, width = int(starts[0]) - group.slack, 2 * (group.low + group.slack)
        # Bits of the words around every place, by halves that overlap; at the ends of the words fewer are there.
        last = int(starts[-1]) + group.low * 2 + group.slack
        near = np.concatenate([np.zeros((max(-begin, 0), 4), np.uint64), marks[max(begin, 0) : last], np.zeros((max(last - len(marks), 0), 4), np.uint64)])
        size = 1
        while 2 * size <= width:
            near = near[:-size] | near[size:]
            size *= 2
        windows = _distinct([met // len(group.item)])
        for first in range(0, len(windows), 1 << 10):
            some = windows[first : first + (1 << 10)]
            place = starts[some] - starts[0]
            around = near[place] | near[place + (width - size)]
            low, high = np.searchsorted(met, [some[0] * len(group.item), (some[-1] + 1) * len(group.item)])
            for part in range(low, high, MEETINGS):
                codes = met[part : min(part + MEETINGS, high)]
                window, piece = np.divmod(codes, len(group.item))
                lacking = np.bitwise_count(group.marks[piece] & ~around[np.searchsorted(some, window)]).sum(axis=1, dtype=np.int64)
                keep = lacking <= group.most[piece]
                window, piece = window[keep], piece[keep]
                row = np.searchsorted(at, starts[window], "right") - 1
                out.update(zip(row.tolist(), group.item[piece].tolist(), (starts[window] - group.offset[piece]).tolist(), strict=True))
        return sorted(out)

    def _verify(self, todo: list[tuple[int, int, int]], words: np.ndarray, at: np.ndarray, base: int, out: dict) -> None:
        """Counts edits; places of one item that lie close together in a text are checked as one stretch of words."""
        n = 0
        while n < len(todo):
            r, i, low = todo[n]
            length = int(self.lengths[i])
            high, n = low, n + 1
            while n < len(todo) and todo[n][:2] == (r, i) and todo[n][2] <= high + length:
                high, n = todo[n][2], n + 1
            k = allowed(length)
            first, last = max(low - k - SLACK, int(at[r])), min(high + length + k + SLACK, int(at[r + 1]))
            if last - first < length - k:
                continue
            stretch = words[first:last].tolist()
            if len(self.sets[i].intersection(stretch)) < len(self.sets[i]) - k:
                continue  # each word that is not there is an edit
            edits, end = least_edits(self.lists[i], stretch)
            if edits <= k:
                new = (edits, max(first + end - length, int(at[r])) - int(at[r]))
                out[r + base, i] = min(out.get((r + base, i), new), new)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = size // BLOCK_CHARS + 1
    for b in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def _matcher(key: str, items: list[tuple[int, str]]) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items)
    return _MATCHERS[key]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_edits, n_item_words), one row per document row and leaked item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one(items):
        key = uuid.uuid4().hex

        def run(batches):
            matcher = _matcher(key, items)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = matcher.find(batch.column(1).to_pylist())
                out = [(ids[r], matcher.ids[i], start, edits, int(matcher.lengths[i])) for r, i, start, edits in found]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

        return rows.mapInArrow(run, FOUND)

    blocks = _blocks(benchmark)
    out, more = one(next(blocks)), next(blocks, None)
    while more is not None:
        # Each further block is matched before the next one is read, so that the driver holds one.
        out, more = written(out, "leaks").unionByName(written(one(more), "leaks")), next(blocks, None)
    return out


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, all columns; rows stay where they are."""

    def one(docs, items):
        key = uuid.uuid4().hex

        def run(batches):
            matcher = _matcher(key, items)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                bad = {r for r, *_ in matcher.find(texts)}
                yield batch.filter(pa.array([r not in bad for r in range(len(texts))], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    blocks = _blocks(benchmark)
    out, more = one(docs, next(blocks)), next(blocks, None)
    while more is not None:  # as in leaks(): the driver holds one block
        out, more = one(written(out, "clean"), more), next(blocks, None)
    return out
