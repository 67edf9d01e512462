"""Adaptive context-mixing range coder of token ids: many blocks in step, each with statistics of its own from nothing.

An id is a number in its block: the order of first appearance there. Three models give probabilities of the next number:
order 0 by counts of the block so far, with the share of numbers seen once for an id that is new to the block; order 1
and order 2 by records of what followed the last and the last two ids, the two likeliest followers with counts each. The
probability coded is the weighted sum of the three. Weights are the models' shares in what was coded so far, by how much
the two records have seen; like counts and records they change with every id.

The range is split by the mixed probabilities of the up to four recorded followers; what is left goes to the
others by order 0. A new id adds the class of its size, by counts, and its place in the class. Counts
and intervals are integers, and weights know only sums, products and quotients of doubles, rounded alike everywhere; so
every machine decodes what any other coded. Each step treats one id of each block, as vectors.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block at most, and ids in all.
BLOCK_TOKENS = 4096
IDS = 1 << 16
#: Slots of a block's order-2 records.
SLOTS = 1 << 12
#: Bits of the split between recorded followers and the others.
SPLIT_BITS = 16
_SPLIT = np.uint64(SPLIT_BITS)
_MASK48, _LEAST, _WORD = np.uint64((1 << 48) - 1), np.uint64(1 << 32), np.uint64(16)
_SPLIT_LAST = np.uint64((1 << SPLIT_BITS) - 1)
_TOTAL = (1 << SPLIT_BITS) - 8
#: Class of an id: bits of the id plus one, less one.
CLASS = np.frexp(np.arange(1, IDS + 1, dtype=np.float64))[1] - 1
CLASSES = 17
#: What a new id of a class adds to the numbers of each.
_CLASS_ADD = (np.arange(CLASSES + 1) > np.arange(CLASSES)[:, None]).astype(np.int16)
#: The states of a record are the counts of its two followers, up to these.
MOST_FIRST, MOST_SECOND = 15, 3
_P, _Q = (x.ravel() for x in np.meshgrid(np.arange(MOST_FIRST + 1), np.arange(MOST_SECOND + 1), indexing="ij"))
_SHARE_FIRST, _SHARE_SECOND = _P / np.maximum(_P + _Q, 1), _Q / np.maximum(_P + _Q, 1)
#: How much a record has seen, 0 (nothing) to 7.
_LEVEL = np.select([_P == 0, (_Q == 0) & (_P < 2), (_Q == 0) & (_P < 5), _Q == 0, _P < 2 * _Q, _P < 5, _P < 6 * _Q], range(7), 7)
#: Starting weights of the orders 0, 1, 2 by levels of the order-2 and the order-1 record.
_START = np.array([[(1.0, 0.4 * (one > 0), 0.6 * (two > 0)) for one in range(8)] for two in range(8)]).reshape(64, 3).T


def _next_states() -> tuple[np.ndarray, np.ndarray]:
    """(state, whether the followers change places) after (state, case): 0 the first follower, 1 the second, 2 another, which
    takes the second place and weakens the first. The larger count is first."""
    after, turn = np.zeros((len(_P), 3), np.int64), np.zeros((len(_P), 3), bool)
    for state, (p, q) in enumerate(zip(_P.tolist(), _Q.tolist(), strict=True)):
        for case, (x, y) in enumerate([(min(p + 1, MOST_FIRST), q), (p, q + 1), (p - (p > 3) * (p // 4), 1)]):
            turn[state, case] = y > x
            x, y = max(x, y), min(x, y, MOST_SECOND)
            after[state, case] = x * (MOST_SECOND + 1) + y
    return after.ravel(), turn.ravel()


_AFTER, _TURN = _next_states()
_AFTER_FIELD = _AFTER << 26
#: A node has counts before each of four branches, in 16 bits each. One in each of the last three, and their top bits; the
#: ones moved by 16 bits for each branch are what one more number of that branch adds.
_ONES, _TOPS = np.uint64(0x0001000100010000), np.uint64(0x8000800080000000)
_FIELD, _TO_BITS = np.uint64(0xFFFF), np.uint64(4)
LEVELS = 6
#: Nodes of a block by level, first ones, and the bits of a number above and in each level.
_LEVEL_FIRST = (4 ** np.arange(LEVELS)[:, None] - 1) // 3
_ABOVE = 2 * np.arange(LEVELS, 0, -1)[:, None]
NODES = (4**LEVELS - 1) // 3
_CASES, _ORDERS = np.arange(4, 0, -1, dtype=np.uint8)[:, None], np.arange(3)[:, None]


class _Writer:
    """Range coders of many blocks: 48 bits of low and range, 16-bit words, carries added to words already out."""

    def __init__(self, lanes: int, capacity: int):
        self.range, self.low = np.full(lanes, 1 << 48, np.uint64), np.zeros(lanes, np.uint64)
        self.lane, self.capacity = np.arange(lanes), capacity
        # Words of all blocks, and where each one's next word goes.
        self.words, self.at = np.zeros(lanes * capacity, np.uint16), self.lane * capacity

    def split(self, n: int, start: np.ndarray, size: np.ndarray, rest: np.ndarray, start0: np.ndarray, size0: np.ndarray, total0: np.ndarray) -> None:
        """One interval of the split in each of the first n blocks, and one of the order-0 range inside it for those of `rest`."""
        step = self.range[:n] >> _SPLIT
        low = self.low[:n]
        low += step * start
        step *= size
        inner = step[rest] // total0
        low[rest] += inner * start0
        step[rest] = inner * size0
        self.range[:n] = step
        self._settle(self.lane[:n])

    def new(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray, bits: np.ndarray, place: np.ndarray) -> None:
        """A class's interval and a place in it, in some blocks."""
        inner = self.range[lanes] // total
        width = (inner * size) >> bits
        self.low[lanes] += inner * start + width * place
        self.range[lanes] = width
        self._settle(lanes)

    def _settle(self, lanes: np.ndarray) -> None:
        where = lanes[self.low.take(lanes) > _MASK48]
        if len(where):
            self.low[where] &= _MASK48
            back = self.at[where] - 1
            while len(back):
                self.words[back] += np.uint16(1)
                back = back[self.words[back] == 0] - 1
        while len(lanes := lanes[self.range.take(lanes) < _LEAST]):
            low, at = self.low.take(lanes), self.at.take(lanes)
            self.words[at] = low >> np.uint64(32)
            self.at[lanes] = at + 1
            self.low[lanes] = (low << _WORD) & _MASK48
            self.range[lanes] = self.range.take(lanes) << _WORD

    def finish(self) -> list[bytes]:
        """Emits the last words; each block's coded bytes."""
        for _ in range(3):
            self.words[self.at] = self.low >> np.uint64(32)
            self.low = (self.low << _WORD) & _MASK48
            self.at += 1
        return [self.words[i * self.capacity : n].astype("<u2").tobytes() for i, n in enumerate(self.at.tolist())]


class _Reader:
    """The other direction. A damaged block may lead anywhere in its statistics, but not out of them."""

    def __init__(self, coded: list[bytes]):
        lanes, self.last = len(coded), max((len(c) for c in coded), default=0) // 2 + 4
        self.words = np.zeros((lanes, self.last + 1), np.uint16)
        for i, c in enumerate(coded):
            self.words[i, : len(c) // 2] = np.frombuffer(c, "<u2")
        self.range, self.code = np.full(lanes, 1 << 48, np.uint64), np.zeros(lanes, np.uint64)
        self.at, self.lane = np.full(lanes, 3), np.arange(lanes)
        for i in range(3):
            self.code = (self.code << _WORD) | self.words[:, i]

    def settle(self, lanes: np.ndarray) -> None:
        while len(lanes := lanes[self.range[lanes] < _LEAST]):
            self.code[lanes] = (self.code[lanes] << _WORD) | self.words[lanes, np.minimum(self.at[lanes], self.last)]
            self.at[lanes] += 1
            self.range[lanes] <<= _WORD


class _Model:
    """Statistics of many blocks. Numbers are those of the block plus one; 0 is none. What is alike for the order-2 and the
    order-1 record, for the four followers or for the levels of the trees is done for all in one go, as rows."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.count = np.zeros(lanes * (BLOCK_TOKENS + 1), np.uint16)
        self.count_base = self.lane * (BLOCK_TOKENS + 1)
        # Trees of counts: nodes of four branches, a block's after another's.
        self.nodes = np.zeros(lanes * NODES, np.uint64)
        self.node_base = self.lane * NODES
        self.seen, self.once, self.distinct = (np.zeros(lanes, np.int64) for _ in range(3))
        # Records of order 2, then of order 1: 13 bits for each follower, 6 for the state.
        self.records = np.zeros(lanes * (SLOTS + BLOCK_TOKENS + 1), np.uint32)
        self.two_base, self.one_base = self.lane * SLOTS, lanes * SLOTS + self.count_base
        self.weights, self.weight_base = np.tile(_START.T, (lanes, 1)).ravel(), self.lane * 192
        # Numbers of new ids in smaller classes, and in all, with one more for each class.
        self.classes = np.tile(np.arange(CLASSES + 1, dtype=np.int16), (lanes, 1))

    def look(self, n: int, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(followers, ends), by rows: recorded followers, 0 for none, with a row to spare, and the bounds of their intervals
        in the split, from 0 to that of the rest."""
        self.at = np.empty((2, n), np.int64)
        np.add(self.two_base[:n], ((before * 40503 + last * 30011) >> 3) & (SLOTS - 1), out=self.at[0])
        np.add(self.one_base[:n], last, out=self.at[1])
        records = self.records.take(self.at, mode="clip").astype(np.int64)
        self.fields = first, second, state = records & 8191, (records >> 13) & 8191, records >> 26
        level = _LEVEL.take(state, mode="clip")
        self.bucket = (self.weight_base[:n] + (level[0] * 24 + level[1] * 3)) + _ORDERS
        self.now = w0, w1, w2 = self.weights.take(self.bucket, mode="clip")
        part = 1 / (w0 + w1 + w2)
        self.w0 = w0 * part / (self.seen[:n] + self.once[:n] + 1)
        weight = np.empty((2, n))
        np.multiply(w2, part, out=weight[0])
        np.multiply(w1, part, out=weight[1])
        self.shares = shares_first, shares_second = weight * _SHARE_FIRST.take(state, mode="clip"), weight * _SHARE_SECOND.take(state, mode="clip")
        # A follower in both records is coded once, by the sum.
        known, shares = np.empty((5, n), np.int64), np.empty((4, n))
        known[0], known[1], known[4] = first[0], second[0], 0
        shares[0], shares[1], shares[2], shares[3] = shares_first[0], shares_second[0], shares_first[1], shares_second[1]
        as_first, as_second = known[:2] == first[1], known[:2] == second[1]
        np.multiply(first[1], ~(as_first[0] | as_first[1]), out=known[2])
        np.multiply(second[1], ~(as_second[0] | as_second[1]), out=known[3])
        shares[:2] += shares[2] * as_first
        shares[:2] += shares[3] * as_second
        mass = shares + self.w0 * self.count.take(self.count_base[:n] + known[:4], mode="clip")
        ends = np.empty((6, n), np.int64)
        ends[0], ends[5] = 0, 1 << SPLIT_BITS
        np.multiply((mass * _TOTAL).astype(np.int64) + 1, known[:4] > 0, out=ends[1:5])
        for k in range(1, 4):
            ends[k + 1] += ends[k]
        return known, ends

    def path(self, n: int, x: np.ndarray) -> np.ndarray:
        """Finds the nodes above the numbers x; gives counts of all smaller numbers."""
        number = x - 1
        place = (number >> _ABOVE) + (self.node_base[:n] + _LEVEL_FIRST)
        shift = ((number >> (_ABOVE - 2)) & 3).view(np.uint64) << _TO_BITS
        node = self.nodes.take(place, mode="clip")
        self.above = place, node, shift
        return ((node >> shift) & _FIELD).sum(axis=0)

    def find(self, lane: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number whose counts cover a place."""
        number, base = np.zeros(len(lane), np.int64), self.node_base[lane]
        for first in _LEVEL_FIRST[:, 0].tolist():
            node = self.nodes.take(base + (number + first), mode="clip")
            # All three counts are taken from the place at once; a top bit stays where the count is not larger.
            digit = np.bitwise_count((place * _ONES + _TOPS - node) & _TOPS)
            place = place - ((node >> (digit.astype(np.uint64) << _TO_BITS)) & _FIELD)
            number = number * 4 + digit
        return number + 1

    def learn(self, n: int, x: np.ndarray, fresh: np.ndarray) -> None:
        """Takes in the numbers x, whose path was found; fresh: new in their blocks."""
        at = self.count_base[:n] + x
        times = self.count.take(at, mode="clip")
        self.count[at] = times + np.uint16(1)
        first, second, state = self.fields
        is_first, is_second = first == x, second == x
        zero = self.w0 * (times + fresh * (self.once[:n] + 1))
        two, one = self.shares[0] * is_first + self.shares[1] * is_second
        whole = 1 / (zero + one + two)
        parts = np.empty((3, n))
        for part, mass in zip(parts, (zero, one, two), strict=True):
            np.multiply(mass, whole, out=part)
        self.weights[self.bucket] = self.now + parts
        # Records after x.
        case = state * 3 + 2 - 2 * is_first - is_second
        second = np.where(is_first, second, x)
        both = first + second
        first = np.where(_TURN.take(case, mode="clip"), second, first)
        self.records[self.at] = first | ((both - first) << 13) | _AFTER_FIELD.take(case, mode="clip")
        place, node, shift = self.above
        self.nodes[place] = node + (_ONES << shift)
        self.seen[:n] += 1
        self.once[:n] += fresh
        self.once[:n] -= times == 1
        self.distinct[:n] += fresh


def _chosen(at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the intervals from the bounds at those places of the rows of ends."""
    start = ends.take(at, mode="clip")
    return start.view(np.uint64), (ends.take(at + ends.shape[1], mode="clip") - start).view(np.uint64)


def _order(lengths: list[int]) -> tuple[list[int], list[int]]:
    """Blocks by falling length, and how many have an id at each step."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    sizes = -np.array([lengths[i] for i in order], np.int64)
    return order, np.searchsorted(sizes, -np.arange(max(lengths, default=0)), "left").tolist()


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of each block of ids."""
    order, widths = _order([len(b) for b in blocks])
    lanes, longest = len(blocks), len(widths)
    ids, numbers, fresh = np.zeros((longest, lanes), np.int32), np.zeros((longest + 2, lanes), np.int64), np.zeros((longest, lanes), bool)
    for lane, i in enumerate(order):
        n = len(blocks[i])
        if n > BLOCK_TOKENS:
            raise ValueError(f"a block holds {BLOCK_TOKENS} ids at most")
        _, first, inverse = np.unique(blocks[i], return_index=True, return_inverse=True)
        ids[:n, lane] = blocks[i]
        fresh[first, lane] = True
        numbers[2 : n + 2, lane] = np.cumsum(fresh[:n, lane])[first][inverse]
    writer, model = _Writer(lanes, 5 * longest + 8), _Model(lanes)
    for t, n in enumerate(widths):
        x, new = numbers[t + 2, :n], fresh[t, :n]
        known, ends = model.look(n, numbers[t, :n], numbers[t + 1, :n])
        kind = 4 - ((known[:4] == x) * _CASES).sum(axis=0, dtype=np.uint8).astype(np.int64)
        start, size = _chosen(kind * n + model.lane[:n], ends)
        rest = np.flatnonzero(kind == 4)
        before = model.path(n, x)
        some, seen, escape = new[rest], model.seen[rest], model.once[rest] + 1
        start0 = np.where(some, seen.astype(np.uint64), before[rest])
        size0 = np.where(some, escape, model.count[model.count_base[rest] + x[rest]]).astype(np.uint64)
        writer.split(n, start, size, rest, start0, size0, (seen + escape).astype(np.uint64))
        made = np.flatnonzero(new)
        if len(made):
            _code_new(writer, model, made, ids[t, made])
        model.learn(n, x, new)
    coded: list = [b""] * lanes
    for lane, out in enumerate(writer.finish()):
        coded[order[lane]] = out
    return coded


def _code_new(writer: _Writer, model: _Model, lanes: np.ndarray, ids: np.ndarray) -> None:
    group = CLASS[ids]
    rows, at = model.classes.take(lanes, axis=0), np.arange(len(lanes)) * (CLASSES + 1) + group
    start, end, total = rows.take(at), rows.take(at + 1), rows[:, CLASSES]
    writer.new(lanes, *(v.astype(np.uint64) for v in (start, end - start, total, group, ids + 1 - (1 << group))))
    model.classes[lanes] = rows + _CLASS_ADD.take(group, axis=0)


def decode_blocks(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    order, widths = _order(lengths)
    lanes, longest = len(coded), len(widths)
    reader, model = _Reader([coded[i] for i in order]), _Model(lanes)
    numbers = np.zeros((longest + 2, lanes), np.int64)
    names = np.zeros((lanes, BLOCK_TOKENS + 2), np.uint16)
    for t, n in enumerate(widths):
        known, ends = model.look(n, numbers[t, :n], numbers[t + 1, :n])
        step = reader.range[:n] >> _SPLIT
        aim = np.minimum(reader.code[:n] // step, _SPLIT_LAST).astype(np.int64)
        kind = (aim >= ends[1:5]).sum(axis=0, dtype=np.uint8).astype(np.int64)
        at = kind * n + model.lane[:n]
        start, size = _chosen(at, ends)
        reader.code[:n] -= step * start
        width = step * size
        x = known.take(at, mode="clip")
        fresh = np.zeros(n, bool)
        rest = np.flatnonzero(kind == 4)
        if len(rest):
            seen, escape = model.seen[rest].astype(np.uint64), (model.once[rest] + 1).astype(np.uint64)
            inner = width[rest] // (seen + escape)
            place = np.minimum(reader.code[rest] // inner, seen + escape - np.uint64(1))
            new = place >= seen
            fresh[rest] = new
            x[rest] = np.where(new, model.distinct[rest] + 1, model.find(rest, np.where(new, np.uint64(0), place)))
        before = model.path(n, x)
        if len(rest):
            reader.code[rest] -= inner * np.where(new, seen, before[rest])
            width[rest] = inner * np.where(new, escape, model.count[model.count_base[rest] + x[rest]].astype(np.uint64))
        reader.range[:n] = width
        reader.settle(reader.lane[:n])
        made = np.flatnonzero(fresh)
        if len(made):
            names[made, x[made]] = _read_new(reader, model, made)
        model.learn(n, x, fresh)
        numbers[t + 2, :n] = x
    out: list = [None] * lanes
    for lane, i in enumerate(order):
        out[i] = names[lane][numbers[2 : lengths[i] + 2, lane]].astype(np.int64)
    return out


def _read_new(reader: _Reader, model: _Model, lanes: np.ndarray) -> np.ndarray:
    rows = model.classes.take(lanes, axis=0)
    total = rows[:, CLASSES].astype(np.int64)
    inner = reader.range[lanes] // total.astype(np.uint64)
    aim = np.minimum(reader.code[lanes] // inner, (total - 1).astype(np.uint64)).astype(np.int16)
    group = (rows <= aim[:, None]).sum(axis=1, dtype=np.uint8).astype(np.int64) - 1
    at = np.arange(len(lanes)) * (CLASSES + 1) + group
    start, ends = rows.take(at), rows.take(at + 1)
    width = (inner * (ends - start).astype(np.uint64)) >> group.astype(np.uint64)
    code = reader.code[lanes] - inner * start.astype(np.uint64)
    place = np.minimum(code // width, (1 << group).astype(np.uint64) - np.uint64(1))
    reader.code[lanes], reader.range[lanes] = code - width * place, width
    reader.settle(lanes)
    model.classes[lanes] = rows + _CLASS_ADD.take(group, axis=0)
    return np.minimum((1 << group) - 1 + place.astype(np.int64), IDS - 1)
