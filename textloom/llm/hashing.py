"""Vectorized hashing of the words of many texts."""

from __future__ import annotations

import numpy as np

#: By byte: what ends a word. WHITE is ASCII white space, MARKS every ASCII character but lower-case letters and digits.
WHITE, MARKS = np.zeros(256, bool), np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
MARKS[:128] = True
MARKS[[*range(48, 58), *range(97, 123)]] = False
#: Bytes hashed at a time, so that temporaries stay small whatever a text's length.
PIECE = 1 << 21
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: near inputs give unrelated outputs."""
    x = x + np.uint64(salt) + A
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, blank: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each run of bytes that `blank` does not mark."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not blank[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        solid = ~blank[raw]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        begin = np.flatnonzero(first)
        if len(begin):
            where = np.flatnonzero(solid)
            word = np.cumsum(first)[where] - 1
            place = where - begin[word]
            weight = mix(np.arange(int(place.max()) + 1, dtype=np.uint64))
            value = (raw[where].astype(np.uint64) + np.uint64(1)) * weight[place]
            hashes.append(mix(np.add.reduceat(value, np.searchsorted(where, begin))))
            starts.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def words_by_text(texts: list[str | None], blank: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the first word's index of each text with the total at the end."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw)
    hashes, starts = word_hashes(data.lower(), blank)  # bytes.lower() changes A-Z only
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of fewer words the whole sequence is one; none without words."""
    if len(words) == 0:
        return words
    if len(words) < width:
        run, n = words[:1] * A, len(words)
        for w in words[1:]:
            run = mix(run + w)
        return mix(run, n)
    run = words[: len(words) - width + 1] * A
    for k in range(1, width):
        run = mix(run, k) + words[k : len(words) - width + 1 + k] * B
    return np.unique(mix(run))


def chunks(texts: list[str | None], limit: int = 1 << 22):
    """(first, last) row ranges of about `limit` characters at most, one row at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)
