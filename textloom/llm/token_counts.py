"""Greedy word-piece lengths by a linear longest-match automaton.

Words are runs of characters other than ASCII white space. A word is the vocabulary's space mark followed by the word's
UTF-8 bytes in the byte alphabet of the vocabulary; its pieces are the longest vocabulary entries from left to right.
The automaton is the vocabulary's trie in which each node knows the node to go on from when no child fits (failure
link) and how many pieces are complete by then, so a word's length is a sum over one pass and no piece is built.
Special entries of a vocabulary file, which stand beside its pieces, are no pieces: their characters are counted as text.
A null, empty or blank text has no words and no pieces. Each row is counted by itself; extra columns are not read; an
empty table gives no rows. Words are remembered per worker up to a fixed number.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer words are not remembered.
LONGEST_KEPT = 48
KEPT_WORDS = 1 << 18


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable Latin,
    else the next free character from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """Trie with failure links; entries are byte strings that include every single byte."""

    def __init__(self, entries: set[bytes]):
        entries = entries | {bytes([b]) for b in range(256)}
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for entry in entries:
            node = 0
            for byte in entry:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][byte]
            final[node] = True
        self.link, self.popped = [0] * len(self.next), [0] * len(self.next)
        level = [(0, byte, node) for byte, node in self.next[0].items()]
        while level:
            below = []
            for parent, byte, node in level:
                if final[node]:  # the whole string is one piece; go on from the root
                    self.link[node], self.popped[node] = 0, 1
                else:
                    # Single bytes are entries, so a chain of links ends at a node that has the byte: the root at last.
                    at, done = self.link[parent], self.popped[parent]
                    while byte not in self.next[at]:
                        at, done = self.link[at], done + self.popped[at]
                    self.link[node], self.popped[node] = self.next[at][byte], done
                below += [(node, b, n) for b, n in self.next[node].items()]
            level = below

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces."""
        at, n = 0, 0
        for byte in word:
            while byte not in self.next[at]:
                n, at = n + self.popped[at], self.link[at]
            at = self.next[at][byte]
        while at:
            n, at = n + self.popped[at], self.link[at]
        return n


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    special = {t["content"] for t in stored.get("added_tokens", ())}
    back = {c: b for b, c in enumerate(byte_alphabet())}
    return Automaton({bytes(back[c] for c in entry) for entry in stored["model"]["vocab"] if entry and entry not in special and all(c in back for c in entry)})


class _Lengths(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _lengths(path: str) -> _Lengths:
    return _Lengths(load(path))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row."""

    def run(batches):
        lengths = _lengths(vocabulary)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                parts = (text or "").encode("utf-8", "surrogatepass").split()  # ASCII white space
                words.append(len(parts))
                tokens.append(sum(map(lengths.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
