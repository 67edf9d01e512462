"""Language identification by prediction by partial matching.

A text is its lower-cased UTF-8 bytes, all of them, after ORDER line ends. For each language a tree of byte contexts of up
to ORDER bytes, which run on over blanks, marks and words, counts what followed. A byte is coded in the longest context
that the language's statistics know; each context that has not seen the byte costs an escape (method C: the share of
distinct followers). The language whose frozen statistics give the whole text the shortest code is predicted.

The trees are held as tables by order: a byte with its context gives its full code lengths in all languages, a context its
escapes. Bytes of many texts are looked up together, longest contexts first, and only what an order lacks goes on to the
next one, so the work is a few vector operations a byte whatever the words.

A text that is null or has no letter is `und` with score 0; so is every text when there is nothing to learn from. Ties
go to the first language in byte order. Rows are predicted by their own text; extra columns are not read. Statistics
are counted on a bounded sample of the labelled rows: about SAMPLE_DOCS whole documents of each language, chosen by hash
of the doc_id, of any length. Counts of grams, not texts, come to the driver.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import remainder

ORDER = 4
SAMPLE_DOCS = 600
UNKNOWN = "und"
START = b"\n" * ORDER
#: Bytes looked up together.
PIECE = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")
#: The model of a worker process, kept from task to task.
_MODELS: dict = {}


def _bytes(text: str) -> bytes:
    return START + text.lower().encode("utf-8", "replace")


def grams(data: bytes, order: int = ORDER) -> np.ndarray:
    """Each byte after the first ORDER with the `order` bytes before it, as one number."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(max(len(raw) - ORDER, 0), np.uint64)
    for back in range(order, -1, -1):
        out = (out << np.uint64(8)) | raw[ORDER - back : len(raw) - back]
    return out


class _Table:
    """Sorted numbers with a row of values each, found by a hash of their own."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(int(len(keys) * 4).bit_length(), 4))
        # Each slot holds one key's place; keys that meet in a slot are found by halving.
        self.slots = np.full(1 << int(64 - self.shift), -1, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self.slots[self._slot(keys)].astype(np.int64)
        # An empty slot means that no key has it.
        other = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        if len(other):
            place = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            at[other] = np.where(self.keys[place] == keys[other], place, -1)
        return at


class Model:
    """Code lengths in bits under each language, from counts of grams of ORDER + 1 bytes by language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: language -> (grams, how often)."""
        self.languages = sorted(counts)
        n = len(self.languages)
        self.known, self.escapes = [], []
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            each = []
            for language in self.languages:
                keys, at = np.unique(counts[language][0] & mask, return_inverse=True)
                each.append((keys, np.bincount(at, weights=counts[language][1], minlength=len(keys))))
            every = np.unique(np.concatenate([k for k, _ in each])) if each else np.zeros(0, np.uint64)
            contexts = np.unique(every >> np.uint64(8))
            seen, total, distinct = np.zeros((len(every), n)), np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            for j, (keys, times) in enumerate(each):
                seen[np.searchsorted(every, keys), j] = times
                of = np.searchsorted(contexts, keys >> np.uint64(8))
                total[:, j], distinct[:, j] = np.bincount(of, weights=times, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
            some = total > 0
            escape = np.where(some, -np.log2(np.where(some, distinct / np.maximum(total + distinct, 1), 1.0)), 0.0)
            self.escapes.append(_Table(contexts, escape))
            of = np.searchsorted(contexts, every >> np.uint64(8))
            lower = np.full((len(every), n), 8.0) if not order else self.known[-1].values[self.known[-1].find(every & (mask >> np.uint64(8)))]
            hit = -np.log2(np.maximum(seen, 1) / np.maximum(total[of] + distinct[of], 1))
            self.known.append(_Table(every, np.where(seen > 0, hit, escape[of] + lower)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """(grams, languages): bits of the last byte of each gram of ORDER + 1 bytes."""
        out = np.zeros((len(codes), len(self.languages)))
        left = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            keys = codes[left] & mask
            at = self.known[order].find(keys)
            found = at >= 0
            if found.all():
                out[left] += self.known[order].values[at]
                return out
            out[left[found]] += self.known[order].values[at[found]]
            left, keys = left[~found], keys[~found]
            at = self.escapes[order].find(keys >> np.uint64(8))
            some = at >= 0
            out[left[some]] += self.escapes[order].values[at[some]]
        out[left] += 8.0  # a byte that no language has seen
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior under equal priors) of each text."""
        total = np.zeros((len(texts), len(self.languages)))
        data = [_bytes(t) if t and self.languages and any(map(_has_letter, _LETTERS.findall(t))) else b"" for t in texts]
        held, size = [], 0
        for i, one in enumerate(data):
            for first in range(ORDER, len(one), PIECE):
                held.append((i, one[first - ORDER : first + PIECE]))
                size += len(held[-1][1])
                if size >= PIECE:
                    self._add(held, total)
                    held, size = [], 0
        self._add(held, total)
        best = total.argmin(axis=1) if self.languages else None
        out = []
        for i, one in enumerate(data):
            share = float(1 / np.exp2(np.maximum(total[i, best[i]] - total[i], -1000)).sum()) if one else 0.0
            out.append((self.languages[best[i]] if one else UNKNOWN, share))
        return out

    def _add(self, held: list[tuple[int, bytes]], total: np.ndarray) -> None:
        if held:
            codes = [grams(data) for _, data in held]
            sums = np.add.reduceat(self.bits(np.concatenate(codes)), np.cumsum([0] + [len(c) for c in codes[:-1]]), axis=0)
            np.add.at(total, [i for i, _ in held], sums)


def _has_letter(run: str) -> bool:
    return any(map(str.isalpha, run))


def count_texts(texts: dict[str, list[str]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts for a model, of texts at hand."""
    return {k: np.unique(np.concatenate([grams(_bytes(t)) for t in v] or [np.zeros(0, np.uint64)]), return_counts=True) for k, v in texts.items()}


def training_counts(docs: DataFrame, held_out: int = 1, by: int = 3) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gram counts over about SAMPLE_DOCS whole texts of each language, of rows outside the held-out part."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), by) != held_out))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return {}
    scale = 1 << 30
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, SAMPLE_DOCS / n) * scale))).otherwise(limit)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(scale)) < limit).select("lang", "text")

    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _bytes(text)
                for first in range(ORDER, len(data), PIECE):
                    keys, n = np.unique(grams(data[first - ORDER : first + PIECE]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = chosen.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = found.toArrow()  # bounded by the sample
    langs, keys, times = (table.column(c).to_numpy() for c in ("lang", "gram", "n"))
    out = {}
    for lang in sizes:
        mine = langs == lang
        order = np.argsort(keys[mine].view(np.uint64))
        if len(order):
            out[lang] = (keys[mine].view(np.uint64)[order], times[mine][order])
    return out


def identify(docs: DataFrame, counts: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row: score is the posterior of the language under equal priors."""
    counts = training_counts(docs) if counts is None else counts
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(counts)
        model = _MODELS[key]
        for batch in batches:
            got = model.predict(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
