"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and the context of each hit.

Tokens are the runs between white space, lower-cased, without punctuation at their ends. The lexicon holds tokens that
labelled toxic documents use and others hardly do; its size is bounded by the sample that it is learned from. A token
that is not in it is run through the automaton of edit distance 1 (2 from LONG letters on) over the lexicon's trie,
which finds misspelled terms. Each hit looks at the tokens around it: quotation marks and words of report speak for
quotation, words of address for abuse. A logistic model over the hits' sums gives the score.

Terms of fewer than SHORT letters are matched exactly only: an edit of so short a word mostly gives another word. A null
or empty text has no hits and gets the model's lowest kind of score. Scores depend on the text only. Without labelled
rows the score is 0; where labels are too few for any term to stand out it is the share of toxic ones. Extra columns are not read. Equal doc_ids are scored row by row; empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import remainder
from textloom.session import written

#: Labelled documents learned from, of each class, about.
SAMPLE_DOCS = 20_000
#: A term's log odds must exceed the first; its likelihood ratio must be one that this share of corpora would show for any
#: of the tokens tried by chance.
PLAIN_ODDS, CHANCE = 2.0, 0.05
#: Tokens shorter than the first are matched exactly; from the second on two edits are allowed.
SHORT, LONG = 5, 12
WINDOW = 6
ENDS = "\"'“”„«»‘’`.,;:!?()[]{}<>-–—…*_~|/\\#$%&+="
QUOTES = frozenset("\"“”„«»‘’`")
# Fixed word lists: words of report and words of address in the languages at hand.
REPORT = frozenset("said says called calls word words term quote quoted wrote writes report reported means slur sagte schrieb wort nannte dit écrit mot appelle dijo escribió palabra llamó".split())
ADDRESS = frozenset("you your you're u du dich dein ihr euch tu toi vous ton te tú tu usted eres".split())
KEPT_TOKENS, LONGEST_KEPT = 1 << 18, 40
N_FEATURES = 9
_SCORERS: dict = {}


def _deletions(token: str, k: int) -> set[str]:
    """The token without up to k of its characters."""
    one = {token[:i] + token[i + 1 :] for i in range(len(token))}
    return one | {token} if k == 1 else one.union({token}, *(_deletions(t, k - 1) for t in one))


class Trie:
    """The lexicon, with a lookup of terms within an edit distance of a token."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.root: dict = {}
        #: Terms and what is left of them after as many deletions as edits are allowed: two texts within k edits share
        #: one of these, so a token that shares none needs no automaton.
        self.shared: set[str] = set()
        #: Beginnings and ends of terms, one of which an edited token keeps up to its middle.
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for term in weights:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            if len(term) >= SHORT:
                self.shared |= _deletions(term, 2 if len(term) >= LONG - 2 else 1)
                self.heads |= {term[:i] for i in range(len(term) + 1)}
                self.tails |= {term[i:] for i in range(len(term) + 1)}

    def near(self, token: str) -> tuple[str, int] | None:
        """The nearest term (then the heaviest) within the distance allowed for the token's length."""
        k = 0 if len(token) < SHORT else 1 if len(token) < LONG else 2
        half = (len(token) - 1) // 2
        if k == 1 and token[:half] not in self.heads and token[half + 1 :] not in self.tails:
            return None
        if k == 0 or self.shared.isdisjoint(_deletions(token, k)):
            return None
        best = None
        # States of the automaton are rows of edit counts; a branch ends where no count is within the distance.
        stack = [(self.root, list(range(len(token) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= k and len(child) >= SHORT:
                        found = (row[-1], -self.weights[child], child)
                        best = found if best is None or found < best else best
                    continue
                new = [row[0] + 1]
                for j, t in enumerate(token, 1):
                    new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (t != c)))
                if min(new) <= k:
                    stack.append((child, new))
        return None if best is None else (best[2], best[0])


class _Hits(dict):
    """(weight, edits) of a raw token, or None; bounded."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, raw: str):
        token = raw.strip(ENDS)
        hit = None
        if token in self.trie.weights:
            hit = (self.trie.weights[token], 0)
        elif token and (near := self.trie.near(token)):
            hit = (self.trie.weights[near[0]], near[1])
        if len(raw) <= LONGEST_KEPT:
            if len(self) >= KEPT_TOKENS:
                self.clear()
            self[raw] = hit
        return hit


def features(text: str | None, hits: dict) -> list[float]:
    """A document's sums over its hits."""
    tokens = text.lower().split() if text else []
    of = list(map(hits.__getitem__, tokens))
    if of.count(None) == len(of):
        return [0.0] * N_FEATURES
    found = [(i, h) for i, h in enumerate(of) if h is not None]
    exact = near = top = quoted = reported = addressed = 0.0
    for i, (weight, edits) in found:
        around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        in_quotes = tokens[i][0] in QUOTES or tokens[i].rstrip(".,;:!?)")[-1:] in QUOTES
        told = not REPORT.isdisjoint(around)
        exact += weight * (edits == 0)
        near += weight * (edits > 0)
        top = max(top, weight / (1 + edits))
        quoted += in_quotes
        reported += told
        addressed += not ADDRESS.isdisjoint(around)
    n = len(found)
    return [1.0, math.log1p(exact), math.log1p(near), top, quoted / n, reported / n, addressed / n, math.log1p(n), math.log(n / len(tokens))]


def learn_weights(rows: DataFrame) -> dict[str, float]:
    """Log odds of the tokens of the sample's (text, toxic) that pass the bound.

    Documents count once per family: two minima of hashes over their longer tokens, which near copies mostly share. Else
    whatever a group of copies says would look like a term."""
    token = F.array_distinct(F.transform(F.split(F.lower("text"), "\\s+"), lambda w: F.btrim(w, F.lit(ENDS))))
    long = F.filter("w", lambda w: F.char_length(w) > 5)
    least = lambda seed: F.array_min(F.transform(F.when(F.size(long) > 0, long).otherwise(F.col("w")), lambda w: F.xxhash64(w, F.lit(seed))))
    one = rows.select("toxic", token.alias("w")).select("toxic", F.xxhash64(least(1), least(2)).alias("family"), "w")
    totals = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count_distinct("family").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    each = one.select("toxic", "family", F.explode("w").alias("w")).distinct()
    counts = written(each.groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "tokens")
    odds = F.ln((F.col("a") + 0.5) / (toxic + 1)) - F.ln((F.col("b") + 0.5) / (clean + 1))
    # Twice the log likelihood ratio against equal shares in both classes; it needs no clean document to have the term. Its
    # tail falls like exp(-x / 2), and the bound is divided by the number of tokens tried.
    every = F.col("a") + F.col("b")
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / (every * share))).otherwise(F.lit(0.0))
    ratio = 2 * (part("a", toxic / (toxic + clean)) + part("b", clean / (toxic + clean)))
    tried = counts.count()
    terms = counts.where(F.char_length("w") > 1).withColumn("odds", odds)
    terms = terms.where((ratio > 2 * math.log(max(tried, 1) / CHANCE)) & (F.col("odds") > PLAIN_ODDS))
    return {r.w: float(r.odds) for r in terms.select("w", "odds").collect()}  # bounded by the sample


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic model with intercept, by Newton's method with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * w
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _map(rows: DataFrame, weights: dict[str, float], model: np.ndarray | None) -> DataFrame:
    """Scores of (doc_id, held_out, text), or features of (toxic, text) where there is no model yet."""
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = _Hits(Trie(weights))
        hits = _SCORERS[key]
        for batch in batches:
            x = np.array([features(t, hits) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, N_FEATURES)
            if model is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x))], ["toxic", "x"])
                continue
            score = 1 / (1 + np.exp(-np.clip(model[0] + x @ model[1:], -30, 30)))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "toxic int, x array<double>" if model is None else "doc_id long, held_out boolean, score double, predicted int")


def sample(docs: DataFrame, labels: DataFrame, held_out: int = 0, by: int = 5) -> DataFrame:
    """(toxic, text) of about SAMPLE_DOCS labelled documents of each class, outside the held-out part."""
    rows = labels.where((remainder(F.col("doc_id"), by) != held_out) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 30
    limit = F.lit(0)
    for toxic, n in counts.items():
        limit = F.when(F.col("toxic") == toxic, F.lit(int(min(1.0, SAMPLE_DOCS / n) * scale))).otherwise(limit)
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(scale)) < limit)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(rows), "doc_id").select("toxic", "text")  # rows: bounded above


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    chosen = sample(docs, labels)
    weights = learn_weights(chosen)
    if not weights and chosen.isEmpty():
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    seen = _map(chosen, weights, None).collect()  # bounded by the sample
    model = fit(np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float))
    return _map(rows, weights, model)
