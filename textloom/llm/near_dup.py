"""Near duplicates by b-bit MinHash.

Texts: A-Z lower-cased, words are runs of other characters than ASCII white space, a document's set is its distinct
shingles of `width` words (fewer words: the whole sequence). Two documents are linked where the Jaccard similarity of the
sets is `percent` hundredths or more (five words and 80 by default); components of links are the groups. A null, empty or
blank text has an empty set, is linked with nothing and is its own component. Rows that share a doc_id are one node;
rows with a null doc_id have no links and a null component. Extra columns are not read. An empty table gives no rows.

Candidates come from bands of full minima, so a pair is missed with a probability of 0.002 at a similarity of 0.8, 0.00005
at 0.85 and less above. Then two low bits of each minimum, packed into four longs, give an estimate corrected for chance
agreement, which chooses whom a class is first compared with. Every link is confirmed on full sets.

A group of thousands of copies is not expanded into pairs. Equal sets are one class from the start. Each class is then
compared with one other only: the likeliest of the smallest classes of its buckets. What this links becomes a
component. Classes joined by buckets form a cluster; where a cluster still holds several components, the classes outside
its largest one are compared with all of it, by exact counts over an inverted index inside the task. Clusters of any
size are dealt as a grid of chunks, and a task gives only the links that join components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.components import components
from textloom.session import written

MINIMA, BANDS, ROWS, BITS = 128, 21, 6, 2
#: A link: 100 * intersection >= percent * union of the sets of shingles of so many words.
WIDTH, PERCENT = 5, 80
#: Shingles of a chunk, about: what one side of a task holds.
CHUNK_SHINGLES = 1 << 20
#: A class is not first compared with a leader whose estimate is so far below the threshold: five standard deviations.
MARGIN = 0.23
SIG = [f"s{i}" for i in range(MINIMA * BITS // 64)]
SKETCH = "doc_id long, n long, d1 long, d2 long, " + ", ".join(f"{s} long" for s in SIG) + ", bands array<long>"


def _multipliers() -> np.ndarray:
    return H.mix(np.arange(MINIMA, dtype=np.uint64), 77) | np.uint64(1)


def minima(sets: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 2048):
        np.minimum(least, (multipliers[:, None] * sets[None, at : at + 2048]).min(axis=1), out=least)
    return least


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, d1, d2, s0.., bands) of each row: set size, digest of the set, packed bits, one key a band."""

    def run(batches):
        a = _multipliers()
        shift = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]
        salt = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, last in H.chunks(texts):
                words, at = H.words_by_text(texts[first:last])
                n, d1, d2, sig, bands = [], [], [], [], []
                for i in range(last - first):
                    s = H.shingles(words[at[i] : at[i + 1]], width)
                    n.append(len(s))
                    d1.append(H.mix(s, 1).sum(dtype=np.uint64))
                    d2.append(H.mix(s, 2).sum(dtype=np.uint64))
                    m = minima(s, a)
                    low = H.mix(m, 3) & np.uint64((1 << BITS) - 1)
                    sig.append((low.reshape(len(SIG), -1) << shift).sum(axis=1, dtype=np.uint64))
                    key = salt
                    for r in range(ROWS):
                        key = H.mix(key + m[r : BANDS * ROWS : ROWS] * H.A, r)
                    bands.append(key if len(s) else key[:0])
                columns = [ids.slice(first, last - first), pa.array(n, pa.int64())]
                columns += [pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)]
                columns += [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in np.array(sig, np.uint64).T]
                keys = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(b) for b in bands]), pa.int32()), pa.array(keys)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", *SIG, "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def estimate(x: str, y: str) -> Column:
    """Similarity from the packed bits of two rows, corrected for agreement by chance."""
    odd = F.lit(0x5555555555555555)
    differ = [F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1))).bitwiseAND(odd)) for d in (F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}")) for s in SIG)]
    chance = 1 / 2**BITS
    return ((1 - sum(differ[1:], differ[0]) / MINIMA) - chance) / (1 - chance)


def _plausible(x: str, y: str, percent: int) -> Column:
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")  # a bound on the similarity
    return sizes & (estimate(x, y) >= percent / 100 - MARGIN)


def _chunks(total: Column) -> Column:
    return F.ceil(total / CHUNK_SHINGLES).cast("long")


def _links(rows: DataFrame, keys: list[str], width: int, percent: int) -> DataFrame:
    """(a, b) of classes whose full sets reach the threshold, inside each group of `keys`.

    rows: keys, wide (on the side that is indexed; else on the side that is looked up), rep, component, text. Only links
    that join components, given ones or ones joined before in the group, are given."""

    def run(table: pa.Table) -> pa.Table:
        wide = np.array(table.column("wide").to_pylist(), bool)
        reps, parts = (np.array(table.column(c).to_pylist(), np.int64) for c in ("rep", "component"))
        texts, sets = table.column("text").to_pylist(), [None] * len(wide)
        for first, last in H.chunks(texts):
            words, at = H.words_by_text(texts[first:last])
            for i in range(last - first):
                sets[first + i] = H.shingles(words[at[i] : at[i + 1]], width)
        index = np.flatnonzero(wide)
        sizes = np.array([len(sets[i]) for i in index], np.int64)
        values = np.concatenate([sets[i] for i in index]) if len(index) else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(index)), sizes)[order]
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        out = []
        for u in np.flatnonzero(~wide).tolist():
            one = sets[u]
            left, right = np.searchsorted(values, one), np.searchsorted(values, one, "right")
            n = right - left
            both = np.bincount(owner[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], minlength=len(index))
            near = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes + len(one) - both)) & (reps[index] != reps[u]))
            for i in near.tolist():
                x, y = find(int(parts[u])), find(int(parts[index[i]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(reps[index[i]]), int(reps[u])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "a long, b long").distinct()


def _star_links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among (leader, rep, n): the members of a leader, dealt in chunks, each beside the leader's text."""
    total = pairs.groupBy("leader").agg(_chunks(F.sum("n")).alias("chunks"))
    dealt = pairs.join(total, "leader").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    rows = dealt.join(texts, "rep").select("leader", "chunk", F.lit(True).alias("wide"), "rep", F.col("rep").alias("component"), "text")
    head = total.join(texts.withColumnRenamed("rep", "leader"), "leader").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    heads = head.select("leader", "chunk", F.lit(False).alias("wide"), F.col("leader").alias("rep"), F.col("leader").alias("component"), "text")
    return _links(rows.unionByName(heads), ["leader", "chunk"], width, percent)


def _cluster_links(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the components of each cluster; rows: rep, n, cluster, component."""
    parts = rows.groupBy("cluster", "component").agg(F.count("*").alias("c"))
    heads = parts.groupBy("cluster").agg(F.max_by("component", F.struct("c", "component")).alias("head"), F.count("*").alias("k")).where("k > 1")
    # Written before it is counted by cluster: a join that feeds no aggregation of its key can be split where a cluster is hot.
    mixed = written(rows.join(heads.drop("k"), "cluster"), "mixed")
    outside = F.col("component") != F.col("head")
    size = mixed.groupBy("cluster").agg(_chunks(F.sum("n")).alias("wide_chunks"), _chunks(F.sum(F.when(outside, F.col("n")))).alias("chunks"))
    mixed = written(written(mixed.join(size, "cluster"), "mixed").join(texts, "rep"), "mixed")
    all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("rep"), F.col(c))
    columns = ["cluster", "x", "y", "wide", "rep", "component", "text"]
    wide = mixed.withColumn("x", mine("wide_chunks")).withColumn("y", all_of("chunks")).withColumn("wide", F.lit(True)).select(*columns)
    thin = mixed.where(outside).withColumn("y", mine("chunks")).withColumn("x", all_of("wide_chunks")).withColumn("wide", F.lit(False)).select(*columns)
    return _links(wide.unionByName(thin), ["cluster", "x", "y"], width, percent)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: kept is the smallest doc_id of its component."""
    rows = written(sketch(docs, width), "sketch")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    ids = classes.select(F.col("rep").alias("doc_id"), "d1", "d2", "n")
    reps = rows.join(ids, ["doc_id", "d1", "d2", "n"], "left_semi").withColumnRenamed("doc_id", "rep")
    reps = written(reps.select("rep", "n", *SIG, "bands"), "reps")
    banded = reps.select(F.explode("bands").alias("key"), "rep")
    leaders = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = written(banded.join(leaders, "key").where("rep <> leader").select("leader", "rep").distinct(), "pairs")
    clusters = components(pairs, "leader", "rep")
    # A merge join at any size: texts cross the network once, whatever the ids' size is guessed to be.
    needed = clusters.select(F.col("node").alias("rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(needed.hint("merge"), "rep", "left_semi")
    texts = written(texts, "texts")
    light = reps.select("rep", "n", *SIG)
    x, y = light.alias("x"), light.alias("y")
    near = pairs.join(x, F.col("leader") == F.col("x.rep")).join(y, pairs["rep"] == F.col("y.rep")).where(_plausible("x", "y", percent))
    near = near.select("leader", F.col("y.rep").alias("rep"), F.col("y.n").alias("n"), estimate("x", "y").alias("e"))
    likeliest = near.groupBy("rep").agg(F.max_by("leader", F.struct("e", -F.col("leader"))).alias("leader"), F.first("n").alias("n"))
    links = written(_star_links(likeliest, texts, width, percent), "links")
    part = components(links)
    placed = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(light.select("rep", "n"), "rep")
    placed = placed.join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = written(_cluster_links(placed, texts, width, percent), "links")
    part = components(links.unionByName(more))
    named = classes.join(part.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def filter_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs of which one stays from each group, all columns: the one with the smallest doc_id, null ones last.

    Each different pair of doc_id and text is a node of its own, so unlike texts under one doc_id, or under none, are told
    apart; of rows that repeat both, one stays."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias("__key"), "component_id")
    ids = keyed.groupBy("__key").agg(F.min("doc_id").alias("__id"))
    first = F.min_by("__key", F.struct(F.col("__id").isNull(), "__id", "__key"))
    heads = found.distinct().join(ids, "__key").groupBy("component_id").agg(first.alias("__key")).select("__key")
    return keyed.join(heads, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
