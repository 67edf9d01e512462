"""Inverted and forward index as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.ordering import number_rows, running_sum
from textloom.operators.tokens import doc_terms
from textloom.session import durable

#: Postings are stored in this many folders by term hash, so a query reads only the folders of its terms.
BUCKETS = 64
#: Ids that agree but for this many last bits are one part of a term's list.
CHUNK_BITS = 16


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def assign_doc_ids(pages: DataFrame, order: str, out: str = "doc_id", needed: tuple[str, ...] = ("html", "url")) -> DataFrame:
    """Dense ids from 0 in the order of a unique key, for rows whose needed columns are neither null nor empty."""
    for c in needed:
        pages = pages.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return number_rows(pages, [F.col(order)], out)


def postings(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct (term, doc_id)."""
    return toks.select("term", F.col(key).alias("doc_id")).distinct()


def posting_arrays(posts: DataFrame) -> DataFrame:
    """(term, doc_freq, doc_ids ascending) of postings that may repeat. One row holds a whole list: for export of bounded
    corpora; queries use rows."""
    return posts.groupBy("term").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids")).withColumn("doc_freq", F.size("doc_ids"))


def encode_gaps(posts: DataFrame) -> DataFrame:
    """(term, doc_id, gap) of postings that may repeat: difference to the previous id of the term, the first to 0.

    A list is made in parts of ids that agree but for CHUNK_BITS bits, so a frequent term is no single task; lists are what is shuffled, once."""
    lists = posts.groupBy("term", F.shiftright("doc_id", CHUNK_BITS).alias("__part")).agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    lists = durable(lists)
    before = lists.select("term", "__part", F.lag(F.element_at("ids", -1)).over(Window.partitionBy("term").orderBy("__part")).alias("__before"))
    both = lists.join(before.where("__before is not null"), ["term", "__part"], "left")
    shifted = F.concat(F.array(F.coalesce("__before", F.lit(0))), F.slice("ids", F.lit(1), F.size("ids") - 1))
    return both.select("term", F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), shifted.alias("before")))).select("term", "doc_id", (F.col("doc_id") - F.col("before")).alias("gap"))


def decode_gaps(gaps: DataFrame, order: str = "doc_id") -> DataFrame:
    """(term, decoded): running sum of the gaps, in parts like those of encode_gaps()."""
    rows = gaps.select("term", F.shiftright(order, CHUNK_BITS).alias("__part"), order, "gap")
    sums = rows.groupBy("term", "__part").agg(F.sum("gap").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("term").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("term", "__part", before.alias("__base")).where("__base is not null")
    inside = F.sum("gap").over(Window.partitionBy("term", "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    both = rows.select("term", "__part", inside.alias("__inside")).join(bases, ["term", "__part"], "left")
    return both.select("term", (F.col("__inside") + F.coalesce("__base", F.lit(0))).alias("decoded"))


def gap_arrays(posts: DataFrame) -> DataFrame:
    ids = F.col("doc_ids")
    shifted = F.transform(ids, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.element_at(ids, F.greatest(i, F.lit(1)))))
    return posting_arrays(posts).select("term", "doc_freq", shifted.alias("d_gaps"))


def dictionary(posts: DataFrame, offsets: bool = False) -> DataFrame:
    """(term, doc_freq[, postings_offset]); an offset is 4 bytes for each posting of the terms before, in byte order."""
    terms = posts.groupBy("term").agg(F.count("*").alias("doc_freq"))
    # Stored first, as range bounds take a pass of their own.
    return running_sum(durable(terms), [F.col("term")], 4 * F.col("doc_freq"), "postings_offset") if offsets else terms


def index_stats(terms: DataFrame) -> DataFrame:
    """One row: distinct terms and their mean length in bytes."""
    return terms.agg(F.count("*").alias("terms"), F.avg(F.octet_length("term")).alias("mean_term_bytes"))


def forward(docs: DataFrame, url: Column | None = None, title: Column | None = None) -> DataFrame:
    """(doc_id, url, title), null as empty."""
    url = F.col("url") if url is None else url
    title = F.col("title") if title is None else title
    return docs.select("doc_id", F.coalesce(url, F.lit("")).alias("url"), F.coalesce(title, F.lit("")).alias("title"))


def forward_offsets(table: DataFrame) -> DataFrame:
    """(doc_id, offset): after the count and the offset table of 8 bytes each, records of 4 bytes and both texts."""
    n = table.agg((8 + 8 * F.count("*")).alias("head"))  # one row
    size = 4 + F.octet_length("url") + F.octet_length("title")
    return (
        running_sum(table.select("doc_id", size.alias("size")), [F.col("doc_id")], F.col("size"), "before")
        .join(F.broadcast(n))
        .select("doc_id", (F.col("before") + F.col("head")).cast("bigint").alias("offset"))
    )


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id), dictionary (term, doc_freq), forward (doc_id, url, title)."""

    postings: DataFrame
    dictionary: DataFrame
    forward: DataFrame
    buckets: int | None = None

    @staticmethod
    def write_settings(spark: SparkSession, path: str, buckets: int) -> None:
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/settings")

    def save(self, path: str, buckets: int = BUCKETS) -> None:
        """Postings partitioned by term hash and sorted by term inside files, so row groups prune on term.

        A frequent term's postings are dealt on over several files by doc_id. The number of buckets is stored beside."""
        self.write_settings(self.postings.sparkSession, path, buckets)
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(8))
        (
            self.postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
            .repartition("bucket", spread).sortWithinPartitions("bucket", "term", "doc_id")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        )
        self.dictionary.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")
        self.forward.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/forward")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """A stored index, or one that grows by batches: there a document is in one batch, so frequencies add up."""
        buckets = spark.read.parquet(f"{path}/settings").first().buckets
        posts, terms, docs = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "dictionary", "forward"))
        if "batch" in terms.columns:
            posts, docs = posts.drop("batch"), docs.drop("batch")
            terms = terms.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"))
        return Index(posts, terms, docs, buckets)

    def lists_of(self, terms: list[str]) -> DataFrame:
        """Postings of some terms; on a stored index the folder filter prunes files before the term filter does."""
        hits = self.postings.where(F.col("term").isin(terms))
        if self.buckets:
            hits = hits.where(F.col("bucket").isin(sorted({term_bucket(t, self.buckets) for t in terms})))
        return hits.select("term", "doc_id")


def term_bucket(term: str, buckets: int) -> int:
    """bucket_of() on the driver: the 32-bit Murmur3 hash of seed 42, where bytes after the last whole word of four are
    taken one by one as signed numbers."""
    data, mask = term.encode(), 0xFFFFFFFF
    whole = len(data) - len(data) % 4
    units = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)] + [b - 256 if b > 127 else b for b in data[whole:]]
    h = 42
    for unit in units:
        k = unit * 0xCC9E2D51 & mask
        k = ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        h ^= k
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def build_index(docs: DataFrame, text: str = "text", min_chars: int = 1) -> Index:
    """docs: doc_id, text and, where there are, url and title."""
    posts = postings(doc_terms(docs, "doc_id", text, min_chars))
    have = [F.col(c) if c in docs.columns else F.lit("") for c in ("url", "title")]
    return Index(posts, dictionary(posts), forward(docs, *have))
