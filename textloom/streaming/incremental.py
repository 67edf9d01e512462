"""Incremental indexing: new documents of a watched folder become part of a stored index, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index import BUCKETS, Index, bucket_of, dictionary, forward
from textloom.operators.tokens import doc_terms
from textloom.session import durable

#: Postings that one task sorts and writes.
ROWS_A_TASK = 1_000_000


def _stored(spark: SparkSession, path: str, columns: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], columns)


def add_documents(docs: DataFrame, path: str, batch: int | None = None, min_chars: int = 1, buckets: int = BUCKETS) -> None:
    """Adds documents that the index at `path` lacks: postings by bucket, dictionary, forward table. Index.load opens it.

    docs: doc_id, text and, where there are, url and title; of rows that share a doc_id one is taken, once for all tables.
    Each batch owns folders that it overwrites, so a batch that is run again after a failure replaces its own output
    instead of adding to it. The forward table goes last: a document counts as indexed only when its postings are there.
    The first batch sets the number of buckets.
    """
    spark = docs.sparkSession
    number = batch if batch is not None else _next(spark, path)
    settings = _stored(spark, f"{path}/settings", "buckets int").first()
    buckets = settings.buckets if settings else buckets
    if not settings:
        Index.write_settings(spark, path, buckets)
    known = _stored(spark, f"{path}/forward", "doc_id long, batch int")
    others = known.where(known["batch"] != number).select("doc_id")
    columns = [c for c in ("doc_id", "text", "url", "title") if c in docs.columns]
    fresh = durable(docs.select(*columns).dropDuplicates(["doc_id"]).join(others, "doc_id", "left_anti"))
    posts = durable(doc_terms(fresh, min_chars=min_chars).select("term", "doc_id"))  # distinct, as documents and their terms are
    tasks = 1 + posts.count() // ROWS_A_TASK  # tasks of a bounded size, however few buckets there are
    ranged = posts.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartitionByRange(tasks, "bucket", "term", "doc_id")
    sorted_ = ranged.sortWithinPartitions("bucket", "term", "doc_id")
    sorted_.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
    dictionary(posts).write.mode("overwrite").parquet(f"{path}/dictionary/batch={number}")
    have = [F.col(c) if c in columns else F.lit("") for c in ("url", "title")]
    forward(fresh, *have).write.mode("overwrite").parquet(f"{path}/forward/batch={number}")


def _next(spark: SparkSession, path: str) -> int:
    last = _stored(spark, f"{path}/forward", "doc_id long, batch int").agg({"batch": "max"}).first()[0]
    return 0 if last is None else int(last) + 1


def index_stream(docs: DataFrame, path: str, checkpoint: str, min_chars: int = 1) -> StreamingQuery:
    """Indexes a stream of (doc_id, text) and stops when what is there now is done; started again, it resumes."""
    return (
        docs.writeStream.foreachBatch(lambda rows, n: add_documents(rows, path, n, min_chars))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def watch(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
