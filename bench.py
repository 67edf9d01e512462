"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom import registry
from textloom.operators import index as I
from textloom.operators import tokens as T
from textloom.plans import search as P
from textloom.session import shared_dir, spread

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["doc_tokens", "stem_translit_terms", "term_frequency", "zipf_curve", "corpus_token_stats", "postings", "dictionary_offsets", "bool_nested", "batch_queries", "forward_index", "extract_article_text", "page_links", "corpus_stats_chars"]


def timed(f) -> float:
    start = time.time()
    f()
    return time.time() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain = lambda frame: frame.write.format("noop").mode("overwrite").save()
    drain(registry.doc_tokens(spark, SF))  # warm-up
    took = {n: timed(lambda n=n: drain(registry.QUERIES[n](spark, SF))) for n in NAMES}
    docs = spread(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    mb = docs.agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    root = f"{shared_dir(spark)}/bench-index-{os.getpid()}"
    took["index_build_and_save"] = timed(lambda: I.build_index(docs).save(root, buckets=16))
    stored = I.Index.load(spark, root)
    n = stored.dictionary.count()
    frequent = [r.term for r in stored.dictionary.orderBy(F.desc("doc_freq")).limit(12).collect()]
    some = [r.term for r in T.top_terms(stored.dictionary.withColumnRenamed("doc_freq", "freq").where("freq < 50"), 12).collect()]
    texts = [q for a, b in zip(frequent, some, strict=True) for q in (f"{a} && {b}", f"{a} || {b}", f"!{a} {b}", f"({a} || {b}) && !{frequent[0]}")]
    took["stored_queries"] = timed(lambda: [P.search(stored, q).count() for q in texts])
    rows = docs.count()
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(took.values()), 2), "unit": "sec", "queries": {k: round(v, 3) for k, v in took.items()},
        "sf": SF, "tokenized_mb_s": round(mb / took["doc_tokens"], 1), "index_ms_per_doc": round(1000 * took["index_build_and_save"] / rows, 3),
        "mean_query_ms": round(1000 * took["stored_queries"] / len(texts), 1), "distinct_terms": n,
    }))


if __name__ == "__main__":
    main()
