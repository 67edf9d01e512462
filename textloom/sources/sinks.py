"""Writers for the formats that stages exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_absent(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key the table at `path` lacks: running it again writes nothing."""
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows.dropDuplicates([key]).write.mode("append").parquet(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """doc_id, text as tab-separated lines, with tabs and line ends of texts as spaces."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[\t\r\n]", " ")
    docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), clean).alias("value")).write.mode("overwrite").text(path)


def write_tokens(toks: DataFrame, path: str) -> None:
    """term, doc_id as tab-separated lines."""
    toks.select(F.concat_ws("\t", "term", F.col("doc_id").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_doc_info(table: DataFrame, path: str) -> None:
    """doc_id, url, title as tab-separated lines, with tabs and newlines of titles as spaces."""
    clean = F.regexp_replace(F.coalesce("title", F.lit("")), "[\t\n]", " ")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("url", F.lit("")), clean)
    table.select(line.alias("value")).write.mode("overwrite").text(path)


def write_frequencies(frequencies: DataFrame, path: str) -> None:
    """`count term` lines, by falling count and term."""
    ordered = frequencies.orderBy(F.desc("freq"), F.desc("term"))
    ordered.select(F.concat_ws(" ", F.col("freq").cast("string"), "term").alias("value")).write.mode("overwrite").text(path)


def save_progress(progress: DataFrame, path: str) -> None:
    progress.select("section", "next_page").write.mode("overwrite").json(path)


def save_links(links: DataFrame, path: str) -> None:
    """The link set, one a line."""
    links.select("link").distinct().write.mode("overwrite").text(path)


def write_html(pages: DataFrame, path: str, key: str = "name") -> None:
    """(name, html) rows that the table lacks."""
    append_absent(pages.select(key, "html"), path, key)


def write_html_files(pages: DataFrame, path: str) -> None:
    """(name, html) as name.html files of a local or mounted folder that all executors share; rows stay where they are and
    names must be unique. A file is replaced as a whole, so a task that runs again does no harm."""
    import os

    def run(batches):
        os.makedirs(path, exist_ok=True)
        for batch in batches:
            for name, html in zip(batch["name"], batch["html"], strict=True):
                if html is not None:
                    with open(f"{path}/.{name}.part", "w", encoding="utf-8", newline="") as f:
                        f.write(html)
                    os.replace(f"{path}/.{name}.part", f"{path}/{name}.html")
            yield batch[["name"]]

    pages.select("name", "html").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
