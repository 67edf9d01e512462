"""Readers for the formats that stages exchange."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, html) of *.html files below a folder, one row a file."""
    return (
        spark.read.text(path, wholetext=True, pathGlobFilter="*.html")
        .select(F.regexp_extract(F.col("_metadata.file_name"), "([^/]*)\\.html$", 1).alias("name"), F.col("value").alias("html"))
    )


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of *.txt files."""
    return (
        spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
        .select(F.regexp_extract(F.col("_metadata.file_name"), "([^/]*)\\.txt$", 1).alias("name"), F.col("value").alias("text"))
    )


def documents_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) lines; a line without a tab or with a bad id is left out."""
    lines = spark.read.text(path)
    parts = F.regexp_extract("value", "^(\\d+)\t(.*)$", 1), F.regexp_extract("value", "^(\\d+)\t(.*)$", 2)
    return lines.select(parts[0].try_cast("long").alias("doc_id"), parts[1].alias("text")).where("doc_id is not null")


def tokens_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id) lines; rows that lack a field are left out."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return lines.where(F.size("p") >= 2).select(F.col("p")[0].alias("term"), F.col("p")[1].try_cast("long").alias("doc_id")).where("term <> '' and doc_id is not null")


def frequencies_txt(spark: SparkSession, path: str) -> DataFrame:
    """(freq, term) of lines with exactly two fields."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("p"))
    return lines.where(F.size("p") == 2).select(F.col("p")[0].try_cast("long").alias("freq"), F.col("p")[1].alias("term")).where("freq is not null")


def doc_info_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url, title); missing fields are empty."""
    p = F.split("value", "\t")
    lines = spark.read.text(path)
    return lines.select(
        F.try_element_at(p, F.lit(1)).try_cast("long").alias("doc_id"),
        F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")).alias("url"),
        F.coalesce(F.try_element_at(p, F.lit(3)), F.lit("")).alias("title"),
    )


def load_progress(spark: SparkSession, path: str, sections: list[str]) -> DataFrame:
    """(section, next_page): the stored state, 1 for sections that it lacks or that are corrupt; a missing file is empty state."""
    wanted = spark.createDataFrame([(s,) for s in sections], "section string")
    try:
        rows = spark.read.schema("section string, next_page int").json(path)
        rows.schema  # noqa: B018
        stored = rows.where("section is not null and next_page is not null").groupBy("section").agg(F.max("next_page").alias("stored"))
    except Exception as e:  # the path check is Spark's own; other faults must show
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], "section string, stored int")
    return wanted.join(stored, "section", "left").select("section", F.coalesce("stored", F.lit(1)).alias("next_page"))


def load_links(spark: SparkSession, path: str) -> DataFrame:
    """(link) of a stored link set, one a line; a missing file is the empty set."""
    try:
        rows = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], "value string")
    return rows.select(F.trim("value").alias("link")).where("link <> ''").distinct()


def queries_txt(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of the lines that are not blank, numbered by place in the files."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("query_id"), F.trim("value").alias("query"))
    return rows.where("query <> ''")


@dataclass(frozen=True)
class CrawlerSettings:
    """The settings of a crawl: store, logic, crawler."""

    store_path: str = "store"
    delay_s: float = 0.0
    user_agent: str = "textloom"
    seeds: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    @staticmethod
    def from_mapping(given: dict) -> CrawlerSettings:
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in CrawlerSettings.__dataclass_fields__ and k != "extra"}
        return CrawlerSettings(**known, extra={k: v for k, v in given.items() if k not in known})

    @staticmethod
    def from_yaml(path: str) -> CrawlerSettings:
        """Settings of a YAML file whose sections are merged; needs the yaml package."""
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML settings needs the yaml package") from e
        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
        flat = {}
        for k, v in given.items():
            flat.update(v if isinstance(v, dict) else {k: v})
        return CrawlerSettings.from_mapping(flat)


def listing(pages: DataFrame, progress: DataFrame, links_prefix: str, max_pages: int = 50) -> DataFrame:
    """(link, section, page) of listing pages from each section's next page on, up to the limit of pages.

    pages(section, page, html) stands for the network."""
    from textloom.functions.links import listing_links

    due = pages.join(progress, "section").where((F.col("page") >= F.col("next_page")) & (F.col("page") <= max_pages))
    return due.select(F.explode(listing_links(F.col("html"), links_prefix)).alias("link"), "section", "page")
