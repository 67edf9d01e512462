"""Link discovery over paged section listings, resumable by (section, next_page)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.links import listing_links
from textloom.session import durable

MAX_PAGES = 50


def discover(
    pages: DataFrame, progress: DataFrame, target: int, known: DataFrame | None = None, prefix: str = "/article/n/", max_pages: int = MAX_PAGES
) -> tuple[DataFrame, DataFrame]:
    """(links(link), progress(section, next_page)) after visiting each section's pages in turn.

    pages(section, page, html) stands for the network. One round visits one page of every section that is not past
    `max_pages`; rounds go on until `target` links are known or no section moves. A page that is missing or has no html
    has failed: its section stays at that page and is tried again by the next run. Known links are kept."""
    state = durable(progress.select("section", F.col("next_page").cast("int").alias("next_page")))
    links = known.select("link").where("link is not null").distinct() if known is not None else state.sparkSession.createDataFrame([], "link string")
    links = durable(links)
    while links.count() < target:
        due = state.where(F.col("next_page") <= max_pages).withColumnRenamed("next_page", "page")
        got = durable(due.join(pages.where("html is not null").select("section", "page", "html"), ["section", "page"]))
        if got.isEmpty():
            break
        found = got.select(F.explode(listing_links(F.col("html"), prefix)).alias("link")).distinct()
        links = durable(links.union(found.join(links, "link", "left_anti")))
        moved = got.select("section").distinct().withColumn("step", F.lit(1))
        state = durable(state.join(moved, "section", "left").select("section", (F.col("next_page") + F.coalesce("step", F.lit(0))).alias("next_page")))
    return links, state


def absent(links: DataFrame, stored: DataFrame, key: str = "link") -> DataFrame:
    """Links that are not stored yet."""
    return links.select(key).distinct().join(stored.select(key), key, "left_anti")


def fetched(links: DataFrame, pages: DataFrame, key: str = "link") -> DataFrame:
    """(key, html) of the links that pages has; the others are errors of their own and stop nothing."""
    return links.join(pages.select(key, "html"), key).where("html is not null")
