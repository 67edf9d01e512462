"""URL queue, document store and the level-by-level crawl over a table of pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import links as L
from textloom.session import durable

#: Levels of a crawl whose tables are merged into one, so that plans of deep crawls stay short.
MERGE_LEVELS = 20
#: The phrase of a captcha page and the marker of an article page.
CAPTCHA, ARTICLE = "Вы точно человек?", "articleBody"
NEW, PROCESSING, DONE, FAILED = "new", "processing", "done", "failed"


def only_new(candidates: DataFrame, queue: DataFrame, key: str = "url") -> DataFrame:
    """Distinct keys that the queue lacks; their count() is the number inserted."""
    return candidates.select(key).where(F.col(key).isNotNull()).distinct().join(queue.select(key), key, "left_anti")


def enqueue(queue: DataFrame, candidates: DataFrame) -> DataFrame:
    """The queue with absent urls added as new; present ones keep their status."""
    return queue.select("url", "status").unionByName(only_new(candidates, queue).withColumn("status", F.lit(NEW)))


def set_status(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (url, status), one row a url at most."""
    c = changes.select("url", F.col("status").alias("__to"))
    return queue.join(c, "url", "left").select("url", F.coalesce("__to", "status").alias("status"))


def upsert_latest(store: DataFrame, rows: DataFrame, key: str = "url", version: str = "crawled_at") -> DataFrame:
    """One row per key: the one of the highest version, new rows before stored ones at a tie.

    max_by aggregates before the shuffle, so a key with many versions does not land in one task."""
    both = store.withColumn("__n", F.lit(0)).unionByName(rows.withColumn("__n", F.lit(1)))
    body = F.struct(*(c for c in store.columns))
    last = both.groupBy(key).agg(F.max_by(body, F.struct(F.col(version), F.col("__n"), F.xxhash64(body))).alias("__r"))
    return last.select("__r.*")


STORE = "url string, html_content string, source_name string, crawled_at long, http_headers struct<etag: string, last_modified: string>"


def store_rows(fetched: DataFrame) -> DataFrame:
    """Document-store rows of fetched (url, html[, etag, last_modified]); crawled_at is the time of the run in seconds."""
    have = {c: F.col(c) if c in fetched.columns else F.lit(None).cast("string") for c in ("etag", "last_modified")}
    return fetched.select(
        "url", F.col("html").alias("html_content"), L.authority(F.col("url")).alias("source_name"), F.unix_timestamp().alias("crawled_at"),
        F.struct(have["etag"].alias("etag"), have["last_modified"].alias("last_modified")).alias("http_headers"),
    )


def claim(queue: DataFrame, limit: int) -> DataFrame:
    """The queue with the first `limit` new urls, in url order, marked as being processed; give them back by release()."""
    taken = queue.where(F.col("status") == NEW).orderBy("url").limit(limit).select("url", F.lit(PROCESSING).alias("status"))
    return set_status(queue, taken)


def release(queue: DataFrame) -> DataFrame:
    """What was being processed becomes new again, as after an interrupt."""
    return queue.withColumn("status", F.when(F.col("status") == PROCESSING, NEW).otherwise(F.col("status")))


def route(html: Column, captcha: str = CAPTCHA, marker: str = ARTICLE) -> Column:
    """What becomes of a fetched page: failed, captcha, skipped or article."""
    return (
        F.when(html.isNull(), F.lit("failed")).when(H.has_marker(html, captcha), F.lit("captcha"))
        .when(~H.has_marker(html, marker), F.lit("skipped")).otherwise(F.lit("article"))
    )


@dataclass(frozen=True)
class CrawlConfig:
    domains: tuple[str, ...] = ()
    pattern: str = "^https?://[^/]+/article/(n|c)/.+"
    prefix: str = "/article/"
    captcha: str = CAPTCHA
    marker: str = ARTICLE
    max_depth: int | None = None


def crawl(
    seeds: DataFrame, pages: DataFrame, config: CrawlConfig, links: Callable[[DataFrame], DataFrame] | None = None, queue: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first by levels: (queue(url, status, depth), articles(url, html, source_name)).

    pages(url, html) stands for the network: a url without a row fails. Each level is one join of the frontier with
    pages; levels are checkpointed. There is no depth limit unless one is given. A captcha page ends the crawl after its
    level and leaves its url new, as an interrupt does. What a crawl that ends early has found but not visited is new. `links` maps the level's article rows to (url); the default extracts and filters hrefs. `queue`
    resumes an earlier crawl: its done and failed urls are not visited, its new and processing ones are seeds.
    """

    def found(rows: DataFrame) -> DataFrame:
        out = rows.select(F.explode(L.absolute_links(F.col("html"), F.col("url"), config.prefix)).alias("url"))
        return out.where(L.is_allowed(F.col("url"), config.domains, config.pattern)) if config.domains else out.where(F.col("url").rlike(config.pattern))

    links = links or found
    frontier = seeds.select("url").where(F.col("url").isNotNull()).distinct()
    seen = None
    if queue is not None:
        seen = durable(queue.where(F.col("status").isin(DONE, FAILED)).select("url", "status", F.lit(-1).cast("long").alias("depth")))
        again = queue.where(~F.col("status").isin(DONE, FAILED)).select("url")
        frontier = only_new(frontier.union(again), seen)
    articles = None
    for depth in count():
        if config.max_depth is not None and depth > config.max_depth:
            break
        level = frontier.join(pages.select("url", "html"), "url", "left").withColumn("way", route(F.col("html"), config.captcha, config.marker))
        level = durable(level.withColumn("depth", F.lit(depth).cast("long")))
        if level.isEmpty():
            frontier = frontier.limit(0)
            break
        status = F.when(F.col("way") == "failed", FAILED).when(F.col("way") == "captcha", NEW).otherwise(DONE)
        rows = level.select("url", status.alias("status"), "depth")
        seen = rows if seen is None else seen.unionByName(rows)
        got = level.where(F.col("way") == "article").select("url", "html", L.authority(F.col("url")).alias("source_name"))
        articles = got if articles is None else articles.unionByName(got)
        if depth % MERGE_LEVELS == MERGE_LEVELS - 1:
            seen, articles = durable(seen), durable(articles)
        frontier = only_new(links(level.where(F.col("way") == "article")), seen)
        if not level.where(F.col("way") == "captcha").isEmpty():
            depth += 1
            break
    rest = frontier.select("url", F.lit(NEW).alias("status"), F.lit(depth).cast("long").alias("depth"))
    seen = rest if seen is None else seen.unionByName(rest)
    if articles is None:
        articles = seeds.sparkSession.createDataFrame([], "url string, html string, source_name string")
    return seen, articles
