"""Crawls that are deep or end early lose nothing."""

from textloom.operators import frontier

page = lambda *to: "articleBody" + "".join(f'<a href="/article/n/{x}">' for x in to)
url = "https://h.org/article/n/{}".format
CONFIG = frontier.CrawlConfig(domains=("h.org",))


def _crawl(spark, pages, config=CONFIG, queue=None):
    table = spark.createDataFrame([(url(k), v) for k, v in pages.items()], "url string, html string")
    seen, articles = frontier.crawl(spark.createDataFrame([(url("a0"),)], "url string"), table, config, queue=queue)
    return seen, {r.url.rsplit("/", 1)[1]: (r.status, r.depth) for r in seen.collect()}, articles


def test_a_chain_is_followed_to_its_end(spark):
    _, got, articles = _crawl(spark, {f"a{i}": page(f"a{i + 1}") for i in range(54)})
    assert got == {f"a{i}": ("done", i) for i in range(54)} | {"a54": ("failed", 54)} and articles.count() == 54


def test_what_was_found_is_new(spark):
    pages = {"a0": page("b", "c"), "b": page("d"), "c": "<p>Вы точно человек?</p>", "d": page("e"), "e": page()}
    seen, got, _ = _crawl(spark, pages)
    assert got == {"a0": ("done", 0), "b": ("done", 1), "c": ("new", 1), "d": ("new", 2)}
    _, again, _ = _crawl(spark, pages | {"c": page("f"), "f": page()}, queue=seen)
    assert {k: v for k, (v, _) in again.items()} == dict.fromkeys(["a0", "b", "c", "d", "e", "f"], "done")
    _, short, _ = _crawl(spark, pages, frontier.CrawlConfig(domains=("h.org",), max_depth=0))
    assert short == {"a0": ("done", 0), "b": ("new", 1), "c": ("new", 1)}


def test_crawl_query_equals_its_sql_on_deep_webs(spark, tmp_path):
    """Below 1,791 pages nothing has a missing page eight generations up; the query differed from its SQL beyond."""
    import duckdb

    from textloom import registry

    spark.range(2000).selectExpr("id AS page_id").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, registry.QUERIES["crawl_bfs"](spark, str(tmp_path)).select("url", "status", "depth").collect()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.sql(registry.ORACLES["crawl_bfs"]).select("url, status, depth").fetchall())
    assert ("u1919", "done", 10) in got
