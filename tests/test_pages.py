"""Extraction, links, frontier, files, streaming."""

from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import links as L
from textloom.operators import corpus, discover, frontier
from textloom.operators.ordering import number_rows
from textloom.sources import readers, sinks
from textloom.streaming.incremental import index_stream, watch

PAGES = [
    '<h1 itemprop="headline"> A <i> B </i></h1><div itemprop="articleBody"><p>xOne</p><p> Two </p></div>',
    "<p>none</p>",
    '<div class="big ocr">a<p>b</p></div><article>z</article>',
    "<article> p <b>q</b></article>",
    None,
    "",
]


def test_extraction(spark):
    h = F.col("html")
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES)], "i int, html string")
    got = rows.select("i", H.title(h), H.article_body(h), H.ocr_or_article(h), H.ocr_only(h)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("AB", "One\nTwo", None, ""), ("No Title", "No Body", None, ""), ("No Title", "No Body", "a b", "a b"),
        ("No Title", "No Body", "p q", ""), ("No Title", "No Body", None, ""), ("No Title", "No Body", None, ""),
    ]


def test_links(spark):
    html = "".join(f'<a href="{x}">' for x in ("/article/n/a?x=1#f", "/article/n/a", "/other", "/article/n/b/../c"))
    row = spark.createDataFrame([(html, "https://h.org/article/c/x")], "html string, url string")
    got = row.select(L.absolute_links(F.col("html"), F.col("url"))).first()[0]
    assert sorted(got) == ["https://h.org/article/n/a", "https://h.org/article/n/c"]
    assert row.select(L.is_allowed(F.col("url"), ["h.org"], "^https://h.org/article/(n|c)/.+")).first()[0]


def test_frontier(spark):
    queue = spark.createDataFrame([("a", "done"), ("b", "new")], "url string, status string")
    more = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "url string")
    assert sorted(map(tuple, frontier.enqueue(queue, more).collect())) == [("a", "done"), ("b", "new"), ("c", "new")]
    store = spark.createDataFrame([("a", "old", 1), ("b", "old", 5)], "url string, html string, crawled_at long")
    new = spark.createDataFrame([("a", "new", 2), ("b", "same", 5)], "url string, html string, crawled_at long")
    assert sorted(map(tuple, frontier.upsert_latest(store, new).collect())) == [("a", "new", 2), ("b", "same", 5)]


def test_crawl_follows_links_and_resumes(spark):
    page = lambda *to: "articleBody" + "".join(f'<a href="/article/n/{x}?q">' for x in to)
    url = "https://h.org/article/n/{}".format
    pages = spark.createDataFrame([(url("a"), page("b", "c")), (url("b"), page("a", "d")), (url("c"), "plain")], "url string, html string")
    config = frontier.CrawlConfig(domains=("h.org",))
    seen, articles = frontier.crawl(spark.createDataFrame([(url("a"),)], "url string"), pages, config)
    assert {r.url[-1]: (r.status, r.depth) for r in seen.collect()} == {"a": ("done", 0), "b": ("done", 1), "c": ("done", 1), "d": ("failed", 2)}
    assert sorted(r.url[-1] for r in articles.collect()) == ["a", "b"]
    queue = spark.createDataFrame([(url("a"), "done"), (url("b"), "processing")], "url string, status string")
    again, _ = frontier.crawl(spark.createDataFrame([(url("a"),)], "url string"), pages, config, queue=queue)
    assert {r.url[-1]: r.status for r in again.collect()} == {"a": "done", "b": "done", "d": "failed"}


def test_numbers_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    assert number_rows(rows, [F.col("id")], "n").where("n <> id").count() == 0


def test_empty_corpus(spark):
    pages = spark.createDataFrame([], "html string")
    assert tuple(corpus.stats_chars(pages, F.col("html"), F.col("html")).first()) == (0, 0, 0, None, None)


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x\ny</p>")
    assert [tuple(r) for r in readers.html_files(spark, str(tmp_path)).collect()] == [("a", "<p>x\ny</p>")]
    rows = spark.createDataFrame([(1, "u", "a\tb\nc")], "doc_id long, url string, title string")
    sinks.write_doc_info(rows, str(tmp_path / "info"))
    assert [tuple(r) for r in readers.doc_info_tsv(spark, str(tmp_path / "info")).collect()] == [(1, "u", "a b c")]
    for _ in range(2):
        sinks.append_absent(rows, str(tmp_path / "store"), "url")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    sinks.save_progress(spark.createDataFrame([("s", 7)], "section string, next_page int"), str(tmp_path / "state"))
    got = readers.load_progress(spark, str(tmp_path / "state"), ["s", "t"]).collect()
    assert sorted(map(tuple, got)) == [("s", 7), ("t", 1)]
    assert readers.load_progress(spark, str(tmp_path / "missing"), ["s"]).first().next_page == 1
    (tmp_path / "f.txt").write_text("  3 x\n bad\n2 y\n")
    assert sorted(map(tuple, readers.frequencies_txt(spark, str(tmp_path / "f.txt")).collect())) == [(2, "y"), (3, "x")]


def test_stream_is_idempotent(spark, tmp_path):
    docs = str(tmp_path / "docs")
    for batch in ([(1, "a b"), (2, "b")], [(2, "b"), (3, "c a")]):
        spark.createDataFrame(batch, "doc_id long, text string").coalesce(1).write.mode("append").parquet(docs)
        index_stream(watch(spark, docs), str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "index/postings")).select("term", "doc_id").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("a", 3), ("b", 1), ("b", 2), ("c", 3)]


def test_discovery_resumes_at_failed_pages(spark):
    page = lambda *n: "".join(f'<a href="/article/n/{x}">' for x in n)
    rows = [("s", 1, page(1, 2)), ("s", 2, None), ("t", 1, page(2, 3)), ("t", 2, page(4)), ("t", 3, page(5))]
    pages = spark.createDataFrame(rows, "section string, page int, html string")
    start = spark.createDataFrame([("s", 1), ("t", 1)], "section string, next_page int")
    links, state = discover.discover(pages, start, 4)
    assert sorted(r.link for r in links.collect()) == [f"/article/n/{i}" for i in (1, 2, 3, 4)]
    assert sorted(map(tuple, state.collect())) == [("s", 2), ("t", 3)]
    links, state = discover.discover(pages, state, 99, links)
    assert links.count() == 5 and sorted(map(tuple, state.collect())) == [("s", 2), ("t", 4)]
    stored = spark.createDataFrame([("/article/n/1",)], "link string")
    web = spark.createDataFrame([("/article/n/2", "x"), ("/article/n/3", None)], "link string, html string")
    assert [tuple(r) for r in discover.fetched(discover.absent(links, stored), web).collect()] == [("/article/n/2", "x")]


def test_claims_and_store(spark):
    queue = spark.createDataFrame([("b", "new"), ("a", "new"), ("c", "done")], "url string, status string")
    claimed = frontier.claim(queue, 1)
    assert sorted(map(tuple, claimed.collect())) == [("a", "processing"), ("b", "new"), ("c", "done")]
    assert sorted(map(tuple, frontier.release(claimed).collect())) == [("a", "new"), ("b", "new"), ("c", "done")]
    row = frontier.store_rows(spark.createDataFrame([("https://h.org:8/x", "p", "e1")], "url string, html string, etag string")).first()
    assert (row.source_name, row.http_headers.etag, row.http_headers.last_modified) == ("h.org:8", "e1", None) and row.crawled_at > 1_600_000_000


def test_links_and_queries_files(spark, tmp_path):
    assert readers.load_links(spark, str(tmp_path / "none")).count() == 0
    sinks.save_links(spark.createDataFrame([("a",), ("b",), ("a",)], "link string"), str(tmp_path / "links"))
    assert sorted(r.link for r in readers.load_links(spark, str(tmp_path / "links")).collect()) == ["a", "b"]
    (tmp_path / "q.txt").write_text("a && b\n\n  \n!c\n")
    assert [r.query for r in readers.queries_txt(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()] == ["a && b", "!c"]


def test_intermediate_tables_can_be_cleared(spark):
    import os

    from textloom.session import clear, written

    table = written(spark.range(3), "some")
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and clear(spark) >= 1 and not os.path.exists(path) and clear(spark) == 0


def test_a_batch_is_written_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """One task a bucket grew with the input."""
    from textloom.operators.index import Index
    from textloom.streaming import incremental

    monkeypatch.setattr(incremental, "ROWS_A_TASK", 50)
    docs = spark.createDataFrame([(i, f"common word{i}") for i in range(100)] + [(0, "other common")], "doc_id long, text string")
    incremental.add_documents(docs.where("text <> 'other common'"), str(tmp_path / "i"), buckets=1)
    incremental.add_documents(docs, str(tmp_path / "i"))  # adds nothing
    assert len(list((tmp_path / "i/postings/batch=0").glob("bucket=0/*.parquet"))) == 5
    index = Index.load(spark, str(tmp_path / "i"))
    assert sorted((r.term, r.doc_id) for r in index.postings.collect()) == sorted((t, i) for i in range(100) for t in ("common", f"word{i}"))
    assert {r.term: r.doc_freq for r in index.dictionary.collect()} == {"common": 100} | {f"word{i}": 1 for i in range(100)}


def test_made_pages_take_words_wherever_they_are(spark, tmp_path):
    """The whole text was split into words, twice; the selectors' ocr block was looked for twice."""
    from textloom import registry

    texts = [" 1a b\nc-d é e  ff", "a b c d e", "", None, "7" * 5000 + "q w e" + "\n" * 5000 + "r t yé zz", "a,b,c,d,e,f"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["real_selectors"](spark, str(tmp_path)).collect()}
    assert got == {0: ("a b", "\nd e", "", None), 4: ("No Title", "No Body", "y q", "y q"), 5: ("No Title", "No Body", "", "b")}
    plan = registry.QUERIES["real_selectors"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(text#") == 1 and plan.count("found(") == 3
