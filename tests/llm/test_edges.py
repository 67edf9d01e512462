"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: every operator, defined results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontaminate, html_text, language, licenses, mixing, near_dup, quality, token_counts, token_files, toxicity

VOCABULARY = corpus_pipeline.TOKENIZER
CLASH = ["rid", "key", "n", "rep", "component", "words", "slot", "block", "place", "weight", "__t", "rows", "part", "kept", "score", "x"]
LONG = "word " * 40_000
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, " \n ", "en", "a"), (4, "one two three", "en", None), (4, "one two three", "en", None), (5, LONG, "de", "b"), (None, "no id at all here", "en", "b"), (6, "### 12 \x00 é", None, "a")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "never seen by any of these rows", 0)], "item_id long, text string, n int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")


OPERATORS = {
    "op1": lambda d, i, la: decontaminate.leaks(d, i),
    "op2": lambda d, i, la: token_files.written_index(d, VOCABULARY),
    "op3": lambda d, i, la: toxicity.score(d, la),
    "op4": lambda d, i, la: licenses.license_scan(d),
    "op5": lambda d, i, la: mixing.mix(d),
    "op6": lambda d, i, la: near_dup.near_duplicates(d),
    "op7": lambda d, i, la: token_counts.token_counts(d, VOCABULARY),
    "op8": lambda d, i, la: language.identify(d),
    "op10": lambda d, i, la: quality.assess(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_a_row(docs, items, labels, name):
    got = OPERATORS[name](docs, items, labels).collect()
    assert len(got) == (0 if name == "op1" else len(ROWS))
    if name != "op1":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, items, labels, name):
    assert OPERATORS[name](empty, items, labels).count() == 0


def test_empty_benchmark_and_labels(docs, items, labels):
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}


STAGES = [quality.filter_documents, near_dup.filter_documents, mixing.mixed_documents, lambda d: decontaminate.filter_documents(d, d.select(F.lit(9).alias("item_id"), F.lit("not here").alias("text")).limit(1))]


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns(docs, empty, number):
    got = STAGES[number](docs)
    assert got.columns == docs.columns
    assert got.count() == [1, 7, 8, 8][number] if number else got.count() <= len(ROWS)
    assert STAGES[number](empty).count() == 0


def test_defined_values(docs, items, labels):
    near = [tuple(r) for r in near_dup.near_duplicates(docs).collect()]
    assert (1, 0, 1, True) in near and near.count((4, 1, 4, True)) == 2 and (5, 1, 5, True) in near and (None, 1, None, True) in near
    lang = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.count_texts({"en": ["one two"], "fr": ["né à"]})).collect()}
    assert lang[1] == lang[2] == lang[3] == ("und", 0.0) and lang[6][0] == "fr" and lang[4][0] == "en"
    lic = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (lic[1].n_words, lic[1].n_base, lic[1].first_word, lic[1].labels, lic[1].score) == (0, 0, None, "", 0.0)
    q = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert q[1].base_failed and not q[1].kept and q[5].n_words == 40_000 and q[5].n_repeat_words == 40_000
    t = {r.doc_id: r.n_tokens for r in token_files.written_index(docs, VOCABULARY).collect()}
    assert t[1] == t[2] == 1 and t[5] > 40_000


def test_pages(spark):
    rows = [(1, None, None), (2, "https://h/x", ""), (2, "https://h/x", "<p>a"), (3, "no url at all", "<div>" * 300 + "deep"), (None, "https://h/y", "<p>b &amp; c</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "texts", "codes", "pattern", "fixed", "text")})
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(0, "b & c", 5), (1, "", 0), (2, "", 0), (2, "a", 1), (3, "deep", 4)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pipeline_on_odd_and_empty_tables(docs, items, tmp_path):
    """Nulls, repeated rows, clashing names and empty tables through all five stages."""
    for name, frame in (("odd", docs), ("empty", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    spark = docs.sparkSession
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    kept = near_dup.filter_documents(quality.filter_documents(docs))
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in kept.collect())
    assert corpus_pipeline.token_output(spark, docs, "").count() == len(ROWS) and corpus_pipeline.token_output(spark, docs.limit(0), "").count() == 0
