"""Queries of the operators over the test tables, with SQL where SQL can express them."""

from __future__ import annotations


import public_tokenizers

from textloom.llm import decontaminate, html_text, language, licenses, mixing, near_dup, quality, token_counts, token_files, toxicity
from textloom.llm.common import read

QUERIES, ORACLES = {}, {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op10_quality_rules(spark, sf_dir):
    out = quality.assess(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op10_quality_rules"] = quality.oracle()




@_query
def op6_minhash_near_dedup(spark, sf_dir):
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


@_query
def op1_benchmark_decontamination(spark, sf_dir):
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query
def op4_license_scan(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents"))


ORACLES["op4_license_scan"] = licenses.oracle()


@_query
def op5_source_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


@_query
def op8_language_id(spark, sf_dir):
    return language.identify(read(spark, sf_dir, "documents"))


@_query
def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op2_token_output(spark, sf_dir):
    return token_files.written_index(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op3_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op9_html_extraction(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


#: All pairs that share a shingle, compared on full sets, and the smallest id reachable.
ORACLES["op6_minhash_near_dedup"] = """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) END AS s FROM w),
    n AS (SELECT doc_id, len(s) AS n FROM s),
    u AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS h FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""
