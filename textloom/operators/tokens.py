"""Tokens, term frequencies, rank curves and token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.terms import terms
from textloom.operators.ordering import number_rows
from textloom.session import durable


def _terms(raw: DataFrame, min_chars: int) -> DataFrame:
    """Raw tokens in column `term` to terms; rows whose term is not valid go."""
    rest = [c for c in raw.columns if c != "term"]
    low = raw.select(*rest, X.lowercase(X.truncate(F.col("term"))).alias("term"))
    return X.stemmed(low, "term").where(X.is_valid(F.col("term"), min_chars))


def tokens(frame: DataFrame, key: str = "doc_id", text: str | Column = "text", min_chars: int = 1, stemmed: bool = True) -> DataFrame:
    """One row per token: key, pos (of the raw token, from 0) and term.

    Validity is decided after stemming, so `pos` has gaps where tokens were rejected. Null texts give no rows.
    """
    column = F.col(text) if isinstance(text, str) else text
    found = frame.select(F.col(key), F.posexplode(terms(frame.sparkSession, column, min_chars, stemmed)).alias("pos", "term"))
    return found.where("term is not null").select(key, F.col("pos").cast("bigint").alias("pos"), "term")


def doc_terms(frame: DataFrame, key: str = "doc_id", text: str | Column = "text", min_chars: int = 1) -> DataFrame:
    """(key, term) with each term of a row once: what postings are made of. Rows that share a key may repeat terms."""
    column = F.col(text) if isinstance(text, str) else text
    return frame.select(F.col(key), F.explode(terms(frame.sparkSession, column, min_chars, distinct=True)).alias("term"))


def term_counts(frame: DataFrame, text: str | Column = "text", min_chars: int = 1) -> DataFrame:
    """(term, freq) over all tokens. Raw tokens are counted first, so each distinct one is stemmed once."""
    column = F.col(text) if isinstance(text, str) else text
    raw = frame.select(F.explode(X.raw_tokens(column)).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    return _terms(raw, min_chars).groupBy("term").agg(F.sum("freq").alias("freq"))


def term_frequencies(toks: DataFrame) -> DataFrame:
    """(term, freq); partial counts are made before the shuffle."""
    return toks.groupBy("term").agg(F.count("*").alias("freq"))


def top_terms(frequencies: DataFrame, k: int = 10) -> DataFrame:
    return frequencies.orderBy(F.desc("freq"), F.desc("term")).limit(k)


def zipf(frequencies: DataFrame) -> DataFrame:
    """(rank, term, freq, ideal, log_rank, log_freq): ranks by falling frequency, ties by falling term in byte order."""
    frequencies = durable(frequencies)  # read three times: for range bounds, for the ranks and for the maximum
    ranked = number_rows(frequencies, [F.desc("freq"), F.desc("term")], "rank", start=1)
    top = frequencies.agg(F.max("freq").alias("top"))  # one row
    return ranked.join(F.broadcast(top)).select(
        "rank", "term", "freq", (F.col("top").cast("double") / F.col("rank")).alias("ideal"),
        F.log10("rank").alias("log_rank"), F.log10("freq").alias("log_freq"),
    )


def token_stats(documents: DataFrame, text: str = "text", min_chars: int = 2) -> DataFrame:
    """One row: tokens, mean token length in bytes (null without tokens), bytes processed."""
    counts = term_counts(documents, text, min_chars)
    total = F.coalesce(F.sum("freq"), F.lit(0))
    toks = counts.agg(total.alias("tokens"), (F.sum(F.octet_length("term") * F.col("freq")) / total).alias("mean_token_bytes"))
    size = documents.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("bytes"))
    return toks.join(F.broadcast(size))
