"""Corpus size statistics, in bytes of files and in code points of bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats_bytes(pages: DataFrame, raw: Column, clean: Column) -> DataFrame:
    """One row: docs, MB raw and clean, mean KB of each (1024-based, 2 decimals; null without documents)."""
    n = F.nullif(F.count(raw), F.lit(0))
    r, c = F.coalesce(F.sum(F.octet_length(raw)), F.lit(0)), F.coalesce(F.sum(F.octet_length(clean)), F.lit(0))
    return pages.agg(
        F.count(raw).alias("docs"), F.round(r / 1024 / 1024, 2).alias("raw_mb"), F.round(c / 1024 / 1024, 2).alias("clean_mb"),
        F.round(r / n / 1024, 2).alias("mean_raw_kb"), F.round(c / n / 1024, 2).alias("mean_clean_kb"),
    )


def stats_chars(pages: DataFrame, raw: Column, body: Column) -> DataFrame:
    """One row: docs, code points raw and of bodies, means (null without documents)."""
    n = F.nullif(F.count("*"), F.lit(0))
    r, b = F.coalesce(F.sum(F.char_length(raw)), F.lit(0)), F.coalesce(F.sum(F.char_length(body)), F.lit(0))
    return pages.agg(
        F.count("*").alias("docs"), r.alias("raw_chars"), b.alias("body_chars"), (r / n).alias("mean_raw_chars"), (b / n).alias("mean_body_chars")
    )
