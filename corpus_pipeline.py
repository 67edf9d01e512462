"""The corpus pipeline: documents to token files in five stages, each written as Parquet and read again by the next.

A stage judges every row that the one before kept. All but the last return the columns of documents; the fourth returns
the rows in mixed order, which is the order of its files, and the fifth encodes in that order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, mixing, near_dup, quality, token_files
from textloom.llm.common import read
from textloom.session import written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.filter_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filter_documents(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files, in the order of the rows of docs' files; of rows from elsewhere, by doc_id."""
    try:
        part = F.regexp_extract("_metadata.file_name", "part-(\\d+)", 1).cast("int")
        placed = docs.select("doc_id", "text", part.alias("part_no"), F.col("_metadata.row_index").alias("row_no"))
        order = ["part_no", "row_no"]
        placed.schema  # noqa: B018  the columns are there or not
    except AnalysisException:
        placed, order = docs, None
    return token_files.written_index(placed, TOKENIZER, order)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]
#: Votes, signatures and coding are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
