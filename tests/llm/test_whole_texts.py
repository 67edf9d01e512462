"""Token files against an unaltered library, on texts that end in white space or hold special tokens."""

import zlib

import numpy as np

import corpus_pipeline
from textloom.llm import token_files

ENDS = ["foo bar\n\n", "foo bar\n", "foo bar\n\n\n\n", "foo ", "\n\n", "a b\nc\n\nd\n\n", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n\n", "plain text here"]


def test_files_equal_an_unaltered_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    docs = spark.createDataFrame(list(enumerate(ENDS)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.written_index(docs, corpus_pipeline.TOKENIZER).collect()}
    start = 0
    for doc, text in enumerate(ENDS):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)
