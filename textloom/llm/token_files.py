"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A table of segments is the file format; each row is one segment of whole documents in doc_id order and can be decoded
alone: part, segment, start (tokens of the part before it), n_tokens, doc_ids, lengths, payload. The payload is a
header and blocks of BLOCK_TOKENS ids: for each block its coded size and the crc32 of its ids, then the coded words.
A damaged block is found by its checksum and touches no other block. Coding is in `context_mixing`: every block starts
from empty statistics of order 0 to 2. `pack` and `unpack` need no Spark and code all blocks of a segment in step; tables
are written and read by the same coder's form in `jvm_coder`, block by block.

A null or empty text is just the end id. Rows that share a doc_id stay in the order of their texts. Extra columns are
not read. An empty table gives no segments.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.context_mixing import BLOCK_TOKENS, IDS, decode_blocks, encode_blocks
from textloom.llm.hashing import chunks
from textloom.llm.jvm_coder import function
from textloom.session import shared_dir

#: Blocks of a segment, about; a segment ends with a document.
SEGMENT_BLOCKS = 1024
END_ID = 0
#: Of the second form of payloads.
MAGIC = b"TLT2"
SEGMENTS = "part int, segment int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """A payload: header, directory of blocks, coded blocks."""
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError(f"ids must be below {IDS}")
    blocks = [ids[i : i + BLOCK_TOKENS] for i in range(0, len(ids), BLOCK_TOKENS)]
    coded = encode_blocks(blocks) if blocks else []
    directory = b"".join(struct.pack("<III", len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(blocks, coded, strict=True))
    return MAGIC + struct.pack("<I", len(blocks)) + directory + b"".join(coded)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload; raises ValueError that names the block where a checksum fails."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token payload")
    n = struct.unpack_from("<I", payload, 4)[0]
    entries = [struct.unpack_from("<III", payload, 8 + 12 * i) for i in range(n)]
    ends = 8 + 12 * n + np.cumsum([0] + [e[1] for e in entries])
    coded = [payload[ends[i] : ends[i + 1]] for i in range(n)]
    blocks = decode_blocks(coded, [e[0] for e in entries]) if n else []
    for i, (block, entry) in enumerate(zip(blocks, entries, strict=True)):
        if zlib.crc32(block.astype("<u4").tobytes()) != entry[2]:
            raise ValueError(f"block {i} is damaged")
    return np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


#: White space beside the space and the newline, by any definition that a tokenizer may use.
_OTHER_SPACE = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


#: A space in the entries of a byte-level vocabulary.
_SPACE = "\u0120"


class Encoder:
    """Whole texts to the ids of the library's plain call. The byte-level splitter always cuts before a single space
    between two other characters, so such pieces are encoded alone and remembered, in bounded number. A text's first
    piece, which no space leads, is encoded by itself; texts with any other use of white space, at their end too, or with
    the characters of an added token go to the library whole."""

    #: Pieces remembered, and the longest of them.
    KEPT, LONGEST = 1 << 20, 32

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo, self.other = {}, re.compile(_OTHER_SPACE)
        self.mark = "\x00"
        # Entries of a byte-level vocabulary that begin with a space.
        vocabulary = self.tokenizer.get_vocab()
        self.led = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.led[[n for token, n in vocabulary.items() if token[0] == _SPACE]] = self.tokenizer.encode(" ", add_special_tokens=False).tokens == [_SPACE]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with a space before, and end with, something else than white space: a row of them in one
        go, parted where an entry begins with a space, since they have no other."""
        out = []
        for first, last in chunks(pieces, 1 << 18):
            data = self._encoded(["".join(pieces[first:last])])[0]
            starts = np.flatnonzero(self.led.take(np.frombuffer(data, "<u2"))).tolist()
            if len(starts) != last - first:
                out += self._encoded(pieces[first:last])
                continue
            starts.append(len(data) // 2)
            out += [data[2 * a : 2 * b] for a, b in pairwise(starts)]
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        out = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if any(len(i) and int(i.max()) >= IDS for i in out):
            raise ValueError(f"ids must be below {IDS}")
        return [i.astype("<u2").tobytes() for i in out]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        out: list = [b""] * len(texts)
        whole, split, new = [], [], set()
        if len(self.memo) > self.KEPT:
            self.memo.clear()
        memo = self.memo
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.mark in text or "  " in text or " \n" in text or "\n " in text or text[-1] in " \n" or self.other.search(text) or any(t in text for t in self.added):
                whole.append(i)
                continue
            pieces = text.replace(" ", self.mark + " ").split(self.mark)
            # Most pieces are known, and a look among so many costs more than all else that is done with one.
            found = list(map(memo.get, pieces))
            unknown = [n for n, ids in enumerate(found) if ids is None]
            missing = [pieces[n] for n in unknown]
            new.update(missing)
            split.append((i, found, unknown, missing))
        # No first piece begins with a space and all others do, so one memory serves both.
        firsts, others = [p for p in new if p[:1] != " "], [p for p in new if p[:1] == " "]
        made = dict(zip(firsts, self._encoded(firsts), strict=True)) | dict(zip(others, self._pieces(others), strict=True))
        for i, found, unknown, missing in split:
            for n, p in zip(unknown, missing, strict=True):
                found[n] = made[p]
            out[i] = b"".join(found)
        memo.update((p, ids) for p, ids in made.items() if len(p) <= self.LONGEST)
        for i, v in zip(whole, self._encoded([texts[i] for i in whole]), strict=True):
            out[i] = v
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def segments(docs: DataFrame, tokenizer: str, order: list[str] | None = None) -> DataFrame:
    """The rows of the file format. Documents are dealt by range of `order` (doc_id by default), so that parts follow it."""
    order = order or ["doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in order if c != "doc_id"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        held, keys, lengths, n, number, start = [], [], [], 0, 0, 0
        end = struct.pack("<H", END_ID)

        def out():
            nonlocal held, keys, lengths, n, number, start
            columns = [[part], [number], [start], [n], [keys], [lengths], [b"".join(held)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SEGMENTS.split(", ")])
            held, keys, lengths, number, start, n = [], [], [], number + 1, start + n, 0
            return batch

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in chunks(texts):
                for key, ids in zip(names[first:last], encoder.ids(texts[first:last]), strict=True):
                    held += [ids, end]
                    keys.append(key)
                    lengths.append(len(ids) // 2 + 1)
                    n += len(ids) // 2 + 1
                    if n >= SEGMENT_BLOCKS * BLOCK_TOKENS:
                        yield out()
        if keys:
            yield out()

    made = rows.select("doc_id", "text").mapInArrow(run, SEGMENTS)
    return made.withColumn("payload", function(docs.sparkSession, "Pack", "payload"))


def write(docs: DataFrame, path: str, tokenizer: str, order: list[str] | None = None) -> None:
    """Writes the files: a task that is run again after a lost executor replaces its own."""
    segments(docs, tokenizer, order).write.parquet(path)


def _with_base(stored: DataFrame) -> DataFrame:
    """The stored segments with the tokens of all parts before (one row a part)."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    return stored.join(bases, "part")


def index(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decoded ids."""
    found = function(stored.sparkSession, "Documents", F.struct("payload", "lengths"))
    rows = _with_base(stored).select((F.col("start") + F.col("base")).alias("before"), "doc_ids", "lengths", found.alias("found"))
    rows = rows.select("before", F.inline(F.arrays_zip("doc_ids", "lengths", "found")))
    return rows.select(F.col("doc_ids").alias("doc_id"), (F.col("before") + F.col("found.start")).alias("start"), F.col("lengths").alias("n_tokens"), "found.ids_crc32")


def read_ids(stored: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offsets = np.concatenate([[0], np.cumsum(row["lengths"])])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(row["payload"], "<u2"), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), ids], ["doc_id", "ids"])

    decoded = stored.withColumn("payload", function(stored.sparkSession, "Unpack", "payload"))
    return decoded.mapInArrow(run, "doc_id long, ids array<long>")


def written_index(docs: DataFrame, tokenizer: str, order: list[str] | None = None) -> DataFrame:
    """Writes the files to the shared folder, reads them back, and gives the index of what was read."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, order)
    return index(spark.read.schema(SEGMENTS).parquet(path))
