"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are the binary digits of its
length, whole sequences first.  Pieces of one length share a bucket and every
piece is a sequence of its own, so no sequence crosses documents and none needs
padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LENGTH, END_ID = 2048, 1
CACHE_PIECES, GROUPS = 400_000, 4096
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Blanks other than the space that a text may hold before a space; such texts are not cut at spaces.
_ASCII_BLANKS = tuple(f"{c} " for c in " \t\n\x0b\x0c\r")
_OTHER_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")


class CachedIds:
    """Ids of texts as little-endian uint32 bytes, those of up to ``cache`` frequent words kept.

    The tokenizer splits before every space that follows a character other
    than a blank, and merges nothing across: a text's ids are those of its
    words in a row.  A word not kept is encoded from the same vocabulary's
    ranks; a text that holds an added token goes to the tokenizer whole.
    """

    def __init__(self, path: str = TOKENIZER, ranks: str = RANKS, cache: int = CACHE_PIECES):
        self.tokenizer, self.cache, self.known = Tokenizer.from_file(path), cache, {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={}).encode_ordinary

    def _bytes(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if any(b in text for b in _ASCII_BLANKS) or not text.isascii() and _OTHER_BLANK.search(text):
            return self._bytes(text)
        first, *words = text.split(" ")
        known = self.known
        out = [known.get(w) for w in words]
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    out[i] = ids = self._bytes(f" {w}")
                    if len(w) <= 40:
                        if len(known) >= self.cache:
                            known.clear()
                        known[w] = ids
        return self._bytes(first) + b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str) -> CachedIds:
    return CachedIds(path, ranks)


def binary_pieces(n: int, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """(start, length) of n ids: whole sequences, then the powers of two of the rest, falling."""
    start = 0
    while n - start >= length:
        yield start, length
        start += length
    while start < n:
        size = 1 << ((n - start).bit_length() - 1)
        yield start, size
        start += size


def document_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece; null texts count as empty."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int32()))] * with_ids)
    ddl = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer, ranks).ids, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = (ids_of(text.as_py()) if text.is_valid else b"") + end
                total = len(data) // 4
                for start, n in binary_pieces(total, length):
                    part = data[4 * start : 4 * (start + n)]
                    rows.append((doc_id, start, n, zlib.crc32(part), total) + (np.frombuffer(part, "<i4"),) * with_ids)
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut_up, ddl)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, groups: int = GROUPS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece.

    Sequences are numbered from 0, the longest bucket first; within a bucket,
    groups of pieces (by hash) are numbered at once and their offsets added, so
    no bucket passes one task.  Every document has at least its end id, empty
    and null texts too; repeated rows, and rows without a doc_id, are packed one
    by one.  Very long texts are cut whole; an empty table gives an empty result;
    further columns are left out.
    """
    pieces = cut(document_pieces(docs, tokenizer, ranks, length, end_id, with_ids)).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))  # at most 12 * groups rows
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", before(W.orderBy(F.col("length").desc())).alias("base"))
    counts = counts.select("length", "part", before(W.partitionBy("length").orderBy("part")).alias("inside")).join(F.broadcast(buckets), "length")
    ranked = pieces.withColumn("nth", F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")))
    out = ranked.join(F.broadcast(counts.withColumn("before", F.col("base") + F.col("inside"))), ["length", "part"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    return out.select(*names, *["ids"] * with_ids)
