"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts over ``pretokens.LIMIT`` characters are cut at safe boundaries first, so the
library never sees a text whose pattern needs a deep stack, and memory is bounded by
a piece, not by the text.  Decoding concatenates raw bytes; no text decoding is
involved, so it is exact for any ids.

Defined results: null text equals empty text and gives no ids.  Rows are independent:
null and repeated doc_ids, ties and other columns don't matter.  Special strings are
ordinary text.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import slices, text_col
from tideline.llm.pretokens import LIMIT, pieces


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a local rank file (base64 token, space, rank on each line); cached in each worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, enc: tiktoken.Encoding, limit: int = LIMIT) -> list[int]:
    if len(text) <= 2048:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, whole in pieces(text, limit):
        ids += enc._encode_single_piece(piece) if whole else enc.encode_ordinary(piece)
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in slices(batches, 256):
            ids = [encode(t, enc, limit) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", text_col().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded binary).  A null list decodes to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in slices(batches, 256):
            raw = [enc.decode_bytes(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids, decoded binary): ``decode_documents`` of ``encode_documents`` in one pass and one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in slices(batches, 256):
            ids = [encode(t, enc, limit) for t in b.column("text").to_pylist()]
            raw = pa.array(map(enc.decode_bytes, ids), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), raw], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", text_col().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, ids, decoded) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
