"""Line dedup over range-partitioned line hashes.

Every line long enough gives a row (hash of its key, document, position).  The rows
are range-partitioned by hash and document with a secondary sort by position, largest
document first, and checkpointed.  One pass summarises each partition's first and last
hash, so that a run of equal hashes may lie over many partitions: a very common line is
no hot task.  A second pass streams each partition: the first document of a run keeps
its lines, the others' are dropped once the run has ``min_docs`` documents.  Only
positions leave that pass; per document they become a compressed bitmap of the lines to
keep.  Texts are read again only to apply it.

The key of a line is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased;
keys under ``min_chars`` code points always stay.

Defined results: null or empty text is one empty line.  A null doc_id counts as one
document, smaller than any other.  Rows that repeat a doc_id count as one document when
documents are counted; each row keeps or drops lines by its own text.  Other columns
are not read.  Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut_parts, id_back, id_col, out_batch, slices, text_col

MIN_CHARS, MIN_DOCS = 20, 3
SPACE = b" \t\n\x0b\x0c\r"

EDGE = pa.schema([("part", pa.int32()), ("first", pa.binary()), ("first_docs", pa.int64()), ("first_from", pa.int64()), ("first_to", pa.int64()), ("last", pa.binary()), ("last_docs", pa.int64()), ("last_from", pa.int64()), ("last_to", pa.int64())])
DROP = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32())])


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a UTF-8 line's key; None if the key is too short."""
    key = line.strip(SPACE).lower()  # bytes.lower() lower-cases A-Z alone
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            keys, rows, at = [], [], []
            for n, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                for pos, line in enumerate(t.split(b"\n")):
                    if len(line) >= min_chars and (k := key_of(line, min_chars)):
                        keys.append(k)
                        rows.append(n)
                        at.append(pos)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("id").take(take), b.column("th").take(take), pa.array(at, pa.int32())], names=["key", "id", "th", "pos"])

    return run


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key binary(16), id, th, pos) of every line that counts; th tells apart rows of one doc_id."""
    rows = docs.select(id_col().alias("id"), text_col().alias("text")).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(_line_keys(min_chars), "key binary, id long, th long, pos int")


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys as rows of two unsigned longs, ids."""
    raw = b.column("key").cast(pa.binary(16)) if b.num_rows else pa.array([], pa.binary(16))
    keys = np.frombuffer(raw.buffers()[1], dtype=np.uint64, offset=16 * raw.offset, count=2 * len(raw)).reshape(-1, 2) if len(raw) else np.empty((0, 2), np.uint64)
    return keys, b.column("id").to_numpy(zero_copy_only=False)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, documents, first and last document of a partition's first and last run."""
    first = last = None
    only_first = True
    for b in batches:
        keys, ids = _columns(b)
        if not len(ids):
            continue
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
        stops = np.concatenate([starts[1:], [len(ids)]])
        for n in sorted({0, len(starts) - 1}):
            key, part = keys[starts[n]].tobytes(), ids[starts[n] : stops[n]]
            docs = 1 + int((part[1:] != part[:-1]).sum())
            if last and last[0] == key:
                last = [key, last[1] + docs - (last[3] == part[0]), last[2], int(part[-1])]
            else:
                only_first = first is None
                last = [key, docs, int(part[0]), int(part[-1])]
            if only_first:
                first = last
    if last:
        yield out_batch(EDGE, **{"part": [TaskContext.get().partitionId()]} | {n: [v] for n, v in zip(EDGE.names[1:], [*first, *last], strict=True)})


def resolve(edges: list[tuple]) -> dict[int, tuple[int, int | None, int, int]]:
    """By partition: documents of its first run that lie before, the last of them, documents of its first and of its last run in all.

    edges: rows of EDGE in the order of partitions.
    """
    runs: list[list] = []  # key, documents, last document
    found: dict[int, list] = {}
    for part, first, n1, from1, to1, last, n2, _from2, to2 in edges:
        if runs and runs[-1][0] == first:
            run = runs[-1]
            before, previous = run[1], run[2]
            run[1] += n1 - (run[2] == from1)
            run[2] = to1
        else:
            run, before, previous = [first, n1, to1], 0, None
            runs.append(run)
        tail = run
        if last != first:
            tail = [last, n2, to2]
            runs.append(tail)
        found[part] = [before, previous, run, tail]
    return {p: (b, q, r[1], t[1]) for p, (b, q, r, t) in found.items()}


def _drops(known: dict[int, tuple], min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions to drop: all documents of a run but its first, if the run has enough."""
        part = known.get(TaskContext.get().partitionId())
        key, seen, last_doc, firsts = None, 0, None, True
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of the current run, until it has enough documents
        if part:
            seen, last_doc = part[0], part[1]

        def emit(x):
            ids, th, pos = (np.concatenate(c) for c in zip(*x, strict=True))
            return out_batch(DROP, id=ids, th=th, pos=pos)

        for b in batches:
            keys, ids = _columns(b)
            if not len(ids):
                continue
            th, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("th", "pos"))
            new_key = np.concatenate([[key is not None and keys[0].tobytes() != key], (keys[1:] != keys[:-1]).any(axis=1)])
            new_doc = new_key | np.concatenate([[last_doc is None or ids[0] != last_doc], ids[1:] != ids[:-1]])
            new_doc[0] |= key is None and seen == 0
            run_no = new_key.cumsum()
            order = new_doc.cumsum()
            at_start = np.flatnonzero(new_key)
            base = np.zeros(run_no[-1] + 1, dtype=np.int64)
            base[0] = -seen
            base[run_no[at_start]] = order[at_start] - 1
            nth = order - base[run_no]  # 1 for the first document of a run
            most = np.zeros(len(base), dtype=np.int64)
            np.maximum.at(most, run_no, nth)
            if firsts:  # the partition's first run may go on before and after it
                most[0] = max(most[0], part[2])
            enough = most >= min_docs
            out = []
            if new_key.any() or enough[0]:
                if waiting and enough[0]:
                    out += waiting
                waiting = []
            late = nth >= 2
            go = late & enough[run_no]
            wait = late & ~enough[run_no] & (run_no == run_no[-1])
            if go.any():
                out.append((ids[go], th[go], pos[go]))
            if wait.any():
                waiting.append((ids[wait].copy(), th[wait].copy(), pos[wait].copy()))
            if out:
                yield emit(out)
            firsts = firsts and not new_key.any()
            key, seen, last_doc = keys[-1].tobytes(), int(nth[-1]), int(ids[-1])
        if waiting and part and part[3] >= min_docs:
            yield emit(waiting)

    return run


def _bitmap(positions: list[int], n_lines: int) -> bytes:
    keep = np.ones(-(-n_lines // 8) * 8, dtype=bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes())


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        drop = b.column("drop").to_pylist()
        maps = [_bitmap(d, max(d) + 1) for d in drop]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array([len(d) for d in drop], pa.int64()), pa.array(maps, pa.binary())], names=["id", "th", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, th, n_dropped, keep) of the texts that lose lines.

    ``keep``: zlib of packed bits, one a line from the first on; lines beyond the bits stay.
    """
    rows = line_keys(docs, min_chars)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut_parts(rows.repartitionByRange(parts, "key", F.desc("id")).sortWithinPartitions("key", F.desc("id"), "th", "pos"))
    edges = sorted(tuple(r) for r in ordered.select("key", "id").mapInArrow(_edges, "part int, first binary, first_docs long, first_from long, first_to long, last binary, last_docs long, last_from long, last_to long").collect())
    known = resolve([tuple(bytes(v) if isinstance(v, bytearray) else v for v in e) for e in edges])
    drops = ordered.mapInArrow(_drops(known, min_docs), "id long, th long, pos int")
    return drops.groupBy("id", "th").agg(F.collect_set("pos").alias("drop")).mapInArrow(_bitmaps, "id long, th long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, text) and bitmaps -> doc_id, n_lines, n_dropped, kept_text."""
    text = text_col()
    rows = docs.select(id_col().alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))
    joined = rows.join(bitmaps, (F.col("i") == F.col("id")) & (F.col("t") == F.col("th")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts, counts = b.column("text").to_pylist(), []
            for n, (t, k) in enumerate(zip(texts, b.column("keep").to_pylist(), strict=True)):
                lines = t.split("\n")
                counts.append(len(lines))
                if k is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(k), dtype=np.uint8))[: len(lines)]
                    texts[n] = "\n".join(x for at, x in enumerate(lines) if at >= len(bits) or bits[at])
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(counts, pa.int64()), b.column("n_dropped"), pa.array(texts, pa.string())], names=["i", "n_lines", "n_dropped", "kept_text"])

    out = joined.select("i", "text", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep").mapInArrow(run, "i long, n_lines long, n_dropped long, kept_text string")
    return out.select(id_back("i").alias("doc_id"), "n_lines", "n_dropped", "kept_text")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, kept_text."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
