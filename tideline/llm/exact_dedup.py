"""Exact dedup through an extendible-hash index on shared files.

1. Every row's entry (hash of the whole text, bytes) goes to a file in the shared
   folder.  A grouped histogram of hash prefixes over it, of at most 2**MAX_BITS cells,
   is what the directory grows by.
2. Hashes with more bytes than a page can't be split from themselves.  A second grouped
   pass, over the cells alone that are overfull, finds them; each gets a chain of pages
   of its own, so that no task gets more than about a page of bytes however large a
   group of copies is.
3. The directory starts with one slot.  An overfull bucket splits on its next hash bit;
   where its depth is the directory's, the directory doubles.  Several slots may point to
   one bucket.  It is written to the shared folder too.  Its size follows the number of
   pages, at most about MAX_PAGES, as pages grow beyond that.
4. Pages are numbered along the key ranges, and each is owned by one task.  It walks its
   rows in hash order, compares whole texts byte by byte, and chains the different texts
   that share a hash.
5. Heads of pages whose bucket has several pages are compared again, with their texts:
   one row per page and text, not per copy, in a tree of ``FAN`` pages a task.

Defined results: null text equals empty text.  A null doc_id is smaller than any
other.  Rows that repeat a doc_id are rows of their own in group sizes; where equal
texts share the largest doc_id too, one of these rows is ``kept``.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import cut, free, id_back, id_col, keep_rows, matching, out_batch, slices, text_col

PAGE_BYTES = 32 << 20
MAX_PAGES, MAX_BITS = 1 << 16, 20
#: Bits of the histogram beyond those that number the pages.
SPARE_BITS = 4
FAN = 64
ROW_BYTES = 64

CHAIN = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("page", pa.int32()), ("base", pa.int32()), ("many", pa.bool_()), ("chain", pa.int32()), ("rank", pa.int64()), ("head", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("head_text", pa.string())])


def _bits(n: int):
    return F.shiftrightunsigned(F.col("h"), 64 - n) if n else F.lit(0).cast("long")


@dataclass
class Directory:
    """slots: the bucket of each prefix of ``depth`` bits.  Of each bucket: its own depth, its prefix and its bytes."""

    depth: int
    slots: np.ndarray
    local: np.ndarray
    prefix: np.ndarray
    size: np.ndarray


def grow(cells: np.ndarray, page_bytes: int) -> Directory:
    """Extendible hashing over a histogram: cells has the bytes of each prefix, 2**bits in number."""
    bits = len(cells).bit_length() - 1
    before = np.concatenate([[0], np.cumsum(cells, dtype=np.int64)])
    depth, slots = 0, np.zeros(1, dtype=np.int64)
    local, prefix, size = np.zeros(1, np.int64), np.zeros(1, np.int64), before[-1:].copy()
    while len(over := np.flatnonzero((size > page_bytes) & (local < bits))):
        if (local[over] == depth).any():  # the directory doubles
            depth, slots = depth + 1, np.repeat(slots, 2)
        local[over] += 1
        prefix[over] *= 2
        low, width = prefix[over] << (bits - local[over]), 1 << (bits - local[over])
        size[over] = before[low + width] - before[low]
        split = np.full(len(local), -1, dtype=np.int64)
        split[over] = len(local) + np.arange(len(over))
        local, prefix = np.concatenate([local, local[over]]), np.concatenate([prefix, prefix[over] + 1])
        size = np.concatenate([size, before[low + 2 * width] - before[low + width]])
        upper = (split[slots] >= 0) & ((np.arange(len(slots)) >> (depth - local[slots])) & 1 == 1)
        slots[upper] = split[slots[upper]]
    return Directory(depth, slots, local, prefix, size)


@dataclass
class Index:
    depth: int
    slots: DataFrame  # slot, first, pages
    hot: DataFrame  # h, first, pages
    pages: int
    longest: int  # pages in a bucket, at most


def _table(spark: SparkSession, name: str, **columns: np.ndarray) -> DataFrame:
    return cut(spark.createDataFrame(pa.table(columns)), name, len(next(iter(columns.values()))))


def build_index(entries: DataFrame, page_bytes: int = PAGE_BYTES) -> Index:
    """The index of entries (h, bytes; a written table)."""
    total = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    page_bytes = max(page_bytes, total // MAX_PAGES + 1)
    bits = min(MAX_BITS, (total // page_bytes).bit_length() + SPARE_BITS)
    found = entries.groupBy(_bits(bits).alias("cell")).agg(F.sum("bytes").alias("bytes")).toArrow()
    cells = np.zeros(1 << bits, dtype=np.int64)
    cells[found["cell"].to_numpy()] = found["bytes"].to_numpy()
    full = np.flatnonzero(cells > page_bytes)  # at most MAX_PAGES
    heavy = pa.table({"h": pa.array([], pa.int64()), "bytes": pa.array([], pa.int64())})
    if len(full):
        inside = entries.join(F.broadcast(entries.sparkSession.createDataFrame(pa.table({"cell": full}))), _bits(bits) == F.col("cell"), "left_semi")
        heavy = inside.groupBy("h").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > page_bytes).toArrow()
    hot, hot_bytes = heavy["h"].to_numpy(), heavy["bytes"].to_numpy()
    np.subtract.at(cells, (hot.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), hot_bytes)
    d = grow(cells, page_bytes)
    order = np.argsort(d.prefix << (bits - d.local))  # along the key ranges
    pages = -(-d.size // page_bytes)
    first = np.zeros(len(pages), dtype=np.int64)
    first[order] = np.cumsum(pages[order]) - pages[order]
    hot_pages = -(-hot_bytes // page_bytes)
    hot_first = pages.sum() + np.cumsum(hot_pages) - hot_pages
    slots = _table(entries.sparkSession, "hash-directory", slot=np.arange(len(d.slots)), first=first[d.slots], pages=pages[d.slots])
    chained = _table(entries.sparkSession, "hash-hot", hh=hot, hot_first=hot_first, hot_pages=hot_pages)
    every = np.concatenate([pages, hot_pages])
    return Index(d.depth, slots, chained, int(every.sum()), int(every.max(initial=1)))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, page, base, many, text) ordered by h, id descending: chains of equal texts."""
    state: dict = {"h": None}

    def flush():
        for k, c in enumerate(state["chains"] if state["h"] is not None else ()):
            n, ids = len(c["ids"]), c["ids"]
            sha = hashlib.sha256(c["text"]).hexdigest()
            for at in range(0, n, 8192):
                part = ids[at : at + 8192]
                m = len(part)
                heads = [c["text"].decode("utf-8")] if at == 0 and state["many"] else [None]
                yield out_batch(CHAIN, id=part, h=[state["h"]] * m, page=[state["page"]] * m, base=[state["base"]] * m, many=[state["many"]] * m, chain=[k] * m, rank=range(at, at + m), head=[ids[0]] * m, n=[n] * m, sha=[sha] * m, head_text=heads + [None] * (m - 1))

    held: list[pa.RecordBatch] = []
    size = 0
    for b in slices(batches):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        for i, h, page, base, many, t in zip(*(b.column(c).to_pylist() for c in ("id", "h", "page", "base", "many")), texts, strict=True):
            if h != state["h"] or page != state["page"]:
                for x in flush():
                    held.append(x)
                    size += x.nbytes
                if size >= 1 << 20:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
                state = {"h": h, "page": page, "base": base, "many": many, "chains": []}
            for c in state["chains"]:
                if c["text"] == t:
                    c["ids"].append(i)
                    break
            else:
                state["chains"].append({"text": t, "ids": [i]})
    held += list(flush())
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


MERGED = pa.schema([("h", pa.int64()), ("page", pa.int32()), ("base", pa.int32()), ("chain", pa.int32()), ("to_page", pa.int32()), ("to_chain", pa.int32()), ("head", pa.int64()), ("n", pa.int64()), ("head_text", pa.string())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads (h, part, head, page, base, chain, n, head_text) ordered by h, part, head descending: equal texts go to the first of them, which alone keeps its text."""
    now, chains = None, []

    def flush():
        for c in chains:
            rows = c["rows"]
            k = len(rows)
            yield out_batch(MERGED, h=[now[0]] * k, page=[r["page"] for r in rows], base=[r["base"] for r in rows], chain=[r["chain"] for r in rows], to_page=[rows[0]["page"]] * k, to_chain=[rows[0]["chain"]] * k, head=[rows[0]["head"]] * k, n=[sum(r["n"] for r in rows)] * k, head_text=[c["text"]] + [None] * (k - 1))

    for b in slices(batches, 64):
        for r in b.to_pylist():
            if (r["h"], r["part"]) != now:
                yield from flush()
                now, chains = (r["h"], r["part"]), []
            text = r.pop("head_text")
            for c in chains:
                if c["text"] == text:
                    c["rows"].append(r)
                    break
            else:
                chains.append({"text": text, "rows": [r]})
    yield from flush()


def merge_heads(heads: DataFrame, longest: int, fan: int = FAN) -> DataFrame:
    """heads (h, page, base, chain, head, n, head_text) -> h, page, chain, and the head, n of the whole hash's equal texts, first: it is the head's own.

    A bucket has ``longest`` pages at most, from page ``base`` on.  Each round merges ``fan`` pages in a task.
    """
    way, span = None, 1
    while True:
        span *= fan
        dealt = heads.withColumn("part", F.expr(f"(page - base) div {span}"))
        merged = cut(dealt.repartition("h", "part").sortWithinPartitions("h", "part", F.desc("head"), "page", "chain").mapInArrow(_merge, _ddl(MERGED)), "hash-heads")
        step = merged.select("h", "page", "chain", "to_page", "to_chain", "head", "n")
        if way is not None:  # what went to a head before goes where that head goes now
            before = way.select("h", F.col("page").alias("p"), F.col("chain").alias("c"), F.col("to_page").alias("page"), F.col("to_chain").alias("chain"))
            step = cut(before.join(step, ["h", "page", "chain"]).select("h", F.col("p").alias("page"), F.col("c").alias("chain"), "to_page", "to_chain", "head", "n"), "hash-heads")
        way = step
        if span >= longest:
            return way.select("h", "page", "chain", "head", "n", ((F.col("page") == F.col("to_page")) & (F.col("chain") == F.col("to_chain"))).alias("first"))
        heads = merged.where(F.col("head_text").isNotNull()).select("h", "page", "base", "chain", "head", "n", "head_text")


def exact_dedup(docs: DataFrame, page_bytes: int = PAGE_BYTES, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of equal texts is kept.
    """
    rows = docs.select(id_col().alias("id"), text_col().alias("text")).withColumn("h", F.xxhash64("text"))
    entries = cut(rows.select("h", (F.octet_length("text") + ROW_BYTES).cast("long").alias("bytes")), "hash-entries")
    index = build_index(entries, page_bytes)
    free(entries)
    # Rows of a chain of pages are dealt by their place in the input too, as ids may be null or repeat.
    dealt = rows.withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id()))
    dealt = dealt.join(F.broadcast(index.slots), _bits(index.depth) == F.col("slot")).join(F.broadcast(index.hot), F.col("h") == F.col("hh"), "left")
    dealt = dealt.withColumns({"base": F.coalesce("hot_first", "first").cast("int"), "own": F.coalesce("hot_pages", "pages")})
    owned = dealt.select("id", "h", (F.col("base") + F.pmod("deal", "own")).cast("int").alias("page"), "base", (F.col("own") > 1).alias("many"), "text")
    chains = cut(owned.repartitionById(max(1, index.pages), F.col("page")).sortWithinPartitions("page", "h", F.desc("id")).mapInArrow(_chains, _ddl(CHAIN)), "hash-pages")
    free(index.slots, index.hot)
    result = chains.where("NOT many").select("id", "head", "n", (F.col("rank") == 0).alias("kept"), "sha")
    if index.longest > 1:
        heads = chains.where(F.col("head_text").isNotNull()).select("h", "page", "base", "chain", "head", "n", "head_text")
        merged = merge_heads(heads, index.longest, fan).withColumnsRenamed({"head": "all_head", "n": "all_n"})
        several = chains.where("many").join(merged, ["h", "page", "chain"]).select("id", F.col("all_head").alias("head"), F.col("all_n").alias("n"), ((F.col("rank") == 0) & F.col("first")).alias("kept"), "sha")
        result = result.unionByName(several)
    return result.select(id_back("id").alias("doc_id"), id_back("head").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type] if f.type in names else 'array<int>'}" for f in schema)


def drop_exact_duplicates(docs: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``docs`` without all but one row of equal texts, columns as they were."""
    found = exact_dedup(docs, page_bytes)
    ids = cut(found.select(id_col().alias("id"), "kept", F.col("text_sha256").alias("sha")), "exact-kept")
    keep = ids.where("kept").select("id", "sha").distinct()
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        return matching(docs, keep.select("id"), "left_semi")
    # Rows that share id and text: any one of them, with a null text as good as an empty one.
    return keep_rows(docs, keep, ids.groupBy("id", "sha").count().where("count > 1").select("id", "sha"))
