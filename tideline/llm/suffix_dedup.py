"""Suffix-array dedup of byte strings, over all documents.

A window is a string of ``length`` bytes of one document.  Each byte covered by a
window that also starts anywhere else is removed, judged on the input.

Windows are dealt out so that equal ones meet: a window's anchor is its k-gram with the
least hash, which depends on the window's bytes alone.  Neighbouring windows with one
anchor make a *context*.  Contexts of equal content are one class, and of a class two
members at most travel, so a passage that many documents share isn't sorted once a copy.
All that can hold equal windows is sorted, and the order alone decides what repeats:

* two-stage suffix sorting: only suffixes smaller than their successors (type B) are
  sorted directly; the others (type A) are induced by scanning the buckets of first
  bytes in order, each suffix placing its predecessor;
* adjacent common prefixes of the sorted windows then show which occur twice.

What a class's members lose follows from the class.  Sorting runs in blocks of about
``BLOCK`` bytes that never split an anchor.  An anchor with more than ``OVER`` bytes of
different contexts would not fit a task: its contexts are cut into bands of windows by
the anchor's place in them, and dealt anew by anchor, band and the bytes that all windows
of a band hold (``WIDTHS``: ever narrower bands, the last of one window).  Equal windows
have one anchor, one place and so one band, so they still meet.

Defined results: null or empty text has no bytes and loses none.  A null doc_id comes
back as null.  Rows that repeat a doc_id or a text are documents of their own, so equal
rows cover each other.  Other columns are not read.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import HOT_KEYS, HOT_LEAST, cut, free, free_shuffles, id_back, id_col, join_flagged, out_batch, slices, text_col

LENGTH, GRAM = 400, 64
BLOCK, OVER = 1 << 18, 1 << 19
#: Windows in a band, for anchors over OVER.
WIDTHS = (48, 8, 1)
SCAN = 1 << 19

_rng = np.random.default_rng(20240501)
_table = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_base = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(int(_base), -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: A context: its first window, windows, where its anchor starts in it, the key it is dealt by (the anchor's hash), and its content's hash.
#: Contents are told apart by both hashes, 128 bits.
OCC = pa.schema([("p0", pa.int64()), ("n_win", pa.int32()), ("aoff", pa.int32()), ("g", pa.int64()), ("c", pa.int64())])
OCC_DDL = "p0 long, n_win int, aoff int, g long, c long"


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _base), np.full(size, _inverse)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    up, down = _powers[size]
    return up[:n], down[:n]


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: its anchor's start, and all k-gram hashes.  data: uint8, at least length long."""
    up, down = _pow(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_table[data] * up)])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    w = length - gram + 1
    packed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(packed) % w
    blocks = np.concatenate([packed, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64), h


def _hash(raw: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(raw), "little", signed=True)


def contexts(text: bytes, length: int = LENGTH, gram: int = GRAM, scan: int = SCAN) -> list[tuple[int, int, int, int, int]]:
    """The contexts of a text, as OCC."""
    out = []
    for at in range(0, len(text) - length + 1, scan):
        raw = text[at : at + scan + length - 1]
        where, h = anchors(np.frombuffer(raw, np.uint8), length, gram)
        starts = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
        stops = np.concatenate([starts[1:], [len(where)]])
        grams = h[where[starts]].view(np.int64).tolist()
        for s, e, a, g in zip(starts.tolist(), stops.tolist(), where[starts].tolist(), grams, strict=True):
            out.append((at + s, e - s, a - s, g, _hash(raw[s : e - 1 + length])))
    return out


def bands(raw: bytes, aoff: int, g: int, width: int, length: int) -> list[tuple[int, int, int, int, int]]:
    """A context in bands of ``width`` places of the anchor: OCC, with p0 counted from the context's start.

    All windows of a band hold the same bytes around the anchor, which enter the new key.
    """
    out = []
    last = len(raw) - length  # the last window has the anchor at aoff - last
    for band in range(aoff // width, (aoff - last) // width - 1, -1):
        low, high = band * width, band * width + width - 1
        x, y = aoff - min(aoff, high), aoff - max(aoff - last, low)
        core = raw[aoff - low : max(0, aoff - high + length)]
        key = _hash(g.to_bytes(8, "little", signed=True) + band.to_bytes(8, "little") + core)
        out.append((x, y - x + 1, aoff - x, key, _hash(raw[x : y + length])))
    return out


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            found = [contexts(t, length, gram) for t in b.column("text").cast(pa.binary()).to_pylist()]
            n = np.array([len(f) for f in found], dtype=np.int64)
            take = pa.array(np.repeat(np.arange(len(n)), n))
            flat = [x for f in found for x in f]
            columns = list(zip(*flat, strict=True)) if flat else [[]] * len(OCC)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("th").take(take), *(pa.array(c, f.type) for c, f in zip(columns, OCC, strict=True))], names=["id", "th", *OCC.names])

    return run


def suffix_order(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Two-stage sorting of the windows of contexts laid end to end.

    Context k lies in text[.. ends[k]] and its windows start at starts[k] .. starts[k] + counts[k] - 1.
    Returns all window starts in the order of their first ``length`` bytes.
    """
    n = len(text)
    raw = text.tobytes()
    end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    # Type B: smaller than its successor, that is, the next different byte within the context is larger.
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[ends - 1] = -1  # the end of a context is smaller than any byte
    known = np.flatnonzero(step)
    smaller = step[known[np.searchsorted(known, np.arange(n))]] > 0
    # Windows, and the positions from the last window to the next type B or to the context's end.
    b_at = np.flatnonzero(smaller)
    last = starts + counts - 1
    k = np.searchsorted(b_at, last)
    until = np.where(k < len(b_at), b_at[np.minimum(k, len(b_at) - 1)] if len(b_at) else n, n)
    to_end = until >= ends
    until = np.where(to_end, ends - 1, until)
    inside = np.zeros(n + 1, dtype=np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, until + 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    direct = np.flatnonzero(inside & smaller)
    keys = [raw[i : min(i + length, e)] for i, e in zip(direct.tolist(), end_of[direct].tolist(), strict=True)]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)]
    del keys
    direct = direct[np.argsort(text[direct], kind="stable")]
    at_byte = np.searchsorted(text[direct], np.arange(257))
    induced = inside & ~smaller

    pending: list[list[np.ndarray]] = [[] for _ in range(256)]

    def place(before: np.ndarray) -> None:
        """Predecessors, in order, to the buckets of their first bytes."""
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            at = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                pending[first[x]].append(before[x:y])

    first_of = np.zeros(n, dtype=bool)
    first_of[np.concatenate([[0], ends[:-1]])] = True  # a context's first byte has no predecessor
    tails = ends - 1
    place(tails[induced[tails]])
    out = []
    for c in range(256):
        front = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        bucket = []
        while len(front):
            bucket.append(front)
            before = front[~first_of[front]] - 1
            front = before[induced[before] & (text[before] == c)]
        bucket.append(direct[at_byte[c] : at_byte[c + 1]])
        whole = np.concatenate(bucket)
        before = whole[~first_of[whole]] - 1
        place(before[induced[before] & (text[before] > c)])
        out.append(whole)
    order = np.concatenate(out)
    window = np.zeros(n + 1, dtype=np.int32)
    np.add.at(window, starts, 1)
    np.add.at(window, starts + counts, -1)
    return order[np.cumsum(window[:n])[order] > 0]


def repeated(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Marks window starts whose common prefix with a neighbour in the order is ``length`` long."""
    marked = np.zeros(len(text), dtype=bool)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for at in range(0, len(order) - 1, 16384):
        a, b = order[at : min(at + 16384, len(order) - 1)], order[at + 1 : at + 16385]
        near = np.flatnonzero(text[a + length - 1] == text[b + length - 1])
        a, b = a[near], b[near]
        common = (view[a] == view[b]).all(axis=1)
        marked[a[common]] = marked[b[common]] = True
    return marked


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def block_runs(raws: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Contexts of whole groups -> of each, the byte ranges covered by repeated windows."""
    text = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts, counts = ends - sizes, sizes - length + 1
    marked = repeated(text, suffix_order(text, starts, counts, ends, length), length)
    return [[(a, b - 1 + length) for a, b in _runs(marked[s : s + n])] for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]


SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64())])
FOUND = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("spans", pa.list_(SPAN))])
FOUND_DDL = "g long, c long, n long, spans array<struct<a: long, b: long>>"


def _sort_blocks(length: int, block: int):
    """Members of classes, ordered by g -> FOUND of the first members that lose bytes."""

    def found(rows):
        kept = [(r, runs) for r, runs in zip(rows, block_runs([r[4] for r in rows], length), strict=True) if r[3] and runs]
        return out_batch(FOUND, g=[r[0] for r, _ in kept], c=[r[1] for r, _ in kept], n=[r[2] for r, _ in kept], spans=[[{"a": a, "b": b} for a, b in runs] for _, runs in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, 1024):
            for r in zip(*(b.column(c).to_pylist() for c in ("g", "c", "n", "first", "raw")), strict=True):
                if held and r[0] != held[-1][0] and size >= block:
                    yield found(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield found(held)

    return run


WANT = ("p0", "n_win", "aoff", "g", "c", "n", "first", "wide")
WANT_DDL = "p0 long, n_win int, aoff int, g long, c long, n long, first boolean, wide boolean"


def _fetch(length: int):
    """Texts with the contexts wanted of them -> a row a context, with its bytes."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            for t, want in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("want").to_pylist(), strict=True):
                for at in range(0, len(want), 4096):
                    part = want[at : at + 4096]
                    raw = [t[w["p0"] : w["p0"] + w["n_win"] - 1 + length] for w in part]
                    yield pa.RecordBatch.from_arrays([*(pa.array([w[c] for w in part], k) for c, k in zip(WANT, kinds, strict=True)), pa.array(raw, pa.binary())], names=[*WANT, "raw"])

    return run


def _split(length: int, width: int):
    """Contexts (text, aoff, g, c, n) -> their bands as contexts in texts of their own, which go by (id, th) = (g, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            rows = b.to_pylist()
            flat = [(r["g"], r["c"], r["n"], *x) for r in rows for x in bands(r["text"], r["aoff"], r["g"], width, length)]
            columns = list(zip(*flat, strict=True)) if flat else [[]] * (3 + len(OCC))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), *OCC.types), strict=True)], names=["id", "th", "n", *OCC.names])

    return run


def _wanted(occ: DataFrame, length: int, over: int) -> tuple[DataFrame, int]:
    """What is to be sorted, as (id, th) and WANT: of each class in a group of several members, the first and the last; the number of all contexts.

    wide: the group's bytes are over ``over``; of these the first member is enough.
    """
    at = F.struct("id", "th", "p0")
    many = F.sum("n") > 1
    classes = cut(occ.groupBy("g", "c").agg(F.sum("n").alias("n"), F.min(at).alias("rep"), F.when(many, F.max(at)).alias("other"), F.max("n_win").alias("n_win"), F.max("aoff").alias("aoff")), "context-classes")
    total, n_classes = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    size = F.sum((F.col("n_win") + F.lit(length - 1)) * F.when(F.col("n") > 1, 2).otherwise(1))
    hot = F.count("*") >= max(HOT_LEAST, -(-n_classes // HOT_KEYS))
    groups = cut(classes.groupBy("g").agg(F.sum("n").alias("members"), (size > over).alias("wide"), hot.alias("hot")).where("members > 1").drop("members"), "context-groups")
    first, last = F.struct("rep.*", F.lit(True).alias("first")), F.struct("other.*", F.lit(False).alias("first"))
    members = F.when((F.col("n") > 1) & ~F.col("wide"), F.array(first, last)).otherwise(F.array(first))
    wanted = join_flagged(classes, ["g"], groups).select("n_win", "aoff", "g", "c", "n", "wide", F.explode(members).alias("m"))
    wanted = cut(wanted.select("m.id", "m.th", "m.p0", "m.first", "n_win", "aoff", "g", "c", "n", "wide"), "context-wanted")
    free(classes, groups)
    free_shuffles(occ.sparkSession)
    return wanted, total


def covered(texts: DataFrame, occ: DataFrame, length: int, block: int, over: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """texts (id, th, text), occ (id, th, n, OCC ...; a written table) -> the rows of occ that lose bytes, with spans, counted from p0."""
    over = over if widths else 1 << 62
    wanted, total = _wanted(occ, length, over)
    by_text = wanted.groupBy("id", "th").agg(F.collect_list(F.struct(*WANT)).alias("want"))
    parts = texts.join(by_text, ["id", "th"]).select("text", "want").mapInArrow(_fetch(length), f"{WANT_DDL}, raw binary")
    wide = not wanted.where("wide").isEmpty()
    parts = cut(parts, "context-texts") if wide else parts
    narrow = parts.where("NOT wide").select("g", "c", "n", "first", "raw")
    found = narrow.repartition("g").sortWithinPartitions("g").mapInArrow(_sort_blocks(length, block), FOUND_DDL)
    used = [wanted]
    if wide:
        cold = parts.where("wide").dropDuplicates(["g", "c"])
        cold = cut(cold.select(F.col("g").alias("id"), F.col("c").alias("th"), F.col("raw").alias("text"), "aoff", "g", "c", "n"), "context-wide")
        split = cut(cold.mapInArrow(_split(length, widths[0]), f"id long, th long, n long, {OCC_DDL}"), "context-bands")
        lost = covered(cold.select("id", "th", "text"), split, length, block, over, widths[1:])
        moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("p0")).alias("a"), (s["b"] + F.col("p0")).alias("b")))
        whole = lost.groupBy("id", "th").agg(F.flatten(F.collect_list(moved)).alias("spans"))
        found = found.unionByName(whole.join(cold.select("id", "th", "n"), ["id", "th"]).select(F.col("id").alias("g"), F.col("th").alias("c"), "n", "spans"))
        used += [parts, cold, split]
    lookup = cut(found.select("g", "c", "spans", (F.col("n") >= max(HOT_LEAST, -(-total // HOT_KEYS))).alias("hot")), "context-spans")
    free(*used)
    free_shuffles(occ.sparkSession)
    return join_flagged(occ, ["g", "c"], lookup)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, over: int = OVER) -> DataFrame:
    """(id, th, a, b): byte ranges [a, b) covered by repeated windows; they overlap.  th is the text's hash."""
    rows = docs.select(id_col().alias("id"), text_col().alias("text")).withColumn("th", F.xxhash64("text"))
    texts = rows.where(F.octet_length("text") >= length).select("id", "th", "text")
    occ = cut(texts.mapInArrow(_scan(length, gram), f"id long, th long, {OCC_DDL}"), "contexts").withColumn("n", F.lit(1).cast("long"))
    lost = covered(texts, occ, length, block, over).select("id", "th", "p0", F.explode("spans").alias("s"))
    return lost.select("id", "th", (F.col("p0") + F.col("s.a")).alias("a"), (F.col("p0") + F.col("s.b")).alias("b"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, over: int = OVER) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (array of from, to), kept (binary)."""
    spans = repeated_spans(docs, length, gram, block, over).groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("cover"))
    rows = docs.select(id_col().alias("i"), text_col().alias("text")).withColumn("t", F.xxhash64("text"))
    joined = rows.join(spans, (F.col("i") == F.col("id")) & (F.col("t") == F.col("th")), "left").select("i", "text", "cover")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts, found = b.column("text").cast(pa.binary()).to_pylist(), []
            sizes = [len(t) for t in texts]
            for n, cover in enumerate(b.column("cover").to_pylist()):
                merged = merge_spans([(c["a"], c["b"]) for c in cover or ()])
                found.append([{"a": x, "b": y} for x, y in merged])
                if merged:
                    edges = [0, *(v for m in merged for v in m), sizes[n]]
                    texts[n] = b"".join(texts[n][x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(texts, pa.binary())], names=["i", "n_bytes", "spans", "kept"])

    out = joined.mapInArrow(run, "i long, n_bytes long, spans array<struct<a: long, b: long>>, kept binary")
    return out.select(id_back("i").alias("doc_id"), "n_bytes", "spans", "kept")
