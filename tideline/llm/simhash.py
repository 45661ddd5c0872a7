"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint has 64 bits, so 8 positional bytes.  Two fingerprints with at most
``apart`` differing bits differ in at most as many bytes: they share at least
8 - ``apart`` positional bytes, the guaranteed minimum, four for the four bits here.

The index lists fingerprints under ``keyed`` positional bytes at once.  With one, a list
holds 1/256 of all fingerprints, and the pairs whose shared bytes are tallied grow with
the square of the corpus; with four, a pair meets only where four bytes agree, the least
that it must reach.  The links are the same.  In a list, each pair is taken in its first
common key alone; its shared positional bytes are tallied over all eight positions, pairs
under the guaranteed minimum go, and the differing bits of the others are counted.  Lists
keep a spanning forest of their links, so a list of m fingerprints yields fewer than m.

Equal fingerprints are one class before any pairing.  Lists over ``LIST_ROWS``
fingerprints are dealt out in pairs of blocks over many tasks, exactly.

Defined results: null text equals empty text; no words give fingerprint zero, which
links like any other.  A null doc_id counts as smaller than any other and comes
back as null.  Rows that repeat a doc_id are one node.  Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, free, id_back, id_col, join_one, keep_rows, out_batch, own_rows, slices, text_col
from tideline.llm.components import components

SHINGLE, BITS_APART = 4, 4
LIST_ROWS = 4096
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
KEYED = 4
CHUNK = 1 << 16
#: Bytes up to which a text's words are taken at once.
SHORT = 1 << 18

PRINTS = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
POSTS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("x", pa.int64()), ("y", pa.int64())])
OVER = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("key", pa.int64())])


def shingle_hashes(text: bytes, shingle: int, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of UTF-8 bytes, in chunks of words: neither all words nor all shingles of a long text exist at a time."""
    # bytes.lower() lower-cases A-Z alone
    words = iter(WORDS.findall(text.lower())) if len(text) <= SHORT else (w.group().lower() for w in WORDS.finditer(text))
    some, whole, held = False, False, []
    while not whole:
        new = list(islice(words, chunk))
        whole = len(new) < chunk
        held += new
        k = shingle if some or len(held) >= shingle else len(held)
        n = len(held) - k + 1
        if not held or (n < 1 and not whole) or (k < shingle and not whole):
            continue
        if n > 0:
            ends = np.cumsum([len(w) + 1 for w in held])
            joined, starts, stops = b" ".join(held), [0, *ends[: n - 1].tolist()], (ends[k - 1 :] - 1).tolist()
            yield np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, stops, strict=True)], dtype=np.uint64)
            some, held = True, held[n:]


def fingerprint(text: bytes, shingle: int = SHINGLE, chunk: int = CHUNK) -> int:
    """Signed 64-bit SimHash of UTF-8 bytes."""
    total, tally = 0, np.zeros(64, dtype=np.int64)
    for h in shingle_hashes(text, shingle, chunk):
        tally += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    if not total:
        return 0
    out = int.from_bytes(np.packbits(2 * tally > total, bitorder="little").tobytes(), "little")
    return out - (1 << 64) if out >> 63 else out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1024):
        yield out_batch(PRINTS, id=b.column("id"), fp=[fingerprint(t) for t in b.column("text").cast(pa.binary()).to_pylist()])


def _prints_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1024):
        prints = [fingerprint(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sha"), pa.array(prints, pa.int64())], names=["id", "sha", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp) of every row."""
    return docs.select(id_col().alias("id"), text_col().alias("text")).mapInArrow(_prints, "id long, fp long")


@lru_cache
def byte_sets(keyed: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """The sets of positions that lists are keyed by; for each mask of differing bytes, the first set among the shared ones (-1: none)."""
    sets = list(combinations(range(8), keyed))
    return sets, np.array([next((n for n, s in enumerate(sets) if not any(mask >> p & 1 for p in s)), -1) for mask in range(256)], dtype=np.int64)


def _posts(keyed: int):
    """Every fingerprint under each of its keys: number of the set of positions, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, _ = byte_sets(keyed)
        for b in slices(batches, 2048):
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            parts = fp.view(np.uint64)[:, None].view(np.uint8).reshape(-1, 8).astype(np.int64)
            keys = np.stack([sum((parts[:, p] << (8 * k) for k, p in enumerate(s)), np.int64(n << 32)) for n, s in enumerate(sets)], axis=1)
            yield out_batch(POSTS, key=keys.ravel(), fp=np.repeat(fp, len(sets)))

    return run


def _pairs(left: np.ndarray, right: np.ndarray, key: int, same: bool, apart: int, keyed: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that this list owns: tally of shared bytes, count filter, verification."""
    found_i, found_j = [], []
    step, first = max(1, (1 << 21) // max(1, len(right))), byte_sets(keyed)[1]
    for at in range(0, len(left), step):
        x = left[at : at + step, None] ^ right[None, :]
        unlike = np.packbits(x[..., None].view(np.uint8) != 0, axis=-1, bitorder="little")[..., 0]
        tally = 8 - np.bitwise_count(unlike)
        ok = (tally >= 8 - apart) & (first[unlike] == key >> 32)
        if same:
            ok &= np.arange(at, at + len(ok))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(ok)
        near = np.bitwise_count(x[i, j]) <= apart
        found_i.append(i[near] + at)
        found_j.append(j[near])
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a[i] - b[j]."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for x, y in zip(a[i].view(np.int64).tolist(), b[j].view(np.int64).tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[rx] = ry
            kept.append((x, y))
    return kept


def _lists(apart: int, list_rows: int, keyed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Posts ordered by key: links of each list; lists over list_rows come back as posts (y null)."""
        held_key, held, long_ = None, [], False

        def ended(key: int, fps: np.ndarray) -> list[tuple[int, int]]:
            if len(fps) < 2:
                return []
            i, j = _pairs(fps, fps, key, True, apart, keyed)
            return _forest(fps, i, fps, j) if len(i) else []

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy(zero_copy_only=False)
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            wide = np.flatnonzero(stops - starts > 1)
            links, over_key, over_fp = [], [], []
            runs = sorted({0, len(starts) - 1, *wide.tolist()})
            for r in runs:
                k, part = int(key[starts[r]]), fp[starts[r] : stops[r]]
                if held_key is not None and k != held_key:
                    if not long_:
                        links += ended(held_key, np.concatenate(held))
                    held_key, held, long_ = None, [], False
                if r == len(starts) - 1 or held_key == k:
                    held_key = k
                    held.append(part.copy())
                    if long_ or sum(map(len, held)) > list_rows:
                        long_ = True
                        for x in held:
                            over_key.append(np.full(len(x), k))
                            over_fp.append(x.view(np.int64))
                        held = []
                elif len(part) > list_rows:
                    over_key.append(np.full(len(part), k))
                    over_fp.append(part.view(np.int64))
                else:
                    links += ended(k, part)
            if links or over_key:
                ok = np.concatenate(over_key) if over_key else np.empty(0, np.int64)
                of = np.concatenate(over_fp) if over_fp else np.empty(0, np.int64)
                yield out_batch(OVER, x=[a for a, _ in links] + of.tolist(), y=[c for _, c in links] + [None] * len(of), key=[0] * len(links) + ok.tolist())
        if held_key is not None and not long_ and held:
            links = ended(held_key, np.concatenate(held))
            if links:
                yield out_batch(OVER, x=[a for a, _ in links], y=[c for _, c in links], key=[0] * len(links))

    return run


def _block_pairs(apart: int, keyed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ordered by (key, i, j, side): the block pair i <= j of a long list."""
        now, sides = None, ([], [])

        def ended():
            if now is None:
                return
            key, i, j = now
            a = np.array(sides[0], dtype=np.int64).view(np.uint64)
            b = a if i == j else np.array(sides[1], dtype=np.int64).view(np.uint64)
            if len(a) and len(b):
                x, y = _pairs(a, b, key, i == j, apart, keyed)
                links = _forest(a, x, b, y) if len(x) else []
                if links:
                    yield out_batch(LINKS, x=[p for p, _ in links], y=[q for _, q in links])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "fp")), strict=True):
                if r[:3] != now:
                    yield from ended()
                    now, sides = r[:3], ([], [])
                sides[r[3]].append(r[4])
        yield from ended()

    return run


def links(distinct: DataFrame, apart: int = BITS_APART, list_rows: int = LIST_ROWS, keyed: int = KEYED) -> DataFrame:
    """distinct (fp long) -> (x, y): links that join all fingerprints at most ``apart`` bits apart; a written table.

    Lists keyed by 1 to 4 bytes find all pairs up to 8 - ``keyed`` bits apart; more is refused.
    """
    if not (1 <= keyed <= 4 and 0 <= apart <= 8 - keyed):
        raise ValueError(f"lists keyed by {keyed} bytes can't find all pairs {apart} bits apart")
    posts = distinct.select("fp").mapInArrow(_posts(keyed), "key long, fp long")
    found = posts.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_lists(apart, list_rows, keyed), "x long, y long, key long")
    found = cut(found, "simhash-links")
    out = found.where(F.col("y").isNotNull()).select("x", "y")
    over = found.where(F.col("y").isNull()).select("key", F.col("x").alias("fp"))
    if over.isEmpty():
        return out
    blocks = over.join(over.groupBy("key").agg(F.ceil(F.count("*") / list_rows).cast("int").alias("n")), "key")
    blocks = blocks.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n").cast("long")).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "fp")
    pairs = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(_block_pairs(apart, keyed), "x long, y long")
    all_found = cut(out.unionByName(pairs), "simhash-found")
    free(found)
    return all_found


def _labels(prints: DataFrame, extra: DataFrame | None, apart: int, list_rows: int, keyed: int) -> DataFrame:
    """prints (id, fp ...; a written table) -> (fp, component), a written table; the component is its least id.  extra (id): ids whose fingerprints are linked too."""
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = links(classes, apart, list_rows, keyed)
    n_classes, n_found = classes.count(), found.count()
    # A class goes by its least id; classes that share it (rows that repeat an id) are one node here.
    a, b = classes.select(F.col("fp").alias("x"), F.col("least").alias("a")), classes.select(F.col("fp").alias("y"), F.col("least").alias("b"))
    near = cut(join_one(found, "x", a, n_found), "simhash-near", n_found)
    nodes = join_one(near, "y", b, n_found).select("a", "b")
    if extra is not None:
        nodes = nodes.unionByName(prints.join(extra, "id", "left_semi").join(classes, "fp").select(F.col("id").alias("a"), F.col("least").alias("b")))
    nodes = components(nodes)
    labels = cut(classes.join(nodes, F.col("least") == F.col("node"), "left").select("fp", F.coalesce("component", "least").alias("component")), "simhash-labels", n_classes)
    free(near)
    return labels


def simhash_components(docs: DataFrame, apart: int = BITS_APART, list_rows: int = LIST_ROWS, keyed: int = KEYED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id (smallest doc_id reached)."""
    prints = cut(fingerprints(docs), "fingerprints")
    # Rows that repeat a doc_id with other texts are one node: each fingerprint of an id links to the id's first.
    same = prints.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id")
    out = join_one(prints, "fp", _labels(prints, same, apart, list_rows, keyed), prints.count())
    return out.select(id_back("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_back("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, apart: int = BITS_APART) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each group of near fingerprints, columns as they were.

    Each row goes by its own text: rows that share an id, or have none, aren't linked by that.
    """
    rows = own_rows(docs).select("doc_id", "text")
    prints = cut(rows.select(F.col("doc_id.id").alias("id"), F.col("doc_id.sha").alias("sha"), "text").mapInArrow(_prints_of_rows, "id long, sha string, fp long"), "fingerprints")
    classes = cut(prints.groupBy("fp").agg(F.min(F.struct("id", "sha")).alias("first")), "classes")
    found = links(classes, apart)
    grouped = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    labels = classes.join(grouped, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("component", "fp").alias("component"))
    return keep_first(docs, prints, labels, classes.count())


def keep_first(docs: DataFrame, prints: DataFrame, labels: DataFrame, n_classes: int) -> DataFrame:
    """Rows of ``docs`` that are the first of their component; labels (first: struct of id and sha, component), prints (id, sha ...)."""
    keep = cut(labels.groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.sha"), "simhash-kept", n_classes)
    repeats = prints.groupBy("id", "sha").count().where("count > 1").select("id", "sha")
    return keep_rows(docs, keep, None if repeats.isEmpty() else repeats)
