"""SimHash near-dedup by similarity: wide fingerprints in the byte-position inverted index.

Texts alike to 0.8 in their sets of five-word shingles differ in about 0.15 of the bits of
a SimHash, ten of 64; there 64 bits neither guarantee a shared byte nor tell such pairs
from others well.  Here a fingerprint has 64 positional bytes: every distinct shingle votes
on 512 bits.  The index lists fingerprints under three positional bytes at once, in 128
sets of positions.  A near pair shares about 17 bytes of 64 at 0.8, more above, and is
found if it shares one of the sets: no number of bytes is guaranteed at that many bits, so
the README gives the recall against all pairs.

Pairs of a list are tallied by shared positional bytes, those under ``SHARED`` go, and
differing bits are counted.  A similarity makes a number of bits expected, with a standard
error of 8 bits at 0.8; pairs up to ``DOUBTFUL`` errors above it are possible links.  They
decide nothing but which texts are compared: the texts that possible links join, directly
or by others, are a group, and within a group every pair that other links don't join
already is counted out by its two sets of shingles.  So no possible link stands for another.

A post holds the first 8 bytes besides its node.  A list lets go those that are like no
other in these bytes; the others, few, get their whole fingerprints, and a spanning forest
of the possible links is searched breadth first, which gives the same groups as all of
them (lists of up to ``FEW``: all pairs).  Lists over ``LIST_ROWS`` are dealt out in pairs
of blocks.

Groups of up to ``FEW`` texts are compared pair by pair.  Of larger ones a task holds a
block of ``BLOCK_BYTES`` of sets and compares each set with those that it isn't joined to,
so a block of copies of one text is done in few passes.  Where a group has several blocks,
the texts outside its largest part are then held against every block.

``SET_BYTES`` bytes make 2^24 keys a set: a random post meets N / 2^24 others, under one up
to 16 million texts, and the lists grow beyond; four bytes (more sets) then suit better.

Defined results: null text equals empty text; no words give the fingerprint zero.  A null
doc_id counts as smaller than any other.  Rows that share an id, or have none, aren't
linked by that: each goes by its own text.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, free, longs, out_batch, own_rows, slices
from tideline.llm.components import components
from tideline.llm.simhash import LINKS, LIST_ROWS, keep_first, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Bytes of a fingerprint; bytes a set; the sets are {p, p + g, p + h} for all positions p, any two of which share one byte at most.
WIDE, SET_BYTES, STEPS = 64, 3, ((1, 3), (7, 20))
#: Least number of shared positional bytes: 17 are expected at 0.8 (standard deviation 3.5).
SHARED = 6
#: Differing bits of the first 8 bytes up to which a post stays: ten are expected at 0.8 (standard deviation 3), 32 of unlike texts.
WORD_APART = 22

#: Standard errors of the bits up to which a link is possible; rows of a list or group up to which all its pairs are taken; partners of a text compared in one task.
DOUBTFUL, FEW, PARTNERS = 3.0, 16, 256
#: Bytes of sets of shingles in a block of a group.
BLOCK_BYTES = 4 << 20

SETS = np.array([[p, (p + g) % WIDE, (p + h) % WIDE] for g, h in STEPS for p in range(WIDE)])
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ROWS = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("wide", pa.binary()), ("digest", pa.binary())])
POSTS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("word", pa.int64())])
SHINGLES = pa.schema([("g", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary())])
MET = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("over", pa.bool_())])


def bits_apart(similarity: float) -> int:
    """Differing bits up to which sets of equal size may be at this Jaccard similarity or above."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(8 * WIDE * share + DOUBTFUL * sqrt(8 * WIDE * share * (1 - share)))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of a text's shingles, ascending."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, shingle)]))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """SimHash of a text's distinct shingles; a shingle's 8 words of bits come from its XXH64 by SplitMix64."""
    tally, steps = np.zeros(8 * WIDE, dtype=np.int64), GOLDEN * np.arange(1, WIDE // 8 + 1, dtype=np.uint64)
    for at in range(0, len(h), 4096):
        z = h[at : at + 4096, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        tally += np.unpackbits(z.view(np.uint8).reshape(-1, WIDE), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * tally > len(h)).tobytes()


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            wide, digest = [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                h = shingle_set(t, shingle)
                wide.append(wide_fingerprint(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
            yield out_batch(ROWS, id=b.column("id"), sha=b.column("sha"), wide=wide, digest=digest)

    return run


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, WIDE)


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint under each of its keys: number of the set of positions, and their bytes."""
    for b in slices(batches, 2048):
        wide = _matrix(b.column("wide"))
        keys = np.arange(len(SETS), dtype=np.int64) << (8 * SET_BYTES)
        keys = keys + sum(wide[:, SETS[:, k]].astype(np.int64) << (8 * k) for k in range(SET_BYTES))
        word = wide[:, :8].copy().view(np.int64).ravel()
        yield out_batch(POSTS, key=keys.ravel(), node=np.repeat(longs(b.column("node")), len(SETS)), word=np.repeat(word, len(SETS)))


def runs(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[pa.Table, bool]]:
    """Runs of two rows and more that share the first column, of rows ordered by it.

    Those over ``limit`` rows come in pieces, marked True.
    """
    now, held, rows, over = None, [], 0, False
    for b in batches:
        if not b.num_rows:
            continue
        key = longs(b.column(0))
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        sizes = np.diff(edges)
        for r in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()}):
            if now is not None and key[edges[r]] != now:
                if rows > 1 or (rows and over):
                    yield pa.Table.from_batches(held), over
                held, rows, over = [], 0, False
            now = key[edges[r]]
            held.append(b.slice(int(edges[r]), int(sizes[r])))
            rows += int(sizes[r])
            if limit is not None and rows > (0 if over else limit):
                yield pa.Table.from_batches(held), True
                held, rows, over = [], 0, True
    if rows > 1 or (rows and over):
        yield pa.Table.from_batches(held), over


def _alike(words: np.ndarray) -> np.ndarray:
    """Which of a list's words are like another one."""
    near = np.bitwise_count(words ^ words[0]) <= WORD_APART
    near[0] = near[1:].any()
    rest = np.flatnonzero(~near)
    step = max(1, (1 << 20) // len(words))
    for at in range(0, len(rest), step):
        some = rest[at : at + step]
        like = np.bitwise_count(words[some, None] ^ words[None, :]) <= WORD_APART
        like[np.arange(len(some)), some] = False
        near[some] = like.any(axis=1)
        near |= like.any(axis=0)
    return near


def _met(list_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Posts ordered by key: those like another of their list, and all of lists over list_rows."""
        for t, over in runs(batches, list_rows):
            if not over:
                t = t.filter(pa.array(_alike(t.column("word").to_numpy().view(np.uint64))))
            if t.num_rows:
                yield out_batch(MET, key=t.column("key").combine_chunks(), node=t.column("node").combine_chunks(), over=pa.array(np.full(t.num_rows, over)))

    return run


def _near(a: np.ndarray, b: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of a with every row of b: whether they share enough positional bytes and differ in few enough bits, and these bits."""
    x = a[:, None, :] ^ b[None, :, :]
    bits = np.bitwise_count(x.view(np.uint64)).sum(axis=-1, dtype=np.int64)
    return (WIDE - np.count_nonzero(x, axis=-1) >= SHARED) & (bits <= apart), bits


def forest(wide: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs that join all fingerprints (rows of bytes) that near ones connect, by breadth first search, and each one's tree."""
    left, xs, ys, tree = np.arange(len(wide)), [], [], np.arange(len(wide))
    while len(left) > 1:
        root = left[0]
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, (1 << 17) // len(left))
            now, front = front[:step], front[step:]
            found = np.zeros(len(left), dtype=bool)
            block = 1 << 17
            for at in range(0, len(left), block):
                near, bits = _near(wide[now], wide[left[at : at + block]], apart)
                hit = near.any(axis=0)
                found[at : at + block] = hit
                xs.append(now[np.where(near, bits, 8 * WIDE + 1)[:, hit].argmin(axis=0)])
                ys.append(left[at : at + block][hit])
            tree[left[found]] = root
            front, left = np.concatenate([front, left[found]]), left[~found]
    return (np.concatenate(xs), np.concatenate(ys), tree) if xs else (left[:0], left[:0], tree)


def _links(apart: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in runs(batches, None):
            node, wide = t.column("node").to_numpy(), _matrix(t.column("wide"))
            if len(node) <= FEW:
                x, y = np.nonzero(np.triu(_near(wide, wide, apart)[0], 1))
            else:
                x, y, _ = forest(wide, apart)
            if len(x):
                yield out_batch(LINKS, x=np.minimum(node[x], node[y]), y=np.maximum(node[x], node[y]))

    return run


def links(classes: DataFrame, apart: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """classes (node long, wide binary; a written table) -> distinct (x, y), x < y: links that join fingerprints up to ``apart`` bits apart; a written table."""
    posts = classes.select("node", "wide").mapInArrow(_posts, "key long, node long, word long")
    met = cut(posts.repartition("key").sortWithinPartitions("key").mapInArrow(_met(list_rows), "key long, node long, over boolean"), "wide-met")
    whole = met.join(classes.select("node", "wide"), "node")
    dealt = whole.where(~F.col("over")).select(F.col("key").alias("g"), "node", "wide")
    over = met.where("over").groupBy("key").agg(F.ceil(F.count("*") / list_rows).cast("int").alias("n"))
    if not over.isEmpty():
        blocks = whole.where("over").join(over, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n").cast("long")).cast("int"))
        blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("mine <> other")
        # Groups that share a hash are compared together; each link is counted out, so none is wrong.
        dealt = dealt.unionByName(blocks.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "node", "wide"))
    found = dealt.repartition("g").sortWithinPartitions("g", "node").mapInArrow(_links(apart), "x long, y long")
    out = cut(found.distinct(), "wide-links")
    free(met)
    return out


def _shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            yield out_batch(SHINGLES, g=b.column("g"), node=b.column("node"), shingles=[shingle_set(t, shingle).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()])

    return run


def _compared(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ordered by (x, part, y), the first of each (x, part) with a null y and x's own shingles: pairs as similar as that."""
        mine = np.empty(0, np.uint64)
        for b in batches:
            xs, ys = [], []
            for n, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                other = np.frombuffer(b.column("shingles")[n].as_py(), np.uint64)
                if y is None:
                    mine = other
                    continue
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both >= similarity * (len(mine) + len(other) - both):
                    xs.append(x)
                    ys.append(y)
            yield out_batch(LINKS, x=xs, y=ys)

    return run


def compare(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (x, y) whose shingles (node, shingles) are as similar as that.

    Both are written tables.  A text with many partners is dealt out in parts of about
    ``PARTNERS``; each task holds one set and streams its partners' past it.
    """
    parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = cut(pairs.join(parts, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts"))).drop("parts"), "wide-dealt")
    others = dealt.join(shingles, F.col("y") == F.col("node")).select("x", "part", "y", "shingles")
    own = dealt.select("x", "part").distinct().join(shingles, F.col("x") == F.col("node")).select("x", "part", F.lit(None).cast("long").alias("y"), "shingles")
    return own.unionByName(others).repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first()).mapInArrow(_compared(similarity), "x long, y long")


def joined(sets: list[np.ndarray], similarity: float, label: np.ndarray, asks: np.ndarray) -> tuple[list[int], list[int]]:
    """Index pairs that join all sets as similar as that, directly or by others, of which one asks.

    Sets of one label are joined already.  Each set that asks is compared with all of other labels.
    """
    sizes, label, xs, ys = np.array([len(s) for s in sets]), np.unique(label, return_inverse=True)[1], [], []
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(ids) + 1, dtype=bool)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    for n in np.flatnonzero(asks).tolist():
        others = np.flatnonzero((label != label[n]) & (sizes >= similarity * sizes[n]) & (sizes[n] >= similarity * sizes))
        if len(others) and sizes[n]:
            mark[parts[n]] = True
            starts = np.cumsum(sizes[others]) - sizes[others]
            both = np.add.reduceat(mark[np.concatenate([parts[o] for o in others.tolist()])], starts, dtype=np.int64)
            mark[parts[n]] = False
            others = others[both >= similarity * (sizes[n] + sizes[others] - both)]
        if len(others):
            found, at = np.unique(label[others], return_index=True)
            xs += [n] * len(at)
            ys += others[at].tolist()
            label[np.isin(label, found)] = label[n]
    return xs, ys


def _joined(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, node, label, asks, shingles) ordered by key: the links of each key's sets."""
        for t, _ in runs(batches, None):
            node, asks = t.column("node").to_numpy(), t.column("asks").to_numpy()
            x, y = joined([np.frombuffer(s.as_py(), np.uint64) for s in t.column("shingles")], similarity, t.column("label").to_numpy(), asks)
            if x:
                yield out_batch(LINKS, x=np.minimum(node[x], node[y]), y=np.maximum(node[x], node[y]))

    return run


def _in_tasks(rows: DataFrame, similarity: float) -> DataFrame:
    # Tasks that share a key are compared together; each link is counted out, so none is wrong.
    return rows.select("key", "node", "label", "asks", "shingles").repartition("key").sortWithinPartitions("key").mapInArrow(_joined(similarity), "x long, y long")


def join_groups(members: DataFrame, similarity: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """members (g, node, shingles; a written table) -> (x, y), a written table: links that join all texts of a group that are as similar as that, directly or by others."""
    sizes = members.groupBy("g").agg(F.count("*").alias("n"), F.ceil(F.sum(F.length("shingles") + 8) / block_bytes).alias("blocks"))
    sizes = cut(sizes, "wide-sizes")
    few = members.select("g", F.col("node").alias("x")).join(sizes.where(f"n <= {FEW}"), "g")
    pairs = cut(few.join(members.select("g", F.col("node").alias("y")), "g").where("x < y").select("x", "y"), "wide-pairs")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    blocks = members.join(sizes.where(f"n > {FEW}"), "g").withColumn("block", block)
    alone = blocks.select(F.xxhash64("g", "block").alias("key"), "node", F.col("node").alias("label"), F.lit(True).alias("asks"), "shingles")
    near = cut(compare(pairs, members.select("node", "shingles"), similarity).unionByName(_in_tasks(alone, similarity)), "wide-near")
    if not sizes.where(f"n > {FEW} AND blocks > 1").isEmpty():
        # A pair of two blocks that nothing joins yet has a text outside the largest part of its group.
        labels = components(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "own")
        parts = blocks.where("blocks > 1").join(labels, F.col("own") == F.col("node"), "left").withColumn("label", F.coalesce("component", "node"))
        parts = cut(parts.select("g", "node", "label", "block", "blocks", "shingles"), "wide-parts")
        weights = parts.groupBy("g", "label").agg(F.sum(F.length("shingles") + 8).alias("bytes"))
        largest = weights.groupBy("g").agg(F.max_by("label", "bytes").alias("largest"), F.ceil((F.sum("bytes") - F.max("bytes")) / block_bytes).alias("chunks")).where("chunks > 0")
        parts_of = parts.join(largest, "g")
        asked = parts_of.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        asking = parts_of.where("label <> largest").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        across = asked.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)).select(*asked.columns, "asks"))
        inner, near = near, cut(near.unionByName(_in_tasks(across.withColumn("key", F.xxhash64("g", "block", "chunk")), similarity)), "wide-near")
        free(inner, parts)
    free(sizes, pairs)
    return near


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, list_rows: int = LIST_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each group of near copies, columns as they were."""
    rows = own_rows(docs).select(F.col("doc_id.id").alias("id"), F.col("doc_id.sha").alias("sha"), "text")
    prints = cut(rows.mapInArrow(_prints(shingle), "id long, sha string, wide binary, digest binary"), "wide-prints")
    # Texts of one set of shingles are a class.
    first = prints.groupBy("wide", "digest").agg(F.min(F.struct("id", "sha")).alias("first"))
    classes = cut(first.withColumn("node", F.monotonically_increasing_id()), "wide-classes")
    found = links(classes, bits_apart(similarity), list_rows)
    groups = components(found.select(F.col("x").alias("a"), F.col("y").alias("b"))).select("node", F.col("component").alias("g"))
    groups = groups.unionByName(groups.select("g", F.col("g").alias("node")).distinct())  # components leaves out the smallest node
    named = cut(classes.join(groups, "node").select("g", "node", F.col("first.id").alias("__id"), F.col("first.sha").alias("__sha")), "wide-groups")
    texts = rows.join(named, (F.col("id") == F.col("__id")) & (F.col("sha") == F.col("__sha"))).select("g", "node", "text")
    # Rows that repeat an id and its text give one set.
    sets = texts.mapInArrow(_shingles(shingle), "g long, node long, shingles binary").groupBy("g", "node").agg(F.first("shingles").alias("shingles"))
    sets = cut(sets, "wide-shingles")
    near = join_groups(sets, similarity, block_bytes)
    free(found, named, sets)
    grouped = components(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
    labels = classes.withColumnRenamed("node", "own").join(grouped, F.col("own") == F.col("node"), "left").select("first", F.coalesce("component", "own").alias("component"))
    return keep_first(docs, prints, labels, classes.count())
