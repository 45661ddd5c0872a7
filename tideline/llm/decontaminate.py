"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items are indexed; every passage of every document is a query.  An item's
impacts are divided by its own full score, so a score is the share of the item that a
passage accounts for, and one threshold holds for all items.  Retrieval is exact: all
(passage, item) pairs at or above the threshold come back.

Pruning has WAND's two levels, vectorised over the passages of an Arrow batch: a
passage whose terms' largest impacts don't reach the threshold is done; else the largest
impacts by block of items are summed, and only blocks that reach the threshold are
opened.  In an open block, terms are taken by falling block impact, and an item is given
up as soon as what it has and what is left can't reach the threshold.

A retrieved item counts as leaked if the passage holds enough of both its question (all
sentences but the last) and its answer (the last one): shares of their five-word
shingles, repeats once.

Passages are twice as long as the longest item of a shard and overlap by half, so any
stretch as long as an item lies in one of them.  The index is built in shards of
``SHARD`` items and broadcast in passes of bounded size.

Defined results: null texts are empty; documents and items without words yield nothing.
A null doc_id or item_id comes back as null.  Rows that repeat a doc_id give the best
values of all of them.  Other columns are not read.  Empty tables: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, matching, own_rows, slices, text_col

THRESHOLD, OVERLAP, GRAM = 0.5, 0.6, 5
K1, B = 1.2, 0.75
SHARD, BLOCKS = 2048, 64
#: Bytes of items on the driver at a time; bytes of block bounds broadcast for a pass.
ITEM_BYTES, PASS_BYTES = 16 << 20, 64 << 20
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(ws: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; one sentence is both."""
    parts = [w for w in map(words, SENTENCE.split(text)) if w]
    if len(parts) < 2:
        return (parts[0], parts[0]) if parts else ([], [])
    return [w for p in parts[:-1] for w in p], parts[-1]


@dataclass
class Shard:
    items: list[int]  # positions of the items in the benchmark
    terms: dict[str, int]
    top: np.ndarray  # largest impact of a term
    by_block: np.ndarray  # the same by block of items
    postings: list[dict[int, list[tuple[int, float]]]]  # of a term: by block, items and impacts
    texts: list[tuple[set, set]]  # shingles of question and answer
    passage: int
    size: int  # items in a block


@dataclass
class Statistics:
    """Items that have words, their words in all, and in how many items each word is."""

    items: int
    words: int
    df: dict[str, int]


def statistics(texts: list[str]) -> Statistics:
    bags = [b for b in map(words, texts) if b]
    return Statistics(len(bags), sum(map(len, bags)), Counter(w for b in bags for w in set(b)))


def build(texts: list[str], shard: int = SHARD, blocks: int = BLOCKS, of: Statistics | None = None) -> list[Shard]:
    """Shards of the index; document frequencies and lengths are those of all items: ``of``, or these texts."""
    of = of or statistics(texts)
    bags = [Counter(words(t)) for t in texts]
    live = [n for n, b in enumerate(bags) if b]
    mean = of.words / max(1, of.items)
    idf = {w: np.log(1 + (of.items - d + 0.5) / (d + 0.5)) for w, d in of.df.items()}
    live.sort(key=lambda n: (sum(bags[n].values()), n))  # like lengths share blocks: tighter bounds
    out = []
    for at in range(0, len(live), shard):
        items = live[at : at + shard]
        size = -(-len(items) // blocks)
        terms: dict[str, int] = {}
        postings: list[dict[int, list[tuple[int, float]]]] = []
        for k, n in enumerate(items):
            length = sum(bags[n].values())
            impact = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) for w, tf in bags[n].items()}
            whole = sum(impact.values())
            for w, v in impact.items():
                t = terms.setdefault(w, len(terms))
                if t == len(postings):
                    postings.append({})
                postings[t].setdefault(k // size, []).append((k, v / whole))
        by_block = np.zeros((len(terms), -(-len(items) // size)), dtype=np.float32)
        for t, p in enumerate(postings):
            for b, pairs in p.items():
                by_block[t, b] = np.nextafter(np.float32(max(v for _, v in pairs)), np.float32(2))  # a bound, so never less
        qa = [question_answer(texts[n]) for n in items]
        out.append(Shard(items, terms, by_block.max(axis=1), by_block, postings, [(shingles(q), shingles(a)) for q, a in qa], 2 * max(sum(bags[n].values()) for n in items), size))
    return out


def open_block(s: Shard, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
    """Items of a block at or above the threshold, exactly."""
    bound = s.by_block[terms, block].astype(np.float64)
    terms, bound = terms[bound > 0], bound[bound > 0]
    order = np.lexsort((terms, -bound))
    left = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]])
    scores: dict[int, float] = {}
    for n, t in enumerate(terms[order].tolist()):
        new = left[n] >= threshold - 1e-9  # else no item that isn't there yet can reach it
        for k, v in s.postings[t][block]:
            if k in scores:
                scores[k] += v
            elif new:
                scores[k] = v
        if not new:
            scores = {k: v for k, v in scores.items() if v + left[n + 1] >= threshold - 1e-9}
            if not scores:
                break
    return [(k, v) for k, v in scores.items() if v >= threshold - 1e-9]


def search(s: Shard, docs: list[list[str]], threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, float]]:
    """(document, first word of the passage, item of the shard, score) of all pairs at or above the threshold."""
    stride, get = s.passage // 2, s.terms.get
    doc_of, word_of, terms, at = [], [], [], 0
    for d, ws in enumerate(docs):
        n = max(1, -(-len(ws) // stride) - 1)  # passages start at every stride; the last reaches the end
        doc_of += [d] * n
        word_of += range(0, n * stride, stride)
        t = np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
        segment = np.arange(len(ws)) // stride
        for shift in (0, 1):
            p = segment - shift
            ok = (t >= 0) & (p >= 0) & (p < n)
            terms.append((at + p[ok]) * len(s.terms) + t[ok])
        at += n
    pairs = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.int64)
    if not len(pairs):
        return
    passage, term = np.divmod(pairs, len(s.terms))
    total = np.bincount(passage, weights=s.top[term], minlength=at)
    keep = total[passage] >= threshold - 1e-9
    passage, term = passage[keep], term[keep]
    starts = np.concatenate([[0], np.flatnonzero(passage[1:] != passage[:-1]) + 1, [len(passage)]])
    for lo in range(0, len(starts) - 1, 256):
        edges = starts[lo : lo + 257]
        if len(edges) < 2 or edges[0] == edges[-1]:
            continue
        bound = np.add.reduceat(s.by_block[term[edges[0] : edges[-1]]], edges[:-1] - edges[0], axis=0, dtype=np.float64)
        for i, b in zip(*np.nonzero(bound >= threshold - 1e-9), strict=True):
            p = int(passage[edges[i]])
            for k, v in open_block(s, term[edges[i] : edges[i + 1]], int(b), threshold):
                yield doc_of[p], word_of[p], k, v


FOUND = "doc_id {kind}, item int, score double, question double, answer double"


def _run(index, threshold: float, overlap: float, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            docs = [words(t) for t in b.column("text").to_pylist()]
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for s in index.value:
                seen: dict[tuple[int, int], set] = {}
                for d, at, k, score in search(s, docs, threshold):
                    if (d, at) not in seen:
                        seen[d, at] = shingles(docs[d][at : at + s.passage], gram)
                    inside, ws = seen[d, at], docs[d][at : at + s.passage]
                    share = []
                    for part in s.texts[k]:
                        short = next(iter(part)) if len(part) == 1 else ()
                        if len(part) == 1 and len(short) < gram:
                            hit = any(tuple(ws[i : i + len(short)]) == short for i in range(len(ws) - len(short) + 1))
                            share.append(float(hit))
                        else:
                            share.append(len(part & inside) / len(part))
                    if min(share) >= overlap:
                        new = (score, *share)
                        old = best.get((d, s.items[k]), new)
                        best[d, s.items[k]] = tuple(map(max, old, new))
            if best:
                take = pa.array([d for d, _ in best])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), pa.array([i for _, i in best], pa.int32()), *(pa.array([v[n] for v in best.values()], pa.float64()) for n in range(3))], names=["doc_id", "item", "score", "question", "answer"])

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 256):
        for t in b.column("text").to_pylist():
            found = Counter(words(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])


def _live_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_pydict({"n": [sum(bool(words(t)) for t in b.column("text").to_pylist())]})


def _groups(benchmark: DataFrame, item_bytes: int) -> Iterator[tuple[list, Statistics | None]]:
    """The items in groups of about ``item_bytes``, each with the statistics of all items; one group needs none."""
    texts = benchmark.select("item_id", text_col().alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // item_bytes))
    if n == 1:
        yield texts.orderBy("item_id", "text").collect(), None
        return
    counts = cut(texts.mapInArrow(_item_words, "word string, n long").groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("n")), "item-words")
    total_words = counts.agg(F.sum("n")).first()[0] or 0
    live = texts.mapInArrow(_live_items, "n long").agg(F.sum("n")).first()[0] or 0
    group = texts.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        part = group.where(F.col("g") == k).drop("g")
        items = part.orderBy("item_id", "text").collect()
        mine = part.mapInArrow(_item_words, "word string, n long").select("word").distinct()
        yield items, Statistics(live, total_words, {r.word: r.df for r in counts.join(mine, "word", "left_semi").collect()})


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, gram: int = GRAM, shard: int = SHARD, item_bytes: int = ITEM_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, score, question_overlap, answer_overlap of each leak.

    At most about ``item_bytes`` of the items are on the driver at a time, and shards of about
    ``pass_bytes`` are broadcast for one pass; a larger benchmark takes more passes over docs.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_col().alias("text"))
    found = []
    for items, of in _groups(benchmark, item_bytes):
        index = build([r.text for r in items], shard, of=of)
        names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(items)], f"n int, item_id {item_kind}")
        best = None
        while index:
            n = max(1, int(np.searchsorted(np.cumsum([s.by_block.nbytes for s in index]), pass_bytes, side="right")))
            held, index = sc.broadcast(index[:n]), index[n:]
            part = rows.mapInArrow(_run(held, threshold, overlap, gram), FOUND.format(kind=kind))
            best = part if best is None else best.unionByName(part)
        if best is not None:
            best = best.groupBy("doc_id", "item").agg(*(F.max(c).alias(c) for c in ("score", "question", "answer")))
            found.append(best.join(F.broadcast(names), F.col("item") == F.col("n")).select("doc_id", "item_id", "score", F.col("question").alias("question_overlap"), F.col("answer").alias("answer_overlap")))
    if not found:
        return spark.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double")
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that hold a test item, columns as they were."""
    bad = leaks(own_rows(docs), benchmark, **parameters).select("doc_id.*").distinct()
    return matching(docs, bad, "left_anti")
