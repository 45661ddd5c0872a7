"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the rows, side by side, of three small hashed tables: of the whole
word, of its first four and of its first six characters.  So two words rarely share an
embedding though the tables are small, and forms of one stem share most of it.
Filters of several widths run over the words, each is max-pooled over the whole text,
and a logistic layer weighs the pooled values.  Before training, one coordinate of
each table starts at the smoothed log-odds of the bucket's words in the training
labels; the rest starts at random.  Adam trains all of it.

The score is calibrated on held-back training rows: the cut that separates best gets
the score 0.7.  ``thresholds`` are calibrated by language on the same rows, drawn
towards that cut where a language has few rows.  A score reads the text alone.

At prediction, filters are folded into the tables, so a word costs a few table rows.
Texts over ``CHUNK`` words go through in overlapping chunks with a running maximum.

Training reads a bounded sample: up to ``max_rows`` rows of either label, those of the
smallest hash of doc_id, with texts up to ``max_chars`` characters.  Scores cover all rows.

Defined results: null text equals empty text; a text without words has the model's
score of nothing found.  Rows with a null label or doc_id don't train; a doc_id
labelled twice counts as toxic if any of its labels says so.  Without any label of
either kind, all scores are 0.  Null or unseen languages use the general threshold.
Rows that repeat a doc_id are scored each; the smallest of their texts trains.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import slices, smallest_hashes, text_col

BUCKETS, PART = 1 << 15, 4
STEMS = (None, 4, 6)
WIDTHS, FILTERS = (1, 2, 3), 8
CHUNK = 1 << 13
CACHE = 100_000
CUT = 0.7
WORD = re.compile(r"[^\W_]+")


class Hasher:
    """Words to a bucket of each table, packed into one number; cached."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words, seen = WORD.findall(text.lower()), self.seen
        try:
            ids = [seen[w] for w in words]
        except KeyError:
            if len(seen) > CACHE:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = sum((zlib.crc32(w[:n].encode("utf-8", "replace")) % BUCKETS) << (15 * k) for k, n in enumerate(STEMS))
            ids = [seen[w] for w in words]
        return np.array(ids, dtype=np.int64).reshape(-1)


def _buckets(ids: np.ndarray) -> list[np.ndarray]:
    return [(ids >> (15 * k)) & (BUCKETS - 1) for k in range(len(STEMS))]


@dataclass
class Model:
    tables: np.ndarray  # tables, BUCKETS, widths in all, FILTERS: tables with filters folded in
    bias: np.ndarray  # widths, FILTERS
    weights: np.ndarray
    offset: float
    shift: float = 0.0
    scale: float = 1.0
    cut: float = CUT
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        reach = max(WIDTHS) - 1
        for at in range(0, len(ids), CHUNK):
            part = ids[max(0, at - reach) : at + CHUNK]
            x = sum(t[b] for t, b in zip(self.tables, _buckets(part), strict=True))  # words, taps, filters
            tap = 0
            for n, w in enumerate(WIDTHS):
                if len(part) >= w:
                    z = x[: len(part) - w + 1, tap]
                    for j in range(1, w):
                        z = z + x[j : len(part) - w + 1 + j, tap + j]
                    out[n] = np.maximum(out[n], z.max(axis=0) + self.bias[n])
                tap += w
        return out.ravel()

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids) @ self.weights + self.offset)

    def score(self, ids: np.ndarray) -> float:
        z = self.scale * (self.logit(ids) - self.shift) + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(texts: list[str], labels: list[int], langs: list[str | None], epochs: int = 3, seed: int = 7) -> Model | None:
    """Fit on these rows; every fifth of either label is held back to calibrate the cut and the thresholds."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    rng, hasher = np.random.default_rng(seed), Hasher()
    docs = [hasher(t) for t in texts]
    rank = np.zeros(len(y), dtype=np.int64)
    for label in (0, 1):
        rank[y == label] = np.arange((y == label).sum())
    few = min((y == 0).sum(), (y == 1).sum()) < 10
    held = np.flatnonzero(rank % 5 == 4) if not few else np.arange(len(y))
    fit = np.flatnonzero(rank % 5 != 4) if not few else np.arange(len(y))

    tables = rng.normal(0, 0.1, (len(STEMS), BUCKETS, PART)).astype(np.float32)
    positive = (y[fit] == 1).sum()
    for n in range(len(STEMS)):
        seen = np.zeros((2, BUCKETS))
        for d in fit:
            seen[y[d]][np.unique(_buckets(docs[d])[n])] += 1
        odds = np.log((seen[1] + 1) / (positive + 20)) - np.log((seen[0] + 1) / (len(fit) - positive + 20))
        tables[n, :, 0] = np.clip(np.where(seen[1] > 1, odds, np.minimum(odds, 0)), -2, 4)
    taps = sum(WIDTHS)
    filters = rng.normal(0, 0.2, (taps, len(STEMS) * PART, FILTERS)).astype(np.float32)
    filters[0, ::PART, 0] = 1 / len(STEMS)
    p = {"e": tables, "f": filters, "b": np.zeros((len(WIDTHS), FILTERS), np.float32), "w": rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), "o": np.zeros(1, np.float32)}
    p["w"][0], p["o"][0] = 2.0, -3.0
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    weight = {1: 0.5 * len(fit) / max(1, positive), 0: 0.5 * len(fit) / max(1, len(fit) - positive)}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), 32):
            g = {k: np.zeros_like(v) for k, v in p.items() if k != "e"}
            rows: dict[tuple[int, int], np.ndarray] = {}
            for d in order[at : at + 32]:
                _backward(p, docs[d], y[d], weight[y[d]] / 32, g, rows)
            step += 1
            rate = 0.01 * (1 - epoch / (epochs + 1))
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.999 * square[k] + 0.001 * v * v
                p[k] -= rate * fix * mean[k] / (np.sqrt(square[k]) + 1e-7)
            for (n, r), v in rows.items():  # lazily, for the rows touched
                mean["e"][n, r] = 0.9 * mean["e"][n, r] + 0.1 * v
                square["e"][n, r] = 0.999 * square["e"][n, r] + 0.001 * v * v
                p["e"][n, r] -= rate * fix * mean["e"][n, r] / (np.sqrt(square["e"][n, r]) + 1e-7)
    folded = np.stack([np.einsum("bh,thf->btf", p["e"][n], p["f"][:, n * PART : (n + 1) * PART]) for n in range(len(STEMS))])
    model = Model(folded.astype(np.float32), p["b"], p["w"], float(p["o"][0]))
    z = np.array([model.logit(docs[d]) for d in held])
    model.shift = best_cut(z, y[held])
    model.scale = float(np.clip(2.0 / max(1e-3, np.std(z)), 0.25, 4.0))
    scores = np.array([model.score(docs[d]) for d in held])
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([langs[d] == lang for d in held])
        n = min(int(y[held][mine].sum()), int((1 - y[held][mine]).sum()))
        own = best_cut(scores[mine], y[held][mine]) if n else CUT
        model.thresholds[lang] = float((n * own + 20 * CUT) / (n + 20))
    return model


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best F1."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    hits = y[::-1].cumsum()[::-1]
    f1 = 2 * hits / (np.arange(len(y), 0, -1) + max(1, y.sum()))
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    lower = np.where(best > 0, z[best - 1], z[best] - 1)
    k = int(np.argmax(z[best] - lower))
    return float((z[best[k]] + lower[k]) / 2)


def _backward(p: dict, ids: np.ndarray, label: int, weight: float, g: dict, rows: dict) -> None:
    """Adds one text's gradients; a maximum passes its gradient to the words under it alone."""
    buckets = _buckets(ids)
    x = np.concatenate([t[b] for t, b in zip(p["e"], buckets, strict=True)], axis=1)
    pooled, where, tap = np.zeros((len(WIDTHS), FILTERS), np.float32), np.full((len(WIDTHS), FILTERS), -1), 0
    for n, w in enumerate(WIDTHS):
        if len(ids) >= w:
            m = len(ids) - w + 1
            z = x[:m] @ p["f"][tap]
            for j in range(1, w):
                z += x[j : j + m] @ p["f"][tap + j]
            top = z.argmax(axis=0)
            best = z[top, np.arange(FILTERS)] + p["b"][n]
            pooled[n] = np.maximum(best, 0)
            where[n] = np.where(best > 0, top, -1)
        tap += w
    logit = pooled.ravel() @ p["w"] + p["o"][0]
    d = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
    g["w"] += d * pooled.ravel()
    g["o"] += d
    back, tap = d * p["w"].reshape(pooled.shape), 0
    for n, w in enumerate(WIDTHS):
        live = np.flatnonzero(where[n] >= 0)
        g["b"][n, live] += back[n, live]
        for j in range(w):
            at = where[n, live] + j
            g["f"][tap + j][:, live] += x[at].T * back[n, live]
            dx = p["f"][tap + j][:, live].T * back[n, live][:, None]
            for i, v in zip(at, dx, strict=True):
                for t, own in enumerate(buckets):
                    r, part = own[i], v[t * PART : (t + 1) * PART]
                    rows[t, r] = rows[t, r] + part if (t, r) in rows else part
        tap += w


def is_held_out(doc_id):
    """True where crc32 of doc_id as text leaves 1 by 3; false for null."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2500, max_chars: int = 100_000, seed: int = 7) -> Model | None:
    """docs (doc_id, text, lang), labels (doc_id, toxic): a model of the sampled labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.least(F.greatest(F.max("toxic"), F.lit(0)), F.lit(1)).cast("int").alias("y"))
    short = docs.where(F.char_length(text_col()) <= max_chars).select(F.col("doc_id").alias("id"), text_col().alias("text"), F.col("lang").cast("string").alias("lang"))
    picked = F.broadcast(smallest_hashes(known, "y", max_rows))  # 2 * max_rows rows of three numbers
    # One text a doc_id, the smallest: rows that repeat an id don't add to what the driver gets.
    rows = short.join(picked, F.col("id") == F.col("doc_id")).groupBy("id", "y", "r").agg(F.min(F.struct("text", "lang")).alias("t")).select("y", "t.text", "t.lang", "r", "id").collect()
    rows.sort(key=lambda r: (r.r, r.id, r.text))
    return train([r.text for r in rows], [r.y for r in rows], [r.lang for r in rows], seed=seed)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text) -> doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = held.value, Hasher()
        for b in slices(batches, 512):
            s = [m.score(hasher(t)) if m else 0.0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(s, pa.float64())], names=["doc_id", "lang", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", lang.alias("lang"), text_col().alias("text")).mapInArrow(run, f"doc_id {kind}, lang string, score double")


def flag(scored: DataFrame, model: Model | None) -> DataFrame:
    """Adds predicted (score at the general cut) and flagged (score at the language's threshold)."""
    cuts = (model.thresholds if model else None) or {"": CUT}
    by = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    threshold = F.coalesce(F.try_element_at(by, F.coalesce("lang", F.lit(""))), F.lit(CUT))
    return scored.withColumn("threshold", threshold).withColumn("predicted", (F.col("score") >= CUT).cast("int")).withColumn("flagged", (F.col("score") >= F.col("threshold")).cast("int"))
