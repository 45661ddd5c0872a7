"""A corpus pipeline over ``documents``: each stage reads what the one before wrote.

Toxic documents go, then exact copies, near copies and documents that hold benchmark
items; the last stage encodes what is left.

Every stage judges a row by its own text, so null or repeated doc_ids lose no other row.  A
null text is an empty one.  A null doc_id counts as smaller than any other.  Empty tables
give no rows.  Columns of other names stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, exact_dedup, simhash_wide, toxicity
from tideline.llm.common import cut, matching, own_rows
from tideline.llm.queries import ENCODE_FILE, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents at or above their language's threshold.  Labels of the held-out third don't train.

    Null texts are empty texts and score as the model's nothing found.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.is_held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    scored = toxicity.flag(toxicity.score(own_rows(docs), model), model)
    bad = cut(scored.where("flagged = 1").select("doc_id.*").distinct(), "toxic")
    return matching(docs, bad, "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike to 0.8 in their five-word shingles, the one with the smallest doc_id stays."""
    return simhash_wide.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold the question and answer of a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    path = public_tokenizers.path(ENCODE_FILE)
    return bpe.digests(bpe.round_trip(docs, path, public_tokenizers.PATTERN))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("byte_bpe", encode)]

#: The classifier, the fingerprints and the encoder aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
