"""Claims: gated, ordered dequeues.

The head of line of a subscriber is its least unfinished sequence, over pending and
in-flight rows alone: those reach the window, pruned at the scan, and due time is
looked at after it.  A partition is a function of the subscriber, so the partition
filter goes below the window.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import OWNER_TOKEN
from tideline.schemas import ACTIVE, IN_FLIGHT, PENDING, UNFINISHED

BATCH = 64
#: Orders of a claim; each ends with the id, so that ties have one order.
BY_PARTITION, BY_SUBSCRIBER, BY_AGE = ("partition", "subscriber_id", "sequence", "id"), ("subscriber_id", "sequence", "id"), ("created_at", "sequence", "id")


def heads(deliveries: DataFrame) -> DataFrame:
    """(subscriber_id, head): the least unfinished sequence of each subscriber."""
    return deliveries.where(F.col("status").isin(*UNFINISHED)).groupBy("subscriber_id").agg(F.min("sequence").alias("head"))


def eligible(deliveries: DataFrame, now: Column, partitions: list[int] | None = None, suspended: DataFrame | None = None, hol: bool = True) -> DataFrame:
    """Pending rows that may be attempted now.

    partitions: None is all of them, an empty list none.  suspended: (subscriber_id, suspended); None skips that gate.
    """
    rows = deliveries.where(F.col("status").isin(*UNFINISHED))
    if partitions is not None:
        rows = rows.where(F.col("partition").isin(partitions)) if partitions else rows.limit(0)
    if hol:
        rows = rows.withColumn("__head", F.min("sequence").over(Window.partitionBy("subscriber_id"))).where("sequence = __head").drop("__head")
    rows = rows.where((F.col("status") == PENDING) & (F.coalesce("next_attempt_at", now) <= now))
    if suspended is not None:
        rows = rows.join(suspended.where("suspended").select("subscriber_id"), "subscriber_id", "left_anti")
    return rows.select(*deliveries.columns)


def eligible_antijoin(deliveries: DataFrame, now: Column) -> DataFrame:
    """The head-of-line gate as an anti-join on the subscriber's head, one row each; the same rows as the window's."""
    first = heads(deliveries).select(F.col("subscriber_id").alias("__s"), "head")
    due = deliveries.where((F.col("status") == PENDING) & (F.coalesce("next_attempt_at", now) <= now))
    return due.join(first, (F.col("subscriber_id") == F.col("__s")) & (F.col("head") < F.col("sequence")), "left_anti")


def take(rows: DataFrame, limit: int, order: tuple[str, ...] = BY_PARTITION) -> DataFrame:
    return rows.limit(0) if limit <= 0 else rows.orderBy(*order).limit(limit)


def stamp(rows: DataFrame, owner: str, generation: Column, now: Column) -> DataFrame:
    """In flight under this owner and generation, one attempt more."""
    return rows.withColumns({"status": F.lit(IN_FLIGHT), "owner": F.lit(owner), "generation": generation.cast("bigint"), "claimed_at": now, "attempt": F.col("attempt") + 1})


def check_stamp(owner: str, generation: int) -> None:
    if not owner:
        raise ValueError("an owner is required")
    if generation == 0:
        raise ValueError("generation 0 can't claim")


def claim(deliveries: DataFrame, owner: str, generation: int, now: Column, partitions: list[int] | None, limit: int = BATCH, suspended: DataFrame | None = None, hol: bool = True, order: tuple[str, ...] = BY_PARTITION) -> DataFrame:
    """The claimed rows, stamped."""
    check_stamp(owner, generation)
    return stamp(take(eligible(deliveries, now, partitions, suspended, hol), limit, order), owner, F.lit(generation), now)


def claim_naive(deliveries: DataFrame, owner: str, generation: int, now: Column, limit: int = BATCH) -> DataFrame:
    """No partitions and no head of line: oldest first."""
    check_stamp(owner, generation)
    return stamp(take(eligible(deliveries, now, hol=False), limit, BY_AGE), owner, F.lit(generation), now)


def claim_fifo(deliveries: DataFrame, owner: str, generation: int, now: Column) -> DataFrame:
    """One row: the oldest head of line."""
    check_stamp(owner, generation)
    return stamp(take(eligible(deliveries, now), 1, BY_AGE), owner, F.lit(generation), now)


def orphans(deliveries: DataFrame, owners: DataFrame) -> DataFrame:
    """Unfinished rows whose partition has no owner row."""
    return deliveries.where(F.col("status").isin(*UNFINISHED)).join(owners.select("partition"), "partition", "left_anti").select(*deliveries.columns)


ORPHAN = "an unfinished delivery has no partition owner"


def check_ownership(deliveries: DataFrame, owners: DataFrame) -> None:
    """Distributed claims fail closed: owner rows must exist, for every unfinished row."""
    if owners.isEmpty():
        raise ValueError("no partition has an owner")
    if not orphans(deliveries, owners).isEmpty():
        raise ValueError(ORPHAN)


def claim_distributed(deliveries: DataFrame, owners: DataFrame, node: str, token: str, now: Column, limit: int = BATCH, suspended: DataFrame | None = None, drained_too: bool = False, check: bool = True) -> DataFrame:
    """Rows of the partitions that the node owns and that are active; stamped with the owner row's generation.

    check: the plan itself raises where an unfinished row has no owner, in the one pass that claims.
    """
    if not (m := re.fullmatch(OWNER_TOKEN.strip("^$"), token)) or m.group(1) != node:
        raise ValueError("the owner token must be NODE/incarnation/worker-N of this node")
    if check and owners.isEmpty():
        raise ValueError("no partition has an owner")
    # At most a row a partition; Spark broadcasts it by size.
    known = owners.select("partition", F.col("generation").alias("__g"), ((F.col("owner_node") == node) & (F.lit(drained_too) | (F.col("state") == ACTIVE))).alias("__mine"))
    rows = deliveries.where(F.col("status").isin(*UNFINISHED)).join(known, "partition", "left" if check else "inner")
    if check:
        rows = rows.where(F.when(F.col("__g").isNull(), F.raise_error(F.lit(ORPHAN)).cast("boolean")).otherwise(F.col("__mine")))
    else:
        rows = rows.where("__mine")
    rows = eligible(rows, now, None, suspended)
    return stamp(take(rows, limit), token, F.col("__g"), now).select(*deliveries.columns)


def claim_workers(deliveries: DataFrame, workers: int, generation: int, now: Column, limit: int = BATCH, suspended: DataFrame | None = None, hol: bool = True) -> DataFrame:
    """One claim for each of ``workers`` workers, of up to ``limit`` rows of its own partitions: partition p is worker p % workers'."""
    check_stamp("worker", generation)
    if workers <= 1:
        return claim(deliveries, "worker-0", generation, now, None, limit, suspended, hol)
    rows = eligible(deliveries, now, None, suspended, hol).withColumn("__w", F.col("partition") % workers)
    if limit <= 0:
        return stamp(rows.limit(0), "worker-0", F.lit(generation), now).select(*deliveries.columns)
    nth = F.row_number().over(Window.partitionBy("__w").orderBy(*BY_PARTITION))
    rows = rows.withColumn("__n", nth).where(F.col("__n") <= limit)  # a limit by group: only that many rows of a group are kept while sorting
    return stamp(rows, "", F.lit(generation), now).withColumn("owner", F.concat(F.lit("worker-"), "__w")).select(*deliveries.columns)


def apply_claim(deliveries: DataFrame, claimed: DataFrame) -> DataFrame:
    """State after a claim: the claimed rows in place of what they were.  ``claimed`` must be materialised."""
    return deliveries.join(claimed.select("id"), "id", "left_anti").select(*deliveries.columns).unionByName(claimed.select(*deliveries.columns))
