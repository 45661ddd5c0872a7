"""Bounded retention of suspended subscribers' rows: by age first, then by count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import gap_marker
from tideline.schemas import RETAINED

MAX_COUNT, MAX_AGE_S = 1_000, 86_400


def drops(deliveries: DataFrame, now: Column, max_age_s: int = MAX_AGE_S, max_count: int = MAX_COUNT, only: DataFrame | None = None) -> DataFrame:
    """(id, subscriber_id, sequence, reason) of the retained rows that go.

    A row goes by age if it was created before now less the age; of the others the
    newest ``max_count`` sequences of a subscriber stay.  Bounds that aren't positive don't apply.
    """
    rows = deliveries.where(F.col("status") == RETAINED)
    if only is not None:
        rows = rows.join(only.select("subscriber_id").distinct(), "subscriber_id", "left_semi")
    aged = F.col("created_at") < now - F.make_dt_interval(secs=F.lit(max_age_s)) if max_age_s > 0 else F.lit(False)
    rows = rows.select("id", "subscriber_id", "sequence", aged.alias("aged"))
    rank = F.row_number().over(Window.partitionBy("subscriber_id").orderBy("aged", F.desc("sequence")))
    over = rank > max_count if max_count > 0 else F.lit(False)
    reason = F.when(F.col("aged"), "age").when(over, "count")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "subscriber_id", "sequence", "reason")


def judged(rows: DataFrame, now: Column, max_age_s: int = MAX_AGE_S, max_count: int = MAX_COUNT) -> DataFrame:
    """``rows``, whole subscribers, with the ``reason`` of those that go: ``drops`` in the one pass that also keeps the rest."""
    kept = F.col("status") == RETAINED
    aged = F.coalesce(kept & (F.col("created_at") < now - F.make_dt_interval(secs=F.lit(max_age_s))), F.lit(False)) if max_age_s > 0 else F.lit(False)
    rows = rows.withColumn("__kept", F.coalesce(kept, F.lit(False))).withColumn("__aged", aged)
    rank = F.row_number().over(Window.partitionBy("subscriber_id", "__kept").orderBy("__aged", F.desc("sequence")))
    over = F.col("__kept") & (rank > max_count) if max_count > 0 else F.lit(False)
    return rows.withColumn("reason", F.when(F.col("__aged"), "age").when(over, "count")).drop("__kept", "__aged")


def gaps(dropped: DataFrame) -> DataFrame:
    """(subscriber_id, n, sequence, reason): how many went, and the last one; age drops come before count drops."""
    last = F.max(F.struct((F.col("reason") == "count").alias("late"), "sequence"))
    out = dropped.groupBy("subscriber_id").agg(F.count("*").alias("n"), last.alias("last"))
    return out.select("subscriber_id", "n", F.col("last.sequence").alias("sequence"), F.when(F.col("last.late"), "count").otherwise("age").alias("reason"))


def apply(deliveries: DataFrame, subscribers: DataFrame, now: Column, max_age_s: int = MAX_AGE_S, max_count: int = MAX_COUNT, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Deliveries without the rows that go, and subscribers with gap, running total and marker.

    only (subscriber_id): rows of other subscribers are neither sorted nor shuffled.
    """
    touched, others = deliveries, None
    if only is not None:
        touched, others = deliveries.join(only, "subscriber_id", "left_semi"), deliveries.join(only, "subscriber_id", "left_anti").select(*deliveries.columns)
    rows = judged(touched, now, max_age_s, max_count)
    stay, gone = rows.where("reason IS NULL").select(*deliveries.columns), rows.where("reason IS NOT NULL")
    found = gaps(gone).select(F.col("subscriber_id").alias("__s"), "n", "sequence", "reason")
    joined = subscribers.join(found, F.col("subscriber_id") == F.col("__s"), "full_outer")
    who = F.coalesce("subscriber_id", "__s")
    total = F.coalesce("dropped", F.lit(0)) + F.coalesce(F.col("n").cast("int"), F.lit(0))
    marker = F.when(F.col("n").isNotNull(), gap_marker(who, total, F.col("sequence"), F.col("reason"))).otherwise(F.coalesce("marker", F.lit("")))
    after = joined.select(who.alias("subscriber_id"), F.coalesce("suspended", F.lit(False)).alias("suspended"), (F.coalesce("gap", F.lit(False)) | F.col("n").isNotNull()).alias("gap"), total.alias("dropped"), marker.alias("marker"))
    return stay if others is None else others.unionByName(stay), after
