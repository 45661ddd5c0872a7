"""Fan-out, dense sequences, and enqueueing as a function from state to state."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import PARTITIONS, partition_of
from tideline.operators import retention
from tideline.schemas import PENDING, RETAINED

#: Rows of subscribers up to which fan-out broadcasts them; beyond it Spark chooses.
FANOUT_BROADCAST = 10_000


@dataclass(frozen=True)
class State:
    deliveries: DataFrame
    subscribers: DataFrame
    subscriber_seq: DataFrame
    partition_owners: DataFrame | None = None


def fan_out(events: DataFrame, subscribers: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Each event to each subscriber.  The partition is hashed once per subscriber, before the product."""
    dimension = subscribers.withColumn("partition", partition_of(F.col("subscriber_id"), partitions))
    small = len(dimension.select("subscriber_id").head(FANOUT_BROADCAST + 1)) <= FANOUT_BROADCAST
    return events.crossJoin(F.broadcast(dimension) if small else dimension)


def explode_subscribers(messages: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """messages (event_id, event_type, payload, subscribers array<struct<id, url>>) -> a row per subscriber, in order."""
    rows = messages.select("*", F.posexplode("subscribers").alias("sub_ord", "s")).drop("subscribers")
    return rows.select("*", F.col("s.id").alias("subscriber_id"), F.col("s.url").alias("url"), partition_of(F.col("s.id"), partitions).alias("partition")).drop("s")


def invalid_rows(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows that can't be enqueued, with their reason.  A payload, where there is one, is JSON text or its bytes."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(empty("event_id"), "event id required").when(empty("subscriber_id"), "subscriber id required").when(empty("url"), "subscriber url required").when(empty("id"), "delivery id required")
    if "payload" in rows.columns:
        text = F.col("payload").cast("string")
        reason = reason.when(text.isNotNull() & F.try_parse_json(text).isNull(), "payload isn't JSON")
    again = F.count("*").over(Window.partitionBy("id")) > 1
    bad = rows.withColumn("reason", F.coalesce(reason, F.when(again, "duplicate delivery id"))).where("reason IS NOT NULL")
    if existing is not None:
        known = rows.join(existing.select("id"), "id", "left_semi").withColumn("reason", F.lit("duplicate delivery id"))
        bad = bad.unionByName(known).dropDuplicates(["id", "reason"])
    return bad


def with_sequences(rows: DataFrame, counters: DataFrame | None, order: list[Column]) -> DataFrame:
    """sequence: the subscriber's counter plus 1, 2, ... in the order given."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("subscriber_id").orderBy(*order)).cast("bigint"))
    if counters is None:
        return ranked.withColumnRenamed("__n", "sequence")
    last = counters.select(F.col("subscriber_id").alias("__s"), F.col("next_seq").alias("__last"))
    joined = ranked.join(last, F.col("subscriber_id") == F.col("__s"), "left")
    return joined.withColumn("sequence", F.col("__n") + F.coalesce("__last", F.lit(0).cast("bigint"))).drop("__n", "__s", "__last")


def advance(counters: DataFrame, sequenced: DataFrame) -> DataFrame:
    """Counters after these rows; sequences never restart."""
    new = sequenced.groupBy("subscriber_id").agg(F.max("sequence").alias("next_seq"))
    return counters.select("subscriber_id", "next_seq").unionByName(new).groupBy("subscriber_id").agg(F.max("next_seq").alias("next_seq"))


def enqueue(state: State, rows: DataFrame, now: Column, order: list[Column], max_age_s: int = retention.MAX_AGE_S, max_count: int = retention.MAX_COUNT, fresh_ids: bool = False) -> State:
    """rows (id, event_id, event_type, payload, subscriber_id, url, secret, partition) -> new state; all rows or none.

    Rows of suspended subscribers are retained, and retention is applied to them.
    fresh_ids: the ids can't be in the state, so they are only compared with each other.
    """
    bad = invalid_rows(rows, None if fresh_ids else state.deliveries)
    if first := bad.first():
        raise ValueError(f"nothing enqueued: {first.reason} (delivery {first.id!r})")
    sequenced = with_sequences(rows, state.subscriber_seq, order)
    asleep = state.subscribers.where("suspended").select(F.col("subscriber_id").alias("__s"))
    new = sequenced.join(asleep, F.col("subscriber_id") == F.col("__s"), "left")
    new = new.withColumn("status", F.when(F.col("__s").isNull(), PENDING).otherwise(RETAINED)).drop("__s")
    nothing = {"attempt": F.lit(0), "next_attempt_at": now, "created_at": now, "last_error": F.lit(""), "owner": F.lit(None).cast("string"), "generation": F.lit(0).cast("bigint"), "claimed_at": F.lit(None).cast("timestamp")}
    new = new.withColumns(nothing).select(*state.deliveries.columns)
    counters = advance(state.subscriber_seq, sequenced)
    # Only suspended subscribers retain anything.
    touched = state.subscribers.where("suspended").join(rows.select("subscriber_id").distinct(), "subscriber_id", "left_semi").select("subscriber_id")
    deliveries, subscribers = retention.apply(state.deliveries.unionByName(new), state.subscribers, now, max_age_s, max_count, only=touched)
    return replace(state, deliveries=deliveries, subscribers=subscribers, subscriber_seq=counters)
