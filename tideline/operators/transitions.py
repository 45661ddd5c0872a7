"""State transitions of claimed rows, as functions from state and commands to state.

A command names a delivery and the stamp (owner, generation) it was claimed under; it
takes effect only on an in-flight row with that stamp.  Others come back rejected.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import backoff_ms
from tideline.operators import retention
from tideline.operators.enqueue import State
from tideline.schemas import DEAD, DELIVERED, IN_FLIGHT, PENDING, PERMANENT, RETAINED, SUCCESS, UNFINISHED

UNKNOWN, NOT_IN_FLIGHT, STALE = "unknown", "not_in_flight", "stale_stamp"
STALE_AGE_S = 60


def judge(deliveries: DataFrame, commands: DataFrame, check_stamp: bool = True) -> DataFrame:
    """commands with ``rejected``: null if the command takes effect."""
    known = deliveries.select(F.col("id").alias("__id"), F.col("status").alias("__status"), F.col("owner").alias("__owner"), F.col("generation").alias("__generation"))
    same = (F.col("owner") == F.col("__owner")) & (F.col("generation") == F.col("__generation")) & (F.col("generation") != 0)
    reason = F.when(F.col("__id").isNull(), UNKNOWN).when(F.col("__status") != IN_FLIGHT, NOT_IN_FLIGHT)
    if check_stamp:
        reason = reason.when(~F.coalesce(same, F.lit(False)), STALE)
    return commands.join(known, F.col("id") == F.col("__id"), "left").withColumn("rejected", reason).drop("__id", "__status", "__owner", "__generation")


def rejected(deliveries: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands without effect and why; they aren't retried."""
    return judge(deliveries, commands).where("rejected IS NOT NULL")


def _cleared(new: dict[str, Column]) -> dict[str, Column]:
    return new | {"owner": None, "generation": F.lit(0), "claimed_at": None}


def _mark(deliveries: DataFrame, commands: DataFrame, new: dict[str, Column], check_stamp: bool = True) -> DataFrame:
    """One join on the id; ``new`` may use the command's columns, as c_<name>."""
    good = judge(deliveries, commands, check_stamp).where("rejected IS NULL").drop("rejected")
    good = good.select(*(F.col(c).alias(f"c_{c}") for c in good.columns)).withColumn("c_hit", F.lit(True))
    joined = deliveries.join(good, F.col("id") == F.col("c_id"), "left")
    kinds = dict(deliveries.dtypes)
    values = {c: (F.lit(None) if v is None else v).cast(kinds[c]) for c, v in _cleared(new).items() if c in kinds}
    return joined.select(*(F.when(F.col("c_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in deliveries.columns))


def mark_delivered(deliveries: DataFrame, commands: DataFrame) -> DataFrame:
    return _mark(deliveries, commands, {"status": F.lit(DELIVERED), "last_error": F.lit("")})


def mark_dead_letter(deliveries: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: id, owner, generation, error.  The subscriber isn't suspended."""
    return _mark(deliveries, commands, {"status": F.lit(DEAD), "last_error": F.col("c_error")})


def mark_failed(deliveries: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: id, owner, generation, attempt, next_attempt_at, error."""
    return _mark(deliveries, commands, {"status": F.lit(PENDING), "attempt": F.col("c_attempt"), "next_attempt_at": F.col("c_next_attempt_at"), "last_error": F.col("c_error")})


def mark(deliveries: DataFrame, commands: DataFrame, check_stamp: bool = True) -> DataFrame:
    """Commands of all kinds in one join: id, owner, generation, ``command`` (as ``route`` names it), attempt, next_attempt_at, error."""
    kind, failed = F.col("c_command"), F.col("c_command") == "mark_failed"
    status = F.when(kind == "mark_delivered", DELIVERED).when(failed, PENDING).otherwise(DEAD)
    return _mark(deliveries, commands, {"status": status, "attempt": F.when(failed, F.col("c_attempt")).otherwise(F.col("attempt")), "next_attempt_at": F.when(failed, F.col("c_next_attempt_at")).otherwise(F.col("next_attempt_at")), "last_error": F.when(kind == "mark_delivered", "").otherwise(F.col("c_error"))}, check_stamp)


def hit_subscribers(deliveries: DataFrame, commands: DataFrame) -> DataFrame:
    """(subscriber_id) of the commands that take effect.  At most a row a command: materialise it before it is used several times."""
    good = judge(deliveries, commands).where("rejected IS NULL").select("id")
    return deliveries.join(good, "id", "left_semi").select("subscriber_id").distinct()


def suspend(state: State, hit: DataFrame, now: Column, max_age_s: int = retention.MAX_AGE_S, max_count: int = retention.MAX_COUNT) -> State:
    """These subscribers (subscriber_id) suspended, their pending rows retained, and retention applied.  Other subscribers' rows stay where they are."""
    asleep = hit.select(F.col("subscriber_id").alias("__s"))
    held = state.deliveries.join(hit, "subscriber_id", "left_semi").withColumn("status", F.when(F.col("status") == PENDING, RETAINED).otherwise(F.col("status")))
    others = state.deliveries.join(hit, "subscriber_id", "left_anti").select(*state.deliveries.columns)
    who = state.subscribers.join(asleep, F.col("subscriber_id") == F.col("__s"), "full_outer")
    subscribers = who.select(F.coalesce("subscriber_id", "__s").alias("subscriber_id"), (F.coalesce("suspended", F.lit(False)) | F.col("__s").isNotNull()).alias("suspended"), F.coalesce("gap", F.lit(False)).alias("gap"), F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("marker", F.lit("")).alias("marker"))
    kept, subscribers = retention.apply(held.select(*state.deliveries.columns), subscribers, now, max_age_s, max_count)
    return replace(state, deliveries=others.unionByName(kept), subscribers=subscribers)


def exhaust_and_suspend(state: State, commands: DataFrame, now: Column, max_age_s: int = retention.MAX_AGE_S, max_count: int = retention.MAX_COUNT) -> State:
    """Dead letters, their subscribers suspended, their pending rows retained, and retention applied.

    One join finds the subscribers that are hit, which are kept; one pass marks and suspends.
    """
    hit = hit_subscribers(state.deliveries, commands).persist()
    return suspend(replace(state, deliveries=mark_dead_letter(state.deliveries, commands)), hit, now, max_age_s, max_count)


def newly_suspended(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.where("suspended").select("subscriber_id").join(before.where("suspended").select("subscriber_id"), "subscriber_id", "left_anti")


def resume(state: State, who: DataFrame, now: Column, max_age_s: int = retention.MAX_AGE_S, max_count: int = retention.MAX_COUNT) -> tuple[State, DataFrame]:
    """who (subscriber_id) -> new state and (subscriber_id, gap, dropped, marker).

    Retention runs first, then the gap is read and cleared and retained rows become
    pending at now, attempts as they were.  An unknown subscriber has no gap and no row is written.
    """
    who = who.select("subscriber_id").distinct()
    deliveries, subscribers = retention.apply(state.deliveries, state.subscribers, now, max_age_s, max_count, only=who)
    known = subscribers.join(state.subscribers.select("subscriber_id"), "subscriber_id", "left_semi")
    gap = who.join(known, "subscriber_id", "left").select("subscriber_id", F.coalesce("gap", F.lit(False)).alias("gap"), F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("marker", F.lit("")).alias("marker"))
    back = who.select(F.col("subscriber_id").alias("__s"))
    rows = deliveries.join(back, F.col("subscriber_id") == F.col("__s"), "left")
    awake = F.col("__s").isNotNull() & (F.col("status") == RETAINED)
    kind = dict(deliveries.dtypes)["next_attempt_at"]
    rows = rows.withColumn("next_attempt_at", F.when(awake, now.cast(kind)).otherwise(F.col("next_attempt_at"))).withColumn("status", F.when(awake, PENDING).otherwise(F.col("status")))
    meta = known.join(back, F.col("subscriber_id") == F.col("__s"), "left")
    clear = F.col("__s").isNotNull()
    meta = meta.select("subscriber_id", (F.col("suspended") & ~clear).alias("suspended"), (F.col("gap") & ~clear).alias("gap"), F.when(clear, 0).otherwise(F.col("dropped")).alias("dropped"), F.when(clear, "").otherwise(F.col("marker")).alias("marker"))
    return replace(state, deliveries=rows.select(*deliveries.columns), subscribers=meta), gap


def is_stale(now: Column, age_s: int) -> Column:
    return (F.col("status") == IN_FLIGHT) & F.col("claimed_at").isNotNull() & (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(age_s)))


def recover_stale(deliveries: DataFrame, now: Column, age_s: int = 0) -> DataFrame:
    """In-flight rows claimed too long ago are pending again, attempts as they were.  Age 0: the default; negative: never."""
    if age_s < 0:
        return deliveries
    return reset(deliveries, is_stale(now, age_s or STALE_AGE_S))


def reset(deliveries: DataFrame, which: Column) -> DataFrame:
    """Back to pending, stamp cleared."""
    kinds, hit = dict(deliveries.dtypes), F.coalesce(which, F.lit(False))
    new = {"status": F.lit(PENDING), "owner": F.lit(None), "generation": F.lit(0), "claimed_at": F.lit(None)}
    return deliveries.select(*(F.when(hit, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in deliveries.columns))


def backdate_claim(deliveries: DataFrame, delivery: str, at: Column) -> DataFrame:
    """For tests: as if it had been claimed at another time."""
    return deliveries.withColumn("claimed_at", F.when(F.col("id") == delivery, at).otherwise(F.col("claimed_at")))


def route(results: DataFrame, now: Column, max_attempts: int = 8, base_ms: int = 1_000, max_ms: int = 900_000, suspend: bool = True, jitter: bool = False) -> DataFrame:
    """results (outcome, attempt, ...) with ``command`` and the retry's next_attempt_at.

    suspend=False is the rule of the unordered and global policies: dead letters only.
    """
    last = "exhaust_and_suspend" if suspend else "mark_dead_letter"
    command = F.when(F.col("outcome") == SUCCESS, "mark_delivered").when((F.col("outcome") == PERMANENT) | (F.col("attempt") >= max_attempts), last).otherwise("mark_failed")
    later = now + F.make_dt_interval(secs=backoff_ms(F.col("attempt"), base_ms, max_ms, jitter) / 1000.0)
    return results.withColumn("command", command).withColumn("next_attempt_at", F.when(F.col("command") == "mark_failed", later))


def is_suspended(subscribers: DataFrame, who: DataFrame) -> DataFrame:
    """(subscriber_id, suspended); unknown ones aren't."""
    return who.select("subscriber_id").join(subscribers.select("subscriber_id", "suspended"), "subscriber_id", "left").select("subscriber_id", F.coalesce("suspended", F.lit(False)).alias("suspended"))


def unfinished(deliveries: DataFrame) -> DataFrame:
    return deliveries.where(F.col("status").isin(*UNFINISHED)).agg(F.count("*").alias("n"))


def retained_count(deliveries: DataFrame) -> DataFrame:
    return deliveries.where(F.col("status") == RETAINED).groupBy("subscriber_id").agg(F.count("*").alias("n"))
