"""Inputs: the test tables, and the delivery state that derives from ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import partition_of
from tideline.operators.enqueue import State
from tideline.schemas import DELIVERED, IN_FLIGHT, PENDING, RETAINED

NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def deliveries(spark: SparkSession, sf_dir: str, partitions: int = 256) -> DataFrame:
    """A state that the delivery machine can reach, one subscriber a user: see FIXTURES B.3.  One exchange, by user."""
    by_user = Window.partitionBy("user_id")
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", "props")
    e = e.withColumn("sequence", F.row_number().over(by_user.orderBy("ts", "event_id")).cast("bigint")).withColumn("n", F.count("*").over(by_user))
    suspended, head, seq, user = F.col("suspended"), F.col("head"), F.col("sequence"), F.col("user_id")
    e = e.withColumn("suspended", user % 7 == 0).withColumn("head", 1 + (user * 13) % F.col("n"))
    at_head = seq == head
    status = F.when(seq < head, DELIVERED).when(suspended & at_head, "dead_lettered").when(suspended, RETAINED).when(at_head & (user % 3 == 0), IN_FLIGHT).otherwise(PENDING)
    subscriber = F.concat(F.lit("sub-"), user)
    e = e.withColumn("subscriber_id", subscriber).withColumn("status", status).withColumn("partition", partition_of(F.col("subscriber_id"), partitions))
    flying = F.col("status") == IN_FLIGHT
    attempt = F.when((seq <= head) & ~(at_head & ~suspended & (user % 3 != 0) & (user % 5 != 0)), 1).otherwise(0)
    later = at_head & ~suspended & (user % 3 != 0) & (user % 5 == 0)
    return e.select(
        F.concat(F.lit("dlg-"), "event_id").alias("id"),
        F.concat(F.lit("evt-"), "event_id").alias("event_id"),
        "subscriber_id",
        F.concat(F.lit("https://example.test/hook/"), user).alias("url"),
        "partition",
        "sequence",
        F.col("props").alias("payload"),
        "event_type",
        "status",
        attempt.alias("attempt"),
        F.when(later, F.expr("TIMESTAMP_NTZ '2024-02-01 01:00:00'")).otherwise(F.col("ts")).alias("next_attempt_at"),
        F.lit("").alias("last_error"),
        F.when(flying, F.concat(F.lit("worker-"), F.col("partition") % 4)).alias("owner"),
        F.when(flying, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("generation"),
        F.when(flying, F.col("ts")).alias("claimed_at"),
        F.col("ts").alias("created_at"),
    )


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = events(spark, sf_dir).select("user_id").distinct()
    return users.select(F.concat(F.lit("sub-"), "user_id").alias("subscriber_id"), (F.col("user_id") % 7 == 0).alias("suspended"), F.lit(False).alias("gap"), F.lit(0).alias("dropped"), F.lit("").alias("marker"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("next_seq")).select(F.concat(F.lit("sub-"), "user_id").alias("subscriber_id"), "next_seq")


def owners(spark: SparkSession, partitions: int = 256) -> DataFrame:
    """go0 and go1 in turn; every 37th partition drains towards the other."""
    p = F.col("id")
    drains = p % 37 == 0
    return spark.range(partitions).select(p.cast("int").alias("partition"), F.concat(F.lit("go"), p % 2).alias("owner_node"), F.lit(1).cast("bigint").alias("generation"), F.when(drains, "draining").otherwise("active").alias("state"), F.when(drains, F.concat(F.lit("go"), (p + 1) % 2)).alias("next_owner"))


def state(spark: SparkSession, sf_dir: str) -> State:
    return State(deliveries(spark, sf_dir), subscribers(spark, sf_dir), counters(spark, sf_dir), owners(spark))


def receipts(spark: SparkSession, sf_dir: str, disturbed: bool = False) -> DataFrame:
    """(sub, seq, arrived): delivered rows; disturbed arrivals are those of an unordered policy."""
    d = deliveries(spark, sf_dir).where(F.col("status") == DELIVERED)
    number = F.substring_index("event_id", "-", -1).cast("bigint")
    arrived = F.col("created_at") + F.make_dt_interval(hours=(number % 17).cast("int")) if disturbed else F.col("created_at")
    return d.select(F.col("subscriber_id").alias("sub"), F.col("sequence").alias("seq"), arrived.alias("arrived"))
