"""One workload through three policies, as a model in closed form: who receives what, when.

Subscribers ``sub-0`` .. each get sequences 1 .. n, all dispatched at time 0.  An attempt
takes the subscriber's delay; where the receiver has a fault (``fault``) the first attempt
fails at once and the next one comes after the base backoff.

* ordered: a subscriber's deliveries follow each other, subscribers don't wait for others;
* fifo: one delivery at a time, the oldest first;
* naive: ``workers`` at a time, in waves, oldest first; a failed one arrives after its backoff.

So ordered and fifo receive in order, and naive doesn't.  The running sums of ordered are
by subscriber; those of fifo are global by its nature and run over the sequences first (one
row each) and then within each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import key_hash, latency_ms
from tideline.operators import metrics

POLICIES = ("ordered", "fifo", "naive")


def fault() -> Column:
    """Whether the receiver fails the first attempt of (sub, seq)."""
    return key_hash(F.concat("sub", F.lit(":"), "seq")) % 17 == 0


def workload(spark: SparkSession, subscribers: int = 64, events: int = 40, every: int = 4, fast_ms: int = 1, slow_ms: int = 25) -> DataFrame:
    """(sub, n, seq, delay_ms): every ``every``-th subscriber is slow."""
    rows = spark.range(subscribers).select(F.col("id").alias("n"), F.concat(F.lit("sub-"), "id").alias("sub")).withColumn("delay_ms", latency_ms(F.col("sub"), every, fast_ms, slow_ms).cast("bigint"))
    return rows.select("sub", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(events).cast("bigint"))).alias("seq"), "delay_ms")


def receipts(work: DataFrame, workers: int = 16, backoff_ms: int = 2) -> DataFrame:
    """(policy, sub, seq, attempts, arrived): milliseconds from the dispatch."""
    rows = work.withColumn("failed", fault()).withColumn("attempts", F.when(F.col("failed"), 2).otherwise(1)).withColumn("cost", F.col("delay_ms") + F.when(F.col("failed"), backoff_ms).otherwise(0))
    by_sub = Window.partitionBy("sub").orderBy("seq")
    ordered = rows.withColumn("arrived", F.sum("cost").over(by_sub))
    by_seq = rows.groupBy("seq").agg(F.sum("cost").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("seq")) - F.col("all"))
    fifo = rows.join(F.broadcast(by_seq), "seq").withColumn("arrived", F.col("before") + F.sum("cost").over(Window.partitionBy("seq").orderBy("n")))
    count = work.select("sub").distinct().agg(F.count("*").alias("subs"))
    wave = F.floor(((F.col("seq") - 1) * F.col("subs") + F.col("n")) / workers)
    naive = rows.join(F.broadcast(count)).withColumn("arrived", wave * F.lit(1) + F.col("cost"))
    out = None
    for policy, df in zip(POLICIES, (ordered, fifo, naive), strict=True):
        part = df.select(F.lit(policy).alias("policy"), "sub", "seq", "attempts", F.col("arrived").cast("bigint").alias("arrived"))
        out = part if out is None else out.unionByName(part)
    return out


def report(got: DataFrame) -> DataFrame:
    """By policy: receipts, inversions, deliveries per second, their share of naive's in percent, and p50 and p99 of arrival."""
    before = F.lag("seq").over(Window.partitionBy("policy", "sub").orderBy("arrived", "seq"))
    steps = got.withColumn("back", F.coalesce(F.col("seq") < before, F.lit(False)))
    sums = steps.groupBy("policy").agg(F.count("*").alias("receipts"), F.count_if("back").alias("inversions"), F.max("arrived").alias("ms"))
    rates = sums.withColumn("per_second", F.round(F.col("receipts") * 1000 / F.col("ms"), 3))
    shares = metrics.share_of_baseline(rates, "naive").select("policy", "percent")
    ranks = metrics.nearest_rank(got, "arrived", (50, 99), ("policy",))
    return rates.drop("ms").join(shares, "policy").join(ranks, "policy")


def check_complete(got: DataFrame, work: DataFrame) -> None:
    """Every policy must receive each delivery exactly once."""
    want = work.count()
    if bad := got.groupBy("policy").agg(F.count("*").alias("n"), F.countDistinct("sub", "seq").alias("d")).where((F.col("n") != want) | (F.col("d") != want)).first():
        raise ValueError(f"{bad.policy} has {bad.n} receipts of {bad.d} deliveries; {want} were sent")
