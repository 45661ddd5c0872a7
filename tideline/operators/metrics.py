"""Order, latency and load figures of delivered work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import is_slow


def inversions(receipts: DataFrame, strict: bool = True) -> DataFrame:
    """receipts (sub, seq, arrived): steps back in each subscriber's order of arrival.

    strict counts seq < previous; else seq <= previous, so that repeats count too.
    """
    before = F.lag("seq").over(Window.partitionBy("sub").orderBy("arrived", "seq"))
    back = F.col("seq") < F.col("before") if strict else F.col("seq") <= F.col("before")
    return receipts.withColumn("before", before).agg(F.count_if(F.coalesce(back, F.lit(False))).alias("inversions"), F.count("*").alias("receipts"))


def latencies(receipts: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Milliseconds from the dispatch of seq to its arrival, never negative."""
    joined = receipts.join(dispatched.select("seq", "dispatched_at"), "seq")
    ms = (F.unix_micros(F.col("arrived").cast("timestamp")) - F.unix_micros(F.col("dispatched_at").cast("timestamp"))) / 1000.0
    return joined.select("sub", "seq", F.greatest(ms, F.lit(0.0)).alias("ms"))


#: Distinct values that one task sorts to find a rank; splits of a range that holds more.
SORTED, SPLITS = 100_000, 64


def nearest_rank(values: DataFrame, value: str, percents: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """sorted[n * p // 100], the last for p that would lie beyond; 0 if there are none.

    Values are counted first, so what is sorted is distinct values, with running totals:
    no list of all values is gathered.  Without ``by``, ranges that hold a wanted rank are
    narrowed by grouped counts until few values are left; only these are sorted.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    zero = F.lit(0).cast(dict(values.dtypes)[value])
    if not by:
        found = _ranks(counted.persist(), value, percents)
        return values.sparkSession.range(1).select(*((zero if v is None else F.lit(v).cast(dict(values.dtypes)[value])).alias(f"p{p}") for p, v in found.items()))
    order = Window.partitionBy(*by).orderBy(value)
    ranked = counted.withColumn("upto", F.sum("k").over(order)).withColumn("n", F.sum("k").over(Window.partitionBy(*by)))
    at = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    picks = [F.min(F.when(F.col("upto") > at(p), F.col(value))) for p in percents]
    return ranked.groupBy(*by).agg(*(F.coalesce(x, zero).alias(f"p{p}") for x, p in zip(picks, percents, strict=True)))


def _ranks(counted: DataFrame, value: str, percents: tuple[int, ...]) -> dict[int, object]:
    """The value at each percent's rank in counted (value, k); None if there is none."""
    total, distinct = counted.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count("*")).first()
    out = {}
    for p in percents:
        rows, n, rank = counted, distinct, min(total * p // 100, total - 1)
        while n > SORTED:
            cuts = rows.agg(F.percentile_approx(value, [x / SPLITS for x in range(1, SPLITS)], 1000)).first()[0]
            part = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col(value)))
            sizes = sorted(rows.groupBy(part.alias("part")).agg(F.sum("k").alias("k"), F.count("*").alias("n")).collect())  # SPLITS rows
            for s in sizes:
                if rank < s.k:
                    break
                rank -= s.k
            if s.n == n:
                break  # the values can't be told apart any further
            rows, n = rows.where(part == s.part), s.n
        if n:
            ranked = rows.withColumn("upto", F.sum("k").over(Window.orderBy(value)))
            out[p] = ranked.where(F.col("upto") > rank).agg(F.min(value)).first()[0]
        else:
            out[p] = None
    return out


def throughput(receipts: DataFrame, at: str = "arrived") -> DataFrame:
    us = F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))
    return receipts.agg(F.count("*").alias("n"), (us / 1e6).alias("seconds")).withColumn("per_second", F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).otherwise(0.0))


def worker_stats(attempts: DataFrame) -> DataFrame:
    """attempts (owner, idle_ms): deliveries and idle time of each owner."""
    return attempts.groupBy("owner").agg(F.count("*").alias("deliveries"), F.sum("idle_ms").alias("idle_ms"))


def balance(stats: DataFrame, value: str) -> DataFrame:
    """Least, most, mean, coefficient of variation over the population, and most by least (0 if least is 0)."""
    x = F.col(value).cast("double")
    out = stats.agg(F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("dev"))
    return out.select("least", "most", "mean", F.when(F.col("mean") != 0, F.col("dev") / F.col("mean")).otherwise(0.0).alias("cv"), F.when(F.col("least") != 0, F.col("most") / F.col("least")).otherwise(0.0).alias("ratio"))


def claim_stats(calls: DataFrame) -> DataFrame:
    """calls (rows): calls, rows, calls that got rows, rows per such call."""
    out = calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("rows") > 0).alias("non_empty"))
    return out.withColumn("rows_per_claim", F.when(F.col("non_empty") > 0, F.col("rows") / F.col("non_empty")).otherwise(0.0))


def slow_subscribers(subscribers: DataFrame, every: int) -> DataFrame:
    return subscribers.agg(F.count_if(is_slow(F.col("subscriber_id"), every)).alias("slow"), F.count("*").alias("subscribers"))


def share_of_baseline(rates: DataFrame, baseline: str) -> DataFrame:
    """rates (policy, per_second) with the percentage of the baseline policy's rate; 0 without one."""
    base = rates.where(F.col("policy") == baseline).agg(F.max("per_second").alias("base"))
    return rates.crossJoin(base).select("policy", "per_second", F.when(F.col("base") > 0, F.round(F.col("per_second") * 100 / F.col("base"), 1)).otherwise(0.0).alias("percent"))


def spread(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("partition").alias("partitions"), F.countDistinct("subscriber_id").alias("subscribers"))


def sequences(receipts: DataFrame) -> DataFrame:
    """(sub, seqs) in order of arrival; a subscriber's list is gathered, so for reports of bounded runs."""
    rows = receipts.groupBy("sub").agg(F.sort_array(F.collect_list(F.struct("arrived", "seq"))).alias("x"))
    return rows.select("sub", F.col("x.seq").alias("seqs"))


def first_match(rows: DataFrame, condition: Column, order: str) -> DataFrame:
    return rows.where(condition).orderBy(order).limit(1)
