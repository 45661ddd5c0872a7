"""Maps from partitions to workers and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalars import logical_node


def check_claim(claim: list[int], partitions: int) -> None:
    if any(p < 0 or p >= partitions for p in claim):
        raise ValueError(f"partitions must lie in 0..{partitions - 1}")
    if len(set(claim)) != len(claim):
        raise ValueError("a partition is claimed twice")


def build_ownership(spark: SparkSession, workers: int, partitions: int, overlap: bool = False, claim: list[int] | None = None) -> DataFrame:
    """(partition, worker): the i-th claimed partition goes to worker i % workers; overlap gives all to all."""
    if claim is None:
        universe = spark.range(partitions).select(F.col("id").cast("int").alias("partition"), F.col("id").alias("i"))
    else:
        check_claim(claim, partitions)
        universe = spark.range(1).select(F.posexplode(F.array(*map(F.lit, claim)) if claim else F.array().cast("array<int>")).alias("i", "partition"))
    if overlap:
        return universe.select("partition", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))).alias("worker"))
    return universe.select("partition", (F.col("i") % workers).cast("int").alias("worker"))


def partitions_for_node(spark: SparkSession, partitions: int, nodes: int, index: int) -> DataFrame:
    """Partitions p with p % nodes = index; none for invalid arguments."""
    valid = partitions > 0 and nodes > 0 and 0 <= index < nodes
    return spark.range(partitions if valid else 0).where(F.col("id") % max(1, nodes) == index).select(F.col("id").cast("int").alias("partition"))


def owner_assignments(spark: SparkSession, partitions: int, nodes: int) -> DataFrame:
    """(partition, owner_node) over logical nodes go0, go1, ..."""
    return spark.range(max(0, partitions) if nodes > 0 else 0).select(F.col("id").cast("int").alias("partition"), logical_node(F.col("id") % max(1, nodes)).alias("owner_node"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(partition, worker_from, worker_to) of partitions whose worker changes when workers are resized."""
    both = before.withColumnRenamed("worker", "worker_from").join(after.withColumnRenamed("worker", "worker_to"), "partition")
    return both.where("worker_from <> worker_to")


def resize(spark: SparkSession, state: tuple[int, int], workers: int, partitions: int, overlap: bool = False, claim: list[int] | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """state (workers, generation) -> new map and state.  The same count is no change; else the generation goes up."""
    if workers <= 0:
        raise ValueError("workers must be positive")
    if overlap or claim is not None:
        raise ValueError("an overlapping or narrowed claim can't be resized")
    if workers == state[0]:
        return build_ownership(spark, workers, partitions), state
    return build_ownership(spark, workers, partitions), (workers, state[1] + 1)


def uncovered(slices: list[DataFrame], whole: DataFrame) -> DataFrame:
    """(partition, times) of partitions that the slices don't hold exactly once."""
    every = whole.select("partition", F.lit(0).alias("n"))
    for s in slices:
        every = every.unionByName(s.select("partition", F.lit(1).alias("n")))
    return every.groupBy("partition").agg(F.sum("n").alias("times")).where("times <> 1")
