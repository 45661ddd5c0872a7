"""Partition ownership: a table of at most a few hundred rows, changed by compare-and-set.

Each change returns the new table, or raises if its condition doesn't hold; the one
driver that writes the table gives the changes their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.transitions import reset
from tideline.schemas import ACTIVE, DRAINING, IN_FLIGHT, OWNER


class Conflict(ValueError):
    """The row isn't as the change expects it."""


def _node(name: str) -> None:
    if not name or "/" in name:
        raise ValueError(f"bad node name {name!r}")


def ensure_owners(spark: SparkSession, owners: DataFrame | None, partitions: int, node: str) -> DataFrame:
    wanted = spark.range(partitions).select(F.col("id").cast("int").alias("partition"), F.lit(node).alias("owner_node"))
    return ensure_assignments(owners, wanted)


def ensure_assignments(owners: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """Missing partitions get their owner at generation 1, active; another owner than wanted is a conflict. All or nothing."""
    spark = wanted.sparkSession
    owners = spark.createDataFrame([], OWNER) if owners is None else owners
    if not wanted.where("owner_node IS NULL OR owner_node = '' OR owner_node LIKE '%/%'").isEmpty():
        raise ValueError("a node name is empty or has a slash")
    joined = owners.join(wanted.select(F.col("partition").alias("__p"), F.col("owner_node").alias("__node")), F.col("partition") == F.col("__p"), "full_outer")
    if row := joined.where("owner_node <> __node").first():
        raise Conflict(f"partition {row.partition} belongs to {row.owner_node}, not {row['__node']}")
    return joined.select(F.coalesce("partition", "__p").alias("partition"), F.coalesce("owner_node", "__node").alias("owner_node"), F.coalesce("generation", F.lit(1).cast("bigint")).alias("generation"), F.coalesce("state", F.lit(ACTIVE)).alias("state"), "next_owner")


def owner_row(owners: DataFrame, partition: int):
    return owners.where(F.col("partition") == partition).first()


def delivery_status(deliveries: DataFrame, delivery: str) -> str | None:
    row = deliveries.where(F.col("id") == delivery).select("status").first()
    return row.status if row else None


def in_flight_stamp(deliveries: DataFrame, partition: int):
    """(id, owner, generation) of the partition's in-flight row of least sequence."""
    return deliveries.where((F.col("partition") == partition) & (F.col("status") == IN_FLIGHT)).orderBy("sequence", "id").select("id", "owner", "generation").first()


def is_distributed(owners: DataFrame | None) -> bool:
    """Any owner row turns distributed claims on."""
    return owners is not None and not owners.isEmpty()


def in_flight_by_partition(deliveries: DataFrame) -> DataFrame:
    return deliveries.where(F.col("status") == IN_FLIGHT).groupBy("partition").agg(F.count("*").alias("n"))


def distribution(owners: DataFrame) -> DataFrame:
    return owners.groupBy("owner_node").agg(F.count("*").alias("n")).orderBy("owner_node")


def begin_rows(owners: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (partition, source, target): owners with ``changed``; active rows of the source start draining, generation as it was."""
    joined = owners.join(moves.select(F.col("partition").alias("__p"), "source", "target"), F.col("partition") == F.col("__p"), "left")
    ok = F.coalesce((F.col("owner_node") == F.col("source")) & (F.col("state") == ACTIVE) & (F.col("source") != F.col("target")), F.lit(False))
    return joined.select("partition", "owner_node", "generation", F.when(ok, DRAINING).otherwise(F.col("state")).alias("state"), F.when(ok, F.col("target")).otherwise(F.col("next_owner")).alias("next_owner"), ok.alias("changed"))


def begin_handoff(owners: DataFrame, partition: int, source: str, target: str) -> DataFrame:
    _node(source)
    _node(target)
    if source == target:
        raise ValueError("a handoff needs two nodes")
    after = begin_rows(owners, owners.sparkSession.createDataFrame([(partition, source, target)], "partition int, source string, target string"))
    if after.where("changed").isEmpty():
        raise Conflict(f"partition {partition} isn't active on {source}")
    return after.drop("changed")


def complete_rows(owners: DataFrame, deliveries: DataFrame, partitions: DataFrame) -> DataFrame:
    """owners with ``changed``: draining rows without in-flight deliveries go to their next owner, generation one up."""
    busy = in_flight_by_partition(deliveries).select(F.col("partition").alias("__b"))
    joined = owners.join(partitions.select(F.col("partition").alias("__p")), F.col("partition") == F.col("__p"), "left").join(busy, F.col("partition") == F.col("__b"), "left")
    ok = F.col("__p").isNotNull() & F.col("__b").isNull() & (F.col("state") == DRAINING)
    return joined.select("partition", F.when(ok, F.col("next_owner")).otherwise(F.col("owner_node")).alias("owner_node"), F.when(ok, F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"), F.when(ok, ACTIVE).otherwise(F.col("state")).alias("state"), F.when(~ok, F.col("next_owner")).alias("next_owner"), ok.alias("changed"))


def complete_handoff(owners: DataFrame, deliveries: DataFrame, partition: int) -> DataFrame:
    after = complete_rows(owners, deliveries, owners.where(F.col("partition") == partition).select("partition"))
    if after.where("changed").isEmpty():
        raise Conflict(f"partition {partition} isn't draining, or has deliveries in flight")
    return after.drop("changed")


ABORT, NOTHING, STEAL, REFUSE = "abort_drain", "no_op", "steal", "conflict"


def takeover_decision(owners: DataFrame, wishes: DataFrame) -> DataFrame:
    """wishes (partition, target, expected) with the decision of a forced takeover."""
    joined = wishes.join(owners, "partition", "left")
    mine, at = F.col("owner_node") == F.col("target"), F.col("generation") == F.col("expected")
    decision = F.when(mine & (F.col("state") == DRAINING) & at, ABORT).when(mine & (F.col("state") == ACTIVE) & F.col("generation").isin(F.col("expected"), F.col("expected") + 1), NOTHING).when(~mine & at, STEAL)
    return joined.withColumn("decision", F.coalesce(decision, F.lit(REFUSE)))


def force_takeover(owners: DataFrame, deliveries: DataFrame, partition: int, target: str, expected: int, reset_in_flight: bool = True) -> tuple[DataFrame, DataFrame]:
    """Owners and deliveries after the takeover; a stolen partition's in-flight rows are pending again."""
    _node(target)
    if expected == 0:
        raise ValueError("generation 0 can't be expected")
    wish = owners.sparkSession.createDataFrame([(partition, target, expected)], "partition int, target string, expected bigint")
    decision = takeover_decision(owners, wish).first().decision
    if decision == REFUSE:
        raise Conflict(f"partition {partition} isn't at generation {expected}")
    here = F.col("partition") == partition
    if decision == ABORT:
        return owners.withColumns({"state": F.when(here, ACTIVE).otherwise(F.col("state")), "next_owner": F.when(~here, F.col("next_owner"))}), deliveries
    if decision == STEAL:
        new = owners.withColumns({"owner_node": F.when(here, target).otherwise(F.col("owner_node")), "generation": F.when(here, F.col("generation") + 1).otherwise(F.col("generation")), "state": F.when(here, ACTIVE).otherwise(F.col("state")), "next_owner": F.when(~here, F.col("next_owner"))})
        return new, reset(deliveries, here & (F.col("status") == IN_FLIGHT)) if reset_in_flight else deliveries
    return owners, deliveries


def take_over_rows(owners: DataFrame, deliveries: DataFrame, wishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forced takeovers of many partitions (partition, target, expected; one wish each): owners with their ``decision``, and deliveries.

    In-flight rows of the partitions that are stolen are pending again; refused wishes change nothing.
    """
    decided = takeover_decision(owners, wishes).select(F.col("partition").alias("__p"), F.col("target").alias("__target"), "decision")
    joined = owners.join(decided, F.col("partition") == F.col("__p"), "left")
    steal, freed = F.coalesce(F.col("decision") == STEAL, F.lit(False)), F.coalesce(F.col("decision").isin(STEAL, ABORT), F.lit(False))
    after = joined.select("partition", F.when(steal, F.col("__target")).otherwise(F.col("owner_node")).alias("owner_node"), F.when(steal, F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"), F.when(freed, ACTIVE).otherwise(F.col("state")).alias("state"), F.when(~freed, F.col("next_owner")).alias("next_owner"), "decision")
    stolen = decided.where(F.col("decision") == STEAL).select(F.col("__p").alias("partition"), F.lit(True).alias("__stolen"))
    rows = deliveries.join(F.broadcast(stolen), "partition", "left")  # a row a partition at most
    return after, reset(rows, F.col("__stolen") & (F.col("status") == IN_FLIGHT)).select(*deliveries.columns)


def owner_of(owners: DataFrame, partition: int) -> str | None:
    row = owner_row(owners, partition)
    return row.owner_node if row else None


def partitions_of(owners: DataFrame, node: str) -> DataFrame:
    """(partition) that a node owns, draining ones too."""
    return owners.where(F.col("owner_node") == node).select("partition")


def heads_in_flight(deliveries: DataFrame) -> DataFrame:
    """(partition, id, owner, generation): ``in_flight_stamp`` of every partition, by one grouped minimum."""
    first = F.min(F.struct("sequence", "id", "owner", "generation")).alias("x")
    return deliveries.where(F.col("status") == IN_FLIGHT).groupBy("partition").agg(first).select("partition", "x.id", "x.owner", "x.generation")


def send_to_nodes(messages: DataFrame, owners: DataFrame, send) -> dict[str, bool]:
    """Hands each node its rows (``send(node, rows)``) and awaits its answer: (node -> acknowledged).

    The nodes are those of the owner table, a few; a node that fails keeps none of the others back.
    """
    routed = messages.join(F.broadcast(owners.select("partition", "owner_node")), "partition")
    acks = {}
    for (node,) in owners.select("owner_node").distinct().orderBy("owner_node").collect():
        try:
            send(node, routed.where(F.col("owner_node") == node).drop("owner_node"))
            acks[node] = True
        except Exception:
            acks[node] = False
    return acks


def local_subscribers(messages: DataFrame, owners: DataFrame, node: str) -> DataFrame:
    """Fanned-out rows whose partition this node owns; others are acknowledged without being enqueued."""
    mine = owners.where(F.col("owner_node") == node).select("partition")
    return messages.join(mine, "partition", "left_semi")


def by_node(messages: DataFrame, owners: DataFrame) -> DataFrame:
    """(event_id, owner_node, subscribers) of the rows to send to each node."""
    joined = messages.join(owners.select("partition", "owner_node"), "partition")
    return joined.groupBy("event_id", "owner_node").agg(F.sort_array(F.collect_list("subscriber_id")).alias("subscribers"))
