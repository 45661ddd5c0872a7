"""Dispatch messages as a stream, in the order of their intake.

Order comes from an intake ordinal that travels with each message: a log's offset, or a
file's time, path and line.  Arrow batches and micro-batch tasks have no order of their own.

``serve`` joins a stream to the engine: each micro-batch is enqueued in intake order, the
one place where sequences are given, and then delivered; what backs off is drained after.
``sequence_stream`` gives sequences alone, from counters kept in state by subscriber
(transformWithState, RocksDB), for jobs without an engine: they go on over micro-batches
and restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.engine import Engine
from tideline.functions.scalars import PARTITIONS, decode_message, partition_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "subscriber_id string, event_id string, event_type string, payload string, url string, partition int, sequence bigint"
#: The intake ordinal of ``read_messages``; ``ord`` is the subscriber's place in the message.
INTAKE = ("intake_time", "intake_file", "intake_line")


class Sequencer(StatefulProcessor):
    def __init__(self, order: tuple[str, ...]):
        self.order = [*order, "ord"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next_seq", "next_seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # A subscriber's rows of one micro-batch are sorted together; the source's limits
        # (maxFilesPerTrigger, maxOffsetsPerTrigger) bound them.
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last = self.next.get()[0] if self.next.exists() else 0
        batch["sequence"] = range(last + 1, last + 1 + len(batch))
        self.next.update((last + len(batch),))
        yield batch[["subscriber_id", "event_id", "event_type", "payload", "url", "partition", "sequence"]]

    def close(self) -> None:
        pass


def read_messages(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of message files, one message a line: value, and INTAKE.  Files that come at one time go by path."""
    files = spark.readStream.options(**options).text(path, wholetext=True)
    meta = F.col("_metadata.file_modification_time").alias("intake_time"), F.col("_metadata.file_path").alias("intake_file")
    lines = files.select("value", *meta)
    return lines.select(*INTAKE[:2], F.posexplode(F.split("value", "\n")).alias("intake_line", "value"))


def parse_messages(raw: DataFrame, partitions: int = PARTITIONS, order: tuple[str, ...] = INTAKE) -> DataFrame:
    """A stream of dispatch messages (value string, and the columns of ``order``) -> a row per subscriber.  Messages that don't parse give no row."""
    m = raw.select(decode_message(F.col("value").cast("string")).alias("m"), *order).where("m.event.id IS NOT NULL")
    rows = m.select(F.col("m.event.id").alias("event_id"), F.col("m.event.type").alias("event_type"), F.col("m.event.data").alias("payload"), *order, F.posexplode("m.subscribers").alias("ord", "s"))
    return rows.select("event_id", "event_type", "payload", *order, F.col("ord").cast("bigint").alias("ord"), F.col("s.id").alias("subscriber_id"), F.col("s.url").alias("url"), partition_of(F.col("s.id"), partitions).alias("partition"))


def sequence_stream(rows: DataFrame, order: tuple[str, ...] = INTAKE) -> DataFrame:
    """rows of ``parse_messages`` with their sequences."""
    return rows.groupBy("subscriber_id").transformWithStateInPandas(statefulProcessor=Sequencer(order), outputStructType=OUT, outputMode="Append", timeMode="None")


def run_stream(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Writes micro-batches through ``each``; a batch may come again after a failure, under the same number."""
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def enqueue_batch(engine: Engine, batch: DataFrame, number: int, order: tuple[str, ...] = INTAKE) -> None:
    """A micro-batch of ``parse_messages`` into the engine's state, once however often it comes."""
    rows = batch.drop("partition").withColumns({"payload": F.encode("payload", "UTF-8"), "secret": F.lit(b"")})
    if not rows.isEmpty():
        engine.enqueue(rows, (*order, "ord"), number)


def serve(engine: Engine, messages: DataFrame, checkpoint: str, order: tuple[str, ...] = INTAKE, **trigger) -> int:
    """Enqueues and delivers a stream; the number of attempts.  Ends with the stream, when nothing is pending or in flight.

    messages: ``parse_messages`` of a stream.  Each micro-batch's deliveries are attempted
    until none is due, so a later batch finds the earlier ones of its subscribers tried.
    """
    attempts = 0

    def each(batch: DataFrame, number: int) -> None:
        nonlocal attempts
        enqueue_batch(engine, batch, number, order)
        while n := engine.step():
            attempts += n

    run_stream(messages, each, checkpoint, **trigger).awaitTermination()
    return attempts + engine.drain()
