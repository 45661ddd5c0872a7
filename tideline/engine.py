"""The delivery loop: claim, attempt, route, mark, over durable snapshots.

One driver runs it; each round's state is written and read back, so plans don't grow
and a driver that starts again goes on from the last whole state.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import claim, enqueue, ownership, retention, transitions
from tideline.sources.sinks import Sink, attempt, attempt_log, delivered_log, prepare
from tideline.sources.snapshot import MemoryStore, Snapshots, register_views

ORDERED, NAIVE, FIFO = "ordered", "naive", "fifo"
TOGGLES = frozenset({"suspend_gate", "draining_gate", "in_flight_reset", "mark_stamp"})


@dataclass(frozen=True)
class Config:
    """Values that aren't positive fall back to the defaults; stale_age_s below 0 turns recovery off."""

    policy: str = ORDERED
    workers: int = 1
    partitions: int = scalars.PARTITIONS
    max_attempts: int = 8
    base_ms: int = scalars.BASE_MS
    max_ms: int = scalars.MAX_MS
    jitter: bool = True
    retention_count: int = retention.MAX_COUNT
    retention_age_s: int = retention.MAX_AGE_S
    stale_age_s: int = 0
    batch: int = claim.BATCH
    node: str = ""
    distributed: bool = False
    hol: bool = True  # off only to show that the gate matters
    #: Gates that are off, for tests that show what each is for: see TOGGLES.
    off: frozenset[str] = frozenset()

    def __post_init__(self):
        if self.policy not in (ORDERED, NAIVE, FIFO):
            raise ValueError(f"unknown policy {self.policy!r}")
        if self.distributed != bool(self.node):
            raise ValueError("a node name is needed for distributed ownership, and only there")
        if self.off - TOGGLES:
            raise ValueError(f"unknown gates {sorted(self.off - TOGGLES)}")
        if "/" in self.node:
            raise ValueError("a node name has no slash")
        for name, default in (("workers", 32 if self.policy == NAIVE else 1), ("partitions", scalars.PARTITIONS), ("max_attempts", 8), ("base_ms", scalars.BASE_MS), ("max_ms", scalars.MAX_MS), ("retention_count", retention.MAX_COUNT), ("retention_age_s", retention.MAX_AGE_S), ("batch", claim.BATCH)):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, default)


@dataclass
class Engine:
    spark: SparkSession
    store: Snapshots | MemoryStore
    sink: Sink
    config: Config = field(default_factory=Config)
    on_suspend: Callable[[str], None] | None = None
    on_rejected: Callable[[Row], None] | None = None
    clock: Callable[[], float] = time.time

    def __post_init__(self):
        self.started = self.closed = False
        self.generation, self.run = 1, scalars.incarnation()
        self.calls: list[int] = []
        self.idle_s = 0.0

    def now(self):
        return F.lit(datetime.fromtimestamp(self.clock(), UTC)).cast("timestamp")

    def start(self) -> None:
        """Recovers claims that went stale."""
        if self.closed or self.started:
            raise RuntimeError("closed, or started already")
        state = self.store.read(live=True)
        if self.config.stale_age_s >= 0:
            stale = state.deliveries.where(transitions.is_stale(self.now(), self.config.stale_age_s or transitions.STALE_AGE_S))
            if touched := self._partitions(stale):
                self.store.write(replace(state, deliveries=transitions.recover_stale(state.deliveries, self.now(), self.config.stale_age_s)), touched)
        self.started = True

    @staticmethod
    def _partitions(rows: DataFrame) -> list[int]:
        """At most as many as the configuration has."""
        return sorted(r.partition for r in rows.select("partition").distinct().collect())

    def dispatch(self, event_id: str, event_type: str, payload: str, subscribers: list[dict]) -> None:
        """Enqueues one event to these subscribers ({"id", "url", "secret"?}); nothing is sent here."""
        self._ready()
        if not event_id or not subscribers:
            raise ValueError("an event id and a subscriber are required")
        rows = [(n, event_id, event_type, bytearray((payload or "null").encode()), s.get("id") or "", s.get("url") or "", bytearray(s.get("secret") or b"")) for n, s in enumerate(subscribers)]
        self.enqueue(self.spark.createDataFrame(rows, "ord int, event_id string, event_type string, payload binary, subscriber_id string, url string, secret binary"))

    def enqueue(self, rows: DataFrame, order: tuple[str, ...] = ("ord",), batch: int | None = None) -> None:
        """rows (event_id, event_type, payload, subscriber_id, url, secret, and the columns of ``order``): a batch of dispatches.

        A subscriber's sequences follow ``order`` over the whole batch.  batch: its number in a
        stream; one that is in the state already is left out, as a stream may bring it again.
        """
        self._ready()
        if batch is not None and batch <= self.store.batch():
            return
        who = rows.select("subscriber_id").distinct()  # hashed once a subscriber
        who = who.withColumn("partition", scalars.partition_of(F.col("subscriber_id"), self.config.partitions))
        # Ids hold the run and the version they enter the state with, so no older one can be the same.
        ident = F.concat(F.lit(f"{self.run}-{self.store.version()}-"), F.sha2(F.concat_ws("\0", "event_id", "subscriber_id", *(F.col(c).cast("string") for c in order)), 256).substr(1, 32))
        rows = rows.join(who, "subscriber_id", "left").withColumn("id", ident).persist()
        state = self.store.read(live=True)
        if self.config.distributed:
            rows = ownership.local_subscribers(rows, state.partition_owners, self.config.node)
        after = enqueue.enqueue(state, rows, self.now(), [F.col(c) for c in order], self.config.retention_age_s, self.config.retention_count, fresh_ids=True)
        self.store.write(after, self._partitions(rows), batch)
        rows.unpersist()

    def _ready(self) -> None:
        if not self.started or self.closed:
            raise RuntimeError("not started, or closed")

    def _claim(self, state: enqueue.State) -> DataFrame:
        c, now, worker = self.config, self.now(), "worker-0"
        suspended = None if "suspend_gate" in c.off else state.subscribers
        if c.policy == NAIVE:
            return claim.claim_naive(state.deliveries, worker, self.generation, now, c.batch)
        if c.policy == FIFO:
            return claim.claim_fifo(state.deliveries, worker, self.generation, now)
        if c.distributed or ownership.is_distributed(state.partition_owners):
            return claim.claim_distributed(state.deliveries, state.partition_owners, c.node, f"{c.node}/{self.run}/{worker}", now, c.batch, suspended, drained_too="draining_gate" in c.off)
        return claim.claim_workers(state.deliveries, c.workers, self.generation, now, c.batch, suspended, c.hol)

    def step(self) -> int:
        """One round; the number of attempts.

        The claim is durable before anything is sent, and the results before anything is marked.
        """
        state = self.store.read(live=True)
        got = self._claim(state).persist()
        touched = self._partitions(got)
        if not touched:
            self.calls.append(0)
            return 0
        state = self.store.write(replace(state, deliveries=claim.apply_claim(state.deliveries.where(F.col("partition").isin(touched)), got)), touched)
        claimed = state.deliveries.join(got.select("id"), "id", "left_semi")
        results = self.store.keep_results(attempt(prepare(claimed, int(self.clock())), self.sink))
        n = results.count()
        self.calls.append(n)
        if n:
            self._mark(state, results, touched)
        got.unpersist()
        return n

    def _mark(self, state: enqueue.State, results: DataFrame, touched: list[int]) -> None:
        c, now = self.config, self.now()
        routed = transitions.route(results.withColumn("error", scalars.error_text(F.col("outcome"), F.col("code"), F.col("err"))), now, c.max_attempts, c.base_ms, c.max_ms, suspend=c.policy == ORDERED, jitter=c.jitter)
        routed = routed.select("id", "owner", "generation", "attempt", "next_attempt_at", "error", "command").persist()
        here = state.deliveries.where(F.col("partition").isin(touched))
        if self.on_rejected:
            for row in transitions.rejected(here, routed).toLocalIterator():
                self.on_rejected(row)
        after = replace(state, deliveries=transitions.mark(here, routed, "mark_stamp" not in c.off))
        exhausted = routed.where(F.col("command") == "exhaust_and_suspend")
        if not exhausted.isEmpty():
            hit = transitions.hit_subscribers(here, exhausted).persist()
            after = transitions.suspend(after, hit, now, c.retention_age_s, c.retention_count)
        written = self.store.write(after, touched)
        routed.unpersist()
        if self.on_suspend:  # only after the state is durable
            for row in transitions.newly_suspended(state.subscribers, written.subscribers).toLocalIterator():
                self.on_suspend(row.subscriber_id)

    def drain(self, rounds: int | None = None, wait: Callable[[float], None] = time.sleep, deadline_s: float | None = None) -> int:
        """Steps until nothing is pending or in flight; rows in backoff are waited for.  The number of attempts.

        Only ``rounds`` or ``deadline_s``, where given, end it earlier, by a TimeoutError.
        """
        total, began = 0, time.monotonic()
        for done in itertools.count():
            if (rounds is not None and done >= rounds) or (deadline_s is not None and time.monotonic() - began >= deadline_s):
                raise TimeoutError(f"not drained in {done} rounds")
            n = self.step()
            total += n
            if not n:
                if transitions.unfinished(self.store.read(live=True).deliveries).first().n == 0:
                    return total
                self.idle_s += self.config.base_ms / 1000
                wait(self.config.base_ms / 1000)

    def close(self, rounds: int | None = None, deadline_s: float | None = None) -> None:
        """New dispatches are refused; what is pending or in flight is drained."""
        self.closed = True
        if self.started:
            self.drain(rounds, deadline_s=deadline_s)

    def resume(self, subscriber: str) -> Row:
        """Wakes a suspended subscriber; its gap."""
        who = self.spark.createDataFrame([(subscriber,)], "subscriber_id string")
        state = self.store.read(live=True)
        after, gap = transitions.resume(state, who, self.now(), self.config.retention_age_s, self.config.retention_count)
        found = gap.first()
        if not state.subscribers.where(F.col("subscriber_id") == subscriber).isEmpty():
            self.store.write(after, self._partitions(state.deliveries.where(F.col("subscriber_id") == subscriber)))
        return found

    def resize(self, workers: int) -> None:
        if workers <= 0 or self.config.distributed:
            raise ValueError("workers must be positive, and ownership local")
        if workers != self.config.workers:
            self.config = replace(self.config, workers=workers)
            self.generation += 1

    def own(self, node: str) -> None:
        """All partitions to one node, where they have no owner yet."""
        state = self.store.read(live=True)
        self.store.write(replace(state, partition_owners=ownership.ensure_owners(self.spark, state.partition_owners, self.config.partitions, node)), [])

    def begin_handoff(self, partition: int, source: str, target: str) -> None:
        state = self.store.read(live=True)
        self.store.write(replace(state, partition_owners=ownership.begin_handoff(state.partition_owners, partition, source, target)), [])

    def complete_handoff(self, partition: int) -> None:
        state = self.store.read(live=True)
        self.store.write(replace(state, partition_owners=ownership.complete_handoff(state.partition_owners, state.deliveries, partition)), [])

    def handoff(self, partition: int, source: str, target: str, rounds: int = 500) -> None:
        """Drains a partition and gives it to another node."""
        self.begin_handoff(partition, source, target)
        for _ in range(rounds):
            if not self.in_flight(partition):
                break
            time.sleep(0.02)
        self.complete_handoff(partition)

    def in_flight(self, partition: int) -> int:
        row = ownership.in_flight_by_partition(self.store.read(live=True).deliveries.where(F.col("partition") == partition)).first()
        return row.n if row else 0

    def status(self) -> None:
        """Registers views of the current state: deliveries, subscribers, ownership, health."""
        register_views(self.store.read())

    def take_over(self, partition: int, target: str, expected: int) -> None:
        state = self.store.read(live=True)
        owners, deliveries = ownership.force_takeover(state.partition_owners, state.deliveries, partition, target, expected, "in_flight_reset" not in self.config.off)
        self.store.write(replace(state, partition_owners=owners, deliveries=deliveries), [partition])

    def log(self, results: DataFrame) -> DataFrame:
        return delivered_log(results)

    def last_calls(self) -> DataFrame | None:
        """The calls to the sink of the last step that made any, failed ones too, in the order of its claim."""
        results = self.store.results()
        return None if results is None else attempt_log(results)
