"""The whole job: long keys, and every row of the inputs."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tideline.engine import Config, Engine
from tideline.functions import scalars as S
from tideline.plans import catalogue


def hash_31(key: str) -> int:
    """31 * h + byte in 64 bits that wrap; the least number has no negative."""
    h = 0
    for b in key.encode():
        h = (h * 31 + b) % 2**64
    h -= 2**64 if h >= 2**63 else 0
    return h if h == -(2**63) else abs(h)


def test_key_hash_wraps(spark):
    keys = ["", "a", "sub-7:1", "sub-1499:12345", "sub-1234567890:123456789", "é" * 20, "\u007f" * 13, "z" * 300] + [f"sub-{n * 7919}:{n**4}" for n in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(S.key_hash(F.col("k"))).collect()] == [hash_31(k) for k in keys]


def test_every_delivery_has_its_key_hash(spark, sf):
    rows = catalogue.queries()["hash_key_31"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/events.parquet").count() == len({r.k for r in rows})
    assert all(r["hash"] == hash_31(r.k) for r in rows)


def test_every_event_goes_to_its_nodes(spark, sf):
    rows = catalogue.queries()["fanout_by_node"](spark, sf).collect()
    ids = {f"evt-{r.event_id}" for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()}
    nations = spark.read.parquet(f"{sf}/nation.parquet").count()
    assert {r.event_id for r in rows} == ids
    assert sum(len(r.subscribers.split(",")) for r in rows) == len(ids) * nations


def test_every_event_is_filtered_by_owner(spark, sf):
    rows = catalogue.queries()["dispatch_owner_filter"](spark, sf).collect()
    ids = {f"evt-{r.event_id}" for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()}
    local = {r.subscriber_id for r in rows}
    assert {r.event_id for r in rows} == ids
    assert len(rows) == len(set(rows)) == len(ids) * len(local)


def test_every_event_is_enqueued(spark, sf):
    rows = catalogue.queries()["enqueue_batch"](spark, sf).collect()
    assert sorted(r.id for r in rows) == sorted(f"new-{r.event_id}" for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect())


def test_every_suspended_subscriber_resumes(spark, sf):
    q = catalogue.queries()
    asleep = {r.subscriber_id for r in q["is_suspended"](spark, sf).where("suspended").collect()}
    assert {r.subscriber_id for r in q["resume_gap"](spark, sf).collect()} == asleep | {"sub-unknown"}
    assert q["resume_replay"](spark, sf).where("status = 'retained'").isEmpty()


def test_every_delivered_row_rejects_its_command(spark, sf):
    got = {r.id for r in catalogue.queries()["mark_rejected"](spark, sf).where("rejected = 'not_in_flight'").collect()}
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    by_status = {r.id: r.status for r in catalogue.queries()["mark_delivered"](spark, sf).collect()}
    # A right stamp also ends as delivered: it was in flight and isn't rejected.
    assert len(by_status) == n and got <= {i for i, s in by_status.items() if s == "delivered"}
    assert len(got) == catalogue.queries()["inversions_ordered"](spark, sf).first().receipts


def test_drain_has_no_round_cap(spark):
    steps = iter([1] * 1500 + [0])
    state = SimpleNamespace(deliveries=spark.createDataFrame([], "status string"))
    e = SimpleNamespace(step=lambda: next(steps), store=SimpleNamespace(read=lambda live=False: state), config=Config(), idle_s=0.0)
    assert Engine.drain(e, wait=lambda s: None) == 1500


def test_drain_ends_at_its_deadline(spark):
    state = SimpleNamespace(deliveries=spark.createDataFrame([("pending",)], "status string"))
    e = SimpleNamespace(step=lambda: 0, store=SimpleNamespace(read=lambda live=False: state), config=Config(), idle_s=0.0)
    for limit in ({"rounds": 2}, {"deadline_s": 0.0}):
        with pytest.raises(TimeoutError):
            Engine.drain(e, wait=lambda s: None, **limit)
