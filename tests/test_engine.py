"""Scenarios of the delivery loop.  Gates have twins: with the gate off, the invariant must break."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from tideline.engine import FIFO, NAIVE, Config, Engine
from tideline.operators import metrics
from tideline.sources.sinks import FaultSink, HoldingSink, HttpSink, TableSink, fault
from tideline.sources.snapshot import Snapshots


def ok(sub, seq, attempt):
    return 200, None


def gone(sub, seq, attempt):
    return 410, None


def down(sub, seq, attempt):
    return 500, None


def first_fails(odd, sub, seq, attempt):
    return (500, None) if attempt == 1 and seq % 2 == odd else (200, None)


def twice(sub, seq, attempt):
    return (503, None) if attempt < 3 else (200, None)


class Clock:
    def __init__(self):
        self.t = 1_700_000_000.0

    def __call__(self):
        return self.t


def engine(spark, tmp_path, answer, **config):
    clock = Clock()
    e = Engine(spark, Snapshots(spark, f"file://{tmp_path}/state"), TableSink(answer), Config(jitter=False, partitions=32, **config), clock=clock)
    e.start()
    return e, clock


def send(e, n, sub="sub-a", start=0):
    spark = e.spark
    rows = spark.range(start, start + n).select(F.col("id").cast("int").alias("ord"), F.format_string("evt-%04d", F.col("id")).alias("event_id"), F.lit("t").alias("event_type"), F.encode(F.format_string('{"n":%d}', F.col("id")), "UTF-8").alias("payload"), F.lit(sub).alias("subscriber_id"), F.lit("http://x").alias("url"), F.lit(b"").alias("secret"))
    e.enqueue(rows)


def statuses(e):
    return {(r.subscriber_id, r.sequence): r.status for r in e.store.read().deliveries.collect()}


def order_of(e, clock, rounds):
    """Sequences in the order of their successful attempts."""
    seen, done = [], set()
    for _ in range(rounds):
        n = e.step()
        now = {k for k, v in statuses(e).items() if v == "delivered"}
        seen += sorted(now - done)
        done = now
        clock.t += 10
        if not n and len(done) == len(statuses(e)):
            break
    return [s for _, s in seen]


def test_head_of_line_keeps_order_and_without_it_order_breaks(spark, tmp_path):
    e, clock = engine(spark, tmp_path / "on", partial(first_fails, 1))
    send(e, 3)
    assert order_of(e, clock, 12) == [1, 2, 3]
    e, clock = engine(spark, tmp_path / "off", partial(first_fails, 1), hol=False)
    send(e, 3)
    got = order_of(e, clock, 12)
    assert sorted(got) == [1, 2, 3] and got != [1, 2, 3]


def test_retry_until_success(spark, tmp_path):
    e, clock = engine(spark, tmp_path, twice, max_attempts=5)
    send(e, 1)
    for _ in range(3):
        assert e.step() == 1
        clock.t += 10
    row = e.store.read().deliveries.first()
    assert (row.status, row.attempt, row.last_error) == ("delivered", 3, "") and e.calls == [1, 1, 1]


def test_backoff_is_waited_for(spark, tmp_path):
    e, clock = engine(spark, tmp_path, twice, base_ms=5000)
    send(e, 1)
    assert [e.step(), e.step()] == [1, 0]
    clock.t += 5.1
    assert e.step() == 1


def test_exhaust_suspends_then_resume_replays_in_order(spark, tmp_path):
    woken = []
    e, clock = engine(spark, tmp_path, down, max_attempts=1, retention_count=3)
    e.on_suspend = woken.append
    send(e, 2)
    e.step()
    assert woken == ["sub-a"] and statuses(e) == {("sub-a", 1): "dead_lettered", ("sub-a", 2): "retained"}
    send(e, 4, start=2)
    assert e.step() == 0
    kept = sorted(k[1] for k, v in statuses(e).items() if v == "retained")
    assert kept == [4, 5, 6]
    gap = e.resume("sub-a")
    assert gap.gap and gap.dropped == 2 and gap.marker == "sub-a:dropped=2:through_seq=3:count"
    e.sink = TableSink(ok)
    assert order_of(e, clock, 6) == [4, 5, 6]
    assert not e.resume("nobody").gap and not e.resume("sub-a").gap


def test_permanent_suspends_and_baselines_only_dead_letter(spark, tmp_path):
    e, _ = engine(spark, tmp_path / "a", gone)
    send(e, 2)
    e.step()
    assert statuses(e)["sub-a", 2] == "retained"
    for policy in (NAIVE, FIFO):
        e, clock = engine(spark, tmp_path / policy, gone, policy=policy)
        send(e, 2)
        e.step()
        clock.t += 1
        e.step()
        assert set(statuses(e).values()) == {"dead_lettered"}


def test_stale_claims_are_recovered_only_if_allowed(spark, tmp_path):
    from dataclasses import replace

    from tideline.operators import claim

    for age, want in ((0, 1), (-1, 0)):
        e, clock = engine(spark, tmp_path / str(age), ok)
        send(e, 1)
        s = e.store.read()
        got = claim.claim(s.deliveries, "dead-worker", 1, e.now(), None).persist()
        e.store.write(replace(s, deliveries=claim.apply_claim(s.deliveries, got)))
        clock.t += 3600
        again = Engine(spark, e.store, TableSink(ok), Config(partitions=32, stale_age_s=age), clock=clock)
        again.start()
        assert again.step() == want


def test_close_drains_and_refuses(spark, tmp_path):
    e, _ = engine(spark, tmp_path, ok)
    e.dispatch("e1", "t", '{"a":1}', [{"id": "s1", "url": "u"}, {"id": "s2", "url": "u"}])
    e.close()
    assert set(statuses(e).values()) == {"delivered"}
    with pytest.raises(RuntimeError):
        e.dispatch("e2", "t", "{}", [{"id": "s1", "url": "u"}])


def test_a_bad_batch_enqueues_nothing(spark, tmp_path):
    e, _ = engine(spark, tmp_path, ok)
    with pytest.raises(ValueError, match="url required"):
        e.dispatch("e1", "t", "{}", [{"id": "s1", "url": "u"}, {"id": "s2", "url": ""}])
    assert statuses(e) == {}


def test_config():
    assert Config(workers=-1, batch=0).batch == 64 and Config(policy=NAIVE, workers=0).workers == 32
    for bad in ({"distributed": True}, {"node": "a"}, {"node": "a/b", "distributed": True}, {"policy": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_handoff_and_takeover(spark, tmp_path):
    from tideline.operators.ownership import Conflict, owner_row

    clock = Clock()
    e = Engine(spark, Snapshots(spark, f"file://{tmp_path}/s"), TableSink(ok), Config(partitions=4, node="A", distributed=True), clock=clock)
    e.start()
    e.own("A")
    e.dispatch("e1", "t", "{}", [{"id": "s1", "url": "u"}])
    p = e.store.read().deliveries.first().partition
    e.handoff(p, "A", "B")
    row = owner_row(e.store.read().partition_owners, p)
    assert (row.owner_node, row.generation, row.state, row.next_owner) == ("B", 2, "active", None)
    assert e.step() == 0  # no longer A's
    e.take_over(p, "A", 2)
    assert e.step() == 1
    with pytest.raises(Conflict):
        e.take_over(p, "B", 9)
    with pytest.raises(Conflict):
        e.own("B")


def test_sinks():
    assert HoldingSink("a")({"subscriber_id": "a"}) is None and HoldingSink("a")({"subscriber_id": "b"}) == (200, None)
    import http.server
    import threading

    seen = []

    class Receiver(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["X-Event-Id"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204 if self.path == "/ok" else 503)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    row = {"body": b"{}", "headers": {"X-Event-Id": "e"}}
    assert HttpSink(5)(row | {"url": base + "/ok"}) == (204, None) and HttpSink(5)(row | {"url": base + "/no"}) == (503, None)
    server.shutdown()
    server.server_close()
    assert HttpSink(1)(row | {"url": base})[0] is None and HttpSink(1)(row | {"url": "nonsense"})[0] == 400
    assert seen == [("e", b"{}")] * 2


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert list(metrics.nearest_rank(df, "v", (50, 99)).first()) == [3.0, 4.0]
    assert list(metrics.nearest_rank(df.limit(0), "v", (50, 99)).first()) == [0.0, 0.0]


def write_messages(folder, name, messages, stamp):
    """A file of dispatch messages (event id, subscribers), with its time."""
    import json
    import os

    path = folder / name
    path.write_text("\n".join([json.dumps({"event": {"id": i, "type": "t", "data": {"id": i}}, "subscribers": [{"id": s, "url": "u"} for s in subs]}) for i, subs in messages] + ["nonsense"]))
    os.utime(path, (stamp, stamp))


def test_stream_sequences_follow_intake(spark, tmp_path):
    """evt-10 comes after evt-2, and a subscriber's place in the list doesn't move it between events; counters go on over restarts."""
    from tideline.streaming import sequencer

    source, got = tmp_path / "in", []
    source.mkdir()

    def each(batch, _):
        got.extend((r.subscriber_id, r.sequence, r.event_id) for r in batch.collect())

    for part in range(2):
        for half in range(2):
            numbers = range(1 + 24 * part + 12 * half, 13 + 24 * part + 12 * half)
            write_messages(source, f"{9 - part}-{half}.txt", [(f"evt-{n}", ["b", "a"] if n % 5 == 1 else ["a", "b"]) for n in numbers], 1_700_000_000 + 10 * part + half)
        messages = sequencer.parse_messages(sequencer.read_messages(spark, str(source)))
        sequencer.run_stream(sequencer.sequence_stream(messages), each, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(got) == sorted((s, n, f"evt-{n}") for s in "ab" for n in range(1, 49))


def test_a_stream_is_delivered_in_order(spark, tmp_path):
    """Intake to delivery: retries on the way, order kept, and a batch that comes again changes nothing."""
    from tideline.streaming import sequencer

    source = tmp_path / "in"
    source.mkdir()
    write_messages(source, "z.txt", [(f"evt-{n}", ["b", "a"] if n % 2 else ["a", "b"]) for n in (1, 2, 10, 11)], 1_700_000_000)
    write_messages(source, "a.txt", [("evt-3", ["a"])], 1_700_000_009)
    e, clock = engine(spark, tmp_path, partial(first_fails, 0), max_attempts=4, workers=3)
    wait = lambda _: setattr(clock, "t", clock.t + 5)
    drain, e.drain = e.drain, lambda: drain(wait=wait)
    messages = sequencer.parse_messages(sequencer.read_messages(spark, str(source)))
    attempts = sequencer.serve(e, messages, str(tmp_path / "cp"))
    rows = e.store.read().deliveries.orderBy("subscriber_id", "sequence").collect()
    assert [(r.subscriber_id, r.event_id, r.sequence, r.status) for r in rows] == [("a", f"evt-{n}", k, "delivered") for k, n in enumerate((1, 2, 10, 11, 3), 1)] + [("b", f"evt-{n}", k, "delivered") for k, n in enumerate((1, 2, 10, 11), 1)]
    assert attempts == sum(r.attempt for r in rows) == 9 + 4 and {r.owner for r in rows} == {None}
    assert e.store.batch() == 0
    again = spark.createDataFrame([("evt-9", "t", "{}", "a", "u", 1)], "event_id string, event_type string, payload string, subscriber_id string, url string, ord int")
    sequencer.enqueue_batch(e, again, 0, ())
    assert e.store.read(live=True).deliveries.isEmpty()


def test_workers_claim_their_own_partitions(spark, tmp_path):
    e, _ = engine(spark, tmp_path, ok, workers=3, batch=2)
    for n in range(12):
        send(e, 1, f"sub-{n}")
    state = e.store.read()
    got = e._claim(state).collect()
    assert {(r.owner, r.partition % 3) for r in got} == {(f"worker-{w}", w) for w in {r.partition % 3 for r in state.deliveries.collect()}}
    assert max(sum(r.owner == f"worker-{w}" for r in got) for w in range(3)) <= 2
    e.resize(1)
    assert {(r.owner, r.generation) for r in e._claim(state).collect()} == {("worker-0", 2)}


def test_a_step_writes_only_what_it_touches(spark, tmp_path):
    e, _ = engine(spark, tmp_path, ok, batch=1)
    for n in range(6):
        send(e, 2, f"sub-{n}")
    before = e.store.manifest()["live"]
    e.step()
    after = e.store.manifest()
    moved = {b for b in before if after["live"].get(b) != before[b]}
    assert len(moved) == 1 and after["tables"] == {t: v for t, v in e.store.manifest(e.store.version() - 1)["tables"].items()}
    finished = [p for p in (tmp_path / "state").glob("v=*/rows/kind=finished/bucket=*")]
    e.step()
    assert len(finished) == 1 and all(p.exists() for p in finished)
    assert sorted(r.status for r in e.store.read().deliveries.collect()) == ["delivered"] * 2 + ["pending"] * 10
    assert len(list((tmp_path / "state").glob("results-*"))) == 1


def test_withheld_results_stay_in_flight(spark, tmp_path):
    e, clock = engine(spark, tmp_path, ok)
    e.sink = HoldingSink("sub-a")
    send(e, 2, "sub-a")
    send(e, 1, "sub-b")
    assert e.step() == 1 and statuses(e) == {("sub-a", 1): "in_flight", ("sub-a", 2): "pending", ("sub-b", 1): "delivered"}
    assert e.step() == 0
    clock.t += 3600
    again = Engine(spark, e.store, TableSink(ok), Config(partitions=32), clock=clock)
    again.start()
    assert (again.step(), again.step(), again.step()) == (1, 1, 0) and set(statuses(e).values()) == {"delivered"}


@pytest.mark.parametrize("policy", ["ordered", NAIVE, FIFO])
def test_replay_of_a_small_workload(spark, tmp_path, policy):
    """The receiver's faults are the same in every run; only the unordered policy lets them change the order."""
    e, clock = engine(spark, tmp_path, ok, policy=policy, base_ms=2000, max_ms=2000)
    e.sink = FaultSink()
    rows = spark.range(1, 7).crossJoin(spark.range(8).withColumnRenamed("id", "s")).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("e"), "id").alias("event_id"), F.lit("t").alias("event_type"), F.encode(F.format_string('{"seq":%d}', F.col("id")), "UTF-8").alias("payload"), F.concat(F.lit("sub-"), "s").alias("subscriber_id"), F.lit("u").alias("url"), F.lit(b"").alias("secret"))
    if policy == FIFO:
        rows = rows.where("s < 2 AND id < 4")  # one a step
    e.enqueue(rows)
    faults = sum(fault(r.subscriber_id, r.ord, 1) for r in rows.collect())
    got, seen = [], set()
    while e.store.read(live=True).deliveries.count():
        e.step()
        clock.t += 1
        done = e.store.read().deliveries.where("status = 'delivered'").collect()
        got += sorted(((clock.t, r.subscriber_id, r.sequence) for r in done if r.id not in seen))
        seen |= {r.id for r in done}
    back = sum(x[2] > y[2] for s in {g[1] for g in got} for x, y in zip(*(lambda q: (q, q[1:]))([g for g in got if g[1] == s])))
    assert len(got) == rows.count() == len(seen)
    assert (back > 0) == (policy == NAIVE and faults > 0) and (faults > 0 or policy == FIFO)


def test_faults_agree_with_the_expression(spark):
    from tideline.operators import replay

    rows = replay.workload(spark).withColumn("failed", replay.fault()).collect()
    assert len(rows) == 2560 and all(r.failed == fault(r["sub"], r.seq, 1) for r in rows) and not fault("sub-0", 1, 2)
    assert FaultSink()({"body": b"x"})[0] == FaultSink()({"body": b'{"data":{"seq":0}}'})[0] == 400
    got = replay.receipts(replay.workload(spark))
    with pytest.raises(ValueError):
        replay.check_complete(got.where("seq < 40 OR policy <> 'naive'"), replay.workload(spark))


def test_control_commands(spark, tmp_path):
    from tideline import control

    e = Engine(spark, Snapshots(spark, f"file://{tmp_path}/s"), TableSink(ok), Config(partitions=4, node="A", distributed=True), clock=Clock())
    e.start()
    e.own("A")
    assert control.run(e, "dispatch", {"id": b"e1", "data": '{"a":1}'}, {"id": "s1", "url": "u"}) == ("ok", 1)
    p = e.store.read().deliveries.first().partition
    assert control.run(e, "owner_of", str(p)) == ("ok", ["A", 1, "active", None]) and control.run(e, "owner_of", 99) == ("ok", None)
    assert control.run(e, "inflight_count", float(p)) == ("ok", 0)
    assert control.run(e, "begin_handoff", p, b"A", "B") == ("ok", None) and control.run(e, "complete_handoff", p)[0] == "ok"
    assert control.run(e, "owner_of", p) == ("ok", ["B", 2, "active", None])
    for bad in (("nothing",), ("owner_of", True), ("owner_of", 1.5), ("owner_of", "x"), ("begin_handoff", p, 5, "B"), ("complete_handoff", p), ("owner_of",), ("dispatch", {}, [])):
        assert control.run(e, *bad)[0] == "error"
    assert control.as_list(None) == [] and control.as_list((1, 2)) == [1, 2] and control.as_bytes("é") == "é".encode() and control.as_bytes(b"x") == b"x"
    e.status()
    assert spark.sql("SELECT n FROM health WHERE status = 'pending'").first().n == 1 and spark.table("ownership").count() == 4
    with pytest.raises(ValueError):
        s = e.store.read()
        e.store.write(type(s)(s.deliveries, s.subscribers, s.subscriber_seq, None), [])


def test_nodes_acknowledge_on_their_own(spark):
    from tideline.operators import ownership

    owners = spark.createDataFrame([(0, "A", 1, "active", None), (1, "B", 1, "active", None)], "partition int, owner_node string, generation bigint, state string, next_owner string")
    rows, got = spark.createDataFrame([("e", "s0", 0), ("e", "s1", 1), ("f", "s2", 0)], "event_id string, subscriber_id string, partition int"), {}

    def send(node, part):
        if node == "B":
            raise ConnectionError
        got[node] = sorted(r.subscriber_id for r in part.collect())

    assert ownership.send_to_nodes(rows, owners, send) == {"A": True, "B": False} and got == {"A": ["s0", "s2"]}


def test_a_claim_without_an_owner_row_fails(spark, sf):
    from tideline.operators import claim
    from tideline.sources import tables as T

    for owners in (T.owners(spark).where("partition < 200"), T.owners(spark).limit(0)):
        with pytest.raises(Exception, match="owner"):
            claim.claim_distributed(T.deliveries(spark, sf), owners, "go1", "go1/run/worker-2", T.now()).collect()


def test_files_without_later_columns_are_read(spark, tmp_path):
    e, _ = engine(spark, tmp_path, ok)
    send(e, 1)
    for f in (tmp_path / "state").glob("v=*/rows/kind=live/bucket=*"):
        spark.read.parquet(f"file://{f}").drop("secret", "last_error", "generation").write.parquet(f"file://{f}x")
        for old in f.iterdir():
            old.unlink()
        for new in f.with_name(f.name + "x").iterdir():
            new.rename(f / new.name)
        f.with_name(f.name + "x").rmdir()
    row = e.store.read().deliveries.first()
    assert (bytes(row.secret), row.last_error, row.generation) == (b"", "", 0) and e.step() == 1


def test_a_payload_must_be_json(spark, tmp_path):
    e, _ = engine(spark, tmp_path, ok)
    with pytest.raises(ValueError, match="JSON"):
        e.dispatch("e1", "t", "{not json", [{"id": "s1", "url": "u"}])
    e.dispatch("e1", "t", "", [{"id": "s1", "url": "u"}])
    assert statuses(e) == {("s1", 1): "pending"}


@pytest.mark.parametrize("limit", [5, 100_000])
def test_ranks_by_narrowing(spark, monkeypatch, limit):
    import random

    monkeypatch.setattr(metrics, "SORTED", limit)
    rng = random.Random(limit)
    for values in ([rng.random() for _ in range(700)], [float(rng.randint(0, 30)) for _ in range(500)] + [7.0] * 300, [3.0] * 50):
        got = metrics.nearest_rank(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", (0, 50, 99, 100)).first()
        assert list(got) == [sorted(values)[min(len(values) * p // 100, len(values) - 1)] for p in (0, 50, 99, 100)]


def test_a_store_in_memory_does_the_same(spark, tmp_path):
    from tideline.sources.snapshot import MemoryStore

    found = []
    for store in (Snapshots(spark, f"file://{tmp_path}/s"), MemoryStore(spark)):
        clock = Clock()
        e = Engine(spark, store, TableSink(partial(first_fails, 1)), Config(jitter=False, partitions=32, base_ms=1000, max_attempts=3), clock=clock)
        e.start()
        send(e, 3, "sub-a")
        send(e, 1, "sub-b")
        e.drain(wait=lambda _, c=clock: setattr(c, "t", c.t + 5))
        calls = e.last_calls().collect()
        found.append((sorted((r.subscriber_id, r.sequence, r.status, r.attempt) for r in store.read().deliveries.collect()), e.calls, [(r.subscriber_id, r.sequence, r.attempt, r.code) for r in calls], store.read(live=True).deliveries.count()))
    assert found[0] == found[1] and found[0][3] == 0 and found[0][2] == [("sub-a", 3, 2, 200)]


def test_gates_off_break_what_they_guard(spark, tmp_path):
    """Twins: with the gate the invariant holds, without it doesn't."""
    from dataclasses import replace

    from tideline.operators import claim
    from tideline.sources.snapshot import MemoryStore

    def made(off, **config):
        clock = Clock()
        e = Engine(spark, MemoryStore(spark), TableSink(ok), Config(jitter=False, partitions=4, off=frozenset(off), **config), clock=clock)
        e.start()
        return e

    for off, attempts in (((), 0), (("suspend_gate",), 1)):
        e = made(off)
        send(e, 1)
        s = e.store.read()
        e.store.write(replace(s, subscribers=spark.createDataFrame([("sub-a", True, False, 0, "")], s.subscribers.schema)), [])
        assert e.step() == attempts
    for off, attempts in (((), 0), (("draining_gate",), 1)):
        e = made(off, node="A", distributed=True)
        e.own("A")
        send(e, 1)
        e.begin_handoff(e.store.read().deliveries.first().partition, "A", "B")
        assert e.step() == attempts
    for off, status in (((), "pending"), (("in_flight_reset",), "in_flight")):
        e = made(off, node="A", distributed=True)
        e.own("B")
        s = e.store.read()
        e.store.write(replace(s, partition_owners=s.partition_owners.withColumn("owner_node", F.lit("A"))), [])
        send(e, 1)
        s = e.store.read()
        got = claim.claim(s.deliveries, "A/old/worker-0", 1, e.now(), None)
        e.store.write(replace(s, deliveries=got))
        e.take_over(got.first().partition, "B", 1)
        assert e.store.read().deliveries.first().status == status
    for off, status in (((), "in_flight"), (("mark_stamp",), "delivered")):
        e = made(off)
        send(e, 1)
        s = e.store.read()
        mine = claim.claim(s.deliveries, "worker-0", 1, e.now(), None).persist()
        state = e.store.write(replace(s, deliveries=claim.claim(s.deliveries, "another", 5, e.now(), None)))
        results = mine.withColumns({"code": F.lit(200), "err": F.lit(None).cast("string"), "outcome": F.lit("success")})
        e._mark(state, results, [mine.first().partition])
        assert e.store.read().deliveries.first().status == status
    with pytest.raises(ValueError):
        Config(off=frozenset({"nothing"}))


def test_attempts_without_a_status(spark):
    from tideline.functions import scalars as S

    rows = spark.createDataFrame([(None, None, "u", True), (None, "reset", "u", False), (None, None, "", False), (400, "bad URL", "u", False), (200, None, "u", False), (None, "reset", "", True)], "code int, err string, url string, gone boolean")
    assert [r[0] for r in rows.select(S.classify_attempt(F.col("code"), F.col("err"), F.col("url"), F.col("gone"))).collect()] == ["retryable", "retryable", "permanent", "permanent", "success", "retryable"]
