"""Registered queries of the delivery engine, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators import assign, claim, enqueue, metrics, ownership, replay, retention, transitions
from tideline.sources import tables as T

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

BYTES = "list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)"
HASH256 = "(list_reduce(list_prepend(37::BIGINT, " + BYTES + "), lambda a, b: (xor(a, b) * 179) & 255))::INTEGER"
#: The state of FIXTURES B.3 in DuckDB's SQL.
STATE = f"""
WITH e AS (
  SELECT event_id, user_id, ts, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
k AS (SELECT *, user_id % 7 = 0 AS suspended, 1 + (user_id * 13) % n AS head, concat('sub-', user_id) AS subscriber_id FROM e),
users AS (SELECT DISTINCT user_id, subscriber_id FROM k),
hashed AS (SELECT user_id, {HASH256.format("subscriber_id")} AS partition FROM users),
s AS (
  SELECT concat('dlg-', event_id) AS id, concat('evt-', event_id) AS event_id, subscriber_id, concat('https://example.test/hook/', user_id) AS url, partition, sequence, event_type, props AS payload,
    CASE WHEN sequence < head THEN 'delivered' WHEN suspended AND sequence = head THEN 'dead_lettered' WHEN suspended THEN 'retained' WHEN sequence = head AND user_id % 3 = 0 THEN 'in_flight' ELSE 'pending' END AS status,
    CASE WHEN sequence <= head AND NOT (sequence = head AND NOT suspended AND user_id % 3 <> 0 AND user_id % 5 <> 0) THEN 1 ELSE 0 END AS attempt,
    CASE WHEN sequence = head AND NOT suspended AND user_id % 3 <> 0 AND user_id % 5 = 0 THEN TIMESTAMP '2024-02-01 01:00:00' ELSE ts END AS next_attempt_at,
    ts AS created_at, user_id, suspended, event_id AS number
  FROM k JOIN hashed USING (user_id)),
d AS (SELECT *, CASE WHEN status = 'in_flight' THEN concat('worker-', partition % 4) END AS owner, CASE WHEN status = 'in_flight' THEN 1 ELSE 0 END::BIGINT AS generation, CASE WHEN status = 'in_flight' THEN created_at END AS claimed_at FROM s),
o AS (SELECT p::INTEGER AS partition, concat('go', p % 2) AS owner_node, 1::BIGINT AS generation, CASE WHEN p % 37 = 0 THEN 'draining' ELSE 'active' END AS state, CASE WHEN p % 37 = 0 THEN concat('go', (p + 1) % 2) END AS next_owner FROM range(256) t(p)),
h AS (SELECT *, min(CASE WHEN status IN ('pending', 'in_flight') THEN sequence END) OVER (PARTITION BY subscriber_id) AS line FROM d),
ready AS (SELECT * FROM h WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-02-01' AND sequence = line AND NOT suspended)
"""
CLAIMED = "'in_flight' AS status, attempt + 1 AS attempt, TIMESTAMP '2024-02-01' AS claimed_at"


def query(sql: str | None = None, state: bool = True):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (STATE + sql) if state else sql
        return f

    return add


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.subscribers(spark, sf_dir)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("nat-"), "n_nationkey").alias("subscriber_id"), F.concat(F.lit("https://example.test/nat/"), "n_nationkey").alias("url"))


FANOUT = f"""
SELECT concat('dlg-', event_id, '-', n_nationkey) AS id, concat('evt-', event_id) AS event_id, concat('nat-', n_nationkey) AS subscriber_id, concat('https://example.test/nat/', n_nationkey) AS url,
  {HASH256.format("concat('nat-', n_nationkey)")} AS partition, row_number() OVER (PARTITION BY n_nationkey ORDER BY ts, event_id) AS sequence, event_type
FROM events CROSS JOIN nation
"""


@query(FANOUT, state=False)
def fanout_deliveries(spark, sf_dir):
    e = T.events(spark, sf_dir).select("event_id", "ts", "event_type")
    rows = enqueue.with_sequences(enqueue.fan_out(e, _nations(spark, sf_dir)), None, [F.col("ts"), F.col("event_id")])
    number = F.substring_index("subscriber_id", "-", -1)
    return rows.select(F.concat(F.lit("dlg-"), "event_id", F.lit("-"), number).alias("id"), F.concat(F.lit("evt-"), "event_id").alias("event_id"), "subscriber_id", "url", "partition", "sequence", "event_type")


@query(f"SELECT subscriber_id, partition FROM (SELECT DISTINCT subscriber_id, partition FROM d) UNION ALL SELECT c_name, {HASH256.format('c_name')} FROM customer")
def partition_hash(spark, sf_dir):
    names = _users(spark, sf_dir).select("subscriber_id").unionByName(T.table(spark, sf_dir, "customer").select(F.col("c_name").alias("subscriber_id")))
    return names.select("subscriber_id", S.partition_of(F.col("subscriber_id")).alias("partition"))


HASH_ANY = "(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))"


@query(f"SELECT c_name, ({HASH_ANY.format('c_name')} % 100)::INTEGER AS partition FROM customer", state=False)
def partition_hash_any(spark, sf_dir):
    return T.table(spark, sf_dir, "customer").select("c_name", S.partition_of(F.col("c_name"), 100).alias("partition"))


@query("SELECT subscriber_id, partition % 3 AS node FROM (SELECT DISTINCT subscriber_id, partition FROM d)")
def node_index(spark, sf_dir):
    return _users(spark, sf_dir).select("subscriber_id", S.node_index(F.col("subscriber_id"), 256, 3).alias("node"))


@query("SELECT k, CASE WHEN u < 9223372036854775808::HUGEINT THEN u ELSE 18446744073709551616::HUGEINT - u END::BIGINT AS hash FROM (SELECT k, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(k, ''), lambda x: ascii(x)::HUGEINT)), lambda a, b: (a * 31 + b) % 18446744073709551616::HUGEINT) AS u FROM (SELECT concat(subscriber_id, ':', sequence) AS k FROM d))")
def hash_key_31(spark, sf_dir):
    keys = T.deliveries(spark, sf_dir).select(F.concat("subscriber_id", F.lit(":"), "sequence").alias("k"))
    return keys.select("k", S.key_hash(F.col("k")).alias("hash"))


@query("SELECT p::INTEGER AS partition FROM range(256) t(p) WHERE p % 3 = 1", state=False)
def partitions_for_node(spark, sf_dir):
    return assign.partitions_for_node(spark, 256, 3, 1)


@query("SELECT p::INTEGER AS partition, concat('go', p % 3) AS owner_node FROM range(256) t(p)", state=False)
def owner_assignments(spark, sf_dir):
    return assign.owner_assignments(spark, 256, 3)


@query("SELECT p::INTEGER AS partition, (p % 7)::INTEGER AS worker FROM range(256) t(p)", state=False)
def worker_ownership(spark, sf_dir):
    return assign.build_ownership(spark, 7, 256)


@query("SELECT p::INTEGER AS partition, (p % 2)::INTEGER AS worker_from, (p % 3)::INTEGER AS worker_to FROM range(256) t(p) WHERE p % 2 <> p % 3", state=False)
def ownership_resize_diff(spark, sf_dir):
    before, now_at = assign.resize(spark, (1, 1), 2, 256)
    after, _ = assign.resize(spark, now_at, 3, 256)
    return assign.moved(before, after)


@query("SELECT p::INTEGER AS partition, 2::BIGINT AS times FROM range(256) t(p) WHERE p % 6 = 0", state=False)
def partition_cover(spark, sf_dir):
    slices = [assign.partitions_for_node(spark, 256, 2, n) for n in (0, 1)] + [assign.partitions_for_node(spark, 256, 6, 0)]
    return assign.uncovered(slices, spark.range(256).select(F.col("id").cast("int").alias("partition"))).select("partition", F.col("times").cast("bigint").alias("times"))


@query("SELECT concat('evt-', event_id) AS event_id, concat('sub-', user_id) AS subscriber_id, coalesce(c.n, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) c USING (user_id) WHERE event_type <> 'click'", state=False)
def sequence_assign(spark, sf_dir):
    e = T.events(spark, sf_dir).withColumn("subscriber_id", F.concat(F.lit("sub-"), "user_id"))
    used = e.where("event_type = 'click'").groupBy("subscriber_id").agg(F.count("*").alias("next_seq"))
    rows = enqueue.with_sequences(e.where("event_type <> 'click'").select("event_id", "ts", "subscriber_id"), used, [F.col("ts"), F.col("event_id")])
    return rows.select(F.concat(F.lit("evt-"), "event_id").alias("event_id"), "subscriber_id", "sequence")


@query("""SELECT event_id, concat('{"id":"evt-', event_id, '","type":"', event_type, '","data":', props, '}') AS body FROM events""", state=False)
def encode_envelope(spark, sf_dir):
    return T.events(spark, sf_dir).select("event_id", S.envelope(F.concat(F.lit("evt-"), "event_id"), F.col("event_type"), F.col("props")).alias("body"))


@query("SELECT event_id, concat('evt-', event_id) AS id, event_type AS type, replace(props, ' ', '') AS data, 2::INTEGER AS subscribers FROM events", state=False)
def decode_dispatch(spark, sf_dir):
    subs = F.lit('],"subscribers":').substr(2, 100)
    body = F.concat(F.lit('{"event":'), S.envelope(F.concat(F.lit("evt-"), "event_id"), F.col("event_type"), F.col("props")), subs, F.lit('[{"id":"a","url":"u"},{"id":"b","url":"v"}]}'))
    m = S.decode_message(body)
    return T.events(spark, sf_dir).select("event_id", m["event"]["id"].alias("id"), m["event"]["type"].alias("type"), m["event"]["data"].alias("data"), F.size(m["subscribers"]).alias("subscribers"))


@query("SELECT a::INTEGER AS attempt, least(900000, 1000 * (1 << greatest(0, least(a - 1, 20))::INTEGER))::BIGINT AS delay_ms FROM range(-1, 70) t(a)", state=False)
def backoff_schedule(spark, sf_dir):
    return spark.range(-1, 70).select(F.col("id").cast("int").alias("attempt"), S.backoff_ms(F.col("id").cast("int")).alias("delay_ms"))


@query("SELECT c::INTEGER AS code, CASE WHEN c BETWEEN 200 AND 299 THEN 'success' WHEN c IN (408, 429) OR c >= 500 THEN 'retryable' ELSE 'permanent' END AS outcome FROM range(100, 600) t(c)", state=False)
def classify_status(spark, sf_dir):
    return spark.range(100, 600).select(F.col("id").cast("int").alias("code"), S.classify_status(F.col("id")).alias("outcome"))


@query("SELECT c::INTEGER AS code, e AS err, CASE WHEN c BETWEEN 200 AND 299 THEN '' WHEN c <> 0 AND e <> '' THEN concat('status ', c, ': ', e) WHEN e <> '' THEN e WHEN c <> 0 THEN concat('status ', c) ELSE 'delivery failed' END AS message FROM (VALUES (0), (200), (404), (500)) t(c), (VALUES (''), ('timeout')) u(e)", state=False)
def result_error_text(spark, sf_dir):
    rows = spark.sql("SELECT c AS code, e AS err FROM VALUES (0), (200), (404), (500) AS t(c) CROSS JOIN VALUES (''), ('timeout') AS u(e)")
    return rows.select("code", "err", S.error_text(S.classify_status(F.col("code")), F.col("code"), F.col("err")).alias("message"))


@query("SELECT concat('go', p % 3, '/run', p % 5, '/worker-', p) AS token, concat('go', p % 3) AS node, concat('run', p % 5) AS incarnation, p AS worker FROM range(100) t(p) UNION ALL SELECT x, '', '', -1 FROM (VALUES ('worker-1'), ('a/b/worker-01'), ('a//worker-1'), ('a/b/c/worker-1')) v(x)", state=False)
def owner_token_parse(spark, sf_dir):
    p = F.col("id")
    good = spark.range(100).select(S.owner_token(F.concat(F.lit("go"), p % 3), F.concat(F.lit("run"), p % 5), p).alias("token"))
    bad = spark.sql("SELECT * FROM VALUES ('worker-1'), ('a/b/worker-01'), ('a//worker-1'), ('a/b/c/worker-1') AS v(token)")
    parsed = S.parse_owner_token(F.col("token"))
    return good.unionByName(bad).select("token", F.coalesce(parsed["node"], F.lit("")).alias("node"), F.coalesce(parsed["incarnation"], F.lit("")).alias("incarnation"), F.coalesce(parsed["worker"], F.lit(-1).cast("bigint")).alias("worker"))



_SECRET, _AT = b"a secret for examples", 1712345678
_PADS = [bytes(x ^ c for x in _SECRET.ljust(64, b"\0")).hex() for c in (0x36, 0x5C)]
SIGNED = f"concat('t={_AT},v1=', sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(concat('{_AT}.', props))))))"


@query(f"SELECT event_id, {SIGNED} AS signature FROM events", state=False)
def sign_payload(spark, sf_dir):
    return T.events(spark, sf_dir).select("event_id", S.sign(_SECRET, F.lit(_AT), F.col("props")).alias("signature"))


@query("SELECT event_id, event_id % 4 = 0 AS accepted FROM events", state=False)
def verify_payload(spark, sf_dir):
    """Signatures read a minute later: right ones, then other payloads, other secrets and late ones."""
    kind = F.col("event_id") % 4
    rows = T.events(spark, sf_dir).select("event_id", S.sign(_SECRET, F.lit(_AT), F.col("props")).alias("header"), F.encode(F.when(kind == 1, F.concat("props", F.lit(" "))).otherwise(F.col("props")), "UTF-8").alias("payload"), F.when(kind == 2, F.lit(b"another")).otherwise(F.lit(_SECRET)).alias("secret"), (_AT + 60 + F.when(kind == 3, 1).otherwise(0)).alias("now"))
    return rows.select("event_id", S.verify_rows("secret", "header", "payload", "now", F.lit(60)).alias("accepted"))


@query("SELECT n, t, v FROM (VALUES (1, 5::BIGINT, 'ab'), (2, 5, 'ab'), (3, NULL, NULL), (4, NULL, NULL), (5, NULL, NULL), (6, 7, 'c=d')) x(n, t, v)", state=False)
def parse_signature(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES (1, 't=5,v1=ab'), (2, ' v1=ab , t=5'), (3, 't=0,v1=ab'), (4, 't=5'), (5, 't=x,v1=ab'), (6, 't=7,v1=c=d,other') AS h(n, header)")
    found = S.parsed_signature(F.col("header"))
    return rows.select("n", found["t"].alias("t"), found["v"].alias("v"))


@query("SELECT event_id, event_id % 1000 AS seq FROM events", state=False)
def data_sequence(spark, sf_dir):
    body = S.envelope(F.lit("e"), F.lit("t"), F.concat(F.lit('{"seq": '), F.col("event_id") % 1000, F.lit("}")))
    return T.events(spark, sf_dir).select("event_id", S.data_sequence(body).alias("seq"))


@query("SELECT p::INTEGER AS partition, CASE WHEN p < 100 THEN concat('go', p % 2) ELSE 'go5' END AS owner_node, 1::BIGINT AS generation, CASE WHEN p < 100 AND p % 37 = 0 THEN 'draining' ELSE 'active' END AS state, CASE WHEN p < 100 AND p % 37 = 0 THEN concat('go', (p + 1) % 2) END AS next_owner FROM range(256) t(p)", state=False)
def ensure_assignments(spark, sf_dir):
    """Owners of the first hundred partitions stay as they are; the others get theirs."""
    have = T.owners(spark).where("partition < 100")
    wanted = have.select("partition", "owner_node").unionByName(spark.range(100, 256).select(F.col("id").cast("int").alias("partition"), F.lit("go5").alias("owner_node")))
    return ownership.ensure_assignments(have, wanted)


@query("SELECT p::INTEGER AS partition, 'go1' AS owner_node, 1::BIGINT AS generation, 'active' AS state, NULL::VARCHAR AS next_owner FROM range(256) t(p)", state=False)
def ensure_owners(spark, sf_dir):
    return ownership.ensure_owners(spark, None, 256, "go1")


@query("SELECT partition, arg_min(id, (sequence, id)) AS id, arg_min(owner, (sequence, id)) AS owner, arg_min(generation, (sequence, id)) AS generation FROM d WHERE status = 'in_flight' GROUP BY partition")
def in_flight_stamps(spark, sf_dir):
    return ownership.heads_in_flight(T.deliveries(spark, sf_dir))


@query("SELECT subscriber_id, partition FROM (SELECT DISTINCT user_id, subscriber_id, partition FROM d) WHERE partition % 2 = 1 AND partition % 3 = 0 ORDER BY user_id LIMIT 1")
def first_subscriber(spark, sf_dir):
    who = T.subscribers(spark, sf_dir).select("subscriber_id", F.substring_index("subscriber_id", "-", -1).cast("bigint").alias("n")).withColumn("partition", S.partition_of(F.col("subscriber_id")))
    return metrics.first_match(who, (F.col("partition") % 2 == 1) & (F.col("partition") % 3 == 0), "n").select("subscriber_id", "partition")


@query("SELECT count(*) > 0 AS distributed, count(*) FILTER (WHERE owner_node = 'go1') AS mine, max(CASE WHEN partition = 37 THEN owner_node END) AS owner FROM o")
def ownership_lookups(spark, sf_dir):
    owners = T.owners(spark)
    mine = ownership.partitions_of(owners, "go1").count()
    return spark.range(1).select(F.lit(ownership.is_distributed(owners)).alias("distributed"), F.lit(mine).cast("bigint").alias("mine"), F.lit(ownership.owner_of(owners, 37)).alias("owner"))


@query(f"SELECT id, subscriber_id, partition, sequence, {CLAIMED}, concat('worker-', partition % 4) AS owner, 3::BIGINT AS generation FROM (SELECT *, row_number() OVER (PARTITION BY partition % 4 ORDER BY partition, subscriber_id, sequence, id) AS nth FROM ready) WHERE nth <= 10")
def claim_workers(spark, sf_dir):
    return claim.claim_workers(T.deliveries(spark, sf_dir), 4, 3, T.now(), 10, T.subscribers(spark, sf_dir)).select(*_CLAIM_COLUMNS)


@query("SELECT subscriber_id, min(sequence) AS head FROM d WHERE status IN ('pending', 'in_flight') GROUP BY subscriber_id")
def hol_heads(spark, sf_dir):
    return claim.heads(T.deliveries(spark, sf_dir))


@query("SELECT id, subscriber_id, sequence FROM h WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-02-01' AND sequence = line")
def hol_eligible_window(spark, sf_dir):
    return claim.eligible(T.deliveries(spark, sf_dir), T.now()).select("id", "subscriber_id", "sequence")


@query("SELECT id, subscriber_id, sequence FROM d WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-02-01' AND NOT EXISTS (SELECT 1 FROM d x WHERE x.subscriber_id = d.subscriber_id AND x.sequence < d.sequence AND x.status IN ('pending', 'in_flight'))")
def hol_eligible_antijoin(spark, sf_dir):
    return claim.eligible_antijoin(T.deliveries(spark, sf_dir), T.now()).select("id", "subscriber_id", "sequence")


_CLAIM_COLUMNS = ("id", "subscriber_id", "partition", "sequence", "status", "attempt", "owner", "generation", "claimed_at")


@query(f"SELECT id, subscriber_id, partition, sequence, {CLAIMED}, 'worker-0' AS owner, 7::BIGINT AS generation FROM ready WHERE partition % 2 = 0 ORDER BY partition, subscriber_id, sequence LIMIT 20")
def claim_legacy(spark, sf_dir):
    even = [p for p in range(256) if p % 2 == 0]
    return claim.claim(T.deliveries(spark, sf_dir), "worker-0", 7, T.now(), even, 20, T.subscribers(spark, sf_dir)).select(*_CLAIM_COLUMNS)


@query(f"SELECT id, subscriber_id, partition, sequence, {CLAIMED}, 'worker-0' AS owner, 7::BIGINT AS generation FROM d WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-02-01' AND NOT suspended ORDER BY subscriber_id, sequence LIMIT 64")
def claim_no_hol(spark, sf_dir):
    return claim.claim(T.deliveries(spark, sf_dir), "worker-0", 7, T.now(), None, 64, T.subscribers(spark, sf_dir), hol=False, order=claim.BY_SUBSCRIBER).select(*_CLAIM_COLUMNS)


@query("SELECT id, subscriber_id, sequence FROM d WHERE 1 = 0")
def claim_empty_partitions(spark, sf_dir):
    return claim.claim(T.deliveries(spark, sf_dir), "worker-0", 7, T.now(), [], 64).select("id", "subscriber_id", "sequence")


@query(f"SELECT id, subscriber_id, ready.partition, sequence, {CLAIMED}, 'go1/run/worker-2' AS owner, o.generation FROM ready JOIN o ON ready.partition = o.partition WHERE owner_node = 'go1' AND state = 'active' ORDER BY ready.partition, subscriber_id, sequence LIMIT 64")
def claim_distributed(spark, sf_dir):
    return claim.claim_distributed(T.deliveries(spark, sf_dir), T.owners(spark), "go1", "go1/run/worker-2", T.now(), 64, T.subscribers(spark, sf_dir)).select(*_CLAIM_COLUMNS)


@query(f"SELECT id, subscriber_id, partition, sequence, {CLAIMED}, 'worker-0' AS owner, 1::BIGINT AS generation FROM d WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-02-01' ORDER BY created_at, sequence, id LIMIT 64")
def claim_naive(spark, sf_dir):
    return claim.claim_naive(T.deliveries(spark, sf_dir), "worker-0", 1, T.now()).select(*_CLAIM_COLUMNS)


@query(f"SELECT id, subscriber_id, partition, sequence, {CLAIMED}, 'worker-0' AS owner, 1::BIGINT AS generation FROM h WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-02-01' AND sequence = line ORDER BY created_at, sequence, id LIMIT 1")
def claim_fifo(spark, sf_dir):
    return claim.claim_fifo(T.deliveries(spark, sf_dir), "worker-0", 1, T.now()).select(*_CLAIM_COLUMNS)


def _commands(d: DataFrame) -> DataFrame:
    """For every third row in flight the right stamp; next to it a wrong owner, generation, id, and every delivered row."""
    flying = d.where("status = 'in_flight'")
    right = flying.where("sequence % 3 = 0").select("id", "owner", "generation")
    wrong = flying.where("sequence % 3 = 1").select("id", F.lit("worker-x").alias("owner"), "generation")
    old = flying.where("sequence % 3 = 2").select("id", "owner", F.lit(9).cast("bigint").alias("generation"))
    delivered = d.where("status = 'delivered'").select("id", F.lit("worker-0").alias("owner"), F.lit(1).cast("bigint").alias("generation"))
    none = d.where("sequence = 1").select(F.concat(F.lit("no-"), "id").alias("id"), F.lit("worker-0").alias("owner"), F.lit(1).cast("bigint").alias("generation"))
    return right.unionByName(wrong).unionByName(old).unionByName(delivered).unionByName(none)


_MARKED = "id, status, attempt, next_attempt_at, owner, generation, claimed_at"
_GOOD = "status = 'in_flight' AND sequence % 3 = 0"


def _mark_sql(status: str, attempt: str = "attempt", later: str = "next_attempt_at") -> str:
    pick = lambda new, old: f"CASE WHEN {_GOOD} THEN {new} ELSE {old} END"
    return f"SELECT id, {pick(repr(status), 'status')} AS status, {pick(attempt, 'attempt')} AS attempt, {pick(later, 'next_attempt_at')} AS next_attempt_at, {pick('NULL', 'owner')} AS owner, {pick('0', 'generation')}::BIGINT AS generation, {pick('NULL', 'claimed_at')} AS claimed_at FROM d"


@query(_mark_sql("delivered"))
def mark_delivered(spark, sf_dir):
    d = T.deliveries(spark, sf_dir)
    return transitions.mark_delivered(d, _commands(d)).select(*_MARKED.split(", "))


@query(_mark_sql("dead_lettered"))
def mark_dead_letter(spark, sf_dir):
    d = T.deliveries(spark, sf_dir)
    return transitions.mark_dead_letter(d, _commands(d).withColumn("error", F.lit("status 410"))).select(*_MARKED.split(", "))


@query(_mark_sql("pending", "4", "TIMESTAMP '2024-02-02'"))
def mark_failed(spark, sf_dir):
    d = T.deliveries(spark, sf_dir)
    c = _commands(d).withColumns({"error": F.lit("status 500"), "attempt": F.lit(4), "next_attempt_at": F.expr("TIMESTAMP_NTZ '2024-02-02 00:00:00'")})
    return transitions.mark_failed(d, c).select(*_MARKED.split(", "))


@query("""SELECT id, 'stale_stamp' AS rejected FROM d WHERE status = 'in_flight' AND sequence % 3 <> 0
UNION ALL SELECT id, 'not_in_flight' FROM d WHERE status = 'delivered'
UNION ALL SELECT concat('no-', id), 'unknown' FROM d WHERE sequence = 1""")
def mark_rejected(spark, sf_dir):
    d = T.deliveries(spark, sf_dir)
    return transitions.rejected(d, _commands(d)).select("id", "rejected")


@query("""
, hit AS (SELECT DISTINCT subscriber_id FROM d WHERE status = 'in_flight' AND sequence % 3 = 0),
a AS (SELECT d.*, CASE WHEN d.status = 'in_flight' AND d.sequence % 3 = 0 THEN 'dead_lettered' WHEN hit.subscriber_id IS NOT NULL AND d.status = 'pending' THEN 'retained' ELSE d.status END AS new_status, hit.subscriber_id IS NOT NULL AS touched FROM d LEFT JOIN hit USING (subscriber_id)),
b AS (SELECT *, CASE WHEN touched AND new_status = 'retained' THEN row_number() OVER (PARTITION BY subscriber_id, new_status ORDER BY sequence DESC) END AS newest FROM a)
SELECT id, subscriber_id, new_status AS status FROM b WHERE newest IS NULL OR newest <= 10
""")
def exhaust_and_suspend(spark, sf_dir):
    st = T.state(spark, sf_dir)
    commands = _commands(st.deliveries).withColumn("error", F.lit("status 410"))
    after = transitions.exhaust_and_suspend(st, commands, T.now(), max_age_s=0, max_count=10)
    return after.deliveries.select("id", "subscriber_id", "status")


@query("""
, hit AS (SELECT subscriber_id FROM d WHERE status = 'in_flight' AND sequence % 3 = 0),
r AS (SELECT subscriber_id, sequence, row_number() OVER (PARTITION BY subscriber_id ORDER BY sequence DESC) AS newest FROM d JOIN hit USING (subscriber_id) WHERE status = 'pending'),
g AS (SELECT subscriber_id, count(*) AS n, max(sequence) AS last FROM r WHERE newest > 10 GROUP BY subscriber_id),
u AS (SELECT DISTINCT subscriber_id, suspended FROM d)
SELECT subscriber_id, suspended OR hit.subscriber_id IS NOT NULL AS suspended, g.n IS NOT NULL AS gap, coalesce(g.n, 0)::INTEGER AS dropped, CASE WHEN g.n IS NULL THEN '' ELSE concat(subscriber_id, ':dropped=', g.n, ':through_seq=', g.last, ':count') END AS marker
FROM u LEFT JOIN hit USING (subscriber_id) LEFT JOIN g USING (subscriber_id)
""")
def exhausted_subscribers(spark, sf_dir):
    st = T.state(spark, sf_dir)
    commands = _commands(st.deliveries).withColumn("error", F.lit("status 410"))
    return transitions.exhaust_and_suspend(st, commands, T.now(), max_age_s=0, max_count=10).subscribers


_AGED = "created_at < TIMESTAMP '2024-02-01' - INTERVAL 200 HOUR"
_LOST = f"""
, r AS (SELECT *, {_AGED} AS aged FROM d WHERE status = 'retained'),
q AS (SELECT *, row_number() OVER (PARTITION BY subscriber_id ORDER BY aged, sequence DESC) AS newest FROM r),
x AS (SELECT id, subscriber_id, sequence, CASE WHEN aged THEN 'age' WHEN newest > 5 THEN 'count' END AS reason FROM q WHERE aged OR newest > 5)
"""
_AGE_S, _COUNT = 200 * 3600, 5


@query(_LOST + "SELECT * FROM x WHERE reason = 'age'")
def retention_age(spark, sf_dir):
    return retention.drops(T.deliveries(spark, sf_dir), T.now(), _AGE_S, 0)


@query(_LOST + "SELECT * FROM x")
def retention_count(spark, sf_dir):
    return retention.drops(T.deliveries(spark, sf_dir), T.now(), _AGE_S, _COUNT)


_GAP = ", g AS (SELECT subscriber_id, count(*) AS n, count(*) FILTER (WHERE reason = 'count') AS c, coalesce(max(sequence) FILTER (WHERE reason = 'count'), max(sequence)) AS last FROM x GROUP BY subscriber_id)"


@query(_LOST + _GAP + """
SELECT u.subscriber_id, g.n IS NOT NULL AS gap, coalesce(g.n, 0)::INTEGER AS dropped, CASE WHEN g.n IS NULL THEN '' ELSE concat(u.subscriber_id, ':dropped=', g.n, ':through_seq=', g.last, ':', CASE WHEN g.c > 0 THEN 'count' ELSE 'age' END) END AS marker
FROM (SELECT DISTINCT subscriber_id FROM d WHERE suspended) u LEFT JOIN g ON g.subscriber_id = u.subscriber_id
UNION ALL SELECT 'sub-unknown', false, 0, ''
""")
def resume_gap(spark, sf_dir):
    st = T.state(spark, sf_dir)
    who = st.subscribers.where("suspended").select("subscriber_id").unionByName(spark.sql("SELECT 'sub-unknown' AS subscriber_id"))
    return transitions.resume(st, who, T.now(), _AGE_S, _COUNT)[1]


@query(_LOST + "SELECT id, CASE WHEN status = 'retained' THEN 'pending' ELSE status END AS status, attempt, CASE WHEN status = 'retained' THEN TIMESTAMP '2024-02-01' ELSE next_attempt_at END AS next_attempt_at FROM d WHERE id NOT IN (SELECT id FROM x)")
def resume_replay(spark, sf_dir):
    st = T.state(spark, sf_dir)
    who = st.subscribers.where("suspended").select("subscriber_id")
    return transitions.resume(st, who, T.now(), _AGE_S, _COUNT)[0].deliveries.select("id", "status", "attempt", "next_attempt_at")


_OLD = "status = 'in_flight' AND claimed_at < TIMESTAMP '2024-02-01' - INTERVAL 240 HOUR"


@query(f"SELECT id, CASE WHEN {_OLD} THEN 'pending' ELSE status END AS status, attempt, CASE WHEN NOT coalesce({_OLD}, false) THEN owner END AS owner, CASE WHEN {_OLD} THEN 0 ELSE generation END::BIGINT AS generation FROM d WHERE status IN ('in_flight', 'pending')")
def recover_stale(spark, sf_dir):
    after = transitions.recover_stale(T.deliveries(spark, sf_dir), T.now(), 240 * 3600)
    return after.where("status IN ('in_flight', 'pending')").select("id", "status", "attempt", "owner", "generation")


def _route_sql(last: str) -> str:
    return f"""
, res AS (SELECT id, 1 + (number % 9)::INTEGER AS attempt, CASE number % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'retryable' ELSE 'permanent' END AS outcome FROM d),
c AS (SELECT *, CASE WHEN outcome = 'success' THEN 'mark_delivered' WHEN outcome = 'permanent' OR attempt >= 8 THEN '{last}' ELSE 'mark_failed' END AS command FROM res)
SELECT id, attempt, outcome, command, CASE WHEN command = 'mark_failed' THEN TIMESTAMP '2024-02-01' + to_milliseconds(least(900000, 1000 * (1 << (attempt - 1)))) END AS next_attempt_at FROM c
"""


def _results(spark, sf_dir):
    number = F.substring_index("event_id", "-", -1).cast("bigint")
    outcome = F.when(number % 3 == 0, "success").when(number % 3 == 1, "retryable").otherwise("permanent")
    return T.deliveries(spark, sf_dir).select("id", (1 + number % 9).cast("int").alias("attempt"), outcome.alias("outcome"))


@query(_route_sql("exhaust_and_suspend"))
def outcome_routing(spark, sf_dir):
    return transitions.route(_results(spark, sf_dir), T.now())


@query(_route_sql("mark_dead_letter"))
def outcome_routing_baseline(spark, sf_dir):
    return transitions.route(_results(spark, sf_dir), T.now(), suspend=False)


@query("SELECT count(*) AS n FROM d WHERE status IN ('pending', 'in_flight')")
def pending_or_in_flight(spark, sf_dir):
    return transitions.unfinished(T.deliveries(spark, sf_dir))


@query("SELECT subscriber_id, count(*) AS n FROM d WHERE status = 'retained' GROUP BY subscriber_id")
def retained_count(spark, sf_dir):
    return transitions.retained_count(T.deliveries(spark, sf_dir))


@query("SELECT partition, count(*) AS n FROM d WHERE status = 'in_flight' GROUP BY partition")
def in_flight_by_partition(spark, sf_dir):
    return ownership.in_flight_by_partition(T.deliveries(spark, sf_dir))


@query("SELECT DISTINCT subscriber_id, suspended FROM d UNION ALL SELECT 'sub-unknown', false")
def is_suspended(spark, sf_dir):
    subs = T.subscribers(spark, sf_dir)
    return transitions.is_suspended(subs, subs.select("subscriber_id").unionByName(spark.sql("SELECT 'sub-unknown' AS subscriber_id")))


@query("SELECT owner_node, count(*) AS n FROM o GROUP BY owner_node")
def owner_distribution(spark, sf_dir):
    return ownership.distribution(T.owners(spark))


@query("""SELECT partition, owner_node, generation, 'draining' AS state, CASE WHEN state = 'active' AND owner_node = 'go0' THEN 'go9' ELSE next_owner END AS next_owner, state = 'active' AND owner_node = 'go0' AS changed FROM o WHERE state = 'draining' OR owner_node = 'go0'
UNION ALL SELECT partition, owner_node, generation, state, next_owner, false FROM o WHERE state = 'active' AND owner_node <> 'go0'""")
def begin_handoff(spark, sf_dir):
    moves = spark.range(256).select(F.col("id").cast("int").alias("partition"), F.lit("go0").alias("source"), F.lit("go9").alias("target"))
    return ownership.begin_rows(T.owners(spark), moves)


@query("""
, busy AS (SELECT DISTINCT partition FROM d WHERE status = 'in_flight'),
j AS (SELECT o.*, o.state = 'draining' AND busy.partition IS NULL AS changed FROM o LEFT JOIN busy USING (partition))
SELECT partition, CASE WHEN changed THEN next_owner ELSE owner_node END AS owner_node, CASE WHEN changed THEN generation + 1 ELSE generation END AS generation, CASE WHEN changed THEN 'active' ELSE state END AS state, CASE WHEN NOT changed THEN next_owner END AS next_owner, changed FROM j
""")
def complete_handoff(spark, sf_dir):
    return ownership.complete_rows(T.owners(spark), T.deliveries(spark, sf_dir), spark.range(256).select(F.col("id").cast("int").alias("partition")))


@query("""
SELECT partition, target, expected, CASE WHEN owner_node = target AND state = 'draining' AND generation = expected THEN 'abort_drain' WHEN owner_node = target AND state = 'active' AND generation IN (expected, expected + 1) THEN 'no_op' WHEN owner_node <> target AND generation = expected THEN 'steal' ELSE 'conflict' END AS decision
FROM o, (VALUES ('go0'), ('go1')) t(target), (VALUES (1::BIGINT), (2::BIGINT)) e(expected)
""")
def force_takeover(spark, sf_dir):
    wishes = spark.range(256).select(F.col("id").cast("int").alias("partition")).crossJoin(spark.sql("SELECT * FROM VALUES ('go0'), ('go1') AS t(target) CROSS JOIN VALUES (1L), (2L) AS e(expected)"))
    return ownership.takeover_decision(T.owners(spark), wishes).select("partition", "target", "expected", "decision")


_STOLEN = "owner_node = 'go1'"


@query(f"SELECT id, CASE WHEN {_STOLEN} AND status = 'in_flight' THEN 'pending' ELSE status END AS status, CASE WHEN NOT (coalesce({_STOLEN}, false) AND status = 'in_flight') THEN d.owner END AS owner, CASE WHEN {_STOLEN} AND status = 'in_flight' THEN 0 ELSE d.generation END::BIGINT AS generation FROM d LEFT JOIN o ON d.partition = o.partition")
def force_takeover_reset(spark, sf_dir):
    """In-flight rows after go0 has taken all partitions by force."""
    wishes = spark.range(256).select(F.col("id").cast("int").alias("partition"), F.lit("go0").alias("target"), F.lit(1).cast("bigint").alias("expected"))
    return ownership.take_over_rows(T.owners(spark), T.deliveries(spark, sf_dir), wishes)[1].select("id", "status", "owner", "generation")


@query(f"SELECT partition, 'go0' AS owner_node, CASE WHEN {_STOLEN} THEN 2 ELSE 1 END::BIGINT AS generation, 'active' AS state, NULL::VARCHAR AS next_owner FROM o")
def force_takeover_owners(spark, sf_dir):
    wishes = spark.range(256).select(F.col("id").cast("int").alias("partition"), F.lit("go0").alias("target"), F.lit(1).cast("bigint").alias("expected"))
    return ownership.take_over_rows(T.owners(spark), T.deliveries(spark, sf_dir), wishes)[0].drop("decision")


@query("SELECT id, partition FROM d WHERE status IN ('pending', 'in_flight') AND partition >= 200")
def orphan_deliveries(spark, sf_dir):
    return claim.orphans(T.deliveries(spark, sf_dir), T.owners(spark).where("partition < 200")).select("id", "partition")


def _dispatch_owner_filter(spark, sf_dir, events: DataFrame) -> DataFrame:
    e = events.select(F.concat(F.lit("evt-"), "event_id").alias("event_id"))
    return ownership.local_subscribers(enqueue.fan_out(e, _nations(spark, sf_dir)), T.owners(spark), "go1").select("event_id", "subscriber_id")


@query("SELECT concat('evt-', event_id) AS event_id, concat('nat-', n_nationkey) AS subscriber_id FROM events, nation WHERE " + HASH256.format("concat('nat-', n_nationkey)") + " % 2 = 1", state=False)
def dispatch_owner_filter(spark, sf_dir):
    return _dispatch_owner_filter(spark, sf_dir, T.events(spark, sf_dir))


def _fanout_by_node(spark, sf_dir, events: DataFrame) -> DataFrame:
    e = events.select(F.concat(F.lit("evt-"), "event_id").alias("event_id"))
    out = ownership.by_node(enqueue.fan_out(e, _nations(spark, sf_dir)), T.owners(spark))
    return out.withColumn("subscribers", F.array_join("subscribers", ","))


@query("SELECT concat('evt-', event_id) AS event_id, concat('go', " + HASH256.format("concat('nat-', n_nationkey)") + " % 2) AS owner_node, string_agg(concat('nat-', n_nationkey), ',' ORDER BY concat('nat-', n_nationkey)) AS subscribers FROM events, nation GROUP BY 1, 2", state=False)
def fanout_by_node(spark, sf_dir):
    return _fanout_by_node(spark, sf_dir, T.events(spark, sf_dir))


_RECEIPTS = ", r AS (SELECT subscriber_id AS sub, sequence AS seq, created_at + (number % 17) * INTERVAL 1 HOUR AS arrived FROM d WHERE status = 'delivered'), l AS (SELECT *, lag(seq) OVER (PARTITION BY sub ORDER BY arrived, seq) AS before FROM r)"


@query(_RECEIPTS + "SELECT count(*) FILTER (WHERE seq < before) AS inversions, count(*) AS receipts FROM l")
def inversions_strict(spark, sf_dir):
    return metrics.inversions(T.receipts(spark, sf_dir, disturbed=True))


@query(_RECEIPTS + ", t AS (SELECT *, lag(seq) OVER (PARTITION BY sub ORDER BY arrived, seq) AS b2 FROM (SELECT sub, seq, arrived FROM r UNION ALL SELECT sub, seq, arrived FROM r WHERE seq % 10 = 0)) SELECT count(*) FILTER (WHERE seq <= b2) AS inversions, count(*) AS receipts FROM t")
def inversions_nonstrict(spark, sf_dir):
    r = T.receipts(spark, sf_dir, disturbed=True)
    return metrics.inversions(r.unionByName(r.where("seq % 10 = 0")), strict=False)


@query("SELECT count(*) FILTER (WHERE false) AS inversions, count(*) AS receipts FROM d WHERE status = 'delivered'")
def inversions_ordered(spark, sf_dir):
    return metrics.inversions(T.receipts(spark, sf_dir))


@query(_RECEIPTS + ", a AS (SELECT seq, min(created_at) AS sent FROM (SELECT sequence AS seq, created_at FROM d) GROUP BY seq), m AS (SELECT greatest((epoch_us(arrived) - epoch_us(sent)) / 1000.0, 0.0)::DOUBLE AS ms FROM r JOIN a USING (seq)), s2 AS (SELECT list_sort(list(ms)) AS v FROM m) SELECT v[1 + least(len(v) * 50 // 100, len(v) - 1)] AS p50, v[1 + least(len(v) * 99 // 100, len(v) - 1)] AS p99 FROM s2")
def latency_percentiles(spark, sf_dir):
    sent = T.deliveries(spark, sf_dir).groupBy(F.col("sequence").alias("seq")).agg(F.min("created_at").alias("dispatched_at"))
    return metrics.nearest_rank(metrics.latencies(T.receipts(spark, sf_dir, disturbed=True), sent), "ms", (50, 99))


@query("SELECT count(*) AS n, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1000000.0::DOUBLE AS seconds, count(*) / ((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1000000.0::DOUBLE) AS per_second FROM d WHERE status = 'delivered'")
def delivery_throughput(spark, sf_dir):
    return metrics.throughput(T.receipts(spark, sf_dir))


def _attempts(spark, sf_dir):
    return T.deliveries(spark, sf_dir).where("attempt > 0").select(F.concat(F.lit("worker-"), F.col("partition") % 16).alias("owner"), (F.col("sequence") % 11).alias("idle_ms"))


_WORKERS = ", w AS (SELECT concat('worker-', partition % 16) AS owner, count(*) AS deliveries, sum(sequence % 11)::BIGINT AS idle_ms FROM d WHERE attempt > 0 GROUP BY 1)"


@query(_WORKERS + "SELECT * FROM w")
def worker_stats(spark, sf_dir):
    return metrics.worker_stats(_attempts(spark, sf_dir))


@query(_WORKERS + "SELECT min(deliveries)::DOUBLE AS least, max(deliveries)::DOUBLE AS most, round(avg(deliveries), 6) AS mean, round(stddev_pop(deliveries) / avg(deliveries), 6) AS cv, round(CASE WHEN min(deliveries) = 0 THEN 0 ELSE max(deliveries)::DOUBLE / min(deliveries) END, 6) AS ratio FROM w")
def worker_balance(spark, sf_dir):
    out = metrics.balance(metrics.worker_stats(_attempts(spark, sf_dir)), "deliveries")
    return out.select("least", "most", *(F.round(c, 6).alias(c) for c in ("mean", "cv", "ratio")))


@query(", c AS (SELECT partition, count(*) FILTER (WHERE id IN (SELECT id FROM ready)) AS rows FROM d GROUP BY partition) SELECT count(*) AS calls, sum(rows)::BIGINT AS rows, count(*) FILTER (WHERE rows > 0) AS non_empty, sum(rows) / count(*) FILTER (WHERE rows > 0)::DOUBLE AS rows_per_claim FROM c")
def claim_stats(spark, sf_dir):
    d = T.deliveries(spark, sf_dir)
    got = claim.eligible(d, T.now(), None, T.subscribers(spark, sf_dir)).groupBy("partition").agg(F.count("*").alias("rows"))
    calls = d.select("partition").distinct().join(got, "partition", "left").select(F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))
    return metrics.claim_stats(calls)


@query("SELECT count(DISTINCT partition) AS partitions, count(DISTINCT subscriber_id) AS subscribers FROM d")
def partition_spread(spark, sf_dir):
    return metrics.spread(T.deliveries(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE user_id % 4 = 0) AS slow, count(*) AS subscribers FROM (SELECT DISTINCT user_id FROM events)", state=False)
def slow_subscribers(spark, sf_dir):
    return metrics.slow_subscribers(T.subscribers(spark, sf_dir), 4)


@query("SELECT subscriber_id, CASE WHEN user_id % 4 = 0 THEN 25 ELSE 1 END AS delay_ms FROM users")
def latency_profile(spark, sf_dir):
    return T.subscribers(spark, sf_dir).select("subscriber_id", S.latency_ms(F.col("subscriber_id"), 4, 1, 25).alias("delay_ms"))


REPLAY = (
    "WITH w0 AS (SELECT n, concat('sub-', n) AS sub, seq, CASE WHEN n % 4 = 0 THEN 25 ELSE 1 END AS delay_ms FROM range(64) t(n), range(1, 41) u(seq)), "
    "w AS (SELECT *, list_reduce(list_prepend(0::BIGINT, " + BYTES.format("concat(sub, ':', seq)") + "), lambda a, b: a * 31 + b) % 17 = 0 AS failed FROM w0), "
    "c AS (SELECT *, delay_ms + CASE WHEN failed THEN 2 ELSE 0 END AS cost, CASE WHEN failed THEN 2 ELSE 1 END AS attempts FROM w), "
    "r AS (SELECT 'ordered' AS policy, sub, seq, attempts, sum(cost) OVER (PARTITION BY sub ORDER BY seq)::BIGINT AS arrived FROM c "
    "UNION ALL SELECT 'fifo', sub, seq, attempts, sum(cost) OVER (ORDER BY seq, n)::BIGINT FROM c "
    "UNION ALL SELECT 'naive', sub, seq, attempts, (((seq - 1) * 64 + n) // 16 + cost)::BIGINT FROM c), "
    "l AS (SELECT *, lag(seq) OVER (PARTITION BY policy, sub ORDER BY arrived, seq) AS before FROM r), "
    "g AS (SELECT policy, count(*) AS receipts, count(*) FILTER (WHERE seq < before) AS inversions, round(count(*) * 1000 / max(arrived)::DOUBLE, 3) AS per_second, list_sort(list(arrived)) AS v FROM l GROUP BY policy) "
)


@query(REPLAY + "SELECT policy, sub, seq, attempts::INTEGER AS attempts, arrived FROM r", state=False)
def replay_receipts(spark, sf_dir):
    """64 subscribers and 40 events through the three policies."""
    return replay.receipts(replay.workload(spark))


@query(REPLAY + "SELECT policy, receipts, inversions, per_second, round(per_second * 100 / (SELECT per_second FROM g WHERE policy = 'naive'), 1) AS percent, v[1 + 1280] AS p50, v[1 + 2534] AS p99 FROM g", state=False)
def baseline_attribution(spark, sf_dir):
    work = replay.workload(spark)
    got = replay.receipts(work)
    replay.check_complete(got, work)
    return replay.report(got)


@query(_RECEIPTS + "SELECT sub, string_agg(seq::VARCHAR, ',' ORDER BY arrived, seq) AS seqs FROM r GROUP BY sub")
def arrival_sequences(spark, sf_dir):
    return metrics.sequences(T.receipts(spark, sf_dir, disturbed=True)).withColumn("seqs", F.array_join("seqs", ","))


@query("""
, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS used FROM events)
SELECT concat('new-', event_id) AS id, concat('sub-', user_id) AS subscriber_id, used + nth AS sequence, CASE WHEN user_id % 7 = 0 THEN 'retained' ELSE 'pending' END AS status FROM n
""")
def enqueue_batch(spark, sf_dir):
    return _enqueue_batch(spark, sf_dir, T.events(spark, sf_dir))


def _enqueue_batch(spark, sf_dir, events: DataFrame) -> DataFrame:
    st = T.state(spark, sf_dir)
    rows = events.select(F.concat(F.lit("new-"), "event_id").alias("id"), F.concat(F.lit("evt-"), "event_id").alias("event_id"), "event_type", F.col("props").alias("payload"), F.concat(F.lit("sub-"), "user_id").alias("subscriber_id"), F.concat(F.lit("https://example.test/hook/"), "user_id").alias("url"), "ts")
    rows = rows.withColumn("partition", S.partition_of(F.col("subscriber_id")))
    after = enqueue.enqueue(replace(st), rows, T.now(), [F.col("ts"), F.col("event_id")], max_age_s=0, max_count=0)
    return after.deliveries.where("id LIKE 'new-%'").select("id", "subscriber_id", "sequence", "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
