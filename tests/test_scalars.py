import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import scalars as S


def fnv(text: str) -> int:
    h = S.OFFSET
    for b in text.encode():
        h = (h ^ b) * S.PRIME % 2**64
    return h


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=20).filter(lambda s: "\0" not in s and s.isprintable()), min_size=1, max_size=30))
def test_partition(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(S.partition_of(F.col("t")), S.partition_of(F.col("t"), 100), S.partition_of(F.col("t"), 0), S.partition_of(F.col("t"), 65_537)).collect()
    assert [tuple(r) for r in got] == [(fnv(t) % 256, fnv(t) % 100, fnv(t) % 256, fnv(t) % 65_537) for t in texts]


def test_backoff(spark):
    df = spark.range(1).select(*(S.backoff_ms(F.lit(a), 1000, 8000).alias(f"a{a}") for a in (-3, 1, 2, 3, 4, 8, 2_000_000)))
    assert list(df.first()) == [1000, 1000, 2000, 4000, 8000, 8000, 8000]
    assert spark.range(1).select(S.backoff_ms(F.lit(1), 0, 0)).first()[0] == 1000
    low, high = spark.range(500).select(S.backoff_ms(F.lit(3), 1000, 8000, jitter=True).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert 4000 <= low < high <= 4400


@pytest.mark.parametrize("codes,outcome", [((200, 201, 204), "success"), ((408, 429, 500, 502, 503), "retryable"), ((400, 401, 404, 410, 422, 302, 101), "permanent")])
def test_status(spark, codes, outcome):
    df = spark.createDataFrame([(c,) for c in codes], "c int")
    assert {r[0] for r in df.select(S.classify_status(F.col("c"))).collect()} == {outcome}


def test_signature(spark):
    secret, payload = b"quiet harbour", b'{"a": 1}'
    want = "t=1712345678,v1=" + hmac.new(secret, b"1712345678." + payload, hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(bytearray(secret), bytearray(payload), bytearray(payload + b" "), 1712345678)], "s binary, p binary, bad binary, t long")
    got = df.select(S.sign(secret, F.col("t"), F.col("p")), S.sign_rows("s", "t", "p"), S.verify_rows("s", F.lit(want), "p", F.col("t") + 59, F.lit(60)), S.verify_rows("s", F.lit(want), "bad", F.col("t"), F.lit(60)), S.verify_rows("s", F.lit(want), "p", F.col("t") + 600, F.lit(60)), S.verify_rows("s", F.lit(want), "p", F.col("t") + 600, F.lit(0))).first()
    assert list(got) == [want, want, True, False, False, True]
    assert S.parse_signature("v1=ab, t=5") == (5, "ab")
    assert S.parse_signature("t=0,v1=ab") is None and S.parse_signature("t=5") is None and S.parse_signature(None) is None
    long = b"k" * 100
    assert spark.range(1).select(S.sign(long, F.lit(7), F.lit("x"))).first()[0] == "t=7,v1=" + hmac.new(long, b"7.x", hashlib.sha256).hexdigest()


def test_envelope_and_message(spark):
    df = spark.createDataFrame([('e"1', "a\\b", '{"n": 1,  "z": [1.0]}'), ("e2", "t", None)], "i string, t string, p string")
    assert [r[0] for r in df.select(S.envelope(F.col("i"), F.col("t"), F.col("p"))).collect()] == ['{"id":"e\\"1","type":"a\\\\b","data":{"n": 1,  "z": [1.0]}}', '{"id":"e2","type":"t","data":null}']
    m = spark.createDataFrame([('{"event":{"id":"e","type":"t","data":{"seq":4}},"subscribers":[{"id":"a","url":"u"}]}',), ("nonsense",)], "b string")
    got = [r[0] for r in m.select(S.decode_message(F.col("b"))).collect()]
    assert got[0].event.data == '{"seq":4}' and got[0].subscribers[0].id == "a" and got[1] is None
    assert spark.range(1).select(S.data_sequence(F.lit('{"data":{"seq":4}}'))).first()[0] == 4


def test_headers_leave_out_empty_values(spark):
    got = spark.range(1).select(S.headers(F.lit("t"), F.lit("e"), F.lit(None).cast("string"), F.lit(""))).first()[0]
    assert got == {"Content-Type": "application/json", "X-Event": "t", "X-Event-Id": "e"}


def test_ids_are_unique(spark):
    ids = [r[0] for r in spark.range(1000).select(S.delivery_id("x-")).collect()]
    assert len(set(ids)) == 1000 and all(len(i) == 34 for i in ids) and S.incarnation() != S.incarnation()
