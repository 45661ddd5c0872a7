"""Scalar functions as Spark expressions: no Python runs for a row, but for per-row secrets.

``register`` makes them temporary SQL functions.
"""

from __future__ import annotations

import hashlib
import hmac
import uuid

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tideline.schemas import PERMANENT, RETRYABLE, SUCCESS

PARTITIONS = 256
MASK = 2**32 - 1
#: 64-bit FNV-1a: offset basis and prime, fixed by the algorithm.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
BASE_MS, MAX_MS = 1_000, 900_000


def _bytes(text: Column) -> Column:
    """UTF-8 bytes as an array of bigint."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("bigint"))


def partition_of(text: Column, partitions: int = PARTITIONS) -> Column:
    """FNV-1a 64 over UTF-8 bytes, unsigned, modulo ``partitions`` (not positive: 256).

    A modulus that divides 256 needs the hash's low byte alone; others run on two
    32-bit limbs, so that no step leaves a signed 64-bit range.
    """
    n = partitions if partitions > 0 else PARTITIONS
    data = _bytes(text)
    if 256 % n == 0:
        low = F.aggregate(data, F.lit(OFFSET & 255).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * (PRIME & 255)).bitwiseAND(255))
        return (low % n).cast("int")
    small = PRIME & MASK  # the prime is 2**40 + small

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b)
        hi = h["hi"] * small + x * 256 + F.shiftrightunsigned(x * small, 32)
        return F.struct((x * small).bitwiseAND(MASK).alias("lo"), hi.bitwiseAND(MASK).alias("hi"))

    start = F.struct(F.lit(OFFSET & MASK).cast("bigint").alias("lo"), F.lit(OFFSET >> 32).cast("bigint").alias("hi"))
    return F.aggregate(data, start, step, lambda h: ((h["hi"] % n) * (2**32 % n) + h["lo"] % n) % n).cast("int")


def node_index(text: Column, partitions: int, nodes: int) -> Column:
    return F.lit(0) if nodes <= 0 else F.pmod(partition_of(text, partitions), F.lit(nodes)).cast("int")


def key_hash(text: Column) -> Column:
    """31 * h + byte, wrapping in signed 64 bits, absolute value; -2**63 has none and stays.  Two 32-bit limbs, as in ``partition_of``."""

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"] * 31 + b
        return F.struct(lo.bitwiseAND(MASK).alias("lo"), (h["hi"] * 31 + F.shiftrightunsigned(lo, 32)).bitwiseAND(MASK).alias("hi"))

    def signed(h: Column) -> Column:
        v = F.when(h["hi"] >= 2**31, h["hi"] - 2**32).otherwise(h["hi"]) * 2**32 + h["lo"]
        return F.when(v > -(2**63), F.abs(v)).otherwise(v)

    zero = F.lit(0).cast("bigint")
    return F.aggregate(_bytes(text), F.struct(zero.alias("lo"), zero.alias("hi")), step, signed)


def backoff_ms(attempt: Column, base_ms: int = BASE_MS, max_ms: int = MAX_MS, jitter: bool = False, seed: int | None = None) -> Column:
    """min(max, base * 2**(attempt - 1)), with up to a tenth more as jitter.  The shift is bounded before multiplying."""
    base, top = (base_ms if base_ms > 0 else BASE_MS), (max_ms if max_ms > 0 else MAX_MS)
    doublings = F.least(F.greatest(F.coalesce(attempt, F.lit(1)) - 1, F.lit(0)), F.lit(max(0, (top // base).bit_length()))).cast("int")
    delay = F.least(F.lit(top).cast("bigint"), F.lit(base).cast("bigint") * F.pow(F.lit(2.0), doublings).cast("bigint"))
    if jitter:
        delay = delay + F.floor(F.rand(seed) * (F.floor(delay / 10) + 1)).cast("bigint")
    return delay


def classify_status(code: Column) -> Column:
    return F.when((code >= 200) & (code < 300), SUCCESS).when(code.isin(408, 429) | (code >= 500), RETRYABLE).otherwise(PERMANENT)


def error_text(outcome: Column, code: Column, err: Column) -> Column:
    has_code, has_err = F.coalesce(code, F.lit(0)) != 0, F.coalesce(err, F.lit("")) != ""
    status = F.concat(F.lit("status "), code.cast("string"))
    return F.when(outcome == SUCCESS, "").when(has_code & has_err, F.concat(status, F.lit(": "), err)).when(has_err, err).when(has_code, status).otherwise("delivery failed")


def classify_attempt(code: Column, err: Column, url: Column, cancelled: Column | None = None) -> Column:
    """An attempt that never got a status: cancelled and network errors may be retried, a missing URL may not."""
    early = F.when(F.coalesce(url, F.lit("")) == "", PERMANENT)
    if cancelled is not None:
        early = F.when(cancelled, RETRYABLE).when(F.coalesce(url, F.lit("")) == "", PERMANENT)
    return early.when(code.isNull() & err.isNotNull(), RETRYABLE).otherwise(classify_status(code))


def envelope(event_id: Column, event_type: Column, payload: Column) -> Column:
    """{"id","type","data"} with the raw JSON text as it is; null data is null."""
    quoted = [F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'^\{"v":(.*)\}$', 1) for c in (event_id, event_type)]
    return F.concat(F.lit('{"id":'), quoted[0], F.lit(',"type":'), quoted[1], F.lit(',"data":'), F.coalesce(payload, F.lit("null")), F.lit("}"))


MESSAGE = "struct<event: struct<id: string, type: string, data: string>, subscribers: array<struct<id: string, url: string>>>"


def decode_message(body: Column) -> Column:
    """A dispatch message; the event's data stays JSON text."""
    head = F.from_json(body, MESSAGE)
    event = F.struct(head["event"]["id"].alias("id"), head["event"]["type"].alias("type"), F.get_json_object(body, "$.event.data").alias("data"))
    return F.when(head["event"].isNotNull(), F.struct(event.alias("event"), head["subscribers"].alias("subscribers")))


def data_sequence(body: Column) -> Column:
    return F.get_json_object(body, "$.data.seq").try_cast("bigint")


def _xor_key(secret: bytes, byte: int) -> str:
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    return bytes(b ^ byte for b in key.ljust(64, b"\0")).hex()


def sign(secret: bytes, unix: Column, payload: Column) -> Column:
    """t=<unix>,v1=<hmac-sha256 of "unix.payload">, for one secret: two SHA-256 calls in the JVM."""
    message = F.concat(F.encode(F.concat(unix.cast("string"), F.lit(".")), "UTF-8"), payload.cast("binary"))
    inner = F.sha2(F.concat(F.unhex(F.lit(_xor_key(secret, 0x36))), message), 256)
    outer = F.sha2(F.concat(F.unhex(F.lit(_xor_key(secret, 0x5C))), F.unhex(inner)), 256)
    return F.concat(F.lit("t="), unix.cast("string"), F.lit(",v1="), outer)


def parse_signature(header: str | None) -> tuple[int, str] | None:
    t, v = 0, ""
    for part in (header or "").split(","):
        name, _, value = part.strip().partition("=")
        if name == "t":
            t = int(value) if value.isascii() and value.isdigit() else 0
        elif name == "v1":
            v = value
    return (t, v) if t > 0 and v else None


def parsed_signature(header: Column) -> Column:
    """struct(t, v) as ``parse_signature`` reads it: of repeated parts the last; null fields if a part is missing or t isn't positive."""
    parts = F.transform(F.split(header, ",", -1), lambda p: F.trim(p))
    value = lambda name: F.substr(F.try_element_at(F.filter(parts, lambda p: F.startswith(p, F.lit(f"{name}="))), F.lit(-1)), F.lit(len(name) + 2))
    t, v = F.when(value("t").rlike("^[0-9]+$"), value("t").try_cast("bigint")), value("v1")
    good = (t > 0) & (v != "")
    return F.struct(F.when(good, t).alias("t"), F.when(good, v).alias("v"))


@F.pandas_udf(StringType())
def sign_rows(secret: pd.Series, unix: pd.Series, payload: pd.Series) -> pd.Series:
    """As ``sign``, with a secret a row."""
    return pd.Series([f"t={t},v1={hmac.new(bytes(s), f'{t}.'.encode() + bytes(p or b''), hashlib.sha256).hexdigest()}" if s else None for s, t, p in zip(secret, unix, payload, strict=True)])


@F.pandas_udf(BooleanType())
def verify_rows(secret: pd.Series, header: pd.Series, payload: pd.Series, now: pd.Series, tolerance: pd.Series) -> pd.Series:
    """True if the header signs the payload and, for a positive tolerance, lies within it of now."""

    def one(s, h, p, n, tol) -> bool:
        found = parse_signature(h)
        if not s or found is None or (tol > 0 and abs(n - found[0]) > tol):
            return False
        return hmac.compare_digest(hmac.new(bytes(s), f"{found[0]}.".encode() + bytes(p or b""), hashlib.sha256).hexdigest(), found[1])

    return pd.Series([one(*x) for x in zip(secret, header, payload, now, tolerance, strict=True)], dtype=bool)


def headers(event_type: Column, event_id: Column, delivery_id: Column, signature: Column) -> Column:
    """Header map of a delivery; empty values are left out."""
    names = {"Content-Type": F.lit("application/json"), "X-Event": event_type, "X-Event-Id": event_id, "X-Delivery-Id": delivery_id, "X-Signature": signature}
    every = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    return F.map_filter(every, lambda _, v: v != "")


def delivery_id(prefix: str = "") -> Column:
    """Random; materialise before it is used twice."""
    return F.concat(F.lit(prefix), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))


def incarnation() -> str:
    return uuid.uuid4().hex


OWNER_TOKEN = r"^([^/]+)/([^/]+)/worker-(0|[1-9][0-9]*)$"


def owner_token(node: Column, run: Column, worker: Column) -> Column:
    return F.concat_ws("/", node, run, F.concat(F.lit("worker-"), worker.cast("string")))


def parse_owner_token(token: Column) -> Column:
    """struct(node, incarnation, worker), null if the token doesn't round-trip."""
    parts = [F.regexp_extract(token, OWNER_TOKEN, n) for n in (1, 2, 3)]
    return F.when(token.rlike(OWNER_TOKEN), F.struct(parts[0].alias("node"), parts[1].alias("incarnation"), parts[2].try_cast("bigint").alias("worker")))


def logical_node(index: Column) -> Column:
    return F.concat(F.lit("go"), index.cast("string"))


def gap_marker(subscriber: Column, dropped: Column, sequence: Column, reason: Column) -> Column:
    return F.concat(subscriber, F.lit(":dropped="), dropped.cast("string"), F.lit(":through_seq="), sequence.cast("string"), F.lit(":"), reason)


def is_slow(subscriber: Column, every: int) -> Column:
    """Whether sub-<n> has n divisible by ``every``."""
    n = F.regexp_extract(subscriber, r"^sub-(\d+)$", 1).try_cast("bigint")
    return F.coalesce(n % every == 0, F.lit(False)) if every > 0 else F.lit(False)


def latency_ms(subscriber: Column, every: int, fast_ms: int, slow_ms: int) -> Column:
    return F.when(is_slow(subscriber, every), slow_ms).otherwise(fast_ms)


def register(spark: SparkSession) -> None:
    spark.udf.register("sign_delivery", sign_rows)
    spark.udf.register("verify_delivery", verify_rows)
