"""Sinks: where claimed deliveries go.

A sink is a picklable callable from a row to (status code, error), or to None if no result
ever comes.  One with ``open`` is opened once for each partition of rows, as a client is.
"""

from __future__ import annotations

import http.client
import json
import urllib.parse
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import classify_attempt, envelope, headers, sign_rows

Sink = Callable[[dict], tuple[int | None, str | None] | None]
TIMEOUT_S, BODY_LIMIT, IDLE = 30.0, 1 << 20, 100


class Client:
    """Keeps up to ``idle`` connections open, one a host; the least used one goes."""

    def __init__(self, timeout: float, idle: int):
        self.timeout, self.idle = timeout, idle
        self.open: OrderedDict[tuple[str, str], http.client.HTTPConnection] = OrderedDict()

    def post(self, url: str, body: bytes, headers: dict) -> int:
        parts = urllib.parse.urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError(f"bad URL {url!r}")
        where = parts.scheme, parts.netloc
        target = urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, ""))
        kept = self.open.pop(where, None)
        for connection in ([kept] if kept else []) + [None]:  # a kept connection may have been closed meanwhile
            try:
                if connection is None:
                    kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
                    connection = kind(parts.netloc.rpartition("@")[2], timeout=self.timeout)
                connection.request("POST", target, body, headers)
                answer = connection.getresponse()
                answer.read(BODY_LIMIT)
            except (http.client.HTTPException, ConnectionError):
                connection.close()
                if connection is not kept:
                    raise
                continue
            except OSError:
                connection.close()
                raise
            if answer.will_close or not answer.isclosed():  # or the body was longer than the limit
                connection.close()
            else:
                self.open[where] = connection
                if len(self.open) > self.idle:
                    self.open.popitem(last=False)[1].close()
            return answer.status
        raise ConnectionError("no connection")

    def close(self) -> None:
        for connection in self.open.values():
            connection.close()


@dataclass(frozen=True)
class HttpSink:
    """POSTs a delivery's body; a network error is no status and an error text, a bad URL is refused."""

    timeout: float = TIMEOUT_S
    idle: int = IDLE

    def open(self) -> HttpSession:
        return HttpSession(Client(self.timeout, self.idle))

    def __call__(self, row: dict) -> tuple[int | None, str | None]:
        session = self.open()
        try:
            return session(row)
        finally:
            session.close()


@dataclass(frozen=True)
class HttpSession:
    client: Client

    def __call__(self, row: dict) -> tuple[int | None, str | None]:
        try:
            return self.client.post(row["url"], bytes(row["body"]), dict(row["headers"] or {})), None
        except ValueError as e:
            return 400, str(e)
        except (OSError, http.client.HTTPException) as e:
            return None, str(e) or type(e).__name__

    def close(self) -> None:
        self.client.close()


@dataclass(frozen=True)
class TableSink:
    """For tests and simulations: the answer is a function of the subscriber, sequence and attempt."""

    answer: Callable[[str, int, int], tuple[int | None, str | None]]

    def __call__(self, row: dict) -> tuple[int | None, str | None]:
        return self.answer(row["subscriber_id"], row["sequence"], row["attempt"])


@dataclass(frozen=True)
class HoldingSink:
    """Withholds the results of one subscriber's deliveries, which stay in flight; the others succeed."""

    subscriber: str

    def __call__(self, row: dict) -> tuple[int | None, str | None] | None:
        return None if row["subscriber_id"] == self.subscriber else (200, None)


def fault(subscriber: str, seq: int, attempt: int) -> bool:
    """Whether a receiver fails this attempt: the first one, where the 31-hash of "sub:seq" divides by 17."""
    h = 0
    for byte in f"{subscriber}:{seq}".encode():
        h = (h * 31 + byte) % 2**64
    return attempt == 1 and min(h, 2**64 - h) % 17 == 0


@dataclass(frozen=True)
class FaultSink:
    """A receiver with faults that are the same in every run: 400 for a body without a positive data.seq, 500 for ``fault``, else 200."""

    def __call__(self, row: dict) -> tuple[int | None, str | None]:
        try:
            seq = json.loads(bytes(row["body"]))["data"]["seq"]
        except (ValueError, KeyError, TypeError):
            return 400, None
        if not isinstance(seq, int) or seq <= 0:
            return 400, None
        return (500, None) if fault(row["subscriber_id"], seq, row["attempt"]) else (200, None)


def prepare(claimed: DataFrame, now_unix: int) -> DataFrame:
    """Body, signature and headers of each claimed row, made once.  The payload is the JSON that was enqueued."""
    body = F.encode(envelope(F.col("event_id"), F.col("event_type"), F.decode("payload", "UTF-8")), "UTF-8")
    rows = claimed.withColumn("body", body).withColumn("signature", sign_rows("secret", F.lit(now_unix), "body"))
    return rows.withColumn("headers", headers(F.col("event_type"), F.col("event_id"), F.col("id"), F.col("signature")))


def attempt(prepared: DataFrame, sink: Sink) -> DataFrame:
    """Claimed rows with code, err and outcome; rows whose result never came aren't among them.

    Write it before it is used: a recomputed task would send again.  Delivery is at least
    once; receivers tell repeats by the delivery id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = sink.open() if hasattr(sink, "open") else sink
        try:
            for b in batches:
                rows = b.to_dict("records")
                found = [opened(r) if r["url"] else (None, "no url") for r in rows]
                came = [(r["id"], *f) for r, f in zip(rows, found, strict=True) if f is not None]
                yield pd.DataFrame({"id": pd.Series([c[0] for c in came], dtype=object), "code": pd.array([c[1] for c in came], dtype="Int32"), "err": pd.Series([c[2] for c in came], dtype=object)})
        finally:
            if opened is not sink:
                opened.close()

    columns = [c for c in ("id", "event_id", "subscriber_id", "sequence", "attempt", "url", "body", "headers") if c in prepared.columns]
    results = prepared.select(*columns).mapInPandas(run, "id string, code int, err string")
    joined = prepared.drop("body", "headers", "signature").join(results, "id")
    return joined.withColumn("outcome", classify_attempt(F.col("code"), F.col("err"), F.col("url")))


def attempt_log(results: DataFrame) -> DataFrame:
    """(claimed_at, partition, subscriber_id, sequence, event_id, url, attempt, code, err, outcome) of every call, ordered as claims are."""
    return results.select("claimed_at", "partition", "subscriber_id", "sequence", "event_id", "url", "attempt", "code", "err", "outcome").orderBy("claimed_at", "partition", "subscriber_id", "sequence")


def delivered_log(results: DataFrame) -> DataFrame:
    """(subscriber_id, event_id, sequence, url) of what went through."""
    return results.where(F.col("outcome") == "success").select("subscriber_id", "event_id", "sequence", "url")
