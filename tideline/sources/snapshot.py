"""Durable state: versions of Parquet tables with one CURRENT marker.

Live deliveries (pending, in flight, retained) lie by partition; a change rewrites the
partitions it touches and no others.  Finished ones (delivered, dead letters) never
change again: each version adds its own, and no later one copies them.  So what a step
writes follows what it claims, not the history.  A version's MANIFEST says in which
versions its live partitions and other tables lie.

A version's folder is complete before its CURRENT marker exists, and is never changed
after; so a reader has a whole state, and a driver that dies halfway leaves the last one.
One driver writes.  Paths go through Hadoop's file system, so any store that Spark
writes will do.  Columns that older files lack get their defaults.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.enqueue import State
from tideline.schemas import COUNTER, DEAD, DELIVERED, DELIVERY, OWNER, SUBSCRIBER

OTHERS = {"subscribers": SUBSCRIBER, "subscriber_seq": COUNTER, "partition_owners": OWNER}
TABLES = {"deliveries": DELIVERY} | OTHERS
FINISHED = (DELIVERED, DEAD)
#: Columns that came later, and what files from before mean by their absence.
DEFAULTS = {"secret": "X''", "last_error": "''", "attempt": "0", "generation": "0L"}


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._read: dict[str, DataFrame] = {}
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, marker: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/{marker}"))
        return sorted(int(s.getPath().getName().split("-")[-1].split("=")[-1]) for s in found or [])

    def version(self) -> int:
        """The current version; 0 if there is none."""
        return max(self._versions("CURRENT-*"), default=0)

    def manifest(self, n: int | None = None) -> dict:
        n = self.version() if n is None else n
        if not n:
            return {"live": {}, "tables": {}, "batch": -1}
        stream = self._fs.open(self._path(f"{self.path}/v={n}/MANIFEST"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def batch(self) -> int:
        """The last batch of a stream that is in the state; -1 if there is none."""
        return self.manifest()["batch"]

    def empty(self) -> State:
        return State(*(self.spark.createDataFrame([], s) for s in TABLES.values()))

    def _rows(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(DELIVERY).option("recursiveFileLookup", "true")  # the folders' names aren't columns
        rows = reader.parquet(*paths) if paths else self.spark.createDataFrame([], DELIVERY)
        return rows.withColumns({c: F.coalesce(F.col(c), F.expr(v).cast(rows.schema[c].dataType)) for c, v in DEFAULTS.items()})

    def read(self, live: bool = False) -> State:
        """The current state.  live: without finished deliveries."""
        n = self.version()
        m = self.manifest(n)
        paths = [f"{self.path}/v={v}/rows/kind=live/bucket={b}" for b, v in m["live"].items()]
        rows = self._rows(paths)
        if not live:
            rows = rows.unionByName(self._rows([p for v in self._versions("v=*") if v <= n and self._fs.exists(self._path(p := f"{self.path}/v={v}/rows/kind=finished"))]))
        others = {t: self.spark.read.schema(s).parquet(f"{self.path}/v={m['tables'][t]}/{t}") if t in m["tables"] else self.spark.createDataFrame([], s) for t, s in OTHERS.items()}
        self._read = others
        return State(rows, **others)

    def write(self, state: State, partitions: list[int] | None = None, batch: int | None = None) -> State:
        """The live state as read back from the new version.

        partitions: those whose deliveries, live and newly finished, ``state`` has; the live rows
        of others stay.  None: it has all live rows, and those newly finished.  batch: of the
        stream it came from.  Tables that are as they were read aren't written.
        """
        before = self.manifest(n := self.version())
        n += 1
        folder = f"{self.path}/v={n}"
        self._fs.delete(self._path(folder), True)  # what a driver that died left behind
        rows = state.deliveries if partitions is None else state.deliveries.where(F.col("partition").isin(partitions))
        rows = rows.withColumn("kind", F.when(F.col("status").isin(*FINISHED), "finished").otherwise("live")).withColumn("bucket", F.col("partition"))
        rows.hint("rebalance", "kind", "bucket").write.partitionBy("kind", "bucket").parquet(f"{folder}/rows")
        found = self._fs.globStatus(self._path(f"{folder}/rows/kind=live/bucket=*"))
        mine = {s.getPath().getName().split("=")[1]: n for s in found or []}
        kept = {} if partitions is None else {b: v for b, v in before["live"].items() if int(b) not in set(partitions)}
        tables = dict(before["tables"])
        for t, schema in OTHERS.items():
            df: DataFrame | None = getattr(state, t)
            if df is not None and df is self._read.get(t):
                continue
            if t == "partition_owners" and t in tables and (df is None or df.isEmpty()) and not self._read[t].isEmpty():
                raise ValueError("owner rows can't be cleared while there are any")
            (self.spark.createDataFrame([], schema) if df is None else df).write.parquet(f"{folder}/{t}")
            tables[t] = n
        manifest = {"live": kept | mine, "tables": tables, "batch": before["batch"] if batch is None else batch}
        out = self._fs.create(self._path(f"{folder}/MANIFEST"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.create(self._path(f"{self.path}/CURRENT-{n}"), False).close()  # the one step that makes it current
        self._forget(n)
        return self.read(live=True)

    def _forget(self, n: int) -> None:
        """Deletes markers of old versions, and what no version kept refers to; finished rows stay."""
        current = self._versions("CURRENT-*")
        for old in current[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/CURRENT-{old}"), False)
        used: set[str] = set()
        for v in current[-self.keep :]:
            m = self.manifest(v)
            used |= {f"v={x}/rows/kind=live/bucket={b}" for b, x in m["live"].items()} | {f"v={x}/{t}" for t, x in m["tables"].items()} | {f"v={v}/MANIFEST"}
        for v in self._versions("v=*"):
            if v > n - self.keep:
                continue
            for pattern in (f"v={v}/rows/kind=live/bucket=*", *(f"v={v}/{t}" for t in OTHERS), f"v={v}/MANIFEST"):
                for s in self._fs.globStatus(self._path(f"{self.path}/{pattern}")) or []:
                    if "v=" + s.getPath().toString().rpartition("/v=")[2] not in used:
                        self._fs.delete(s.getPath(), True)

    def keep_results(self, results: DataFrame) -> DataFrame:
        """Results of attempts, durable before anything is marked by them; those of the claim before go."""
        path = f"{self.path}/results-{self.version()}"
        for s in self._fs.globStatus(self._path(f"{self.path}/results-*")) or []:
            self._fs.delete(s.getPath(), True)
        results.write.parquet(path)
        return self.results()

    def results(self) -> DataFrame | None:
        """Those of the last claim that had any."""
        found = self._fs.globStatus(self._path(f"{self.path}/results-*"))
        return self.spark.read.parquet(found[0].getPath().toString()) if found else None


class MemoryStore:
    """The same store without files, for tests and trials: frames that are cut from their plans and kept in memory.

    It ends with the application, and a lost executor loses it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._version, self._batch = spark, 0, -1
        self._state = State(*(spark.createDataFrame([], s) for s in TABLES.values()))
        self._results: DataFrame | None = None

    def version(self) -> int:
        return self._version

    def batch(self) -> int:
        return self._batch

    def _kept(self, df: DataFrame, schema: str) -> DataFrame:
        return self.spark.createDataFrame(df.select(*self.spark.createDataFrame([], schema).columns).toArrow(), schema).cache()

    def read(self, live: bool = False) -> State:
        s = self._state
        return State(s.deliveries.where(~F.col("status").isin(*FINISHED)) if live else s.deliveries, s.subscribers, s.subscriber_seq, s.partition_owners)

    def write(self, state: State, partitions: list[int] | None = None, batch: int | None = None) -> State:
        old = self._state
        rows = state.deliveries if partitions is None else state.deliveries.where(F.col("partition").isin(partitions))
        done = old.deliveries.where(F.col("status").isin(*FINISHED))
        rows = rows.join(done.select("id"), "id", "left_anti").select(*done.columns)  # finished rows stay as they are
        others = old.deliveries.where(~F.col("status").isin(*FINISHED) & ~F.col("partition").isin(partitions)) if partitions else old.deliveries.where(~F.col("status").isin(*FINISHED) & F.lit(partitions is not None))
        kept = {t: getattr(old, t) if getattr(state, t) is getattr(old, t) else self._kept(self.spark.createDataFrame([], s) if getattr(state, t) is None else getattr(state, t), s) for t, s in OTHERS.items()}
        self._state = State(self._kept(done.unionByName(others).unionByName(rows), DELIVERY), **kept)
        self._version += 1
        self._batch = self._batch if batch is None else batch
        return self.read(live=True)

    def keep_results(self, results: DataFrame) -> DataFrame:
        self._results = self.spark.createDataFrame(results.toArrow()).cache()
        return self._results

    def results(self) -> DataFrame | None:
        return self._results


def register_views(state: State) -> None:
    """Temporary views for status queries: deliveries, subscribers, ownership, and health (status, n)."""
    state.deliveries.createOrReplaceTempView("deliveries")
    state.subscribers.createOrReplaceTempView("subscribers")
    if state.partition_owners is not None:
        state.partition_owners.createOrReplaceTempView("ownership")
    state.deliveries.groupBy("status").agg(F.count("*").alias("n")).createOrReplaceTempView("health")
