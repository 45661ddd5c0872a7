"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null doc_id inside operators: smaller than any real id.
NULL_ID = -(2**63)

#: Values of a sampling column up to which their counts are broadcast.
BROADCAST_VALUES = 10_000

#: Values of a key joined by broadcast: those with at least 1/HOT_KEYS of the rows and HOT_LEAST rows.
HOT_KEYS, HOT_LEAST = 500, 64

#: Rows up to which a join with one row a key broadcasts all its keys.
FEW_ROWS = 10_000

#: Rows a file, and least number of files, of tables whose number of rows is known when they are written.
FILE_ROWS, LEAST_FILES = 1 << 18, 8

#: Bytes of text that become Python objects at a time.
SLICE_BYTES = 4 << 20

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder under ``spark.checkpoint.dir``.

    The setting is read from the session.  Only where it is unset and the master is local
    (tests on one machine) a temporary folder is made and set; a cluster without the setting
    is refused, as executors would write to disks of their own.  The folder is deleted when
    the driver's Python ends; ``free`` deletes tables before that.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _roots:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tideline-")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/tideline-{app}"
        atexit.register(_delete, spark, _roots[app])
    return _roots[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM may have gone first; the cluster's own cleaning then applies
        return


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``rows``: about how many rows there are, where known; few rows make few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once all that read them is written itself."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the disk of finished queries' shuffles go: Spark deletes them when the driver's JVM collects its garbage, which a large heap may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_parts(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: like ``cut``, but partitions and their order stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_col(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def matching(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are ("left_semi") or aren't ("left_anti") among found (id, and sha: text's SHA-256, if there).

    Columns of ``docs`` may have any names.
    """
    on = id_col("docs.doc_id") == F.col("found.id")
    if "sha" in found.columns:
        on &= F.sha2(text_col("docs.text"), 256) == F.col("found.sha")
    return docs.alias("docs").join(found.alias("found"), on, how)


def keep_rows(docs: DataFrame, keep: DataFrame, again: DataFrame | None) -> DataFrame:
    """Rows of ``docs`` whose (id, sha) is in ``keep``, one of each; columns of any names as they were.

    ``again``: the (id, sha) that several rows hold, None if no row repeats one.
    """
    kept = matching(docs, keep, "left_semi")
    if again is None:
        return kept
    once, twice = matching(kept, again, "left_anti"), matching(kept, again, "left_semi")
    whole = twice.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_col().alias("id"), F.sha2(text_col(), 256).alias("sha"))
    return once.unionByName(whole.dropDuplicates(["id", "sha"]).select("row.*"))


def own_rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang and text of ``docs``, with the struct (id, sha) as doc_id: what an operator finds out goes to rows of that text alone, though ids may be null or repeat."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct(id_col().alias("id"), F.sha2(text_col(), 256).alias("sha")).alias("doc_id"), lang.alias("lang"), text_col().alias("text"))


def join_one(rows: DataFrame, key: str, lookup: DataFrame, total: int, few: int = FEW_ROWS) -> DataFrame:
    """Inner join of ``rows``, ``total`` in number, with ``lookup``, which has one row a value of ``key``, without a hot task.

    Up to ``few`` rows, the values that they hold are broadcast.  Beyond that, values that
    more than 1/HOT_KEYS of ``rows`` hold, so at most HOT_KEYS of them, are broadcast and
    the others are shuffled.  ``rows`` is read several times: a written table.
    """
    if total <= few:
        return rows.join(F.broadcast(lookup.join(F.broadcast(rows.select(key).distinct()), key, "left_semi")), key)
    least = max(HOT_LEAST, -(-total // HOT_KEYS))
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key))
    by_value = rows.join(F.broadcast(lookup.join(hot, key, "left_semi")), key)
    return by_value.unionByName(rows.join(hot, key, "left_anti").join(lookup, key))


def join_flagged(rows: DataFrame, keys: list[str], lookup: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has one row a key and marks the few hot keys in ``hot``.

    Hot keys, at most HOT_KEYS of them, are broadcast; the others are shuffled.  Both are
    read several times: written tables.
    """
    hot, others = F.broadcast(lookup.where("hot").drop("hot")), lookup.where("NOT hot").drop("hot")
    cold = rows.join(F.broadcast(lookup.where("hot").select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(others, keys))


def smallest_hashes(rows: DataFrame, by: str, k: int) -> DataFrame:
    """Of each value of ``by`` the ``k`` rows (doc_id, by) of smallest hash of doc_id; adds that hash, r.

    Counts come first and a hash bound keeps about 2 k rows a value, so that ranking
    handles rows in proportion to k and not to the number of tasks.
    """
    hashed = rows.withColumn("r", F.pmod(F.xxhash64("doc_id"), F.lit(2**53)))
    counts = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    counts = counts.sparkSession.createDataFrame(few, counts.schema) if len(few := counts.head(BROADCAST_VALUES + 1)) <= BROADCAST_VALUES else counts
    near = hashed.join(F.broadcast(counts) if len(few) <= BROADCAST_VALUES else counts, F.col(by) == F.col("__by")).where(F.col("r") <= F.lit(float(2**53)) * (2.0 * k + 100) / F.col("__n"))
    ranked = near.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy("r", "doc_id")))
    return ranked.where(F.col("__rank") <= k).drop("__by", "__n", "__rank")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to few rows and, but for single longer rows, ``size`` bytes of text, so that Python objects of few rows exist at a time.

    After the last one, freed memory goes back: workers wait for later tasks with it.
    """
    for b in batches:
        upto = np.zeros(b.num_rows, dtype=np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                upto += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(upto)
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
            end = min(b.num_rows, at + rows, max(at + 1, end))
            yield b.slice(at, end - at)
            at = end
        del b
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def longs(column: pa.Array) -> np.ndarray:
    """An int column without nulls as numpy."""
    return column.to_numpy(zero_copy_only=False)


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
