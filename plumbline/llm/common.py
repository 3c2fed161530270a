"""What several corpus operators share: the shared folder, settled tables and running sums in a total order."""

from __future__ import annotations

import atexit
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_folder

_written: list[tuple[SparkSession, str]] = []
_kept: dict = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = new_folder(spark, name)
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_settled() -> None:
    """Delete all tables and files that this process has put below the shared folder."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # noqa: BLE001 - the session may be gone; the folder's owner cleans up then
            return


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again; others are left alone."""
    for df in tables:
        path = getattr(df, "settled_at", None)
        if path:
            _written.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


atexit.register(remove_settled)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet below the shared folder and read it back.

    Cuts lineage like checkpoint(), but computes df once only and survives any lost executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path  # for forget()
    return out


def kept(cache):
    """cache, an lru_cache of what a worker keeps from task to task, as one that let_go() empties."""
    _kept[cache.__name__] = cache
    return cache


def let_go(*but: str) -> None:
    """Empty this process's caches made by kept(), but those named."""
    for name, cache in _kept.items():
        if name not in but:
            cache.cache_clear()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *but: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in a worker that is used again.

    Before it the worker lets go of what tasks of other kinds have kept (see let_go); after it, it gives the
    memory it has freed back to the system.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(*but)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tasks_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Tasks to deal df out to: some `each` bytes of the files it is read from, or as many as a shuffle has, if that is more."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // each)) if size < 1 << 60 else least  # beyond: Spark doesn't know


def in_ranges(df: DataFrame, keys: list[str], name: str, tasks: int) -> DataFrame:
    """Settle df dealt out to `tasks` ranges of keys (ascending, nulls first), with the range's number as _pid.

    Meant for narrow rows: keys and numbers, not texts.
    """
    return settle(df.repartitionByRange(tasks, *keys).withColumn("_pid", F.spark_partition_id()), name)


def running_sum(
    ranged: DataFrame, order: list[str], weight: Column, into: str, by: list[str] | None = None
) -> DataFrame:
    """Add `into`: the sum of weight over all rows before this one in the total order.

    ranged comes from in_ranges with a prefix of `order` as keys. With `by`, sums restart for each value.
    One task never sees more than one range: sums of whole ranges are added up in a table that has a
    row for each range (and value of by), and only rows of the same range are sorted together.
    """
    by = by or []
    totals = ranged.groupBy("_pid", *by).agg(F.sum(weight).alias("_all"))
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_pid", *by, F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    same = [own["_pid"] == base["_pid"], *(own[c].eqNullSafe(base[c]) for c in by)]
    # Spark broadcasts base where it measures it to be small; else both sides are dealt out by these keys, as own already is
    joined = own.join(base, same, "left")
    return joined.select(*(own[c] for c in ranged.columns), (F.col("_own") + F.col("_base")).cast("long").alias(into))
