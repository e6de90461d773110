"""What the operators share: stored intermediate tables and connected components."""

from __future__ import annotations

import contextvars
import ctypes
import os
import pathlib
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.session import shared_folder

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package: Spark hands out an archive of its sources, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sources-")), f"{package.name}.zip")  # the driver serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


class Scope:
    """The stored tables and other things that one piece of work made, to be deleted together.

    `with Scope() as scope:` collects what is made inside, on this thread; `clear` deletes it, nothing else. What is
    made outside of any scope stays until its caller deletes it.
    """

    def __init__(self) -> None:
        self.undo: list[Callable[[], None]] = []

    def __enter__(self) -> Scope:
        self.token = _SCOPE.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _SCOPE.reset(self.token)

    def clear(self) -> None:
        while self.undo:
            self.undo.pop()()


_SCOPE: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)


def undo_later(action: Callable[[], None]) -> None:
    """Have the scope at work, if any, call `action` when it is cleared."""
    scope = _SCOPE.get()
    if scope is not None:
        scope.undo.append(action)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below `spark.checkpoint.dir`."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    undo_later(lambda: delete_folder(spark, folder))
    return folder


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet and read back: cut lineage, known size, survives lost executors."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._stored_in = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` returned and that nothing reads any more."""
    for table in tables:
        delete_folder(table.sparkSession, table._stored_in)


CACHES: list[dict] = []  # what modules keep in a worker from task to task


def tidy(keep: dict | None = None) -> None:
    """Give memory back to the system at the end of a task, for workers live on: caches but `keep`, and what is free."""
    for cache in CACHES:
        if cache is not keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


BITMAP_BITS = 23  # a bitmap of ids takes 1 MB, whatever their number


def may_hold(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """`rows` with a column `may`, false only where `key` is surely not in the one column of `ids`.

    Ids are hashed to a bitmap of fixed size, 256 rows of 4 KB, which is broadcast. Rows with long texts are then
    shuffled only where `may` is true. With very many ids the bitmap fills up and excludes less; results stay.
    """

    def spot(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS))

    spots = ids.select(spot(F.col(ids.columns[0])).alias("spot"))
    position = F.col("spot").bitwiseAND(F.lit(32767))
    bits = spots.groupBy(F.shiftright("spot", 15).alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bits"))
    bits = stored(bits, "bitmap")
    byte = F.conv(F.hex(F.substring("bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
    placed = rows.withColumn("spot", spot(key)).withColumn("bucket", F.shiftright("spot", 15))
    return placed.join(F.broadcast(bits), "bucket", "left").withColumn("may", may).drop("bucket", "bits", "spot")


def components(edges: DataFrame) -> DataFrame:
    """Smallest id that links reach, for every id in `edges` (a, b).

    Large-star and small-star rounds: every id points its neighbours to the smallest of them, until nothing
    changes. Minima are aggregated before the shuffle and joins are left to adaptive skew handling, so an id with
    very many links is no problem. Every round is written; the one before is deleted.

    Returns id, component, one row for each id of an edge between two different ids. No edges give no rows.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.distinct(), "links")
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct()
        )
        after = stored(small, "links")
        fresh = _mark(after)
        discard(now, large)
        now = after
        if fresh == mark:
            return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).transform(_with_roots)
        mark = fresh


def _with_roots(pointers: DataFrame) -> DataFrame:
    roots = pointers.select(F.col("component").alias("id"), "component").distinct()
    return pointers.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    # Order-free fingerprint of a set of edges; two 64-bit sums, wide enough that none overflows.
    sums = [F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *sums).first())


class Runs:
    """Rows of one key at a time from batches that are sorted by the key."""

    def __init__(self, batches: Iterable[pa.RecordBatch], key: tuple[str, ...]) -> None:
        self.batches, self.key = batches, key

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in self.batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in self.key]
            change = np.zeros(batch.num_rows, dtype=bool)
            for column in columns:
                change[1:] |= column[1:] != column[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for first, end in zip(cuts, cuts[1:], strict=False):
                key = tuple(column[first] for column in columns)
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(first, end - first))
                last = key
        if held:
            yield pa.Table.from_batches(held)
