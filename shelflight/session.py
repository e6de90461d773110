"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Adaptive execution sizes the shuffle partitions, splits skewed joins and turns
# a join into a broadcast only when the measured size is below the threshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tables of many columns make long methods, which the JVM interprets from 8,000 bytes on: such stages go without.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "shelflight", master: str | None = None, **extra: str) -> SparkSession:
    """A session with these settings; `extra` uses `__` for the dots of a name."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for name, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Apply the runtime settings to a session built elsewhere."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a folder in the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def code_boundary(df: DataFrame) -> DataFrame:
    """The same rows; what is done to them next is compiled apart from what made them.

    Spark compiles all steps between two shuffles together and gives that up for all of them if they make one method too
    long (`SETTINGS`). Each then copies every row. A row count, of which nothing is read, ends the compiled part, so the
    steps before it stay together. Filters stay above it, and it keeps all columns: for a step that reads them anyway.
    """
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Have what the jobs run here have shuffled deleted as each ends, instead of when the driver's memory is next cleared.

    For jobs of which nothing is run again: their results are stored or came to the driver.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)


class Scratch:
    """Collects the folders that `written` makes inside it, so that they can go once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []

    def __enter__(self) -> Scratch:
        self._token = _SCRATCH.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _SCRATCH.reset(self._token)

    def drop(self) -> None:
        while self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet, in a new folder below the shared one, and read back.

    Unlike a checkpoint it computes the rows once, and its columns are read as needed. The folder stays until the
    shared folder is emptied or a `Scratch` drops it; what was shuffled on the way goes.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if (scratch := _SCRATCH.get()) is not None:
        scratch.folders.append(folder)
    with shuffles_dropped(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
