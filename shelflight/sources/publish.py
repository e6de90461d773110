"""The four published tables: conforming to their schemas and writing them."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.functions import exact_sum
from shelflight.schema import PUBLISHED_SCHEMAS, type_names

# Published name -> name in the stage's table, where they differ.
_SOURCES = {"Historical_Revenue": "Revenue"}
# Filled with the time of the load.
_LOAD_TIMES = {"predictions": "Prediction_Date", "recommendations": "Created_At", "revenue": "Report_Date"}


def conform_table(df: DataFrame, table: str, loaded_at: dt.datetime) -> DataFrame:
    """Columns of a published table in order and type; absent ones are null."""
    present = {c.lower(): c for c in df.columns}
    kinds = type_names(df)
    columns = []
    for field in PUBLISHED_SCHEMAS[table].fields:
        source = present.get(_SOURCES.get(field.name, field.name).lower())
        if field.name == _LOAD_TIMES.get(table):
            value = F.lit(loaded_at.isoformat(sep=" ")).cast("timestamp_ntz")
        elif source is None:
            value = F.lit(None).cast(field.dataType)
        elif kinds[source] == "string" and field.dataType.simpleString() != "string":
            value = F.col(f"`{source}`").try_cast(field.dataType)
        else:
            value = F.col(f"`{source}`").cast(field.dataType)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def published_tables(
    engineered: DataFrame, scored: DataFrame, recommendations: DataFrame, loaded_at: dt.datetime
) -> dict[str, DataFrame]:
    return {
        "inventory": conform_table(engineered, "inventory", loaded_at),
        "predictions": conform_table(scored, "predictions", loaded_at),
        "revenue": conform_table(scored, "revenue", loaded_at),
        "recommendations": conform_table(recommendations, "recommendations", loaded_at),
    }


def publish(tables: dict[str, DataFrame], sink: str, properties: dict[str, str] | None = None) -> None:
    """Replace the tables at the sink: all of them, or none if a write fails.

    A name ending in a slash or holding one is a folder for parquet, anything else a catalog database. There a new
    generation of all tables is written first; then one entry in the manifest makes it the one that is read
    (`read_published`, in a database also the views of the tables' names). Earlier generations stay for readers
    at work until `drop_generations`. A JDBC url writes to that database in parallel connections, one table
    after another, and has no generations.
    """
    if sink.startswith("jdbc:"):
        for name, df in tables.items():
            df.write.mode("overwrite").option("truncate", "true").jdbc(sink, name, properties=properties or {})
        return
    spark, generation = next(iter(tables.values())).sparkSession, uuid.uuid4().hex[:12]
    store = _Folder(spark, sink.rstrip("/")) if "/" in sink else _Database(spark, sink)
    number = max(store.generations(), default=(0, ""))[0] + 1
    for name, df in tables.items():
        store.write(name, df, generation)
    store.enter(number, generation, list(tables))


def read_published(spark: SparkSession, sink: str) -> dict[str, DataFrame]:
    """The tables of the last generation that was published whole."""
    store = _Folder(spark, sink.rstrip("/")) if "/" in sink else _Database(spark, sink)
    found = max(store.generations(), default=None)
    if found is None:
        raise FileNotFoundError(f"nothing was published at {sink}")
    return store.read(found[1])


def drop_generations(spark: SparkSession, sink: str, keep: int = 1) -> None:
    """Delete all but the last `keep` generations (with 0 all of them), and what failed writes left."""
    store = _Folder(spark, sink.rstrip("/")) if "/" in sink else _Database(spark, sink)
    found = sorted(store.generations())
    store.drop({generation for _, generation in found[max(0, len(found) - keep) :]})


class _Folder:
    """Generations as folders; a manifest entry is an empty file, whose name has number and generation."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return [f.getPath().getName() for f in self.files.listStatus(place)] if self.files.exists(place) else []

    def generations(self) -> list[tuple[int, str]]:
        entries = [name.split("-") for name in self._names(f"{self.folder}/_manifest")]
        return [(int(number), generation) for number, generation in entries]

    def write(self, name: str, df: DataFrame, generation: str) -> None:
        df.write.parquet(f"{self.folder}/{generation}/{name}")

    def enter(self, number: int, generation: str, names: list[str]) -> None:
        # Fails if another publisher took the number meanwhile.
        self.files.create(self.path(f"{self.folder}/_manifest/{number:09d}-{generation}"), False).close()

    def read(self, generation: str) -> dict[str, DataFrame]:
        place = f"{self.folder}/{generation}"
        return {name: self.spark.read.parquet(f"{place}/{name}") for name in sorted(self._names(place))}

    def drop(self, kept: set[str]) -> None:
        for name in self._names(f"{self.folder}/_manifest"):
            if name.split("-")[1] not in kept:
                self.files.delete(self.path(f"{self.folder}/_manifest/{name}"), False)
        for name in set(self._names(self.folder)) - kept - {"_manifest"}:
            self.files.delete(self.path(f"{self.folder}/{name}"), True)


class _Database:
    """Generations as tables named by them; the manifest is a table, and views of the plain names follow it."""

    def __init__(self, spark: SparkSession, database: str) -> None:
        self.spark, self.database = spark, database

    def _tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables(self.database) if t.tableType != "VIEW"]

    def generations(self) -> list[tuple[int, str]]:
        if not self.spark.catalog.tableExists(f"{self.database}.published_generations"):
            return []
        return [tuple(row) for row in self.spark.table(f"{self.database}.published_generations").collect()]

    def write(self, name: str, df: DataFrame, generation: str) -> None:
        df.write.saveAsTable(f"{self.database}.{name}_{generation}")

    def enter(self, number: int, generation: str, names: list[str]) -> None:
        entry = self.spark.range(1).select(F.lit(number).alias("number"), F.lit(generation).alias("generation"))
        entry.write.mode("append").saveAsTable(f"{self.database}.published_generations")
        for name in names:
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.database}.{name} AS SELECT * FROM {self.database}.{name}_{generation}")

    def read(self, generation: str) -> dict[str, DataFrame]:
        names = [name for name in self._tables() if name.endswith(f"_{generation}")]
        return {name.removesuffix(f"_{generation}"): self.spark.table(f"{self.database}.{name}") for name in sorted(names)}

    def drop(self, kept: set[str]) -> None:
        for name in self._tables():
            if name != "published_generations" and name.rsplit("_", 1)[-1] not in kept:
                self.spark.sql(f"DROP TABLE {self.database}.{name}")


def product_view(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables linked by product, one row per product of the inventory.

    A product has many lines in every table, so the tables are totalled per
    product first: the joins are one to one, share the partitioning of the
    totals, and a frequent product never meets all its own copies.
    """
    inventory = tables["inventory"].groupBy("Product_ID").agg(
        F.count(F.lit(1)).alias("inventory_lines"),
        exact_sum(F.col("Inventory_Value")).alias("inventory_value"),
    )
    predictions = tables["predictions"].groupBy("Product_ID").agg(
        exact_sum(F.col("Predicted_Revenue_at_Risk")).alias("predicted_risk"),
        F.min("Predicted_Inventory_Health").alias("lowest_health"),
    )
    revenue = tables["revenue"].groupBy("Product_ID").agg(
        exact_sum(F.col("Historical_Revenue")).alias("historical_revenue"),
        exact_sum(F.col("Predicted_Revenue")).alias("predicted_revenue"),
    )
    advice = tables["recommendations"].groupBy("Product_ID").agg(
        F.count(F.lit(1)).alias("recommendations"),
        exact_sum(F.col("Expected_Revenue_Recovery")).alias("expected_recovery"),
    )
    joined = inventory
    for side in (predictions, revenue, advice):
        joined = joined.join(side, "Product_ID", "left")
    return joined.na.fill(0, subset=["recommendations", "expected_recovery"])
