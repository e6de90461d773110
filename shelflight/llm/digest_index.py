"""Exact deduplication against a persistent index of digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.llm.shared import may_hold, stored, text_or_empty


class DigestIndex:
    """A table of (digest, keep_id), bucketed and sorted by digest; rows are only ever appended.

    `buckets` is the number of bucket files of one append and should follow the size that the index will reach
    (a digest takes about 45 bytes). The table lives in the warehouse, so a later run goes on with it by name.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64) -> None:
        self.spark, self.table, self.buckets = spark, table, buckets

    def rows(self) -> DataFrame | None:
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else None

    def absorb(self, digests: DataFrame) -> None:
        """Append the digests of (digest, doc_id) that the index lacks, each with its largest doc_id.

        A digest that is already there keeps its first keeper, whatever the new ids are.
        """
        fresh = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        known = self.rows()
        if known is not None:
            fresh = fresh.join(known.hint("merge"), "digest", "left_anti")
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))  # each written by one task, whatever the number of partitions
        (
            fresh.select("digest", "keep_id").repartition(self.buckets, bucket).write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the unchanged text in UTF-8; null counts as empty."""
    return docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document: which row of its equal texts stays.

    The whole texts are read once, for their digests; only (doc_id, digest) is stored and moved. The table is
    absorbed in `batches` ranges of falling doc_id, each joined against what the index holds by then, so the
    largest doc_id of equal texts is the one indexed. A document whose text an earlier run has indexed is dropped.
    Without `index` a new one serves this table alone and is dropped.

    Returns doc_id, keep_id, group_size (long, in this table), kept, text_sha256. Null text counts as empty. A null
    doc_id stays only if no equal text has an id; of rows that share text and doc_id all have the same result,
    which `keep_rows` resolves to one row. An empty table gives no rows. Other columns are not looked at.
    """
    own = index is None
    if own:
        index = new_index(docs.sparkSession)
    digests = stored(text_digests(docs), "digests")
    number = F.col("doc_id").cast("double")
    cuts = digests.select(F.percentile_approx(number, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts), reverse=True), None]
    for high, low in zip(edges, edges[1:], strict=False):
        part = digests
        if high is not None:
            part = part.where((number < high) | F.col("doc_id").isNull() if low is None else number < high)
        if low is not None:
            part = part.where(number >= low)
        index.absorb(part)
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    found = stored(sizes.join(index.rows().hint("merge"), "digest"), "digest-groups")
    if own:
        index.drop()
    return digests.join(found, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of `docs` that `deduplicate` keeps, one for each text, with all their columns.

    Only rows whose id may be that of a dropped row are joined with those. Rows that repeat both doc_id and text are told apart by
    a row number whose minimum is aggregated, so they may hold any share of the table. `docs` should be a stored
    table: the numbers follow its files.
    """
    key = [F.col("row.doc_id").alias("id"), F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256).alias("sha")]
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")).select("*", *key)
    theirs = [F.col("doc_id").alias("their_id"), F.col("text_sha256").alias("their_sha")]
    same = F.col("id").eqNullSafe(F.col("their_id")) & (F.col("sha") == F.col("their_sha"))
    dropped = stored(decided.where("NOT kept").select(*theirs).distinct(), "dropped")
    repeated = decided.where("kept AND group_size > 1").groupBy(*theirs).agg(F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated, "repeated")
    first = stored(
        rows.select("id", "sha", "number").join(repeated, same).groupBy("their_id", "their_sha")
        .agg(F.min("number").alias("first")), "first",
    )
    marked = may_hold(rows, F.col("id"), dropped.select("their_id"))
    unsure = marked.where("may").join(dropped, same, "left_anti")
    kept = marked.where("NOT may").unionByName(unsure).join(first, same, "left")
    return kept.where("first IS NULL OR first = number").select("row.*")


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index under a name of its own."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")
