"""Files written by the stages. Every task writes its own part; nothing is merged."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """`compression` (gzip) is for text that a later stage reads back: one task then reads each part as a whole."""
    df.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression=compression
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The one-row summary as a JSON document."""
    summary.write.mode("overwrite").json(path)
