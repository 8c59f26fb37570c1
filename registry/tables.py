"""Access to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscan.session import apply_settings, scratch_folder


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Rows a task renders pages of: seconds of work, and few enough for small workers.
_ROWS_PER_TASK = 25_000


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly to as many tasks as there are cores, or more when there are many rows.

    Splits of a file are as uneven as its row groups, and some of them are empty. The rows of a
    table of Parquet files are counted from the footers. Applied to the compact rows the pages
    are rendered from, never to html.
    """
    if df.isStreaming:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks(df))


def tasks(df: DataFrame) -> int:
    """As many tasks as there are cores, or more when there are many rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // _ROWS_PER_TASK))


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


scratch = scratch_folder
