"""Readers for the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXT_TABLES = ("documents", "pages", "conversations")  # the tables whose rows are costly to process


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


ROWS_A_TASK = 25_000


def spread(df: DataFrame, rows: int = 0) -> DataFrame:
    """Use all cores on a table stored in fewer splits than there are cores; a no-op for tables of ordinary size.

    ``rows``, where it is known, asks for a task per 25,000 rows too, so that no task grows with the table.

    A file with one row group is one task, however costly the expressions on it are. Column pruning and filters still
    reach the scan through the round-robin exchange.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` in at least as many tasks as there are cores, one per 25,000 of its ``rows``, by a hash of its unique ``key``.

    Nothing is run to learn the present number of tasks, and no task sorts its rows, as a round-robin exchange does.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), key)
