"""Helpers shared by the operators of this subpackage: checkpoints, text bytes of Arrow columns, ranks, components."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.session import ensure_checkpoint_dir, shuffles_dropped

BLOCK_BYTES = 4 << 20  # bytes of text that the numpy code of a task works on at a time


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as Parquet below the shared checkpoint folder; what was shuffled for them is dropped."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``checkpointed``, in partitions of about ``rows`` rows: small tables don't leave a file for each of many tasks."""
    stored = checkpointed(df)
    return stored.coalesce(max(1, -(-stored.count() // rows)))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES):
    """Slices of record batches with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def row_key(*columns: str | Column) -> Column:
    """64-bit identity of a row from its id and text; repeated rows share it."""
    return F.xxhash64(*columns)


def gapless_rank(df: DataFrame, key: str, order: list[str], name: str, rows_per_group: int = 200_000) -> DataFrame:
    """Rows with ``name``: 0, 1, 2, ... within each value of the non-null column ``key``, in an order that ``order`` decides.

    A value may hold any share of the rows: rows are dealt to salts by a hash of ``order``, counted per (key, salt), and
    numbered within their salt from the number of rows in earlier salts. ``df`` should be cheap to read twice.
    """
    salts = max(1, -(-df.count() // rows_per_group))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_rows"))
              .select(key, "_salt", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")))
    within = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    return (salted.join(starts, [key, "_salt"]).withColumn(name, F.col("_start") + within - 1)
            .drop("_salt", "_start"))


def components(edges: DataFrame, stored=checkpointed) -> DataFrame:
    """(node, root) for every node of ``edges`` (long u, v); root is the smallest node it is connected to.

    Alternating large and small stars: each round hangs neighbours below the smallest node they know. Minima are
    combined before the exchange, hubs meet their one minimum in a join that can be split, and every round is
    checkpointed (by ``stored``). Self-links are kept as nodes.
    """
    loops = edges.where("u = v").select(F.col("u").alias("node")).distinct()
    links = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == state:
            break
        state = now
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    linked = found.union(roots)
    return linked.union(loops.join(linked, "node", "left_anti").select("node", F.col("node").alias("root")))
