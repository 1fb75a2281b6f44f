"""Exact cosine top-k of a batch of query vectors over a vector table.

Vectors are scored where they lie: each Arrow batch is one matrix product with the query block and emits only its own
top-k. The query block is broadcast when a count shows that it is small; larger batches go through a grid of
(vector tile, query block) cells joined on the cell key, so that no task holds more than one tile and one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULTS
from gleanery.functions.vectors import ARROW, best_rows, matrix, order_keys, undefined_products, unit_rows
from gleanery.operators.ranking import top_k

NUDGE = 1e-9  # moves cosines that are short binary fractions off the rounding boundary, where the last bit would decide
MAX_BROADCAST_QUERIES = 4096
TILE_ROWS = 65_536
BLOCK_ROWS = 4096


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULTS.retrieval_top_k,
    where: Column | None = None,
    threshold: float = 0.0,
    id_col: str = "id",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Ranked (query_id, id, score, rank). ``where`` filters the payload before the search; scores are cosines."""
    base = (vectors.where(where) if where is not None else vectors).select(F.col(id_col).alias("id"), "embedding")
    base = base.where(F.size("embedding") > 0)
    id_type = base.schema["id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, raw double"

    head = queries.select("query_id", "embedding").limit(max_broadcast_queries + 1).collect()
    if len(head) <= max_broadcast_queries:
        candidates = _by_broadcast(base, head, k, threshold, schema)
    else:
        candidates = _by_grid(base, queries, k, threshold, schema, tile_rows)
    nudged = candidates.withColumn("raw", F.col("raw") + NUDGE)
    ranked = top_k(nudged, ["query_id"], [F.round("raw", 6).desc(), F.col("id")], k)
    return ranked.select("query_id", "id", F.round("raw", 4).alias("score"), F.col("rank").cast("bigint"))


def _emit(query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, threshold: float) -> dict:
    """Top-k of every query row of a (queries x vectors) score matrix."""
    out_q, out_i, out_s = [], [], []
    keys = order_keys(ids)
    for row, query_id in enumerate(query_ids):
        best = best_rows(scores[row] + NUDGE, keys, k)
        if threshold > 0:
            best = best[scores[row, best] >= threshold]
        out_q.append(np.repeat(query_id, len(best)))
        out_i.append(ids[best])
        out_s.append(scores[row, best])
    return {"query_id": np.concatenate(out_q), "id": np.concatenate(out_i), "raw": np.concatenate(out_s)}


def _by_broadcast(base: DataFrame, query_rows: list, k: int, threshold: float, schema: str) -> DataFrame:
    spark = base.sparkSession
    if not query_rows:
        return spark.createDataFrame([], schema)
    block = spark.sparkContext.broadcast((
        np.array([r["query_id"] for r in query_rows]),
        unit_rows(np.array([r["embedding"] for r in query_rows], dtype=np.float64))))

    out = pa.schema([(name, ARROW[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])

    def score(batches):
        query_ids, q = block.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            scores = undefined_products(q, unit_rows(matrix(batch.column(1))))
            yield pa.RecordBatch.from_pydict(_emit(query_ids, scores, ids, k, threshold), schema=out)

    return base.mapInArrow(score, schema)


def _by_grid(base: DataFrame, queries: DataFrame, k: int, threshold: float, schema: str, tile_rows: int) -> DataFrame:
    tiles = max(1, -(-base.count() // tile_rows))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    left = base.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select("query_id", F.col("embedding").alias("query_embedding")).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))))

    def cell(vectors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or block.empty:
            return pd.DataFrame({"query_id": [], "id": [], "raw": []})
        m = unit_rows(np.stack(vectors["embedding"].to_numpy()).astype(np.float64))
        q = unit_rows(np.stack(block["query_embedding"].to_numpy()).astype(np.float64))
        return pd.DataFrame(_emit(block["query_id"].to_numpy(), undefined_products(q, m), vectors["id"].to_numpy(), k, threshold))

    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInPandas(cell, schema)


def attach_text(results: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Fill the text of each hit from a lookup table; a hit without an entry keeps what it has."""
    lookup = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("looked_up"))
    current = F.col("text") if "text" in results.columns else F.lit("")
    return results.join(lookup, "id", "left").withColumn("text", F.coalesce("looked_up", current)).drop("looked_up")
