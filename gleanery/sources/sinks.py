"""Writers of records, tables and their summaries. Every writer replaces or appends whole tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.documents import summarize


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report (already aggregated rows) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_crawl(pages: DataFrame, folder: str, now: datetime | None = None) -> str:
    """Page records under ``crawl_<timestamp>.jsonl`` and counts per page type; returns the path."""
    path = f"{folder}/crawl_{(now or datetime.now(timezone.utc)):%Y%m%d_%H%M%S}.jsonl"
    write_jsonl(pages, path)
    stored = pages.sparkSession.read.schema(pages.schema).json(path)
    write_report(summarize(stored, "page_type", "word_count"), f"{folder}/summary.json")
    return path


def write_documents(docs: DataFrame, folder: str) -> None:
    """Documents partitioned by page type, the usual filter, and their summary."""
    path = f"{folder}/documents"
    docs.write.mode("overwrite").partitionBy("page_type").parquet(path)
    write_report(summarize(docs.sparkSession.read.parquet(path), "page_type", "word_count"), f"{folder}/documents_summary")


def write_chunks(chunks: DataFrame, folder: str) -> None:
    path = f"{folder}/chunks"
    chunks.write.mode("overwrite").partitionBy("chunk_strategy").parquet(path)
    stored = chunks.sparkSession.read.parquet(path)
    both = summarize(stored, "chunk_strategy", "chunk_words").withColumnRenamed("chunk_strategy", "name").withColumn("kind", F.lit("strategy"))
    types = summarize(stored, "page_type", "chunk_words").withColumnRenamed("page_type", "name").withColumn("kind", F.lit("page_type"))
    write_report(both.unionByName(types), f"{folder}/chunks_summary")


def write_vectors(vectors: DataFrame, path: str, payload: tuple[str, ...] = ("page_type", "source")) -> None:
    """Vector table clustered by the payload columns that searches filter on, so that filters skip files and row groups.

    The range includes the id: a payload value with many rows is spread over several files.
    """
    keys = [c for c in payload if c in vectors.columns]
    vectors.repartitionByRange(*keys, "id").sortWithinPartitions(*keys, "id").write.mode("overwrite").parquet(path)


def append_embedding_cache(fresh: DataFrame, path: str) -> None:
    fresh.select("text_hash", "embedding").write.mode("append").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label, edges by relation: lookups read only the relations a question admits."""
    write_nodes(nodes, path)
    write_edges(edges, path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return read_nodes(spark, path), read_edges(spark, path)


def read_nodes(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/nodes")


def read_edges(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/edges")


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    write_jsonl(nodes, f"{path}/nodes")
    write_jsonl(edges, f"{path}/edges")


def write_metrics(per_query: DataFrame, summary: DataFrame, folder: str) -> None:
    """Per-query metrics and the one-row summary."""
    write_jsonl(per_query, f"{folder}/per_query")
    write_report(summary, f"{folder}/summary")
