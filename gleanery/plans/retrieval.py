"""The hybrid retrieval plan over a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULTS, Settings
from gleanery.functions import text as T
from gleanery.models import Embedder, embed
from gleanery.operators import bm25, dense, fusion


def hybrid_retrieve(
    docs: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    k: int = DEFAULTS.retrieval_top_k,
    graph_hits: DataFrame | None = None,
    threshold: float = 0.0,
    settings: Settings = DEFAULTS,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Fuse vector, keyword and (optional) graph hits of every query and keep the best ``k``.

    ``docs`` is (id, text); ``queries`` is (query_id, query_text); ``graph_hits`` is (query_id, id, text, score, rank).
    Vector and keyword search see the expanded query, the final boost the raw one. Pass ``vectors`` (id, embedding)
    to search stored vectors instead of embedding the documents.
    """
    expanded = queries.withColumn("query_text", T.expand_query(F.col("query_text")))
    stored = vectors if vectors is not None else embed(docs.select("id", "text"), embedder)
    lists = [
        ("dense", dense.search(stored, embed(expanded, embedder, "query_text"), k=k), settings.dense_weight),
        ("bm25", bm25.search(docs, expanded, k=k, id_col="id").withColumnRenamed("doc_id", "id"), settings.bm25_weight)]
    texts = docs.select("id", "text")
    if graph_hits is not None:
        lists.append(("graph", graph_hits.select("query_id", "id", "score", "rank"), settings.graph_weight))
        evidence = graph_hits.select("id", "text").join(texts.select("id"), "id", "left_anti").dropDuplicates(["id"])
        texts = texts.unionByName(evidence)
    fused = fusion.reciprocal_rank_fusion(lists, settings.rrf_k)
    boosted = fusion.boost_fused(fused, queries, texts, settings.fused_boost)
    return fusion.rank_fused(boosted, k, threshold)


def search_counts(lists: dict[str, DataFrame]) -> DataFrame:
    """Number of hits per retriever and query."""
    frames = [df.groupBy("query_id").agg(F.count("*").alias("hits")).withColumn("source", F.lit(name))
              for name, df in lists.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
