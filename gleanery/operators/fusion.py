"""Weighted reciprocal rank fusion, exact-match boosts and reranking of candidate lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.config import DEFAULTS
from gleanery.functions import text as T
from gleanery.models import LexicalScorer, Scorer
from gleanery.operators.ranking import top_k


def reciprocal_rank_fusion(
    lists: list[tuple[str, DataFrame, float]], k: int = DEFAULTS.rrf_k
) -> DataFrame:
    """Fuse ranked lists of (query_id, id, score, rank), given as (source, list, weight).

    Keeps the rank in every list, the source whose raw score was highest (the earlier list on ties) and the position
    at which a hit was first seen, which breaks ties of the fused score. A missing weight is ``None``; 0 is honoured.
    """
    tagged = [
        ranked.select("query_id", "id", "score", "rank", F.lit(i).alias("list_no"), F.lit(source).alias("source"),
                      F.lit(1.0 if weight is None else float(weight)).alias("weight"))
        for i, (source, ranked, weight) in enumerate(lists)]
    hits = reduce(DataFrame.unionByName, tagged)
    ranks = [F.max(F.when(F.col("source") == source, F.col("rank"))).alias(f"{source}_rank") for source, _, _ in lists]
    fused = hits.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 6).alias("rrf_score"),
        F.max_by("source", F.struct("score", -F.col("list_no"))).alias("source"),
        F.min(F.struct("list_no", "rank")).alias("first_seen"), *ranks)
    return fused.withColumn("score", F.col("rrf_score"))


def rank_fused(fused: DataFrame, top: int, threshold: float = 0.0) -> DataFrame:
    """Cut to the best ``top`` per query, after the optional threshold on the (possibly boosted) score."""
    kept = fused.where(F.col("score") >= threshold) if threshold > 0 else fused
    return top_k(kept, ["query_id"], [F.round("score", 9).desc(), F.col("rrf_score").desc(), F.col("first_seen")], top
                 ).withColumn("rank", F.col("rank").cast("bigint"))


def boost_fused(fused: DataFrame, queries: DataFrame, texts: DataFrame, multiplier: float = DEFAULTS.fused_boost,
                query_text: str = "query_text") -> DataFrame:
    """Multiply the score (not ``rrf_score``) of hits whose text contains a boost term of their query.

    Only the candidates are joined with the texts, and only for queries that have boost terms.
    """
    terms = queries.select("query_id", T.boost_terms(F.col(query_text)).alias("boost"))
    with_terms = fused.join(terms, "query_id", "left")
    lookup = texts.select("id", F.lower("text").alias("low"))
    hit = F.coalesce((F.size("boost") > 0) & T.any_contains(F.col("low"), F.col("boost")), F.lit(False))
    return (with_terms.join(lookup, "id", "left")
            .withColumn("score", F.col("score") * F.when(hit, multiplier).otherwise(1.0)).drop("boost", "low"))


def rerank(
    candidates: DataFrame,
    scorer: Scorer | None = None,
    k: int = DEFAULTS.rerank_top_k,
    order_col: str = "rank",
    chars: int | None = None,
) -> DataFrame:
    """Rerank (query_id, query_text, id, text, source, rrf_score, rank, page_type, url) with a passage scorer.

    Rows of source "graph" pass through in front, unscored. When the best passage of a query scores below -3 the
    fused order stands; otherwise page types and admission URLs shift the score used for ordering (``ce_score``),
    while ``score`` keeps the scorer's own value.
    """
    scorer = scorer or LexicalScorer()
    is_graph = F.col("source") == "graph"
    passage = F.col("text") if chars is None else F.substring(F.col("text"), 1, chars)
    raw = F.round(scorer.score(F.col("query_text"), passage), 4)
    scored = candidates.where(~is_graph).withColumn("score", raw)
    best = F.max("score").over(Window.partitionBy("query_id"))
    low_url = F.lower(F.coalesce("url", F.lit("")))
    shift = (
        F.when(F.col("page_type").isin(*K.RERANK_HIGH_VALUE), 0.5).otherwise(0.0)
        - F.when(F.col("page_type").isin(*K.RERANK_LOW_VALUE), 2.0).otherwise(0.0)
        - F.when(F.contains(low_url, F.lit("apply"))
                 | (F.contains(low_url, F.lit("admission")) & ~F.contains(low_url, F.lit("faculty"))), 1.5)
        .otherwise(0.0))
    no_signal = F.col("best") < -3.0
    adjusted = (scored.withColumn("best", best)
                .withColumn("ce_score", F.when(no_signal, F.col("score")).otherwise(F.round(F.col("score") + shift, 4)))
                .withColumn("sort_key", F.when(no_signal, F.col("rrf_score")).otherwise(F.col("ce_score"))))
    kept = top_k(adjusted, ["query_id"], [F.round("sort_key", 6).desc(), F.col(order_col)], k, "text_rank")
    passed = candidates.where(is_graph).withColumns({
        "score": F.col("rrf_score"), "ce_score": F.lit(None).cast("double"),
        "text_rank": F.lit(0)})
    both = passed.unionByName(kept.drop("best", "sort_key"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("text_rank", order_col))
    return both.withColumn("final_rank", position.cast("bigint")).drop("text_rank")


def score_summary(reranked: DataFrame) -> DataFrame:
    """Display columns of reranked hits."""
    return reranked.select(
        "query_id", F.col("final_rank").alias("rank"), "source", "ce_score",
        F.round("rrf_score", 5).alias("rrf_score"),
        F.substring(F.coalesce("url", F.lit("")), 1, 70).alias("url_snippet"),
        F.coalesce("page_type", F.lit("?")).alias("page_type"),
        F.replace(F.substring("text", 1, 120), F.lit("\n"), F.lit(" ")).alias("text_snippet"))
