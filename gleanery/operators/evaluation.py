"""Retrieval metrics, exact order statistics and pass/fail tallies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.session import ensure_checkpoint_dir

K_VALUES = (1, 3, 5, 10)


def keyword_relevance(results: DataFrame, queries: DataFrame, keywords_col: str = "keywords") -> DataFrame:
    """(query_id, rank, rel): a hit is relevant when its text contains any keyword, ignoring case."""
    wanted = queries.select("query_id", F.transform(keywords_col, F.lower).alias("kw"))
    rel = T.any_contains(F.lower(F.coalesce("text", F.lit(""))), F.col("kw")).cast("int")
    return results.join(wanted, "query_id").select("query_id", "rank", rel.alias("rel"))


def per_query_metrics(
    queries: DataFrame, judged: DataFrame, k_values: Sequence[int] = K_VALUES, ndcg_k: int = 5
) -> DataFrame:
    """One row per query, also for queries without results: hit@k, reciprocal rank and nDCG@k.

    The ideal gain counts only the relevant hits inside the top k.
    """
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    stats = judged.groupBy("query_id").agg(
        *[F.max(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).cast("double").alias(f"hit_{k}") for k in k_values],
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("rank") <= ndcg_k, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rank") <= ndcg_k, F.col("rel")).otherwise(0)).alias("n_rel"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_rel"), F.lit(1)).cast("int")), F.lit(0.0),
                        lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return queries.select("query_id").join(stats, "query_id", "left").select(
        "query_id",
        *[F.coalesce(f"hit_{k}", F.lit(0.0)).alias(f"hit_{k}") for k in k_values],
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"),
        F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def mean_metrics(per_query: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    return per_query.agg(
        F.count("*").alias("n_queries"),
        *[F.round(F.avg(f"hit_{k}"), 4).alias(f"recall_{k}") for k in k_values],
        F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg"))


GRID = 256  # quantiles by which a round narrows every bracket


def exact_percentiles(
    df: DataFrame, by: str, value: str, percents: Sequence[float] = (0.5, 0.9, 0.95), accuracy: int = 10_000, most: int = 4096
) -> DataFrame:
    """(grp, p, value, n, mean) with ``sorted(values)[int(n * p)]`` per group; nulls are left out, a null group is none.

    Selection in rounds, for all groups and percentiles at once. A bracket is an open interval with the counts below it and
    at its ends; one map-side combined aggregation a round counts them and takes a sketch of the rows inside, whose
    quantiles around the wanted rank are the next bracket (about 1/40 of it). An answer that lies at an end is found
    however many ties it has. What is ordered in the end is one bracket of at most ``most`` rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("grp"), F.col(value).cast("double").alias("v"))
    groups = rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = groups.where(F.col("grp").isNotNull()).select("*", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("p")).withColumn(
        "target", F.floor(F.col("n") * F.col("p"))).where("target < n").withColumns(
        {"value": F.lit(None).cast("double"), "rank": F.lit(0).cast("bigint"), "within": F.col("n")}).checkpoint()
    margin = math.ceil(GRID / accuracy) + 1  # grid cells by which the sketch may be off
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    while True:
        open_ones = state.where(F.col("value").isNull() & (F.col("within") > most))
        if open_ones.isEmpty():
            break
        inside = (v > lo) & (v < hi)
        seen = rows.join(open_ones.select("grp", "p", "lo", "hi"), "grp").groupBy("grp", "p").agg(
            F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if(v == hi).alias("at_hi"), F.count_if(inside).alias("held"),
            F.percentile_approx(F.when(inside, v), [i / GRID for i in range(GRID + 1)], F.lit(accuracy)).alias("grid"))
        rank = F.col("target") - F.col("below") - F.col("at_lo")  # among the rows inside
        cell = F.floor(rank * GRID / F.col("held")).cast("int")
        missed = (F.col("target") < F.col("below")) | (F.col("rank") >= F.col("held") + F.col("at_hi"))
        looked = open_ones.drop("rank", "within", "value").join(seen, ["grp", "p"]).withColumn("rank", rank).withColumn(
            "rank", F.when(missed, F.raise_error(F.lit("a bracket lost its percentile")).cast("bigint")).otherwise(F.col("rank")))
        narrowed = looked.select(
            "grp", "n", "mean", F.when(F.col("rank").between(0, F.col("held") - 1), F.get("grid", F.greatest(cell - margin, F.lit(0)))).otherwise(lo).alias("lo"),
            F.when(F.col("rank").between(0, F.col("held") - 1), F.get("grid", F.least(cell + 1 + margin, F.lit(GRID)))).otherwise(hi).alias("hi"), "p", "target",
            F.when(F.col("rank") < 0, lo).when(F.col("rank") >= F.col("held"), hi).alias("value"), "rank", F.col("held").alias("within"),
            lo.alias("low"), hi.alias("high"))
        # a bracket with few rows inside is kept as it is and ordered below
        few = F.col("within") <= most
        narrowed = narrowed.withColumns({"lo": F.when(few, F.col("low")).otherwise(lo), "hi": F.when(few, F.col("high")).otherwise(hi)}).drop("low", "high")
        settled = state.where(F.col("value").isNotNull() | (F.col("within") <= most))
        state = settled.unionByName(narrowed).checkpoint()
    left = state.where("value IS NULL")
    # a group that never had more than `most` rows still spans its ends
    whole = F.col("within") == F.col("n")
    placed = rows.join(left.drop("value", "mean"), "grp").where(whole | ((v > lo) & (v < hi)))
    ordered = placed.groupBy("grp", "p").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first(F.when(whole, F.col("target")).otherwise(F.col("rank"))).alias("at"))
    picked = ordered.select("grp", "p", F.get("vs", F.col("at")).alias("found"))
    return state.join(picked, ["grp", "p"], "left").select("grp", "p", F.coalesce("value", "found").alias("value"), "n", "mean")


def pass_rate(checked: DataFrame) -> DataFrame:
    """(n, passed, failed) of rows with ``expected`` and ``got``."""
    return checked.agg(F.count("*").alias("n"), F.count_if(F.col("got") == F.col("expected")).alias("passed"),
                       F.count_if(F.col("got") != F.col("expected")).alias("failed"))
