"""Context blocks, prompts and source lists from ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.functions import text as T
from gleanery.operators.ranking import top_k


def context_blocks(results: DataFrame, max_chunks: int = 5) -> DataFrame:
    """(query_id, context, n_chunks) from (query_id, rank, source, text, url): graph texts, then numbered chunks."""
    usable = results.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    chunks = top_k(usable.where("source <> 'graph'"), ["query_id"], [F.col("rank")], max_chunks, "n")
    cite = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("\n(Source: "), "url", F.lit(")"))).otherwise("")
    numbered = chunks.select("query_id", F.lit(1).alias("part"), "n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "text", cite).alias("line"))
    graph = usable.where("source = 'graph'").select("query_id", F.lit(0).alias("part"), F.col("rank").cast("int").alias("n"), F.col("text").alias("line"))
    return graph.unionByName(numbered).groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "line"))), lambda x: x["line"]), "\n\n").alias("context"),
        F.count_if(F.col("part") == 1).alias("n_chunks"))


def prompt(question: Column, context: Column, history: Column, chat_markup: bool = True) -> Column:
    """Prompt text: ChatML with the history as messages, or the header-token layout with the history inline."""
    has_context, has_history = T.strip(context) != "", T.strip(history) != ""
    block = F.when(has_context, F.concat(F.lit("\n\n[Context from UB CSE website:]\n"), context)).otherwise("")
    if not chat_markup:
        told = F.when(has_history, F.concat(F.lit("\n\n[Conversation so far:]\n"), history)).otherwise("")
        return F.concat(
            F.lit(f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{K.SYSTEM_PROMPT}<|eot_id|>"
                  "<|start_header_id|>user<|end_header_id|>\n"),
            T.strip(F.concat(told, block, F.lit("\n\n"), question)),
            F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"))
    message = lambda role, body: F.concat(F.lit(f"<|im_start|>{role}\n"), body, F.lit("<|im_end|>"))
    lines = F.transform(F.split(T.strip(history), "\n"), lambda s: T.strip(s))
    told = F.array_compact(F.transform(lines, lambda s: F.when(s.startswith("User:"), message("user", T.strip(F.substring(s, 6, 1 << 30)))).when(
        s.startswith("Assistant:"), message("assistant", T.strip(F.substring(s, 11, 1 << 30))))))
    return F.array_join(F.concat(
        F.array(message("system", F.lit(K.SYSTEM_PROMPT))), told,
        F.array(message("user", T.strip(F.concat(question, block))), F.lit("<|im_start|>assistant"))), "\n")


def source_urls(results: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, url, position): distinct URLs by best rank."""
    best = results.where(F.coalesce("url", F.lit("")) != "").groupBy("query_id", "url").agg(F.min("rank").alias("best"))
    return top_k(best, ["query_id"], [F.col("best"), F.col("url")], k, "position").select(
        "query_id", "url", F.col("position").cast("bigint").alias("position"))


def citations(urls: Column) -> Column:
    return F.array_join(F.transform(urls, lambda u, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), u)), "\n")


def debug_payload(results: DataFrame, k: int = 5, max_chars: int = 800) -> DataFrame:
    """(query_id, chunks, graph): shortened top chunks and the graph texts of every query."""
    top = top_k(results.where("source <> 'graph'"), ["query_id"], [F.col("rank")], k, "n").select(
        "query_id", F.struct("n", "source", "url", F.substring("text", 1, max_chars).alias("text")).alias("c"), F.lit(None).cast("string").alias("g"))
    graph = results.where("source = 'graph'").select("query_id", F.lit(None).cast(top.schema["c"].dataType).alias("c"), F.col("text").alias("g"))
    return top.unionByName(graph).groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("chunks"), F.collect_list("g").alias("graph"))
