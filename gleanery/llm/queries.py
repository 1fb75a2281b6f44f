"""The registered queries of this subpackage: each applies one operator, with its production parameters, to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import (chat, decontaminate, language, neighbours, packing, passages, repair, setjoin, sharding, simhash, suffixes, tries,
                          warc)
from gleanery.llm.common import read


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(read(spark, sf_dir, "documents"))


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))],
                                  "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.formatted_turns(turns))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.removed(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_spans", "words_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(read(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(read(spark, sf_dir, "conversations"))


def op13_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_byte_network, op3_hash_tree_shards, op4_chat_round_trip, op5_benchmark_leaks, op6_repeated_passages, op7_suffix_arrays, op8_legacy_archives,
    op9_hash_prefix_forest, op10_simhash_components, op11_structure_repair, op12_prefix_trie, op13_chosen_path_join)}
ORACLES: dict[str, str] = {
    "op8_legacy_archives": """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        f AS (SELECT *, strlen(payload) >= 100 AND page_id > min(page_id) OVER (PARTITION BY payload) AS again, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
        CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM f""",
}
