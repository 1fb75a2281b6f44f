"""Stored keyword index with block-max postings.

Documents of similar length share a block of about ``block_docs``: short documents weigh a term most, so that blocks differ
in the greatest score a term can give in them. A row holds one term in one block: its documents, their impacts (everything
of BM25 but the query's weight) in falling order, and the greatest impact. Rows lie in shelves by a hash of the term, sorted
by term and block: a search reads the shelves of its terms only, of these first the greatest impacts alone.

A block can give a query no more than the sum of its terms' greatest impacts, weighted. The few blocks that promise most
are scored first; the k-th score they give rules out every block that promises less, and only the others are opened. The
result is that of scoring everything, and the corpus is not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.config import DEFAULTS
from gleanery.functions import text as T
from gleanery.operators import bm25
from gleanery.operators.ranking import top_k
from gleanery.plans.sizing import broadcast_if_small
from gleanery.session import ensure_checkpoint_dir, shuffles_dropped

BLOCK_DOCS = 64
SHELVES = 64
TASK_TOKENS = 1_000_000  # about so many tokens of the texts become postings in one task
COUNT_ROWS = 1_000  # texts whose tokens are counted together
GROUP_QUERIES = 256  # so many queries of a block are looked up together
PROBES = 8  # blocks per query that are scored to find the k-th score
MARGIN = 1e-6  # scores are compared after rounding to six digits


@dataclass(frozen=True)
class BlockIndex:
    """Stored tables: ``blocks`` (shelf, term, block, top, docs, impacts), ``terms`` (term, df, idf) and ``stats`` (one row).

    ``repeated``: some ids come more than once, so that they may lie in several blocks.
    """

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    shelves: int
    repeated: bool


def _shelf(term, shelves: int):
    return F.pmod(F.xxhash64(term), F.lit(shelves)).cast("int")


def with_blocks(lengths: DataFrame, block_docs: int) -> DataFrame:
    """(doc_id, dl, block): documents in the order of their lengths, about ``block_docs`` to a block.

    Only the histogram of lengths is put in order. A length with more documents than a block holds deals them to blocks by a
    hash, rarer lengths share a block with their neighbours.
    """
    joined = lengths.join(broadcast_if_small(block_starts(lengths, block_docs)), "dl")
    return joined.select("doc_id", "dl", block_of().alias("block"))


def block_starts(lengths: DataFrame, block_docs: int) -> DataFrame:
    """(dl, first, parts): the first block of every length and how many it is dealt to."""
    counts = lengths.groupBy("dl").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("dl").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("dl", F.floor(before / block_docs).alias("first"), F.ceil(F.col("n") / block_docs).alias("parts"))


def block_of() -> Column:
    return F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("parts"))


def term_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, term, tf) of docs(kept columns, tokens): counted where the tokens lie, without an exchange."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", term string, tf long"

    def counted(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, COUNT_ROWS):
                batch = whole.slice(start, COUNT_ROWS)
                lists = batch.column("tokens")
                codes = lists.flatten().dictionary_encode()
                words = max(1, len(codes.dictionary))
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                cell, tf = np.unique(row * words + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
                of = pa.array(cell // words)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in keep), codes.dictionary.take(pa.array(cell % words)), pa.array(tf)],
                                                 names=[*keep, "term", "tf"])

    return docs.select(*keep, "tokens").mapInArrow(counted, schema)


def placed_postings(docs: DataFrame, lengths: DataFrame, twice: DataFrame | None, block_docs: int) -> DataFrame:
    """(term, block, doc_id, dl, tf) of docs(doc_id, tokens); ``lengths`` has their stored (doc_id, dl), ``twice`` the ids that come more than once.

    A document's block follows from its length and id, so its tokens are counted and placed where it is read. Only documents whose id
    comes more than once are put together by an exchange: each posting of such an id lies in every block that one of them has.
    """
    starts = broadcast_if_small(block_starts(lengths, block_docs))
    own = docs.where("doc_id IS NOT NULL").withColumn("dl", F.size("tokens"))
    if twice is None:
        return term_counts(own.join(starts, "dl").withColumn("block", block_of()), "doc_id", "dl", "block")
    twice = broadcast_if_small(twice)
    once = own.join(twice, "doc_id", "left_anti").join(starts, "dl").withColumn("block", block_of())
    merged = term_counts(own.join(twice, "doc_id", "left_semi"), "doc_id", "dl").groupBy("term", "doc_id", "dl").agg(F.sum("tf").alias("tf"))
    places = lengths.join(twice, "doc_id", "left_semi").join(starts, "dl").select("doc_id", block_of().alias("block"))
    return term_counts(once, "doc_id", "dl", "block").unionByName(merged.join(places, "doc_id"))


def block_rows(postings: DataFrame, impact: Column, shelves: int, tasks: int) -> DataFrame:
    """(term, block, top, docs, impacts, shelf) in the order of shelf, term and block, after one exchange of the postings.

    A shelf is held by as many tasks as ``tasks`` gives it, which deal its blocks among them: a frequent term spans files.
    """
    shelf = _shelf("term", shelves)
    parts = -(-tasks // shelves)
    slot = (shelf * parts + F.pmod(F.xxhash64("block"), F.lit(parts))) % tasks
    dealt = postings.select("term", "block", "doc_id", "dl", "tf", slot.cast("int").alias("slot")).repartitionById(tasks, F.col("slot"))
    rows = dealt.groupBy("slot", "term", "block").agg(F.sort_array(F.collect_list(F.struct(impact.alias("impact"), "doc_id")), asc=False).alias("p"))
    return rows.select("term", "block", F.col("p")[0]["impact"].alias("top"), F.col("p")["doc_id"].alias("docs"), F.col("p")["impact"].alias("impacts"),
                       shelf.alias("shelf")).sortWithinPartitions("shelf", "term", "block")


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", params: bm25.Bm25 = bm25.Bm25(),
          block_docs: int = BLOCK_DOCS, shelves: int = SHELVES) -> BlockIndex:
    """Write the index of ``docs`` below ``path``, in place of what is there."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    tokenized = docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col)).alias("tokens"))
    with shuffles_dropped(spark):
        tokenized.select("doc_id", F.size("tokens").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    n_docs, avgdl, total = lengths.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    twice = lengths.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    repeated = not twice.isEmpty()
    spark.range(1).select(F.lit(n_docs).alias("n_docs"), F.lit(avgdl).alias("avgdl"), F.lit(shelves).alias("shelves"), F.lit(repeated).alias("repeated"),
                          F.lit(kind).alias("id_type")).write.mode("overwrite").parquet(f"{path}/stats")
    tf, dl = F.col("tf"), F.col("dl")
    impact = tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * dl / F.lit(avgdl)))
    wanted = max(spark.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    tasks = wanted if wanted <= shelves else -(-wanted // shelves) * shelves
    with shuffles_dropped(spark):
        rows = block_rows(placed_postings(tokenized, lengths, twice if repeated else None, block_docs), impact, shelves, tasks)
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("shelf").parquet(f"{path}/blocks")
        df = _blocks(spark, path, kind).groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
        bm25.inverse_frequencies(df, F.lit(n_docs), params.epsilon).write.mode("overwrite").parquet(f"{path}/terms")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> BlockIndex:
    stats = spark.read.parquet(f"{path}/stats")
    about = stats.first()
    return BlockIndex(_blocks(spark, path, about["id_type"]), spark.read.parquet(f"{path}/terms"), stats, about["shelves"], about["repeated"])


def _blocks(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    schema = f"term string, block long, top double, docs array<{id_type}>, impacts array<double>, shelf int"
    return spark.read.schema(schema).parquet(f"{path}/blocks")


def opened(spark: SparkSession, path: str, docs: DataFrame, **options) -> BlockIndex:
    """The index stored below ``path``; built from ``docs`` if there is none (its terms are written last)."""
    try:
        spark.read.parquet(f"{path}/terms")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return build(docs, path, **options)
    return read(spark, path)


@dataclass(frozen=True)
class Plan:
    """Weighted terms of the queries, what every block promises them, the first scores and the blocks left to open."""

    weights: DataFrame
    promises: DataFrame
    probed: DataFrame
    left: DataFrame


def _kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as Parquet below the shared checkpoint folder; what was shuffled for them is dropped."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scored(rows: DataFrame, weights: DataFrame, chosen: DataFrame, repeated: bool) -> DataFrame:
    """(query_id, doc_id, raw) of all documents of the chosen (query_id, block).

    Rows are exchanged by block, once and whatever the number of queries: a block's documents are scored where its rows meet. Only ids
    that lie in several blocks (``repeated``) are summed once more.
    """
    groups = max(1, -(-weights.select("query_id").distinct().count() // GROUP_QUERIES))
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")
    asked = chosen.groupBy("block", group).agg(F.collect_set("query_id").alias("asked"))
    met = (rows.select("term", "block", "docs", "impacts").repartition("block").join(asked, "block")
           .join(broadcast_if_small(weights.select("*", group)), ["term", "group"]).where(F.array_contains("asked", F.col("query_id"))))
    hits = met.select("block", "query_id", "weight", F.explode(F.arrays_zip("docs", "impacts")).alias("x"))
    raw = F.sum(F.col("weight") * F.col("x.impacts")).alias("raw")
    scored = hits.groupBy("block", "query_id", F.col("x.docs").alias("doc_id")).agg(raw)
    if repeated:
        scored = scored.groupBy("query_id", "doc_id").agg(F.sum("raw").alias("raw"))
    return scored.select("query_id", "doc_id", "raw").where("raw > 0")


def planned(index: BlockIndex, queries: DataFrame, k: int, query_text: str = "query_text", probes: int = PROBES) -> tuple[DataFrame, Plan]:
    """(rows of the queries' terms, plan of the search)."""
    terms = bm25.query_terms(queries, False, query_text)
    weights = _kept(terms.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    shelves = [r[0] for r in weights.select(_shelf("term", index.shelves)).distinct().collect()]
    rows = index.blocks.where(F.col("shelf").isin(shelves)).join(broadcast_if_small(weights.select("term").distinct()), "term", "left_semi")
    tops = rows.select("term", "block", "top").repartition("block").join(broadcast_if_small(weights), "term")
    promises = _kept(tops.groupBy("block", "query_id").agg(F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).alias("most"))
                     .where("most > 0").select("query_id", "block", "most"))
    best = _kept(top_k(promises, ["query_id"], [F.col("most").desc(), F.col("block")], probes, "place"))
    probed = _kept(_scored(rows, weights, best, index.repeated))
    kth = top_k(probed, ["query_id"], [F.col("raw").desc(), F.col("doc_id")], k, "place").where(F.col("place") == k).select("query_id", F.col("raw").alias("kth"))
    left = (promises.join(best.select("query_id", "block"), ["query_id", "block"], "left_anti").join(kth, "query_id", "left")
            .where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - MARGIN)))
    return rows, Plan(weights, promises, probed, _kept(left.select("query_id", "block")))


def search(index: BlockIndex, queries: DataFrame, k: int = DEFAULTS.bm25_top_k, query_text: str = "query_text", probes: int = PROBES) -> DataFrame:
    """Ranked (query_id, doc_id, score, rank) from the stored index alone."""
    rows, plan = planned(index, queries, k, query_text, probes)
    scored = plan.probed.unionByName(_scored(rows, plan.weights, plan.left, index.repeated))
    ranked = top_k(scored, ["query_id"], [F.round("raw", 6).desc(), F.col("doc_id")], k)
    return ranked.select("query_id", "doc_id", F.round("raw", 4).alias("score"), F.col("rank").cast("bigint"))


def blocks_read(index: BlockIndex, queries: DataFrame, k: int = DEFAULTS.bm25_top_k, query_text: str = "query_text", probes: int = PROBES) -> DataFrame:
    """(query_id, blocks, opened): how many blocks hold a term of the query, and how many a search opens."""
    _, plan = planned(index, queries, k, query_text, probes)
    first = F.least(F.count(F.lit(1)), F.lit(probes))
    every = plan.promises.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), first.alias("first"))
    more = plan.left.groupBy("query_id").agg(F.count(F.lit(1)).alias("more"))
    return every.join(more, "query_id", "left").select("query_id", "blocks", (F.col("first") + F.coalesce("more", F.lit(0))).alias("opened"))
