"""Inverted index and BM25 (Okapi) search over a batch of queries.

A batch of queries of checked size is scored where the documents lie: each Arrow batch of token lists is scored by one
matrix product against the query weights and ships only its own top-k, so the corpus is never shuffled. A larger batch
is joined relationally: only tokens that occur in some query survive to one exchange, keyed by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULTS
from gleanery.functions import text as T
from gleanery.functions.vectors import ARROW, best_rows, order_keys
from gleanery.operators.ranking import top_k
from gleanery.operators.textjoin import contains_pairs
from gleanery.plans.sizing import broadcast_if_small

MAX_INLINE_BOOSTS = 500
MAX_INLINE_WEIGHTS = 200_000
MAX_INLINE_CELLS = 8_000_000  # terms x queries of the weight matrix (64 MB)
CHUNK_CELLS = 2_000_000
_BOOST = "\u0002"  # prefix of pseudo-terms that mark "the text contains this boost term"


@dataclass(frozen=True)
class Bm25:
    k1: float = DEFAULTS.bm25_k1
    b: float = DEFAULTS.bm25_b
    epsilon: float = DEFAULTS.bm25_epsilon
    boost: float = DEFAULTS.bm25_boost


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): one row per vocabulary entry; combined map-side before the exchange."""
    return (T.unnest(docs, F.array_distinct(T.tokens(F.col(text_col))), "term")
            .groupBy("term").agg(F.count("*").alias("df")))


def corpus_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: number of documents (empty ones included) and mean document length in tokens."""
    length = F.size(T.tokens(F.col(text_col)))
    return docs.select(length.alias("dl")).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def inverse_frequencies(df: DataFrame, n_docs: Column, epsilon: float = DEFAULTS.bm25_epsilon) -> DataFrame:
    """(term, df, idf). A negative idf is replaced by ``epsilon`` times the mean raw idf of the vocabulary."""
    raw = df.withColumn("raw_idf", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((F.lit(epsilon) * F.avg("raw_idf")).alias("floor")).scalar()
    return raw.select("term", "df", F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf")).alias("idf"))


@dataclass(frozen=True)
class Bm25Index:
    """Tables of a keyword index. ``postings`` is (term, doc_id, tf, dl); ``stats`` has one row."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def write(self, path: str, partitions: int | None = None) -> None:
        """Range-partition postings by (term, doc_id): a frequent term spans several files, a rare term prunes to one."""
        spread = [F.col("term"), F.col("doc_id")]
        ordered = (self.postings.repartitionByRange(partitions, *spread) if partitions
                   else self.postings.repartitionByRange(*spread))
        ordered.sortWithinPartitions(*spread).write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark, path: str) -> "Bm25Index":
        return Bm25Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Bm25 = Bm25()) -> Bm25Index:
    tokenized = docs.select(F.col(id_col).alias("doc_id"), T.tokens(F.col(text_col)).alias("tokens"))
    postings = (T.unnest(tokenized, F.col("tokens"), "term", "doc_id", F.size("tokens").alias("dl"))
                .groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "dl"))
    stats = corpus_statistics(docs, text_col)
    terms = inverse_frequencies(document_frequencies(docs, text_col), stats.select("n_docs").scalar(), params.epsilon)
    return Bm25Index(postings, terms, stats)


def query_terms(queries: DataFrame, boost: bool, query_text: str = "query_text", boost_text: str | None = None) -> DataFrame:
    """(query_id, term, qtf, is_boost): token multiplicities, plus one pseudo-term per boost term when asked for."""
    plain = (queries.select("query_id", F.explode(T.tokens(F.col(query_text))).alias("term"))
             .groupBy("query_id", "term").agg(F.count("*").alias("qtf")).withColumn("is_boost", F.lit(False)))
    if not boost:
        return plain
    marks = queries.select("query_id", F.explode(T.boost_terms(F.col(boost_text or query_text))).alias("t")).select(
        "query_id", F.concat(F.lit(_BOOST), F.col("t")).alias("term"), F.lit(0).cast("bigint").alias("qtf"),
        F.lit(True).alias("is_boost"))
    return plain.unionByName(marks)


def _score(params: Bm25, avgdl: Column) -> Column:
    tf, dl = F.col("tf"), F.col("dl")
    return F.col("qtf") * F.coalesce(F.col("idf"), F.lit(0.0)) * (
        tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * dl / avgdl)))


def _rank(scored: DataFrame, k: int, params: Bm25) -> DataFrame:
    """Sum contributions per (query, document), apply the boost, keep the k best positive scores."""
    best = (scored.groupBy("query_id", "doc_id")
            .agg(F.sum("part").alias("raw"), F.max("is_boost").alias("boosted"))
            .withColumn("raw", F.col("raw") * F.when(F.col("boosted"), params.boost).otherwise(1.0))
            .where(F.col("raw") > 0))
    ranked = top_k(best, ["query_id"], [F.round("raw", 6).desc(), F.col("doc_id")], k)
    return ranked.select("query_id", "doc_id", F.round("raw", 4).alias("score"), F.col("rank").cast("bigint"))


def _with_boost_marks(docs, queries, exploded, id_col: str, text: Column, query_text: str) -> DataFrame:
    """Postings plus one pseudo-posting per (document, boost term its text contains).

    A small vocabulary is tested on each whole text while it is tokenized; a large one goes through the substring join.
    """
    boosts = queries.select(F.explode(T.boost_terms(F.col(query_text))).alias("pattern")).distinct()
    few = [r["pattern"] for r in boosts.limit(MAX_INLINE_BOOSTS + 1).collect()]
    if not few:
        return exploded
    if len(few) <= MAX_INLINE_BOOSTS:
        marks = [F.when(F.contains(F.col("low"), F.lit(t)), F.lit(_BOOST + t)) for t in sorted(few)]
        tokenized = docs.select(F.col(id_col).alias("doc_id"), T.tokens(text).alias("tokens"), F.lower(text).alias("low"))
        return T.unnest(tokenized, F.concat("tokens", F.array_compact(F.array(*marks))), "term", "doc_id", F.size("tokens").alias("dl"))
    pairs = contains_pairs(docs.select(F.col(id_col).alias("id"), F.lower(text).alias("text")), boosts)
    return exploded.unionByName(pairs.select(
        F.col("id").alias("doc_id"), F.lit(None).cast("int").alias("dl"), F.concat(F.lit(_BOOST), "pattern").alias("term")))


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = DEFAULTS.bm25_top_k,
    boost: bool = True,
    params: Bm25 = Bm25(),
    id_col: str = "doc_id",
    text_col: str = "text",
    query_text: str = "query_text",
    boost_text: str | None = None,
    max_inline_weights: int = MAX_INLINE_WEIGHTS,
) -> DataFrame:
    """Ranked (query_id, doc_id, score, rank) straight from the documents.

    ``max_inline_weights`` bounds the (query, term) rows that may be shipped to the tasks; 0 forces the relational plan.
    """
    stats = corpus_statistics(docs, text_col)
    n_docs, avgdl = stats.select("n_docs").scalar(), stats.select("avgdl").scalar()
    wanted = broadcast_if_small(query_terms(queries, boost, query_text, boost_text))
    idf = inverse_frequencies(document_frequencies(docs, text_col), n_docs, params.epsilon)
    weighted = idf.join(wanted, "term", "right").select("query_id", "term", "qtf", "is_boost", "idf")
    if max_inline_weights:
        rows = weighted.limit(max_inline_weights + 1).collect()
        cells = len({r["term"] for r in rows}) * len({r["query_id"] for r in rows})
        if (len(rows) <= max_inline_weights and cells <= MAX_INLINE_CELLS
                and len({r["term"] for r in rows if r["is_boost"]}) <= MAX_INLINE_BOOSTS):
            return _search_in_place(docs, rows, stats.first()["avgdl"], k, params, id_col, text_col,
                                    queries.schema["query_id"].dataType.simpleString())
        weighted = queries.sparkSession.createDataFrame(rows, weighted.schema) if len(rows) <= max_inline_weights else weighted
    weights = broadcast_if_small(weighted)

    col = F.col(text_col)
    tokenized = docs.select(F.col(id_col).alias("doc_id"), T.tokens(col).alias("tokens"))
    exploded = T.unnest(tokenized, F.col("tokens"), "term", "doc_id", F.size("tokens").alias("dl"))
    if boost:
        exploded = _with_boost_marks(docs, queries, exploded, id_col, col, boost_text or query_text)
    postings = (exploded.join(broadcast_if_small(wanted.select("term").distinct()), "term", "left_semi")
                .repartition("doc_id")
                .groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")))
    parts = postings.join(weights, "term").select(
        "query_id", "doc_id", F.when(F.col("is_boost"), 0.0).otherwise(_score(params, avgdl)).alias("part"), "is_boost")
    return _rank(parts, k, params)


def _search_in_place(docs: DataFrame, rows: list, avgdl: float, k: int, params: Bm25, id_col: str, text_col: str,
                     query_type: str) -> DataFrame:
    """Score whole documents against a weight matrix inside the scan; only top-k rows leave a batch."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"query_id {query_type}, doc_id {id_type}, raw double"
    query_ids = sorted({r["query_id"] for r in rows})
    place = {q: i for i, q in enumerate(query_ids)}
    plain = [r for r in rows if not r["is_boost"] and r["idf"] is not None]
    marks = [r for r in rows if r["is_boost"]]
    vocabulary = sorted({r["term"] for r in plain})
    column = {t: i for i, t in enumerate(vocabulary)}
    weights = np.zeros((len(vocabulary), len(query_ids)))
    for r in plain:
        weights[column[r["term"]], place[r["query_id"]]] = r["qtf"] * r["idf"]
    boosted = sorted({r["term"][len(_BOOST):] for r in marks})
    wants = np.zeros((len(boosted), len(query_ids)), dtype=bool)
    for r in marks:
        wants[boosted.index(r["term"][len(_BOOST):]), place[r["query_id"]]] = True
    shared = spark.sparkContext.broadcast((np.array(query_ids), pa.array(vocabulary, pa.string()), weights, boosted, wants))
    k1, b, factor = params.k1, params.b, params.boost
    out = pa.schema([(name, ARROW[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])

    def score(batches):
        names, vocab, w, boost_terms, wanted = shared.value
        height = max(16, CHUNK_CELLS // max(w.shape[0], w.shape[1], 1))
        for whole in batches:
            for start in range(0, whole.num_rows, height):
                batch = whole.slice(start, height)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                lists = batch.column("tokens")
                lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                term = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocab), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ids)), lengths)
                cell, tf = np.unique(row[term >= 0] * len(vocab) + term[term >= 0], return_counts=True)
                at, which = cell // max(len(vocab), 1), cell % max(len(vocab), 1)
                dense = np.zeros((len(ids), len(vocab)))
                dense[at, which] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[at] / avgdl))
                scores = dense @ w
                for n in range(len(boost_terms)):
                    hit = batch.column(f"has_{n}").to_numpy(zero_copy_only=False).astype(bool)
                    flags = hit[:, None] & wanted[n][None, :] if n == 0 else flags | (hit[:, None] & wanted[n][None, :])
                if boost_terms:
                    scores = np.where(flags, scores * factor, scores)
                keys = order_keys(ids)
                found = [best_rows(scores[:, q], keys, k) for q in range(len(names))]
                found = [best[scores[best, q] > 0] for q, best in enumerate(found)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat(names, [len(f) for f in found]), "doc_id": ids[np.concatenate(found)],
                    "raw": np.concatenate([scores[f, q] for q, f in enumerate(found)])}, schema=out)

    text = F.col(text_col)
    flags = [F.contains(F.col("low"), F.lit(t)).alias(f"has_{n}") for n, t in enumerate(boosted)]
    prepared = docs.select(F.col(id_col).alias("doc_id"), T.tokens(text).alias("tokens"), F.lower(text).alias("low")).select(
        "doc_id", "tokens", *flags)
    ranked = top_k(prepared.mapInArrow(score, schema), ["query_id"], [F.round("raw", 6).desc(), F.col("doc_id")], k)
    return ranked.select("query_id", "doc_id", F.round("raw", 4).alias("score"), F.col("rank").cast("bigint"))


def search_index(index: Bm25Index, queries: DataFrame, k: int = DEFAULTS.bm25_top_k, params: Bm25 = Bm25(),
                 query_text: str = "query_text") -> DataFrame:
    """Search a stored index (no boosts, which need the texts)."""
    avgdl = index.stats.select("avgdl").scalar()
    wanted = broadcast_if_small(query_terms(queries, False, query_text))
    weights = broadcast_if_small(index.terms.join(wanted, "term").select("query_id", "term", "qtf", "is_boost", "idf"))
    parts = index.postings.join(weights, "term").select(
        "query_id", "doc_id", _score(params, avgdl).alias("part"), "is_boost")
    return _rank(parts, k, params)
