"""Registered searches: keyword, vector, fused and reranked, with their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.functions import text as T
from gleanery.models import HashEmbedder, embed, embed_with_cache
from gleanery.operators import bm25, dense, evaluation, fusion
from gleanery.plans import oracle_macros as M
from gleanery.plans.retrieval import hybrid_retrieve
from gleanery.sources.tables import table

DIM = 64
_HASHED = HashEmbedder(DIM, undefined=True)  # the statements divide by the norm, whatever it is


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _named_items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items joined with a two-word name, so that exact-match boosts have something to match."""
    low = F.lower("query_text")
    word = F.coalesce(F.get(F.regexp_extract_all(low, F.lit("[a-z]{4,}"), F.lit(0)), 0), F.lit("none"))
    return _items(spark, d).withColumn(
        "query_text", F.concat("query_text", F.lit(" by Ada "), F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 99)))


_ITEMS = "items AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"
_NAMED = (
    "items AS (SELECT item_id AS query_id, text || ' by Ada ' || upper(substr(w, 1, 1)) || substr(w, 2) AS query_text "
    "FROM (SELECT *, coalesce(regexp_extract_all(lower(text), '[a-z]{4,}')[1], 'none') AS w FROM benchmark))")


# --- keyword search -------------------------------------------------------------------------------
def bm25_term_stats(spark, d):
    docs = _docs(spark, d)
    stats = bm25.corpus_statistics(docs)
    idf = bm25.inverse_frequencies(bm25.document_frequencies(docs), stats.select("n_docs").scalar())
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_corpus_stats(spark, d):
    return bm25.corpus_statistics(_docs(spark, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_search(spark, d):
    return bm25.search(_docs(spark, d), _items(spark, d), k=10, boost=False)


def bm25_search_boosted(spark, d):
    return bm25.search(_docs(spark, d), _named_items(spark, d), k=20, boost=True)


def boost_term_extraction(spark, d):
    return _named_items(spark, d).select("query_id", F.array_join(F.array_sort(T.boost_terms(F.col("query_text"))), "|").alias("terms"))


def query_expansion(spark, d):
    return _items(spark, d).select("query_id", F.md5(T.expand_query(F.col("query_text"))).alias("expanded_md5"))


def _expansion_sql(expr: str) -> str:
    steps, prev = [], f"SELECT query_id, query_text, {expr} AS e0 FROM items"
    for i, (pattern, words) in enumerate(K.EXPANSIONS):
        prev = (f"SELECT *, CASE WHEN regexp_matches(e{i}, '(?i){pattern}') THEN e{i} || {M.lit(' ' + words)} "
                f"ELSE e{i} END AS e{i + 1} FROM ({prev})")
    return f"SELECT query_id, query_text, {M.strip(f'e{len(K.EXPANSIONS)}')} AS expanded FROM ({prev})"


# --- vector search --------------------------------------------------------------------------------
def _label_centroids(spark, d):
    """One query vector per label: the mean of its unit vectors."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    mean = e.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(F.col("label").alias("query_id")).agg(
        F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select(
        "query_id", F.transform("v", lambda p: p["x"]).alias("embedding"))


def dense_topk(spark, d):
    return dense.search(table(spark, d, "embeddings"), _label_centroids(spark, d), k=20, id_col="vec_id")


def dense_topk_filtered(spark, d):
    return dense.search(table(spark, d, "embeddings"), _label_centroids(spark, d), k=20, id_col="vec_id",
                        where=(F.col("label") >= 3) & (F.col("label") <= 7))


def dense_threshold(spark, d):
    return dense.search(table(spark, d, "embeddings"), _label_centroids(spark, d), k=50, id_col="vec_id", threshold=0.2)


def legacy_similarity_top3(spark, d):
    hits = dense.search(table(spark, d, "embeddings"), _label_centroids(spark, d), k=3, id_col="vec_id")
    return hits.select("query_id", "id", "rank", F.round(1 - (1 - F.col("score")), 3).alias("sim"))


_CENTROIDS = """
    e AS MATERIALIZED (SELECT vec_id, label, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
    c AS (SELECT label AS query_id, d, avg(x) AS x FROM e GROUP BY ALL),
    cn AS (SELECT query_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM c),
    en AS (SELECT vec_id, label, d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e)"""


def _dense_sql(k: int, where: str = "true", having: str = "true") -> str:
    return f"""WITH {_CENTROIDS},
        s AS (SELECT query_id, vec_id AS id, sum(cn.x * en.x) AS raw FROM cn JOIN en USING (d) WHERE {where}
              GROUP BY ALL HAVING {having})
        {M.ranked('s', 'raw + 1e-9', k, 'id')}"""


def embedding_cache_split(spark, d):
    """Hit or miss of every document in a vector cache that holds the texts of the labelled documents."""
    docs = _docs(spark, d)
    known = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = embed(known.groupBy(F.md5("text").alias("text_hash")).agg(F.first("text").alias("text")), HashEmbedder(DIM)
                  ).select("text_hash", "embedding")
    _, fresh = embed_with_cache(docs.select("doc_id", "text"), cache, HashEmbedder(DIM))
    state = docs.select(F.md5("text").alias("text_hash")).join(
        fresh.select("text_hash", F.lit(True).alias("miss")), "text_hash", "left")
    return state.groupBy(F.when(F.col("miss"), "miss").otherwise("hit").alias("state")).agg(
        F.count("*").alias("documents"), F.countDistinct("text_hash").alias("texts"))


def embed_documents(spark, d):
    out = embed(_docs(spark, d).select("doc_id", "text"), _HASHED)
    return out.select("doc_id", F.posexplode("embedding").alias("d", "x")).where("x <> 0").select(
        "doc_id", F.col("d").cast("bigint"), F.round("x", 6).alias("x"))


# --- fusion and reranking -------------------------------------------------------------------------
def _dense_list(spark, d, k=20):
    vectors = embed(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), _HASHED)
    wanted = embed(_items(spark, d), _HASHED, "query_text")
    return dense.search(vectors, wanted, k=k)


def dense_text_search(spark, d):
    return _dense_list(spark, d, 20)


def rrf_fuse(spark, d):
    keyword = bm25.search(_docs(spark, d), _items(spark, d), k=20, boost=False).withColumnRenamed("doc_id", "id")
    fused = fusion.reciprocal_rank_fusion([("dense", _dense_list(spark, d), 0.6), ("bm25", keyword, 0.4)])
    return fusion.rank_fused(fused, 20).select("query_id", "id", "rank", "rrf_score", "source", "dense_rank", "bm25_rank")


def rrf_boosted(spark, d):
    docs, items = _docs(spark, d), _named_items(spark, d)
    keyword = bm25.search(docs, items, k=20, boost=False).withColumnRenamed("doc_id", "id")
    fused = fusion.reciprocal_rank_fusion([("bm25", keyword, 0.4)])
    boosted = fusion.boost_fused(fused, items, docs.select(F.col("doc_id").alias("id"), "text"))
    return fusion.rank_fused(boosted, 20).select("query_id", "id", "rank", "rrf_score", F.round("score", 7).alias("score"))


def hybrid_search(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    return hybrid_retrieve(docs, _named_items(spark, d), _HASHED, k=20).select(
        "query_id", "id", "rank", "rrf_score", F.round("score", 7).alias("score"), "source")


def _rerank_input(spark, d):
    docs = _docs(spark, d)
    hits = bm25.search(docs, _items(spark, d), k=20, boost=False).withColumnRenamed("doc_id", "id")
    url = F.concat(F.lit("https://docs.example.org/"), F.when(F.col("lang") == "fr", "apply/").otherwise(""), "source")
    info = docs.select(F.col("doc_id").alias("id"), "text", url.alias("url"),
                       F.when(F.col("lang") == "en", "research").when(F.col("lang") == "de", "general")
                       .otherwise("other").alias("page_type"))
    return (hits.join(info, "id").join(_items(spark, d), "query_id")
            .withColumn("source", F.lit("bm25")).withColumn("rrf_score", F.round(1.0 / (60 + F.col("rank")), 6)))


RERANK_CHARS = 512  # the statement's passage length


def rerank_lexical(spark, d):
    return fusion.rerank(_rerank_input(spark, d), chars=RERANK_CHARS).select("query_id", "id", "final_rank", "score", "ce_score")


def rerank_summary(spark, d):
    return fusion.score_summary(fusion.rerank(_rerank_input(spark, d), chars=RERANK_CHARS))


_FUSE_BASE = f"""{_ITEMS}, {M.bm25_ctes('documents', 'items', False)},
    b AS ({M.ranked('bm25', 'raw', 20)}),
    dv AS MATERIALIZED ({M.hash_vectors('documents', 'doc_id', 'text', DIM)}),
    qv AS ({M.hash_vectors('items', 'query_id', 'query_text', DIM)}),
    ids AS (SELECT DISTINCT query_id FROM items),
    s AS (SELECT i.query_id, t.doc_id, coalesce(x.raw, 0) AS raw FROM ids i CROSS JOIN documents t LEFT JOIN
          (SELECT query_id, doc_id, sum(qv.x * dv.x) AS raw FROM qv JOIN dv USING (d) GROUP BY ALL) x
          ON x.query_id = i.query_id AND x.doc_id = t.doc_id),
    dn AS ({M.ranked('s', 'raw + 1e-9', 20)})"""

_RERANK_SQL = f"""WITH {_ITEMS}, {M.bm25_ctes('documents', 'items', False)},
    b AS ({M.ranked('bm25', 'raw', 20)}),
    c AS (SELECT b.query_id, b.doc_id AS id, b.rank, d.text, round(1.0 / (60 + b.rank), 6) AS rrf_score,
            'https://docs.example.org/' || CASE WHEN lang = 'fr' THEN 'apply/' ELSE '' END || d.source AS url,
            CASE WHEN lang = 'en' THEN 'research' WHEN lang = 'de' THEN 'general' ELSE 'other' END AS page_type,
            round(8.0 * len(list_intersect(list_distinct({M.tokens('i.query_text')}), {M.tokens('substr(d.text, 1, 512)')}))
              / greatest(len(list_distinct({M.tokens('i.query_text')})), 1) - 4.0, 4) AS score
          FROM b JOIN documents d ON d.doc_id = b.doc_id JOIN items i ON i.query_id = b.query_id),
    m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM c),
    a AS (SELECT *, CASE WHEN best < -3 THEN score ELSE round(score + CASE WHEN page_type = 'research' THEN 0.5 ELSE 0 END
            - CASE WHEN page_type = 'general' THEN 2.0 ELSE 0 END - CASE WHEN contains(url, 'apply') THEN 1.5 ELSE 0 END, 4)
            END AS ce_score FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
            round(CASE WHEN best < -3 THEN rrf_score ELSE ce_score END, 6) DESC, rank) AS final_rank FROM a)"""


# --- evaluation -----------------------------------------------------------------------------------
def _judged(spark, d):
    items = _items(spark, d).withColumn("keywords", F.array("query_text"))
    hits = bm25.search(_docs(spark, d), items, k=10, boost=False)
    with_text = hits.join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return items, evaluation.keyword_relevance(with_text, items)


def retrieval_metrics_per_query(spark, d):
    items, judged = _judged(spark, d)
    m = evaluation.per_query_metrics(items, judged)
    return m.select("query_id", "hit_1", "hit_3", "hit_5", "hit_10", F.round("rr", 6).alias("rr"),
                    F.round("ndcg", 6).alias("ndcg"))


def retrieval_metrics(spark, d):
    items, judged = _judged(spark, d)
    return evaluation.mean_metrics(evaluation.per_query_metrics(items, judged))


def latency_percentiles(spark, d):
    out = evaluation.exact_percentiles(table(spark, d, "events"), "event_type", "value")
    return out.select("grp", "p", "value", "n", F.round("mean", 1).alias("mean"))


def latency_pass_rate(spark, d):
    """Share of samples per event type under a target, with a rounded mean."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("value") < 20).cast("double")), 4).alias("pass_rate"))


_METRIC_ROWS = f"""WITH {_ITEMS}, {M.bm25_ctes('documents', 'items', False)},
    b AS ({M.ranked('bm25', 'raw', 10)}),
    j AS (SELECT b.query_id, b.rank, contains(lower(d.text), lower(i.query_text))::INT AS rel
          FROM b JOIN documents d USING (doc_id) JOIN items i ON i.query_id = b.query_id),
    g AS (SELECT query_id, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END)::DOUBLE AS hit_1,
            max(CASE WHEN rank <= 3 THEN rel ELSE 0 END)::DOUBLE AS hit_3,
            max(CASE WHEN rank <= 5 THEN rel ELSE 0 END)::DOUBLE AS hit_5,
            max(CASE WHEN rank <= 10 THEN rel ELSE 0 END)::DOUBLE AS hit_10,
            min(CASE WHEN rel = 1 THEN rank END) AS fr,
            sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg,
            sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS nr FROM j GROUP BY query_id),
    m AS (SELECT i.query_id, coalesce(hit_1, 0) AS hit_1, coalesce(hit_3, 0) AS hit_3, coalesce(hit_5, 0) AS hit_5,
            coalesce(hit_10, 0) AS hit_10, coalesce(1.0 / fr, 0) AS rr,
            CASE WHEN nr > 0 THEN dcg / list_sum(list_transform(range(1, nr::BIGINT + 1), lambda i: 1.0 / log2(i + 1)))
                 ELSE 0 END AS ndcg
          FROM items i LEFT JOIN g USING (query_id))"""

QUERIES = {f.__name__: f for f in (
    bm25_term_stats, bm25_corpus_stats, bm25_search, bm25_search_boosted, boost_term_extraction, query_expansion,
    dense_topk, dense_topk_filtered, dense_threshold, legacy_similarity_top3, embedding_cache_split, embed_documents,
    dense_text_search, rrf_fuse, rrf_boosted, hybrid_search, rerank_lexical, rerank_summary,
    retrieval_metrics_per_query, retrieval_metrics, latency_percentiles, latency_pass_rate)}

ORACLES = {
    "bm25_term_stats": f"""WITH {_ITEMS}, {M.bm25_ctes('documents', 'items', False)}
        SELECT term, df, round(idf, 6) AS idf FROM idf JOIN raw USING (term)""",
    "bm25_corpus_stats": f"""SELECT count(*) AS n_docs, round(avg(len({M.tokens('text')})), 6) AS avgdl FROM documents""",
    "bm25_search": f"WITH {_ITEMS}, {M.bm25_ctes('documents', 'items', False)} {M.ranked('bm25', 'raw', 10)}",
    "bm25_search_boosted": f"WITH {_NAMED}, {M.bm25_ctes('documents', 'items', True)} {M.ranked('bm25', 'raw', 20)}",
    "boost_term_extraction": f"""WITH {_NAMED} SELECT query_id,
        array_to_string(list_sort({M.boost_terms('query_text')}), '|') AS terms FROM items""",
    "query_expansion": f"WITH {_ITEMS} SELECT query_id, md5(expanded) AS expanded_md5 FROM ({_expansion_sql('query_text')})",
    "dense_topk": _dense_sql(20),
    "dense_topk_filtered": _dense_sql(20, "label BETWEEN 3 AND 7"),
    "dense_threshold": _dense_sql(50, having="sum(cn.x * en.x) >= 0.2"),
    "legacy_similarity_top3": f"""SELECT query_id, id, rank, round(1 - (1 - score), 3) AS sim FROM ({_dense_sql(3)})""",
    "embedding_cache_split": """WITH k AS (SELECT DISTINCT md5(text) AS h FROM documents SEMI JOIN labels USING (doc_id))
        SELECT CASE WHEN k.h IS NULL THEN 'miss' ELSE 'hit' END AS state, count(*) AS documents,
               count(DISTINCT md5(text)) AS texts
        FROM documents LEFT JOIN k ON k.h = md5(text) GROUP BY 1""",
    "embed_documents": f"""SELECT doc_id, d, round(x, 6) AS x FROM ({M.hash_vectors('documents', 'doc_id', 'text', DIM)})
        WHERE x <> 0""",
    "dense_text_search": f"WITH {_FUSE_BASE} SELECT query_id, doc_id AS id, score, rank FROM dn",
    "rrf_fuse": f"""WITH {_FUSE_BASE},
        u AS (SELECT *, 0 AS l, 'dense' AS source, 0.6 AS w FROM dn UNION ALL SELECT *, 1, 'bm25', 0.4 FROM b),
        f AS (SELECT query_id, doc_id AS id, round(sum(w / (60 + rank)), 6) AS rrf_score,
                arg_max(source, score * 1000 - l * 0.00001) AS source,
                max(CASE WHEN l = 0 THEN rank END) AS dense_rank, max(CASE WHEN l = 1 THEN rank END) AS bm25_rank,
                min(l * 1000 + rank) AS seen FROM u GROUP BY ALL)
        SELECT query_id, id, rank, rrf_score, source, dense_rank, bm25_rank FROM (SELECT *, row_number() OVER
          (PARTITION BY query_id ORDER BY rrf_score DESC, seen) AS rank FROM f) WHERE rank <= 20""",
    "rrf_boosted": f"""WITH {_NAMED}, {M.bm25_ctes('documents', 'items', False)},
        b AS ({M.ranked('bm25', 'raw', 20)}),
        f AS (SELECT b.query_id, b.doc_id AS id, round(0.4 / (60 + b.rank), 6) AS rrf_score, b.rank AS seen,
              len(list_filter({M.boost_terms('i.query_text')}, lambda t: contains(lower(d.text), t))) > 0 AS hit
              FROM b JOIN items i ON i.query_id = b.query_id JOIN documents d ON d.doc_id = b.doc_id),
        g AS (SELECT *, rrf_score * CASE WHEN hit THEN 1.5 ELSE 1.0 END AS score FROM f)
        SELECT query_id, id, rank, rrf_score, round(score, 7) AS score FROM (SELECT *, row_number() OVER (PARTITION BY
          query_id ORDER BY round(score, 9) DESC, rrf_score DESC, seen) AS rank FROM g) WHERE rank <= 20""",
    "hybrid_search": f"""WITH {_NAMED}, xi AS MATERIALIZED ({_expansion_sql('query_text')}),
        {M.bm25_ctes('documents', 'xi', True, query_text='expanded', boost_text='expanded')},
        b AS ({M.ranked('bm25', 'raw', 20)}),
        dv AS MATERIALIZED ({M.hash_vectors('documents', 'doc_id', 'text', DIM)}),
        qv AS ({M.hash_vectors('xi', 'query_id', 'expanded', DIM)}),
        s AS (SELECT i.query_id, t.doc_id, coalesce(x.raw, 0) AS raw FROM (SELECT DISTINCT query_id FROM xi) i CROSS JOIN documents t
              LEFT JOIN (SELECT query_id, doc_id, sum(qv.x * dv.x) AS raw FROM qv JOIN dv USING (d) GROUP BY ALL) x
              ON x.query_id = i.query_id AND x.doc_id = t.doc_id),
        dn AS ({M.ranked('s', 'raw + 1e-9', 20)}),
        u AS (SELECT *, 0 AS l, 'dense' AS source, 0.6 AS w FROM dn UNION ALL SELECT *, 1, 'bm25', 0.4 FROM b),
        f AS (SELECT query_id, doc_id AS id, round(sum(w / (60 + rank)), 6) AS rrf_score,
                arg_max(source, score * 1000 - l * 0.00001) AS source, min(l * 1000 + rank) AS seen FROM u GROUP BY ALL),
        g AS (SELECT f.*, rrf_score * CASE WHEN len(list_filter({M.boost_terms('i.query_text')},
                lambda t: contains(lower(d.text), t))) > 0 THEN 1.5 ELSE 1.0 END AS score
              FROM f JOIN items i ON i.query_id = f.query_id JOIN documents d ON d.doc_id = f.id)
        SELECT query_id, id, rank, rrf_score, round(score, 7) AS score, source FROM (SELECT *, row_number() OVER
          (PARTITION BY query_id ORDER BY round(score, 9) DESC, rrf_score DESC, seen) AS rank FROM g) WHERE rank <= 20""",
    "rerank_lexical": f"{_RERANK_SQL} SELECT query_id, id, final_rank, score, ce_score FROM r WHERE final_rank <= 5",
    "rerank_summary": f"""{_RERANK_SQL} SELECT query_id, final_rank AS rank, 'bm25' AS source, ce_score,
        round(rrf_score, 5) AS rrf_score, substr(url, 1, 70) AS url_snippet, page_type,
        replace(substr(text, 1, 120), chr(10), ' ') AS text_snippet FROM r WHERE final_rank <= 5""",
    "retrieval_metrics_per_query": f"""{_METRIC_ROWS}
        SELECT query_id, hit_1, hit_3, hit_5, hit_10, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM m""",
    "retrieval_metrics": f"""{_METRIC_ROWS}
        SELECT count(*) AS n_queries, round(avg(hit_1), 4) AS recall_1, round(avg(hit_3), 4) AS recall_3,
               round(avg(hit_5), 4) AS recall_5, round(avg(hit_10), 4) AS recall_10, round(avg(rr), 4) AS mrr,
               round(avg(ndcg), 4) AS ndcg FROM m""",
    "latency_percentiles": """WITH s AS (SELECT event_type AS grp, list_sort(list(value)) AS v, count(*) AS n,
            avg(value) AS mean FROM events GROUP BY 1)
        SELECT grp, p, v[floor(n * p)::BIGINT + 1] AS value, n, round(mean, 1) AS mean
        FROM s CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS p)""",
    "latency_pass_rate": """SELECT event_type, count(*) AS n, round(avg((value < 20)::INT), 4) AS pass_rate
        FROM events GROUP BY 1""",
}
