"""Registered searches over stored indexes and collections, each built once from the given tables and then read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from gleanery.operators import blockmax
from gleanery.plans.search_queries import ORACLES as SEARCHES
from gleanery.plans.search_queries import _dense_sql, _items, _label_centroids
from gleanery.session import ensure_checkpoint_dir
from gleanery.sources.collections import VectorCollection
from gleanery.sources.tables import table


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def bm25_index_search(spark, d):
    """Keyword search from a stored block-max index."""
    index = blockmax.opened(spark, _folder(spark, "keywords"), table(spark, d, "documents"))
    return blockmax.search(index, _items(spark, d), k=10)


def _points(spark, d):
    """Embeddings with the payload of the document of the same number."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("page_type"), "source")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label",
                                                   F.concat(F.lit("course "), F.col("label").cast("string")).alias("course_code"),
                                                   F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("chunk_strategy"))
    return vectors.join(docs, "id", "left")


def _collection(spark, d) -> VectorCollection:
    collection = VectorCollection(spark, _folder(spark, "vectors"))
    collection.create(_points(spark, d))
    return collection


def dense_stored_search(spark, d):
    return _collection(spark, d).search(_label_centroids(spark, d), 20, page_type="en", chunk_strategy="odd")


def collection_scroll(spark, d):
    found = _collection(spark, d).scroll(page_type="en", source="src3", chunk_strategy=None)
    return found.select("id", "course_code", F.col("label").cast("bigint").alias("label"))


def collection_upsert(spark, d):
    """A collection after an upsert that relabels label 3 and adds copies of label 4 under new ids."""
    collection, e = _collection(spark, d), table(spark, d, "embeddings")
    changed = e.where("label = 3").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") + 100).alias("label"))
    added = e.where("label = 4").select((F.col("vec_id") + 1_000_000).alias("id"), "embedding", "label")
    collection.upsert(changed.unionByName(added))
    return collection.points().select(F.col("id").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.size("embedding").cast("bigint").alias("dim"))


QUERIES = {f.__name__: f for f in (bm25_index_search, dense_stored_search, collection_scroll, collection_upsert)}

ORACLES = {
    "bm25_index_search": SEARCHES["bm25_search"],
    "dense_stored_search": _dense_sql(20, "label % 2 <> 0 AND vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "collection_scroll": """SELECT vec_id AS id, 'course ' || label AS course_code, label::BIGINT AS label FROM embeddings
        WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3')""",
    "collection_upsert": """SELECT vec_id, CASE WHEN label = 3 THEN 103 ELSE label END::BIGINT AS label, len(embedding) AS dim FROM embeddings UNION ALL
        SELECT vec_id + 1000000, label::BIGINT, len(embedding) FROM embeddings WHERE label = 4""",
}
