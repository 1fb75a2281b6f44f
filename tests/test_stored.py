"""Stored keyword index and vector collection: what a search opens, and what an upsert moves."""

import contextlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.operators import blockmax, bm25
from gleanery.plans.search_queries import _items
from gleanery.sources.collections import VectorCollection
from gleanery.sources.tables import table


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("keywords"))
    return path, blockmax.build(table(spark, data, "documents"), f"{path}/a", block_docs=8)


def test_block_max_search_equals_scoring_everything(spark, data, index):
    docs, items = table(spark, data, "documents"), _items(spark, data)
    want = sorted(map(tuple, bm25.search(docs, items, k=10, boost=False).collect()))
    for probes in (1, 8, 1000):
        assert sorted(map(tuple, blockmax.search(index[1], items, k=10, probes=probes).collect())) == want
    few = blockmax.search(index[1], items, k=100_000)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, bm25.search(docs, items, k=100_000, boost=False).collect()))


def test_block_max_skips_blocks(spark, data, index):
    read = blockmax.blocks_read(index[1], _items(spark, data), k=3, probes=2).agg(F.sum("opened"), F.sum("blocks")).first()
    assert 0 < read[0] < 0.8 * read[1]


def test_block_max_reads_only_its_index(spark, data, index):
    plan = plan_of(blockmax.search(index[1], _items(spark, data), k=10))
    assert "documents.parquet" not in plan and "PartitionFilters: [" in plan and "shelf" in plan


def test_block_index_is_built_once(spark, index):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, "")], "doc_id long, text string")
    path = f"{index[0]}/b"
    blockmax.opened(spark, path, docs)
    again = blockmax.opened(spark, path, docs.limit(0))
    asked = spark.createDataFrame([("q", "beta alpha"), ("none", "delta"), ("null", None)], "query_id string, query_text string")
    got = [(r.query_id, r.doc_id, r.score) for r in blockmax.search(again, asked, 5).collect()]
    assert sorted(got) == sorted((r.query_id, r.doc_id, r.score) for r in bm25.search(docs, asked, 5, boost=False).collect())
    empty = blockmax.opened(spark, f"{index[0]}/c", docs.limit(0))
    assert blockmax.search(empty, asked, 5).count() == 0


def test_blocks_of_equal_lengths(spark):
    lengths = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, 5).otherwise(F.col("id")).cast("int").alias("dl"))
    sizes = [r["count"] for r in blockmax.with_blocks(lengths, 10).groupBy("block").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 40


def shuffle_bytes(spark) -> int:
    files, total = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), 0
    while files.hasNext():
        f = files.next()
        total += f.length() if f.getName().startswith("shuffle_") else 0
    return total


def test_block_index_leaves_no_shuffles(spark, tmp_path):
    """What building and planning exchange is dropped step by step; every posting is exchanged once."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3000))) for k in range(60)]).alias("text"))
    asked = docs.where("doc_id < 20").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    before = shuffle_bytes(spark)
    index = blockmax.build(docs, str(tmp_path))
    assert shuffle_bytes(spark) - before < 100_000
    blockmax.planned(index, asked, 5)
    assert shuffle_bytes(spark) - before < 100_000
    want = sorted(map(tuple, bm25.search(docs, asked, k=5, boost=False).collect()))
    assert sorted(map(tuple, blockmax.search(index, asked, k=5).collect())) == want


def test_block_index_exchanges_postings_once(spark, data):
    docs = table(spark, data, "documents").select("doc_id", blockmax.T.tokens(F.col("text")).alias("tokens"))
    lengths = docs.select("doc_id", F.size("tokens").alias("dl"))
    postings = blockmax.placed_postings(docs, lengths, None, 64)
    rows = blockmax.block_rows(postings, F.col("tf") / F.col("dl"), 64, 8)
    tree = plan_of(rows).split("\n\n")[0]
    counted = tree[:tree.index("MapInArrow")]
    assert counted.count("Exchange") == 1, tree
    assert rows.agg(F.sum(F.size("docs"))).first()[0] == docs.select(F.sum(F.size(F.array_distinct("tokens")))).first()[0]


def test_block_index_of_repeated_ids(spark, tmp_path):
    """Rows equal in id and length are one document with the terms of all; its postings lie in the block of each of its rows."""
    texts = [(1, "alpha beta beta"), (1, "alpha beta beta"), (2, "beta gamma"), (2, "delta beta delta beta"), (None, "alpha"), (3, None), (4, "gamma gamma alpha")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = blockmax.build(docs, str(tmp_path), block_docs=1)
    lists = index.blocks.select("term", F.explode(F.arrays_zip("docs", "impacts")).alias("x")).select("term", "x.docs", F.round("x.impacts", 6)).collect()
    counts = Counter((d, len(t.split()), w) for d, t in texts if d and t for w in t.split())
    rows = Counter(d for d, _ in texts)
    average = sum(len((t or "").split()) for _, t in texts) / len(texts)
    want = [(w, d, round(n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / average)), 6)) for (d, dl, w), n in counts.items() for _ in range(rows[d])]
    assert sorted(map(tuple, lists)) == sorted(want)


@pytest.fixture
def collection(spark, tmp_path):
    rows = [(i, [float(i), 1.0], ("faculty", "course", None)[i % 3], f"s{i % 2}", "atomic") for i in range(60)]
    points = spark.createDataFrame(rows, "id long, embedding array<double>, page_type string, source string, chunk_strategy string")
    made = VectorCollection(spark, f"file://{tmp_path}/points", buckets=8)
    assert not made.exists() and made.needs_build(points)
    assert made.create(points) and not made.create(points) and not made.needs_build(points)
    return made


def test_collection_prunes_by_payload(collection, spark):
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    found = collection.search(asked, 100, page_type="course", source="s1", chunk_strategy="atomic")
    assert sorted(r.id for r in found.collect()) == [i for i in range(60) if i % 3 == 1 and i % 2 == 1]
    plan = plan_of(collection.scroll(page_type="course", chunk_strategy="atomic"))
    assert "page_type" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert "chunk_strategy" in plan.split("PushedFilters:")[1].split("\n")[0]
    assert "embedding" not in plan.split("ReadSchema:")[1].split("\n")[0]
    with pytest.raises(ValueError):
        collection.scroll(colour="red")


def test_collection_upsert_leaves_the_stored_side_where_it_is(collection, spark):
    new = spark.createDataFrame([(3, [9.0, 9.0], "course", "s0", 1), (3, [8.0, 8.0], "course", "s0", 2), (99, [1.0, 1.0], None, None, 1)],
                                "id long, embedding array<double>, page_type string, source string, version int")
    merged = collection.merged(new, "version")
    merged.collect()
    assert plan_of(merged).count("Bucketed: true") == 1
    tree = plan_of(merged).split("\n\n")[0]
    scan = next(i for i, line in enumerate(tree.split("\n")) if "Scan parquet" in line)
    above = tree.split("\n")[:scan]
    depth = lambda line: len(line) - len(line.lstrip(" :|+-*"))
    at = depth(tree.split("\n")[scan])
    path = []
    for line in reversed(above):  # the ancestors of the scan
        if depth(line) < at:
            path.append(line)
            at = depth(line)
    join = next(i for i, line in enumerate(path) if "Join" in line)
    assert not any("Exchange" in line for line in path[:join]), tree
    assert collection.upsert(new, "version")
    rows = {r.id: (r.embedding, r.page_type) for r in collection.points().collect()}
    assert len(rows) == 61 and rows[3] == ([8.0, 8.0], "course") and rows[99] == ([1.0, 1.0], None)
    before = collection._current()
    assert not collection.upsert(new.where("version = 2").drop("version")) and collection._current() == before
    collection.reset()
    assert collection.exists() and collection.count() == 0
