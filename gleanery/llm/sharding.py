"""Shards by a hierarchical weighted hash tree: region, rack and shard are drawn one level after the other.

A tree is a tuple of regions, a region a tuple of racks, a rack a tuple of (shard number, weight). At each level every
child of the chosen node draws -ln(u) / weight, u being a hash of the key and the child's label, and the smallest draw
wins; a node's weight is the sum of its shards' weights. A changed weight changes no other child's draw, so rows move
only between that subtree and the rest, never between two unchanged siblings.

Nulls and ties: a null key is a key like any other; equal draws go to the smaller label; repeated keys share a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed, gapless_rank

Tree = tuple[tuple[tuple[tuple[int, float], ...], ...], ...]


def uniform_tree(shards: int, regions: int = 2, racks: int = 4, per_rack: int = 3) -> Tree:
    """Shards 0, 1, ... of weight 1, filled rack by rack up to regions x racks x per_rack; each further shard is grown."""
    base = regions * racks * per_rack
    first = list(range(min(shards, base)))
    filled = [tuple((s, 1.0) for s in first[i:i + per_rack]) for i in range(0, len(first), per_rack)]
    tree = tuple(tuple(filled[i:i + racks]) for i in range(0, len(filled), racks))
    for shard in range(base, shards):
        tree = grown(tree, shard)
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own: rows move only into the new shard."""
    return (*tree, (((shard, weight),),))


def _weight(node) -> float:
    return sum(weight for rack in node for _, weight in rack)


def _draw(key: Column, label: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, label), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(u) / weight


def _choose(key: Column, children: Column) -> Column:
    """Label of the child with the smallest draw; a child of weight 0 never wins."""
    drawn = F.transform(F.filter(children, lambda c: c["w"] > 0),
                        lambda c: F.struct(_draw(key, c["label"], c["w"]).alias("draw"), c["label"].alias("label")))
    return F.array_min(drawn)["label"]


def _children(nodes: list[tuple[str, float]]) -> Column:
    return F.array(*(F.struct(F.lit(label).alias("label"), F.lit(float(w)).alias("w")) for label, w in nodes))


def _levels(tree: Tree):
    regions = [(f"r{i}", _weight(region)) for i, region in enumerate(tree)]
    racks = {f"r{i}": [(f"r{i}/k{j}", _weight((rack,))) for j, rack in enumerate(region)] for i, region in enumerate(tree)}
    shards = {f"r{i}/k{j}": [(f"s{s}", w) for s, w in rack] for i, region in enumerate(tree) for j, rack in enumerate(region)}
    return regions, racks, shards


def assign(df: DataFrame, tree: Tree, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``df`` with the int column ``name``: the shard of its key. Built-in expressions only, no exchange."""
    regions, racks, shards = _levels(tree)

    def below(parents: dict, chosen: Column) -> Column:
        table = F.create_map(*(x for p, nodes in parents.items() for x in (F.lit(p), _children(nodes))))
        return F.element_at(table, chosen)

    k = F.col(key)
    staged = df.withColumn("_region", _choose(k, _children(regions)))
    staged = staged.withColumn("_rack", _choose(k, below(racks, F.col("_region"))))
    staged = staged.withColumn(name, F.substring(_choose(k, below(shards, F.col("_rack"))), 2, 9).cast("int"))
    return staged.drop("_region", "_rack")


def sharded(documents: DataFrame, shards: int = 24, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    ``size`` is the UTF-8 length of the text plus 8 (null: 8); ``slot`` numbers the rows of a shard from 0 without gaps;
    ``grown_shard`` is the shard once one more shard has been added. An empty table gives no rows.
    """
    tree = tree or uniform_tree(shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                            F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(assign(rows, tree), grown(tree, shards), name="grown_shard")
    return gapless_rank(checkpointed(rows), "shard", ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
