"""Conversation prefix trie: balanced parentheses per shard, range min-max excess blocks, merged spines.

A node is a distinct sequence of first turns. Turns are digested to 128 bits, and prefixes are told apart by polynomial
sums of those digests, which compose: runs of one conversation in several partitions are summed apart and shifted, so that
a conversation of any length is spread over tasks.

Nodes are ordered by the list of branching nodes above them and then by depth, which is the order of a depth-first walk;
chains without branches add nothing to that list. Range partitions of that order are the shards. A shard writes its nodes
as balanced parentheses, and ``find_close`` looks for the end of every subtree through the smallest excess of blocks; ranks
count leaf pairs ``()`` and cumulative sums give savings and children. Nodes still open at the end of a shard are its spine.
Every shard also tells at which nodes it falls to a new least depth; from these few records, shards later in the order close
the spines of earlier ones. The driver holds one such list per shard, never nodes.

Nulls and ties: null turns come first, null role or text is empty; equal turns are ordered by role, then by a digest of the
text. A null conv_id (kept as -2^63 inside) is a conversation of its own, without the first turns of another, and the
smallest member of a node only if it is the only one. Repeated rows are turns. Texts of any length are read once each and only their digest moves on.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed

HEAD = 5  # a conversation takes at most so many first turns of another
BASE = 100
SHARD_NODES = 1 << 18
BLOCK = 64  # parentheses in a block of the excess index
_POWER = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they can be divided by
_WORD = 1 << 64
NONE = -(1 << 63)


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2^64; exponents may be negative."""
    out, square = np.ones(len(exponents), np.uint64), np.full(1, base, np.uint64)
    if len(exponents) and exponents.min() < 0:
        return np.where(exponents < 0, _powers(pow(base, -1, _WORD), np.maximum(-exponents, 0)), _powers(base, np.maximum(exponents, 0)))
    rest = exponents.astype(np.int64)
    while rest.any():
        out = np.where(rest & 1, out * square, out)
        square, rest = square * square, rest >> 1
    return out


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, p (place from 0), size (code points), t1, t2 (digest of the turn) and s1, s2 (sums up to this turn) of every turn."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("tie"), F.length(text).cast("long").alias("size"),
                        F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), F.md5(whole)).alias("t2"))
    order = ["conv_id", "turn", "role", "tie"]

    def runs(batches):
        part, last, count, sums = TaskContext.get().partitionId(), None, 0, (0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = _numbers(batch, "conv_id")
            starts = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
            lengths = np.diff(np.append(starts, len(ids)))
            if ids[0] != last:
                count, sums = 0, (0, 0)
            p = np.arange(len(ids)) - np.repeat(starts, lengths)
            p[:lengths[0]] += count
            found = []
            for k in (0, 1):
                t = _numbers(batch, f"t{k + 1}").view(np.uint64)
                total = np.cumsum(t * _powers(_POWER[k], p), dtype=np.uint64)
                before = np.append(np.uint64(0), total)[starts]
                before[:1] -= np.uint64(sums[k])
                found.append(total - np.repeat(before, lengths))
            last, count, sums = ids[-1], int(p[-1]) + 1, (found[0][-1], found[1][-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(np.full(len(ids), part)), pa.array(p), *(batch.column(c) for c in ("size", "t1", "t2")),
                 *(pa.array(f.view(np.int64)) for f in found)], names=["conv_id", "part", "p", "size", "t1", "t2", "s1", "s2"])

    stored = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        runs, "conv_id long, part long, p long, size long, t1 long, t2 long, s1 long, s2 long"))
    # a conversation in several partitions is the first or last of each: fewer such runs than twice the partitions
    ends = stored.groupBy("conv_id", "part").agg(F.max("p").alias("p"))
    several = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1").select("conv_id")
    cut = stored.join(ends.join(several, "conv_id"), ["conv_id", "part", "p"]).select("conv_id", "part", "p", "s1", "s2").collect()
    before: dict = {}
    at = None
    for r in sorted(cut, key=lambda r: (r.conv_id, r.part)):
        if at is None or at[0] != r.conv_id:
            at = (r.conv_id, 0, 0, 0)
        before[(r.conv_id, r.part)] = at[1:]
        at = (r.conv_id, at[1] + r.p + 1, *((s + pow(base, at[1], _WORD) * (x % _WORD)) % _WORD for s, base, x in zip(at[2:], _POWER, (r.s1, r.s2))))
    if not before:
        return stored.drop("part")

    def shifted(batches):
        for batch in batches:
            keys = zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist())
            off = np.array([before.get(k, (0, 0, 0)) for k in keys], np.uint64).reshape(-1, 3)
            n = off[:, 0].astype(np.int64)
            sums = [off[:, k + 1] + _powers(_POWER[k], n) * _numbers(batch, f"s{k + 1}").view(np.uint64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(_numbers(batch, "p") + n), *(batch.column(c) for c in ("size", "t1", "t2")),
                 *(pa.array(s.view(np.int64)) for s in sums)], names=["conv_id", "p", "size", "t1", "t2", "s1", "s2"])

    return checkpointed(stored.mapInArrow(shifted, "conv_id long, p long, size long, t1 long, t2 long, s1 long, s2 long"))


def rebuilt_steps(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, steps): all conv_ids with the depth of their last node; the node on each depth of each rebuilt conversation.

    steps: conv_id, depth, size, g1, g2 (the node) and o1, o2 (its parent).
    """
    rows = numbered_turns(turns)
    kept = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD + 1)).cast("int")
    first = F.when(F.col("p") < HEAD, F.struct("p", "size", "s1", "s2", "t1", "t2"))
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(first)).alias("own"))
    bases = convs.where(f"conv_id % {BASE} = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("others"))
    convs = convs.withColumn("h", F.when(F.col("conv_id") == NONE, 0).otherwise(kept)).withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE)
    convs = convs.join(bases, "base", "left").select(
        "conv_id", "n", "h", "own", F.coalesce(F.slice("others", F.lit(1), F.col("h")), F.expr("slice(own, 1, 0)")).alias("others"))
    convs = checkpointed(convs.withColumn("m", F.size("others")))
    # the sum of the first m turns taken over, and of the h own turns left out (all of them where there are no more)
    end = lambda array, n, s: F.coalesce(F.get(array, n - 1)[s], F.lit(0))
    sums = convs.select("conv_id", "h", "m", *(end("others", F.col("m"), s).alias(f"m{s[1]}") for s in ("s1", "s2")),
                        *(end("own", F.col("h"), s).alias(f"h{s[1]}") for s in ("s1", "s2")))
    own = rows.join(sums, "conv_id").where("p >= h").select(
        "conv_id", "p", "size", "t1", "t2", "s1", "s2", "h", "m", "m1", "m2", "h1", "h2")
    taken = convs.select("conv_id", F.explode("others").alias("x")).select(
        "conv_id", "x.p", "x.size", "x.t1", "x.t2", "x.s1", "x.s2", *(F.lit(0).alias(c) for c in ("h", "m")), *(F.lit(0).cast("long").alias(c) for c in ("m1", "m2", "h1", "h2")))

    def nodes(batches):
        for batch in batches:
            col = {c: _numbers(batch, c) for c in batch.schema.names if c != "conv_id"}
            shift = col["m"].astype(np.int64) - col["h"]
            out = []
            for k in (0, 1):
                s, m, h, t = (col[f"{c}{k + 1}"].view(np.uint64) for c in "smht")
                g = m + _powers(_POWER[k], shift) * (s - h)
                out.append((g, g - t * _powers(_POWER[k], col["p"] + shift)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(col["p"] + shift + 1), batch.column("size"),
                 *(pa.array(out[k][j].view(np.int64)) for j in (0, 1) for k in (0, 1))], names=["conv_id", "depth", "size", "g1", "g2", "o1", "o2"])

    steps = checkpointed(own.unionByName(taken).mapInArrow(nodes, "conv_id long, depth long, size long, g1 long, g2 long, o1 long, o2 long"))
    return convs.select("conv_id", F.expr("m + greatest(n - h, 0)").alias("depth")), steps


def end_digests(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, g1, g2 and ends_sha256 of every node at which conversations end, hashed as their sorted ids stream by."""
    last = convs.withColumn("depth", F.col("depth").cast("long"))
    ends = steps.join(last, ["conv_id", "depth"]).select("depth", "g1", "g2", "conv_id")
    rootless = convs.where("depth = 0").select(F.col("depth").cast("long"), *(F.lit(0).cast("long").alias(c) for c in ("g1", "g2")), "conv_id")
    ends = ends.unionByName(rootless)

    def hashed(batches):
        node, digest, any_yet = None, None, False
        for batch in batches:
            out = []
            for d, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("depth", "g1", "g2", "conv_id"))):
                if (d, a, b) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest, any_yet = (d, a, b), hashlib.sha256(), False
                if c != NONE:
                    digest.update(f",{c}".encode() if any_yet else str(c).encode())
                    any_yet = True
            yield from listed(out)
        yield from listed([(*node, digest.hexdigest())] if node else [])

    def listed(out):
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array(list(x), pa.int64()) for x in list(zip(*out))[:3]), pa.array([r[3] for r in out])],
                                             names=["depth", "g1", "g2", "ends_sha256"])

    keys = ["depth", "g1", "g2"]
    return ends.repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(hashed, "depth long, g1 long, g2 long, ends_sha256 string")


def parentheses(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(excess after every parenthesis, place of every node's opening one) of nodes in depth-first order."""
    closing = np.append(0, depth[:-1] - depth[1:] + 1)
    opening = np.arange(len(depth)) + np.cumsum(closing)
    step = np.full(len(depth) + int(closing.sum()), -1, np.int64)
    step[opening] = 1
    return depth[0] - 1 + np.cumsum(step), opening


def find_close(excess: np.ndarray, opening: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Place of the closing parenthesis of each opening one, or the number of parentheses where it is not among them."""
    n = len(excess)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.append(excess, np.full(-n % block, excess.max() + 1))
    levels = [padded]
    while len(levels[-1]) > 1:
        top = levels[-1]
        levels.append(np.append(top, np.full(-len(top) % block, top.max() + 1)).reshape(-1, block).min(axis=1))
    levels = [np.append(x, np.full(-len(x) % block, x.max() + 1)) for x in levels]
    at, want = opening + 1, excess[opening]  # the first place from ``at`` on with a lower excess
    place, todo, level = np.full(len(opening), n), np.arange(len(opening)), np.zeros(len(opening), np.int64)
    while len(todo):
        moved = at[todo]
        lower, over = np.zeros(len(todo), bool), np.zeros(len(todo), bool)
        for k in range(len(levels)):
            on = level[todo] == k
            ends = on & (moved >= len(levels[k]))
            over |= ends
            on &= ~ends
            lower[on] = levels[k][moved[on]] < want[todo[on]]
        down = lower & (level[todo] > 0)
        hit = lower & (level[todo] == 0)
        place[todo[hit]] = moved[hit]
        at[todo[down]] *= block
        level[todo[down]] -= 1
        on = ~lower & ~over
        step = todo[on]
        at[step] += 1
        up = step[(at[step] % block == 0) & (level[step] + 1 < len(levels))]
        at[up] //= block
        level[up] += 1
        todo = todo[~hit & ~over]
    return np.minimum(place, n)


def shard_counts(depth: np.ndarray, weight: np.ndarray):
    """Per node: children, leaves and weight of its subtree as far as the shard goes, and whether it is still open at the end.

    The last node counts as open and not as a leaf. Also the records: (depth, nodes of that depth before the next record,
    leaves and weight before it) wherever the depth falls below all before.
    """
    n = len(depth)
    excess, opening = parentheses(depth)
    close = find_close(excess, opening)
    is_open = close >= len(excess)
    after = np.searchsorted(opening, close)  # rank: nodes opened before the subtree is closed
    leaf = np.append(excess[opening[:-1] + 1] < excess[opening[:-1]], False)  # the pair ()
    leaves, weights = np.append(0, np.cumsum(leaf)), np.append(0, np.cumsum(weight))
    parent = _parents(depth)
    children = np.bincount(parent[parent >= 0], minlength=n)
    records, least = [], np.minimum.accumulate(depth)
    new = np.flatnonzero(np.append(True, least[1:] < least[:-1]))
    for a, b in zip(new.tolist(), np.append(new[1:], n).tolist()):
        records.append((int(depth[a]), int((depth[a:b] == depth[a]).sum()), int(leaves[a]), int(weights[a])))
    return children, leaves[after] - leaves[:-1], weights[after] - weights[:-1], is_open, records, int(leaves[-1]), int(weights[-1])


def _parents(depth: np.ndarray) -> np.ndarray:
    """Index of every node's parent, the latest node one step up; -1 where it is in an earlier shard."""
    n = len(depth)
    places = depth * n + np.arange(n)
    order = np.argsort(places)
    k = np.searchsorted(places[order], places - n) - 1
    found = order[np.maximum(k, 0)]
    return np.where((k >= 0) & (depth[found] == depth - 1), found, -1)


def closing_records(shards: list) -> tuple[dict, dict]:
    """For each shard, what follows it: records (depth, nodes, leaves before, weight before) and the totals of all that follows.

    ``shards``: (key, last depth, records, leaves, weight) in order. Also whether the last node of each shard is a leaf.
    """
    follows, leaf, future, total = {}, {}, [], (0, 0)
    for key, last, records, leaves, weight in reversed(shards):
        leaf[key] = int(not future or future[0][0] <= last)
        follows[key] = (future, total)
        leaves += leaf[key]
        least = records[-1][0]
        tied = sum(x[1] for x in future if x[0] == least)
        own = [*records[:-1], (records[-1][0], records[-1][1] + tied, *records[-1][2:])]
        future = own + [(d, n, a + leaves, b + weight) for d, n, a, b in future if d < least]
        total = (total[0] + leaves, total[1] + weight)
    return follows, leaf


def trie(turns: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per trie node of the rebuilt conversations of turns(conv_id, turn, role, text)."""
    convs, steps = rebuilt_steps(turns)
    smallest = F.coalesce(F.min(F.when(F.col("conv_id") != NONE, F.col("conv_id"))), F.lit(NONE))
    found = steps.groupBy("depth", "g1", "g2", "o1", "o2", "size").agg(smallest.alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = convs.agg(smallest.alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(c) for c in ("depth", "g1", "g2", "o1", "o2", "size")), "conv_id", "n_convs")
    nodes = checkpointed(found.unionByName(root))
    above = nodes.select(F.expr("depth + 1").alias("depth"), F.col("g1").alias("o1"), F.col("g2").alias("o2"), F.col("conv_id").alias("parent_conv_id"),
                         F.col("n_convs").alias("members"))
    nodes = checkpointed(nodes.join(above, ["depth", "o1", "o2"], "left"))
    branching = nodes.where("n_convs < members").select("depth", "g1", "g2")
    paths = steps.join(branching, ["depth", "g1", "g2"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "g1"))).alias("path"))
    keyed = nodes.join(paths, "conv_id", "left").withColumn(
        "path", F.expr("coalesce(transform(filter(path, x -> x.depth <= depth), x -> x.g1), cast(array() as array<bigint>))"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "size", "g1", "g2"]
    ordered = keyed.select(*columns, "path").repartitionByRange("path", "depth").sortWithinPartitions("path", "depth").drop("path")

    def shards(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= shard_nodes:
                yield from encoded(part, seq, held)
                seq, held = seq + 1, []
        yield from encoded(part, seq, held)

    def encoded(part, seq, held):
        table = pa.Table.from_batches(held).combine_chunks() if sum(b.num_rows for b in held) else None
        if table is None:
            return
        batch = table.to_batches()[0]
        depth = _numbers(batch, "depth")
        children, leaves, saved, is_open, records, all_leaves, all_saved = shard_counts(depth, (_numbers(batch, "n_convs") - 1) * _numbers(batch, "size"))
        n = len(depth)
        note = pa.array([None] * (n - 1) + [[x for r in records for x in r] + [all_leaves, all_saved]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in columns), pa.array(np.full(n, part)), pa.array(np.full(n, seq)), pa.array(children.astype(np.int64)),
             pa.array(leaves.astype(np.int64)), pa.array(saved.astype(np.int64)), pa.array(is_open), note],
            names=[*columns, "part", "seq", "n_children", "n_leaves", "saved_tokens", "is_open", "note"])

    schema = ", ".join(f"{c} long" for c in columns) + ", part long, seq long, n_children long, n_leaves long, saved_tokens long, is_open boolean, note array<long>"
    local = checkpointed(ordered.mapInArrow(shards, schema))
    notes = local.where("note is not null").select("part", "seq", "depth", "note").collect()
    listed = [((r.part, r.seq), r.depth, [tuple(r.note[i:i + 4]) for i in range(0, len(r.note) - 2, 4)], r.note[-2], r.note[-1])
              for r in sorted(notes, key=lambda r: (r.part, r.seq))]
    follows, leaf = closing_records(listed)
    shared = turns.sparkSession.sparkContext.broadcast((follows, leaf))

    def merged(batches):
        follows, leaf = shared.value
        for batch in batches:
            counts = [_numbers(batch, c).copy() for c in ("n_children", "n_leaves", "saved_tokens")]
            depth, part, seq = (_numbers(batch, c) for c in ("depth", "part", "seq"))
            for i in np.flatnonzero(batch.column("is_open").to_numpy(zero_copy_only=False)):
                key = (int(part[i]), int(seq[i]))
                future, (all_leaves, all_saved) = follows[key]
                counts[1][i] += leaf[key]
                for d, n, leaves, saved in future:
                    if d == depth[i] + 1:
                        counts[0][i] += n
                    if d <= depth[i]:
                        all_leaves, all_saved = leaves, saved
                        break
                counts[1][i] += all_leaves
                counts[2][i] += all_saved
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(c) for c in counts)],
                                             names=[*columns, "n_children", "n_leaves", "saved_tokens"])

    whole = local.drop("note").mapInArrow(merged, ", ".join(f"{c} long" for c in [*columns, "n_children", "n_leaves", "saved_tokens"]))
    empty = hashlib.sha256(b"").hexdigest()
    return whole.join(end_digests(steps, convs), ["depth", "g1", "g2"], "left").select(
        F.nullif("conv_id", F.lit(NONE)).alias("conv_id"), "depth", F.nullif("parent_conv_id", F.lit(NONE)).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
