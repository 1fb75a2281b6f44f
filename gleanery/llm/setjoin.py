"""MinHash near-duplicates: chosen-path set similarity join.

A document's set holds its word shingles (64-bit hashes, told apart as such). Equal sets, by size and a 128-bit digest, are
one entry. Independent trees branch the entries recursively: a node of the first level holds the entries that agree in one
selected minwise token, and a node with more than ``LIMIT`` entries branches again by ``PICKS`` further minwise tokens that
its path selects. Nodes of at most ``LIMIT`` entries are compared exhaustively. A pair at the threshold is in some node of
a tree at any depth with probability 0.9375 or more, and of ``TREES`` independent trees all miss it with 6e-8 or less.

Groups of many near copies share all tokens and would never branch apart. So each first-level node first links its entries
to its smallest one, and where two such steps prove all of a node connected, it is done. A node that keeps at least ``SHARE`` of the
entries of the node above it, or is still large after the last level, is compared exhaustively too, in tiles of bounded
rows and set sizes: its largest connected part against the rest, and the rest against itself, so that work is only done for
entries that are not connected, whatever their number.

Candidates need sizes that allow the similarity and agreement of at least ``MATCH`` of ``TOKENS`` minwise tokens (a pair at
the threshold fails with 1e-8). Every link is confirmed on the full sets of both texts. For the first links, the texts of
the partners of one entry stream past that entry's set, and entries with many partners are dealt to several tasks. In a
node, the texts of entries that have a candidate there are read, all intersections are counted at once by products of
shingle incidence matrices, a bounded slice of shingles at a time, and spanning links are given out, never all pairs.

Nulls and ties: documents without words have an empty set and are linked with nothing. The component id is the smallest
non-null doc_id of the component (null if all are null), and a row without a doc_id is never kept. Rows that repeat, or
that share a doc_id, keep their own sets. A text of any length is one array in one task. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import blocks, components, settled, text_bytes
from gleanery.llm.passages import shingles

WIDTH = 4
PERCENT = 80
TREES = 6
PICKS = 2
LEVELS = 4
FIRST = TREES * PICKS  # minwise tokens of the first level
TOKENS = FIRST * LEVELS  # each level selects from tokens of its own
MATCH = 21
LIMIT = 32
SHARE = 0.5
TILE = 1024
TILE_SHINGLES = 1 << 19
SLICE = 1 << 12  # shingles of an incidence matrix
ROWS = 20_000  # entries of a stored partition
PAIRS_PER_TASK = 512  # pairs of one entry that are confirmed together
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SEEDS = _mixed(np.arange(1, TOKENS + 3, dtype=np.uint64) * _BASE)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """(hash, row) of the distinct shingles of every text, by row and hash; a text of fewer words has its whole sequence as one."""
    word, row, _ = shingles(data, offsets, 1)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    n = max(0, len(word) - width + 1)

    def joined(starts, length):
        h = np.full(len(starts), length, np.uint64)
        for j in range(length):
            h = _mixed(h * _BASE + word[starts + j])
        return h

    starts = np.flatnonzero(row[:n] == row[len(row) - n:]) if n else np.zeros(0, np.int64)
    h, of = [joined(starts, width)], [row[starts]]
    begin = np.cumsum(counts) - counts
    for length in range(1, width):
        few = np.flatnonzero(counts == length)
        h.append(joined(begin[few], length))
        of.append(few)
    h, of = np.concatenate(h), np.concatenate(of)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], of[new]


def set_digests(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.add.reduceat(_mixed(h ^ s), starts).view(np.int64) for s in _SEEDS[-2:])


def signed(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, k (the row, from id and text), n (set size), d1, d2 (digest of the set), heads and tokens (minwise tokens)."""

    def listed(batches):
        for part in blocks(batches):
            h, row = shingle_sets(*text_bytes(part.column("text")), width)
            n = np.bincount(row, minlength=part.num_rows)
            some = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[some]
            digests = [np.zeros(part.num_rows, np.int64) for _ in range(2)]
            tokens = np.zeros((part.num_rows, TOKENS), np.uint32)
            if len(some):
                for d, found in zip(digests, set_digests(h, starts)):
                    d[some] = found
                for k in range(TOKENS):
                    tokens[some, k] = np.minimum.reduceat(_mixed(h ^ _SEEDS[k]), starts).astype(np.uint32)
            heads, low = np.ascontiguousarray(tokens[:, :FIRST]).tobytes(), tokens.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("k"), pa.array(n.astype(np.int64)), *map(pa.array, digests),
                 pa.array([heads[i:i + 4 * FIRST] for i in range(0, len(heads), 4 * FIRST)], pa.binary()),
                 pa.array([low[i:i + TOKENS] for i in range(0, len(low), TOKENS)], pa.binary())],
                names=["doc_id", "k", "n", "d1", "d2", "heads", "tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("k"), "text")
    return rows.mapInArrow(listed, "doc_id long, k long, n long, d1 long, d2 long, heads binary, tokens binary")


def _bytes(column, width: int) -> np.ndarray:
    return text_bytes(column)[0].reshape(-1, width)


def first_nodes(entries: DataFrame) -> DataFrame:
    """(node, sid): every entry in ``PICKS`` nodes of each tree."""

    def branched(batches):
        for batch in batches:
            tokens = np.ascontiguousarray(_bytes(batch.column("heads"), 4 * FIRST)).view(np.uint32).astype(np.uint64)
            node = _mixed((tokens << np.uint64(8)) + np.arange(FIRST, dtype=np.uint64))
            sid = batch.column("sid").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64).ravel()), pa.array(np.repeat(sid, FIRST))], names=["node", "sid"])

    return entries.select("heads", "sid").mapInArrow(branched, "node long, sid long")


def branches(rows: DataFrame, level: int) -> DataFrame:
    """(node, sid, label, above) one level deeper: the path selects ``PICKS`` tokens of those that the level has to itself."""

    def branched(batches):
        for batch in batches:
            tokens, node = _bytes(batch.column("tokens"), TOKENS), batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            draw = _mixed(node + np.uint64(level))
            first = (draw % np.uint64(FIRST)).astype(np.int64)
            step = 1 + ((draw >> np.uint64(32)) % np.uint64(FIRST - 1)).astype(np.int64)
            for pick in range(PICKS):
                place = (first + pick * step) % FIRST + FIRST * level
                token = tokens[np.arange(len(node)), place].astype(np.uint64)
                child = _mixed(node * _BASE + (token << np.uint64(8)) + place.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(c) for c in ("sid", "label", "size"))], names=["node", "sid", "label", "above"])

    return rows.mapInArrow(branched, "node long, sid long, label long, above long")


def alike(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int, match: int) -> np.ndarray:
    """Whether set sizes allow the similarity and enough minwise tokens agree."""
    ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    ok[ok] = (a[ok] == b[ok]).sum(axis=1) >= match
    return ok


def candidates(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of distinct ``pairs`` whose sizes and tokens may belong to a link."""
    sides = [entries.select(F.col("sid").alias(x), F.col("n").alias(f"{x}_n"), F.col("tokens").alias(f"{x}_tokens")) for x in "uv"]

    def kept(batches):
        for batch in batches:
            sizes = (batch.column(f"{x}_n").to_numpy(zero_copy_only=False) for x in "uv")
            ok = alike(*sizes, *(_bytes(batch.column(f"{x}_tokens"), TOKENS) for x in "uv"), percent, MATCH)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    return pairs.join(sides[1], "v").join(sides[0], "u").mapInArrow(kept, "u long, v long")


def _by_node(batches, within):
    """Apply ``within`` to tables that hold whole nodes, of batches that are sorted by node."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(node, node[-1]))
        if cut:  # the last node may go on
            yield from within(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from within(pa.Table.from_batches(held).combine_chunks())


def _pairs(table: pa.Table, tokens: np.ndarray, percent: int):
    """(i, j) of rows of one node that may be alike and are not connected yet."""
    node, label, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
    for d in range(1, len(node)):
        i = np.flatnonzero(node[d:] == node[:-d])
        if not len(i):
            break
        i = i[label[i] != label[i + d]]
        yield (i := i[alike(n[i], n[i + d], tokens[i], tokens[i + d], percent, MATCH)]), i + d


def with_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """The ``rows`` (node, sid, label, n, tokens) that have a candidate in their node; nodes are bounded."""

    def kept(table):
        some = np.zeros(table.num_rows, bool)
        for i, j in _pairs(table, _bytes(table.column("tokens"), TOKENS), percent):
            some[i] = some[j] = True
        yield from table.filter(pa.array(some)).to_batches()

    schema = "node long, sid long, label long, n long, tokens binary"
    return (rows.select("node", "sid", "label", "n", "tokens").repartition("node").sortWithinPartitions("node", "sid")
            .mapInArrow(lambda batches: _by_node(batches, kept), schema))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct hashes."""
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # only shared hashes have a column
    shared = times[at] > 1
    column, of = place[at[shared]], of[shared]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        a, b = np.searchsorted(column, (start, start + SLICE))
        cells = np.zeros((len(sets), SLICE), np.float32)
        cells[of[a:b], column[a:b] - start] = 1
        both += (cells @ cells.T).astype(np.int64)
    return both


def spanning(linked: np.ndarray):
    """Links that join what a symmetric matrix of links joins."""
    rest = np.ones(len(linked), bool)
    for root in range(len(linked)):
        reached = [root] if rest[root] else []
        rest[root] = False
        while reached:
            u = reached.pop()
            new = np.flatnonzero(linked[u] & rest)
            rest[new] = False
            reached.extend(new.tolist())
            yield from ((u, v) for v in new.tolist())


def node_links(rows: DataFrame, entries: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v) links, confirmed on full sets, that join the entries which the nodes of ``rows`` prove connected."""
    rows = settled(with_candidates(rows, percent))
    wanted = settled(entries.join(rows.select("sid").distinct(), "sid").select("k", "sid", "d1", "d2"))
    texts = documents.select(F.xxhash64("doc_id", "text").alias("k"), "text").join(wanted, "k").select("sid", "d1", "d2", "text")

    def hashed(batches):
        """The rows with their sets in place of their texts."""
        for part in blocks(batches):
            h, row = shingle_sets(*text_bytes(part.column("text")), width)
            n = np.bincount(row, minlength=part.num_rows)
            some = np.flatnonzero(n)
            same = np.zeros(part.num_rows, bool)
            if len(some):  # else another text under the same row hash
                d1, d2 = (part.column(c).to_numpy(zero_copy_only=False)[some] for c in ("d1", "d2"))
                found = set_digests(h, (np.cumsum(n) - n)[some])
                same[some] = (found[0] == d1) & (found[1] == d2)
            sets = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(n))), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sets], names=[*names, "sets"]).filter(pa.array(same))

    def linked(table):
        tokens = _bytes(table.column("tokens"), TOKENS)
        pairs = list(_pairs(table, tokens, percent))
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs))
        node, sid, n = (table.column(c).to_numpy() for c in ("node", "sid", "n"))
        sets = table.column("sets").chunk(0)
        ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(node[a][1:] != node[a][:-1]) + 1
        out = []
        for x, y in zip(np.split(a, cuts), np.split(b, cuts)):
            own, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            both = intersections([flat[ends[i]:ends[i + 1]] for i in own])
            i, j = at[:len(x)], at[len(x):]
            near = 100 * both[i, j] >= percent * (n[own[i]] + n[own[j]] - both[i, j])
            links = np.zeros(both.shape, bool)
            links[i[near], j[near]] = links[j[near], i[near]] = True
            out += [(sid[own[u]], sid[own[v]]) for u, v in spanning(links)]
        if out:
            u, v = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    names = ["node", "sid", "label", "n", "tokens"]
    dealt = rows.join(texts, "sid").select(*names, "d1", "d2", "text").repartition("node").sortWithinPartitions("node", "sid")
    return settled(dealt.mapInArrow(lambda batches: _by_node(hashed(batches), linked), "u long, v long").distinct())


def confirmed(pairs: DataFrame, entries: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose full sets have the similarity."""
    pairs = settled(pairs)
    asked = pairs.select(F.col("u").alias("sid")).union(pairs.select("v")).distinct()
    wanted = settled(entries.join(asked, "sid").select("k", "sid", "d1", "d2"))
    texts = documents.select(F.xxhash64("doc_id", "text").alias("k"), "text").join(wanted, "k").select("sid", "d1", "d2", "text")
    parts = settled(pairs.groupBy("u").agg(F.expr(f"int(count(1) div {PAIRS_PER_TASK} + 1)").alias("parts")))
    dealt = pairs.join(parts, "u").select("u", "v", F.pmod(F.xxhash64("v"), "parts").alias("part"))
    heads = parts.select("u", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part")).select("u", "part", F.col("u").alias("sid"), F.lit(0).alias("turn"))
    rows = heads.unionByName(dealt.select("u", "part", F.col("v").alias("sid"), F.lit(1).alias("turn"))).join(texts, "sid")

    def compared(batches):
        at, own = None, None
        for batch in batches:
            for part in blocks([batch]):
                h, row = shingle_sets(*text_bytes(part.column("text")), width)
                begin = np.searchsorted(row, np.arange(part.num_rows + 1))
                u, group, sid, turn, d1, d2 = (part.column(c).to_pylist() for c in ("u", "part", "sid", "turn", "d1", "d2"))
                out = []
                for i in range(part.num_rows):
                    mine = h[begin[i]:begin[i + 1]]
                    if not len(mine) or tuple(int(d[0]) for d in set_digests(mine, np.zeros(1, np.int64))) != (d1[i], d2[i]):
                        continue  # another text under the same row hash
                    if turn[i] == 0:
                        at, own = (u[i], group[i]), mine
                    elif at == (u[i], group[i]):
                        place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                        both = int((own[place] == mine).sum())
                        if 100 * both >= percent * (len(own) + len(mine) - both):
                            out.append((u[i], sid[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    keys = ["u", "part", "turn", "sid", "d1", "d2", "text"]
    sorted_rows = rows.select(*keys).repartition("u", "part").sortWithinPartitions("u", "part", "turn")
    return settled(sorted_rows.mapInArrow(compared, "u long, v long").distinct())


def bounded_nodes(rows: DataFrame, entries: DataFrame, limit: int, tile: int, levels: int) -> DataFrame:
    """(node, sid, label, n, tokens) with bounded nodes that together hold every pair of the trees that is not connected yet."""
    facts = entries.select("sid", "n", "tokens")
    rows, out, ready = rows.withColumn("above", F.lit(None).cast("long")), ["node", "sid", "label", "n", "tokens"], []
    for level in range(1, levels + 1):
        nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("above").alias("above"))
        close = (F.col("size") >= SHARE * F.col("above")) if level < levels else F.lit(True)
        kind = F.when(F.col("size") <= limit, "small").when(F.coalesce(close, F.lit(False)), "close").otherwise("large")
        mixed = settled(nodes.where("low <> high").select("node", "size", kind.alias("kind")))
        whole = rows.drop("above").join(mixed, "node").join(facts, "sid")
        ready.append(whole.where("kind = 'small'").select(*out))
        kinds = {r.kind for r in mixed.select("kind").distinct().collect()}
        if "close" in kinds:
            ready.append(tiles(settled(whole.where("kind = 'close'").select(*out)), tile))
        if "large" not in kinds:
            break
        rows = settled(branches(whole.where("kind = 'large'").select("node", "sid", "label", "tokens", "size"), level).distinct())
    return reduce(DataFrame.unionByName, ready)


def tiles(rows: DataFrame, tile: int) -> DataFrame:
    """Nodes of any size as bounded ones that hold every pair with different labels: the largest label against the rest, and the rest."""
    counts = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    top = counts.groupBy("node").agg(F.max(F.struct("rows", "label", "shingles")).alias("top"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    parts = lambda a, b: F.expr(f"greatest(ceil(({a}) / {tile}), ceil(({b}) / {TILE_SHINGLES}))")
    dealt = settled(top.select("node", F.col("top.label").alias("main"), parts("top.rows", "top.shingles").alias("mains"),
                                    parts("rows - top.rows", "shingles - top.shingles").alias("rests")))
    dealt = rows.join(dealt, "node")
    is_main = F.col("label") == F.col("main")
    whole = F.expr("sequence(0L, rests - 1L)")
    facing = F.when(is_main, whole).otherwise(F.expr("sequence(0L, mains - 1L)"))
    tiled = dealt.withColumn("own", F.pmod(F.xxhash64("sid"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))))
    cell = lambda kind, a, b: F.xxhash64("node", F.lit(kind), a, b)
    across = tiled.withColumn("other", F.explode(facing)).withColumn(
        "node", F.when(is_main, cell(0, F.col("own"), F.col("other"))).otherwise(cell(0, F.col("other"), F.col("own"))))
    rest = tiled.where((~is_main) & (F.col("rests") > 1)).withColumn("other", F.explode(whole)).withColumn(
        "node", cell(1, F.least("own", "other"), F.greatest("own", "other")))
    return across.unionByName(rest).select(*rows.columns)


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, limit: int = LIMIT, tile: int = TILE, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents(doc_id, text)."""
    marked = settled(signed(documents, width), ROWS)
    entries = settled(marked.where("n > 0").groupBy("d1", "d2", "n", "heads", "tokens")
                           .agg(F.min("doc_id").alias("first_id"), F.min("k").alias("k")).withColumn("sid", F.monotonically_increasing_id()), ROWS)
    rows = first_nodes(entries)
    shared = settled(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("u")).where("size > 1").select("node", "u"))
    rows = settled(rows.join(shared, "node"))
    spokes = rows.where("u <> sid").select("u", F.col("sid").alias("v")).distinct()
    links = confirmed(candidates(spokes, entries, percent), entries, documents, width, percent)
    lowest = links.groupBy(F.col("v").alias("sid")).agg(F.min("u").alias("label"))  # one step to the smallest partner, and one more
    further = lowest.select(F.col("sid").alias("label"), F.col("label").alias("lower"))
    labels = settled(lowest.join(further, "label", "left").select("sid", F.coalesce("lower", "label").alias("label")))
    labelled = settled(rows.join(labels, "sid", "left").select("node", "sid", F.coalesce("label", "sid").alias("label")))
    links = links.union(node_links(bounded_nodes(labelled, entries, limit, tile, levels), entries, documents, width, percent))
    roots = settled(components(links, settled).select(F.col("node").alias("sid"), "root"))
    rooted = entries.select("sid", "d1", "d2", "n", "first_id").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = settled(rooted.join(roots, "sid", "left_semi").groupBy("root").agg(F.min("first_id").alias("lowest")))
    classes = rooted.join(lowest, "root", "left").select("d1", "d2", "n", F.coalesce("lowest", "first_id").alias("class_id"))
    found = marked.select("doc_id", "n", "d1", "d2").join(settled(classes), ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
