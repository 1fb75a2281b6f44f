"""Near-duplicate passages by compact windows.

Tokens are shingles of ``width`` words (split at white space, A-Z lower-cased). For each of ``hashes`` hash functions the
Cartesian tree of a text's hashes groups its subsequences by where their minimum lies: node c stands for all of them
within (l, r) around c, and only windows of at least ``words`` words count. Only nodes that are the minimum of some
window of that length can have one; their neighbours in the tree are such nodes too, so the tree is built over them.

Exact repeats are settled by equality. Successive windows of ``words`` words with one minimum are a piece; pieces whose minimum
two rows share are told apart by a 128-bit digest. A piece that an earlier row holds goes as a whole; where a minimum has different
pieces, the windows of each one's first row are told apart by digests too, and go wherever an earlier row holds them. That is
complete, whatever else the earlier rows hold.

Near copies: windows whose minimum is the same shingle meet under (hash function, shingle). First each links to the first such window,
by doc_id. A window that neither this nor an exact repeat settles then meets all windows of earlier rows under its key, by sketches of
the shingles around the minimum; those with enough in common for a passage are compared with it, the closest first, in rounds until
none is left. So a near copy is found whatever comes first under its keys. What one row's passage holds beyond a part that is cut anyway
is found by the windows whose minimum lies there; a few words at its end may stay where no window has one. Where the intervals of a
document join those of an earlier one under at least ``agree`` hash functions, the two regions are compared: stretches of
shingles that the earlier region also holds, with gaps of at most two edits, are passages if they cover at least ``words``
words and their share of common shingles is at least ``similarity``, whatever follows beside them. The later passage is removed, so the
first copy stays.

Nulls and ties: null and empty texts have no passages and pass through. Rows without a doc_id come last in the order;
rows with equal doc_id go by a hash of the text; rows equal in both are treated alike and do not remove each other.
Repetition inside one document alone is kept. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import blocks, stored, text_bytes

WIDTH = 5
WORDS = 50
HASHES = 8
AGREE = 2
SIMILARITY = 0.8
CUT_BYTES = 1 << 20  # texts are cut in blocks of so many bytes: their arrays stay in the processor's cache
PART_REGIONS = 256  # about so many regions of a row are listed together
SKETCH_BITS = 1024
SKETCH_SLACK = 3  # so many more shingles may miss around a minimum than a passage's share allows: longer ones are not even
ROUND_SOURCES = 16  # earlier windows of a key that an open window is compared with in the first round
TILE_CELLS = 1 << 22  # pairs of windows whose sketches a task compares at a time
BATCH_TOKENS = 1 << 20  # tokens of the regions that a task yields at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64((1 << 28) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """(hash, row, number of its first word) of every shingle of a block of texts."""
    upper = (data >= 65) & (data <= 90)
    text = data + upper.astype(np.uint8) * 32
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1]))
    stop = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
    powers = np.ones(len(data) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    sums = np.append(np.uint64(0), np.add.accumulate((text.astype(np.uint64) + np.uint64(1)) * powers[:-1]))
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    down = np.ones(len(data) + 1, np.uint64)
    down[1:] = inverse
    down = np.multiply.accumulate(down)
    word = _mixed((sums[stop] - sums[start]) * down[start])
    row = np.searchsorted(offsets, start, "right") - 1
    number = np.arange(len(start)) - np.searchsorted(start, offsets[row])
    n = max(0, len(word) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * _BASE + word[j:j + n]
    ok = row[:n] == row[len(row) - n:] if n else np.zeros(0, bool)
    return _mixed(h)[ok], row[:n][ok], number[:n][ok]


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:len(x) - (width - k)], x[width - k:]) if width > k else x


def compact_windows(order: np.ndarray, row: np.ndarray, length: int):
    """(l, c, r), places in the block, of the nodes of each row's Cartesian tree whose windows hold ``length`` tokens."""
    none = np.zeros(0, np.int64)
    if len(order) < length:
        return none, none, none
    key = (order & ~_PLACE) | np.arange(len(order), dtype=np.uint64)  # ties go to the left
    least = _slide_min(key, length)
    whole = row[:len(least)] == row[length - 1:]
    c = (least[whole] & _PLACE).astype(np.int64)  # the place of the minimum never moves back as a window moves on
    c = c[np.append(True, c[1:] != c[:-1])] if len(c) else c
    ends = np.flatnonzero(np.append(row[1:] != row[:-1], True))
    of = np.searchsorted(ends, c)
    first, last = np.append(0, ends[:-1] + 1)[of], ends[of]
    values, rows = key[c].tolist(), row[c].tolist()
    left, right, stack = first.copy(), last.copy(), []
    for i, v in enumerate(values):
        if stack and rows[stack[-1]] != rows[i]:
            stack.clear()
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = c[i] - 1
        if stack:
            left[i] = c[stack[-1]] + 1
        stack.append(i)
    return left, c, right


def _seeds(hashes: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, hashes).astype(np.uint64)


def window_digests(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` successive shingle hashes, by binary digits of ``length``."""
    whole, used, k, weight = np.zeros(len(h), np.uint64), 0, 1, _BASE
    while k <= length:
        if length & k:
            n = max(0, len(h) - used) if used else len(h)
            whole = whole[:n] * weight + h[used:used + n] if used else h.copy()
            used += k
        if 2 * k <= length:
            h = h[:-k] * weight + h[k:]
            weight = np.multiply(weight, weight, dtype=np.uint64)
        k *= 2
    return _mixed(whole)


def exact_pieces(documents: DataFrame, width: int, words: int) -> DataFrame:
    """_row, rank, start (word), size (shingles), key, d1, d2 of every run of windows of ``words`` words that have one minimum."""
    length, seed = words - width + 1, _seeds(1)[0]

    def listed(batches):
        for part in blocks(batches, limit=CUT_BYTES):
            h, row, number = shingles(*text_bytes(part.column("text")), width)
            if len(h) < length:
                continue
            order = _mixed(h ^ seed)
            least = _slide_min((order & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length)
            at = np.flatnonzero(row[:len(least)] == row[length - 1:])
            c = (least[at] & _PLACE).astype(np.int64)
            new = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else c
            begin, end = at[new], at[np.append(new[1:], len(at)) - 1] + length if len(c) else c
            raw = h.tobytes()
            digest = b"".join(xxhash.xxh3_128_digest(raw[8 * a:8 * b]) for a, b in zip(begin.tolist(), end.tolist()))
            pair = np.frombuffer(digest, np.int64).reshape(-1, 2)
            of = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays(
                [part.column("_row").take(of), part.column("rank").take(of), pa.array(number[begin].astype(np.int64)),
                 pa.array(end - begin), pa.array(order[c[new]].view(np.int64)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())],
                names=["_row", "rank", "start", "size", "key", "d1", "d2"])

    return documents.mapInArrow(listed, "_row long, rank long, start long, size long, key long, d1 long, d2 long")


def exact_repeats(documents: DataFrame, width: int, words: int) -> DataFrame:
    """_row, other, start, stop of the windows of ``words`` words that an earlier row holds too, piece by piece; other is such a row.

    Equal windows have the same minimum, so only pieces around minima that two rows share are looked at. A later row's piece is
    repeated throughout; of the windows of a piece's first row, those that the first row of another piece holds.
    """
    length = words - width + 1
    found = stored(exact_pieces(documents, width, words))
    shared = found.groupBy("key").agg(F.min("_row").alias("a"), F.max("_row").alias("b")).where("a <> b").select("key")
    hits = stored(found.join(shared, "key"))
    kinds = stored(hits.groupBy("key", "d1", "d2").agg(F.min(F.struct("rank", "_row")).alias("own")))
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    placed = stored(hits.join(kinds, ["key", "d1", "d2"]).select("_row", F.col("own._row").alias("other"), "start", "size", "key"))
    whole = placed.where("_row <> other").select("_row", "other", "start", (F.col("start") + F.col("size") + width - 1).alias("stop"))
    lists = placed.where("_row = other").join(several, "key").groupBy("_row").agg(F.collect_set(F.struct("start", "size")).alias("wanted"))

    def listed(batches):
        for part in blocks(batches, limit=CUT_BYTES):
            h, row, number = shingles(*text_bytes(part.column("text")), width)
            begin = np.searchsorted(row, np.arange(part.num_rows))
            wanted = part.column("wanted").combine_chunks() if isinstance(part.column("wanted"), pa.ChunkedArray) else part.column("wanted")
            runs, of = wanted.flatten(), np.repeat(begin, pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            first, n = of + runs.field("start").to_numpy(), runs.field("size").to_numpy() - length + 1
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            to = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [part.column("_row").take(to), part.column("rank").take(to), pa.array(window_digests(h, length)[at].view(np.int64)),
                 pa.array(window_digests(_mixed(h), length)[at].view(np.int64)), pa.array(number[at].astype(np.int64))],
                names=["_row", "rank", "d1", "d2", "start"])

    held = documents.join(lists, "_row").select("_row", "rank", "text", "wanted").mapInArrow(listed, "_row long, rank long, d1 long, d2 long, start long")
    before = Window.partitionBy("d1", "d2").orderBy("rank", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = held.withColumn("other", F.first("_row").over(before)).where("_row <> other").select(
        "_row", "other", "start", (F.col("start") + words).alias("stop"))
    return stored(whole.union(inner))


def windows(documents: DataFrame, width: int, words: int, hashes: int) -> DataFrame:
    """_row, rank, key (the hash function in its low byte) and place (l and r) of every compact window of documents(_row, rank, text)."""
    length = words - width + 1
    seeds = _seeds(hashes)

    def listed(batches):
        for part in blocks(batches, limit=CUT_BYTES):
            h, row, number = shingles(*text_bytes(part.column("text")), width)
            for k, seed in enumerate(seeds):
                left, c, right = compact_windows(_mixed(h ^ seed), row, length)
                at = pa.array(row[c])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row").take(at), part.column("rank").take(at),
                     pa.array(((_mixed(h[c] ^ seed) & ~np.uint64(255)) | np.uint64(k)).view(np.int64)),
                     pa.array(number[left].astype(np.int64) << 32 | number[right])],
                    names=["_row", "rank", "key", "place"])

    return documents.mapInArrow(listed, "_row long, rank long, key long, place long")


def stretches(own: np.ndarray, other: np.ndarray, width: int, words: int, similarity: float) -> list[tuple[int, int]]:
    """Word ranges of ``own`` (shingle hashes of a region) that near-duplicate a part of ``other``.

    These are the places within any sub-range that begins and ends with a common shingle, has no gap above two edits, holds
    ``words`` words and reaches ``similarity``: what lies beside such a range does not count against it.
    """
    common = np.flatnonzero(np.isin(own, other))
    if not len(common):
        return []
    cuts = np.flatnonzero(np.diff(common) > 2 * width + 1) + 1
    out: list[tuple[int, int]] = []
    for run in np.split(common, cuts):
        if run[-1] - run[0] + width < words:
            continue
        # run[i]..run[j], n places with m common ones, is near enough if m >= similarity * (2n - m), so if end[j] >= begin[i]
        m = np.arange(len(run)) * (1 + similarity)
        begin, end = m - 2 * similarity * run, m + 1 + similarity - 2 * similarity * (run + 1)
        best = np.maximum.accumulate(end[::-1])[::-1]  # the best end at or after j; it falls with j
        last = np.searchsorted(-best, -begin + 1e-9, "right") - 1  # the last j that is near enough for i: the longest range
        for i in np.flatnonzero((last >= 0) & (run[last] - run + width >= words)):
            start, stop = int(run[i]), int(run[last[i]]) + width
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(stop, out[-1][1]))
            else:
                out.append((start, stop))
    return out


def region_batches(key: int, own: np.ndarray, wants: list[dict], limit: int = BATCH_TOKENS):
    """Record batches of the regions ``wants`` (l, r and, of later rows, other, ol, or) of a row's shingles ``own``, with at most ``limit`` tokens or one region each."""
    start, size = 0, 0
    for i, w in enumerate([*wants, None]):
        n = w["r"] - w["l"] + 1 if w else 0
        if i > start and (w is None or size + n > limit):
            few = wants[start:i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(few), pa.int64()), pa.array([x["l"] for x in few], pa.int32()), pa.array([x["r"] for x in few], pa.int32()),
                 pa.array([own[x["l"]:x["r"] + 1] for x in few], pa.list_(pa.int64())),
                 *(pa.array([x.get(k) for x in few], t) for k, t in (("other", pa.int64()), ("ol", pa.int32()), ("or", pa.int32())))],
                names=["_row", "l", "r", "tokens", "other", "ol", "or"])
            start, size = i, 0
        size += n


def compared(documents: DataFrame, links: DataFrame, width: int, words: int, similarity: float) -> DataFrame:
    """_row, other, start, stop (words) of the passages in the regions of links(_row, l, r, other, ol, or) (shingles)."""
    # each region is listed with the earlier one that it meets, and the earlier ones by themselves
    no = F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("int")
    ends = stored(links.select("_row", "l", "r", "other", "ol", "or").union(links.select("other", "ol", "or", *no).distinct()))
    # a row that many others link to is dealt in parts: no list and no task holds all of its regions
    parts = ends.groupBy("_row").agg(F.expr(f"count(1) div {PART_REGIONS} + 1").alias("parts"))
    lists = (ends.join(parts, "_row").groupBy("_row", F.expr("pmod(xxhash64(l, r, other, ol, or), parts)").alias("part"))
             .agg(F.collect_list(F.struct("l", "r", "other", "ol", "or")).alias("wanted")))
    # rows equal in id and text give the same regions: one is enough
    wanted = documents.join(parts, "_row", "left_semi").select("_row", "text").dropDuplicates(["_row"]).join(lists, "_row")

    def regions(batches):
        for part in blocks(batches):
            h, row, _ = shingles(*text_bytes(part.column("text")), width)
            h = h.view(np.int64)
            begin = np.searchsorted(row, np.arange(part.num_rows + 1))
            for i, (key, wants) in enumerate(zip(part.column("_row").to_pylist(), part.column("wanted").to_pylist())):
                yield from region_batches(key, h[begin[i]:begin[i + 1]], wants)

    tokens = wanted.select("_row", "text", "wanted").mapInArrow(regions, "_row long, l int, r int, tokens array<long>, other long, ol int, or int")
    source = [F.coalesce(x, y).alias(f"s{n}") for n, (x, y) in enumerate((("other", "_row"), ("ol", "l"), ("or", "r")))]
    both = tokens.select("*", *source).repartition("s0", "s1", "s2").sortWithinPartitions("s0", "s1", "s2", F.col("other").asc_nulls_first())

    def compare(batches):
        others = None  # the earlier region; those that meet it follow
        for batch in batches:
            rows, tokens = [], batch.column("tokens")
            for i, (row, other, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_row", "other", "l")))):
                own = tokens[i].values.to_numpy(zero_copy_only=False)
                if other is None:
                    others = own
                else:
                    rows += [(row, other, at + a, at + b) for a, b in stretches(own, others, width, words, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)],
                                             names=["_row", "other", "start", "stop"])

    return stored(both.mapInArrow(compare, "_row long, other long, start long, stop long"))


def _inside(spans: list | None, n: int, width: int) -> np.ndarray:
    """Which of a row's ``n`` shingles lie in its ``spans`` (words)."""
    steps = np.zeros(n + 1, np.int64)
    for s in spans or ():
        steps[min(s["start"], n)] += 1
        steps[min(max(s["start"], s["stop"] - width + 1), n)] -= 1
    return np.cumsum(steps)[:-1] > 0


def distinct_counts(values: np.ndarray, row: np.ndarray, length: int) -> np.ndarray:
    """How many different values each run of ``length`` places from here on has within its row (fewer places at the row's end)."""
    n = len(values)
    order = np.lexsort((np.arange(n), values, row))
    before = np.full(n, -1)
    same = (values[order[1:]] == values[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    before[order[1:][same]] = order[:-1][same]
    first = np.searchsorted(row, row)
    steps = np.zeros(n + 1, np.int64)  # a place counts for the runs that hold it and not its value's place before
    np.add.at(steps, np.maximum(np.maximum(before + 1, np.arange(n) - length + 1), first), 1)
    steps[1:] -= 1
    return np.cumsum(steps)[:-1]


def sketches(documents: DataFrame, holders: DataFrame, near: DataFrame, exact: DataFrame, width: int, words: int, hashes: int,
             similarity: float) -> DataFrame:
    """_row, rank, key, place, open, least and sketch of the windows of ``holders`` whose minimum no exact repeat has settled.

    ``open``: no near copy has settled it either. The sketch has a bit for each shingle that a window of ``words`` words around the
    minimum can hold, so that windows of a key are told apart without their texts; ``least``: the bits that a near copy of one has.
    """
    length, seeds = words - width + 1, _seeds(hashes)
    missing = length - int(np.ceil(2 * similarity * length / (1 + similarity) - 1e-9)) + SKETCH_SLACK
    listed = holders.groupBy("_row").agg(F.collect_set(F.struct("key", "place")).alias("wanted"))
    spans = [d.groupBy("_row").agg(F.collect_set(F.struct("start", "stop")).alias(c)) for d, c in ((near, "near"), (exact, "exact"))]
    texts = documents.join(listed.select("_row"), "_row", "left_semi").dropDuplicates(["_row"]).join(listed, "_row")
    texts = texts.join(spans[0], "_row", "left").join(spans[1], "_row", "left").select("_row", "rank", "text", "wanted", "near", "exact")

    def sketched(batches):
        for part in blocks(batches, limit=CUT_BYTES):
            h, row, _ = shingles(*text_bytes(part.column("text")), width)
            begin = np.searchsorted(row, np.arange(part.num_rows + 1))
            orders = [_mixed(h ^ seed) for seed in seeds]
            bits = (_mixed(h ^ _BASE) % np.uint64(SKETCH_BITS)).astype(np.int64)
            various = distinct_counts(bits, row, length)
            at, keys, places, free, least = [], [], [], [], []
            for i, (wants, near, exact) in enumerate(zip(*(part.column(c).to_pylist() for c in ("wanted", "near", "exact")))):
                n = int(begin[i + 1] - begin[i])
                settled, repeated = _inside(near, n, width), _inside(exact, n, width)
                for w in wants:
                    left, right = int(begin[i]) + (w["place"] >> 32), int(begin[i]) + (w["place"] & 0xFFFFFFFF)
                    c = left + int(orders[w["key"] & 255][left:right + 1].argmin())
                    if not repeated[c - begin[i]]:
                        a, b = max(left, c - length + 1), min(right + 1, c + length)
                        at.append((i, a, b))
                        least.append(max(1, int(various[a:b - length + 1].min()) - missing))
                        keys.append(w["key"])
                        places.append(w["place"])
                        free.append(not settled[c - begin[i]])
            for start in range(0, len(at), 4096):
                few = at[start:start + 4096]
                grid = np.zeros((len(few), SKETCH_BITS), bool)
                for k, (_, a, b) in enumerate(few):
                    grid[k, bits[a:b]] = True
                of = pa.array([x[0] for x in few], pa.int64())
                data = pa.py_buffer(np.packbits(grid, axis=1).tobytes())
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH_BITS // 8), len(few), [None, data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row").take(of), part.column("rank").take(of), pa.array(keys[start:start + 4096], pa.int64()),
                     pa.array(places[start:start + 4096], pa.int64()), pa.array(free[start:start + 4096]),
                     pa.array(least[start:start + 4096], pa.int32()), sketch],
                    names=["_row", "rank", "key", "place", "open", "least", "sketch"])

    return texts.mapInArrow(sketched, "_row long, rank long, key long, place long, open boolean, least int, sketch binary")


def key_matches(row: np.ndarray, free: np.ndarray, sketch: np.ndarray, least: np.ndarray, begin: int, end: int):
    """(target, source, more) among a key's windows, ordered by rank and row: for every open window the earlier rows' windows with which it
    has its ``least`` bits in common, the closest first, numbers ``begin`` to ``end``; more: there are others after these."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    start = np.repeat(first, np.diff(np.append(first, len(row))))  # windows before this one are of earlier rows
    targets = np.flatnonzero(free & (start > 0))
    height = max(1, TILE_CELLS // max(1, len(row)))
    for tile in (targets[i:i + height] for i in range(0, len(targets), height)):
        stop = int(start[tile].max())
        common = np.zeros((len(tile), stop), np.uint16)
        for w in range(sketch.shape[1]):
            common += np.bitwise_count(sketch[tile, w][:, None] & sketch[None, :stop, w])
        common[np.arange(stop)[None, :] >= start[tile][:, None]] = 0
        near = common >= least[tile][:, None]
        for k in np.flatnonzero(near.sum(1) > begin):
            found = np.flatnonzero(near[k])
            found = found[np.argsort(-common[k, found].astype(np.int64), kind="stable")]
            for source in found[begin:end]:
                yield int(tile[k]), int(source), len(found) > end


def matched(windows: DataFrame, begin: int, end: int) -> DataFrame:
    """_row, other, key, l, r, ol, or, more of the ``key_matches`` of windows(_row, rank, key, place, open, least, sketch)."""
    def listed(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            key = held.column("key").to_numpy()
            ready = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            yield from match(held.slice(0, ready))
            held = held.slice(ready)
        if held is not None:
            yield from match(held)

    def match(part):
        if part.num_rows == 0:
            return
        key, row, place = (part.column(c).to_numpy() for c in ("key", "_row", "place"))
        least = part.column("least").to_numpy()
        free = part.column("open").to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint64).reshape(part.num_rows, -1)
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), part.num_rows)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if row[a] != row[b - 1] and free[a:b].any():
                out += [(a + t, a + o, more) for t, o, more in key_matches(row[a:b], free[a:b], sketch[a:b], least[a:b], begin, end)]
        for i in range(0, len(out), 65_536):
            t, o, more = (np.array(x) for x in zip(*out[i:i + 65_536]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[t]), pa.array(row[o]), pa.array(key[t]),
                 *(pa.array(x.astype(np.int32)) for p in (place[t], place[o]) for x in (p >> 32, p & 0xFFFFFFFF)), pa.array(more)],
                names=["_row", "other", "key", "l", "r", "ol", "or", "more"])

    dealt = windows.repartition("key").sortWithinPartitions("key", "rank", "_row")
    return dealt.mapInArrow(listed, "_row long, other long, key long, l int, r int, ol int, or int, more boolean")


def further(documents: DataFrame, holders: DataFrame, near: DataFrame, exact: DataFrame, width: int, words: int, hashes: int,
            similarity: float) -> DataFrame:
    """_row, other, start, stop of near copies of other rows than the first of their keys, in rounds.

    Every window that is still open meets all windows of earlier rows under its key by their sketches. Those with enough in common for
    a passage are compared, the closest first: so many in the first round, four times as many in the next, until no open
    window has any left. Windows that a round settles need no more.
    """
    found, begin, end = None, 0, ROUND_SOURCES
    while True:
        pairs = stored(matched(sketches(documents, holders, near, exact, width, words, hashes, similarity), begin, end))
        links = stored(pairs.groupBy("_row", "other").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("ol").alias("ol"), F.max("or").alias("or")))
        now = compared(documents, links, width, words, similarity)
        found, near = now if found is None else found.union(now), near.union(now)
        left = pairs.where("more").select("key").distinct()
        if left.isEmpty():
            return found
        holders, begin, end = holders.join(left, "key", "left_semi"), end, end + 4 * (end - begin)


def passages(documents: DataFrame, width: int = WIDTH, words: int = WORDS, hashes: int = HASHES, agree: int = AGREE,
             similarity: float = SIMILARITY) -> DataFrame:
    """_row, other (the earlier row), start, stop (words) of the later passages of documents(_row, rank, text)."""
    before = Window.partitionBy("key").orderBy("rank", "_row", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("key")
    # what lies under a key of two rows; rows beyond the first two are held for the further rounds
    held = (windows(documents, width, words, hashes).withColumn("o", F.first(F.struct("_row", "place")).over(before))
            .withColumns({"a": F.min("_row").over(every), "b": F.max("_row").over(every), "n": F.count(F.lit(1)).over(every)})
            .where("a <> b").select("_row", "key", "place", "o", (F.col("n") > 2).alias("many")))
    held = stored(held)
    met = (held.where("_row <> o._row")
           .select("_row", F.col("o._row").alias("other"), F.expr("int(key & 255)").alias("fn"),
                   *[F.expr(e).alias(k) for p, a, b in (("place", "l", "r"), ("o.place", "ol", "or"))
                     for e, k in ((f"int(shiftright({p}, 32))", a), (f"int({p} & 4294967295)", b))]))
    links = stored(met.groupBy("_row", "other").agg(
        F.min("l").alias("l"), F.max("r").alias("r"), F.min("ol").alias("ol"), F.max("or").alias("or"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1, fn)"))).alias("fns")).where(F.col("fns") >= agree).drop("fns"))
    near = compared(documents, links, width, words, similarity)
    exact = exact_repeats(documents, width, words)
    more = further(documents, held.where("many").select("_row", "key", "place"), near, exact, width, words, hashes, similarity)
    return near.union(exact).union(more)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and the white space after each span."""
    words = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in sorted(spans):
        begin, end = words[a][0], words[b][0] if b < len(words) else len(text)
        if begin > at:
            kept.append(text[at:begin])
        at = max(at, end)
    kept.append(text[at:])
    return "".join(kept)


def identified(documents: DataFrame) -> DataFrame:
    """``documents`` with _row and rank, the place of its doc_id in the order of removal."""
    return documents.withColumn("_row", F.xxhash64("doc_id", "text")).withColumn(
        "rank", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))


def removed(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_spans, words_removed and text (what is left) of every document."""
    rows = identified(documents.select("doc_id", "text"))
    return _cut(rows, passages(rows.select("_row", "rank", "text"), **options)).select("doc_id", "n_spans", "words_removed", "text")


def deduplicated(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with later copies of passages cut from ``text``; other columns pass through, whatever their names."""
    keyed = identified(documents.select("doc_id", "text"))
    spans = passages(keyed.select("_row", "rank", "text"), **options)
    others = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"])
    cut = _cut(documents.select(F.xxhash64("doc_id", "text").alias("_row"), "text", others.alias("others")), spans)
    return cut.select(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in documents.columns])


def _cut(rows: DataFrame, found: DataFrame) -> DataFrame:
    spans = found.groupBy("_row").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    joined = rows.join(spans, "_row", "left")
    kept = [c for c in rows.columns if c not in ("text", "n_spans", "words_removed")]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("text", T.StringType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("words_removed", T.LongType())])

    def strip(batches):
        for part in blocks(batches):
            texts, counts, words = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist()):
                runs: list[list[int]] = []
                for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                texts.append(without_words(text, runs) if runs else text)
                counts.append(len(runs))
                words.append(sum(b - a for a, b in runs))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string()),
                                              pa.array(counts, pa.int64()), pa.array(words, pa.int64())], names=schema.names)

    return joined.select(*kept, "text", "_spans").mapInArrow(strip, schema)
