"""Exact substring removal with suffix arrays of shards, built by induced sorting.

Every byte that a ``length``-byte string covers which also starts anywhere else is removed; strings are judged on the
input and lie within one document.

Windows that are equal must meet in one shard. Each window of ``length`` bytes has an anchor, the smallest hash of its
``GRAM``-byte strings, which depends on its bytes alone; a run of windows with one anchor is a piece. A piece's anchor
and digest are counted first: pieces whose anchor occurs once, inside them too, hold nothing repeated, pieces with a digest that occurs
twice are repeated throughout, and only one piece of each digest is sent on, to the shard of its anchor. A shard joins
its pieces and sorts their suffixes: suffixes are classified (smaller or larger than the next), leftmost-smaller
substrings are sorted by an induction and named, their order is settled (by doubling ranks where names repeat), and a
second induction gives the array. Common prefixes of neighbours, up to ``length``, are kept in text order.

A shard ends between anchors, so it holds less than ``shard_bytes`` and one anchor's pieces beyond it. Where those exceed
``hot_bytes``, as for a notice in very many different contexts, the anchor is in no shard: each of its windows is told
apart by a 128-bit digest, counted over all tasks.

Nulls and ties: null and empty texts have nothing to remove; a document shorter than ``length`` is kept whole. Repeated
rows repeat each other's strings, so both lose them. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import blocks, stored, text_bytes

LENGTH = 200
GRAM = 32
SHARD_BYTES = 1 << 20
CUT_BYTES = 1 << 18  # texts are cut in blocks of so many bytes: their arrays stay in the processor's cache
HOT_BYTES = 4 << 20  # an anchor whose different pieces have more bytes is settled window by window
_BASE = np.uint64(0x9E3779B97F4A7C15)


# suffix arrays


def _classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the unique smallest."""
    n = len(s)
    differs = np.append(s[1:] != s[:-1], True)
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    nxt = np.minimum(nxt, n - 2)
    smaller = s[nxt] < s[np.minimum(nxt + 1, n - 1)]
    smaller[-1] = True
    return smaller


def _deal(found: list[list[np.ndarray]], s: np.ndarray, at: np.ndarray):
    """Append positions to the lists of their symbols, keeping their order within a symbol."""
    if not len(at):
        return
    c = s[at]
    order = np.argsort(c, kind="stable")
    c, at = c[order], at[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    for part, symbol in zip(np.split(at, cuts), c[np.append(0, cuts)].tolist()):
        found[symbol].append(part)


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffixes sorted by induction from ``lms``, the leftmost-smaller ones in the order wanted."""
    symbols = int(s.max()) + 1
    seeds: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    large: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    small: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _deal(seeds, s, lms)

    def before(at, kind):
        at = at[at > 0] - 1
        return at[smaller[at] == kind]

    for c in range(symbols):
        done = 0
        while done < len(large[c]):  # a bucket grows while its own symbol precedes
            at, done = np.concatenate(large[c][done:]), len(large[c])
            _deal(large, s, before(at, False))
        if seeds[c]:
            _deal(large, s, before(np.concatenate(seeds[c]), False))
    for c in reversed(range(symbols)):
        done = 0
        while done < len(small[c]):
            at, done = np.concatenate(small[c][done:]), len(small[c])
            _deal(small, s, before(at, True))
        if large[c]:
            _deal(small, s, before(np.concatenate(large[c])[::-1], True))
    small[0] = [np.array([len(s) - 1])]
    return np.concatenate([part for c in range(symbols) for part in (*large[c], *(p[::-1] for p in reversed(small[c])))])


def _ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by doubling ranks, until all differ or ``depth`` names are compared."""
    rank, k = names.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        if k < len(rank):
            after[:-k] = rank[k:] + 1
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key)
        new = np.append(0, key[order][1:] != key[order][:-1]).cumsum()
        rank[order] = new
        k *= 2
        if new[-1] == len(rank) - 1 or k >= depth:
            return order


def suffix_array(s: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Sorted suffixes of ``s``, whose last symbol, 0, occurs nowhere else; by their first ``limit`` symbols, if given."""
    if len(s) < 2:
        return np.arange(len(s))
    smaller = _classify(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        array = _induce(s, smaller, lms)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        order = array[is_lms[array]]
        size = np.diff(np.append(lms, len(s) - 1)) + 1  # a substring ends with the start of the next
        length = np.zeros(len(s), np.int64)
        length[lms] = size
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        live = np.flatnonzero(same)
        for k in range(int(size.max())):
            live = live[length[a[live]] > k]
            if not len(live):
                break
            differ = (s[a[live] + k] != s[b[live] + k]) | (smaller[a[live] + k] != smaller[b[live] + k])
            same[live[differ]] = False
            live = live[~differ]
        name = np.zeros(len(s), np.int64)
        name[order] = np.append(0, (~same).cumsum())
        lms = lms[_ranked(name[lms], len(s) if limit is None else limit)]
    return _induce(s, smaller, lms)


def permuted_prefixes(s: np.ndarray, array: np.ndarray, room: np.ndarray, limit: int) -> np.ndarray:
    """In text order: longest prefix, up to ``limit``, that a suffix shares with a neighbour in the array.

    ``room`` is the number of symbols a suffix may use; prefixes end there.
    """
    a, b = array[:-1], array[1:]
    most = np.minimum(np.minimum(room[a], room[b]), limit)
    follower, cap = np.full(len(s), -1, np.int64), np.zeros(len(s), np.int64)
    follower[a], cap[a] = b, most
    # where the next suffix's neighbour is the next one's too, a prefix is one longer than the next: only ends of such runs are compared
    inner = np.append((follower[1:] == follower[:-1] + 1) & (follower[:-1] >= 0), False)
    four = np.zeros(len(s), np.uint64)  # a suffix's first four symbols, compared at once while there is room
    for k in range(4):
        four[:max(0, len(s) - k)] |= s[k:].astype(np.uint64) << np.uint64(16 * k)
    common = np.zeros(len(s), np.int64)
    at = np.flatnonzero(~inner & (follower >= 0))
    live = at[cap[at] >= 4]
    while len(live):
        k = common[live]
        live = live[four[live + k] == four[follower[live] + k]]
        common[live] += 4
        live = live[common[live] + 4 <= cap[live]]
    live = at[common[at] < cap[at]]
    while len(live):
        k = common[live]
        live = live[s[live + k] == s[follower[live] + k]]
        common[live] += 1
        live = live[common[live] < cap[live]]
    stop = ~inner
    within = np.flatnonzero(inner)
    stop[within[s[within] != s[follower[within]]]] = True  # the prefix ends at a difference or at the run's end
    stop = np.flatnonzero(stop)
    end = stop[np.searchsorted(stop, within)]
    common[within] = np.minimum(end - within + common[end], cap[within])
    common = common[a]
    out = np.zeros(len(s), np.int64)
    out[a] = common
    out[b] = np.maximum(out[b], common)
    return out


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, whether the string of ``length`` bytes at each start also starts elsewhere in the parts."""
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    s = np.empty(int(sizes.sum() + len(parts)), np.uint16)
    room = np.zeros(len(s), np.int64)
    for at, p in zip(starts, parts):
        s[at:at + len(p)] = np.frombuffer(p, np.uint8)
        s[at:at + len(p)] += 2
        s[at + len(p)] = 1
        room[at:at + len(p)] = np.arange(len(p), 0, -1)
    s[-1] = 0
    prefix = permuted_prefixes(s, suffix_array(s, length), room, length)
    return [prefix[at:at + max(0, n - length + 1)] >= length for at, n in zip(starts, sizes)]


# pieces


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:len(x) - (width - k)], x[width - k:]) if width > k else x


def cut(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, start, size, anchor, whether the anchor's string occurs again in the piece) of the pieces of a block's texts."""
    gram = min(gram, length)
    n = len(data) - gram + 1
    if n < 1 or len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
    h, k, weight = data.astype(np.uint64), 1, _BASE
    whole, used = np.zeros(len(h), np.uint64), 0  # hash of the bytes dealt with so far, by binary digits of gram
    while k <= gram:
        if gram & k:
            m = len(h) if used == 0 else min(len(whole), len(h) - used)
            whole = h.copy() if used == 0 else whole[:m] * weight + h[used:used + m]
            used += k
        if 2 * k <= gram:
            h = h[:-k] * weight + h[k:]
            weight = np.multiply(weight, weight, dtype=np.uint64)
        k *= 2
    whole = whole[:n]
    whole ^= whole >> np.uint64(31)
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(29)
    least = _slide_min(whole, length - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    inside = np.arange(len(least)) + length <= offsets[row + 1]
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.minimum(np.append(first[1:], len(least)) - 1, offsets[row[first] + 1] - length)
    spans = np.lib.stride_tricks.sliding_window_view(whole, length - gram + 1)
    again = np.zeros(len(first), bool)
    for k in range(0, len(first), 4096):  # the anchor's first place, in the first window, and its last, in the last one
        at = slice(k, k + 4096)
        value = least[first[at]][:, None]
        leftmost = first[at] + (spans[first[at]] == value).argmax(1)
        rightmost = last[at] + length - gram - (spans[last[at], ::-1] == value).argmax(1)
        again[at] = leftmost < rightmost
    return row[first], first - offsets[row[first]], last - first + length, least[first].view(np.int64), again


def repeated_windows(pieces: DataFrame, length: int) -> DataFrame:
    """anchor, d1, d2 and a, b of every string of ``length`` bytes of ``pieces`` that also starts elsewhere in them, by a 128-bit digest.

    No task holds more than a batch of an anchor's pieces: equal strings meet as counts.
    """

    def listed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                raws = part.column("bytes").to_pylist()
                at = [np.arange(max(0, len(r) - length + 1)) for r in raws]
                of = pa.array(np.repeat(np.arange(len(raws)), [len(x) for x in at]))
                digest = b"".join(xxhash.xxh3_128_digest(r[a:a + length]) for r, x in zip(raws, at) for a in x.tolist())
                pair = np.frombuffer(digest, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(of) for k in ("anchor", "d1", "d2")] + [pa.array(x) for x in (np.concatenate(at), pair[:, 0].copy(), pair[:, 1].copy())],
                    names=["anchor", "d1", "d2", "a", "w1", "w2"])

    every = stored(pieces.mapInArrow(listed, "anchor long, d1 long, d2 long, a long, w1 long, w2 long"))
    several = every.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    return every.join(several, ["w1", "w2"]).select("anchor", "d1", "d2", "a", (F.col("a") + length).alias("b"))


def marked(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """_row and spans (start, stop) of the repeated strings of documents(_row, text)."""

    def listed(batches):
        for part in blocks(batches, limit=CUT_BYTES):
            data, offsets = text_bytes(part.column("text"))
            row, start, size, anchor, again = cut(data, offsets, length, gram)
            raw = data.tobytes()
            digest = [xxhash.xxh3_128_digest(raw[a:a + n]) for a, n in zip((offsets[row] + start).tolist(), size.tolist())]
            pair = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("_row").take(pa.array(row)), pa.array(start), pa.array(size), pa.array(anchor),
                 pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(again)],
                names=["_row", "start", "size", "anchor", "d1", "d2", "again"])

    found = stored(documents.mapInArrow(listed, "_row long, start long, size long, anchor long, d1 long, d2 long, again boolean"))
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 or again")
    hits = stored(found.drop("again").join(shared.select("anchor", "again"), "anchor"))
    kinds = stored(hits.groupBy("anchor", "d1", "d2").agg(
        F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), F.min(F.struct("_row", "start", "size")).alias("own")))
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("again").alias("again")).where("kinds > 1 or again")
    wanted = kinds.join(several.select("anchor"), "anchor")
    hot = stored(wanted.groupBy("anchor").agg(F.sum("own.size").alias("bytes")).where(F.col("bytes") > hot_bytes).select("anchor"))

    def packed(batches):  # texts are compressed before they are exchanged
        for part in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), pa.array([zlib.compress(t.encode(), 1) for t in part.column("text").to_pylist()], pa.binary())], names=["_row", "packed"])

    def fetched(batches):
        for batch in batches:
            for packed, wants in zip(batch.column("packed").to_pylist(), batch.column("wanted").to_pylist()):
                raw = zlib.decompress(packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w[k] for w in wants], pa.int64()) for k in ("anchor", "d1", "d2")]
                    + [pa.array([raw[w["start"]:w["start"] + w["size"]] for w in wants], pa.binary())],
                    names=["anchor", "d1", "d2", "bytes"])

    def pieces(of: DataFrame) -> DataFrame:
        lists = of.groupBy("own._row").agg(F.collect_list(F.struct("own.start", "own.size", "anchor", "d1", "d2")).alias("wanted"))
        texts = documents.where(F.octet_length("text") >= length).select("_row", "text").mapInArrow(packed, "_row long, packed binary")
        return texts.join(lists, "_row").select("packed", "wanted").mapInArrow(fetched, "anchor long, d1 long, d2 long, bytes binary")

    def shard(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            flags = repeated_starts([h[3] for h in held], length)
            rows = []
            for (anchor, d1, d2, _), flag in zip(held, flags):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
                rows += [(anchor, d1, d2, a, b - 1 + length) for a, b in edge.reshape(-1, 2).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)],
                                              names=["anchor", "d1", "d2", "a", "b"])

        for batch in batches:  # sorted by anchor: a shard ends between anchors
            for h in zip(*(batch.column(k).to_pylist() for k in ("anchor", "d1", "d2", "bytes"))):
                if size > shard_bytes and h[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(h)
                size += len(h[3])
        if held:
            yield flush()

    any_hot = not hot.isEmpty()
    calm = wanted.join(hot, "anchor", "left_anti") if any_hot else wanted
    inner = (pieces(calm).repartition("anchor").sortWithinPartitions("anchor", "d1", "d2")
             .mapInArrow(shard, "anchor long, d1 long, d2 long, a long, b long"))
    if any_hot:
        inner = inner.union(repeated_windows(pieces(wanted.join(hot, "anchor")), length))
    keys = ["d1", "d2"]  # a piece's bytes decide its anchor, which need not be exchanged again
    copied = kinds.where("n > 1").select(*keys, F.lit(0).cast("long").alias("a"), F.col("own.size").alias("b"))
    spans = hits.join(copied.union(inner.drop("anchor")), keys).select("_row", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("stop"))
    return spans.groupBy("_row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def deduplicated(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, kept (binary: the remaining bytes) and removed (runs) of every document."""
    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    joined = rows.join(marked(rows.select("_row", "text"), length, gram), "_row", "left")
    schema = T.StructType([documents.schema["doc_id"], *T._parse_datatype_string(
        "n_bytes long, kept binary, removed array<struct<start:long,stop:long>>").fields])

    def strip(batches):
        for part in blocks(batches):
            sizes, kept, removed = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                raw = (text or "").encode()
                runs = merged(spans)
                edges = [0, *(x for run in runs for x in run), len(raw)]
                sizes.append(len(raw))
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append([{"start": a, "stop": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=schema.names)

    return joined.select("doc_id", "text", "spans").mapInArrow(strip, schema)
