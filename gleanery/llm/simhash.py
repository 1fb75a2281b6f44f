"""SimHash near-duplicates: byte-position inverted index with count filtering.

Fingerprints that differ in at most ``bits`` of 64 bits agree in at least 8 - ``bits`` of their 8 bytes, each at its
position. The index lists fingerprints under groups of positional bytes, chosen so that any such pair meets in a list;
in a list, the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum are passed over and
the rest verified. Equal fingerprints are one entry. Lists emit spanning links, never all their pairs.

Nulls and ties: null and empty texts have fingerprint 0, which links like any other. The component id is the smallest
non-null doc_id of the component (null if all are null). Repeated rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import free_name
from gleanery.llm.common import checkpointed, components, text_bytes

WIDTH = 4
BITS = 4
SEED = 42
SMALL_LIST = 8
WORK_SHINGLES = 1 << 18


def fingerprint_of(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles; bit set where it is set in over half of the hashes."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return 0
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(norm))
    if len(starts) < width:
        return xxhash.xxh64_intdigest(norm, seed)
    starts, ends = starts[:len(starts) - width + 1], ends[width - 1:]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), WORK_SHINGLES):
        part = [digest(norm[a:b], seed) for a, b in zip(starts[i:i + WORK_SHINGLES].tolist(), ends[i:i + WORK_SHINGLES].tolist())]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int32)
    majority = np.packbits(votes * 2 > len(starts))
    return int.from_bytes(majority.tobytes(), "big")


def with_fingerprint(documents: DataFrame, width: int = WIDTH, seed: int = SEED, name: str = "_fp") -> DataFrame:
    """``documents`` with the signed 64-bit column ``name``."""

    @F.arrow_udf("long")
    def fingerprint(column: pa.Array) -> pa.Array:
        data, offsets = text_bytes(column)
        raw = data.tobytes()
        found = [fingerprint_of(raw[a:b], width, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return documents.withColumn(name, fingerprint(F.col("text")))


def position_groups(bits: int) -> list[tuple[int, ...]]:
    """Groups of byte positions of which any 8 - ``bits`` positions contain at least one.

    For four common bytes: triples inside three classes of positions, or two of one class and one of the next; any four
    positions hold such a triple, and 20 is the fewest possible. Otherwise all groups of the guaranteed size.
    """
    if bits != 4:
        return list(combinations(range(8), 8 - bits))
    classes = ((0, 1, 2), (3, 4, 5), (6, 7))
    inside = [t for c in classes for t in combinations(c, 3)]
    return inside + [(*pair, one) for i, c in enumerate(classes) for pair in combinations(c, 2) for one in classes[(i + 1) % 3]]


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Tally of shared positional bytes against the guaranteed minimum, then verification."""
    apart = a ^ b
    tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    near = tally >= 8 - bits
    near[near] = np.bitwise_count(apart[near]) <= bits
    return near


def _spanning(fps: np.ndarray, bits: int):
    """Links that join what is connected within one list: each reached entry is compared only with those not yet reached."""
    rest = fps
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            u = reached.pop()
            near = _near(rest, np.full(len(rest), u), bits)
            if near.any():
                v = rest[near]
                yield np.full(len(v), u), v
                reached.extend(v)
                rest = rest[~near]


def _links(keys: np.ndarray, fps: np.ndarray, bits: int):
    starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
    lengths = np.diff(np.append(starts, len(keys)))
    small = np.repeat(lengths <= SMALL_LIST, lengths)
    for d in range(1, SMALL_LIST):
        if d >= len(keys):
            break
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        near = _near(fps[i], fps[i + d], bits)
        yield fps[i][near], fps[i + d][near]
    for s, n in zip(starts[lengths > SMALL_LIST], lengths[lengths > SMALL_LIST]):
        yield from _spanning(fps[s:s + n], bits)


def links(fingerprints: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v) links among distinct fingerprints (column ``fp``) whose closure joins all pairs within ``bits`` bits."""
    groups = position_groups(bits)
    width = 8 * len(groups[0])
    keys = []
    for n, group in enumerate(groups):
        key = F.lit(n).cast("long")
        if width <= 48:
            for p in group:
                key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        else:
            key = F.xxhash64(key, *(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in group))
        keys.append(key)

    def within_lists(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(keys, fps):
            for u, v in _links(keys, fps, bits):
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:  # sorted by key; the last list of a batch may go on in the next
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if held and held[-1][0][-1] == keys[0] == keys[-1]:
                held.append((keys, fps))
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            held.append((keys[:cut], fps[:cut]))
            yield from flush(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])) if sum(
                len(k) for k, _ in held) else ()
            held = [(keys[cut:], fps[cut:])]
        if held:
            yield from flush(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    listed = fingerprints.select(F.explode(F.array(*keys)).alias("key"), "fp")
    return listed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(within_lists, "u long, v long")


def classes(fingerprints: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint; input: fp and doc_id of every row, cheap to read twice."""
    entries = fingerprints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    found = components(links(entries, bits)).select(F.col("node").alias("fp"), "root")
    rooted = entries.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(documents: DataFrame, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    rows = checkpointed(with_fingerprint(documents.select("doc_id", "text"), width).select("doc_id", F.col("_fp").alias("fp")))
    found = classes(rows, bits).select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """``documents`` with one row of each component left: the smallest doc_id, and of rows with that id the smallest text hash.

    Columns pass through unchanged, whatever their names. Rows without a doc_id come last in that order.
    """
    order = ["doc_id", "_hash"]
    tagged = with_fingerprint(documents.select(F.col("doc_id"), F.col("text")), width, name="fp")
    rows = checkpointed(tagged.select("doc_id", F.xxhash64("text").alias("_hash"), "fp"))
    rooted = rows.join(classes(rows, bits).select("fp", "root"), "fp")
    first = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "_hash")
    own, kept_id, kept_hash, n = (free_name(documents, c) for c in ("_hash", "_kept_id", "_kept_hash", "_n"))
    keep = rooted.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("doc_id").alias(kept_id), F.col("_hash").alias(kept_hash))
    hashed = documents.withColumn(own, F.xxhash64("text"))
    kept = hashed.join(keep, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_hash)), "left_semi")
    repeated = rows.groupBy(*order).count().where("count > 1").limit(1).count()
    if repeated:  # equal rows: one of them stays
        again = Window.partitionBy("doc_id", own).orderBy(F.lit(0))
        kept = kept.withColumn(n, F.row_number().over(again)).where(F.col(n) == 1).drop(n)
    return kept.drop(own)
