"""Benchmark decontamination by the q-gram lemma.

Texts are compared as lower-case words with single blanks. A benchmark item of m characters occurs in a document if some
stretch of it is within e = floor(``rate`` * m) edits. Such a stretch shares at least m - q + 1 - q e character q-grams
with the item, all on diagonals at most e apart; so q-grams are counted in diagonal bands of 2 (e + 1), overlapping by
half, bands that reach the bound are kept, and a banded alignment decides. The bound holds for any gram length that keeps
it positive with the same e; items whose e leaves room are counted with grams of ``LONG_Q`` characters, which are rarer.

The items go to the tasks in blocks of at most ``block_chars`` characters, one pass over the documents per block, so that
what is broadcast is bounded whatever the benchmark's size.

Nulls and ties: null and empty texts match nothing; items of fewer than q characters (and null ones) identify nothing
and are left out; where q e would void the bound, e is lowered until one shared q-gram is required. Repeated rows and
items are reported one by one; of several places of one item in a document the one with the fewest edits, then the first,
is reported. Empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import free_name
from gleanery.llm.common import blocks

Q = 6
LONG_Q = 8
CELLS = 1 << 20
RATE = 0.1
BLOCK_CHARS = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Mixed hashes of all q-grams, put together from grams of 1, 2, 4, ... characters."""
    n = max(0, len(codes) - q + 1)
    h, at = np.zeros(n, np.uint64), 0
    power, size, factor = codes.astype(np.uint64), 1, _BASE
    while n:
        if q & size:
            h = h * factor + power[at:at + n]
            at += size
        size *= 2
        if size > q:
            break
        power = power[:-(size // 2)] * factor + power[size // 2:]
        factor = np.uint64(pow(int(factor), 2, 1 << 64))
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def aligned(item: np.ndarray, text: np.ndarray, first: int, width: int) -> int:
    """Fewest edits that turn ``item`` into a stretch of ``text`` along diagonals first .. first + width - 1."""
    steps = np.arange(width)
    padded = np.full(width + len(item), -1, np.int64)
    lo, hi = max(first, 0), min(first + len(padded), len(text))
    if hi > lo:
        padded[lo - first:hi - first] = text[lo:hi]
    row = np.zeros(width, np.int64)
    for i, c in enumerate(item):
        change = row + (padded[i:i + width] != c)
        change[:-1] = np.minimum(change[:-1], row[1:] + 1)
        row = np.minimum.accumulate(change - steps) + steps
    return int(row.min())


def edit_budget(size: np.ndarray, q: int, rate: float) -> np.ndarray:
    return np.minimum((rate * size).astype(np.int64), (size - q) // q)


class Index:
    """q-grams of the items: sorted values, and the (item, position) pairs of each. All items share one gram length ``gram``."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, rate: float, gram: int):
        self.q = gram
        self.ids, self.codes = [i for i, _ in items], [c for _, c in items]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = edit_budget(self.size, q, rate)
        self.bound = self.size - gram + 1 - gram * self.edits
        grams = [_grams(c, gram) for c in self.codes]
        value = np.concatenate(grams)
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(value, kind="stable")
        self.value, self.first, self.count = np.unique(value[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.value >> np.uint64(42)] = True

    def matches(self, whole: np.ndarray, starts: np.ndarray):
        """Text, item, band and place in the item of every shared q-gram that lies in a band which may reach its bound."""
        grams = _grams(whole, self.q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(42)])
        slot = np.minimum(np.searchsorted(self.value, grams[at]), len(self.value) - 1)
        same = self.value[slot] == grams[at]
        at, slot = at[same], slot[same]
        count = self.count[slot]
        pick = np.repeat(self.first[slot] - np.cumsum(count) + count, count) + np.arange(count.sum())
        item, place, at = self.item[pick], self.place[pick], np.repeat(at, count)
        doc = np.repeat(np.searchsorted(starts, at[np.cumsum(count) - count], "right") - 1, count) if len(at) else at
        band = (at - starts[doc] - place + self.size[item]) // (self.edits[item] + 1)  # diagonals start at -size
        bound = self.bound[item]
        # band b covers steps b and b + 1. A tally in hashed cells is never below a band's own, so what lies in cells below
        # the bound is in no band that reaches it
        cells = [((doc * 8191 + item) * 131071 + band - shift) * 2654435761 >> 7 & CELLS - 1 for shift in (0, 1)]
        tally = sum(np.bincount(c, minlength=CELLS) for c in cells)
        for shift, cell in enumerate(cells):
            may = tally[cell] >= bound
            yield np.stack([doc[may], item[may], band[may] - shift, place[may]])

    def found(self, texts: list[str]) -> dict[tuple[int, int], int]:
        """Fewest edits of every (text number, item number) that occurs."""
        codes = [_codes(t) for t in texts]
        starts = np.cumsum([0] + [len(c) + 1 for c in codes])
        whole = np.zeros(int(starts[-1]), np.uint32)  # texts apart by a code that no normal text holds
        for s, c in zip(starts, codes):
            whole[s:s + len(c)] = c
        key = np.concatenate(list(self.matches(whole, starts)), axis=1)
        if not key.size:
            return {}
        key = key[:, np.lexsort(key[::-1])]
        key = key[:, np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))]
        first = np.flatnonzero(np.append(True, (key[:3, 1:] != key[:3, :-1]).any(axis=0)))
        tally = np.diff(np.append(first, key.shape[1]))
        best: dict[tuple[int, int], int] = {}
        for d, i, b in key[:3, first[tally >= self.bound[key[1, first]]]].T.tolist():
            e = int(self.edits[i])
            if best.get((d, i)) == 0:
                continue
            edits = aligned(self.codes[i], codes[d], b * (e + 1) - int(self.size[i]), 2 * (e + 1))
            if edits <= e:
                best[d, i] = min(edits, best.get((d, i), edits))
        return best


def indexes(items: list[tuple[int, str]], q: int, rate: float) -> list[Index]:
    """The items by gram length: ``LONG_Q`` where the edits allowed still leave at least as many shared grams, else ``q``.

    Longer grams are rarer; the edits that an item may have are the same either way, so the matches are too.
    """
    kept = [(i, _codes(t)) for i, t in ((i, normal(t)) for i, t in items) if len(t) >= q]
    parts: dict[int, list] = {}
    for i, codes in kept:
        n = len(codes)
        edits = int(edit_budget(np.array([n]), q, rate)[0])
        long = LONG_Q > q and n - LONG_Q + 1 - LONG_Q * edits >= LONG_Q
        parts.setdefault(LONG_Q if long else q, []).append((i, codes))
    return [Index(part, q, rate, gram) for gram, part in parts.items()]


def leaks(documents: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS,
          keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, item_id and edits of every item that occurs in a document."""
    items = benchmark.select("item_id", "text").where(F.length("text") >= q)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-2 * total // block_chars) or 1
    fields = [documents.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("edits", T.LongType())])
    found = None
    for n in range(parts):
        part = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n).collect()]
        hits = documents.select(*keys, "text").mapInArrow(_search(documents.sparkSession.sparkContext.broadcast(part), q, rate, keys, schema), schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def _search(items, q, rate, keys, schema):
    def search(batches):
        built = indexes(items.value, q, rate)
        kind = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[schema["item_id"].dataType.simpleString()]
        for part in blocks(batches, limit=1 << 20):
            texts = [normal(t) for t in part.column("text").to_pylist()]
            found = [(d, index.ids[i], edits) for index in built for (d, i), edits in index.found(texts).items()]
            rows = pa.array([d for d, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k).take(rows) for k in keys), pa.array([i for _, i, _ in found], kind),
                 pa.array([e for _, _, e in found], pa.int64())], names=schema.names)
    return search


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``documents`` without the rows in which a benchmark item occurs; columns pass through, whatever their names.

    A row is known by a 128-bit hash of its doc_id and text; nulls are values of their own.
    """
    keys = (free_name(documents, "_row"), free_name(documents, "_row_again"))
    hashes = (F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text"))
    tagged = documents.withColumns(dict(zip(keys, hashes)))
    bad = leaks(tagged, benchmark, keys=keys, **options).select(*keys).distinct()
    return tagged.join(bad, list(keys), "left_anti").drop(*keys)
