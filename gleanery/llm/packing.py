"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Sizes are whole numbers up to the capacity, so the instance is the histogram of sizes: at most ``capacity`` numbers,
whatever the corpus. The reduction permanently fixes sets of up to three sizes that dominate every other bin holding
their largest member, as often as the counts allow; the rest is packed best-fit, largest first, with bins of equal
contents handled together. The plan says which ranks of a size go to which bins; each piece then needs only its
rank among the pieces of its size.

Nulls and ties: null text is empty; every document ends with the end id, so an empty one is a piece of one token.
Repeated rows are packed one by one. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import blocks, checkpointed, gapless_rank

CAPACITY = 1024
END_ID = 2


class Encoder:
    """Token ids of the byte-level vocabulary.

    The rank file holds the same vocabulary as the tokenizer file and gives the same ids several times faster; texts that
    contain a special token's string, or that the ranks cannot take, go to the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except (ValueError, RuntimeError):
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def encoder(tokenizer_path: str, ranks_path: str | None = None) -> Encoder:
    """The encoder of a Python worker, built once for all of its tasks: what a task builds, the worker does not give back."""
    return Encoder(tokenizer_path, ranks_path)


def pieces(documents: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY,
           end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) per piece of at most ``capacity`` tokens.

    A longer document is cut into full pieces, the first taking what is left over.
    """
    kind = documents.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def cut(batches):
        encode = encoder(tokenizer_path, ranks_path)
        for part in blocks(batches):
            rows, which, ids_out = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                start, k = 0, 0
                while start < len(ids):
                    stop = min(start + capacity, len(ids)) if k or len(ids) <= capacity else (len(ids) - 1) % capacity + 1
                    piece = ids[start:stop]
                    rows.append((k, start, stop - start, zlib.crc32(piece.tobytes())))
                    which.append(i)
                    if keep_ids:
                        ids_out.append(piece.astype(np.int64))
                    start, k = stop, k + 1
            n, start, length, crc = zip(*rows)
            columns = [part.column("doc_id").take(pa.array(which)), pa.array(n, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return documents.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


Bins = list[tuple[int, Counter]]  # number of bins, how many of each size they hold


def _dominating(count: np.ndarray, w: int, capacity: int) -> Counter | None:
    """The set that dominates every bin holding one ``w`` as its largest size, if at most three sizes prove it."""
    count[w] -= 1
    try:
        room = capacity - w
        there = np.flatnonzero(count)
        if not len(there) or there[0] > room:
            return Counter([w])
        smallest = np.repeat(there[:3], np.minimum(count[there[:3]], 3))[:3]
        top = int(there[np.searchsorted(there, room, "right") - 1])
        if top == room or len(smallest) < 2 or smallest[:2].sum() > room:
            return Counter([w, top])
        if len(smallest) == 3 and smallest.sum() <= room:
            return None
        fit = there[there <= room]
        other = np.minimum(room - fit, fit)
        at = np.searchsorted(there, other, "right") - 1
        single = (at >= 0) & (there[at] == fit) & (count[fit] < 2)
        at -= single
        sums = np.where(at >= 0, fit + there[np.maximum(at, 0)], -1)
        best = int(sums.max())
        if best < 0 or top >= best:
            return Counter([w, top])
        pick = int(np.flatnonzero(sums == best)[-1])
        a, b = int(fit[pick]), int(there[at[pick]])
        above = there[there > b][:2]
        above = np.repeat(above, np.minimum(count[above], 2))[:2]
        if a == top and (len(above) < 2 or above.sum() > room):
            return Counter([w, a, b])
        return None
    finally:
        count[w] += 1


def reduce_instance(count: np.ndarray, capacity: int) -> Bins:
    """Fix dominating bins and take their sizes out of ``count``, until no size yields one.

    A proof stays valid while its sizes last (fewer items can only leave fewer rivals), so it is applied at once to as
    many bins as the scarcest member allows: the work depends on the number of sizes, not of documents.
    """
    fixed: Bins = []
    found = True
    while found:
        found = False
        for w in np.flatnonzero(count)[::-1]:
            while count[w]:
                chosen = _dominating(count, int(w), capacity)
                if chosen is None:
                    break
                times = min(int(count[s]) // k for s, k in chosen.items())
                for s, k in chosen.items():
                    count[s] -= times * k
                fixed.append((times, chosen))
                found = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> Bins:
    """Best-fit decreasing on a histogram; bins with equal contents stay one group."""
    by_room: list[Bins] = [[] for _ in range(capacity + 1)]
    for s in np.flatnonzero(count)[::-1]:
        s, left = int(s), int(count[s])
        for room in range(s, capacity):
            while left and by_room[room]:
                bins, held = by_room[room].pop()
                each = room // s
                full = min(bins, left // each)
                if full:
                    by_room[room - each * s].append((full, held + Counter({s: each})))
                left -= full * each
                bins -= full
                if bins and left:
                    by_room[room - left * s].append((1, held + Counter({s: left})))
                    left, bins = 0, bins - 1
                if bins:
                    by_room[room].append((bins, held))
            if not left:
                break
        if left:
            each = capacity // s
            if left // each:
                by_room[capacity - each * s].append((left // each, Counter({s: each})))
            if left % each:
                by_room[capacity - left % each * s].append((1, Counter({s: left % each})))
    return [group for groups in by_room for group in groups]


def plan(sizes: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Allotments: ranks of ``size`` from ``first`` on fill bins from ``sequence`` on, ``copies`` a bin, from ``offset``."""
    count = np.zeros(capacity + 1, np.int64)
    for s, n in sizes.items():
        count[s] = n
    bins = reduce_instance(count, capacity)
    bins += best_fit(count, capacity)
    used, rows, sequence = Counter(), [], 0
    for times, held in bins:
        offset = 0
        for s, copies in sorted(held.items(), reverse=True):
            rows.append((s, used[s], sequence, copies, offset))
            used[s] += times * copies
            offset += s * copies
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("size", "first", "sequence", "copies", "offset"), table.T))


def packed(items: DataFrame, size: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"),
           capacity: int = CAPACITY) -> DataFrame:
    """``items`` (read several times; sizes 1 to ``capacity``) with sequence_id and offset."""
    sizes = {int(r[0]): r[1] for r in items.groupBy(size).count().collect()}  # at most `capacity` rows
    if sizes and not 1 <= min(sizes) <= max(sizes) <= capacity:
        raise ValueError(f"sizes must lie between 1 and {capacity}")
    allot = plan(sizes, capacity)
    starts = (allot["size"] << 44) + allot["first"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(starts, (length << 44) + rank, "right") - 1
        nth = rank - allot["first"][at]
        return pd.DataFrame({"sequence_id": allot["sequence"][at] + nth // allot["copies"][at],
                             "offset": allot["offset"][at] + nth % allot["copies"][at] * length})

    ranked = gapless_rank(items, size, list(order), "_rank")
    return ranked.withColumn("_at", place(F.col(size), F.col("_rank"))).select(
        *items.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(documents: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return packed(checkpointed(pieces(documents, tokenizer_path, ranks_path, capacity, end_id, keep_ids)), capacity=capacity)
