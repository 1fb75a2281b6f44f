"""Conversation structure repair: grammar-compressed dynamic programme.

The rows of a conversation become symbols: role initial (s, u, a, other) with or without the fault "truncated", or "must
go" (blank, duplicate). Re-Pair rules, learned from the pair counts of all conversations, replace frequent neighbours by one
symbol. Every symbol has one min-plus transfer matrix over the states of the role grammar ``(s?(ua)+)?``; a rule's matrix is
the product of its two sides and is computed once, bottom-up, for all conversations. An entry holds a cost and its audit as
a rope, whose leaves are edit initials and whose inner nodes are shared; a rope is written out only to settle a tie and at
the end. A conversation is the product over its compressed sequence.

Partitions by range of (conversation, turn) spread a conversation of any length over tasks until its symbols, one byte a row
before compression, meet; the audit that is returned is of that size. Its hash has to read its texts in order: that task
streams them, holding the audit and one row. The driver holds the rules (at most ``MAX_RULES``) and pair counts among them.

Among edits of equal cost the ASCII-least audit wins at every step, as equal costs over the same rows are never a beginning
of one another.

Nulls and ties: a null conv_id, role or text counts as one space; null turns come first and do not enter the gaps; equal
turns are ordered by role, then by a digest of the text. Rows of a null conv_id are one conversation (kept as -2^63
inside). Repeated rows are turns, the later ones duplicates. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import checkpointed

MAX_RULES = 96
NONE = -(1 << 63)
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
ALPHABET = "suaoSUAOx"  # upper case: truncated; o: another role; x: blank or duplicate
KEEP, DELETE, REROLE, INSERT, TRUNCATED = 0, 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # what came last; START and ASSISTANT may be the end
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
MEMO = 50_000  # compressed sequences that a task keeps results of


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of all rows after the damage that crc32(``conv_id:turn``) decides."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                space("role").alias("role"), space("text").alias("text"),
                                (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("b")).where("b <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("b") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("b") == 1, "").when(F.col("b") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("b") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, tie, kind (role initial, fault) of damaged rows; a row equal to the one before it in order is told later."""
    end = F.rtrim("text", F.lit(SPACE))
    rows = rows.select("conv_id", "turn", "role", F.md5("text").alias("tie"), (end == "").alias("blank"),
                       (~F.substring(end, -1, 1).isin(*ENDS)).alias("cut"))
    at = F.coalesce("turn", F.lit(NONE))
    first = (rows.groupBy("conv_id", "role", "tie").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("conv_id", "role", "tie", "first"))
    return rows.join(checkpointed(first), ["conv_id", "role", "tie"], "left").select(
        "conv_id", "turn", "role", "tie", F.substring("role", 1, 1).alias("initial"),
        F.when(F.col("blank"), "b").when(at > F.col("first"), "d").when(F.col("cut"), "t").otherwise("-").alias("fault"))


SEGMENT = ("conv_id long, part long, seq long, symbols string, blank long, duplicate long, truncated long, illegal long, first string, last string, "
           "low long, high long, turns long")


def segments(rows: DataFrame) -> DataFrame:
    """Runs of a conversation's rows in order, with their symbols and counts; ``rows`` are ``marked``."""
    order = ["conv_id", "turn", "role", "tie"]

    def runs(batches):
        part, seq, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            out, run = [], None
            for conv, turn, role, tie, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                same, before = (conv, turn, role, tie) == before, (conv, turn, role, tie)
                if same and fault != "b":
                    fault = "d"
                if run is None or run[0] != conv:
                    if run:
                        out.append(run)
                    run, seq = [conv, part, seq, [], 0, 0, 0, 0, initial, None, None, None, 0], seq + 1
                else:
                    run[7] += (run[9] + initial) not in ("su", "ua", "au")
                symbol = initial if initial in ("s", "u", "a") else "o"
                if fault in ("b", "d"):
                    symbol = "x"
                    run[4 if fault == "b" else 5] += 1
                elif fault == "t":
                    symbol = symbol.upper()
                    run[6] += 1
                run[3].append(symbol)
                run[9] = initial
                if turn is not None:
                    if run[10] is None:
                        run[10] = turn
                    run[12] += turn != run[11]
                    run[11] = turn
            if run:
                out.append(run)
            for r in out:
                r[3] = "".join(r[3])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (3, 8, 9) else pa.int64()) for k, c in enumerate(zip(*out))] if out else
                                             [pa.array([], pa.string() if k in (3, 8, 9) else pa.int64()) for k in range(13)],
                                             names=[x.split()[0] for x in SEGMENT.split(", ")])

    columns = [*order, "initial", "fault"]
    return rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, SEGMENT)


def rule_symbol(k: int) -> str:
    return chr(0x100 + k)


def compressed(symbols: str, rules: list[str]) -> str:
    for k, pair in enumerate(rules):
        symbols = symbols.replace(pair, rule_symbol(k))
    return symbols


def pair_counts(sequences: list[str], weights: np.ndarray) -> list[tuple[str, int]]:
    """Neighbouring symbols with how often they can be replaced; of a run of one symbol every other place counts."""
    codes = np.frombuffer("\0".join([*sequences, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(codes) < 2:
        return []
    of = np.repeat(np.arange(len(sequences)), np.array([len(s) + 1 for s in sequences]))[:len(codes)]
    starts = np.append(True, codes[1:] != codes[:-1])
    inside = np.arange(len(codes)) - np.maximum.accumulate(np.where(starts, np.arange(len(codes)), 0))
    a, b = codes[:-1], codes[1:]
    ok = (a > 0) & (b > 0) & ((a != b) | (inside[:-1] % 2 == 0))
    keys, at = np.unique(a[ok] << 32 | b[ok], return_inverse=True)
    counts = np.bincount(at, weights[of[:-1][ok]], len(keys)).astype(np.int64)
    return [(chr(k >> 32) + chr(k & 0xFFFFFFFF), n) for k, n in zip(keys.tolist(), counts.tolist())]


def learned_rules(found: DataFrame, max_rules: int = MAX_RULES) -> list[str]:
    """Re-Pair over the symbols of all segments: pairs, most frequent first, until none occurs twice or ``max_rules`` are found.

    Pairs without a symbol in common do not touch each other's counts: a round takes as many of them as there are.
    """
    distinct = checkpointed(found.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")))
    rules: list[str] = []
    while len(rules) < max_rules:
        known = list(rules)

        def counted(batches):
            for batch in batches:
                pairs = pair_counts([compressed(s, known) for s in batch.column("symbols").to_pylist()], batch.column("n").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], names=["pair", "n"])

        pairs = distinct.mapInArrow(counted, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").collect()
        used: set[str] = set()
        for r in sorted(pairs, key=lambda r: (-r.n, r.pair)):
            if not used & set(r.pair) and len(rules) < max_rules:
                rules.append(r.pair)
                used |= set(r.pair)
        if len(rules) == len(known):
            break
    return rules


# A rope is a string or a pair of ropes. A matrix is {(from, to): (cost, rope)}.


def written(rope) -> str:
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += (top[1], top[0])
    return "".join(out)


def better(a, b):
    """The cheaper of two entries, at equal cost the one with the ASCII-least audit."""
    if a is None or b is None or a[0] != b[0]:
        return b if a is None or (b is not None and b[0] < a[0]) else a
    x, y = written(a[1]), written(b[1])  # a rope that was written out goes on as one string
    return (a[0], x) if x <= y else (b[0], y)


def product(left: dict, right: dict) -> dict:
    out: dict = {}
    for (i, k), (cost, rope) in left.items():
        for j in range(4):
            entry = right.get((k, j))
            if entry:
                both = (cost + entry[0], (rope, entry[1]) if rope and entry[1] else rope or entry[1])
                out[i, j] = better(out.get((i, j)), both)
    return out


def _insertions() -> dict:
    out = {(i, i): (0, "") for i in range(4)}
    edges = {(i, j): (INSERT, "I") for c in "ua" for i, j in STEP[c].items()}
    for _ in range(2):  # more than two in a row only come back to where they began
        longer = product(out, edges)
        out = {key: better(out.get(key), longer.get(key)) for key in {*out, *longer}}
    return out


INSERTIONS = _insertions()


def symbol_matrix(symbol: str) -> dict:
    """Insertions before a row, then its edit."""
    edits: dict = {(i, i): (DELETE, "D") for i in range(4)}
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        for i, j in STEP.get(symbol.lower(), {}).items():
            edits[i, j] = better(edits.get((i, j)), (KEEP + extra, "K"))
        for role in "ua":
            for i, j in STEP[role].items():
                edits[i, j] = better(edits.get((i, j)), (REROLE + extra, "R"))
    return product(INSERTIONS, edits)


def rule_matrices(rules: list[str]) -> dict[str, dict]:
    """The matrix of every symbol and rule, each rule from its two sides; its ropes are written out, being part of many others."""
    known = {c: symbol_matrix(c) for c in ALPHABET}
    for k, pair in enumerate(rules):
        both = product(known[pair[0]], known[pair[1]])
        known[rule_symbol(k)] = {key: (cost, written(rope)) for key, (cost, rope) in both.items()}
    return known


def cheapest(sequence: str, matrices: dict[str, dict]) -> tuple[int, str]:
    """(cost, audit) of the repair of a compressed sequence, multiplied in pairs so that ties compare short audits first."""
    row = [matrices[c] for c in sequence]
    while len(row) > 1:
        row = [product(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    whole = product(row[0], INSERTIONS) if row else INSERTIONS
    cost, rope = better(whole.get((START, START)), whole.get((START, ASSISTANT)))
    return cost, written(rope)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repairs(found: DataFrame, rules: list[str]) -> DataFrame:
    """conv_id, gaps, the fault counts, cost and audit of every conversation that has rows, from its segments in order."""
    matrices = rule_matrices(rules)
    rest = [x.split()[0] for x in SEGMENT.split(", ")][1:]

    def shortened(batches):
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("symbols"), "symbols",
                                   pa.array([compressed(s, rules) for s in batch.column("symbols").to_pylist()], pa.string()))

    whole = found.mapInArrow(shortened, SEGMENT).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("runs"))

    def solved(batches):
        memo: dict = {}
        for batch in batches:
            out = []
            for conv, runs in zip(batch.column("conv_id").to_pylist(), batch.column("runs").to_pylist()):
                sums = [sum(r[c] for r in runs) for c in ("blank", "duplicate", "truncated", "illegal")]
                sums[3] += sum((a["last"] + b["first"]) not in ("su", "ua", "au") for a, b in zip(runs, runs[1:]))
                timed = [r for r in runs if r["low"] is not None]
                turns = sum(r["turns"] for r in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
                gaps = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
                sequence = "".join(r["symbols"] for r in runs)
                if sequence not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[sequence] = cheapest(sequence, matrices)
                out.append((conv, gaps, *sums, *memo[sequence]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out) if out else [()] * 8)],
                                             names=["conv_id", *COUNTS, "audit"])

    return whole.mapInArrow(solved, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


class Replay:
    """Hash of a conversation's repaired ``role:text`` lines, fed row by row along its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.begun = audit, 0, START, hashlib.sha256(), False

    def _line(self, role: str, text: str, step: str) -> None:
        self.digest.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
        self.begun, self.state = True, STEP[step][self.state]

    def _wanted(self) -> str:
        return "assistant" if self.state == USER else "user"

    def insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self._wanted(), "", self._wanted()[0])
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = role if edit == "K" else self._wanted()
            self._line(role, text, role[0])

    def end(self) -> str:
        self.insertions()
        return self.digest.hexdigest()


def repaired(conversations: DataFrame, max_rules: int = MAX_RULES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation, damaged first."""
    rows = damaged(conversations)
    found = checkpointed(segments(marked(rows)))
    solved = repairs(found, learned_rules(found, max_rules))
    every = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("conv_id")).distinct()
    heads = every.join(solved, "conv_id", "left").select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("tie"), F.lit("").alias("text"),
        F.lit(0).alias("step"), *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"))
    texts = rows.select("conv_id", "turn", "role", F.md5("text").alias("tie"), "text", F.lit(1).alias("step"))
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def replayed(batches):
        head, replay = None, None
        for batch in batches:
            out = []
            steps, role, text = (batch.column(c).to_pylist() for c in ("step", "role", "text"))
            for i, step in enumerate(steps):
                if step == 0:
                    if head:
                        out.append((*head, replay.end()))
                    head = [batch.column(c)[i].as_py() for c in names[:-1]]
                    replay = Replay(head[-1])
                else:
                    replay.row(role[i], text[i])
            yield listed(out)
        yield listed([(*head, replay.end())] if head else [])

    def listed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 6 else pa.int64()) for k, c in enumerate(zip(*out) if out else [()] * 9)], names=names)

    streamed = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "role", "tie")
    result = streamed.mapInArrow(replayed, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
    return result.withColumn("conv_id", F.nullif("conv_id", F.lit(NONE)))
