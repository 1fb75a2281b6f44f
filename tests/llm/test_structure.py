"""Structure repair, prefix trie and chosen-path join against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import queries, repair, setjoin, tries

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_order(rows):
    return sorted(rows, key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.md5(z[2].encode()).hexdigest()))


def repaired(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        bucket, own = zlib.crc32(f"{c_}:{t_}".encode()) % 20, convs[c]
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(bucket, x)
        own += [(t, "user" if bucket == 4 else r, x)] * {0: 0, 3: 2}.get(bucket, 1)
    for c, own in convs.items():
        own = in_order(own)
        turns = {t for t, _, _ in own if t is not None}
        faults, seen = "", set()
        for _, r, x in own:
            y = x.rstrip(SPACE)
            faults += "b" if not y else "d" if (r, x) in seen else "t" if y[-1] not in ".!?" else "-"
            seen.add((r, x))
        best = {0: (0, "", ())}

        def offer(to, state, cost, audit, lines):
            if state not in to or (cost, audit) < to[state][:2]:
                to[state] = (cost, audit, lines)

        def inserted():
            for _ in range(4):
                for state, (cost, audit, lines) in list(best.items()):
                    for role in ("user", "assistant"):
                        if state in STEPS[role[0]]:
                            offer(best, STEPS[role[0]][state], cost + 3, audit + "I", (*lines, (role, "")))

        for (_, r, x), fault in zip(own, faults):
            inserted()
            after = {}
            for state, (cost, audit, lines) in best.items():
                offer(after, state, cost + 4, audit + "D", lines)
                if fault in "bd":
                    continue
                for role, price, edit in ((r, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if state in STEPS.get(role[:1], ()):
                        offer(after, STEPS[role[:1]][state], cost + price + 3 * (fault == "t"), audit + edit, (*lines, (role, x)))
            best = after
        inserted()
        cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        yield (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit,
               hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest())


def trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t, r or "", x or ""))
    own = {c: [z[1:] for z in in_order(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        whole[c] = (own.get(c - int(np.fmod(c, 100)), [])[:h] if h else []) + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    least = {n: min((c for c in m if c is not None), default=None) for n, m in members.items()}
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = sum(saved[k] for k in children[n]) + (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
        ends = ",".join(map(str, sorted(c for c in members[n] if c is not None and len(whole[c]) == len(n))))
        yield (least[n], len(n), least[n[:-1]] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
               hashlib.sha256(ends.encode()).hexdigest())


def near(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(" ".join(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([" ".join(w)] if w else []))
    distinct = list(dict.fromkeys(sets))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for (d, _), s in zip(rows, sets):
        ids[find(s)].append(d)
    for (d, _), s in zip(rows, sets):
        lowest = min((x for x in ids[find(s)] if x is not None), default=None) if s else d
        yield d, len(s), lowest, d is not None and d == lowest


def same(found, want):
    assert Counter(map(tuple, found.collect())) == Counter(want)


@pytest.fixture
def spread(spark):
    """Small exchanges keep all their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some_turns(rng, n, roles, texts):
    return [(int(rng.integers(-3, n // 12 + 2)) if rng.random() < 0.98 else None, None if rng.random() < 0.06 else int(rng.integers(0, 9)),
             roles[rng.integers(0, len(roles))], texts[rng.integers(0, len(texts))]) for _ in range(n)]


@pytest.mark.parametrize("n", (7, 900))
def test_repair(spark, n):
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool"]
    rows = some_turns(np.random.default_rng(n), n, roles, ["a.", "bb! ", "c", "", None, "Hello\n there?", "x "])
    same(repair.repaired(spark.createDataFrame(rows, TURNS)), repaired(rows))


def test_repair_long(spark, spread):
    rng = np.random.default_rng(5)
    rows = [(c, t, ("user", "assistant")[(t + (rng.random() < 0.1)) % 2], "x" * int(rng.integers(0, 6)) + "." * int(rng.random() < 0.8))
            for c in (1, 2) for t in range(900)]
    table = spark.createDataFrame(rows, TURNS)
    found = repair.segments(repair.marked(repair.damaged(table)))
    assert found.where("conv_id = 1").count() > 1  # a long conversation is spread over tasks
    same(repair.repaired(table), repaired(rows))


def test_repair_rules():
    """A rule's matrix gives what its symbols give one by one, ties included."""
    rng = np.random.default_rng(1)
    rules = ["ua", chr(0x100) * 2, "sx", "aU"]
    matrices = repair.rule_matrices(rules)
    for _ in range(300):
        symbols = "".join(rng.choice(list(repair.ALPHABET), rng.integers(0, 14)))
        short = repair.compressed(symbols, rules)
        assert repair.cheapest(short, matrices) == repair.cheapest(symbols, matrices)


def test_repair_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op11_structure_repair(spark, data), repaired(rows))


@pytest.mark.parametrize("n", (5, 900))
def test_trie(spark, spread, n):
    rows = some_turns(np.random.default_rng(n), n, ["user", "assistant", None], ["a", "bb", "", None])
    rows += [(100 + k, None, "user", "same") for k in range(40)]
    same(tries.trie(spark.createDataFrame(rows, TURNS), shard_nodes=4), trie(rows))


def test_trie_long(spark, spread):
    rows = [(c, t, "user", "x" * (t % 3)) for c in (100, 101, 250, 7) for t in range(400)]
    same(tries.trie(spark.createDataFrame(rows, TURNS)), trie(rows))


def test_trie_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op12_prefix_trie(spark, data), trie(rows))


def test_find_close():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        depth = [int(rng.integers(0, 4))]
        while len(depth) < n:
            depth.append(int(rng.integers(max(0, depth[-1] - 3), depth[-1] + 2)))
        excess, opening = tries.parentheses(np.array(depth))
        close = tries.find_close(excess, opening, block=4)
        for i, p in enumerate(opening):
            assert close[i] == next((q for q in range(p + 1, len(excess)) if excess[q] < excess[p]), len(excess))


def family(rng, copies, edits=6):
    base = [f"w{k}" for k in rng.integers(0, 50, 60)]
    for i in range(copies):
        words = list(base)
        for _ in range(rng.integers(0, edits)):
            words[rng.integers(0, 60)] = f"v{rng.integers(0, 99)}"
        yield 100 + i, " ".join(words)


@pytest.mark.parametrize("options", ({}, {"limit": 4, "tile": 8}, {"limit": 4, "tile": 8, "levels": 1}))
def test_near(spark, options):
    rows = [(None, None), (3, ""), (3, " \t"), (4, "A b"), (5, "a  B"), (6, "a b c"), (None, "zz zz zz zz zz"), (None, "zz zz zz zz zz"),
            (9, "a b"), (9, "a b"), (10, "long " * 40_000), *family(np.random.default_rng(2), 150)]
    same(setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options), near(rows))


def test_near_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.op13_chosen_path_join(spark, data), near(rows))


def test_intersections(monkeypatch):
    monkeypatch.setattr(setjoin, "SLICE", 7)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(12)]
    both = setjoin.intersections(sets)
    assert all(both[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_empty_and_clashing(spark):
    names = "sid string, node string, u string, k string, n string, part string, p string, label string, size string"
    clash = lambda df: df.select("*", *(F.lit("q").alias(c.split()[0]) for c in names.split(", ")))
    turns = [(1, 0, "user", "hi."), (1, 1, "assistant", "yes."), (2, None, None, None)]
    docs = [(1, "a b c d e"), (2, "A b c d e"), (None, None)]
    for function, brute, rows, schema in ((repair.repaired, repaired, turns, TURNS), (tries.trie, trie, turns, TURNS),
                                          (setjoin.near_duplicates, near, docs, "doc_id long, text string")):
        same(function(clash(spark.createDataFrame(rows, schema))), brute(rows))
        assert function(clash(spark.createDataFrame([], schema))).count() == 0
