from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from glyco.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long"


def brute(rows):
    own: dict = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members: dict = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    kids: dict = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, who in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(c for c, last in who if last)).encode()).hexdigest()
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in who), len(p), parent, len(who), len(kids.get(p, [])), leaves[p], saved[p], ends))
    return sorted(out, key=str)


def conversations(seed: int):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), 260):
        if c // 100 == 3 and c % 100 == 0:
            continue  # a hundred without its first conversation
        n = rng.choice([1, 1, 2, 3, 4, 6, 9])
        for t in range(n):
            rows.append((c, t if t or c % 3 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "Ünï 😀", "longer text"]), 1))
    copies = [(10_000 + k, t, "user", "copy", 1) for k in range(60) for t in range(8)]  # thousands in small: cut by every shard
    long = [(600 + k, t, "user", f"turn {t}", 1) for k in (1, 2) for t in range(400)]
    ties = [(777, 1, "user", "x", 1), (777, 1, "user", "x", 1), (777, 1, "assistant", "x", 1), (None, 1, "user", "x", 1)]
    rows += copies + long + ties
    rng.shuffle(rows)
    return rows


def test_nodes_match_brute_force(spark):
    rows = conversations(5)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for shard in (40, 300, 100_000):
        got = trie.prefix_trie(df, shard)
        assert got.columns[1] == "depth"
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_find_close_and_ranks():
    rng = random.Random(2)
    for n in (1, 2, 40, 3000):
        signs, open_now, left = [], 0, n
        while left or open_now:
            if left and (open_now == 0 or rng.random() < 0.6):
                signs.append(1)
                left, open_now = left - 1, open_now + 1
            else:
                signs.append(-1)
                open_now -= 1
        signs = np.array([1, *signs, -1])
        stack, close = [], {}
        for i, s in enumerate(signs.tolist()):
            if s == 1:
                stack.append(i)
            else:
                close[stack.pop()] = i
        paren = trie.Parentheses(signs)
        opens = np.flatnonzero(signs == 1)
        assert paren.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
        ranks = paren.leaf_ranks(np.array([], np.int64))
        assert ranks[-1] == sum(close[i] == i + 1 for i in close)


def test_turnless_and_empty(spark):
    # Conversation 7 takes five turns of an absent base and has none of its own left.
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, t, "user", "x", 1) for t in range(3)]
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == brute(rows) and got[0].depth == 0
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
