import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tablevec.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids.get(p, [])) or 1
        last = len(p[-1][1].encode()) if p else 0
        saved[p] = (len(members[p]) - 1) * last + sum(saved[q] for q in kids.get(p, []))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
         sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def made(seed, n=60, alike=0.5):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(1, 14)):
            text = rng.choice(["yes", "no", "é" * 5]) if rng.random() < alike else rng.choice([None, "", f"t{rng.random()}"])
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), text))
    rows += [(7, t, "user", f"{t % 40}") for t in range(300)] + rows[:15] + [(None, 1, "user", "x")]
    return rows


@pytest.mark.parametrize(("seed", "alike", "block"), [(1, 0.95, 1 << 17), (2, 0.5, 64), (3, 0.9, 3), (4, 0.0, 1)])
def test_equals_brute_force(spark, seed, alike, block):
    rows = made(seed, alike=alike)
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], SCHEMA + ", depth long, `a.b` long").repartition(4)
    got = trie.prefix_trie(df, block_arcs=block).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)
    places = sorted([r.enter for r in got] + [r.leave for r in got])
    assert places == list(range(2 * len(got)))  # the tour takes every arc once
    assert all(r.leave - r.enter >= 2 * r.n_leaves - 1 for r in got)


def test_same_conversations(spark):
    """A third of all rows end at one node, over more ids than are joined in a lot."""
    rows = [(5 * i, 0, "user", "same") for i in range(3000)] + [(5 * i + 1, t, "user", f"{i}") for i in range(20) for t in range(3)]
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)


def test_odd_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0
    rows = [(0, 0, "user", "x" * 3_000_000), (1, 0, "user", "x" * 3_000_000), (2, None, None, None)]
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)


def test_chains_of_a_block():
    rng = np.random.default_rng(5)
    arc = rng.permutation(1000)[:600]
    path = rng.permutation(1000)
    follow = dict(zip(path, [*path[1:], -1], strict=True))
    weights = rng.integers(0, 9, (600, 2))
    head, before, last = trie.link_chains(arc, np.array([follow[x] for x in arc]), weights)
    here = set(arc.tolist())
    weight = dict(zip(arc.tolist(), weights.tolist(), strict=True))
    for i, x in enumerate(arc.tolist()):
        at, total, k = x, np.zeros(2, dtype=int), list(path).index(x)
        while k and path[k - 1] in here:
            k -= 1
            at, total = path[k], total + weight[path[k]]
        assert arc[head[i]] == at and (before[i] == total).all() and last[i] == (follow[x] not in here)
