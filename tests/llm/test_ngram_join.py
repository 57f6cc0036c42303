import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tablevec.llm import batches as batches_module
from tablevec.llm import ngram_join


def shingles(text, words):
    if not text:
        return set()
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(docs, words, percent):
    """row -> (size, smallest id reachable); docs: (id, text), rows of one id and text are one."""
    sets = {(i, t): shingles(t, words) for i, t in docs}
    nodes = list(sets)
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n[0])
    return sorted((i, len(sets[i, t]), min((x for x in groups[find((i, t))] if x is not None), default=None)) for i, t in docs if i is not None)


def documents():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "The", "the", "a\x1cb"]

    def prose(n):
        return rng.choices(vocabulary, k=n)

    texts = [None, "", " \t\n", "one", "ONE", "one two", "one  two", "a b c", "a b c d", "A b\tc d", "x " * 50]
    for n in (6, 12, 25, 40, 80, 200, 600):
        for _ in range(6):
            base = prose(n)
            texts.append(" ".join(base))
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 25))):
                    k = rng.randrange(len(copy))
                    copy[k : k + 1] = rng.choice([[], ["new"], [copy[k], rng.choice(vocabulary)]])
                texts.append(" ".join(copy))
    shared = prose(150)  # a passage that many texts share, and chains of copies of copies
    texts += [" ".join(shared + prose(rng.randint(5, 60))) for _ in range(40)]
    chain = prose(120)
    for _ in range(25):
        k = rng.randrange(len(chain))
        chain = chain[:k] + ["link"] + chain[k + 1 :]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return list(enumerate(texts + texts[:5]))


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_equals_brute_force(spark, words, percent):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = ngram_join.similar_documents(df, words, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs, words, percent)


def test_fine_counts_bound_the_overlap():
    rng = np.random.default_rng(6)
    for n in (5, 300, 300_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[n // 7 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64) * np.uint64(2))))
        rows = ngram_join.fine_rows([ngram_join.fine_of(a), ngram_join.fine_of(b)]).astype(np.int64)
        both = len(np.intersect1d(a, b))
        coarse = np.minimum(ngram_join.point_of(a), ngram_join.point_of(b)).sum()
        assert both <= np.minimum(*rows).sum() <= coarse and rows.sum() == len(a) + len(b)


def test_every_link_shares_the_needed_blocks():
    rng = np.random.default_rng(0)
    seen = 0
    for percent in (80, 85):
        for n in (3, 7, 20, 61, 150, 700, 3000):
            for _ in range(40):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                b = a[rng.permutation(len(a))[: len(a) - rng.integers(0, len(a) // 5 + 1)]]
                b = np.unique(np.concatenate((b, rng.integers(0, 1 << 63, rng.integers(0, len(a) // 5 + 1), dtype=np.uint64) * np.uint64(2))))
                overlap = len(np.intersect1d(a, b))
                if 100 * overlap >= percent * (len(a) + len(b) - overlap) and len(a) + len(b) != 2 * overlap:
                    x, y = np.array([len(a)]), np.array([len(b)])
                    shared = np.intersect1d(ngram_join.block_keys(a, percent), ngram_join.block_keys(b, percent))
                    kind = ngram_join.class_of(np.maximum(x, y), percent)[0]
                    of_class = (shared & np.uint64((1 << ngram_join.CLASS_BITS) - 1)) == kind
                    assert of_class.sum() >= ngram_join.needed_blocks(x, y, percent)[0] >= 1
                    seen += 1
    assert seen > 150


def test_very_large_blocks_in_pieces(spark, monkeypatch):
    """A block with more rows than a task holds: every member meets the lowest, and all stay under its key."""
    monkeypatch.setattr(ngram_join, "HELD_ROWS", 3)
    keys = [(1, 5), (1, 6), (1, 7), (1, 8), (1, 9), (1, 10), (2, 5), (2, 6), (3, 1)]
    rows = spark.createDataFrame([(k << 7, v, 0, None, None) for k, v in keys], "key long, node long, size long, point binary, same long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = ngram_join.meet(rows.coalesce(1).sortWithinPartitions("key", "node")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.first, r.node, r.key >> 7 if r.kind == 2 else r.size) for r in got if r.kind == 1} == {(5, v, 0) for v in range(6, 11)} | {(5, 6, 1)}
    assert {r.node for r in got if r.kind == 2 and r.key >> 7 == 1} == set(range(5, 11))


def test_tree_keeps_every_pair_the_bound_allows():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 6, (150, ngram_join.POINT)).astype("<u4")
    points[50:100] = points[:50] + rng.integers(0, 2, (50, ngram_join.POINT))
    sizes = points.sum(axis=1).astype(np.int64)
    component = rng.integers(0, 60, 150)
    got = {tuple(sorted(p)) for p in ngram_join.tree_pairs(points, sizes, component, 85).tolist()}
    want = {
        (i, j) for i in range(150) for j in range(i + 1, 150)
        if component[i] != component[j] and 185 * np.minimum(points[i], points[j]).sum() >= 85 * (sizes[i] + sizes[j])
    }
    assert got == want


def test_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "x"), (5, text, "y"), (5, "other words here now", "z"), (None, text, None), (None, None, "q"), (9, text.upper(), "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df, 4, 85).collect()), key=str)
    assert got == sorted([(5, 27, 5), (5, 27, 5), (5, 1, 5), (None, 27, 5), (None, 0, None), (9, 27, 5)], key=str)
    assert ngram_join.similar_documents(df.limit(0)).count() == 0


def test_workers_keep_nothing_of_the_join(spark):
    """Workers idle on beside the next steps, so what they still hold counts as theirs."""

    def held(batches):
        for batch in batches:
            names = [str(list(batches_module._live))] * batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["names"])

    docs = spark.createDataFrame([(i, f"one two three four five six {i % 7}") for i in range(64)], "doc_id long, text string")
    ngram_join.similar_documents(docs.repartition(8)).collect()
    names = spark.range(64).repartition(8).mapInArrow(held, "names string").collect()
    assert not [r for r in names if "shingles" in r.names]
