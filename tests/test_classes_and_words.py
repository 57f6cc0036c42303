"""Directional classes against NumPy, mutual information against counting, word vectors on a planted corpus."""

import collections
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tablevec.operators import classes, factorize, graph, rank, sweep, train, walks


def lloyd(m, k, rounds):
    at = np.arange(len(m)) % k
    for _ in range(rounds):
        c = np.array([m[at == j].sum(axis=0) if (at == j).any() else np.full(m.shape[1], np.nan) for j in range(k)])
        length = np.linalg.norm(c, axis=1, keepdims=True)
        dots = np.round(m @ (c / np.where(length > 0, length, np.nan)).T, 9)
        at = np.where(np.isnan(dots), -np.inf, dots).argmax(axis=1)
    return at


@pytest.mark.parametrize("k", [1, 4, 9])
def test_classes_follow_the_rounds(spark, k):
    rng = np.random.default_rng(k)
    m = np.concatenate([rng.normal(c, 0.3, (60, 5)) for c in np.eye(5)[:4] * 3])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vec array<double>").repartition(7)
    got = {r.id: r.cluster for r in classes.directional_classes(df, k, 6).collect()}
    assert [got[i] for i in range(len(m))] == list(lloyd(m, k, 6))


def test_classes_of_odd_rows(spark, monkeypatch):
    schema = "id string, vec array<double>"
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", None), ("c", [None, 1.0]), ("d", []), ("e", [0.0, 1.0]), ("f", [0.0, 2.0])]
    got = classes.directional_classes(spark.createDataFrame(rows, schema), 2).collect()
    assert sorted(r.id for r in got) == ["a", "a", "e", "f"]
    by = collections.defaultdict(set)
    for r in got:
        by[r.id].add(r.cluster)
    assert by["a"] | by["e"] == {0, 1} and by["e"] == by["f"]
    assert classes.directional_classes(spark.createDataFrame([], schema), 3).count() == 0
    zeros = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0])], schema)
    assert {r.cluster for r in classes.directional_classes(zeros, 2).collect()} == {0}
    monkeypatch.setattr(classes, "MOST_CENTER_NUMBERS", 3)
    with pytest.raises(ValueError):
        classes.directional_classes(zeros, 2)


def test_relation_summary_names_class_members(spark):
    vecs = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.9, 0.1], "d": [0.1, 0.9]}
    df = spark.createDataFrame(list(vecs.items()), "relation string, vec array<double>")
    assert {(r.first, r.last) for r in rank.relations_summary(df, 4).select("first", "last").toPandas().itertuples()} == {("a", "c"), ("b", "d")}


def test_context_pairs_of_short_and_long_lines(spark):
    rows = [(0, 0, ["a"]), (1, 0, []), (2, 0, ["a", "b"]), (3, 0, ["x"] * 30_000)]
    df = spark.createDataFrame(rows, "doc bigint, sent int, words array<string>")
    got = train.context_pairs(df, 1).collect()
    assert sorted((r.pos, r.center, r.context) for r in got if r.doc < 3) == [(0, "a", "b"), (1, "b", "a")]
    assert sum(r.doc == 3 for r in got) == 2 * 30_000 - 2


def test_mutual_information_counts(spark):
    rng = np.random.default_rng(2)
    pairs = [("abcdef"[a], "uvwxyz"[b]) for a, b in zip(rng.geometric(0.4, 900) % 6, rng.geometric(0.3, 900) % 6)]
    given = pairs + [(None, "u"), ("a", None)]
    got = {(r.row, r.col): r.v for r in train.mutual_information(spark.createDataFrame(given, "center string, context string"), 1.5).collect()}
    n, x, y = collections.Counter(pairs), collections.Counter(a for a, _ in pairs), collections.Counter(b for _, b in pairs)
    total = sum(v**0.75 for v in y.values())
    exact = {(a, b): math.log(c / x[a]) - math.log(y[b] ** 0.75 / total) - math.log(1.5) for (a, b), c in n.items()}
    assert got == {k: pytest.approx(v) for k, v in exact.items() if v > 0}
    none = spark.createDataFrame([], "center string, context string")
    assert train.mutual_information(none).count() == 0


def test_factorized_words_answer_planted_analogies(spark):
    """City and land of each place share the place's words; all cities, and all lands, share their kind's words."""
    rng = np.random.default_rng(5)
    lines = []
    for place in range(12):
        for kind in ("city", "land"):
            for _ in range(60):
                near = [f"of{place}_{j}" for j in rng.integers(0, 5, 2)] + [f"{kind}like{j}" for j in rng.integers(0, 5, 2)]
                lines.append([near[0], near[2], f"{kind}{place}", near[1], near[3]])
    df = spark.createDataFrame([(i, 0, w) for i, w in enumerate(lines)], "doc bigint, sent int, words array<string>")
    vec = {r.token: np.array(r.vec) for r in train.factorized_words(train.context_pairs(df, 2), 24, shift=1.0).collect()}
    names = [f"{kind}{place}" for kind in ("city", "land") for place in range(12)]
    right = 0
    asked = [(a, b) for a in range(12) for b in range(12) if a != b]
    for a, b in asked:
        target = vec[f"land{a}"] - vec[f"city{a}"] + vec[f"city{b}"]
        rest = [w for w in names if w not in (f"land{a}", f"city{a}", f"city{b}")]
        right += max(rest, key=lambda w: vec[w] @ target) == f"land{b}"
    assert right / len(asked) >= 0.9


def block_of(spark, m):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id bigint, vec array<double>").repartition(9)


def test_tall_svd_keeps_small_singular_values(spark):
    rng = np.random.default_rng(1)
    u, v = np.linalg.qr(rng.normal(size=(400, 8)))[0], np.linalg.qr(rng.normal(size=(8, 8)))[0]
    m = u * np.logspace(0, -7, 8) @ v.T  # condition 1e7
    block = block_of(spark, m)
    values, right = factorize.tall_svd(block, 3)
    want = np.linalg.svd(m, compute_uv=False)
    assert np.abs(values / want - 1).max() < 1e-8
    assert np.abs(right.T @ right - np.eye(8)).max() < 1e-12
    q = np.array([r.vec for r in factorize.orthonormal(block).orderBy("id").collect()])
    assert np.abs(q.T @ q - np.eye(8)).max() < 1e-10
    assert np.abs(q @ (q.T @ m) - m).max() < 1e-10


def test_tall_svd_of_odd_blocks(spark):
    values, _ = factorize.tall_svd(block_of(spark, [[3.0, 4.0]]))  # fewer rows than columns
    assert values == pytest.approx([5.0])
    low = block_of(spark, [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])
    assert {len(r.vec) for r in factorize.orthonormal(low).collect()} == {1}
    assert len(factorize.tall_svd(low.limit(0))[0]) == 0 and factorize.orthonormal(low.limit(0)).count() == 0
    zero = block_of(spark, np.zeros((4, 2)))
    assert {len(r.vec) for r in factorize.orthonormal(zero).collect()} == {0}


def test_sweep_equals_single_runs(spark):
    pairs = [(i, j, 1.0) for block in (0, 8) for i in range(block, block + 8) for j in range(i + 1, block + 8)] + [(0, 8, 1.0)]
    edges = graph.to_undirected(spark.createDataFrame(pairs, "src bigint, dst bigint, weight double"))
    seen = []
    for params, matrix, block in sweep.walk_sweep(edges, [6, 3], [2], [2, 3], 4, shift=1.0, seed=2):
        seen.append(tuple(params.values()))
        alone = walks.random_walks(edges, 4, params["length"], seed=2)
        docs = alone.selectExpr("start AS doc", "walk AS sent", "path AS words")
        want = {(r.row, r.col): r.v for r in train.mutual_information(train.context_pairs(docs, 2, 2), 1.0).collect()}
        assert {(r.row, r.col): r.v for r in matrix.collect()} == {k: pytest.approx(v) for k, v in want.items()}
        lengths = [(len(r.vec), float(np.linalg.norm(r.vec))) for r in block.collect()]
        assert {n for n, _ in lengths} == {params["dim"]} and all(abs(x - 1) < 1e-9 for _, x in lengths)
    assert seen == [(3, 2, 2), (3, 2, 3), (6, 2, 2), (6, 2, 3)]
    assert all(m.count() == 0 and b.count() == 0 for _, m, b in sweep.walk_sweep(edges.limit(0), [3], [2], [2], 1))


def test_counted_context_pairs_are_the_counts_of_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i // 2, 0, [None if w == 9 else f"w{w}" for w in rng.integers(0, 10, n)]) for i, n in enumerate(rng.integers(0, 90, 60))]
    df = spark.createDataFrame([*rows, rows[5], (None, None, ["a", "b"]), (1, 7, None)], "doc bigint, sent int, words array<string>")
    want = {(r.center, r.context): r["count"] for r in train.context_pairs(df, 4, 7).groupBy("center", "context").count().collect()}
    for most in (50, 10_000_000):
        monkeypatch.setattr(train, "LOT_PAIRS", most)
        got = train.context_pairs(df, 4, 7, counted=True).collect()
        assert len(got) == len(want) and {(r.center, r.context): r.n for r in got} == want
    plain, counted = (train.mutual_information(train.context_pairs(df, 4, 7, counted=c), 1.0).collect() for c in (False, True))
    assert {(r.row, r.col): pytest.approx(r.v) for r in plain} == {(r.row, r.col): r.v for r in counted}


def test_phrases_of_lines_with_the_same_key_do_not_mix(spark, monkeypatch):
    monkeypatch.setattr(train, "LOT_WORDS", 6)
    lines = [(0, 0, "a b x"), (0, 0, "x y a b"), (None, 1, "a b b c"), (2, 0, "a a b"), (2, 0, "a a b"), (3, 0, ""), (4, 0, None)]
    df = spark.createDataFrame([(d, s, None if t is None else t.split()) for d, s, t in lines], "doc bigint, sent int, words array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "b")], "a string, b string")
    got = [None if r.words is None else " ".join(r.words) for r in train.merge_phrases(df, phrases).collect()]
    assert sorted(got, key=str) == sorted(["a_b x", "x y a_b", "a_b b_c", "a a_b", "a a_b", "", None], key=str)
    assert train.merge_phrases(df, phrases.limit(0)).count() == len(lines)


def test_texts_of_one_piece_are_dealt_out(spark):
    df = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("a b\nc").alias("text")).coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = train.sentences(df, "doc_id", "text").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) > 1 and sum(r["count"] for r in got) == 128
