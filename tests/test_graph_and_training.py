"""Walk invariants, factorization against dense algebra, phrases, sources, downstream learning."""

import collections
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablevec.functions import ordering
from tablevec.operators import evaluate, factorize, graph, ml, textify, train, walks
from tablevec.sources import relations, vectors


def star_and_ring(spark):
    pairs = [(0, i, 1.0 / i) for i in range(1, 41)] + [(i, i % 40 + 1, 0.5) for i in range(1, 41)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint, weight double")
    return graph.to_undirected(edges)


def test_edges_prune_and_weigh(spark, monkeypatch):
    rows = [("a", "r", "1"), ("a", "r", "1"), ("a", "s", "2"), ("once", "r", "1")]
    rows += [("hot", "r", str(i)) for i in range(50)] + [("two", "r", "1"), ("two", "r", "2")]
    tokens = spark.createDataFrame(rows, "token string, relation string, row_id string")
    got = {(r.token, r.relation, r.row_id): r.weight for r in graph.weighted_edges(tokens, max_num=50, share=3).collect()}
    assert got == {
        ("a", "r", "1"): pytest.approx(1 / 3), ("a", "s", "2"): pytest.approx(1 / 3),
        ("two", "r", "1"): 0.5, ("two", "r", "2"): 0.5,
    }


def test_edges_are_placed_by_hash_before_text(spark, capsys):
    rows = [(f"l_key_<#>_{i % 30}", "t", None if i % 7 == 0 else str(i % 50)) for i in range(200)]
    tokens = spark.createDataFrame(rows, "token string, relation string, row_id string")
    edges = graph.weighted_edges(tokens)
    num = collections.Counter(t for t, _, _ in rows)
    assert {tuple(r) for r in edges.collect()} == {(*r, 1.0 / num[r[0]]) for r in rows} and edges.count() == len(set(rows))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph.weighted_edges(tokens).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [__h" in capsys.readouterr().out


def test_products_and_blocks_are_summed_without_objects(spark, capsys):
    cells = [(i % 9, j, float(i + j)) for i in range(9) for j in range(6)]
    matrix = spark.createDataFrame(cells, "row bigint, col bigint, v double").cache()
    block = spark.createDataFrame([(j, [float(j), 1.0]) for j in range(6)], "id bigint, vec array<double>").cache()
    product = factorize.SparseProduct(matrix).times(block)
    dense = np.array([[i + j for j in range(6)] for i in range(9)]) @ np.array([[j, 1.0] for j in range(6)])
    assert {r.id: r.vec for r in product.collect()} == {i: pytest.approx(dense[i]) for i in range(9)}
    product.explain()
    factorize._sum_blocks([(block, 1.0), (product, -2.0)]).explain()
    assert "ObjectHashAggregate" not in capsys.readouterr().out


@pytest.mark.parametrize("weighted", [False, True])
def test_every_move_is_an_edge(spark, weighted):
    edges = star_and_ring(spark).cache()
    known = {(r.src, r.dst) for r in edges.collect()}
    paths = walks.random_walks(edges, 3, 7, weighted, seed=2).collect()
    assert len(paths) == 41 * 3
    for r in paths:
        assert len(r.path) == 8 and r.path[0] == r.start
        assert all((a, b) in known for a, b in zip(r.path, r.path[1:]))


def test_weighted_draws_follow_weights(spark):
    edges = spark.createDataFrame([(0, 1, 8.0), (0, 2, 1.0), (0, 3, 1.0), (1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0)], "src bigint, dst bigint, weight double")
    first = [r.path[1] for r in walks.random_walks(edges, 2000, 1, True, seed=1).where("start = 0").collect()]
    share = collections.Counter(first)
    assert share[1] / len(first) == pytest.approx(0.8, abs=0.03)


def test_dead_ends_and_visit_cap(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src bigint, dst bigint, weight double")
    got = {(r.start): r.path for r in walks.random_walks(edges, 1, 5).collect()}
    assert got == {0: [0, 1, 2], 1: [1, 2]}
    many = walks.random_walks(star_and_ring(spark), 5, 6, seed=3)
    capped = walks.visit_cap(many, 10).collect()
    arrivals = collections.Counter(n for r in capped for n in r.path[1:])
    assert len(capped) == many.count() and max(arrivals.values()) <= 9


def test_second_order_extremes(spark):
    edges = star_and_ring(spark)
    back = walks.second_order_walks(edges, 1, 5, p=1e-9, q=1.0, max_degree=None, seed=4).collect()
    assert all(a == c for r in back for a, c in zip(r.path, r.path[2:]))
    away = walks.second_order_walks(edges, 1, 5, p=1e9, q=1.0, seed=4).collect()
    assert all(a != c for r in away for a, c in zip(r.path, r.path[2:]))
    assert {len(r.path) for r in away} == {7}


def test_second_order_shares_are_exact(spark):
    """Hops after (previous, node) against the exact shares, on a graph with near, far and return arcs."""
    pairs = [(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0), (1, 3, 1.0), (1, 4, 4.0), (3, 4, 1.0)]
    edges = graph.to_undirected(spark.createDataFrame(pairs, "src bigint, dst bigint, weight double"))
    weight = {(r.src, r.dst): r.weight for r in edges.collect()}
    p, q = 0.25, 2.0
    hops = collections.defaultdict(collections.Counter)
    paths = walks.second_order_walks(edges, 400, 20, p, q, max_degree=None, seed=3).collect()
    assert len(paths) == 5 * 400 and {len(r.path) for r in paths} == {22}
    for r in paths:
        for a, b, c in zip(r.path, r.path[1:], r.path[2:]):
            hops[a, b][c] += 1
    for (a, b), seen in hops.items():
        exact = {c: w / (p if c == a else 1.0 if (a, c) in weight else q) for (x, c), w in weight.items() if x == b}
        total, n = sum(exact.values()), sum(seen.values())
        for c, w in exact.items():
            share = w / total
            assert abs(seen[c] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-9


def test_second_order_hubs_dead_ends_and_empty(spark):
    hub = [(0, i, 1.0) for i in range(1, 301)]
    edges = graph.to_undirected(spark.createDataFrame(hub, "src bigint, dst bigint, weight double"))
    paths = walks.second_order_walks(edges, 1, 5, p=4.0, q=0.5, max_degree=None, seed=1).collect()
    assert len(paths) == 301 and all((a == 0) != (b == 0) for r in paths for a, b in zip(r.path, r.path[1:]))
    line = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src bigint, dst bigint, weight double")
    assert {r.start: r.path for r in walks.second_order_walks(line, 1, 3, 2.0, 2.0).collect()} == {0: [0, 1, 2], 1: [1, 2]}
    assert walks.second_order_walks(line.limit(0), 2, 3, 2.0, 2.0).count() == 0


def dense_setup(n=30, seed=0):
    rng = np.random.default_rng(seed)
    a = np.triu((rng.random((n, n)) < 0.3) * rng.random((n, n)), 1)
    a += np.diag(np.full(n - 1, 0.3), 1)
    return a + a.T


def as_edges(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src bigint, dst bigint, weight double")


def as_matrix(block):
    rows = sorted(block.collect(), key=lambda r: r.id)
    return np.array([r.vec for r in rows])


def dense_factor(a):
    c = a / a.sum(axis=1, keepdims=True)
    noise = c.sum(axis=0) ** 0.75
    noise /= noise.sum()
    f = np.zeros_like(a)
    i, j = np.nonzero(a)
    f[i, j] = np.log(c[i, j]) - np.log(a[i, j] * noise[j])
    return f


def unit_rows(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_factorization_equals_dense_svd(spark):
    a = dense_setup()
    f = dense_factor(a)
    matrix = factorize.factor_matrix(as_edges(spark, a)).cache()
    got = np.zeros_like(f)
    for r in matrix.collect():
        got[r.row, r.col] = r.v
    assert got == pytest.approx(f)
    x = as_matrix(factorize.truncated_svd(matrix, 5, iterations=12))
    u, s, _ = np.linalg.svd(f)
    want = unit_rows(u[:, :5] * np.sqrt(s[:5]))
    # columns may differ by sign, inner products of rows may not
    assert x @ x.T == pytest.approx(want @ want.T, abs=1e-4)


def test_propagation_equals_dense_algebra(spark):
    a = dense_setup(20, 1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 4))
    block = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(20)], "id bigint, vec array<double>")
    got = as_matrix(factorize.spectral_propagate(as_edges(spark, a), block, 4, 0.2, 0.5))
    own = np.eye(20) + a
    m = np.eye(20) - own / own.sum(axis=1, keepdims=True) - 0.2 * np.eye(20)
    bessel = [factorize.bessel_first_kind(k, 0.5) for k in range(4)]
    l0, l1 = x, 0.5 * m @ (m @ x) - x
    total = bessel[0] * l0 - 2 * bessel[1] * l1
    for i in (2, 3):
        l2 = m @ (m @ l1) - 2 * l1 - l0
        total = total + (-1) ** i * 2 * bessel[i] * l2
        l0, l1 = l1, l2
    u, s, _ = np.linalg.svd(own @ (x - total), full_matrices=False)
    want = unit_rows(u * np.sqrt(s))
    assert got @ got.T == pytest.approx(want @ want.T, abs=1e-6)
    assert bessel[0] == pytest.approx(np.i0(0.5))


def sents(spark, lines):
    return spark.createDataFrame([(1, i, line.split()) for i, line in enumerate(lines)], "doc bigint, sent int, words array<string>")


def test_phrases_join_left_to_right(spark):
    s = sents(spark, ["a b a b c", "x a b", "b a", "b b b b b", "x"])
    phrases = spark.createDataFrame([("a", "b"), ("b", "b"), ("b", "c")], "a string, b string")
    got = {r.sent: " ".join(r.words) for r in train.merge_phrases(s, phrases).collect()}
    assert got == {0: "a_b a_b c", 1: "x a_b", 2: "b a", 3: "b_b b_b b", 4: "x"}


def test_context_pairs_stay_in_reach(spark):
    s = sents(spark, [" ".join(f"w{i}" for i in range(30)), "solo"])
    got = train.context_pairs(s, 3, seed=1).collect()
    gaps = collections.defaultdict(set)
    for r in got:
        gaps[r.pos].add(int(r.context[1:]) - int(r.center[1:]))
    for pos in range(30):
        reach = max(abs(g) for g in gaps[pos])
        want = {g for g in range(-reach, reach + 1) if g and 0 <= pos + g < 30}
        assert reach <= 3 and gaps[pos] == want


def test_skipgram_separates_communities(spark):
    docs = [(["a1", "a2", "a3", "a1"] * 5,), (["b1", "b2", "b3", "b1"] * 5,)] * 20
    emb = train.fit_skipgram(spark.createDataFrame(docs, "tokens array<string>"), 8, 3, iterations=2, partitions=1).collect()
    assert {r.token for r in emb} == {"a1", "a2", "a3", "b1", "b2", "b3"} and all(len(r.vec) == 8 for r in emb)


def test_skipgram_keeps_no_model_on_the_driver(spark):
    assert not hasattr(train, "Word2Vec")
    docs = [(["a1", "a2", "a3", "a1"] * 5,), (["b1", "b2", "b3", "b1"] * 5,)] * 40 + [(["rare"],), ([],)]
    table = spark.createDataFrame(docs, "tokens array<string>")
    args = dict(min_count=2, iterations=8, partitions=3)
    runs = [{r.token: np.array(r.vec) for r in train.fit_skipgram(table, 8, 3, **args).collect()} for _ in range(2)]
    emb = runs[0]
    assert set(emb) == {"a1", "a2", "a3", "b1", "b2", "b3"} and all(len(v) == 8 for v in emb.values())
    assert all(np.allclose(runs[0][t], runs[1][t], atol=1e-9) for t in emb)
    unit = {t: v / np.linalg.norm(v) for t, v in emb.items()}
    inside = np.mean([unit[x + i] @ unit[x + j] for x in "ab" for i in "123" for j in "123" if i != j])
    across = np.mean([unit["a" + i] @ unit["b" + j] for i in "123" for j in "123"])
    assert inside > across + 0.5


def test_f1_scores(spark):
    truth = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "x", 1)], "id int, label string, true int")
    pred = spark.createDataFrame([(1, "x", 1), (1, "z", 1), (2, "x", 1)], "id int, label string, pred int")
    got = ml.f1_scores(pred, truth).first()
    assert got.micro == pytest.approx(4 / 6) and got.samples == pytest.approx(0.75)
    assert got.macro == pytest.approx(1 / 3) and got.weighted == pytest.approx(2 / 3)


def test_learners_beat_the_majority(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=3) + 3 * (i % 2)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>, label int")
    a, b = evaluate.split_train_test(df, ["id"], 0.3, 1)
    fit, test = ml.features(a), ml.features(b)
    for model in (ml.random_forest_classifier(fit, (5,), 2), ml.logistic_elasticnet(fit, (0.01,), (0.5,), 2), ml.mlp_classifier(fit, 2, 4, 30)):
        assert ml.score(model, fit, test)["test"] > 0.9
    assert ml.score(ml.regressor(fit, "linear"), fit, test, "mae")["test"] < 0.4
    assert ml.accuracy(ml.knn_vote(ml.fold_candidates(df, 5), df), df).first().accuracy > 0.9


def test_sample_relations_round_trip(spark, tmp_path):
    tables = relations.generate_sample(spark, 1)
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    tables["base"].coalesce(1).write.option("header", True).csv(f"{folder}/base.csv")
    (back,) = relations.read_relations(spark, f"{folder}/base.csv").values()
    assert back.count() == 1000 and dict(back.dtypes) == {"id": "int", "name": "string", "money": "int"}
    assert {r.money for r in back.where("name like 'type2%'").collect()} == {200}
    numbered = relations.with_row_index(spark.read.option("header", True).csv(f"{folder}/base.csv"))
    assert all(int(r.id) == r.row_idx for r in numbered.collect())


def test_sample_rows_of_one_kind_are_closest(spark):
    """Rows that share items are closer, on average, than rows that do not: tables to graph to vectors."""
    tables = {k: (df.where("id < 60") if "id" in df.columns else df) for k, df in relations.generate_sample(spark, 1).items()}
    ids = {"base": "id", "price": "item", "trans": "name"}
    tables["trans"] = tables["trans"].where(F.split_part("name", F.lit("_"), F.lit(2)).cast("int") < 60)
    named = graph.name_edges(graph.weighted_edges(textify.repository_tokens(tables, ids))).cache()
    d = graph.token_dictionary(named).cache()
    edges = graph.to_undirected(graph.reindex_edges(named, d)).cache()
    made = factorize.graph_vectors(edges, 4, 4, iterations=2)["spectral"]
    rows = {r.name: np.array(r.vec) for r in graph.decode_ids(made, d).collect() if r.name.startswith("trans_row:type")}
    same = [v @ w for a, v in rows.items() for b, w in rows.items() if a < b and a[10:15] == b[10:15]]
    other = [v @ w for a, v in rows.items() for b, w in rows.items() if a < b and a[10:15] != b[10:15]]
    assert np.mean(same) > np.mean(other) + 0.05


def test_strategy_json(spark, tmp_path):
    df = spark.createDataFrame([("t", "a", "augment", "cell"), ("t", "b", "eqw_quantize", "cell"), ("u", "c", "augment", "token")], "relation string, col string, int_strategy string, grain string")
    relations.write_strategies(df, f"{tmp_path}/s")
    assert sorted(relations.read_strategies(spark, f"{tmp_path}/s").collect()) == sorted(df.collect())


def test_unweighted_edges_and_vector_header(spark, tmp_path):
    spark.createDataFrame([("1 2",), ("2\t3 0.5",), ("",)], "v string").write.text(f"{tmp_path}/e")
    got = sorted(tuple(r) for r in vectors.read_edgelist(spark, f"{tmp_path}/e").collect())
    assert got == [(1, 2, 1.0), (2, 3, 0.5)]
    emb = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [4.0, 5.0, 6.0])], "token string, vec array<double>")
    vectors.write_w2v_text(emb, f"{tmp_path}/w")
    first = spark.read.text(f"{tmp_path}/w").select("value", "_metadata.file_name").orderBy("file_name").first().value
    assert first == "2 3"
    assert sorted(vectors.read_w2v_text(spark, f"{tmp_path}/w").collect()) == sorted(emb.collect())


def test_summary_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)], "v double")
    got = {r.stat: r.value for r in evaluate.summary_stats(df, "v").collect()}
    assert got["geomean"] == pytest.approx(2 ** 1.5) and got["p50"] == 3.0 and got["max"] == 8.0


def test_phrase_passes_keep_only_their_last_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tablevec.session.shared_dir", lambda _: str(tmp_path))
    lines = [(f"d{i}", 0, ["new", "york", "city", f"w{i % 7}"]) for i in range(40)]
    sents = spark.createDataFrame(lines, "doc string, sent int, words array<string>")
    made = train.phrase_corpus(sents, (0.5, 0.5), 5)
    assert {w for r in made.collect() for w in r.words if "_" in w}
    assert made.count() == 40
    assert len(list((tmp_path / "settled").iterdir())) == 1
