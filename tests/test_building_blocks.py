"""Order, joins, draws and text rules on small tables, with the large-data paths forced."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablevec.functions import ordering, text, vectors
from tablevec.functions.draws import draw
from tablevec.operators import prep, textify
from tablevec.plans import compose_queries
from tablevec.session import settle


def test_number_rows_with_a_hot_group(spark):
    rows = [("hot", i, float(i % 7)) for i in range(500)] + [(f"g{i % 20}", i, 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, w double")
    got = ordering.number_rows(df, ["g"], ["x"], "pos", {"before": "w"}, {"size": "*", "all": "w"}, parts=8).collect()
    for group in ("hot", "g3"):
        mine = sorted((r for r in got if r.g == group), key=lambda r: r.x)
        assert [r.pos for r in mine] == list(range(len(mine)))
        assert [r.before for r in mine] == pytest.approx(np.cumsum([0] + [r.w for r in mine])[:-1])
        assert {r["size"] for r in mine} == {len(mine)}
        assert {round(r["all"], 6) for r in mine} == {round(sum(r.w for r in mine), 6)}


def test_number_of_ranges_does_not_change_results(spark):
    df = spark.createDataFrame([(f"w{i * 37 % 101}'\\",) for i in range(101)], "t string").distinct()
    want = sorted(r.t for r in df.collect())
    for parts in (1, 7, None):
        got = ordering.number_rows(df, [], ["t"], "id", parts=parts).collect()
        assert [r.t for r in sorted(got, key=lambda r: r.id)] == want


def test_null_groups_and_null_and_nan_places(spark):
    rows = [(None if i % 4 == 0 else f"g{i % 3}", None if i == 17 else i, i) for i in range(41)]
    df = spark.createDataFrame(rows, "`the.group` string, `it's` int, n int").withColumn("n", F.col("n").cast("decimal(10,2)"))
    got = ordering.number_rows(df, ["the.group"], ["it's"], "pos", totals={"size": "*"}, parts=5).collect()
    assert len(got) == 41
    for group in {r[0] for r in rows}:
        mine = sorted((r for r in got if r[0] == group), key=lambda r: r.pos)
        values = [r[1] for r in mine]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))
        assert [r.pos for r in mine] == list(range(len(mine))) and {r["size"] for r in mine} == {len(mine)}
    by_date = spark.range(30).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 30).cast("int")).alias("d"))
    assert [r.d for r in sorted(ordering.number_rows(by_date, [], ["d"], parts=4).collect(), key=lambda r: r.pos)] == sorted(r.d for r in by_date.collect())
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-1.5,), (0.0,)], "x double")
    ordered = [r.x for r in sorted(ordering.number_rows(odd, [], ["x"], parts=3).collect(), key=lambda r: r.pos)]
    assert ordered[:4] == [None, -1.5, 0.0, float("inf")] and np.isnan(ordered[4])


def test_a_nan_is_a_missing_number(spark):
    df = spark.createDataFrame([(float(i),) for i in range(40)] + [(float("nan"),), (None,)], "x double")
    plain = df.where("x IS NOT NULL AND NOT isnan(x)")
    assert prep.quantile_edges(prep.long_values(df)).collect() == prep.quantile_edges(prep.long_values(plain)).collect()
    bins = [r.x for r in prep.quantize(df, {"x": ("eqw_quantize", "cell")}).collect()]
    assert bins.count(None) == 2 and sorted(b for b in bins if b is not None) == sorted(i // 4 + 1 for i in range(40))


def test_names_with_dots_and_quotes(spark):
    names = ["a.b", "it's", "back`tick", "plain"]
    df = spark.createDataFrame([(i, float(i * i), f"text, {i}", "x") for i in range(30)], "c0 int, c1 double, c2 string, c3 string").toDF(*names)
    profile = {r.col: r for r in prep.profile_columns(df).collect()}
    assert set(profile) == set(names) and profile["a.b"]["distinct"] == 30 and profile["it's"]["max"] == 841.0
    plan = prep.strategy_map(prep.infer_strategies(prep.profile_columns(df)))
    tokens = textify.repository_tokens({"t": df}, {"t": F.col("`a.b`")}, {"t": plan}).collect()
    assert {r.col for r in tokens} == set(names) and len(tokens) == 120
    assert {r.token for r in tokens if r.col == "back`tick"} == {f"text_{i}" for i in range(30)}
    assert prep.category_codes(df, "back`tick").count() == 30
    assert prep.one_hot(df, "plain").columns == [*names[:3], "plain_x"]
    assert textify.row_pair_combinations(df).count() == 180 and textify.term_counts({"t": df}).count() > 0


def test_strategies_of_tables_that_share_a_name(spark):
    one = prep.profile_columns(spark.range(30).selectExpr("id AS value", "id * 1.5D AS x")).withColumn("relation", F.lit("one"))
    two = prep.profile_columns(spark.range(30).selectExpr("CAST(id AS string) AS value")).withColumn("relation", F.lit("two"))
    got = [(r.relation, r.col) for r in prep.infer_strategies(one.unionByName(two)).collect()]
    assert sorted(got) == [("one", "value"), ("one", "x"), ("two", "value")]


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "k string")
    assert sorted((r.k or "", r.features.ones, r.features["size"]) for r in prep.one_hot_vectors(df, "k").collect()) == [
        ("", [], 2), ("a", [0], 2), ("b", [1], 2), ("b", [1], 2)
    ]


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=301), np.full(200, 0.5)])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 3.0), ("b", None)], "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.edge for r in ordering.percentiles(df, ["g"], "x", probs, parts=4).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx(np.percentile(values, 100 * p))
        assert got["b", p] == 3.0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot_equals_plain_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i % 90}", i) for i in range(300)], "k string, i int")
    right = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(60)], "k string, v double")
    key = lambda r: (r.k, r.i, r.v is None, r.v or 0)
    assert ordering.hot_keys(left, ["k"], 10).collect()[0].k == "hot"
    got = sorted(ordering.join_hot(left, right, ["k"], how, share=10).select("k", "i", "v").collect(), key=key)
    assert got == sorted(left.join(right, ["k"], how).select("k", "i", "v").collect(), key=key)


def test_a_hot_key_is_split_at_any_size(spark):
    left = spark.range(10_000).selectExpr("CASE WHEN id % 3 < 2 THEN -1 ELSE id END AS k", "id")
    right = spark.range(-1, 10_000).selectExpr("id AS k", "id * 2 AS v")
    joined = ordering.join_hot(left, right, ["k"])
    assert "Union" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert [r.k for r in ordering.hot_keys(left, ["k"]).collect()] == [-1]
    assert joined.count() == 10_000


def test_draw_is_an_md5(spark):
    got = spark.range(3).select(draw(7, "id", F.lit(2)).alias("d")).collect()
    assert [r.d for r in got] == [int(hashlib.md5(f"7|{i}|2".encode()).hexdigest()[:8], 16) for i in range(3)]


def test_cells_that_carry_no_text(spark):
    cells = [None, "", "  ", "\\N", "12/31/2020", "12/31/2020 x", "a, b  c", "Mixed Case", "\tx\n"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    by_column = [r.v for r in df.select(text.valid_cell("c").alias("v")).collect()]
    by_text = [r.v for r in df.select(F.expr(text.valid_cell_expr("c")).alias("v")).collect()]
    assert [bool(v) for v in by_column] == [bool(v) for v in by_text] == [False] * 6 + [True] * 3


def test_cell_tokens(spark):
    df = spark.createDataFrame([("a, b  c", "Mixed Case Words")], "x string, y string")
    row = df.select(text.encode_cell("x").alias("a"), text.encode_cell("y").alias("b"), text.encode_cell("y", "token").alias("c")).first()
    # the comma becomes a space, and one pass of double spaces turns three spaces into two
    assert row.a == ["a_b_c"] and row.b == ["mixed_case_words"] and row.c == ["mixed", "case", "words"]


def test_row_tokens_policies_and_bins(spark):
    df = spark.createDataFrame([(i, float(i), f"Name {i % 2}") for i in range(40)], "id int, big double, name string")
    plan = {"id": ("skip", "cell"), "big": ("eqh_quantize", "cell"), "name": ("augment", "token")}
    got = textify.repository_tokens({"t": df}, {"t": "id"}, {"t": plan}).collect()
    row = sorted((r.pos, r.tpos, r.token) for r in got if r.row_id == "39")
    assert row == [(1, 0, "big_<#>_10"), (2, 0, "name"), (2, 1, "1")]
    few = textify.repository_tokens({"t": df.limit(5)}, {"t": "id"}, {"t": plan}).collect()
    assert {r.token for r in few if r.col == "big"} == {f"big_<#>_{float(i)}" for i in range(5)}


def test_strategies(spark):
    skewed = [float(2 ** (i % 30)) for i in range(60)]
    rows = [(i * 1000, v, float(i), f"k{i}", " ".join(["w"] * 12)) for i, v in enumerate(skewed)]
    df = spark.createDataFrame(rows, "wide int, skewed double, row_id double, name string, prose string")
    got = prep.strategy_map(prep.infer_strategies(prep.profile_columns(df)))
    assert got == {
        "wide": ("eqh_quantize", "cell"), "skewed": ("eqw_quantize", "cell"), "row_id": ("augment", "cell"),
        "name": ("augment", "cell"), "prose": ("augment", "token"),
    }


def test_legacy_tokenizer(spark):
    df = spark.createDataFrame([("The big-Red_fox x1y, and so on, é",)], "c string")
    assert df.select(text.tokenize("c", " ").alias("t")).first().t == ["the", "big", "red", "fox", "and"]


def test_clean_article(spark):
    body = "== Title ==\n First, line. \n\n== More ==\nsecond \"line\"\n== References ==\nlost"
    df = spark.createDataFrame([(body,), ("a\n== External links\nb",)], "c string")
    assert [r.t for r in df.select(text.clean_article("c").alias("t")).collect()] == ["First line second line", "a"]


def test_pair_samples_and_counts(spark):
    rows = [(0, "x", "a"), (1, "y", "b"), (2, "x", "c"), (3, "z", "b"), (4, "y", "a"), (5, "w", "d")]
    df = spark.createDataFrame(rows, "no int, key string, val string").select("key", "val", "no")
    near = {(r.key, r.value, r.label) for r in textify.pair_samples(df, "no", 1).collect()}
    assert ("x", "a", 0) in near and ("x", "b", 1) in near and ("w", "d", 0) not in near
    block = {(r.key, r.value, r.label) for r in textify.pair_samples(df, "no", 4).collect()}
    assert block == {("y", "a", 0), ("y", "c", 1), ("y", "b", 1)}
    counts = {(r.key, r.value): r.negatives for r in textify.negative_counts(df.select("key", "val", "no"), "no").where("col = 'val'").collect()}
    for no, key, value in rows:
        assert counts[key, value] == sum(k != key and v != value for _, k, v in rows)


def test_pair_samples_never_broadcast_cells(spark, capsys):
    rows = [(i, f"k{'abc'[i % 3]}", f"v{'wxyz'[i % 4]}") for i in range(25)]
    df = settle(spark.createDataFrame(rows, "no int, key string, val string").select("key", "val", "no"))
    for buffer in (1, 4):
        pairs = textify.pair_samples(df, "no", buffer)
        assert pairs.where("label = 1").count() > 0
        pairs.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_mean_vector_weights(spark):
    df = spark.createDataFrame([([1.0, 2.0], 3.0), ([5.0, 6.0], 1.0)], "v array<double>, w double")
    assert df.agg(vectors.mean_vector("v", "w").alias("m")).first().m == pytest.approx([2.0, 3.0])


def test_vector_aggregates_of_known_length_are_plain_numbers(spark, capsys):
    rows = [(i % 40, [float(i), -float(i), 0.5], float(i % 3)) for i in range(200)] + [(0, None, 2.0), (99, None, 1.0), (7, [1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "g int, v array<double>, w double")
    made = df.groupBy("g").agg(
        vectors.sum_vector("v", 3).alias("s"), vectors.mean_vector("v", width=3).alias("m"), vectors.mean_vector("v", "w", 3).alias("wm")
    )
    for r in made.collect():
        mine = [(np.array(v), w) for g, v, w in rows if g == r.g and v is not None]
        if not mine:
            assert r.g == 99 and r.s is None and r.m is None and r.wm is None
            continue
        assert r.s == pytest.approx(sum(v for v, _ in mine)) and r.m == pytest.approx(sum(v for v, _ in mine) / len(mine))
        heavy = [(v, w) for v, w in mine if w]
        assert r.wm == pytest.approx(sum(v * w for v, w in heavy) / sum(w for _, w in heavy))
    made.explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan
    for other in ([1.0], [1.0] * 4):
        with pytest.raises(Exception, match="vectors of 3 numbers"):
            df.unionByName(spark.createDataFrame([(1, other, 1.0)], df.schema)).groupBy("g").agg(vectors.sum_vector("v", 3)).collect()


def test_ends_of_permuted_columns_are_hashed_not_sorted(spark, capsys):
    rows = [("t", "c", None if i % 9 == 0 else f"r{i // 2}", i % 3, f"w{i % 7}") for i in range(90)] * 2 + [("t", "d", "r", 0, "one")]
    p = textify.permuted_columns(spark.createDataFrame(rows, "relation string, col string, row_id string, tpos int, token string"), 4, seed=7)
    want = {}
    for r in p.collect():
        want.setdefault((r.perm, r.relation, r.col), []).append((r.place, r.row_id or "", r.tpos, r.token))
    ends = textify.permuted_ends(p)
    got = {(r.perm, r.relation, r.col): (r.n, r.first_token, r.last_token) for r in ends.collect()}
    assert got == {k: (len(v), min(v)[3], max(v)[3]) for k, v in want.items()}
    ends.explain()
    plan = capsys.readouterr().out
    # whole rows are compared only after the few at an end were picked
    assert "Filter" in plan and plan.index("SortAggregate") < plan.index("BroadcastHashJoin")


def test_token_vectors_are_written_by_many_tasks(spark, sf_dir):
    tokens = spark.range(120000).select(F.concat(F.lit("a_long_column_name_<#>_"), F.col("id") % 60000).alias("token"))
    made = compose_queries.token_vectors(spark, sf_dir, tokens)
    assert made.count() == 60000 and made.select("token").distinct().count() == 60000
    assert len(made.inputFiles()) > 4
