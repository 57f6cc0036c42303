"""Tiled neighbours against brute force: pruning forced, a third of the rows copies of one vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablevec.functions import vectors
from tablevec.operators import analyze, neighbours, rank


def table(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vec array<double>")


def blobs(n=900, copies=300, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 4
    m = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.05
    m[rng.permutation(n)[:copies]] = m[0]
    return m


def brute(m, k, exclude=True):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for q in range(len(m)):
        order = sorted((i for i in range(len(m)) if not (exclude and i == q)), key=lambda i: (-s[q, i], i))
        out[q] = [(i, s[q, i]) for i in order[:k]]
    return out


def check(got, want):
    rows = {}
    for r in got:
        rows.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    assert rows.keys() == want.keys()
    for q, expected in want.items():
        mine = sorted(rows[q])
        assert [i for _, i, _ in mine] == [i for i, _ in expected], q
        assert [s for *_, s in mine] == pytest.approx([s for _, s in expected], abs=2e-9)


def visits(monkeypatch):
    """Rows of base vectors that queries are compared with, summed over all meetings."""
    seen = []
    plain = neighbours.meet

    def spy(queries, base, tiles, *args):
        sizes = tiles.rows
        seen.append(sum(int(sizes[r.visits].sum()) for r in queries.select("visits").collect()))
        return plain(queries, base, tiles, *args)

    monkeypatch.setattr(neighbours, "meet", spy)
    return seen


def test_pruned_tiles_and_copies(spark, monkeypatch):
    m = blobs()
    seen = visits(monkeypatch)
    # tiles far below the default, so that several tiles and crowded cells come into play
    monkeypatch.setattr(neighbours, "LEAST_TILE", 16)
    got = neighbours.knn(table(spark, m), 5, tile=16).collect()
    check(got, brute(m, 5))
    distinct = len(np.unique(m, axis=0))
    assert len(seen) == 2 and sum(seen) < distinct**2 / 3, "hardly any tile was pruned"


def test_comparisons_grow_slower_than_the_square(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_TILE", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(100, 3)) * 9
    total = []
    for n in (500, 1000, 2000):
        m = centres[rng.integers(0, n // 20, n)] + rng.normal(size=(n, 3)) * 0.02  # as many in a cluster at every size
        seen = visits(monkeypatch)
        rows = neighbours.knn(table(spark, m), 5, "euclidean", tile=16).collect()
        assert len(rows) == 5 * n
        total.append(sum(seen))
        monkeypatch.undo()
        monkeypatch.setattr(neighbours, "LEAST_TILE", 16)
    assert total[1] < 3 * total[0] and total[2] < 3 * total[1] and total[2] < 2000**2 / 8


@pytest.mark.parametrize("scale", [1, 1e5])
def test_euclidean_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(neighbours, "LEAST_TILE", 16)
    m = blobs(300, 60, 5, 9) * scale
    m[7] = m[8] + 1e-7 * scale
    gaps = np.round(1 - np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)), 9)
    want = {q: [(i, gaps[q, i]) for i in sorted((i for i in range(len(m)) if i != q), key=lambda i: (-gaps[q, i], i))[:6]] for q in range(len(m))}
    check(neighbours.knn(table(spark, m), 6, "euclidean", tile=16).collect(), want)


def test_zero_vectors_and_scores_that_tie_when_rounded(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_TILE", 4)
    rng = np.random.default_rng(10)
    m = rng.normal(size=(60, 3))
    m[5] = m[17] = 0
    m[20:40] = m[3] + rng.normal(size=(20, 3)) * 1e-6  # cosines that round to 1
    df = table(spark, m)
    unit = np.array([r.u for r in df.orderBy("id").select(vectors.unit("vec").alias("u")).collect()])
    s = np.round(unit @ unit.T, 9)
    want = {q: [(i, s[q, i]) for i in sorted((i for i in range(60) if i != q), key=lambda i: (-s[q, i], i))[:8]] for q in range(60)}
    check(neighbours.knn(df, 8, tile=4).collect(), want)


def test_no_vectors(spark):
    df = table(spark, np.ones((3, 2)))
    assert neighbours.nearest(df.withColumnRenamed("id", "qid"), df.limit(0), 2).count() == 0
    assert neighbours.nearest(df.limit(0).withColumnRenamed("id", "qid"), df, 2).count() == 0


def test_one_tile_and_groups(spark):
    m = blobs(120, 40)
    df = table(spark, m)
    check(neighbours.knn(df, 7).collect(), brute(m, 7))
    grouped = df.withColumn("relation", (F.col("id") % 3).cast("string"))
    got = rank.relevant_rows_diverse(df.withColumnRenamed("id", "qid"), grouped, 4, 2).collect()
    everything = brute(m, len(m), exclude=False)
    want = {}
    for q, ranked in everything.items():
        taken, few = {}, []
        for i, s in ranked:
            taken[i % 3] = taken.get(i % 3, 0) + 1
            if taken[i % 3] <= 2:
                few.append((i, s))
        want[q] = few[:4]
    check(got, want)


def test_counts_and_histogram_with_copies(spark):
    m = blobs(150, 50)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    got = {r.id: r.within for r in neighbours.count_within(table(spark, m), 0.9).collect()}
    assert got == {i: int((s[i] > 0.9).sum()) for i in range(len(m))}
    hist = neighbours.cosine_histogram(table(spark, m), 20).collect()
    assert sum(r.n for r in hist) == len(m) ** 2
    assert sum(r.density * (r.hi - r.lo) for r in hist) == pytest.approx(1)


def test_concentration_without_pairs(spark):
    m = blobs(80, 20) + 1
    got = {r.id: r.concentration for r in analyze.distance_concentration(table(spark, m)).collect()}
    s = m @ m.T
    assert [got[i] for i in range(len(m))] == pytest.approx(list(s.std(axis=1) / s.mean(axis=1)))


def test_hub_denoised_against_brute_force(spark):
    m = np.random.default_rng(5).normal(size=(60, 6))
    df = table(spark, m)
    near = neighbours.knn(df, 10).cache()
    hub = analyze.hubness(df, 10, near).cache()
    got = {}
    for r in rank.hub_denoised(near, near, df, hub, 10, hub_limit=0.6).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.origin))
    lists = brute(m, 10)
    score = {r.id: r.hubness for r in hub.collect()}
    for q, ranked in lists.items():
        mine = [(i, o) for _, i, o in sorted(got[q])]
        good = [i for i, _ in ranked if score[i] < 0.6]
        if not good:
            assert [i for i, _ in mine] == [i for i, _ in ranked]
            continue
        assert [i for i, o in mine if o == "kept"] == good
        voted = [i for i, o in mine if o == "voted"]
        assert not set(voted) & set(good) and q not in voted and all(score[i] < 0.6 for i in voted)
        dropped = sorted((i for i, _ in ranked if score[i] >= 0.6), key=lambda i: (score[i], [j for j, _ in ranked].index(i)))
        assert [i for i, o in mine if o == "returned"] == dropped[: 10 - len(good) - len(voted)]


def test_mutual_proximity_against_brute_force(spark):
    from math import erf

    m = np.random.default_rng(6).normal(size=(40, 5))
    near = neighbours.knn(table(spark, m), 12).cache()
    lists = brute(m, 12)
    fit = {q: (np.mean([1 - s for _, s in v]), np.std([1 - s for _, s in v])) for q, v in brute(m, 39).items()}
    fits = analyze.distance_fits(table(spark, m)).cache()
    assert {r.id: (r.m, r.s) for r in fits.collect()} == {q: pytest.approx(f, abs=1e-8) for q, f in fit.items()}

    def above(d, f):
        return 1 - 0.5 * (1 + erf((d - f[0]) / f[1] / 2**0.5))

    got = {(r.qid, r.id): r.score for r in analyze.mutual_proximity(near, fits, 12).collect()}
    for q, v in lists.items():
        for i, s in v:
            assert got[q, i] == pytest.approx(above(1 - s, fit[q]) * above(1 - s, fit[i]), abs=1e-6)


def test_unit_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    zero, other = [r.u for r in df.select(vectors.unit("v").alias("u")).collect()]
    assert zero == [0.0, 0.0] and other == pytest.approx([0.6, 0.8])


def test_queries_travel_once_to_a_lot_and_copies_meet_once(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_TILE", 16)
    m = blobs(900, 300)
    met = []
    plain = neighbours._with_lots

    def spy(queries, tiles):
        out = plain(queries, tiles).cache()
        visits = queries.select(F.sum(F.size("visits"))).first()[0] or 0
        met.append((out.select(F.sum(F.size("__lots"))).first()[0] or 0, visits, int(tiles.rows.sum())))
        return out

    monkeypatch.setattr(neighbours, "_with_lots", spy)
    got = neighbours.nearest_of(table(spark, m).withColumnRenamed("id", "qid"), table(spark, m), [3, 12], "dot", False, tile=16)
    s = np.round(m @ m.T, 9)
    for k in (3, 12):
        check(got[k].collect(), {q: [(i, s[q, i]) for i in sorted(range(len(m)), key=lambda i: (-s[q, i], i))[:k]] for q in range(len(m))})
    (sent, visits, rows), distinct = met[0], len(np.unique(m, axis=0))
    assert rows == distinct and sent < visits / 3


def test_hubness_queries_search_once(spark, monkeypatch):
    from tablevec.plans import compose_queries, vector_queries

    m = np.random.default_rng(7).normal(size=(60, 4))
    rows = table(spark, m).withColumn("relation", F.concat(F.lit("t"), F.col("id") % 3))
    for plans in (compose_queries, vector_queries):
        monkeypatch.setattr(plans, "emb", lambda *_: rows.select("id", "vec"))
        monkeypatch.setattr(plans, "labelled", lambda *_: rows)
    searches, plain = [], neighbours.tile_search
    monkeypatch.setattr(neighbours, "tile_search", lambda *a, **k: searches.append(1) or plain(*a, **k))
    for query in (vector_queries.hubness_thresholds, vector_queries.hubness_skew, compose_queries.hubness_by_hit, compose_queries.query_hubness):
        searches.clear()
        assert query(spark, None).count() and len(searches) == 1, query.__name__
