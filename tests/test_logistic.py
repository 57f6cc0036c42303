"""Logistic models fitted together against one fit after another, and F1 by hand."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablevec.functions.draws import draw
from tablevec.operators import logistic, ml


def table(spark, n=240, d=4, labels=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 3, 0.5, 1]
    y = (x @ rng.normal(size=(d, labels)) + rng.normal(size=(n, labels)) > 0.8).astype(int)
    emb = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    pairs = spark.createDataFrame([(i, f"label {k}") for i in range(n) for k in range(labels) if y[i, k]] + [(0, "label 0")] * 2, "id long, label string")
    return emb, pairs, x, y


def test_equals_one_fit_after_another(spark):
    emb, _, x, y = table(spark)
    rng = np.random.default_rng(4)
    splits = rng.random((len(x), 2)) < [0.5, 0.9]
    rows = spark.createDataFrame(
        [(i, x[i].tolist(), np.flatnonzero(y[i]).tolist(), splits[i].tolist()) for i in range(len(x))],
        "id long, vec array<double>, labels array<int>, splits array<boolean>",
    ).repartition(3).cache()
    for strength in (1e-4, 0.1):
        w = logistic.fit(rows, y.shape[1], 2, strength)
        assert w.shape == (5, 10)
        for s in range(2):
            for k in (0, 3):
                train = rows.where(F.get("splits", F.lit(s))).select(
                    array_to_vector("vec").alias("features"), F.array_contains("labels", k).cast("double").alias("label")
                )
                one = LogisticRegression(regParam=strength, standardization=False, maxIter=500, tol=1e-12).fit(train)
                assert np.allclose(w[1:, 5 * s + k], one.coefficients.toArray(), atol=1e-4)
                assert abs(w[0, 5 * s + k] - one.intercept) < 1e-4


def test_f1_of_every_split_by_hand(spark):
    emb, pairs, x, y = table(spark, seed=6)
    got = {(r.share, r.shuffle): r for r in ml.node_classification(emb, pairs, (0.3, 0.7), 2, 0.01, 1).collect()}
    assert len(got) == 4
    own = y.sum(axis=1) > 0
    for (share, shuffle), r in got.items():
        drawn = emb.select("id", (draw(1 if shuffle == 0 else f"1.{shuffle}", "id") % 1000 / 1000.0).alias("u")).collect()
        train = np.array([u.u < share for u in sorted(drawn)]) & own
        test = ~train & own
        w = np.zeros((5, y.shape[1]))
        x1 = np.hstack([np.ones((len(x), 1)), x])
        for k in range(y.shape[1]):  # Newton's method, label by label
            for _ in range(50):
                p = 1 / (1 + np.exp(-x1[train] @ w[:, k]))
                grad = x1[train].T @ (p - y[train, k]) / train.sum() + 0.01 * np.append(0, w[1:, k])
                hess = (x1[train].T * (p * (1 - p))) @ x1[train] / train.sum() + 0.01 * np.diag([0, 1, 1, 1, 1])
                w[:, k] -= np.linalg.solve(hess, grad)
        pred = np.zeros_like(y)
        for i in np.flatnonzero(test):
            pred[i, np.argsort(-(x1[i] @ w), kind="stable")[: y[i].sum()]] = 1
        p, t = pred[test], y[test]
        f1 = [2 * (p * t).sum(axis=a) / (p.sum(axis=a) + t.sum(axis=a)) for a in (0, 1)]
        assert np.isclose(r.micro, 2 * (p * t).sum() / (p.sum() + t.sum()))
        assert np.isclose(r.macro, f1[0].mean()) and np.isclose(r.samples, f1[1].mean())
        assert np.isclose(r.weighted, (f1[0] * t.sum(axis=0)).sum() / t.sum())


def test_separable_and_one_sided_labels(spark):
    rows = spark.createDataFrame(
        [(i, [float(i - 20)], [0, 1] if i > 20 else [0], [True, i % 2 == 0]) for i in range(40)],
        "id long, vec array<double>, labels array<int>, splits array<boolean>",
    ).cache()
    w = logistic.fit(rows, 3, 2, 1e-3, rounds=60)  # label 0 always, label 1 separable, label 2 never
    assert np.isfinite(w).all() and w[1, 1] > 0 and w[0, 0] > 5 and w[0, 2] < -5
    best = logistic.most_probable(rows, w, 3).collect()
    assert {r.id for r in best} == set(range(1, 40, 2)) and all(r.split == 1 and r.best[0] == 0 for r in best if r.id < 20)
