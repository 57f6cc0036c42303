"""Many logistic regressions on the same rows, fitted together.

All models form one weight block of (width + 1) x models, which is sent to the tasks once a round; a round is one
job that gives loss and gradient of every model. Rows hold the labels that are true for them and the splits that
they train, so a model is a (split, label) pair and no model needs a pass, or a plan, of its own. On the driver each
model goes its own way: limited-memory quasi-Newton steps, halved where they don't lower its loss.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.session import settle

BLOCK = 64  # models whose gradients are one row
MEMORY = 10
CELLS_AT_ONCE = 2_000_000


def _chunks(batch: pa.RecordBatch, models: int) -> Iterator[tuple[np.ndarray, list, list]]:
    """Rows with a leading 1, their true labels and their splits; few enough at once for a row by model array."""
    step = max(1, CELLS_AT_ONCE // models)
    for start in range(0, batch.num_rows, step):
        some = batch.slice(start, step)
        vec = some.column("vec")
        flat = vec.flatten().to_numpy().reshape(some.num_rows, -1)
        yield np.hstack([np.ones((len(flat), 1)), flat]), some.column("labels").to_pylist(), some.column("splits").to_pylist()


def _truth(labels: list, splits: list, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, whether they count): 0 and 1 by row and model, models of a split together."""
    y = np.zeros((len(labels), n_labels))
    for i, own in enumerate(labels):
        y[i, own] = 1
    train = np.array(splits, dtype=bool)
    return np.tile(y, (1, train.shape[1])), np.repeat(train, n_labels, axis=1)


def loss_and_gradient(rows: DataFrame, weights: np.ndarray, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows each model trains on: (loss by model, gradient by weight and model)."""
    models = weights.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, slope = shared.value, np.zeros(models), np.zeros(weights.shape)
        for batch in batches:
            for x, labels, splits in _chunks(batch, models):
                y, counts = _truth(labels, splits, n_labels)
                z = x @ w
                total += ((np.logaddexp(0, z) - y * z) * counts).sum(axis=0)
                slope += x.T @ ((0.5 * (1 + np.tanh(z / 2)) - y) * counts)
        starts = range(0, models, BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i // BLOCK for i in starts], pa.int32()),
             pa.array([np.vstack([total[i : i + BLOCK], slope[:, i : i + BLOCK]]).tobytes() for i in starts], pa.binary())],
            ["block", "sums"],
        )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(data)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "sums"]
        )

    schema = "block int, sums binary"
    parts = rows.select("vec", "labels", "splits").mapInArrow(work, schema)
    found = sorted(parts.repartition("block").mapInArrow(add, schema).collect())  # the size of the weight block
    both = np.hstack([np.frombuffer(r.sums).reshape(len(weights) + 1, -1) for r in found]) if found else np.zeros((len(weights) + 1, models))
    shared.unpersist()
    return both[0], both[1:]


def _direction(slope: np.ndarray, moves: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Quasi-Newton directions of all models from their last moves and changes of slope, oldest first."""
    q = slope.copy()
    product = (moves * turns).sum(axis=1)  # memory x models
    known = product > 1e-12
    inverse = np.where(known, 1 / np.where(known, product, 1), 0)
    alphas = []
    for k in range(len(moves) - 1, -1, -1):
        alphas.append(inverse[k] * (moves[k] * q).sum(axis=0))
        q -= alphas[-1] * turns[k]
    size = (turns[-1] ** 2).sum(axis=0)
    q *= np.where(known[-1], product[-1] / np.where(size > 0, size, 1), 1 / np.maximum(1, np.sqrt((slope**2).sum(axis=0))))
    for k in range(len(moves)):
        q += moves[k] * (alphas[-1 - k] - inverse[k] * (turns[k] * q).sum(axis=0))
    return -q


def fit(rows: DataFrame, n_labels: int, n_splits: int, strength: float = 1e-4, tolerance: float = 1e-7, rounds: int = 200) -> np.ndarray:
    """Weights by (constant and width, model), models of a split together.

    ``rows``: settled (vec, labels: array of the numbers of the true labels, splits: array of whether the row trains
    a split). Minimised: mean loss plus ``strength`` / 2 times the squared weights without the constant, until no
    slope passes ``tolerance``. The weight block and ``MEMORY`` moves of it are held on the driver.
    """
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    models = n_labels * n_splits
    counts = rows.agg(*[F.sum(F.get("splits", F.lit(i)).cast("long")) for i in range(n_splits)]).first()
    n = np.repeat(np.array([c or 0 for c in counts], dtype=np.float64), n_labels)
    n = np.maximum(n, 1)
    penalty = np.append(0, np.full(width, strength))[:, None]

    def measure(w):
        loss, slope = loss_and_gradient(rows, w, n_labels)
        return loss / n + (penalty * w * w).sum(axis=0) / 2, slope / n + penalty * w

    w = np.zeros((width + 1, models))
    if not models:
        return w
    loss, slope = measure(w)
    moves, turns = np.zeros((2, MEMORY, width + 1, models))
    step = np.ones(models)
    way = _direction(slope, moves, turns)
    for _ in range(rounds):
        if np.abs(slope).max() <= tolerance:
            break
        new = w + step * way
        new_loss, new_slope = measure(new)
        good = new_loss <= loss + 1e-4 * step * (slope * way).sum(axis=0) + 1e-15
        moves[:, :, good] = np.concatenate([moves[1:, :, good], (new - w)[None, :, good]])
        turns[:, :, good] = np.concatenate([turns[1:, :, good], (new_slope - slope)[None, :, good]])
        w[:, good], loss[good], slope[:, good] = new[:, good], new_loss[good], new_slope[:, good]
        step = np.where(good, 1.0, step / 2)
        fresh = _direction(slope, moves, turns)
        uphill = (fresh * slope).sum(axis=0) >= 0
        fresh[:, uphill] = -slope[:, uphill]
        way = np.where(good, fresh, way)
        if step.min() < math.ulp(1.0):
            break
    return w


def most_probable(rows: DataFrame, weights: np.ndarray, n_labels: int) -> DataFrame:
    """(id, split, best) of every row and split that it does not train: the numbers of as many labels as are true for
    it, the most probable first, of equal ones the smaller number."""
    models = weights.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x, labels, splits in _chunks(batch, models):
                z = (x @ shared.value).reshape(len(x), -1, n_labels)
                order = np.argsort(-z, axis=2, kind="stable")
                where, split, best = [], [], []
                for i, (own, trains) in enumerate(zip(labels, splits, strict=True)):
                    for s in np.flatnonzero(~np.array(trains, dtype=bool)).tolist():
                        where.append(at + i)
                        split.append(s)
                        best.append(order[i, s, : len(own)].tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(where, pa.int64())), pa.array(split, pa.int32()), pa.array(best, pa.list_(pa.int32()))],
                    ["id", "split", "best"],
                )
                at += len(x)

    return settle(rows.select("id", "vec", "labels", "splits").mapInArrow(work, f"id {kind}, split int, best array<int>"))
