"""Vectors for a grid of walk length, context window and dimension."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.functions import vectors
from tablevec.operators import factorize, train, walks
from tablevec.session import settle


def walk_sweep(
    edges: DataFrame,
    lengths: list[int],
    windows: list[int],
    dims: list[int],
    num_walks: int = 10,
    weighted: bool = False,
    shift: float = 5.0,
    iterations: int = 3,
    seed: int = 0,
) -> Iterator[tuple[dict, DataFrame, DataFrame]]:
    """(parameters, matrix, vectors) for every combination, in the order length, window, dimension.

    Walks are made once, of the greatest length: a draw depends on start, walk and step only, so
    their beginnings are the walks of any lesser length. Each (length, window) is counted and factorized
    once, in the largest dimension; the leading columns are the vectors of the smaller ones. ``matrix`` is
    (row, col, v), ``vectors`` (token, vec) of unit length. No edges give empty tables.
    """
    paths = settle(walks.random_walks(edges, num_walks, max(lengths), weighted, seed))
    for length in sorted(lengths):
        docs = paths.select(
            F.col("start").alias("doc"), F.col("walk").alias("sent"), F.slice("path", 1, length + 1).alias("words")
        )
        for window in sorted(windows):
            matrix = settle(train.mutual_information(train.context_pairs(docs, window, seed, counted=True), shift))
            widest = settle(factorize.truncated_svd(matrix, max(dims), iterations, seed))
            for dim in sorted(dims):
                leading = widest.withColumn("vec", F.slice("vec", 1, dim))
                named = leading.select(F.col("id").alias("token"), vectors.unit("vec").alias("vec"))
                yield {"length": length, "window": window, "dim": dim}, matrix, named
