"""Vectors from a graph by sparse factorization and spectral propagation.

Matrices are (row, col, v) tables, blocks of vectors are (id, vec) tables. A product is a join
and a grouped vector sum; only d x d matrices (d = dimension) come to the driver.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.functions import ordering, vectors
from tablevec.functions.draws import DRAW_RANGE, draw
from tablevec.session import settle

OVERSAMPLE = 10
TREE_PARTS = 64
RANK_LIMIT = 1e-12


def factor_matrix(edges: DataFrame, power: float = 0.75) -> DataFrame:
    """(row, col, v): ln of the row-normalised weights less ln of weight times noise share of the column.

    Values that are not positive count as 1 before the logarithm.
    """
    strength = edges.groupBy("src").agg(F.sum(F.abs("weight")).alias("s"))
    normal = ordering.join_hot(edges, strength, ["src"]).withColumn("c", F.col("weight") / F.col("s"))
    normal = settle(normal.select("src", "dst", "weight", "c"))
    noise = settle(normal.groupBy("dst").agg(F.pow(F.sum("c"), F.lit(power)).alias("g")))
    total = noise.agg(F.sum("g").alias("g")).scalar()

    def log(x):
        return F.ln(F.when(x > 0, x).otherwise(1.0))

    joined = ordering.join_hot(normal, noise, ["dst"])
    return joined.select(
        F.col("src").alias("row"),
        F.col("dst").alias("col"),
        (log(F.col("c")) - log(F.col("weight") * F.col("g") / total)).alias("v"),
    )


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


class SparseProduct:
    """A settled matrix that multiplies vector tables; its hot columns are looked up once."""

    def __init__(self, matrix: DataFrame):
        self.matrix = matrix
        self.hot = ordering.hot_keys(matrix, ["col"])

    def times(self, block: DataFrame) -> DataFrame:
        """(id, vec): the product with a block (id, vec); rows without entries do not appear."""
        side = block.select(F.col("id").alias("col"), "vec")
        m = ordering.join_on_hot(self.matrix, side, ["col"], self.hot)
        return m.select(F.col("row").alias("id"), vectors.scale("vec", F.col("v")).alias("vec")).groupBy("id").agg(
            vectors.sum_vector("vec", vectors.dimension(block)).alias("vec")
        )


def right_multiply(block: DataFrame, m: np.ndarray) -> DataFrame:
    """Rows times a small matrix, by Arrow batches, without a shuffle."""

    def apply(batches):
        for pdf in batches:
            if len(pdf):
                out = np.stack(pdf["vec"].to_numpy()) @ m
                yield pd.DataFrame({"id": pdf["id"], "vec": list(out)})

    return block.select("id", "vec").mapInPandas(apply, f"id {dict(block.dtypes)['id']}, vec array<double>")


def _triangles(rows: DataFrame) -> DataFrame:
    """(vec): per task the rows of R of a QR decomposition, folded in batch by batch, so d x d numbers are held."""

    def fold(batches):
        r = None
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["vec"].to_numpy())
                r = np.linalg.qr(m if r is None else np.concatenate([r, m]), mode="r")
        if r is not None and r.size:
            yield pd.DataFrame({"vec": list(r)})

    return rows.select("vec").mapInPandas(fold, "vec array<double>")


def tall_svd(block: DataFrame, parts: int = TREE_PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (largest first) and right singular vectors, as columns with a fixed sign, of a tall block.

    A tree of QR decompositions: each task folds its rows to a triangle, at most ``parts`` tasks fold those
    triangles, and what is left of them (d x d each) comes to the driver. No Gram matrix is formed,
    so small singular values keep all digits. An empty block gives none.
    """
    first = _triangles(block).withColumn("part", F.spark_partition_id() % parts)
    rows = _triangles(first.repartition("part")).toArrow()["vec"].to_pylist()
    if not rows:
        return np.zeros(0), np.zeros((0, 0))
    _, values, vt = np.linalg.svd(np.linalg.qr(np.array(rows), mode="r"), full_matrices=False)
    vecs = vt.T
    sign = np.sign(vecs[np.abs(vecs).argmax(axis=0), np.arange(vecs.shape[1])])
    return values, vecs * np.where(sign == 0, 1, sign)


def _whiten(values: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    safe = values > (values[0] if len(values) else 0) * RANK_LIMIT
    return vecs[:, safe] / values[safe]


def orthonormal(block: DataFrame) -> DataFrame:
    """The block with orthonormal columns spanning its own, by tree QR.

    The second pass takes off what rounding left of the columns' lengths; directions weaker than
    1e-12 of the strongest are dropped.
    """
    for _ in range(2):
        block = settle(right_multiply(block, _whiten(*tall_svd(block))))
    return block


def random_block(ids: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(id, vec) of normal draws fixed by id and position."""
    place = F.sequence(F.lit(0), F.lit(width - 1))

    def u(tag, i):
        return (draw(seed, F.lit(tag), "id", i) + 0.5) / float(DRAW_RANGE)

    normal = F.transform(place, lambda i: F.sqrt(-2 * F.ln(u("r", i))) * F.cos(2 * F.lit(np.pi) * u("a", i)))
    return ids.select("id", normal.alias("vec"))


def _unit_rows(block: DataFrame) -> DataFrame:
    return block.select("id", vectors.unit("vec").alias("vec"))


def truncated_svd(matrix: DataFrame, dim: int, iterations: int = 3, seed: int = 0) -> DataFrame:
    """(id, vec): left singular vectors scaled by the root of the singular values, rows of length 1.

    Block power iteration from a drawn start; every round is two sparse products.
    """
    f, ft = SparseProduct(matrix), SparseProduct(settle(transpose(matrix)))
    columns = matrix.select(F.col("col").alias("id")).distinct()
    block = settle(f.times(settle(random_block(columns, dim + OVERSAMPLE, seed))))
    for _ in range(iterations):
        back = settle(ft.times(orthonormal(block)))
        block = settle(f.times(orthonormal(back)))
    q = orthonormal(block)
    values, v = tall_svd(settle(ft.times(q)))
    # q.v holds the left singular vectors
    return _unit_rows(right_multiply(q, v[:, :dim] * values[:dim] ** 0.5))


def dense_svd_rotate(block: DataFrame, dim: int) -> DataFrame:
    """(id, vec): U times the root of the singular values of a tall block, rows of length 1."""
    block = settle(block)
    values, v = tall_svd(block)
    keep = values[:dim] > (values[0] if len(values) else 0) * RANK_LIMIT
    return _unit_rows(right_multiply(block, v[:, :dim][:, keep] / values[:dim][keep] ** 0.5))


def bessel_first_kind(order: int, theta: float, terms: int = 30) -> float:
    """Modified Bessel function of the first kind, by its series."""
    return sum((theta / 2) ** (2 * m + order) / (factorial(m) * factorial(m + order)) for m in range(terms))


def _sum_blocks(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of blocks by id, in one grouping."""
    width = vectors.dimension(parts[0][0])
    scaled = [b.select("id", vectors.scale("vec", w).alias("vec")) for b, w in parts]
    out = scaled[0]
    for s in scaled[1:]:
        out = out.unionByName(s)
    return out.groupBy("id").agg(vectors.sum_vector("vec", width).alias("vec"))


def spectral_propagate(edges: DataFrame, block: DataFrame, step: int = 10, mu: float = 0.2, theta: float = 0.5, rotate: bool = True) -> DataFrame:
    """(id, vec): the block smoothed over the graph by a Chebyshev filter, then rotated again.

    The filter works on M = (I - D^-1 (I + A)) - mu I; M is one sparse table, so each term of the
    expansion costs two products.
    """
    if step == 1:
        return block
    block = settle(block)
    dim = len(block.first().vec)
    loops = block.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("v"))
    around = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("v")).unionByName(loops)
    around = settle(around.groupBy("row", "col").agg(F.sum("v").alias("v")))
    strength = around.groupBy("row").agg(F.sum(F.abs("v")).alias("s"))
    shares = ordering.join_hot(around, strength, ["row"]).select("row", "col", (-F.col("v") / F.col("s")).alias("v"))
    laplace = loops.withColumn("v", F.lit(1.0 - mu)).unionByName(shares).groupBy("row", "col").agg(F.sum("v").alias("v"))
    m = SparseProduct(settle(laplace))

    def twice(x):
        return settle(m.times(settle(m.times(x))))

    before = block
    now = settle(_sum_blocks([(twice(block), 0.5), (block, -1.0)]))
    total = _sum_blocks([(before, bessel_first_kind(0, theta)), (now, -2 * bessel_first_kind(1, theta))])
    total = settle(total)
    for i in range(2, step):
        following = settle(_sum_blocks([(twice(now), 1.0), (now, -2.0), (before, -1.0)]))
        total = settle(_sum_blocks([(total, 1.0), (following, (-1) ** i * 2 * bessel_first_kind(i, theta))]))
        before, now = now, following
    smooth = SparseProduct(around).times(settle(_sum_blocks([(block, 1.0), (total, -1.0)])))
    return dense_svd_rotate(smooth, dim) if rotate else settle(_unit_rows(smooth))


def graph_vectors(edges: DataFrame, dim: int = 128, step: int = 10, mu: float = 0.2, theta: float = 0.5, iterations: int = 3, seed: int = 0) -> dict[str, DataFrame]:
    """``sparse`` (factorized) and ``spectral`` (propagated) vectors of an undirected graph."""
    edges = settle(edges.select("src", "dst", "weight"))
    sparse = settle(truncated_svd(settle(factor_matrix(edges)), dim, iterations, seed))
    return {"sparse": sparse, "spectral": spectral_propagate(edges, sparse, step, mu, theta)}


def graph_vectors_unweighted(edges: DataFrame, dim: int = 128, step: int = 10, mu: float = 0.2, theta: float = 0.5, iterations: int = 3, seed: int = 0) -> dict[str, DataFrame]:
    """The variant with weight 1 per edge line, without self loops and without the last rotation."""
    ones = edges.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    ones = settle(ones)
    sparse = settle(truncated_svd(settle(factor_matrix(ones)), dim, iterations, seed))
    return {"sparse": sparse, "spectral": spectral_propagate(ones, sparse, step, mu, theta, rotate=False)}
