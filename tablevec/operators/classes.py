"""Classes of vectors by direction: Lloyd's rounds as one scan and one small sum each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.functions import ordering, vectors
from tablevec.session import settle

MOST_CENTER_NUMBERS = 20_000_000
DIGITS = 9


def _centers(members: DataFrame, k: int, width: int) -> np.ndarray:
    """k unit-length sums, NaN rows for classes without members or with a zero sum."""
    sums = members.groupBy("cluster").agg(vectors.sum_vector("vec").alias("vec")).toArrow()
    centers = np.full((k, width), np.nan)
    if sums.num_rows:
        centers[sums["cluster"].to_numpy()] = np.array(sums["vec"].to_pylist())
    length = np.linalg.norm(centers, axis=1, keepdims=True)
    return np.divide(centers, length, out=np.full_like(centers, np.nan), where=length > 0)


def _assign(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, vec, cluster): the class with the largest dot, ties to the smallest."""
    sent = points.sparkSession.sparkContext.broadcast(centers)

    def nearest(batches):
        known = ~np.isnan(sent.value).any(axis=1)
        if not known.any():  # every sum is zero: no direction to tell classes by
            known = np.arange(len(known)) == 0
        table, names = np.nan_to_num(sent.value[known]), np.flatnonzero(known)
        for pdf in batches:
            if len(pdf):
                dots = np.round(np.stack(pdf["vec"].to_numpy()) @ table.T, DIGITS)
                yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "cluster": names[dots.argmax(axis=1)]})

    return points.select("id", "vec").mapInPandas(nearest, f"id {dict(points.dtypes)['id']}, vec array<double>, cluster int")


def directional_classes(emb: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """(id, cluster): ``rounds`` rounds of k-means by dot product with unit-length centroids.

    The vector at place i in id order starts in class i mod k. A round sums each class (map-side first),
    scales the sums to length 1 and gives every vector the class with the largest dot, rounded to nine
    digits so that the order of summation decides nothing; ties go to the smallest class. A class
    without members stays empty, and where all sums are zero everything goes to class 0. Null and empty vectors, and vectors with a null number, are left out; all
    others have one length. Rows that repeat an id are classed each. An empty table gives an empty one.

    Only the centroids (k x dimension numbers, refused above 20 million) come to the driver and go to tasks.
    """
    given = emb.where("size(vec) > 0 AND NOT exists(vec, x -> x IS NULL)").select("id", vectors.doubles("vec").alias("vec"))
    placed = ordering.number_rows(given, [], ["id"], "place")
    points = settle(placed.select("id", "vec", (F.col("place") % k).cast("int").alias("cluster")))
    width = points.select(F.max(F.size("vec"))).first()[0]
    if width is None:
        return points.select("id", "cluster")
    if k * width > MOST_CENTER_NUMBERS:
        raise ValueError(f"{k} centroids of {width} numbers are too many to send to every task")
    members = points
    for _ in range(rounds):
        members = _assign(points, _centers(members, k, width))
    return members.select("id", "cluster")
