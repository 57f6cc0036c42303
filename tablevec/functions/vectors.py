"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x * x))


def scale(v, factor) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_c(v), lambda x: x * f)


def unit(v) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    # the length is bound once by the outer transform: an expression inside the inner one would be worked out per element
    scaled = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, scale(v, F.lit(1.0) / n)).otherwise(_c(v)))
    return F.get(scaled, F.lit(0))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a, b) -> Column:
    return norm(subtract(a, b))


def dimension(df: DataFrame, v: str = "vec") -> int:
    """Length of the vectors of a table; 0 without any."""
    row = df.select(v).where(F.col(v).isNotNull()).first()
    return len(row[0]) if row else 0


def _per_element(v: Column, width: int, element) -> Column:
    """Aggregate: an array of one plain number aggregate per element; null without vectors, other lengths are an error."""
    wrong = (F.min(F.size(v)) != width) | (F.max(F.size(v)) != width)
    made = F.array(*[element(i) for i in range(width)]).cast("array<double>")
    return F.when(F.count(v) > 0, F.when(wrong, F.raise_error(F.lit(f"vectors of {width} numbers expected"))).otherwise(made))


def mean_vector(v, weight=None, width: int | None = None) -> Column:
    """Aggregate: element-wise (weighted) mean, combined map-side before the shuffle.

    With ``width``, the known length, the elements are plain number aggregates, which Spark compiles and hashes in
    binary rows. Without it they are one object a group: enough for few groups, slow for as many as there are rows.
    """
    v = _c(v)
    if width is None:
        feature = array_to_vector(v)
        return vector_to_array(Summarizer.mean(feature) if weight is None else Summarizer.mean(feature, _c(weight)))
    if weight is None:
        return _per_element(v, width, lambda i: F.avg(F.get(v, F.lit(i))))
    w = _c(weight)
    total = F.sum(F.when(v.isNotNull(), w))
    return F.when(total > 0, _per_element(v, width, lambda i: F.sum(F.get(v, F.lit(i)) * w) / total))


def sum_vector(v, width: int | None = None) -> Column:
    """Aggregate: element-wise sum, combined map-side before the shuffle; ``width`` as in ``mean_vector``."""
    v = _c(v)
    if width is None:
        return vector_to_array(Summarizer.sum(array_to_vector(v)))
    return _per_element(v, width, lambda i: F.sum(F.get(v, F.lit(i))))
