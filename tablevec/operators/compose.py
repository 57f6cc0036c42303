"""Vectors of columns, relations and rows from the vectors of their tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.functions import ordering, vectors
from tablevec.functions.vectors import dimension
from tablevec.operators.prep import MIN_COLS, MIN_ROWS
from tablevec.session import settle


def compose_columns(tokens: DataFrame, emb: DataFrame, must_have: DataFrame | None = None) -> DataFrame:
    """(relation, col, vec): mean of a column's token vectors, repeats counted.

    ``emb`` has (token, vec). Repeats are counted before the join, so a hot token is one row per
    column. ``must_have`` names the tokens of another model that a token has to be in as well.
    """
    counts = tokens.groupBy("relation", "col", "token").agg(F.count(F.lit(1)).cast("double").alias("n"))
    if must_have is not None:
        counts = counts.join(must_have.select("token"), "token", "left_semi")
    return counts.join(emb.select("token", "vec"), "token").groupBy("relation", "col").agg(
        vectors.mean_vector("vec", "n", dimension(emb)).alias("vec")
    )


def compose_columns_unique(tokens: DataFrame, emb: DataFrame) -> DataFrame:
    """As ``compose_columns`` over the different tokens of a column."""
    distinct = tokens.select("relation", "col", "token").distinct()
    return distinct.join(emb.select("token", "vec"), "token").groupBy("relation", "col").agg(
        vectors.mean_vector("vec", width=dimension(emb)).alias("vec")
    )


def compose_relations(columns: DataFrame) -> DataFrame:
    """(relation, vec): mean of the column vectors."""
    return columns.groupBy("relation").agg(vectors.mean_vector("vec").alias("vec"))


def compose_rows(tokens: DataFrame, emb: DataFrame) -> DataFrame:
    """(relation, row_id, vec): mean per row; null where no token has a vector.

    Rows cannot be counted down first, so hot tokens meet their vectors by broadcast.
    """
    placed = settle(tokens.select("relation", "row_id", "token"))
    joined = ordering.join_hot(placed, emb.select("token", "vec"), ["token"], "left")
    return joined.groupBy("relation", "row_id").agg(vectors.mean_vector("vec", width=dimension(emb)).alias("vec"))


def _or_zero(emb: DataFrame):
    zero = F.array_repeat(F.lit(0.0), dimension(emb))
    return F.coalesce(F.col("vec"), zero)


def of_large_relations(tokens: DataFrame) -> DataFrame:
    """Tokens of relations with more than 15 rows and 2 columns that carry tokens."""
    cells = tokens.groupBy("relation", "row_id", "col").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("relation").agg(F.count_distinct("row_id").alias("rows"), F.count_distinct("col").alias("cols"))
    large = sizes.where((F.col("rows") > MIN_ROWS) & (F.col("cols") > MIN_COLS)).select("relation")
    return tokens.join(F.broadcast(large), "relation", "left_semi")  # one row per relation


def compose_repository(tokens: DataFrame, row_emb: DataFrame, col_emb: DataFrame) -> dict[str, DataFrame]:
    """``rel_vec``, ``col_vec`` and ``row_vec`` with a ``flavour`` column (row, col), of large relations."""
    placed = settle(of_large_relations(tokens))
    cols = compose_columns(placed, row_emb).withColumn("flavour", F.lit("row")).unionByName(
        compose_columns(placed, col_emb, row_emb).withColumn("flavour", F.lit("col"))
    )
    cols = settle(cols)
    rels = cols.groupBy("flavour", "relation").agg(vectors.mean_vector("vec").alias("vec"))
    rows = compose_rows(placed, row_emb).withColumn("flavour", F.lit("row")).unionByName(
        compose_rows(placed, col_emb).withColumn("flavour", F.lit("col"))
    )
    return {"rel_vec": rels, "col_vec": cols, "row_vec": rows}


def without_hubs(tokens: DataFrame, hubness: DataFrame, threshold: float) -> DataFrame:
    """Tokens whose hubness is below the threshold; tokens never scored count as 0."""
    hubs = hubness.where(F.col("hubness") >= threshold).select("token")
    return tokens.join(hubs, "token", "left_anti")


def missing_tokens(tokens: DataFrame, emb: DataFrame) -> DataFrame:
    """(relation, col, missing): tokens without a vector, repeats counted."""
    counts = tokens.groupBy("relation", "col", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(emb.select("token"), "token", "left_anti").groupBy("relation", "col").agg(F.sum("n").alias("missing"))


def row_features(base: DataFrame, row_vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows with their vector; a row whose node was pruned gets zeros."""
    joined = base.join(row_vectors.select(*keys, "vec"), keys, "left")
    return joined.withColumn("vec", _or_zero(row_vectors))


def combine(df: DataFrame, by: list[str]) -> DataFrame:
    """Element-wise mean of the vectors of each group."""
    return df.groupBy(*by).agg(vectors.mean_vector("vec").alias("vec"))
