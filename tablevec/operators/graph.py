"""The token-row graph: incidence, pruning, edges, ids, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevec.functions import ordering
from tablevec.session import settle

# Default pruning limits and degree cap.
MAX_OCCURRENCES = 5000
MAX_TABLES = 5
MAX_DEGREE = 30


def incidence(tokens: DataFrame) -> DataFrame:
    """(token, relation, row_id, n): how often a token occurs on a row."""
    return tokens.groupBy("token", "relation", "row_id").agg(F.count(F.lit(1)).alias("n"))


def token_stats(tokens: DataFrame, prefix_compat: bool = False) -> DataFrame:
    """(token, num, tables): occurrences and distinct tables, counted per table first.

    ``prefix_compat`` takes the text before the first ``_`` as the table name.
    """
    table = F.substring_index("relation", "_", 1) if prefix_compat else F.col("relation")
    per_table = tokens.groupBy("token", table.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return per_table.groupBy("token").agg(F.sum("n").alias("num"), F.count(F.lit(1)).alias("tables"))


def links_well(max_num: int = MAX_OCCURRENCES, max_tables: int = MAX_TABLES) -> Column:
    """True for token stats that link rows without linking everything."""
    return (F.col("num") != 1) & (F.col("num") < max_num) & (F.col("tables") < max_tables)


def clean_tokens(stats: DataFrame, max_num: int = MAX_OCCURRENCES, max_tables: int = MAX_TABLES) -> DataFrame:
    return stats.where(links_well(max_num, max_tables))


def weighted_edges(
    tokens: DataFrame,
    max_num: int = MAX_OCCURRENCES,
    max_tables: int = MAX_TABLES,
    prefix_compat: bool = False,
    share: int = 1000,
) -> DataFrame:
    """(token, relation, row_id, weight): distinct edges with weight 1/num between kept tokens and rows.

    Pruned tokens that hold more than 1/``share`` of all occurrences number less than ``share``:
    a broadcast drops them before the join, so no hot token is shuffled. The join places and sorts rows
    by the token's hash before its text, as tokens of a column begin alike and would be compared in full;
    dropping repeats inside a row reuses that placement.
    """
    placed = settle(tokens.select("token", "relation", "row_id"))
    stats = settle(token_stats(placed, prefix_compat))
    keep = clean_tokens(stats, max_num, max_tables).select("token", "num")
    total = stats.agg(F.sum("num").alias("n")).scalar()
    hot = stats.where((F.col("num") * share > total) & ~links_well(max_num, max_tables)).select("token")
    hashed = F.xxhash64("token")
    return (
        placed.join(F.broadcast(hot), "token", "left_anti")
        .withColumn("__h", hashed)
        .join(keep.withColumn("__h", hashed), ["__h", "token"])
        .dropDuplicates(["__h", "token", "relation", "row_id"])
        .select("token", "relation", "row_id", (F.lit(1.0) / F.col("num")).alias("weight"))
    )


def row_node(relation: str = "relation", row_id: str = "row_id") -> Column:
    return F.concat(F.col(relation), F.lit("_row:"), F.col(row_id))


def name_edges(edges: DataFrame) -> DataFrame:
    """(x, y, weight) with the row node as text."""
    return edges.select(F.col("token").alias("x"), row_node().alias("y"), "weight")


def token_dictionary(named: DataFrame) -> DataFrame:
    """(name, id): distinct end points of an edge list numbered in name order."""
    names = named.select(F.explode(F.array("x", "y")).alias("name"))
    return ordering.number_rows(names.distinct(), [], ["name"], "id")


def decode_ids(df: DataFrame, dictionary: DataFrame, column: str = "id") -> DataFrame:
    """Adds ``name`` for the id in ``column``."""
    d = dictionary.select(F.col("id").alias(column), "name")
    return df.join(d, column, "left")


def search_tokens(dictionary: DataFrame, part: str) -> DataFrame:
    """Dictionary entries whose name contains ``part``."""
    return dictionary.where(F.contains(F.col("name"), F.lit(part)))


def reindex_edges(named: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(src, dst, weight) from a settled (x, y, weight): names replaced by ids, hot names without a shuffle."""
    dx = dictionary.select(F.col("name").alias("x"), F.col("id").alias("src"))
    dy = dictionary.select(F.col("name").alias("y"), F.col("id").alias("dst"))
    half = ordering.join_hot(named, dx, ["x"])
    return ordering.join_on_hot(half, dy, ["y"], ordering.hot_keys(named, ["y"])).select("src", "dst", "weight")


def to_undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; parallel edges keep one weight (the largest)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionAll(back).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(src, degree, strength)."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, pos, dst, weight, degree, prob): neighbours numbered from 0 by id, one row each.

    The list of a hub may be any length, so neighbours stay in rows that join on (src, pos).
    """
    numbered = ordering.number_rows(
        edges.select("src", "dst", "weight"), ["src"], ["dst"], "pos", totals={"degree": "*", "strength": "weight"}
    )
    return numbered.select("src", "pos", "dst", "weight", "degree", (F.col("weight") / F.col("strength")).alias("prob"))


def cap_degree(edges: DataFrame, k: int = MAX_DEGREE) -> DataFrame:
    """The ``k`` heaviest neighbours of each node (ties by id)."""
    return ordering.top_per_group(edges, ["src"], [F.desc("weight"), "dst"], k, "rank").drop("rank")

