"""The given tables as a repository of relations, and SQL text for the same cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = ("region", "nation", "supplier", "customer", "part")
EVERYTHING = (*DIMENSIONS, "orders", "lineitem")

# name -> [(column, kind)] in table order; kind: int, float, str, time
COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "str")],
    "nation": [("n_nationkey", "int"), ("n_name", "str"), ("n_regionkey", "int")],
    "supplier": [("s_suppkey", "int"), ("s_name", "str"), ("s_nationkey", "int"), ("s_acctbal", "float")],
    "customer": [
        ("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "str"),
    ],
    "part": [
        ("p_partkey", "int"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"), ("p_size", "int"),
        ("p_retailprice", "float"),
    ],
    "orders": [
        ("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"), ("o_totalprice", "float"),
        ("o_orderdate", "time"), ("o_orderpriority", "str"),
    ],
    "lineitem": [
        ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
        ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
        ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "time"),
    ],
}
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "supplier": ["s_suppkey"],
    "customer": ["c_custkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repository(spark: SparkSession, sf_dir: str, names=DIMENSIONS) -> dict[str, DataFrame]:
    return {n: read(spark, sf_dir, n) for n in names}


def row_ids(names=DIMENSIONS) -> dict:
    return {n: F.concat_ws("|", *[F.col(c).cast("string") for c in KEYS[n]]) for n in names}


def row_id_sql(name: str) -> str:
    return " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in KEYS[name])


def valid_sql(x: str) -> str:
    """SQL truth of a cell that carries text."""
    t = f"trim(CAST({x} AS VARCHAR), E' \\t\\n\\r\\f\\v')"
    return f"({x} IS NOT NULL AND {t} <> '' AND CAST({x} AS VARCHAR) <> '\\N' AND NOT regexp_matches({t}, '^[0-9]+/[0-9]+/[0-9]+'))"


def norm_sql(x: str) -> str:
    return f"trim(replace(replace(lower({x}), ',', ' '), '  ', ' '), E' \\t\\n\\r\\f\\v')"


def cells_sql(names=DIMENSIONS, policy: str = "augment", token_cols: tuple = ()) -> str:
    """SELECT of (relation, row_id, col, pos, value, grain) over the tables' valid cells."""
    parts = []
    for n in names:
        for pos, (c, kind) in enumerate(COLUMNS[n]):
            numeric = kind in ("int", "float")
            if numeric and policy == "skip":
                continue
            value = f"CAST({c} AS VARCHAR)"
            if numeric and policy == "augment":
                value = f"'{c}_<#>_' || {value}"
            grain = "token" if c in token_cols else "cell"
            parts.append(
                f"SELECT '{n}' AS relation, {row_id_sql(n)} AS row_id, '{c}' AS col, {pos} AS pos, "
                f"{value} AS value, '{grain}' AS grain FROM {n} WHERE {valid_sql(c)}"
            )
    return "\nUNION ALL ".join(parts)


def tokens_sql(names=DIMENSIONS, policy: str = "augment", token_cols: tuple = ()) -> str:
    """SELECT of (relation, row_id, col, pos, tpos, token); whole-cell and word grain."""
    cells = cells_sql(names, policy, token_cols)
    norm = norm_sql("value")
    cell = f"SELECT relation, row_id, col, pos, 0 AS tpos, replace({norm}, ' ', '_') AS token FROM cells_ WHERE grain = 'cell'"
    if not token_cols:
        return f"WITH cells_ AS ({cells}) SELECT * FROM ({cell}) WHERE token <> ''"
    words = (
        "SELECT relation, row_id, col, pos, u.i - 1 AS tpos, ws[u.i] AS token FROM "
        f"(SELECT *, list_filter(regexp_split_to_array({norm}, '[ \\t\\n\\r\\f\\v]+'), lambda t: t <> '') AS ws "
        "FROM cells_ WHERE grain = 'token'), unnest(range(1, len(ws) + 1)) AS u(i)"
    )
    return f"WITH cells_ AS ({cells}) SELECT * FROM ({cell} UNION ALL {words}) WHERE token <> ''"


def edges_sql(names=DIMENSIONS, max_num: int = 5000, max_tables: int = 5) -> str:
    """CTE list ``tok, inc, stats, keep, edges`` of the pruned token-row graph."""
    return f"""tok AS ({tokens_sql(names)}),
inc AS (SELECT token, relation, row_id, count(*) AS n FROM tok GROUP BY ALL),
stats AS (SELECT token, sum(n) AS num, count(DISTINCT relation) AS tables FROM inc GROUP BY token),
keep AS (SELECT token, num FROM stats WHERE num <> 1 AND num < {max_num} AND tables < {max_tables}),
edges AS (SELECT token, relation, row_id, 1.0::DOUBLE / num AS weight FROM inc JOIN keep USING (token))"""


def classes_sql(points: str, k: int, rounds: int = 10, width: int = 64) -> str:
    """Common tables ``a0`` to ``a{rounds}`` (id, vec, cluster) over a table (id, vec): classes by direction."""
    ctes = [f"a0 AS MATERIALIZED (SELECT id, vec, (row_number() OVER (ORDER BY id) - 1) % {k} AS cluster FROM {points})"]
    for i in range(1, rounds + 1):
        ctes.append(
            f"""s{i} AS (SELECT cluster, list(m ORDER BY j) AS vec FROM
(SELECT cluster, u.j, sum(vec[u.j]) AS m FROM a{i - 1}, range(1, {width + 1}) AS u(j) GROUP BY ALL) GROUP BY cluster),
u{i} AS MATERIALIZED (SELECT cluster, vec, sqrt(list_inner_product(vec, vec)) AS len FROM s{i}),
a{i} AS MATERIALIZED (SELECT id, vec, cluster FROM (SELECT p.id, p.vec, u{i}.cluster,
row_number() OVER (PARTITION BY p.id ORDER BY round(list_inner_product(p.vec, u{i}.vec) / len, 9) DESC, u{i}.cluster) AS r FROM {points} p, u{i}) WHERE r = 1)"""
        )
    return ",\n".join(ctes)
