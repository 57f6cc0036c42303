"""Queries: target split, profile, strategies, binning, cell rules, coding, joins of base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablevec.functions import text
from tablevec.operators import prep, textify
from tablevec.plans.tables import COLUMNS, EVERYTHING, cells_sql, norm_sql, read, repository, row_ids, valid_sql

NUMERIC = {
    "customer": ["c_acctbal"],
    "orders": ["o_totalprice"],
    "lineitem": ["l_quantity", "l_extendedprice", "l_discount"],
    "part": ["p_retailprice", "p_size"],
}
PROFILED = ("customer", "part", "lineitem", "documents")
PROFILE_COLUMNS = {
    **COLUMNS,
    "documents": [("doc_id", "int"), ("text", "str"), ("lang", "str"), ("source", "str"), ("n_chars", "int")],
}


def _profile(spark, d, name):
    df = read(spark, d, name).select(*[c for c, k in PROFILE_COLUMNS[name] if k != "time"])
    return prep.profile_columns(df).withColumn("relation", F.lit(name))


def _profile_all(spark, d):
    out = None
    for name in PROFILED:
        p = _profile(spark, d, name)
        out = p if out is None else out.unionByName(p)
    return out


def column_profile(spark, d):
    return _profile_all(spark, d).select(
        "relation", "col", "kind", "non_null", "distinct",
        F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("skew", 4).alias("skew"),
        F.round("median_words", 4).alias("median_words"),
    )


def _profile_sql() -> str:
    parts = []
    for name in PROFILED:
        for c, kind in PROFILE_COLUMNS[name]:
            if kind == "time":
                continue
            num = kind != "str"
            mm = (f"min({c})::DOUBLE", f"max({c})::DOUBLE", f"skewness({c}::DOUBLE)") if num else ("NULL::DOUBLE",) * 3
            med = "NULL::DOUBLE" if num else f"quantile_cont(length({c}) - length(replace({c}, ' ', '')) + 1, 0.5)::DOUBLE"
            parts.append(
                f"SELECT '{name}' AS relation, '{c}' AS col, '{kind}' AS kind, count({c}) AS non_null, "
                f"count(DISTINCT {c}) AS \"distinct\", {mm[0]} AS min, {mm[1]} AS max, {mm[2]} AS skew, "
                f"{med} AS median_words FROM {name}"
            )
    return "\nUNION ALL ".join(parts)


COLUMN_PROFILE_SQL = f"""SELECT relation, col, kind, non_null, "distinct", round(min, 4) AS min, round(max, 4) AS max,
round(skew, 4) AS skew, round(median_words, 4) AS median_words FROM ({_profile_sql()})"""


def infer_strategies(spark, d):
    return prep.infer_strategies(_profile_all(spark, d)).select("relation", "col", "int_strategy", "grain")


INFER_SQL = f"""SELECT relation, col,
CASE WHEN (kind = 'float' AND NOT contains(col, 'id')) OR (kind = 'int' AND max - min >= 5 * non_null)
     THEN CASE WHEN abs(skew) >= 2 THEN 'eqw_quantize' ELSE 'eqh_quantize' END ELSE 'augment' END AS int_strategy,
CASE WHEN kind = 'str' AND median_words >= 10 THEN 'token' ELSE 'cell' END AS grain
FROM ({_profile_sql()})"""


def _numbers(spark, d):
    out = None
    for name, cols in NUMERIC.items():
        v = prep.long_values(read(spark, d, name), cols).select("col", "x")
        out = v if out is None else out.unionByName(v)
    return out


def _binned(values, edges):
    return (
        values.join(edges, "col")
        .select("col", "x", prep.bin_of("x", "edges").alias("bin"))
        .groupBy("col", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    )


def quantile_bins(spark, d):
    values = _numbers(spark, d)
    return _binned(values, prep.quantile_edges(values))


def offset_width_bins(spark, d):
    values = _numbers(spark, d)
    return _binned(values, prep.offset_width_edges(values))


def quantile_edges(spark, d):
    return prep.quantile_edges(_numbers(spark, d)).select(
        "col", F.posexplode("edges").alias("i", "e")
    ).select("col", F.col("i").cast("int").alias("i"), F.round("e", 4).alias("edge"))


_NUMBERS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c}::DOUBLE AS x FROM {t}" for t, cols in NUMERIC.items() for c in cols
)
_PROBS = "[" + ", ".join(f"{i / 10}" for i in range(10)) + "]"
QUANTILE_SQL = f"""WITH v AS ({_NUMBERS_SQL}), e AS (SELECT col, quantile_cont(x, {_PROBS}) AS edges FROM v GROUP BY col),
b AS (SELECT col, x, len(list_filter(edges, lambda q: q <= x))::INTEGER AS bin FROM v JOIN e USING (col))
SELECT col, bin, count(*) AS n, min(x) AS min_x, max(x) AS max_x FROM b GROUP BY ALL"""
QUANTILE_EDGES_SQL = f"""WITH v AS ({_NUMBERS_SQL}), e AS (SELECT col, quantile_cont(x, {_PROBS}) AS edges FROM v GROUP BY col)
SELECT col, (g.i - 1)::INTEGER AS i, round(edges[g.i], 4) AS edge FROM e, range(1, 11) AS g(i)"""
WIDTH_SQL = f"""WITH v AS ({_NUMBERS_SQL}), e AS (SELECT col, max(x) - min(x) AS span FROM v GROUP BY col),
b AS (SELECT col, x, len(list_filter(range(0, 10), lambda i: span * i / 10 <= x))::INTEGER AS bin FROM v JOIN e USING (col))
SELECT col, bin, count(*) AS n, min(x) AS min_x, max(x) AS max_x FROM b GROUP BY ALL"""


def quantized_tokens(spark, d):
    """Profile, choose strategies, bin, and count the tokens of every column."""
    out = None
    for name in ("customer", "part", "orders"):
        df = read(spark, d, name).select(*[c for c, k in COLUMNS[name] if k != "time"])
        plan = prep.strategy_map(prep.infer_strategies(prep.profile_columns(df)))
        toks = textify.repository_tokens({name: df}, row_ids([name]), {name: plan})
        counts = toks.groupBy("relation", "col", "token").agg(F.count(F.lit(1)).alias("n"))
        out = counts if out is None else out.unionByName(counts)
    return out


def _quantized_sql() -> str:
    """Each numeric column twice, once binned and once as it is, and the rule picks one."""
    prof, parts = [], []
    for name in ("customer", "part", "orders"):
        for c, kind in COLUMNS[name]:
            if kind == "time":
                continue
            if kind == "str":
                parts.append(
                    f"SELECT '{name}' AS relation, '{c}' AS col, replace({norm_sql(c)}, ' ', '_') AS token FROM {name} WHERE {valid_sql(c)}"
                )
                continue
            rule = "max - min >= 5 * n" if kind == "int" else f"NOT contains('{c}', 'id')"
            prof.append(
                f"SELECT '{c}' AS col, {rule} AS binned, abs(sk) >= 2 AS deep, q, max - min AS span FROM "
                f"(SELECT count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, skewness({c}::DOUBLE) AS sk, "
                f"quantile_cont({c}::DOUBLE, {_PROBS}) AS q FROM {name})"
            )
            parts.append(
                f"SELECT '{name}' AS relation, '{c}' AS col, '{c}_<#>_' || CASE WHEN binned THEN "
                f"CAST(len(list_filter(CASE WHEN deep THEN q ELSE list_transform(range(0, 10), lambda i: span * i / 10) END, lambda e: e <= {c})) AS VARCHAR) "
                f"ELSE CAST({c} AS VARCHAR) END AS token FROM {name}, (SELECT * FROM prof WHERE col = '{c}') WHERE {c} IS NOT NULL"
            )
    union = "\nUNION ALL ".join(parts)
    return f"""WITH prof AS ({" UNION ALL ".join(prof)}), t AS ({union})
SELECT relation, col, token, count(*) AS n FROM t GROUP BY ALL"""


def numeric_policies(spark, d):
    out = None
    for policy in ("skip", "stringify", "augment"):
        tables = repository(spark, d, ("part", "supplier"))
        plans = {n: {c: (policy, "cell") for c in df.columns} for n, df in tables.items()}
        toks = textify.repository_tokens(tables, row_ids(), plans)
        t = toks.groupBy("relation", "col", "token").agg(F.count(F.lit(1)).alias("n")).withColumn("policy", F.lit(policy))
        out = t if out is None else out.unionByName(t)
    return out


NUMERIC_POLICIES_SQL = "\nUNION ALL ".join(
    f"SELECT relation, col, replace({norm_sql('value')}, ' ', '_') AS token, count(*) AS n, '{p}' AS policy "
    f"FROM ({cells_sql(('part', 'supplier'), p)}) GROUP BY ALL"
    for p in ("skip", "stringify", "augment")
)


def valid_cells(spark, d):
    """Valid and rejected cells of every text column, missing marks and dates included."""
    docs = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return (
        docs.select("doc_id", F.when(text.valid_cell("line"), 1).otherwise(0).alias("ok"))
        .groupBy("doc_id")
        .agg(F.sum("ok").alias("valid"), F.sum(1 - F.col("ok")).alias("rejected"))
    )


VALID_CELLS_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line FROM documents)
SELECT doc_id, sum(CASE WHEN {valid_sql('line')} THEN 1 ELSE 0 END)::BIGINT AS valid,
sum(CASE WHEN {valid_sql('line')} THEN 0 ELSE 1 END)::BIGINT AS rejected FROM l GROUP BY doc_id"""


def valid_relations(spark, d):
    """Rows and columns of the relations large enough to be embedded."""
    out = None
    for name, df in prep.valid_relations(repository(spark, d, EVERYTHING)).items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("relation"), "rows", F.lit(len(df.columns)).alias("cols")
        )
        out = row if out is None else out.unionByName(row)
    return out


VALID_RELATIONS_SQL = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS relation, count(*) AS rows, {len(COLUMNS[n])} AS cols FROM {n}" for n in EVERYTHING
) + ") WHERE rows > 15 AND cols > 2"


def category_codes(spark, d):
    parts = read(spark, d, "part")
    return prep.category_codes(parts.select("p_partkey", "p_type"), "p_type").select("p_partkey", "p_type", "code")


CATEGORY_SQL = """SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part"""


def one_hot(spark, d):
    return prep.one_hot(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


ONE_HOT_SQL = """SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS "o_orderstatus_F",
(o_orderstatus = 'O')::INTEGER AS "o_orderstatus_O", (o_orderstatus = 'P')::INTEGER AS "o_orderstatus_P" FROM orders"""


def date_digits(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy(text.date_digits(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


DATE_SQL = "SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS day, count(*) AS n FROM orders GROUP BY 1"


def code_category(spark, d):
    c = read(spark, d, "customer").select(text.code_category("c_name").alias("category"))
    s = read(spark, d, "supplier").select(text.code_category("s_name").alias("category"))
    return c.unionAll(s).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


CODE_SQL = """WITH v AS (SELECT c_name AS x FROM customer UNION ALL SELECT s_name FROM supplier)
SELECT regexp_replace(x, '[^A-Za-z]', '', 'g') || (regexp_replace(x, '[^0-9]', '', 'g')::HUGEINT % 3)::VARCHAR AS category,
count(*) AS n FROM v GROUP BY 1"""


def fill_zero(spark, d):
    """Left join leaves gaps that become zeros."""
    labels = read(spark, d, "labels")
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    return prep.fill_zero(docs.join(labels, "doc_id", "left")).select("doc_id", "n_chars", "quality", "toxic")


FILL_SQL = """SELECT doc_id, n_chars, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)"""


def split_target(spark, d):
    """Rows with a target, and how many columns each table keeps."""
    tables = {"documents": read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left"),
              "labels": read(spark, d, "labels")}
    parts = prep.split_target(tables, "documents", "quality")
    out = None
    for name in ("documents", "labels", "base_processed"):
        df = parts[name]
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("relation"), "rows", F.lit(len(df.columns)).alias("cols")
        )
        out = row if out is None else out.unionByName(row)
    return out


SPLIT_SQL = """WITH b AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL)
SELECT 'documents' AS relation, count(*) AS rows, 6 AS cols FROM b
UNION ALL SELECT 'labels', count(*), 2 FROM labels UNION ALL SELECT 'base_processed', count(*), 7 FROM b"""


def majority_share(spark, d):
    return prep.majority_share(read(spark, d, "customer"), "c_mktsegment").select(
        "majority", "total", F.round("share", 6).alias("share")
    )


MAJORITY_SQL = """SELECT max(n) AS majority, sum(n)::BIGINT AS total, round(max(n) / sum(n), 6) AS share
FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)"""

QUERIES = {
    "column_profile": (column_profile, COLUMN_PROFILE_SQL),
    "infer_strategies": (infer_strategies, INFER_SQL),
    "quantile_edges": (quantile_edges, QUANTILE_EDGES_SQL),
    "quantile_bins": (quantile_bins, QUANTILE_SQL),
    "offset_width_bins": (offset_width_bins, WIDTH_SQL),
    "quantized_tokens": (quantized_tokens, _quantized_sql()),
    "numeric_policies": (numeric_policies, NUMERIC_POLICIES_SQL),
    "valid_cells": (valid_cells, VALID_CELLS_SQL),
    "valid_relations": (valid_relations, VALID_RELATIONS_SQL),
    "category_codes": (category_codes, CATEGORY_SQL),
    "one_hot": (one_hot, ONE_HOT_SQL),
    "date_digits": (date_digits, DATE_SQL),
    "code_category": (code_category, CODE_SQL),
    "fill_zero": (fill_zero, FILL_SQL),
    "split_target": (split_target, SPLIT_SQL),
    "majority_share": (majority_share, MAJORITY_SQL),
}
