"""Preparing relations: target split, column profile, strategies, binning, coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevec.functions import ordering
from tablevec.functions.names import column as named, literal, quoted
from tablevec.session import settle

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)

# Rules that choose a strategy, and binning limits.
SKEW_LIMIT = 2.0
RANGE_FACTOR = 5
LONG_TEXT_WORDS = 10
MIN_ROWS, MIN_COLS = 15, 2
BINS = 10


def column_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGRAL):
        return "int"
    return "float" if isinstance(dtype, FRACTIONAL) else "str"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: column_kind(f.dataType) for f in df.schema.fields}


def split_target(tables: dict[str, DataFrame], base: str, target: str) -> dict[str, DataFrame]:
    """Rows of ``base`` without a target go; the result has the full base as ``base_processed``
    and every table without the target column."""
    full = tables[base].where(named(target).isNotNull())
    out = {name: (full if name == base else df).drop(target) for name, df in tables.items()}
    out["base_processed"] = full
    return out


def is_valid_relation(df: DataFrame) -> bool:
    """More than 15 rows and more than 2 columns; reads at most 16 rows."""
    return len(df.columns) > MIN_COLS and len(df.select(F.lit(1)).head(MIN_ROWS + 1)) > MIN_ROWS


def valid_relations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: df for name, df in tables.items() if is_valid_relation(df)}


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, x): the values of numeric columns, one row each; nulls and NaN are missing."""
    kind = kinds(df)
    names = columns or [c for c in df.columns if kind[c] != "str"]
    entries = [f"named_struct('col', {literal(c)}, 'x', CAST({quoted(c)} AS DOUBLE))" for c in names]
    return df.selectExpr(f"inline(array({', '.join(entries)}))").where("x IS NOT NULL AND NOT isnan(x)")


def word_count(c) -> Column:
    return F.char_length(named(c)) - F.char_length(F.replace(named(c), F.lit(" "), F.lit(""))) + 1


def _stats(df: DataFrame) -> DataFrame:
    """One wide aggregate over one scan, then one row per column."""
    kind = kinds(df)
    aggs, entries = [], []
    for i, c in enumerate(df.columns):
        aggs.append(F.count(named(c)).alias(f"n{i}"))
        fields = [F.lit(c).alias("col"), F.lit(kind[c]).alias("kind"), F.col(f"n{i}").alias("non_null")]
        if kind[c] == "str":
            fields += [F.lit(None).cast("double").alias(f) for f in ("min", "max", "skew")]
        else:
            x = F.nanvl(named(c).cast("double"), F.lit(None).cast("double"))
            aggs += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), F.skewness(x).alias(f"s{i}")]
            n = F.col(f"n{i}")
            adjusted = F.when(n > 2, F.col(f"s{i}") * F.sqrt(n * (n - 1)) / (n - 2))
            fields += [F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"), adjusted.alias("skew")]
        entries.append(F.struct(*fields))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def _distinct_counts(df: DataFrame) -> DataFrame:
    """(col, distinct): repeated values collapse before the shuffle; long text travels as a digest."""
    entries = []
    for c in df.columns:
        value = named(c).cast("string")
        entries.append(
            F.struct(F.lit(c).alias("col"), F.when(F.char_length(value) > 64, F.md5(value)).otherwise(value).alias("v"))
        )
    values = df.select(F.inline(F.array(*entries))).where(F.col("v").isNotNull())
    return values.distinct().groupBy("col").agg(F.count(F.lit(1)).alias("distinct"))


def _median_words(df: DataFrame) -> DataFrame:
    """(col, median_words) of text columns, from a count per number of words."""
    entries = [F.struct(F.lit(c).alias("col"), word_count(c).alias("w")) for c, t in df.dtypes if t == "string"]
    if not entries:
        return df.sparkSession.createDataFrame([], "col string, median_words double")
    counts = (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("w").isNotNull())
        .groupBy("col", "w")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return counts.groupBy("col").agg(F.percentile("w", F.lit(0.5), F.col("c")).alias("median_words"))


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: kind, non-null and distinct count, min, max, bias-adjusted skew, median words."""
    return (
        _stats(df)
        .join(_distinct_counts(df), "col", "left")
        .join(_median_words(df), "col", "left")
        .select(
            "col", "kind", "non_null", F.coalesce("distinct", F.lit(0)).alias("distinct"),
            "min", "max", "skew", "median_words",
        )
    )


def infer_strategies(profile: DataFrame) -> DataFrame:
    """(col, int_strategy, grain) from a profile; with its ``relation`` if it has one."""
    by_skew = F.when(F.abs("skew") >= SKEW_LIMIT, "eqw_quantize").otherwise("eqh_quantize")
    is_id = F.contains(F.col("col"), F.lit("id"))
    wide = F.col("max") - F.col("min") >= RANGE_FACTOR * F.col("non_null")
    strategy = (
        F.when((F.col("kind") == "float") & ~is_id, by_skew)
        .when((F.col("kind") == "int") & wide, by_skew)
        .otherwise("augment")
    )
    grain = F.when(
        (F.col("kind") == "str") & (F.col("median_words") >= LONG_TEXT_WORDS), "token"
    ).otherwise("cell")
    keys = [c for c in ("relation", "col") if c in profile.columns]
    return profile.select(*keys, strategy.alias("int_strategy"), grain.alias("grain"))


def strategy_map(strategies: DataFrame) -> dict[str, tuple[str, str]]:
    """Strategies of one relation on the driver: one row per column."""
    return {r.col: (r.int_strategy, r.grain) for r in strategies.collect()}


def quantile_edges(values: DataFrame, bins: int = BINS) -> DataFrame:
    """(col, edges): equal-depth edges, exact percentiles 0, 1/n .. (n-1)/n of ``x``."""
    probs = [i / bins for i in range(bins)]
    points = ordering.percentiles(values, ["col"], "x", probs)
    # `bins` rows per column
    return points.groupBy("col").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def offset_width_edges(values: DataFrame, bins: int = BINS) -> DataFrame:
    """(col, edges): equal-width steps of (max - min) / n that start at 0."""
    span = F.max("x") - F.min("x")
    return (
        values.groupBy("col")
        .agg(span.alias("span"))
        .select("col", F.array(*[F.col("span") * i / bins for i in range(bins)]).alias("edges"))
    )


def bin_of(x, edges) -> Column:
    """Number of edges <= x; a null stays null."""
    value = x if isinstance(x, Column) else F.col(x)
    e = edges if isinstance(edges, Column) else F.col(edges)
    return F.when(value.isNotNull(), F.size(F.filter(e, lambda b: b <= value)))


def quantize(df: DataFrame, strategies: dict[str, tuple[str, str]], bins: int = BINS) -> DataFrame:
    """Numeric columns that ask for it replaced by bin numbers; tables under 2n rows stay as they are.

    The edges (``bins`` numbers per column) go into the projection as constants.
    """
    kind = kinds(df)
    numeric = [c for c in df.columns if kind[c] != "str"]
    deep = [c for c in numeric if strategies.get(c, ("", ""))[0] == "eqw_quantize"]
    wide = [c for c in numeric if strategies.get(c, ("", ""))[0] == "eqh_quantize"]
    if not deep and not wide:
        return df
    if len(df.select(F.lit(1)).head(2 * bins)) < 2 * bins:
        return df
    edges = {}
    if deep:
        edges |= {r.col: r.edges for r in quantile_edges(long_values(df, deep), bins).collect()}
    if wide:
        edges |= {r.col: r.edges for r in offset_width_edges(long_values(df, wide), bins).collect()}
    return df.select(
        *[
            F.when(named(c).isNotNull() & ~F.isnan(named(c).cast("double")), ordering.range_bucket(f"CAST({quoted(c)} AS DOUBLE)", edges[c])).alias(c)
            if edges.get(c)
            else named(c)
            for c in df.columns
        ]
    )


def category_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Sorted distinct values numbered from 0; null is -1."""
    key = "__value"
    distinct = df.select(named(column).alias(key)).where(F.col(key).isNotNull()).distinct()
    codes = settle(ordering.number_rows(distinct, [], [key], name))
    joined = ordering.join_hot(df.withColumn(key, named(column)), codes, [key], "left")
    return joined.withColumn(name, F.coalesce(named(name), F.lit(-1)).cast("bigint")).drop(key)


def one_hot(df: DataFrame, column: str, values: list | None = None, limit: int = 1000) -> DataFrame:
    """A 0/1 column per value; the values are the distinct ones unless given.

    A table can't have a column for each of very many values: above ``limit`` take ``one_hot_vectors``.
    """
    if values is None:
        values = [r[0] for r in df.select(named(column)).where(named(column).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(values) > limit:
            raise ValueError(f"{column} has over {limit} values; use one_hot_vectors")
    flags = [
        F.coalesce((named(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}")
        for v in sorted(values)
    ]
    return df.select(*[named(c) for c in df.columns if c != column], *flags)


def one_hot_vectors(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    """A sparse 0/1 vector (position of the one, its length) for any number of values; null has no one."""
    coded = category_codes(df, column, "__code")
    size = F.lit(df.where(named(column).isNotNull()).agg(F.count_distinct(named(column))).scalar())
    at = F.when(F.col("__code") >= 0, F.array("__code")).otherwise(F.array().cast("array<bigint>"))
    return coded.withColumn(name, F.struct(size.alias("size"), at.alias("ones"))).drop("__code")


def fill_zero(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def inject_noise(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` extra uniform columns named ``features i``."""
    return df.select("*", *[F.rand(seed + i).alias(f"features {i}") for i in range(n)])


def majority_share(df: DataFrame, column: str) -> DataFrame:
    """Share of the most frequent value: the floor any classifier has to beat."""
    counts = df.groupBy(named(column)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.max("n").alias("majority"), F.sum("n").alias("total"), (F.max("n") / F.sum("n")).alias("share")
    )
