"""Order-dependent building blocks that never put one whole group, or the whole table, in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevec.functions.names import column, quoted
from tablevec.session import settle


def range_bucket(value: str, cuts: list[float]) -> Column:
    """Number of ascending cut values <= a SQL number, by halving: a few compiled comparisons."""

    def literal(x: float) -> str:
        return f"{x!r}D" if math.isfinite(x) else f"CAST('{x}' AS DOUBLE)"

    def halve(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {value} < {literal(float(cuts[mid]))} THEN {halve(lo, mid)} ELSE {halve(mid + 1, hi)} END"

    return F.expr(halve(0, len(cuts)))


def number_rows(
    df: DataFrame,
    group: list[str],
    order: list[str],
    position: str = "pos",
    sums: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """0-based position in each group by ``order``, running sums before each row, group totals.

    Spark's own range partitioning by ``order`` deals the rows out, written once with the number of
    their range; ranges are numbered apart and shifted by the totals of the earlier ranges, so a group
    with a third of all rows is still many separate pieces of work. There are as many ranges as shuffle
    partitions (``parts`` if given), fewer if they would be small. ``order`` must be unique within a
    group; any type that sorts will do, nulls first and NaN last as Spark sorts them. Null groups count
    as a group. ``sums`` maps a new column to the column whose running total (before the row) it holds;
    ``totals`` maps a new column to the column summed over the group, or to ``*`` for its size.
    """
    sums, totals = sums or {}, totals or {}
    keys = [column(c) for c in order]
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    tagged = settle(ranged.withColumn("__b", F.spark_partition_id()))
    summed = sorted({*sums.values(), *totals.values()} - {"*"})
    same = [f"__g{i}" for i in range(len(group))]
    ranges = tagged.groupBy(*[column(g).alias(s) for g, s in zip(group, same, strict=True)], F.col("__b").alias("__piece")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(column(c)).alias("__t_" + c) for c in summed]
    )
    whole = Window.partitionBy(*(same or [F.lit(0)]))
    earlier = whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per group and range here
    shifts = ranges.select(
        *same,
        "__piece",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__s"),
        *[F.coalesce(F.sum(column("__t_" + c)).over(earlier), F.lit(0)).alias("__s_" + n) for n, c in sums.items()],
        *[F.sum("__n" if c == "*" else column("__t_" + c)).over(whole).alias(n) for n, c in totals.items()],
    )
    piece = Window.partitionBy(*[column(g) for g in group], "__b").orderBy(*keys)
    before = piece.rowsBetween(Window.unboundedPreceding, -1)
    columns = [column(c) for c in df.columns]
    local = tagged.select(
        *columns,
        "__b",
        (F.row_number().over(piece) - 1).alias("__r"),
        *[F.coalesce(F.sum(column(c)).over(before), F.lit(0)).alias("__l_" + n) for n, c in sums.items()],
    )
    met = F.col("__b") == F.col("__piece")
    for g, s in zip(group, same, strict=True):
        met = met & F.col(quoted(g)).eqNullSafe(F.col(s))
    return local.join(shifts, met).select(
        *columns,
        (F.col("__r") + F.col("__s")).cast("bigint").alias(position),
        *[(column("__l_" + n) + column("__s_" + n)).alias(n) for n in sums],
        *[column(n) for n in totals],
    )


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts each partition to ``k`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def hot_keys(df: DataFrame, on: list[str], share: int = 1000) -> DataFrame | None:
    """Keys that hold more than 1/``share`` of the rows (so less than ``share`` of them), or None.

    The keys are counted once, the counts written; the same at every size.
    """
    counts = settle(df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).scalar()
    keys = counts.where(F.col("__n") * share > F.lit(total)).select(*on)
    return keys if keys.head(1) else None


def join_on_hot(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``join_hot`` with the hot keys already looked up."""
    if hot is None:
        return left.join(right, on, how)
    few = F.broadcast(hot)
    hot_side = left.join(few, on, "left_semi").join(F.broadcast(right.join(few, on, "left_semi")), on, how)
    return hot_side.unionByName(left.join(few, on, "left_anti").join(right, on, how))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: int = 1000) -> DataFrame:
    """Join a settled table that may have hot keys to a table with one row per key.

    The hot keys (less than ``share`` by count) and their right-hand rows are broadcast, so
    hot rows are never shuffled; all other keys go through a plain join.
    """
    return join_on_hot(left, right, on, hot_keys(left, on, share), how)


def percentiles(df: DataFrame, group: list[str], value: str, probs: list[float], parts: int | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles per group: (group..., prob, edge); nulls and NaN don't count.

    Equal values are counted first, then the counts get running totals by value range; only
    the rows that hold a wanted rank remain. No group is ever sorted or held in one task.
    """
    rows = df.select(*group, column(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    counts = rows.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = number_rows(counts, group, ["__v"], "__pos", {"__before": "__c"}, {"__size": "__c"}, parts)
    end = F.col("__before") + F.col("__c")

    def holds(spot):
        return (F.col("__before") <= spot) & (spot < end)

    def height(p):
        return p * (F.col("__size") - 1)

    wanted = F.filter(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: holds(F.floor(height(p))) | holds(F.ceil(height(p))),
    )
    spots = ranked.withColumn("prob", F.explode(wanted)).withColumn("__h", height(F.col("prob")))
    lo, hi = F.floor("__h"), F.ceil("__h")
    return (
        spots.groupBy(*group, "prob")
        .agg(
            F.max(F.when(holds(lo), F.col("__v"))).alias("__lo"),
            F.max(F.when(holds(hi), F.col("__v"))).alias("__hi"),
            F.max(F.col("__h") - lo).alias("__f"),
        )
        .select(*group, "prob", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("edge"))
    )
