"""Documents with ids that order them and tell them apart, whatever the id column holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.functions.ordering import number_rows
from tablevec.session import settle

NO_ID = -(1 << 63)


def known_ids(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, id, tie, text): ``id`` orders documents, nulls first; ``tie`` tells rows apart that share an id
    but not their text, 0 if there is one text."""
    rows = df.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    shared = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    texts = rows.join(shared, "id", "left_semi").select("id", F.xxhash64("text").alias("__h")).distinct()
    ties = settle(number_rows(texts, ["id"], ["id", "__h"], "tie").where("tie > 0"))  # all null ids may be one group
    # usually empty, which Spark sees from the written table and then broadcasts it
    return rows.withColumn("__h", F.xxhash64("text")).join(ties, ["id", "__h"], "left").select(
        "key", "id", F.coalesce("tie", F.lit(0).cast("long")).alias("tie"), "text"
    )
