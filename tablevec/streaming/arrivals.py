"""Rows that arrive as files, cleaned and cut into tokens as they come.

Cleaning and tokenizing look at one row at a time, so the batch operators run on a stream as
they are; the graph and the vectors need full token counts and are built from the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablevec.operators.textify import row_tokens
from tablevec.sources.relations import ENCODING


def arriving_csv(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A relation whose CSV files arrive in ``folder``."""
    return (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("encoding", ENCODING)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )


def write_tokens(stream: DataFrame, relation: str, row_id, out: str, checkpoint: str, strategies: dict | None = None):
    """Starts a query that appends the tokens of arriving rows to parquet and ends when all is read."""
    tokens = row_tokens(stream, relation, row_id, strategies)
    return (
        tokens.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
