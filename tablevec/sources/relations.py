"""Relations in and out: CSV folders, databases, row numbers, strategies, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablevec.session import settle

# Helper files that are no relations, the encoding of relation files, the sample's items and prices.
HELPER_FILES = (".DS_Store", "base_processed.csv")
ENCODING = "ISO-8859-1"
SAMPLE_ITEMS = [("macbook", 1000), ("book", 200), ("iphone", 500)]


def list_relations(spark: SparkSession, folder: str) -> dict[str, str]:
    """File name -> path; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    paths = sorted(r.path for r in files.collect())
    names = {p.rsplit("/", 1)[-1]: p for p in paths}
    return {n: p for n, p in names.items() if n not in HELPER_FILES}


def read_relation(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One CSV with a header; without a schema the types are inferred, which reads the file once more."""
    reader = spark.read.option("header", True).option("encoding", ENCODING)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_relations(spark: SparkSession, folder: str, schemas: dict | None = None) -> dict[str, DataFrame]:
    """Relation name (file name without ending) -> table, for every CSV of a folder."""
    schemas = schemas or {}
    out = {}
    for name, path in list_relations(spark, folder).items():
        key = name.rsplit(".", 1)[0]
        out[key] = read_relation(spark, path, schemas.get(key))
    return out


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in file order: by file name, then by place in the file.

    ``df`` comes straight from files. Each file split numbers its own rows; the sizes of the
    splits (one row per split) give the offsets. Nothing is sorted.
    """
    block = ["__file", "__start"]
    local = settle(
        df.select(
            *df.columns,
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__start"),
            F.monotonically_increasing_id().alias("__m"),
        )
    )
    sizes = local.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    before = Window.partitionBy(F.lit(0)).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*block, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return local.join(offsets, block).select(
        *df.columns, (F.col("__m") - F.col("__first") + F.col("__o")).alias(name)
    )


def read_database(
    spark: SparkSession,
    url: str,
    tables: list[str] | None = None,
    schema: str | None = None,
    partition: dict[str, tuple[str, int, int, int]] | None = None,
    **options,
) -> dict[str, DataFrame]:
    """Table name -> table over JDBC; needs the database's driver on the class path.

    ``partition`` gives (column, low, high, pieces) for tables that should be read in pieces.
    """
    base = spark.read.format("jdbc").option("url", url).options(**options)
    if tables is None:
        listing = "(SELECT table_name FROM information_schema.tables" + (f" WHERE table_schema = '{schema}'" if schema else "") + ") t"
        tables = [r[0] for r in base.option("dbtable", listing).load().collect()]
    out = {}
    for name in tables:
        reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", name)
        if partition and name in partition:
            column, low, high, pieces = partition[name]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=pieces)
        out[name] = reader.load()
    return out


def write_relations(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a CSV folder with headers."""
    for name, df in tables.items():
        df.write.option("header", True).option("encoding", ENCODING).csv(f"{folder}/{name}.csv")


def write_strategies(strategies: DataFrame, path: str) -> None:
    """(relation, col, int_strategy, grain) as JSON lines {relation: {col: {int, grain}}}."""
    entry = F.struct("col", F.struct(F.col("int_strategy").alias("int"), "grain").alias("s"))
    per_table = strategies.groupBy("relation").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("cols"))
    per_table.select(F.to_json(F.create_map("relation", "cols")).alias("value")).write.text(path)


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    """(relation, col, int_strategy, grain) from such JSON, also from one file with all relations."""
    nested = "map<string, map<string, struct<int: string, grain: string>>>"
    text = spark.read.text(path, wholetext=False)
    tables = text.select(F.explode(F.from_json("value", nested)).alias("relation", "cols"))
    return tables.select("relation", F.explode("cols").alias("col", "s")).select(
        "relation", "col", F.col("s.int").alias("int_strategy"), F.col("s.grain").alias("grain")
    )


def generate_sample(spark: SparkSession, k: int = 1) -> dict[str, DataFrame]:
    """Three linked tables with three known kinds of rows: base and trans (1000k rows) and price."""
    ids = spark.range(1000 * k).select(F.col("id"), (F.col("id") % 3).cast("int").alias("kind"))
    name = F.concat(F.lit("type"), (F.col("kind") + 1).cast("string"), F.lit("_"), F.col("id").cast("string"))
    money = F.element_at(F.array(*[F.lit(p) for _, p in SAMPLE_ITEMS]), F.col("kind") + 1)
    item = F.element_at(F.array(*[F.lit(i) for i, _ in SAMPLE_ITEMS]), F.col("kind") + 1)
    return {
        "base": ids.select("id", name.alias("name"), money.alias("money")),
        "price": spark.createDataFrame(SAMPLE_ITEMS, "item string, price int"),
        "trans": ids.select(name.alias("name"), item.alias("item")),
    }
