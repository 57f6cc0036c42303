"""Graphs, walks, vectors, vocabularies and corpora as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevec.sources.relations import with_row_index

BLANKS = r"\s+"


def write_edgelist(edges: DataFrame, path: str) -> None:
    """``x y weight`` lines."""
    edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in edges.columns])).write.text(path)


def read_edgelist(spark: SparkSession, path: str, weighted: bool = True) -> DataFrame:
    """(src, dst, weight) from blank-separated lines; a missing weight is 1."""
    parts = F.split(F.trim("value"), BLANKS)
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    weight = F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0)) if weighted else F.lit(1.0)
    return lines.select(F.col("p")[0].cast("bigint").alias("src"), F.col("p")[1].cast("bigint").alias("dst"), weight.alias("weight"))


def write_w2v_text(emb: DataFrame, path: str) -> None:
    """Header ``n d`` in the first part file, then ``token v1 .. vd`` lines."""
    body = emb.select(F.concat_ws(" ", F.col("token").cast("string"), F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value"))
    head = emb.agg(
        F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.coalesce(F.max(F.size("vec")), F.lit(0)).cast("string")).alias("value")
    )
    head.coalesce(1).unionByName(body).write.text(path)


def read_w2v_text(spark: SparkSession, path: str) -> DataFrame:
    """(token, vec) without the header line ``n d``, which may stand in any part file."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), BLANKS).alias("p")).where(F.size("p") > 1)
    longest, rows = lines.agg(F.max(F.size("p")), F.count(F.lit(1))).first()
    header = [str(rows - 1), str((longest or 2) - 1)]
    lines = lines.where(~F.col("p").eqNullSafe(F.array(*[F.lit(x) for x in header])))
    return lines.select(F.col("p")[0].alias("token"), F.expr("slice(p, 2, size(p) - 1)").cast("array<double>").alias("vec"))


def export_tsv(emb: DataFrame, dictionary: DataFrame, vectors_path: str, labels_path: str) -> None:
    """Vectors and their names as two tab-separated files in the same order."""
    named = emb.select("id", "vec").join(dictionary.select("id", "name"), "id")
    named.orderBy("id").select(F.array_join(F.col("vec").cast("array<string>"), "\t")).write.text(vectors_path)
    named.orderBy("id").select("name").write.text(labels_path)


def save_vectors(emb: DataFrame, dictionary: DataFrame, path: str) -> None:
    """``name v1 .. vd`` lines for id-keyed vectors."""
    named = emb.select("id", "vec").join(dictionary.select("id", "name"), "id")
    named.select(F.concat_ws("\t", "name", F.array_join(F.col("vec").cast("array<string>"), " "))).write.text(path)


def write_walks(walks: DataFrame, path: str) -> None:
    """One walk per line, ids separated by blanks."""
    walks.select(F.array_join(F.col("path").cast("array<string>"), " ")).write.text(path)


def read_walks(spark: SparkSession, path: str, max_len: int | None = None) -> DataFrame:
    """(path), cut to ``max_len`` nodes."""
    ids = F.split(F.trim("value"), BLANKS)
    kept = F.slice(ids, 1, max_len) if max_len else ids
    return spark.read.text(path).where(F.trim("value") != "").select(kept.cast("array<bigint>").alias("path"))


def read_community_labels(spark: SparkSession, path: str) -> DataFrame:
    """(node, label): line i lists the nodes that have label i."""
    lines = with_row_index(spark.read.text(path), "label")
    return lines.select(F.explode(F.split("value", r"\t")).alias("node"), "label").where(F.trim("node") != "").select(
        F.trim("node").cast("bigint").alias("node"), "label"
    )


def save_composed(composed: dict[str, DataFrame], folder: str) -> None:
    """Composed vector tables as parquet, one folder per flavour and relation."""
    for name, df in composed.items():
        df.write.partitionBy("flavour", "relation").parquet(f"{folder}/{name}")


def load_composed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("rel_vec", "col_vec", "row_vec")}


def write_corpus(documents: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Token lists as lines of text, sorted by ``order`` if given."""
    lines = documents.orderBy(*order) if order else documents
    lines.select(F.array_join("tokens", " ")).write.text(path)


def save_vocab(counts: DataFrame, path: str) -> None:
    """``word n`` lines, most frequent first."""
    counts.orderBy(F.desc("n"), "word").select("word", "n").write.options(sep=" ", quote='"', escape='"', emptyValue="").csv(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(sep=" ", quote='"', escape='"').schema("word string, n bigint").csv(path)
