"""Queries: the given tables written in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablevec.functions import vectors as vec
from tablevec.operators import compose, prep, textify, train, walks
from tablevec.plans import compose_queries, graph_queries, prep_queries
from tablevec.plans.tables import COLUMNS, read, repository, row_ids
from tablevec.session import shared_dir
from tablevec.sources import relations, vectors
from tablevec.streaming import arrivals


def _place(spark) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


CSV_TABLES = ("region", "nation", "supplier", "customer", "part", "orders")


def relations_from_csv(spark, d):
    """Tables written as CSV, found again as a folder of relations, counted."""
    folder = _place(spark)
    relations.write_relations(repository(spark, d, CSV_TABLES), folder)
    out = None
    for name in CSV_TABLES:
        found = relations.read_relations(spark, f"{folder}/{name}.csv")
        for df in found.values():
            row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(COLUMNS[name][0][0]).cast("bigint")).alias("keys")).withColumn("relation", F.lit(name))
            out = row if out is None else out.unionByName(row)
    return out.groupBy("relation").agg(F.sum("rows").alias("rows"), F.sum("keys").alias("keys"))


CSV_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS relation, count(*) AS rows, sum({COLUMNS[n][0][0]})::BIGINT AS keys FROM {n}" for n in CSV_TABLES
)


def row_index(spark, d):
    """Rows numbered in reading order: every number once, checked by sums."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey")
    numbered = relations.with_row_index(lines)
    return numbered.agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"),
        F.sum("row_idx").alias("total"), F.count_distinct("row_idx").alias("distinct"),
    )


INDEX_SQL = """SELECT count(*) AS rows, 0::BIGINT AS first, count(*) - 1 AS last, (count(*) * (count(*) - 1) // 2)::BIGINT AS total, count(*) AS "distinct" FROM lineitem"""


def edgelist_files(spark, d):
    edges, _ = graph_queries._graph(spark, d)
    path = _place(spark)
    vectors.write_edgelist(edges, path)
    return vectors.read_edgelist(spark, path).select("src", "dst", F.round("weight", 9).alias("weight"))


def w2v_text_files(spark, d):
    path = _place(spark)
    table = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("token"), vec.doubles("embedding").alias("vec"))
    vectors.write_w2v_text(table, path)
    back = vectors.read_w2v_text(spark, path)
    return back.select("token", F.size("vec").alias("dim"), F.round(vec.norm("vec"), 6).alias("norm"), F.round(F.col("vec")[63], 6).alias("last"))


W2V_SQL = """SELECT vec_id::VARCHAR AS token, len(embedding)::INTEGER AS dim, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
round(embedding[64]::DOUBLE, 6) AS last FROM embeddings"""


def tsv_export(spark, d):
    """Labels of exported vectors in file order, with the vector lines beside them."""
    table = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vec.doubles("embedding").alias("vec"))
    names = table.select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    a, b = _place(spark), _place(spark)
    vectors.export_tsv(table, names, a, b)
    lines = relations.with_row_index(spark.read.text(a)).select("row_idx", F.size(F.split("value", "\t")).alias("dim"))
    labels = relations.with_row_index(spark.read.text(b)).select("row_idx", F.col("value").alias("name"))
    return labels.join(lines, "row_idx").select(F.col("row_idx").alias("place"), "name", "dim")


TSV_SQL = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, 'n' || vec_id::VARCHAR AS name, len(embedding)::INTEGER AS dim FROM embeddings"


def named_vectors(spark, d):
    table = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vec.doubles("embedding").alias("vec"))
    names = table.select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    path = _place(spark)
    vectors.save_vectors(table, names, path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("name"), F.size(F.split(parts[1], " ")).alias("dim"))


NAMED_SQL = "SELECT 'n' || vec_id::VARCHAR AS name, len(embedding)::INTEGER AS dim FROM embeddings"


def walk_files(spark, d):
    """Walks written, read back cut to five nodes, counted by path."""
    edges, _ = graph_queries._graph(spark, d)
    path = _place(spark)
    vectors.write_walks(walks.random_walks(edges, graph_queries.WALKS, graph_queries.LENGTH, seed=graph_queries.SEED), path)
    back = vectors.read_walks(spark, path, 5)
    return back.select(F.array_join(F.col("path").cast("array<string>"), " ").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


WALK_SQL = f"""WITH RECURSIVE {graph_queries.GRAPH}, {graph_queries.UNIFORM_WALKS}
SELECT array_to_string(path[1:5], ' ') AS path, count(*) AS n FROM w WHERE step = {graph_queries.LENGTH} GROUP BY 1"""


def community_labels(spark, d):
    """A line of two nodes per labelled document, read back as (node, line number) pairs."""
    path = _place(spark)
    rows = read(spark, d, "labels")
    nodes = [(10 + F.col("quality")).cast("string"), (20 + F.col("toxic")).cast("string")]
    rows.orderBy("doc_id").select(F.concat_ws("\t", *nodes).alias("value")).write.text(path)
    return vectors.read_community_labels(spark, path)


COMMUNITY_SQL = """WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS label, quality, toxic FROM labels)
SELECT (10 + quality)::BIGINT AS node, label FROM l UNION ALL SELECT (20 + toxic)::BIGINT, label FROM l"""


def strategy_files(spark, d):
    path = _place(spark)
    relations.write_strategies(prep_queries.infer_strategies(spark, d), path)
    return relations.read_strategies(spark, path)


def composed_files(spark, d):
    """Composed vectors saved by flavour and relation, and one flavour read back."""
    toks = compose_queries._tokens(spark, d)
    made = compose.compose_repository(toks, compose_queries.token_vectors(spark, d, toks), compose_queries.token_vectors(spark, d, toks, "col"))
    folder = _place(spark)
    vectors.save_composed(made, folder)
    back = vectors.load_composed(spark, folder)["col_vec"].where("flavour = 'row'")
    return compose_queries._shown(back, "relation", "col")


def corpus_files(spark, d):
    """Row documents written as text lines, counted by line."""
    names = ("region", "nation", "customer")
    docs = textify.row_documents(textify.repository_lists(repository(spark, d, names), row_ids(names)))
    path = _place(spark)
    vectors.write_corpus(docs, path, ["relation", "row_id"])
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


CORPUS_SQL = f"""SELECT line, count(*) AS n FROM (SELECT relation, row_id, string_agg(token, ' ' ORDER BY pos, tpos) AS line
FROM ({compose_queries.tokens_sql(("region", "nation", "customer"))}) GROUP BY ALL) GROUP BY line"""


def vocab_files(spark, d):
    path = _place(spark)
    words = train.positions(train.sentences(read(spark, d, "conversations"), "conv_id", "text"))
    vectors.save_vocab(train.vocab_counts(words, 2), path)
    return vectors.read_vocab(spark, path)


VOCAB_SQL = """SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) AS word FROM conversations)
WHERE word <> '' GROUP BY word HAVING count(*) >= 2"""


def streamed_tokens(spark, d):
    """Customers arriving as CSV files, tokenized by a stream."""
    folder, out, marks = _place(spark), _place(spark), _place(spark)
    customer = read(spark, d, "customer")
    customer.write.option("header", True).option("encoding", relations.ENCODING).csv(folder)
    stream = arrivals.arriving_csv(spark, folder, customer.schema)
    arrivals.write_tokens(stream, "customer", F.col("c_custkey"), out, marks).awaitTermination()
    return spark.read.parquet(out).groupBy("col", "token").agg(F.count(F.lit(1)).alias("n"))


STREAM_SQL = f"SELECT col, token, count(*) AS n FROM ({compose_queries.tokens_sql(('customer',))}) GROUP BY ALL"


def noisy_columns(spark, d):
    """A table with added noise columns: values inside [0, 1)."""
    noisy = prep.inject_noise(read(spark, d, "customer").select("c_custkey"), 5, 1)
    flags = [(F.col(f"`features {i}`") >= 0) & (F.col(f"`features {i}`") < 1) for i in range(5)]
    return noisy.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f.cast("int")).alias(f"inside{i}") for i, f in enumerate(flags)])


NOISY_SQL = "SELECT count(*) AS rows, " + ", ".join(f"count(*) AS inside{i}" for i in range(5)) + " FROM customer"

QUERIES = {
    "relations_from_csv": (relations_from_csv, CSV_SQL),
    "row_index": (row_index, INDEX_SQL),
    "edgelist_files": (edgelist_files, f"WITH {graph_queries.GRAPH} SELECT src, dst, round(weight, 9) AS weight FROM und"),
    "w2v_text_files": (w2v_text_files, W2V_SQL),
    "tsv_export": (tsv_export, TSV_SQL),
    "named_vectors": (named_vectors, NAMED_SQL),
    "walk_files": (walk_files, WALK_SQL),
    "community_labels": (community_labels, COMMUNITY_SQL),
    "strategy_files": (strategy_files, prep_queries.INFER_SQL),
    "composed_files": (composed_files, f"WITH {compose_queries.BASE}, {compose_queries.COLS} {compose_queries._shown_sql(compose_queries.LARGE_COLS, 'relation, col')}"),
    "corpus_files": (corpus_files, CORPUS_SQL),
    "vocab_files": (vocab_files, VOCAB_SQL),
    "streamed_tokens": (streamed_tokens, STREAM_SQL),
    "noisy_columns": (noisy_columns, NOISY_SQL),
}
