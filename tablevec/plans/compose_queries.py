"""Queries: composed vectors, ranking quality, question answering, join baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablevec.functions import vectors
from tablevec.functions.draws import draw
from tablevec.operators import analyze, compose, evaluate, neighbours, rank, textify
from tablevec.plans.tables import DIMENSIONS, read, repository, row_ids, tokens_sql
from tablevec.plans.vector_queries import MEANS, SIMS, emb, knn_sql, labelled
from tablevec.session import settle

SHOWN = (0, 1, 31, 63)


def _tokens(spark, d, names=DIMENSIONS):
    return settle(textify.repository_tokens(repository(spark, d, names), row_ids(names)))


def token_vectors(spark, d, tokens, seed="row"):
    """(token, vec): each token takes the embedding that an md5 of its text points at."""
    base = emb(spark, d)
    n = base.count()
    # texts are few bytes and would be read by one task, which then writes all their vectors
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = tokens.select("token").distinct().withColumn("id", draw(seed, "token") % n)
    return settle(drawn.repartition(parts, "id").join(base, "id").select("token", "vec"))


def _shown(df, *keys):
    return df.select(*keys, *[F.round(F.col("vec")[i], 6).alias(f"v{i}") for i in SHOWN], F.round(vectors.norm("vec"), 6).alias("norm"))


def token_vectors_sql(tok="tok", seed="row", name="tv") -> str:
    return f"""{name} AS MATERIALIZED (SELECT token, vec FROM (SELECT token, ('0x' || substr(md5(concat_ws('|', '{seed}', token)), 1, 8))::BIGINT % (SELECT count(*) FROM e) AS id
FROM (SELECT DISTINCT token FROM {tok})) JOIN e USING (id))"""


E_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
BASE = f"""{E_SQL}, tok AS MATERIALIZED ({tokens_sql(DIMENSIONS)}), {token_vectors_sql()}"""


def _mean_sql(source: str, keys: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT {keys}, list(m ORDER BY i) AS vec FROM (SELECT {keys}, u.i, avg(vec[u.i]) AS m FROM {source}, range(1, 65) AS u(i) GROUP BY ALL) GROUP BY {keys})"""


def _shown_sql(source: str, keys: str) -> str:
    cols = ", ".join(f"round(vec[{i + 1}], 6) AS v{i}" for i in SHOWN)
    return f"SELECT {keys}, {cols}, round(sqrt(list_inner_product(vec, vec)), 6) AS norm FROM {source}"


def compose_columns(spark, d):
    toks = _tokens(spark, d)
    return _shown(compose.compose_columns(toks, token_vectors(spark, d, toks)), "relation", "col")


COLS = _mean_sql("(SELECT relation, col, vec FROM tok JOIN tv USING (token))", "relation, col", "cols")


def vectors_for(spark, d):
    """Vectors of cells, columns and relations looked up by name."""
    toks = _tokens(spark, d)
    vecs = token_vectors(spark, d, toks)
    cols = settle(compose.compose_columns(toks, vecs))
    cells = rank.vectors_for(toks.where("col = 'p_name'").select("token").distinct(), vecs, ["token"])
    named = cells.withColumnRenamed("token", "name").withColumn("kind", F.lit("cell"))
    wanted = rank.vectors_for(toks.where("relation = 'part'").select("relation", "col").distinct(), cols, ["relation", "col"])
    named = named.unionByName(wanted.select(F.col("col").alias("name"), "vec").withColumn("kind", F.lit("column")))
    rels = compose.compose_relations(cols)
    return _shown(named.unionByName(rels.select(F.col("relation").alias("name"), "vec").withColumn("kind", F.lit("relation"))), "kind", "name")


def compose_relations(spark, d):
    toks = _tokens(spark, d)
    return _shown(compose.compose_relations(compose.compose_columns(toks, token_vectors(spark, d, toks))), "relation")


RELS = _mean_sql("cols", "relation", "rels")


def compose_rows(spark, d):
    toks = _tokens(spark, d)
    return _shown(compose.compose_rows(toks, token_vectors(spark, d, toks)), "relation", "row_id")


ROWS = _mean_sql("(SELECT relation, row_id, vec FROM tok JOIN tv USING (token))", "relation, row_id", "rws")


def compose_columns_unique(spark, d):
    toks = _tokens(spark, d)
    return _shown(compose.compose_columns_unique(toks, token_vectors(spark, d, toks)), "relation", "col")


UNIQUE = _mean_sql("(SELECT relation, col, vec FROM (SELECT DISTINCT relation, col, token FROM tok) JOIN tv USING (token))", "relation, col", "cols")


def compose_repository(spark, d):
    """Both flavours of column, relation and row vectors; the column flavour has its own token vectors."""
    toks = _tokens(spark, d)
    made = compose.compose_repository(toks, token_vectors(spark, d, toks), token_vectors(spark, d, toks, "col"))
    keys = ("flavour", "relation", "col", "row_id")
    out = None
    for df in made.values():
        part = _shown(df.withColumns({k: F.lit("") for k in keys if k not in df.columns}), *keys)
        out = part if out is None else out.unionByName(part)
    return out


def _large(name: str) -> str:
    """Relations with more than 15 rows and 2 columns."""
    return (
        f"(SELECT * FROM {name} WHERE relation IN (SELECT relation FROM tok GROUP BY relation "
        "HAVING count(DISTINCT row_id) > 15 AND count(DISTINCT col) > 2))"
    )


LARGE_COLS = _large("cols")
REPO_SQL = f"""WITH {BASE}, {token_vectors_sql(seed='col', name='tc')}, {COLS}, {RELS}, {ROWS},
{_mean_sql("(SELECT relation, col, vec FROM tok JOIN tc USING (token))", "relation, col", "ccols")}, {_mean_sql("ccols", "relation", "crels")},
{_mean_sql("(SELECT relation, row_id, vec FROM tok JOIN tc USING (token))", "relation, row_id", "crws")}
""" + "\nUNION ALL ".join(
    _shown_sql(_large(name), f"'{flavour}' AS flavour, relation, {keys}")
    for flavour, name, keys in (
        ("row", "cols", "col, '' AS row_id"), ("col", "ccols", "col, '' AS row_id"), ("row", "rels", "'' AS col, '' AS row_id"),
        ("col", "crels", "'' AS col, '' AS row_id"), ("row", "rws", "'' AS col, row_id"), ("col", "crws", "'' AS col, row_id"),
    )
)


def _hubness(spark, d, toks):
    """(token, hubness): the hubness of the embedding a token points at."""
    base = emb(spark, d)
    n = base.count()
    hub = settle(analyze.hubness(base))
    return settle(toks.select("token").distinct().withColumn("id", draw("row", "token") % n).join(hub, "id").select("token", "hubness"))


def compose_no_hubs(spark, d):
    toks = _tokens(spark, d)
    kept = settle(compose.without_hubs(toks, _hubness(spark, d, toks), 0.7))
    vecs = token_vectors(spark, d, toks)
    rows = _shown(compose.compose_rows(kept, vecs).withColumn("col", F.lit("")), "relation", "row_id", "col")
    cols = compose.compose_columns(kept, vecs).withColumn("row_id", F.lit(""))
    return rows.unionByName(_shown(cols, "relation", "row_id", "col"))


NO_HUBS_SQL = f"""WITH {SIMS}, {knn_sql()}, occ AS (SELECT id, count(*) AS n FROM knn GROUP BY id),
tok0 AS MATERIALIZED ({tokens_sql(DIMENSIONS)}), {token_vectors_sql('tok0')},
th AS MATERIALIZED (SELECT token, coalesce(n, 0) / 20.0 AS h FROM (SELECT token, ('0x' || substr(md5(concat_ws('|', 'row', token)), 1, 8))::BIGINT % (SELECT count(*) FROM e) AS id FROM (SELECT DISTINCT token FROM tok0)) LEFT JOIN occ USING (id)),
tok AS MATERIALIZED (SELECT tok0.* FROM tok0 JOIN th USING (token) WHERE h < 0.7), {ROWS}, {COLS}
{_shown_sql("rws", "relation, row_id, '' AS col")} UNION ALL {_shown_sql("cols", "relation, '' AS row_id, col")}"""


def missing_tokens(spark, d):
    """Tokens of the repository that the vocabulary of the small tables does not have."""
    known = _tokens(spark, d, ("region", "nation", "supplier")).select("token").distinct()
    return compose.missing_tokens(_tokens(spark, d), known)


MISSING_SQL = f"""WITH tok AS ({tokens_sql(DIMENSIONS)}), known AS (SELECT DISTINCT token FROM ({tokens_sql(("region", "nation", "supplier"))}))
SELECT relation, col, count(*) AS missing FROM tok WHERE token NOT IN (SELECT token FROM known) GROUP BY ALL"""


def row_features(spark, d):
    """Customers with the vector of their nation's row; one without would get zeros."""
    toks = _tokens(spark, d, ("customer", "region", "nation"))
    rows = compose.compose_rows(toks, token_vectors(spark, d, toks)).where("relation = 'nation'")
    base = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("row_id"))
    return _shown(compose.row_features(base, settle(rows.where(F.col("vec").isNotNull())), ["row_id"]), "c_custkey")


FEATURES_SQL = f"""WITH {E_SQL}, tok AS MATERIALIZED ({tokens_sql(("customer", "region", "nation"))}), {token_vectors_sql()}, {ROWS},
f AS (SELECT c_custkey, coalesce(vec, [0.0::DOUBLE FOR i IN range(0, 64)]) AS vec FROM customer LEFT JOIN rws ON relation = 'nation' AND row_id = c_nationkey::VARCHAR)
{_shown_sql("f", "c_custkey")}"""


def combine_vectors(spark, d):
    return _shown(compose.combine(labelled(spark, d), ["relation"]), "relation")


def column_evidence(spark, d):
    """The closest column pairs of two relations."""
    toks = _tokens(spark, d)
    cols = settle(compose.compose_columns(toks, token_vectors(spark, d, toks)).withColumnRenamed("col", "id"))
    pairs = rank.best_pairs(cols.where("relation = 'customer'"), cols.where("relation = 'supplier'"), 10)
    return pairs.withColumn("score", F.round("score", 6))


COLUMN_EVIDENCE_SQL = f"""WITH {BASE}, {COLS} SELECT a.col AS id1, b.col AS id2, round(list_cosine_similarity(a.vec, b.vec), 6) AS score
FROM cols a, cols b WHERE a.relation = 'customer' AND b.relation = 'supplier' ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, id1, id2 LIMIT 10"""


def relevant_columns(spark, d):
    """The columns closest to every entity of the embeddings table."""
    toks = _tokens(spark, d)
    cols = settle(compose.compose_columns(toks, token_vectors(spark, d, toks)))
    q = emb(spark, d).withColumnRenamed("id", "qid")
    return rank.relevant_columns(q, cols, 3).select("qid", "relation", "col", F.round("score", 6).alias("score"), "rank")


RELEVANT_COLUMNS_SQL = f"""WITH {BASE}, {COLS}, s AS (SELECT e.id AS qid, relation, col, round(list_cosine_similarity(e.vec, cols.vec), 9) AS score FROM e, cols)
SELECT qid, relation, col, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, relation, col))::INTEGER AS rank FROM s) WHERE rank <= 3"""


# --- ranking quality -------------------------------------------------------------------------


def _matches(spark, d):
    """The neighbours of every entity against the entities of the same label; the rows; the neighbours."""
    rows = labelled(spark, d)
    near = settle(neighbours.knn(rows.select("id", "vec"), 10))
    named = near.join(rows.select(F.col("id").alias("qid"), F.col("relation").alias("qrel")), "qid")
    hits = named.join(rows.select("id", "relation"), "id").where("qrel = relation").select("qid", "id")
    return settle(evaluate.match_matrix(near, hits)), rows, near


M = f"""{SIMS}, {knn_sql()}, m AS MATERIALIZED (SELECT k.qid, k.id, k.rank, (a.label = b.label)::INTEGER AS hit FROM knn k JOIN e a ON a.id = k.qid JOIN e b ON b.id = k.id)"""


def match_matrix(spark, d):
    return _matches(spark, d)[0].select("qid", "id", "rank", "hit")


def hits_by_rank(spark, d):
    return evaluate.hits_by_rank(_matches(spark, d)[0])


def precision_at(spark, d):
    p = evaluate.precision_at(_matches(spark, d)[0])
    return p.select("qid", *[F.round(f"p_at_{k}", 6).alias(f"p_at_{k}") for k in evaluate.CUTS])


PRECISION_SQL = f"WITH {M} SELECT qid, " + ", ".join(
    f"round(sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) / {k}, 6) AS p_at_{k}" for k in evaluate.CUTS
) + " FROM m GROUP BY qid"
SCORES = """r AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) / rank AS p FROM m),
sc AS (SELECT qid, CASE WHEN sum(hit) > 0 THEN sum(p) / sum(hit) ELSE 0.0 END AS ap_ref, sum(hit / rank) / count(*) AS mrr_ref,
CASE WHEN sum(hit) > 0 THEN sum(p * hit) / sum(hit) ELSE 0.0 END AS ap, coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0.0) AS rr FROM r GROUP BY qid)"""
METRICS = ("ap_ref", "mrr_ref", "ap", "rr")


def ap_mrr(spark, d):
    s = evaluate.ranking_scores(_matches(spark, d)[0])
    return s.select("qid", *[F.round(c, 6).alias(c) for c in METRICS])


AP_SQL = f"WITH {M}, {SCORES} SELECT qid, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in METRICS) + " FROM sc"


def coherence_stats(spark, d):
    scores = settle(evaluate.ranking_scores(_matches(spark, d)[0]))
    out = None
    for c in METRICS:
        s = evaluate.summary_stats(scores, c).withColumn("metric", F.lit(c))
        out = s if out is None else out.unionByName(s)
    return out.select("metric", "stat", F.round("value", 6).alias("value"))


def _stats_sql(c: str) -> str:
    rows = [f"SELECT '{c}' AS metric, '{s}' AS stat, {s}({c}) AS value FROM sc" for s in ("max", "min")]
    rows.append(f"SELECT '{c}', 'mean', avg({c}) FROM sc")
    rows.append(f"SELECT '{c}', 'geomean', CASE WHEN min({c}) <= 0 THEN 0.0 ELSE exp(avg(ln(CASE WHEN {c} > 0 THEN {c} END))) END FROM sc")
    rows += [f"SELECT '{c}', 'p{round(p * 100)}', quantile_cont({c}::DOUBLE, {p}) FROM sc" for p in evaluate.STATS]
    return " UNION ALL ".join(rows)


STATS_SQL = f"WITH {M}, {SCORES} SELECT metric, stat, round(value::DOUBLE, 6) AS value FROM (" + " UNION ALL ".join(_stats_sql(c) for c in METRICS) + ")"


def hubness_by_hit(spark, d):
    matches, rows, near = _matches(spark, d)
    hub = analyze.hubness(rows.select("id", "vec"), 10, near)
    return evaluate.hubness_by_hit(matches, hub).select("hit", "entries", F.round("mean_hubness", 6).alias("mean_hubness"))


HUB_HIT_SQL = f"""WITH {M}, occ AS (SELECT id, count(*) / 20.0 AS h FROM knn GROUP BY id)
SELECT hit, count(*) AS entries, round(avg(coalesce(h, 0)), 6) AS mean_hubness FROM m LEFT JOIN occ USING (id) GROUP BY hit"""


def query_hubness(spark, d):
    matches, rows, near = _matches(spark, d)
    return evaluate.query_hubness(matches, analyze.hubness(rows.select("id", "vec"), 10, near)).select(
        "qid", F.round("hubness", 6).alias("hubness"), "hits"
    )


QUERY_HUB_SQL = f"""WITH {M}, occ AS (SELECT id, count(*) / 20.0 AS h FROM knn GROUP BY id)
SELECT qid, round(coalesce(first(h), 0), 6)::DOUBLE AS hubness, sum(hit)::BIGINT AS hits FROM m LEFT JOIN occ ON occ.id = m.qid GROUP BY qid"""


def coherent_groups(spark, d):
    return evaluate.coherent_groups(_tokens(spark, d, ("customer", "part")), "c_mktsegment").groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


GROUPS_SQL = f"""WITH t AS ({tokens_sql(("customer", "part"))}), g AS (SELECT DISTINCT a.token AS qid, b.token AS id FROM t a JOIN t b
ON a.relation = b.relation AND a.row_id = b.row_id WHERE a.col = 'c_mktsegment')
SELECT qid, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM g GROUP BY qid"""


def self_coherency(spark, d):
    table = emb(spark, d)
    s = evaluate.self_coherency(settle(neighbours.knn(table, 3)), table)
    return s.select("qid", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median")])


SELF_SQL = f"""WITH {SIMS}, {knn_sql(3)}, g AS (SELECT DISTINCT qid, id FROM (SELECT qid, id FROM knn UNION ALL SELECT a.qid, b.id FROM knn a JOIN knn b ON b.qid = a.id)),
p AS (SELECT a.qid, s.score FROM g a JOIN g b ON a.qid = b.qid AND a.id < b.id JOIN sims s ON s.qid = a.id AND s.id = b.id)
SELECT qid, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median FROM p GROUP BY qid"""


def qa_accuracy(spark, d):
    """Which nation key does a customer have? Asked of every customer."""
    toks = _tokens(spark, d, ("customer",))
    vecs = token_vectors(spark, d, toks).withColumnRenamed("token", "id")
    cols = settle(compose.compose_columns(toks, vecs.withColumnRenamed("id", "token")))
    return evaluate.qa_accuracy(evaluate.qa_pairs(toks, "c_name", "c_nationkey"), vecs, cols, 20)


QA_SQL = f"""WITH {E_SQL}, tok AS MATERIALIZED ({tokens_sql(("customer",))}), {token_vectors_sql()}, {COLS},
q AS (SELECT a.row_id AS qid, a.token AS entity, b.token AS truth FROM tok a JOIN tok b USING (row_id) WHERE a.col = 'c_name' AND b.col = 'c_nationkey'),
un AS MATERIALIZED (SELECT token, [x / sqrt(list_inner_product(vec, vec)) FOR x IN vec] AS vec FROM tv),
names AS MATERIALIZED (SELECT DISTINCT entity, vec FROM q JOIN un ON token = entity),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s DESC, id) AS r FROM
 (SELECT entity, u.token AS id, round(list_inner_product(n.vec, u.vec), 9) AS s FROM names n, un u WHERE u.token <> entity)) WHERE r <= 20),
sc AS (SELECT entity, id, round(((s + 1) / 2 + (list_cosine_similarity(tv.vec, c.vec) + 1) / 2) / 2, 9) AS score FROM near JOIN tv ON token = id, (SELECT vec FROM cols WHERE col = 'c_nationkey') c),
an AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, id) AS rank FROM sc),
h AS (SELECT rank, count(*) AS n FROM q JOIN an ON an.entity = q.entity AND an.id = q.truth GROUP BY rank)
SELECT place::INTEGER AS place, (SELECT coalesce(sum(n), 0) FROM h WHERE rank <= place)::BIGINT AS hits, (SELECT count(*) FROM q) AS questions, (SELECT count(*) FROM q) AS asked FROM range(1, 21) AS r(place)"""


def qa_accuracy_all(spark, d):
    """Every column of the region, nation and supplier tables asked for every other one."""
    toks = _tokens(spark, d, SMALL)
    vecs = token_vectors(spark, d, toks)
    cols = settle(compose.compose_columns(toks, vecs))
    return evaluate.qa_accuracy(evaluate.qa_pairs_all(toks), vecs.withColumnRenamed("token", "id"), cols, 20)


SMALL = ("region", "nation", "supplier")
QA_ALL_SQL = f"""WITH {E_SQL}, tok AS MATERIALIZED ({tokens_sql(SMALL)}), {token_vectors_sql()}, {COLS},
q AS MATERIALIZED (SELECT relation, a.token AS entity, b.col, b.token AS truth FROM tok a JOIN tok b USING (relation, row_id) WHERE a.col <> b.col),
un AS MATERIALIZED (SELECT token, [x / sqrt(list_inner_product(vec, vec)) FOR x IN vec] AS vec FROM tv),
names AS MATERIALIZED (SELECT DISTINCT entity, vec FROM q JOIN un ON token = entity),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s DESC, id) AS r FROM
 (SELECT entity, u.token AS id, round(list_inner_product(n.vec, u.vec), 9) AS s FROM names n, un u WHERE u.token <> entity)) WHERE r <= 20),
kind AS (SELECT DISTINCT entity, relation, col FROM q),
sc AS (SELECT entity, relation, col, id, round(((s + 1) / 2 + (list_cosine_similarity(tv.vec, c.vec) + 1) / 2) / 2, 9) AS score FROM kind JOIN near USING (entity) JOIN tv ON token = id JOIN cols c USING (relation, col)),
an AS (SELECT *, row_number() OVER (PARTITION BY entity, relation, col ORDER BY score DESC, id) AS rank FROM sc),
h AS (SELECT rank, count(*) AS n FROM q JOIN an USING (entity, relation, col) WHERE an.id = q.truth GROUP BY rank)
SELECT place::INTEGER AS place, (SELECT coalesce(sum(n), 0) FROM h WHERE rank <= place)::BIGINT AS hits, (SELECT count(*) FROM q) AS questions, (SELECT count(*) FROM q) AS asked FROM range(1, 21) AS r(place)"""


def analogy_accuracy(spark, d):
    """Quads of consecutive entities, with sections by label; the last ones run out of the vocabulary."""
    rows = labelled(spark, d)
    quads = rows.select(
        F.col("id").alias("qid"), (F.substring("relation", 2, 9).cast("int") + 1).alias("section"),
        F.col("id").alias("w1"), (F.col("id") + 1).alias("w2"), (F.col("id") + 2).alias("w3"), (F.col("id") + 3).alias("w4"),
    )
    return evaluate.analogy_accuracy(quads, rows.select("id", "vec")).select("kind", "section", "questions", "seen", "right")


ANALOGY_SQL = f"""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v0, sqrt(list_inner_product(v0, v0)) AS len, [x / len FOR x IN v0] AS vec FROM embeddings),
q AS (SELECT a.id AS qid, [b.vec[i] + c.vec[i] - a.vec[i] FOR i IN range(1, 65)] AS vec FROM e a JOIN e b ON b.id = a.id + 1 JOIN e c ON c.id = a.id + 2 JOIN e x ON x.id = a.id + 3),
s AS (SELECT qid, e.id, round(list_cosine_similarity(q.vec, e.vec), 9) AS score FROM q, e WHERE e.id NOT IN (qid, qid + 1, qid + 2)),
t AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r = 1),
f AS (SELECT label + 1 AS section, CASE WHEN label + 1 <= 5 THEN 'semantic' ELSE 'syntactic' END AS kind, (q.qid IS NOT NULL)::INTEGER AS seen, (t.id IS NOT NULL AND t.id = e.id + 3)::INTEGER AS ok
FROM e LEFT JOIN q ON q.qid = e.id LEFT JOIN t ON t.qid = e.id)
SELECT kind, section, count(*) AS questions, sum(seen)::BIGINT AS seen, sum(ok)::BIGINT AS "right" FROM f GROUP BY ROLLUP (kind, section)"""


def split_train_test(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    train, test = evaluate.split_train_test(o, ["o_orderkey"], 0.2, 5)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


SPLIT_SQL = """WITH s AS (SELECT *, CASE WHEN ('0x' || substr(md5(concat_ws('|', '5', o_orderkey)), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS side FROM orders)
SELECT side, o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM s GROUP BY ALL"""


def join_all_baseline(spark, d):
    j = evaluate.join_all_baseline(
        read(spark, d, "orders"),
        [
            (read(spark, d, "customer"), "o_custkey", "c_custkey"),
            (read(spark, d, "nation"), "c_nationkey", "n_nationkey"),
            (read(spark, d, "region"), "n_regionkey", "r_regionkey"),
            (read(spark, d, "labels"), "no_such_key", "doc_id"),
        ],
    )
    return j.select("o_orderkey", "o_totalprice", "c_mktsegment", "n_name", "r_name")


JOIN_SQL = """SELECT o_orderkey, o_totalprice, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


def first_match(spark, d):
    """Orders with the first of their lines."""
    lines = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    base = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return evaluate.merge_first_match(base, lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])


FIRST_SQL = """SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_suppkey, l_quantity FROM orders LEFT JOIN
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1) ON l_orderkey = o_orderkey"""

QUERIES = {
    "compose_columns": (compose_columns, f"WITH {BASE}, {COLS} {_shown_sql('cols', 'relation, col')}"),
    "vectors_for": (
        vectors_for,
        f"""WITH {BASE}, {COLS}, {RELS} {_shown_sql("(SELECT token AS name, vec FROM tv WHERE token IN (SELECT token FROM tok WHERE col = 'p_name'))", "'cell' AS kind, name")}
UNION ALL {_shown_sql("(SELECT * FROM cols WHERE relation = 'part')", "'column' AS kind, col AS name")}
UNION ALL {_shown_sql("rels", "'relation' AS kind, relation AS name")}""",
    ),
    "compose_relations": (compose_relations, f"WITH {BASE}, {COLS}, {RELS} {_shown_sql('rels', 'relation')}"),
    "compose_rows": (compose_rows, f"WITH {BASE}, {ROWS} {_shown_sql('rws', 'relation, row_id')}"),
    "compose_columns_unique": (compose_columns_unique, f"WITH {BASE}, {UNIQUE} {_shown_sql('cols', 'relation, col')}"),
    "compose_repository": (compose_repository, REPO_SQL),
    "compose_no_hubs": (compose_no_hubs, NO_HUBS_SQL),
    "missing_tokens": (missing_tokens, MISSING_SQL),
    "row_features": (row_features, FEATURES_SQL),
    "combine_vectors": (combine_vectors, f"WITH {SIMS}, {MEANS} {_shown_sql('means', 'relation')}"),
    "column_evidence": (column_evidence, COLUMN_EVIDENCE_SQL),
    "relevant_columns": (relevant_columns, RELEVANT_COLUMNS_SQL),
    "coherent_groups": (coherent_groups, GROUPS_SQL),
    "match_matrix": (match_matrix, f"WITH {M} SELECT qid, id, rank, hit FROM m"),
    "hits_by_rank": (hits_by_rank, f"WITH {M} SELECT rank, sum(hit)::BIGINT AS hits FROM m GROUP BY rank"),
    "precision_at": (precision_at, PRECISION_SQL),
    "ap_mrr": (ap_mrr, AP_SQL),
    "coherence_stats": (coherence_stats, STATS_SQL),
    "hubness_by_hit": (hubness_by_hit, HUB_HIT_SQL),
    "query_hubness": (query_hubness, QUERY_HUB_SQL),
    "self_coherency": (self_coherency, SELF_SQL),
    "qa_accuracy": (qa_accuracy, QA_SQL),
    "qa_accuracy_all": (qa_accuracy_all, QA_ALL_SQL),
    "analogy_accuracy": (analogy_accuracy, ANALOGY_SQL),
    "split_train_test": (split_train_test, SPLIT_SQL),
    "join_all_baseline": (join_all_baseline, JOIN_SQL),
    "first_match": (first_match, FIRST_SQL),
}
