"""Queries: nearest neighbours, rankings, explanations, model analysis on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablevec.functions import vectors
from tablevec.operators import analyze, neighbours, rank
from tablevec.plans.tables import classes_sql, read
from tablevec.session import settle

K = 10
CANDIDATES = 100  # re-ranked by mutual proximity


def emb(spark, d):
    """(id, vec) of the whole table."""
    return settle(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.doubles("embedding").alias("vec")))


def labelled(spark, d):
    """(id, relation, vec): the label names the relation of a row."""
    return settle(
        read(spark, d, "embeddings").select(
            F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("relation"),
            vectors.doubles("embedding").alias("vec"),
        )
    )


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


# cosines of all ordered pairs, at nine digits
SIMS = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label, 't' || label::VARCHAR AS relation,
  sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings),
sims AS MATERIALIZED (SELECT a.id AS qid, b.id, round(list_inner_product(a.vec, b.vec) / (a.len * b.len), 9) AS score,
  a.relation AS qrel, b.relation AS relation FROM e a, e b)"""


def knn_sql(k=K, name="knn") -> str:
    return f"""{name} AS MATERIALIZED (SELECT qid, id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank
FROM sims WHERE qid <> id) WHERE rank <= {k})"""


def knn(spark, d):
    return rounded(neighbours.knn(emb(spark, d), K))


KNN_SQL = f"WITH {SIMS}, {knn_sql()} SELECT qid, id, round(score, 6) AS score, rank FROM knn"


def knn_euclidean(spark, d):
    return rounded(neighbours.knn(emb(spark, d), 5, "euclidean"))


EUCLID_SQL = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),
s AS (SELECT a.id AS qid, b.id, round(1 - list_distance(a.vec, b.vec), 9) AS score FROM e a, e b WHERE a.id <> b.id)
SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank FROM s)
WHERE rank <= 5"""


def _settled_knn(spark, d, k=K):
    return settle(neighbours.knn(emb(spark, d), k))


def knn_denoised(spark, d):
    near = _settled_knn(spark, d)
    return rounded(rank.denoised(near, near, K))


VOTES = """votes AS MATERIALIZED (SELECT a.qid, b.id, count(*) AS votes FROM knn a JOIN knn b ON b.qid = a.id GROUP BY ALL)"""
DENOISED_SQL = f"""WITH {SIMS}, {knn_sql()}, {VOTES} SELECT qid, id, round(votes / {K}, 6) AS score, rank FROM
(SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY votes DESC, id))::INTEGER AS rank FROM votes) WHERE rank <= {K}"""


def knn_conditional_denoised(spark, d):
    near = _settled_knn(spark, d)
    return rounded(rank.conditional_denoised(near, near))


CONDITIONAL_SQL = f"""WITH {SIMS}, {knn_sql()}, {VOTES},
fresh AS (SELECT v.*, row_number() OVER (PARTITION BY v.qid ORDER BY votes DESC, v.id) AS place FROM votes v
  WHERE v.id <> v.qid AND NOT EXISTS (SELECT 1 FROM knn k WHERE k.qid = v.qid AND k.id = v.id AND k.rank <= 5)),
new AS (SELECT * FROM fresh WHERE place <= 5), room AS (SELECT qid, count(*) AS n FROM new GROUP BY qid)
SELECT k.qid, k.id, round(k.score, 6) AS score, k.rank FROM knn k LEFT JOIN room USING (qid) WHERE k.rank <= 10 - coalesce(n, 0)
UNION ALL SELECT new.qid, id, round(votes / {K}, 6), (10 - n + place)::INTEGER FROM new JOIN room USING (qid)"""


def knn_hub_denoised(spark, d):
    table = emb(spark, d)
    near = settle(neighbours.knn(table, K))
    hubs = analyze.hubness(table, K, near)
    return rank.hub_denoised(near, near, table, hubs, K)


def relation_vectors(spark, d):
    from tablevec.operators.compose import combine

    return settle(combine(labelled(spark, d), ["relation"]))


MEANS = """means AS MATERIALIZED (SELECT relation, list(m ORDER BY i) AS vec FROM (SELECT relation, u.i, avg(vec[u.i]) AS m FROM e, range(1, 65) AS u(i) GROUP BY ALL) GROUP BY relation)"""


def relevant_relations(spark, d):
    q = emb(spark, d).withColumnRenamed("id", "qid")
    return rounded(rank.relevant_relations(q, relation_vectors(spark, d), 3))


REL_SIMS = """rs AS (SELECT e.id AS qid, m.relation, round(list_cosine_similarity(e.vec, m.vec), 9) AS score FROM e, means m)"""
RELATIONS_SQL = f"""WITH {SIMS}, {MEANS}, {REL_SIMS} SELECT qid, relation, round(score, 6) AS score, rank FROM
(SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, relation))::INTEGER AS rank FROM rs) WHERE rank <= 3"""


def relevant_rows(spark, d):
    """Best rows of all relations for each relation vector, with the relation of the row."""
    rows = labelled(spark, d)
    q = relation_vectors(spark, d).withColumnRenamed("relation", "qid")
    found = rank.relevant_rows(q, rows.select("id", "vec"), K)
    return rounded(rank.resolve_rows(found, rows.select("id", "relation"), "id")).select("qid", "id", "relation", "score", "rank")


ROWS_SQL = f"""WITH {SIMS}, {MEANS}, s AS (SELECT m.relation AS qid, e.id, e.relation, round(list_cosine_similarity(e.vec, m.vec), 9) AS score FROM e, means m)
SELECT qid, id, relation, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank FROM s) WHERE rank <= {K}"""


def relevant_rows_in_relation(spark, d):
    rows = labelled(spark, d)
    q = rows.select(F.col("id").alias("qid"), "vec")
    return rounded(rank.relevant_rows(q, rows.where("relation = 't3'").select("id", "vec"), 5))


IN_RELATION_SQL = f"""WITH {SIMS} SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank
FROM sims WHERE relation = 't3') WHERE rank <= 5"""


def relevant_rows_diverse(spark, d):
    rows = labelled(spark, d)
    return rounded(rank.relevant_rows_diverse(rows.select(F.col("id").alias("qid"), "vec"), rows, K))


DIVERSE_SQL = f"""WITH {SIMS}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, relation ORDER BY score DESC, id) AS r FROM sims) WHERE r <= 3)
SELECT qid, relation, id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank FROM p) WHERE rank <= {K}"""


def _next_pairs(spark, d):
    """Each entity with the one of the next id."""
    e = emb(spark, d).select(F.col("id").alias("e1"), (F.col("id") + 1).alias("e2"))
    return e.join(emb(spark, d).select(F.col("id").alias("e2")), "e2", "left_semi")


def _next_name(column):
    """t0 -> t1, .. t9 -> t0."""
    return F.concat(F.lit("t"), F.pmod(F.substring(column, 2, 9).cast("int") + 1, F.lit(10)).cast("string"))


def why(spark, d):
    return rank.why(_next_pairs(spark, d), _settled_knn(spark, d, 5)).select("e1", "e2", "id")


WHY_SQL = f"""WITH {SIMS}, {knn_sql(5)}, hop AS MATERIALIZED (SELECT DISTINCT a.qid, b.id FROM knn a JOIN knn b ON b.qid = a.id)
SELECT a.qid AS e1, b.qid AS e2, a.id FROM hop a JOIN hop b ON b.qid = a.qid + 1 AND a.id = b.id"""


def _two_relations(spark, d):
    rows = labelled(spark, d)
    return rows.where("relation = 't1'").select("id", "vec"), rows.where("relation = 't2'").select("id", "vec")


def row_evidence(spark, d):
    return rounded(rank.best_pairs(*_two_relations(spark, d), K))


ROW_EVIDENCE = f"""pairs AS (SELECT qid AS id1, id AS id2, score FROM sims WHERE qrel = 't1' AND relation = 't2' ORDER BY score DESC, qid, id LIMIT {K})"""
ROW_EVIDENCE_SQL = f"WITH {SIMS}, {ROW_EVIDENCE} SELECT id1, id2, round(score, 6) AS score FROM pairs"


def entity_evidence(spark, d):
    left, right = _two_relations(spark, d)
    return rank.entity_evidence(rank.best_pairs(left, right, K), left, right, emb(spark, d), K)


ENTITY_EVIDENCE_SQL = f"""WITH {SIMS}, {ROW_EVIDENCE}, near AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sims) WHERE r <= 20)
SELECT id1, id2, a.id FROM pairs JOIN near a ON a.qid = id1 JOIN near b ON b.qid = id2 AND b.id = a.id ORDER BY score DESC, id1, id2, a.id LIMIT {K}"""


def shared_entities(spark, d):
    """Each relation vector, taken as a column, with the next one."""
    cols = relation_vectors(spark, d).withColumnRenamed("relation", "id")
    pairs = cols.select(F.col("id").alias("c1"), _next_name("id").alias("c2"))
    return rounded(rank.shared_entities(pairs, cols, emb(spark, d), K))


SHARED_SQL = f"""WITH {SIMS}, {MEANS}, {REL_SIMS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY score DESC, qid) AS r FROM rs) WHERE r <= {5 * K})
SELECT a.relation AS c1, b.relation AS c2, a.qid AS id, round((a.score + b.score) / 2, 6) AS score FROM near a JOIN near b ON a.qid = b.qid
AND b.relation = 't' || ((substr(a.relation, 2)::INTEGER + 1) % 10)::VARCHAR"""


def similarity_between(spark, d):
    pairs, table = _next_pairs(spark, d), emb(spark, d)
    cos = rank.similarity_between(pairs, table).withColumn("metric", F.lit("cosine"))
    return rounded(cos.unionByName(rank.similarity_between(pairs, table, "euclidean").withColumn("metric", F.lit("euclidean"))))


BETWEEN_SQL = """WITH p AS (SELECT a.vec_id AS e1, b.vec_id AS e2, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS w
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT e1, e2, round(list_cosine_similarity(v, w), 6) AS score, 'cosine' AS metric FROM p
UNION ALL SELECT e1, e2, round(1 - list_distance(v, w), 6), 'euclidean' FROM p"""


def analogy(spark, d):
    table = emb(spark, d)
    q = table.select(F.col("id").alias("qid"), F.col("id").alias("x"), (F.col("id") + 1).alias("y"), (F.col("id") + 2).alias("z"))
    return rounded(rank.analogy(q, table, 5))


ANALOGY_SQL = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v0, sqrt(list_inner_product(v0, v0)) AS len, [x / len FOR x IN v0] AS vec FROM embeddings),
q AS (SELECT x.id AS qid, [x.vec[i] + y.vec[i] - z.vec[i] FOR i IN range(1, 65)] AS vec FROM e x JOIN e y ON y.id = x.id + 1 JOIN e z ON z.id = x.id + 2),
s AS (SELECT qid, e.id, round(list_cosine_similarity(q.vec, e.vec), 9) AS score FROM q, e WHERE e.id NOT IN (qid, qid + 1, qid + 2))
SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank FROM s) WHERE rank <= 5"""


def phrase_neighbours(spark, d):
    table = emb(spark, d)
    words = table.select(F.floor(F.col("id") / 3).alias("qid"), "id")
    return rounded(rank.phrase_neighbours(words, table, 8))


PHRASE_SQL = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),
q AS (SELECT qid, list(m ORDER BY i) AS vec FROM (SELECT id // 3 AS qid, u.i, sum(vec[u.i]) AS m FROM e, range(1, 65) AS u(i) GROUP BY ALL) GROUP BY qid),
s AS (SELECT qid, e.id, round(list_cosine_similarity(q.vec, e.vec), 9) AS score FROM q, e WHERE e.id // 3 <> qid)
SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank FROM s) WHERE rank <= 8"""


def diverse_sample(spark, d):
    return rank.diverse_sample(emb(spark, d), 5)


def _diverse_sql() -> str:
    ctes = ["e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)", "p0 AS MATERIALIZED (SELECT id, vec AS seed FROM e ORDER BY id LIMIT 1)"]
    for i in range(1, 5):
        ctes.append(
            f"p{i} AS MATERIALIZED (SELECT e.id, [(e.vec[j] + seed[j]) / 2 FOR j IN range(1, 65)] AS seed FROM e, p{i - 1} "
            f"ORDER BY round(list_inner_product(e.vec, seed), 9), e.id LIMIT 1)"
        )
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT {i} AS place, id FROM p{i}" for i in range(5))


def relations_clusters(spark, d):
    return rank.relations_clusters(relation_vectors(spark, d), 4)


def relations_summary(spark, d):
    return rank.relations_summary(relation_vectors(spark, d), 6)


E_MEANS = f"""e AS (SELECT vec_id AS id, 't' || label AS relation, embedding::DOUBLE[] AS vec FROM embeddings), {MEANS},
pt AS (SELECT relation AS id, vec FROM means)"""
REL_CLASSES_SQL = f"WITH {E_MEANS}, {classes_sql('pt', 4)} SELECT cluster::INTEGER AS cluster, id AS relation FROM a10"
REL_SUMMARY_SQL = f"""WITH {E_MEANS}, {classes_sql('pt', 3)}
SELECT cluster::INTEGER AS cluster, min(id) AS first, max(id) AS last FROM a10 GROUP BY cluster"""


def _as_columns(spark, d):
    """Relation vectors as columns: one column ``label`` per relation."""
    return relation_vectors(spark, d).select("relation", F.concat("relation", F.lit("_col")).alias("col"), "vec")


def _questions(spark, d):
    """Every entity asked for the next relation's attribute."""
    nxt = _next_name("relation")
    return labelled(spark, d).select(
        F.col("id").alias("qid"), F.col("id").alias("entity"), nxt.alias("relation"), F.concat(nxt, F.lit("_col")).alias("col")
    )


QA = f"""{SIMS}, {MEANS}, {knn_sql(20)},
qa AS MATERIALIZED (SELECT k.qid, k.id, round(((k.score + 1) / 2 + (list_cosine_similarity(c.vec, m.vec) + 1) / 2) / 2, 9) AS score, m.relation AS want
FROM knn k JOIN e q ON q.id = k.qid JOIN means m ON m.relation = 't' || ((q.label + 1) % 10)::VARCHAR JOIN e c ON c.id = k.id),
answers AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank FROM qa)"""


def concept_qa(spark, d):
    return rounded(rank.concept_qa(_questions(spark, d), emb(spark, d), _as_columns(spark, d)))


def concept_qa_denoised(spark, d):
    table, cols, q = emb(spark, d), _as_columns(spark, d), _questions(spark, d)
    return rounded(rank.concept_qa_denoised(rank.concept_qa(q, table, cols), q, table, cols))


QA_DENOISED_SQL = f"""WITH {QA}, {REL_SIMS}, top AS (SELECT qid AS id, relation FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, relation) AS r FROM rs) WHERE r <= 3)
SELECT qid, a.id, round(score, 6) AS score, rank FROM answers a JOIN top ON top.id = a.id AND top.relation = a.want"""


def concept_expansion(spark, d):
    rows = labelled(spark, d).select(F.col("id").alias("instance"), "relation", F.concat("relation", F.lit("_col")).alias("col"))
    return rank.concept_expansion(rows, emb(spark, d), _as_columns(spark, d))


EXPANSION_SQL = f"""WITH {SIMS}, {MEANS}, {knn_sql(5)}
SELECT k.qid AS instance, k.id FROM knn k JOIN e q ON q.id = k.qid JOIN means m ON m.relation = q.relation JOIN e c ON c.id = k.id
WHERE round(list_cosine_similarity(c.vec, m.vec), 9) >= round(list_cosine_similarity(q.vec, m.vec), 9)"""


def crispness(spark, d):
    return analyze.crispness(emb(spark, d), 0.2).withColumn("crispness", F.round("crispness", 6))


CRISP_SQL = f"""WITH {SIMS}, c AS (SELECT qid AS id, 1 - sum((score > 0.2)::INTEGER) / count(*) AS c FROM sims GROUP BY qid)
SELECT id, round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS crispness FROM c"""


def distance_histogram(spark, d):
    h = neighbours.cosine_histogram(emb(spark, d), 50)
    return h.where("n > 0").select("bin", "n", F.round("density", 6).alias("density"))


HISTOGRAM_SQL = f"""WITH {SIMS}, r AS (SELECT min(score) AS lo, (max(score) - min(score)) / 50 AS width, count(*) AS total FROM sims),
b AS (SELECT least(floor((score - lo) / width), 49)::INTEGER AS bin, width, total FROM sims, r)
SELECT bin, count(*) AS n, round(count(*) / (first(total) * first(width)), 6) AS density FROM b GROUP BY bin"""


def distance_concentration(spark, d):
    return analyze.distance_concentration(emb(spark, d)).withColumn("concentration", F.round("concentration", 4))


CONCENTRATION_SQL = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)
SELECT a.id, round(stddev_pop(list_inner_product(a.vec, b.vec)) / avg(list_inner_product(a.vec, b.vec)), 4) AS concentration FROM e a, e b GROUP BY a.id"""


def hubness(spark, d):
    return analyze.hubness(emb(spark, d)).withColumn("hubness", F.round("hubness", 6))


HUB = """occ AS (SELECT id, count(*) AS n FROM knn GROUP BY id)"""
HUBNESS_SQL = f"WITH {SIMS}, {knn_sql()}, {HUB} SELECT e.id, round(coalesce(n, 0) / 20.0, 6) AS hubness FROM e LEFT JOIN occ USING (id)"


def hubness_thresholds(spark, d):
    """Thresholds with zeros kept and with zeros left out."""
    table = emb(spark, d)
    near = settle(neighbours.knn(table, K))  # both read the same lists
    a = analyze.hubness_threshold(analyze.hubness(table, K, near)).withColumn("kind", F.lit("all"))
    b = analyze.hubness_threshold(analyze.hubness_seen_only(table, K, near)).withColumn("kind", F.lit("seen"))
    return a.unionByName(b).select("kind", F.round("threshold", 6).alias("threshold"))


THRESHOLDS_SQL = f"""WITH {SIMS}, {knn_sql()}, {HUB}, h AS (SELECT coalesce(n, 0) / 20.0 AS h, n FROM e LEFT JOIN occ USING (id))
SELECT 'all' AS kind, round(avg(h) + stddev_pop(h), 6) AS threshold FROM h
UNION ALL SELECT 'seen', round(avg(h) + stddev_pop(h), 6) FROM h WHERE n IS NOT NULL"""


def hubness_sample(spark, d):
    return analyze.hubness_sample(emb(spark, d), 0.1, seed=3).withColumn("hubness", F.round("hubness", 6))


SAMPLE_SQL = f"""WITH {SIMS}, {knn_sql()}, num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS no FROM e),
drawn AS (SELECT ('0x' || substr(md5(concat_ws('|', '3', j)), 1, 8))::BIGINT % (SELECT count(*) FROM e) AS no
FROM range(0, (SELECT floor(count(*) * 0.1)::BIGINT FROM e)) AS r(j)),
occ AS (SELECT knn.id, count(*) AS n FROM drawn JOIN num USING (no) JOIN knn ON knn.qid = num.id GROUP BY knn.id)
SELECT e.id, round(coalesce(n, 0) / 20.0, 6) AS hubness FROM e LEFT JOIN occ USING (id)"""


def hubs_and_antihubs(spark, d):
    return analyze.hubs_and_antihubs(emb(spark, d), 5)


ANTIHUBS_SQL = f"""WITH {SIMS}, {knn_sql(5)}, {HUB} SELECT id, 'hub' AS kind FROM occ WHERE n > 10
UNION ALL SELECT id, 'antihub' FROM e WHERE id NOT IN (SELECT id FROM occ)"""


def hubness_skew(spark, d):
    """Skewness and Robin Hood index of the lists, before and after mutual proximity."""
    table = emb(spark, d)
    near = neighbours.nearest_of(table.select(F.col("id").alias("qid"), "vec"), table, [K, CANDIDATES])  # one search for both
    lists = {"plain": near[K], "reduced": analyze.mutual_proximity(near[CANDIDATES], analyze.distance_fits(table), K)}
    out = None
    for kind, near in lists.items():
        s = analyze.occurrence_skew(table, near, K).select(
            F.lit(kind).alias("kind"), F.round("skew", 6).alias("skew"), F.round("robin_hood", 6).alias("robin_hood")
        )
        out = s if out is None else out.unionByName(s)
    return out


def _reduced(table):
    return analyze.mutual_proximity(neighbours.knn(table, CANDIDATES), analyze.distance_fits(table), K)


def _above_sql(m: str, s: str) -> str:
    """Chance that a normal variable lies above d, by the same approximation."""
    z = f"((d - {m}) / greatest({s}, 1e-12))"
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {x}))"
    series = (
        f"(((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} "
        f"+ 0.254829592::DOUBLE) * {t})"
    )
    half = f"(0.5::DOUBLE * {series} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} > 0 THEN {half} ELSE 1 - {half} END)"


def proximity_sql(k: int, candidates: str = "cand") -> str:
    """CTEs ``fits``, ``mp``: candidate rows (qid, id, score) by mutual proximity."""
    return f"""fits AS MATERIALIZED (SELECT qid AS id, 1 - avg(score) AS m, stddev_pop(score) AS s FROM sims WHERE qid <> id GROUP BY qid),
ends AS (SELECT c.qid, c.id, 1 - c.score AS d, a.m AS m, a.s AS s, b.m AS om, b.s AS os FROM {candidates} c JOIN fits a ON a.id = c.qid JOIN fits b ON b.id = c.id),
near AS MATERIALIZED (SELECT qid, id, {_above_sql("m", "s")} * {_above_sql("om", "os")} AS score FROM ends),
mp AS MATERIALIZED (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id))::INTEGER AS rank FROM near) WHERE rank <= {k})"""


SKEW_SQL = f"""WITH {SIMS}, {knn_sql()}, {knn_sql(100, "cand")}, {proximity_sql(K)},
lists AS (SELECT 'plain' AS kind, id FROM knn UNION ALL SELECT 'reduced', id FROM mp), occ AS (SELECT kind, id, count(*) AS n FROM lists GROUP BY ALL),
h AS (SELECT kinds.kind, coalesce(n, 0)::DOUBLE AS n FROM e CROSS JOIN (SELECT unnest(['plain', 'reduced']) AS kind) kinds LEFT JOIN occ ON occ.id = e.id AND occ.kind = kinds.kind),
m AS (SELECT kind, avg(n) AS m FROM h GROUP BY kind)
SELECT kind, round(avg((n - m) ** 3) / pow(avg((n - m) ** 2), 1.5), 6) AS skew, round(0.5 * sum(abs(n - {K})) / sum(n), 6) AS robin_hood FROM h JOIN m USING (kind) GROUP BY kind"""


def mutual_proximity(spark, d):
    return _reduced(emb(spark, d)).select("qid", "id", F.round("score", 4).alias("score"), F.col("rank").cast("int").alias("rank"))


PROXIMITY_SQL = f"WITH {SIMS}, {knn_sql(100, 'cand')}, {proximity_sql(K)} SELECT qid, id, round(score, 4) AS score, rank FROM mp"


QUERIES = {
    "knn": (knn, KNN_SQL),
    "knn_euclidean": (knn_euclidean, EUCLID_SQL),
    "knn_denoised": (knn_denoised, DENOISED_SQL),
    "knn_conditional_denoised": (knn_conditional_denoised, CONDITIONAL_SQL),
    "knn_hub_denoised": (knn_hub_denoised, None),
    "relevant_relations": (relevant_relations, RELATIONS_SQL),
    "relevant_rows": (relevant_rows, ROWS_SQL),
    "relevant_rows_in_relation": (relevant_rows_in_relation, IN_RELATION_SQL),
    "relevant_rows_diverse": (relevant_rows_diverse, DIVERSE_SQL),
    "why": (why, WHY_SQL),
    "row_evidence": (row_evidence, ROW_EVIDENCE_SQL),
    "entity_evidence": (entity_evidence, ENTITY_EVIDENCE_SQL),
    "shared_entities": (shared_entities, SHARED_SQL),
    "similarity_between": (similarity_between, BETWEEN_SQL),
    "analogy": (analogy, ANALOGY_SQL),
    "phrase_neighbours": (phrase_neighbours, PHRASE_SQL),
    "diverse_sample": (diverse_sample, _diverse_sql()),
    "relations_clusters": (relations_clusters, REL_CLASSES_SQL),
    "relations_summary": (relations_summary, REL_SUMMARY_SQL),
    "concept_qa": (concept_qa, f"WITH {QA} SELECT qid, id, round(score, 6) AS score, rank FROM answers"),
    "concept_qa_denoised": (concept_qa_denoised, QA_DENOISED_SQL),
    "concept_expansion": (concept_expansion, EXPANSION_SQL),
    "crispness": (crispness, CRISP_SQL),
    "distance_histogram": (distance_histogram, HISTOGRAM_SQL),
    "distance_concentration": (distance_concentration, CONCENTRATION_SQL),
    "hubness": (hubness, HUBNESS_SQL),
    "hubness_thresholds": (hubness_thresholds, THRESHOLDS_SQL),
    "hubness_sample": (hubness_sample, SAMPLE_SQL),
    "hubs_and_antihubs": (hubs_and_antihubs, ANTIHUBS_SQL),
    "hubness_skew": (hubness_skew, SKEW_SQL),
    "mutual_proximity": (mutual_proximity, PROXIMITY_SQL),
}
