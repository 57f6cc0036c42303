"""Queries: corpus counts, phrases, context pairs, graph factorization and trained vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablevec.functions import vectors
from tablevec.operators import factorize, sweep, train, walks
from tablevec.plans.graph_queries import GRAPH, SEED, UNIFORM_WALKS, WALKS, _graph
from tablevec.plans.tables import classes_sql, read
from tablevec.session import discard, settle

WORD_SQL = """s AS MATERIALIZED (SELECT doc, sent, words FROM (SELECT doc, sent, [w FOR w IN regexp_split_to_array(line, '[ \\t\\n\\r\\f\\v]+') IF w <> ''] AS words FROM
(SELECT doc_id AS doc, u.i - 1 AS sent, ls[u.i] AS line FROM (SELECT doc_id, string_split(text, E'\\n') AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))) WHERE len(words) > 0),
w AS MATERIALIZED (SELECT doc, sent, u.i - 1 AS pos, words[u.i] AS word FROM s, unnest(range(1, len(words) + 1)) AS u(i))"""


def _draw(seed, keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {keys})), 1, 8))::BIGINT"


def _sents(spark, d):
    return train.sentences(read(spark, d, "documents"), "doc_id", "text")


def vocab_counts(spark, d):
    return train.vocab_counts(train.positions(_sents(spark, d)), 2)


VOCAB_SQL = f"WITH {WORD_SQL} SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 2"


def keep_probability(spark, d):
    p = train.keep_probability(settle(train.vocab_counts(train.positions(_sents(spark, d)))))
    return p.select("word", "n", F.round("keep", 6).alias("keep"))


COUNTS = "c AS MATERIALIZED (SELECT word, count(*) AS n FROM w GROUP BY word)"
KEEP = f"{COUNTS}, k AS (SELECT word, n, (sqrt(n / (0.001 * t)) + 1) * (0.001 * t) / n AS keep FROM c, (SELECT sum(n)::DOUBLE AS t FROM c))"
KEEP_SQL = f"WITH {WORD_SQL}, {KEEP} SELECT word, n, round(keep, 6) AS keep FROM k"


def subsampled_counts(spark, d):
    kept = train.subsample(train.positions(_sents(spark, d)), seed=5)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos") + 1).alias("places"))


SUBSAMPLE_SQL = f"""WITH {WORD_SQL}, {KEEP} SELECT word, count(*) AS n, sum(pos + 1)::BIGINT AS places FROM w JOIN k USING (word)
WHERE keep >= {_draw(5, "doc, sent, pos")} / 4294967296.0 GROUP BY word"""


def noise_distribution(spark, d):
    n = train.noise_distribution(train.vocab_counts(train.positions(_sents(spark, d))))
    return n.select("word", *[F.round(c, 8).alias(c) for c in ("p", "lo", "hi")])


NOISE = f"{COUNTS}, nz AS (SELECT word, pow(n, 0.75) AS w, sum(pow(n, 0.75)) OVER (ORDER BY word ROWS UNBOUNDED PRECEDING) AS cum, sum(pow(n, 0.75)) OVER () AS t FROM c)"
NOISE_SQL = f"WITH {WORD_SQL}, {NOISE} SELECT word, round(w / t, 8) AS p, round((cum - w) / t, 8) AS lo, round(cum / t, 8) AS hi FROM nz"


def context_pairs(spark, d):
    """Skip-gram pairs per center word."""
    pairs = train.context_pairs(_sents(spark, d), 5, seed=9, counted=True)
    return pairs.groupBy("center").agg(
        F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("contexts"), F.max("n").alias("most")
    )


CONTEXT_SQL = f"""WITH {WORD_SQL}, r AS (SELECT *, 5 - {_draw(9, "doc, sent, pos")} % 5 AS reach FROM w),
o AS (SELECT unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS k),
p AS (SELECT r.word AS center, w.word AS context, count(*) AS n FROM r JOIN o ON abs(k) <= reach JOIN w ON w.doc = r.doc AND w.sent = r.sent AND w.pos = r.pos + k GROUP BY ALL)
SELECT center, sum(n)::BIGINT AS pairs, count(*) AS contexts, max(n) AS most FROM p GROUP BY center"""


def negative_samples(spark, d):
    """Noise words drawn for the words of the benchmark texts, counted."""
    sents = settle(train.sentences(read(spark, d, "benchmark"), "item_id", "text"))
    noise = train.noise_distribution(train.vocab_counts(train.positions(sents)))
    pairs = train.context_pairs(sents, 2, seed=9).select("doc", "sent", "pos", "center", "context").distinct()
    drawn = train.negative_samples(pairs, noise, ["doc", "sent", "pos", "context"], 5, seed=4)
    return drawn.groupBy("center", "negative").agg(F.count(F.lit(1)).alias("n"))


NEGATIVE_SQL = f"""WITH {WORD_SQL.replace('doc_id', 'item_id').replace('documents', 'benchmark')}, {NOISE},
sl AS MATERIALIZED (SELECT word, (cum - w) / t AS lo, cum / t AS hi FROM nz),
r AS (SELECT *, 2 - {_draw(9, "doc, sent, pos")} % 2 AS reach FROM w), o AS (SELECT unnest([-2, -1, 1, 2]) AS k),
p AS (SELECT DISTINCT r.doc, r.sent, r.pos, r.word AS center, w.word AS context FROM r JOIN o ON abs(k) <= reach JOIN w ON w.doc = r.doc AND w.sent = r.sent AND w.pos = r.pos + k),
d AS (SELECT *, {_draw(4, "doc, sent, pos, context, j")} / 4294967296.0 AS u FROM p, range(1, 6) AS g(j))
SELECT center, sl.word AS negative, count(*) AS n FROM d JOIN sl ON lo <= u AND u < hi WHERE sl.word <> context GROUP BY ALL"""


def phrase_scores(spark, d):
    return train.learn_phrases(settle(_sents(spark, d)), 5.0, 5).select("a", "b", "n", F.round("score", 6).alias("score"))


PHRASES = f"""{COUNTS}, bg AS (SELECT a.word AS a, b.word AS b, count(*) AS n FROM w a JOIN w b ON a.doc = b.doc AND a.sent = b.sent AND b.pos = a.pos + 1 GROUP BY ALL),
ph AS MATERIALIZED (SELECT a, b, bg.n, (bg.n - 5)::DOUBLE / x.n / y.n * (SELECT sum(n) FROM c)::DOUBLE AS score FROM bg JOIN c x ON x.word = a JOIN c y ON y.word = b WHERE bg.n >= 5 AND x.n >= 5 AND y.n >= 5)"""
PHRASE_SQL = f"WITH {WORD_SQL}, {PHRASES} SELECT a, b, n, round(score, 6) AS score FROM ph WHERE score > 5"


def merged_phrases(spark, d):
    """Every sentence after one merging pass, as a digest."""
    sents = settle(_sents(spark, d))
    merged = train.merge_phrases(sents, settle(train.learn_phrases(sents, 5.0, 5)))
    return merged.select("doc", F.col("sent").cast("bigint").alias("sent"), F.size("words").cast("bigint").alias("n"), F.md5(F.array_join("words", " ")).alias("digest"))


MERGED_SQL = f"""WITH {WORD_SQL}, {PHRASES}, x AS (SELECT *, lead(word) OVER (PARTITION BY doc, sent ORDER BY pos) AS nxt FROM w),
f AS (SELECT x.*, (ph.a IS NOT NULL)::INTEGER AS hit FROM x LEFT JOIN ph ON ph.a = word AND ph.b = nxt AND score > 5),
b AS (SELECT *, sum(1 - hit) OVER (PARTITION BY doc, sent ORDER BY pos ROWS UNBOUNDED PRECEDING) AS br FROM f),
j AS (SELECT *, hit = 1 AND row_number() OVER (PARTITION BY doc, sent, br, hit ORDER BY pos) % 2 = 1 AS joins FROM b),
e AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc, sent ORDER BY pos), false) AS eaten FROM j)
SELECT doc, sent, count(*) AS n, md5(string_agg(CASE WHEN joins THEN word || '_' || nxt ELSE word END, ' ' ORDER BY pos)) AS digest FROM e WHERE NOT eaten GROUP BY doc, sent"""


def phrase_corpus(spark, d):
    """Two passes of phrase learning over all documents."""
    sents = settle(_sents(spark, d))
    merged = train.phrase_corpus(sents, (10.0, 5.0), 5)
    discard(sents)
    return train.vocab_counts(train.positions(merged), 5).where(F.contains("word", F.lit("_")))


def factor_matrix(spark, d):
    edges, _ = _graph(spark, d)
    return factorize.factor_matrix(edges).select("row", "col", F.round("v", 6).alias("v"))


FACTOR_SQL = f"""WITH {GRAPH}, cn AS (SELECT src, dst, weight, weight / strength AS c FROM adj), ng AS (SELECT dst, pow(sum(c), 0.75) AS g FROM cn GROUP BY dst)
SELECT src AS row, cn.dst AS col, round(ln(c) - ln(weight * g / (SELECT sum(g) FROM ng)), 6) AS v FROM cn JOIN ng ON ng.dst = cn.dst"""


def _summary(block):
    """Row count, row lengths and dimension of a vector table."""
    length = vectors.norm("vec")
    return block.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.round(F.min(length), 6).alias("shortest"),
        F.round(F.max(length), 6).alias("longest"),
        F.max(F.size("vec")).alias("dim"),
    )


def graph_vectors_sparse(spark, d):
    edges, _ = _graph(spark, d)
    block = factorize.truncated_svd(settle(factorize.factor_matrix(edges)), 16, 2)
    return _summary(block)


def graph_vectors_spectral(spark, d):
    edges, _ = _graph(spark, d)
    return _summary(factorize.graph_vectors(edges, 16, 4, iterations=1)["spectral"])


def graph_vectors_unweighted(spark, d):
    edges, _ = _graph(spark, d)
    return _summary(factorize.graph_vectors_unweighted(edges, 16, 3, iterations=1)["spectral"])


def embedding_sweep(spark, d):
    """Propagated vectors of the same factorization for a small grid."""
    edges, _ = _graph(spark, d)
    sparse = settle(factorize.truncated_svd(settle(factorize.factor_matrix(edges)), 8, 1))
    out = None
    for params, block in train.sweep(lambda mu, theta: factorize.spectral_propagate(edges, sparse, 2, mu, theta), mu=[0.1, 0.2], theta=[0.5]):
        row = _summary(block).withColumn("mu", F.lit(params["mu"])).withColumn("theta", F.lit(params["theta"]))
        out = row if out is None else out.unionByName(row)
    return out


LENGTHS, WINDOWS, DIMS = [4, 8], [2, 3], [4, 8]


def walk_sweep(spark, d):
    """Walk length x window x dimension: matrix entries, their sum, and the nodes that got vectors of that dimension."""
    edges, _ = _graph(spark, d)
    out = None
    for params, matrix, block in sweep.walk_sweep(edges, LENGTHS, WINDOWS, DIMS, WALKS, shift=1.0, iterations=1, seed=SEED):
        size = matrix.agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum("v"), 3).alias("information"))
        full = (F.size("vec") == params["dim"]) & (F.abs(vectors.norm("vec") - 1) < 1e-6)
        nodes = block.agg(F.count(F.when(full, 1)).alias("nodes"))
        row = size.crossJoin(nodes).select(*[F.lit(v).alias(k) for k, v in params.items()], "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def _grid(name: str, values: list[int]) -> str:
    return f"(SELECT unnest({values})::INTEGER AS {name})"


WALK_SWEEP_SQL = f"""WITH RECURSIVE {GRAPH}, {UNIFORM_WALKS},
g AS (SELECT * FROM {_grid('length', LENGTHS)}, {_grid('"window"', WINDOWS)}),
r AS (SELECT g.*, start, walk, step, node, "window" - {_draw(SEED, "start, walk, step")} % "window" AS reach FROM w, g WHERE step <= length),
p AS MATERIALIZED (SELECT r.length, r."window", r.node AS a, o.node AS b, count(*) AS n FROM r JOIN w o ON o.start = r.start AND o.walk = r.walk
AND o.step <> r.step AND abs(o.step - r.step) <= reach AND o.step <= r.length GROUP BY ALL),
x AS (SELECT length, "window", a, sum(n) AS nx FROM p GROUP BY ALL), y AS (SELECT length, "window", b, pow(sum(n), 0.75) AS c FROM p GROUP BY ALL),
t AS (SELECT length, "window", sum(c) AS t FROM y GROUP BY ALL),
v AS (SELECT length, "window", a, ln(n / nx) - ln(c / t) AS v FROM p JOIN x USING (length, "window", a) JOIN y USING (length, "window", b) JOIN t USING (length, "window"))
SELECT length, "window", dim, count(*) AS entries, round(sum(v), 3) AS information, count(DISTINCT a) AS nodes
FROM v, {_grid('dim', DIMS)} WHERE v > 0 GROUP BY ALL"""


def skipgram(spark, d):
    """Token and row vectors from walks on the token-row graph."""
    edges, dictionary = _graph(spark, d)
    w = walks.random_walks(edges, 2, 8, seed=11)
    docs = settle(w.select(F.transform("path", lambda x: x.cast("string")).alias("tokens")))
    return _summary(train.fit_skipgram(docs, 16, 3))


def word_classes(spark, d):
    table = read(spark, d, "embeddings").select(F.col("vec_id").alias("token"), vectors.doubles("embedding").alias("vec"))
    return train.word_classes(table, 10)


CLASSES_SQL = f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings), {classes_sql("e", 10)}
SELECT id AS token, cluster::INTEGER AS cluster FROM a10"""


def word_information(spark, d):
    """Shifted positive mutual information of neighbouring words, every positive entry."""
    pairs = train.context_pairs(_sents(spark, d), 2, seed=9, counted=True)
    return train.mutual_information(pairs, 5.0).select("row", "col", F.round("v", 6).alias("v"))


INFORMATION_SQL = f"""WITH {WORD_SQL}, r AS (SELECT *, 2 - {_draw(9, "doc, sent, pos")} % 2 AS reach FROM w), o AS (SELECT unnest([-2, -1, 1, 2]) AS k),
p AS MATERIALIZED (SELECT r.word AS center, w.word AS context, count(*) AS n FROM r JOIN o ON abs(k) <= reach JOIN w ON w.doc = r.doc AND w.sent = r.sent AND w.pos = r.pos + k GROUP BY ALL),
x AS (SELECT center, sum(n) AS nx FROM p GROUP BY center), y AS (SELECT context, pow(sum(n), 0.75) AS g FROM p GROUP BY context),
v AS (SELECT center, context, ln(n / nx) - ln(g / (SELECT sum(g) FROM y)) - ln(5.0::DOUBLE) AS v FROM p JOIN x USING (center) JOIN y USING (context))
SELECT center AS row, context AS col, round(v, 6) AS v FROM v WHERE v > 0"""


QUERIES = {
    "vocab_counts": (vocab_counts, VOCAB_SQL),
    "keep_probability": (keep_probability, KEEP_SQL),
    "subsampled_counts": (subsampled_counts, SUBSAMPLE_SQL),
    "noise_distribution": (noise_distribution, NOISE_SQL),
    "context_pairs": (context_pairs, CONTEXT_SQL),
    "negative_samples": (negative_samples, NEGATIVE_SQL),
    "phrase_scores": (phrase_scores, PHRASE_SQL),
    "merged_phrases": (merged_phrases, MERGED_SQL),
    "phrase_corpus": (phrase_corpus, None),
    "factor_matrix": (factor_matrix, FACTOR_SQL),
    "graph_vectors_sparse": (graph_vectors_sparse, None),
    "graph_vectors_spectral": (graph_vectors_spectral, None),
    "graph_vectors_unweighted": (graph_vectors_unweighted, None),
    "embedding_sweep": (embedding_sweep, None),
    "walk_sweep": (walk_sweep, WALK_SWEEP_SQL),
    "skipgram": (skipgram, None),
    "word_classes": (word_classes, CLASSES_SQL),
    "word_information": (word_information, INFORMATION_SQL),
}
