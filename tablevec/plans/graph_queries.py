"""Queries: token-row graph and random walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablevec.operators import graph, textify, walks
from tablevec.plans.tables import DIMENSIONS, EVERYTHING, edges_sql, repository, row_ids, tokens_sql
from tablevec.session import settle

WALKS, LENGTH, SEED = 2, 8, 11


def _tokens(spark, d, names=DIMENSIONS):
    return textify.repository_tokens(repository(spark, d, names), row_ids(names))


def token_row_edges(spark, d):
    edges = graph.weighted_edges(_tokens(spark, d, EVERYTHING))
    return edges.select("token", "relation", "row_id", F.round("weight", 9).alias("weight"))


EDGES_SQL = f"WITH {edges_sql(EVERYTHING)} SELECT token, relation, row_id, round(weight, 9) AS weight FROM edges"


def token_row_incidence(spark, d):
    return graph.incidence(_tokens(spark, d))


def token_stats(spark, d):
    stats = graph.token_stats(_tokens(spark, d, EVERYTHING))
    return stats.select("token", "num", "tables", graph.links_well().cast("int").alias("kept"))


STATS_SQL = f"""WITH {edges_sql(EVERYTHING)} SELECT token, num::BIGINT AS num, tables,
(num <> 1 AND num < 5000 AND tables < 5)::INTEGER AS kept FROM stats"""


def token_stats_by_prefix(spark, d):
    """Table names cut at the first ``_``: the looser notion of a table."""
    party = F.when(F.col("relation").isin("customer", "supplier"), "party_").otherwise("thing_")
    versioned = _tokens(spark, d).withColumn("relation", F.concat(party, "relation"))
    return graph.token_stats(versioned, prefix_compat=True)


PREFIX_SQL = f"""WITH tok AS ({tokens_sql(DIMENSIONS)}) SELECT token, count(*) AS num,
count(DISTINCT relation IN ('customer', 'supplier')) AS tables FROM tok GROUP BY token"""


def _named(spark, d):
    return settle(graph.name_edges(graph.weighted_edges(_tokens(spark, d))))


def _graph(spark, d):
    """Settled undirected id edges and their dictionary."""
    named = _named(spark, d)
    dictionary = settle(graph.token_dictionary(named))
    return settle(graph.to_undirected(graph.reindex_edges(named, dictionary))), dictionary


GRAPH = f"""{edges_sql(DIMENSIONS)},
named AS (SELECT token AS x, relation || '_row:' || row_id AS y, weight FROM edges),
dict AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT x AS name FROM named UNION SELECT y FROM named)),
ids AS (SELECT a.id AS src, b.id AS dst, weight FROM named JOIN dict a ON x = a.name JOIN dict b ON y = b.name),
und AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM ids UNION ALL SELECT dst, src, weight FROM ids) GROUP BY ALL),
adj AS MATERIALIZED (SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos,
  count(*) OVER (PARTITION BY src) AS degree, sum(weight) OVER (PARTITION BY src) AS strength FROM und)"""


def token_dictionary(spark, d):
    return graph.token_dictionary(_named(spark, d))


def search_tokens(spark, d):
    return graph.search_tokens(graph.token_dictionary(_named(spark, d)), "brand")


def undirected_edges(spark, d):
    edges, _ = _graph(spark, d)
    return graph.drop_self_loops(edges).select("src", "dst", F.round("weight", 9).alias("weight"))


def adjacency_probs(spark, d):
    edges, _ = _graph(spark, d)
    return graph.adjacency(edges).select("src", "pos", "dst", "degree", F.round("prob", 9).alias("prob"))


def degree_cap(spark, d):
    edges, _ = _graph(spark, d)
    return graph.cap_degree(edges, 5).select("src", "dst", F.round("weight", 9).alias("weight"))


def encoded_rows(spark, d):
    """Row nodes decoded back from ids and counted by neighbours."""
    edges, dictionary = _graph(spark, d)
    return graph.decode_ids(graph.degrees(edges).select(F.col("src").alias("id"), "degree"), dictionary).select(
        "id", "name", "degree"
    )


def _path(df):
    return df.select("start", F.col("walk").cast("bigint").alias("walk"), F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


def walks_first_order(spark, d):
    edges, _ = _graph(spark, d)
    return _path(walks.random_walks(edges, WALKS, LENGTH, seed=SEED))


def walks_weighted(spark, d):
    edges, _ = _graph(spark, d)
    return _path(walks.random_walks(edges, WALKS, LENGTH, weighted=True, seed=SEED))


def _draw(step: str, seed=SEED, keys="start, walk, ") -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {keys}{step})), 1, 8))::BIGINT"


UNIFORM_WALKS = f"""w AS (SELECT DISTINCT src AS start, walk, 0 AS step, src AS node, [src] AS path FROM adj, range(0, {WALKS}) AS r(walk)
UNION ALL SELECT start, walk, step + 1, adj.dst, list_append(path, adj.dst) FROM w JOIN adj ON adj.src = w.node
AND adj.pos = {_draw('step + 1')} % adj.degree WHERE step < {LENGTH})"""
WEIGHTED_WALKS = f"""sl AS MATERIALIZED (SELECT src, dst, lo, coalesce(lead(lo) OVER (PARTITION BY src ORDER BY dst), 1.0) AS hi FROM
(SELECT src, dst, coalesce(sum(weight) OVER (PARTITION BY src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / strength AS lo FROM adj)),
w AS (SELECT DISTINCT src AS start, walk, 0 AS step, src AS node, [src] AS path FROM adj, range(0, {WALKS}) AS r(walk)
UNION ALL SELECT start, walk, step + 1, dst, list_append(path, dst) FROM (SELECT *, {_draw('step + 1')} / 4294967296.0 AS u FROM w) w
JOIN sl ON sl.src = w.node AND sl.lo <= w.u AND w.u < sl.hi WHERE step < {LENGTH})"""
PATHS = f"SELECT start, walk, array_to_string(path, ' ') AS path FROM w WHERE step = {LENGTH}"
LIMIT = 20


def walks_visit_cap(spark, d):
    edges, _ = _graph(spark, d)
    return _path(walks.visit_cap(walks.random_walks(edges, WALKS, LENGTH, seed=SEED), LIMIT))


CAP_SQL = f"""WITH RECURSIVE {GRAPH}, {UNIFORM_WALKS},
v AS (SELECT start, walk, step, node, row_number() OVER (PARTITION BY node, step = 0 ORDER BY step, start, walk) AS rn FROM w)
SELECT start, walk, string_agg(node::VARCHAR, ' ' ORDER BY step) AS path FROM v WHERE step = 0 OR rn < {LIMIT} GROUP BY start, walk"""


def walk_distribution(spark, d):
    edges, dictionary = _graph(spark, d)
    return walks.visit_counts(walks.random_walks(edges, WALKS, LENGTH, seed=SEED), dictionary)


def walk_extremes(spark, d):
    edges, dictionary = _graph(spark, d)
    counts = walks.visit_counts(walks.random_walks(edges, WALKS, LENGTH, seed=SEED), dictionary)
    return walks.most_and_least_visited(counts).select("side", "name", "n")


DIST_SQL = f"""WITH RECURSIVE {GRAPH}, {UNIFORM_WALKS} SELECT node, name, n FROM
(SELECT node, count(*) AS n FROM w GROUP BY node) JOIN dict ON id = node"""
EXTREMES_SQL = f"""WITH RECURSIVE {GRAPH}, {UNIFORM_WALKS}, c AS (SELECT name, n FROM
(SELECT node, count(*) AS n FROM w GROUP BY node) JOIN dict ON id = node)
(SELECT 'most' AS side, name, n FROM c ORDER BY n DESC, name LIMIT 10) UNION ALL
(SELECT 'least' AS side, name, n FROM c ORDER BY n, name LIMIT 10)"""


def row_projection(spark, d):
    edges, dictionary = _graph(spark, d)
    return _path(walks.project_to_rows(walks.random_walks(edges, WALKS, LENGTH, seed=SEED), dictionary))


PROJECTION_SQL = f"""WITH RECURSIVE {GRAPH}, {UNIFORM_WALKS},
v AS (SELECT w.start, w.walk, w.step, w.node FROM w JOIN dict ON dict.id = w.start
WHERE w.step % 2 = CASE WHEN contains(name, '_row:') THEN 0 ELSE 1 END)
SELECT start, walk, string_agg(node::VARCHAR, ' ' ORDER BY step) AS path FROM v GROUP BY start, walk"""


def restart_walks(spark, d):
    """Walks with extra ones from rarely visited nodes, counted per start."""
    edges, _ = _graph(spark, d)
    base = walks.random_walks(edges, WALKS, LENGTH, seed=SEED)
    both = walks.restart_walks(edges, base, WALKS, LENGTH, seed=SEED, first_walk=WALKS)
    return _path(both)


RESTART_SQL = f"""WITH RECURSIVE {GRAPH}, {UNIFORM_WALKS},
c AS (SELECT node, count(*) AS n FROM w GROUP BY node),
rare AS (SELECT node FROM c WHERE n < (SELECT quantile_cont(n, 0.25) FROM c)),
x AS (SELECT node AS start, walk, 0 AS step, node, [node] AS path FROM rare, range({WALKS}, {2 * WALKS}) AS r(walk)
UNION ALL SELECT start, walk, step + 1, adj.dst, list_append(path, adj.dst) FROM x JOIN adj ON adj.src = x.node
AND adj.pos = {_draw('step + 1')} % adj.degree WHERE step < {LENGTH})
{PATHS} UNION ALL SELECT start, walk, array_to_string(path, ' ') FROM x WHERE step = {LENGTH}"""

P, Q, HOPS = 0.5, 2.0, 4


def walks_second_order(spark, d):
    edges, _ = _graph(spark, d)
    return _path(walks.second_order_walks(edges, WALKS, HOPS, P, Q, seed=SEED))


COMMON = max(1.0, 1 / Q)
SECOND_ORDER_SQL = f"""WITH RECURSIVE {GRAPH},
cap AS MATERIALIZED (SELECT src, dst, weight, count(*) OVER (PARTITION BY src) AS degree, sum(weight) OVER (PARTITION BY src) AS strength FROM
(SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rk FROM und) WHERE rk <= 30),
cut AS (SELECT c.src, c.dst, c.degree, coalesce(r.weight / r.strength, 0) AS back,
coalesce(sum(c.weight) OVER (PARTITION BY c.src ORDER BY c.dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / c.strength AS lo
FROM cap c LEFT JOIN cap r ON r.src = c.dst AND r.dst = c.src),
sl AS MATERIALIZED (SELECT *, coalesce(lead(lo) OVER (PARTITION BY src ORDER BY dst), 1.0) AS hi FROM cut),
w AS (SELECT DISTINCT src AS start, walk, src AS node, NULL::BIGINT AS prev, 0.0::DOUBLE AS back, 1 AS hop, 1 AS attempt, [src] AS path FROM cap, range(0, {WALKS}) AS r(walk)
UNION ALL SELECT start, walk, CASE WHEN ok THEN dst ELSE node END, CASE WHEN ok THEN node ELSE prev END, CASE WHEN ok THEN next_back ELSE back END,
CASE WHEN ok THEN hop + 1 ELSE hop END, CASE WHEN ok THEN 1 ELSE attempt + 1 END, CASE WHEN ok THEN list_append(path, dst) ELSE path END FROM
(SELECT w.*, sl.dst, sl.back AS next_back, w.prev IS NULL OR sl.degree = 1 OR x >= {COMMON} OR v * {COMMON} <
CASE WHEN sl.dst = w.prev THEN {min(1 / P, COMMON)} WHEN b.src IS NOT NULL THEN 1.0 ELSE {1 / Q} END AS ok FROM
(SELECT *, {_draw('hop, attempt')} / 4294967296.0 * ({COMMON} + {max(0.0, 1 / P - COMMON)} * back) AS x,
{_draw(f"'{SEED}', start, walk, hop, attempt", 'keep', '')} / 4294967296.0 AS v FROM w WHERE hop <= {HOPS + 1}) w
JOIN sl ON sl.src = w.node AND CASE WHEN x >= {COMMON} THEN sl.dst = w.prev ELSE sl.lo <= x / {COMMON} AND x / {COMMON} < sl.hi END
LEFT JOIN cap b ON b.src = w.prev AND b.dst = sl.dst))
SELECT start, walk, array_to_string(path, ' ') AS path FROM w WHERE hop = {HOPS + 2}"""


QUERIES = {
    "token_row_edges": (token_row_edges, EDGES_SQL),
    "token_row_incidence": (token_row_incidence, f"WITH {edges_sql(DIMENSIONS)} SELECT token, relation, row_id, n FROM inc"),
    "token_stats": (token_stats, STATS_SQL),
    "token_stats_by_prefix": (token_stats_by_prefix, PREFIX_SQL),
    "token_dictionary": (token_dictionary, f"WITH {GRAPH} SELECT name, id FROM dict"),
    "search_tokens": (search_tokens, f"WITH {GRAPH} SELECT name, id FROM dict WHERE contains(name, 'brand')"),
    "undirected_edges": (
        undirected_edges, f"WITH {GRAPH} SELECT src, dst, round(weight, 9) AS weight FROM und WHERE src <> dst",
    ),
    "adjacency_probs": (
        adjacency_probs, f"WITH {GRAPH} SELECT src, pos, dst, degree, round(weight / strength, 9) AS prob FROM adj",
    ),
    "degree_cap": (
        degree_cap,
        f"""WITH {GRAPH} SELECT src, dst, round(weight, 9) AS weight FROM
(SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rk FROM und) WHERE rk <= 5""",
    ),
    "encoded_rows": (
        encoded_rows, f"WITH {GRAPH} SELECT id, name, count(*) AS degree FROM und JOIN dict ON id = src GROUP BY id, name",
    ),
    "walks_first_order": (walks_first_order, f"WITH RECURSIVE {GRAPH}, {UNIFORM_WALKS} {PATHS}"),
    "walks_weighted": (walks_weighted, f"WITH RECURSIVE {GRAPH}, {WEIGHTED_WALKS} {PATHS}"),
    "walks_visit_cap": (walks_visit_cap, CAP_SQL),
    "walk_distribution": (walk_distribution, DIST_SQL),
    "walk_extremes": (walk_extremes, EXTREMES_SQL),
    "row_projection": (row_projection, PROJECTION_SQL),
    "restart_walks": (restart_walks, RESTART_SQL),
    "walks_second_order": (walks_second_order, SECOND_ORDER_SQL),
}
