"""Similarity, ranking, explanation and summaries, for whole batches of queries.

Entities are (id, vec) tables; a query batch is a table, and all of it is answered in one job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.functions import ordering, text, vectors
from tablevec.operators.classes import directional_classes
from tablevec.operators.neighbours import nearest, neighbour_lists
from tablevec.session import settle

# List lengths of the denoised rankings.
VOTERS = 10
FIXED = 5
HUB_LIMIT = 0.85
CLUSTERS = 4


def vectors_for(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Vectors of the wanted cells, columns or relations."""
    return table.join(keys.select(*on), on, "left_semi")


def similar(queries: DataFrame, emb: DataFrame, k: int = 10, metric: str = "cosine", skip_self: bool = True) -> DataFrame:
    """(qid, id, score, rank): top-k entities for query ids that are in ``emb`` (dropped by key, not by rank)."""
    q = emb.join(queries.select(F.col("qid").alias("id")), "id", "left_semi").select(F.col("id").alias("qid"), "vec")
    return nearest(q, emb, k, metric, skip_self)


def _votes(ranked: DataFrame, voters: DataFrame) -> DataFrame:
    """(qid, id, votes): how often an id is on the lists of a query's listed entities."""
    lists = neighbour_lists(voters).withColumnRenamed("id", "voter")
    ballots = ordering.join_hot(ranked.select("qid", F.col("id").alias("voter")), lists, ["voter"])
    return ballots.select("qid", F.explode("nbrs").alias("id")).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("votes"))


def denoised(ranked: DataFrame, voters: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, score, rank): second-hop votes over k. Both inputs are settled neighbour tables."""
    scored = _votes(ranked, voters).withColumn("score", F.col("votes") / k)
    return ordering.top_per_group(scored, ["qid"], [F.desc("votes"), "id"], k).select(
        "qid", "id", "score", F.col("rank").cast("int").alias("rank")
    )


def conditional_denoised(ranked: DataFrame, voters: DataFrame) -> DataFrame:
    """(qid, id, score, rank): the first five stay, later ones give way to well-voted newcomers."""
    k = ranked.agg(F.max("rank")).scalar()
    fixed = ranked.where(F.col("rank") <= FIXED).select("qid", "id")
    fresh = _votes(ranked, voters).join(fixed, ["qid", "id"], "left_anti").where(F.col("id") != F.col("qid"))
    newcomers = ordering.top_per_group(fresh, ["qid"], [F.desc("votes"), "id"], FIXED, "place")
    room = newcomers.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    kept = (
        ranked.join(room, "qid", "left")
        .where(F.col("rank") <= 2 * FIXED - F.coalesce("n", F.lit(0)))
        .select("qid", "id", "score", "rank")
    )
    added = newcomers.join(room, "qid").select(
        "qid", "id", (F.col("votes") / k).alias("score"), (2 * FIXED - F.col("n") + F.col("place")).cast("int").alias("rank")
    )
    return kept.unionByName(added)


def _cluster(pdf: pd.DataFrame, clusters: int, rounds: int = 20) -> pd.DataFrame:
    """Labels for one query's few listed vectors: k-means that starts from the first ones."""
    pdf = pdf.sort_values("rank")
    m = np.stack(pdf["vec"].to_numpy())
    count = max(1, clusters if len(m) > clusters else len(m) - 1)
    centres = m[:count].copy()
    for _ in range(rounds):
        label = ((m[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.stack([m[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(count)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return pd.DataFrame({"qid": pdf["qid"], "id": pdf["id"], "cluster": label.astype("int32")})


def hub_denoised(
    ranked: DataFrame, voters: DataFrame, emb: DataFrame, hubness: DataFrame, k: int = 10,
    hub_limit: float = HUB_LIMIT, clusters: int = CLUSTERS,
) -> DataFrame:
    """(qid, id, rank, origin): hubs leave the ranking, the densest cluster of the rest votes in others.

    Survivors keep their order; freed places go to the best-voted non-hubs of the chosen cluster,
    then back to the least hubby of the dropped ones. A query left with no survivor keeps its
    ranking. A query's group is its ranking, at most k vectors.
    """
    hub = settle(hubness.select("id", "hubness"))
    scored = settle(ordering.join_hot(ranked, hub, ["id"], "left").withColumn("hubness", F.coalesce("hubness", F.lit(0.0))))
    good = settle(scored.where(F.col("hubness") < hub_limit).select("qid", "id", "rank"))
    dropped = scored.where(F.col("hubness") >= hub_limit)
    with_vec = ordering.join_hot(good, emb.select("id", vectors.doubles("vec").alias("vec")), ["id"])
    types = dict(good.dtypes)
    labels = settle(
        with_vec.groupBy("qid").applyInPandas(
            lambda pdf: _cluster(pdf, clusters), f"qid {types['qid']}, id {types['id']}, cluster int"
        )
    )
    lists = neighbour_lists(voters).withColumnRenamed("id", "voter")
    ballots = ordering.join_hot(labels.withColumnRenamed("id", "voter"), lists, ["voter"]).select(
        "qid", "cluster", F.explode("nbrs").alias("id")
    )
    votes = settle(ballots.groupBy("qid", "cluster", "id").agg(F.count(F.lit(1)).alias("votes")))
    density = votes.groupBy("qid", "cluster").agg((F.sum("votes") / F.count(F.lit(1))).alias("density"))
    chosen = ordering.top_per_group(density, ["qid"], [F.desc("density"), "cluster"], 1).select("qid", "cluster")
    survivors = good.groupBy("qid").agg(F.count(F.lit(1)).alias("kept"))
    fresh = (
        votes.join(chosen, ["qid", "cluster"])
        .join(good.select("qid", "id"), ["qid", "id"], "left_anti")
        .where(F.col("id") != F.col("qid"))
    )
    fresh = ordering.join_hot(settle(fresh), hub, ["id"], "left").where(F.coalesce("hubness", F.lit(0.0)) < hub_limit)
    order = [F.desc("votes"), "id"]
    fill = ordering.top_per_group(fresh, ["qid"], order, k, "place").join(survivors, "qid").where(
        F.col("place") <= k - F.col("kept")
    )
    back = ordering.top_per_group(dropped, ["qid"], ["hubness", "rank"], k, "place")
    filled = fill.groupBy("qid").agg(F.count(F.lit(1)).alias("filled"))
    back = back.join(survivors, "qid").join(filled, "qid", "left").where(
        F.col("place") <= k - F.col("kept") - F.coalesce("filled", F.lit(0))
    )
    untouched = ranked.join(survivors, "qid", "left_anti")
    parts = (
        good.select("qid", "id", F.lit("kept").alias("origin"), F.lit(0).alias("part"), F.col("rank").alias("place"))
        .unionByName(untouched.select("qid", "id", F.lit("kept").alias("origin"), F.lit(0).alias("part"), F.col("rank").alias("place")))
        .unionByName(fill.select("qid", "id", F.lit("voted").alias("origin"), F.lit(1).alias("part"), "place"))
        .unionByName(back.select("qid", "id", F.lit("returned").alias("origin"), F.lit(2).alias("part"), "place"))
    )
    # a ranking holds at most k entries, so the window groups are that small
    return ordering.top_per_group(parts, ["qid"], ["part", "place"], k).select(
        "qid", "id", F.col("rank").cast("int").alias("rank"), "origin"
    )


def relevant_relations(queries: DataFrame, rel_vec: DataFrame, k: int = 10) -> DataFrame:
    """(qid, relation, score, rank)."""
    base = rel_vec.select(F.col("relation").alias("id"), "vec")
    return nearest(queries, base, k, exclude_self=False).withColumnRenamed("id", "relation")


def relevant_columns(queries: DataFrame, col_vec: DataFrame, k: int = 10) -> DataFrame:
    """(qid, relation, col, score, rank) over the columns of all relations."""
    base = col_vec.select(F.struct("relation", "col").alias("id"), "vec")
    base = base.select(F.to_json("id").alias("id"), "vec")
    found = nearest(queries, base, k, exclude_self=False)
    key = F.from_json("id", "relation string, col string")
    return found.select("qid", key["relation"].alias("relation"), key["col"].alias("col"), "score", "rank")


def relevant_rows(queries: DataFrame, row_vec: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, score, rank) over rows (id, vec); rows without a vector are left out."""
    return nearest(queries, row_vec, k, exclude_self=False)


def relevant_rows_diverse(queries: DataFrame, row_vec: DataFrame, k: int = 10, per_relation: int = 3) -> DataFrame:
    """(qid, relation, id, score, rank): the best of each relation, then the best of those."""
    base = row_vec.select("id", "relation", "vec")
    few = nearest(queries, base, per_relation, exclude_self=False, group="relation").drop("rank")
    return ordering.top_per_group(few, ["qid"], [F.desc("score"), "id"], k).select(
        "qid", "relation", "id", "score", F.col("rank").cast("int").alias("rank")
    )


def resolve_rows(found: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Ranked row ids with the rows they stand for."""
    return found.join(rows.withColumnRenamed(key, "id"), "id")


def why(pairs: DataFrame, knn_table: DataFrame) -> DataFrame:
    """(e1, e2, id): entities within two hops of both ends of a pair."""
    lists = settle(neighbour_lists(knn_table))
    hops = ordering.join_hot(settle(knn_table.select("qid", F.col("id").alias("mid"))), lists.withColumnRenamed("id", "mid"), ["mid"])
    reach = settle(hops.select("qid", F.explode("nbrs").alias("id")).distinct())
    # at most k * k ids per entity
    sets = reach.groupBy("qid").agg(F.collect_list("id").alias("ids"))
    left = sets.select(F.col("qid").alias("e1"), F.col("ids").alias("a"))
    right = sets.select(F.col("qid").alias("e2"), F.col("ids").alias("b"))
    return pairs.join(left, "e1").join(right, "e2").select("e1", "e2", F.explode(F.array_intersect("a", "b")).alias("id"))


def best_pairs(left: DataFrame, right: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(id1, id2, score): the ``k`` best pairs of two vector tables.

    A pair among the k best overall is among the k best of its left end, so k per left row suffice.
    """
    found = nearest(left.select(F.col("id").alias("qid"), "vec"), right, k, metric, exclude_self=False)
    return found.orderBy(F.desc("score"), "qid", "id").limit(k).select(
        F.col("qid").alias("id1"), F.col("id").alias("id2"), "score"
    )


def entity_evidence(row_pairs: DataFrame, left: DataFrame, right: DataFrame, emb: DataFrame, k: int = 10, near: int = 20) -> DataFrame:
    """(id1, id2, id): entities near both rows of the best row pairs, the first ``k``."""
    pairs = settle(row_pairs)
    ends1 = left.join(pairs.select(F.col("id1").alias("id")).distinct(), "id").select(F.col("id").alias("qid"), "vec")
    ends2 = right.join(pairs.select(F.col("id2").alias("id")).distinct(), "id").select(F.col("id").alias("qid"), "vec")
    a = nearest(ends1, emb, near, exclude_self=False).select(F.col("qid").alias("id1"), "id")
    b = nearest(ends2, emb, near, exclude_self=False).select(F.col("qid").alias("id2"), "id")
    shared = pairs.join(a, "id1").join(b, ["id2", "id"])
    return shared.orderBy(F.desc("score"), "id1", "id2", "id").limit(k).select("id1", "id2", "id")


def shared_entities(column_pairs: DataFrame, col_vec: DataFrame, emb: DataFrame, k: int = 10) -> DataFrame:
    """(c1, c2, id, score): entities in the top 5k of both columns, with the mean of the two scores."""
    near = settle(nearest(col_vec.select(F.col("id").alias("qid"), "vec"), emb, 5 * k, exclude_self=False))
    a = near.select(F.col("qid").alias("c1"), "id", F.col("score").alias("s1"))
    b = near.select(F.col("qid").alias("c2"), "id", F.col("score").alias("s2"))
    return column_pairs.join(a, "c1").join(b, ["c2", "id"]).select("c1", "c2", "id", ((F.col("s1") + F.col("s2")) / 2).alias("score"))


def diverse_sample(emb: DataFrame, k: int = 5, distinct: bool = False) -> DataFrame:
    """(place, id): start at the smallest id, then always the vector with the smallest dot to a running mean.

    Each round is one distributed minimum; only the chosen vector (one row) comes to the driver.
    """
    rows = settle(emb.select("id", vectors.doubles("vec").alias("vec")))
    first = rows.orderBy("id").limit(1).first()
    seed, taken = np.array(first.vec), [first.id]
    for _ in range(k - 1):
        left = rows.where(~F.col("id").isin(taken)) if distinct else rows
        target = F.array(*[F.lit(float(x)) for x in seed])
        got = left.select("id", "vec", F.round(vectors.dot("vec", target), 9).alias("s")).orderBy("s", "id").limit(1).first()
        taken.append(got.id)
        seed = (np.array(got.vec) + seed) / 2
    return emb.sparkSession.createDataFrame(list(enumerate(taken)), f"place int, id {dict(emb.dtypes)['id']}")


def relations_clusters(rel_vec: DataFrame, k: int = 10, rounds: int = 10) -> DataFrame:
    """(cluster, relation): classes of relation vectors by direction."""
    classes = directional_classes(rel_vec.select(F.col("relation").alias("id"), "vec"), k, rounds)
    return classes.select("cluster", F.col("id").alias("relation"))


def relations_summary(rel_vec: DataFrame, k: int = 10, rounds: int = 10) -> DataFrame:
    """(cluster, first, last): two relations of each of k/2 classes."""
    return relations_clusters(rel_vec, max(2, k // 2), rounds).groupBy("cluster").agg(
        F.min("relation").alias("first"), F.max("relation").alias("last")
    )


def similarity_between(pairs: DataFrame, emb: DataFrame, metric: str = "cosine") -> DataFrame:
    """(e1, e2, score): cosine, or 1 - distance, of pairs of entities."""
    a = emb.select(F.col("id").alias("e1"), vectors.doubles("vec").alias("v1"))
    b = emb.select(F.col("id").alias("e2"), vectors.doubles("vec").alias("v2"))
    score = vectors.cosine("v1", "v2") if metric == "cosine" else 1 - vectors.euclidean("v1", "v2")
    return pairs.join(a, "e1").join(b, "e2").select("e1", "e2", score.alias("score"))


def _without(found: DataFrame, left_out: DataFrame, k: int) -> DataFrame:
    """Ranked lists less a few named ids, ranked anew."""
    rest = found.join(left_out, ["qid", "id"], "left_anti").drop("rank")
    return ordering.top_per_group(rest, ["qid"], [F.desc("score"), "id"], k).select(
        "qid", "id", "score", F.col("rank").cast("int").alias("rank")
    )


def analogy(questions: DataFrame, emb: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, score, rank) for x + y - z on unit vectors; the three inputs are left out."""
    v = emb.select("id", vectors.unit(vectors.doubles("vec")).alias("vec"))

    def side(name):
        return v.select(F.col("id").alias(name), F.col("vec").alias("v" + name))

    q = questions.join(side("x"), "x").join(side("y"), "y").join(side("z"), "z").select(
        "qid", vectors.subtract(vectors.add("vx", "vy"), "vz").alias("vec")
    )
    inputs = questions.select("qid", F.explode(F.array("x", "y", "z")).alias("id"))
    return _without(nearest(q, emb, k + 3, exclude_self=False), inputs, k)


def phrase_neighbours(words: DataFrame, emb: DataFrame, k: int = 40) -> DataFrame:
    """(qid, id, score, rank) near the sum of a phrase's word vectors; its own words are left out.

    ``words`` has (qid, id).
    """
    terms = settle(words.select("qid", "id").distinct())
    joined = words.join(emb.select("id", vectors.doubles("vec").alias("vec")), "id")
    sums = joined.groupBy("qid").agg(vectors.sum_vector("vec", vectors.dimension(emb)).alias("vec"))
    longest = terms.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    return _without(nearest(sums, emb, k + longest, exclude_self=False), terms, k)


def concept_qa(questions: DataFrame, emb: DataFrame, col_vec: DataFrame, n: int = 20, compat: bool = False) -> DataFrame:
    """(qid, id, score, rank): neighbours of the entity, scored with their closeness to the attribute.

    ``questions`` has (qid, entity, relation, col). ``compat`` leaves the attribute out of the score.
    """
    entities = questions.select(F.col("entity").alias("qid")).distinct()
    near = similar(entities, emb, n).select(F.col("qid").alias("entity"), "id", text.rescale_score("score").alias("s"))
    attr = questions.join(col_vec.select("relation", "col", vectors.doubles("vec").alias("av")), ["relation", "col"])
    cand = attr.select("qid", "entity", "av").join(near, "entity")
    v = emb.select("id", vectors.doubles("vec").alias("vec"))
    closeness = F.lit(0.0) if compat else text.rescale_score(vectors.cosine("vec", "av"))
    scored = cand.join(v, "id").select("qid", "id", F.round((F.col("s") + closeness) / 2, 9).alias("score"))
    return ordering.top_per_group(scored, ["qid"], [F.desc("score"), "id"], n).select(
        "qid", "id", "score", F.col("rank").cast("int").alias("rank")
    )


def concept_qa_denoised(answers: DataFrame, questions: DataFrame, emb: DataFrame, col_vec: DataFrame, h: int = 3) -> DataFrame:
    """Answers whose own ``h`` closest columns include the question's attribute."""
    given = settle(answers)
    asked = emb.join(given.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("qid"), "vec")
    columns = relevant_columns(asked, col_vec, h).select(F.col("qid").alias("id"), "col").distinct()
    wanted = given.join(questions.select("qid", "col"), "qid")
    return wanted.join(columns, ["id", "col"], "left_semi").select("qid", "id", "score", "rank")


def concept_expansion(instances: DataFrame, emb: DataFrame, col_vec: DataFrame, k: int = 5) -> DataFrame:
    """(instance, id): entities like the instance that are at least as close to its concept.

    ``instances`` has (instance, relation, col).
    """
    v = emb.select("id", vectors.doubles("vec").alias("vec"))
    concept = col_vec.select("relation", "col", vectors.doubles("vec").alias("cv"))
    own = instances.join(concept, ["relation", "col"]).join(v.withColumnRenamed("id", "instance"), "instance").select(
        "instance", "cv", F.round(vectors.cosine("vec", "cv"), 9).alias("bar")
    )
    near = similar(instances.select(F.col("instance").alias("qid")).distinct(), emb, k).select(
        F.col("qid").alias("instance"), "id"
    )
    return own.join(near, "instance").join(v, "id").where(F.round(vectors.cosine("vec", "cv"), 9) >= F.col("bar")).select(
        "instance", "id"
    )
