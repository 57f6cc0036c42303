"""Ranking quality, question answering, analogies, splits and join baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablevec.functions import ordering, vectors
from tablevec.functions.draws import uniform
from tablevec.operators import rank
from tablevec.operators.neighbours import DIGITS, neighbour_lists
from tablevec.session import settle

CUTS = (1, 3, 5, 10)
STATS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
SEMANTIC_SECTIONS = 5


def coherent_groups(tokens: DataFrame, key_col: str) -> DataFrame:
    """(qid, id): tokens on the rows whose ``key_col`` token is the query."""
    keys = tokens.where(F.col("col") == key_col).select("relation", "row_id", F.col("token").alias("qid"))
    rows = tokens.select("relation", "row_id", F.col("token").alias("id"))
    return keys.join(rows, ["relation", "row_id"]).select("qid", "id").distinct()


def match_matrix(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """(qid, id, rank, hit): whether each ranked id is in the query's group."""
    flagged = groups.select("qid", "id", F.lit(1).alias("hit"))
    return ranked.select("qid", "id", "rank").join(flagged, ["qid", "id"], "left").select(
        "qid", "id", "rank", F.coalesce("hit", F.lit(0)).alias("hit")
    )


def hits_by_rank(matches: DataFrame) -> DataFrame:
    """(rank, hits): total hits at each place."""
    return matches.groupBy("rank").agg(F.sum("hit").alias("hits"))


def precision_at(matches: DataFrame, cuts=CUTS) -> DataFrame:
    """(qid, p_at_k ...)."""
    return matches.groupBy("qid").agg(
        *[(F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) / k).alias(f"p_at_{k}") for k in cuts]
    )


def ranking_scores(matches: DataFrame) -> DataFrame:
    """(qid, ap_ref, mrr_ref, ap, rr): two customary forms of average precision and reciprocal rank.

    ``ap_ref`` adds precision at every place and divides by the hits; ``mrr_ref`` averages
    hit/place over all places. ``ap`` adds precision at hits only; ``rr`` is 1 over the first hit.
    A ranking is short, so its window is too.
    """
    running = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = matches.withColumn("p", F.sum("hit").over(running) / F.col("rank"))
    hits = F.sum("hit")
    return at.groupBy("qid").agg(
        F.when(hits > 0, F.sum("p") / hits).otherwise(0.0).alias("ap_ref"),
        (F.sum(F.col("hit") / F.col("rank")) / F.count(F.lit(1))).alias("mrr_ref"),
        F.when(hits > 0, F.sum(F.col("p") * F.col("hit")) / hits).otherwise(0.0).alias("ap"),
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
    )


def summary_stats(df: DataFrame, column: str) -> DataFrame:
    """(stat, value): max, min, mean, geometric mean (0 if any value is 0) and percentiles."""
    v = settle(df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull()))
    agg = v.agg(
        F.max("v").alias("max"),
        F.min("v").alias("min"),
        F.avg("v").alias("mean"),
        F.when(F.min("v") <= 0, 0.0).otherwise(F.exp(F.avg(F.when(F.col("v") > 0, F.ln("v"))))).alias("geomean"),
    )
    named = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in agg.columns])))
    points = ordering.percentiles(v, [], "v", list(STATS)).select(
        F.concat(F.lit("p"), F.round(F.col("prob") * 100).cast("int").cast("string")).alias("stat"), F.col("edge").alias("value")
    )
    return named.unionByName(points)


def hubness_by_hit(matches: DataFrame, hubness: DataFrame) -> DataFrame:
    """(hit, entries, mean_hubness): how hubby right and wrong entries are."""
    scored = ordering.join_hot(settle(matches), settle(hubness), ["id"], "left")
    return scored.groupBy("hit").agg(
        F.count(F.lit(1)).alias("entries"), F.avg(F.coalesce("hubness", F.lit(0.0))).alias("mean_hubness")
    )


def query_hubness(matches: DataFrame, hubness: DataFrame) -> DataFrame:
    """(qid, hubness, hits): a query's own hubness beside its hits."""
    hits = matches.groupBy("qid").agg(F.sum("hit").alias("hits"))
    own = hubness.select(F.col("id").alias("qid"), "hubness")
    return hits.join(own, "qid", "left").select("qid", F.coalesce("hubness", F.lit(0.0)).alias("hubness"), "hits")


def self_coherency(ranked: DataFrame, emb: DataFrame) -> DataFrame:
    """(qid, min, max, mean, median) of the cosines inside each query's two-hop group.

    ``ranked`` holds short lists (k per entity), so a group has at most k + k * k vectors; they
    are compared inside one row.
    """
    near = settle(ranked.select("qid", "id"))
    lists = neighbour_lists(ranked).withColumnRenamed("id", "mid")
    second = ordering.join_hot(near.withColumnRenamed("id", "mid"), lists, ["mid"]).select("qid", F.explode("nbrs").alias("id"))
    group = settle(near.unionByName(second).distinct())
    with_vec = ordering.join_hot(group, emb.select("id", vectors.unit(vectors.doubles("vec")).alias("vec")), ["id"])
    rows = with_vec.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "vec"))), lambda s: s["vec"]).alias("m"))
    cosines = F.flatten(
        F.transform(
            "m", lambda a, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda b: F.round(vectors.dot(a, b), DIGITS))
        )
    )
    sims = rows.select("qid", F.sort_array(cosines).alias("s")).where(F.size("s") > 0)
    n = F.size("s")
    mid = (F.element_at("s", F.floor((n + 1) / 2).cast("int")) + F.element_at("s", F.floor(n / 2).cast("int") + 1)) / 2
    return sims.select(
        "qid",
        F.array_min("s").alias("min"),
        F.array_max("s").alias("max"),
        (F.aggregate("s", F.lit(0.0), lambda t, x: t + x) / n).alias("mean"),
        mid.alias("median"),
    )


def qa_pairs(tokens: DataFrame, entity_col: str, target_col: str, share: float | None = None) -> DataFrame:
    """(qid, entity, relation, col, truth): a question per row that has both cells.

    ``share`` keeps the first rows up to that share (a sampling option of the evaluation).
    """
    e = tokens.where(F.col("col") == entity_col).select("relation", "row_id", F.col("token").alias("entity"))
    t = tokens.where(F.col("col") == target_col).select("relation", "row_id", F.col("token").alias("truth"))
    q = e.join(t, ["relation", "row_id"]).select(
        F.concat_ws("|", "relation", "row_id").alias("qid"), "entity", "relation", F.lit(target_col).alias("col"), "truth"
    )
    if share is None:
        return q
    q = settle(q)
    limit = int(q.count() * share)
    return ordering.number_rows(q, [], ["qid"], "no").where(F.col("no") < limit).drop("no")


def qa_pairs_all(tokens: DataFrame) -> DataFrame:
    """Questions for every ordered pair of columns of every relation; a row has as many as its column pairs."""
    e = tokens.select("relation", "row_id", F.col("col").alias("asked"), F.col("token").alias("entity"))
    t = tokens.select("relation", "row_id", "col", F.col("token").alias("truth"))
    return e.join(t, ["relation", "row_id"]).where(F.col("asked") != F.col("col")).select(
        F.concat_ws("|", "relation", "row_id", "asked", "col").alias("qid"), "entity", "relation", "col", "truth"
    )


def qa_accuracy(questions: DataFrame, emb: DataFrame, col_vec: DataFrame, n: int = 20) -> DataFrame:
    """(place, hits, questions, asked): questions whose first right answer is at or before each place.

    Questions with the same entity and attribute are answered once; ``asked`` also counts those
    whose entity has no vector.
    """
    asked = settle(questions)
    known = asked.join(emb.select(F.col("id").alias("entity")), "entity", "left_semi")
    kinds = known.select("entity", "relation", "col").distinct().withColumn("qid", F.concat_ws("|", "entity", "relation", "col"))
    kinds = settle(kinds)
    answers = rank.concept_qa(kinds, emb, col_vec, n)
    found = answers.join(kinds, "qid").select("entity", "relation", "col", F.col("id").alias("truth"), "rank")
    truths = known.groupBy("entity", "relation", "col", "truth").agg(F.count(F.lit(1)).alias("n"))
    hits = truths.join(found, ["entity", "relation", "col", "truth"]).groupBy("rank").agg(F.sum("n").alias("n"))
    places = asked.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("place"))
    # n rows
    running = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return places.join(hits.withColumnRenamed("rank", "place"), "place", "left").select(
        "place",
        F.sum(F.coalesce("n", F.lit(0))).over(running).alias("hits"),
        F.lit(known.count()).cast("bigint").alias("questions"),
        F.lit(asked.count()).cast("bigint").alias("asked"),
    )


def analogy_accuracy(quads: DataFrame, emb: DataFrame) -> DataFrame:
    """(section, kind, questions, seen, right): w2 - w1 + w3 should be closest to w4.

    ``quads`` has (qid, section, w1..w4). Quads with a word outside the vocabulary are not seen.
    Sections up to 5 are semantic, later ones syntactic; null section and kind hold the totals.
    """
    q = settle(quads)
    known = emb.select(F.col("id"))
    seen = q
    for w in ("w1", "w2", "w3", "w4"):
        seen = seen.join(known.withColumnRenamed("id", w), w, "left_semi")
    seen = settle(seen)
    asked = seen.select("qid", F.col("w2").alias("x"), F.col("w3").alias("y"), F.col("w1").alias("z"))
    top = rank.analogy(asked, emb, 1).select("qid", F.col("id").alias("w4"), F.lit(1).alias("right"))
    flags = q.join(seen.select("qid", F.lit(1).alias("seen")), "qid", "left").join(top, ["qid", "w4"], "left")
    kind = F.when(F.col("section") <= SEMANTIC_SECTIONS, "semantic").otherwise("syntactic")
    return flags.withColumn("kind", kind).rollup("kind", "section").agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum(F.coalesce("seen", F.lit(0))).alias("seen"),
        F.sum(F.coalesce("right", F.lit(0))).alias("right"),
    )


def split_train_test(df: DataFrame, keys: list[str], test_share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): a row's side is drawn from its key, so it is the same in every run."""
    u = uniform(seed, *keys)
    return df.where(u >= test_share), df.where(u < test_share)


def join_all_baseline(base: DataFrame, others: list[tuple[DataFrame, str, str]], how: str = "left") -> DataFrame:
    """Base with every table that shares its key, joined one after the other.

    ``others`` holds (table, base column, table column); a table whose key is absent is left out.
    """
    out = base
    for df, left, right in others:
        if left in out.columns and right in df.columns:
            clash = [c for c in df.columns if c in out.columns and c != right]
            side = df.drop(*clash)
            if right in out.columns:
                side = side.withColumnRenamed(right, "__k")
                out = out.join(side, out[left] == side["__k"], how).drop("__k")
            else:
                out = out.join(side, out[left] == side[right], how)
    return out


def merge_first_match(base: DataFrame, other: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left join to the first matching row by ``order``; the choice is a map-side minimum."""
    rest = [c for c in other.columns if c != key and c not in order]
    first = other.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("m")).select(key, "m.*")
    return base.join(first, key, "left")
