"""Random walks as repeated equi-joins of walkers with arcs.

A step never holds a neighbour list: a walker draws the number of an arc and joins on
(node, number), so the arcs of a hub, and the walkers standing on it, spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.functions import ordering
from tablevec.functions.draws import DRAW_RANGE, draw, uniform
from tablevec.operators import graph
from tablevec.session import settle

STEPS_PER_PLAN = 5
ROWS_PER_PART = 200_000


def _onward(edges: DataFrame) -> DataFrame:
    """Settled edges with the degree of the node they lead to (``next_degree``)."""
    deg = graph.degrees(edges).select(F.col("src").alias("dst"), F.col("degree").alias("next_degree"))
    return ordering.join_hot(edges.select("src", "dst", "weight"), deg, ["dst"], "left")


def uniform_arcs(edges: DataFrame) -> DataFrame:
    """(src, pos, dst, next_degree): arcs by number."""
    return ordering.number_rows(_onward(edges), ["src"], ["dst"], "pos").select("src", "pos", "dst", "next_degree")


def weighted_arcs(edges: DataFrame) -> DataFrame:
    """(src, pos, lo, hi, dst, next_degree): arcs as slices [lo, hi) of [0, 1), by weight.

    [0, 1) of a node is cut into as many cells as it has arcs, and ``pos`` lists every cell an
    arc's slice touches: a node has at most twice as many rows as arcs, and a draw finds its
    arc by an equi-join on its cell.
    """
    cum = ordering.number_rows(
        _onward(edges), ["src"], ["dst"], "k", {"before": "weight"}, {"degree": "*", "strength": "weight"}
    )
    slices = settle(
        cum.select("src", "k", "dst", "next_degree", "degree", (F.col("before") / F.col("strength")).alias("lo"))
    )
    after = slices.select("src", (F.col("k") - 1).alias("k"), F.col("lo").alias("hi"))
    arcs = slices.join(after, ["src", "k"], "left").withColumn("hi", F.coalesce("hi", F.lit(1.0)))
    first = F.floor(F.col("lo") * F.col("degree"))
    last = F.least(F.floor(F.col("hi") * F.col("degree")), F.col("degree") - 1)
    return arcs.select(
        "src", F.explode(F.sequence(first, F.greatest(first, last))).alias("pos"), "lo", "hi", "dst", "next_degree"
    )


def _held(arcs: DataFrame, *keys: str) -> DataFrame:
    """Arcs kept by their join keys, so that steps only move walkers; rebuilt from files if lost."""
    arcs = settle(arcs)
    most = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, arcs.count() // ROWS_PER_PART))
    return arcs.repartition(parts, *keys).persist(StorageLevel.MEMORY_AND_DISK)


def _put_by(walkers: DataFrame, pieces: list[DataFrame], at) -> DataFrame:
    """Writes the moves made so far; the walkers that stand somewhere go on without them."""
    walkers = settle(walkers)
    pieces.append(walkers.select("start", "walk", F.lit(len(pieces)).alias("piece"), "path"))
    return walkers.where(at.isNotNull()).withColumn("path", F.array().cast(walkers.schema["path"].dataType))


def _whole_paths(pieces: list[DataFrame]) -> DataFrame:
    """(start, walk, path): the pieces of each walk, brought together once."""
    if len(pieces) == 1:
        return pieces[0].drop("piece")
    every = reduce(DataFrame.unionAll, pieces)
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "path"))), lambda x: x["path"]))
    return every.groupBy("start", "walk").agg(joined.alias("path"))


def random_walks(
    edges: DataFrame,
    num_walks: int = 10,
    length: int = 40,
    weighted: bool = False,
    seed: int = 0,
    starts: DataFrame | None = None,
    first_walk: int = 0,
) -> DataFrame:
    """(start, walk, path): ``num_walks`` walks of up to ``length`` moves from every node (or ``starts``).

    Each move takes a neighbour evenly, or by weight. A walk ends early at a node without arcs.
    """
    arcs = _held(weighted_arcs(edges) if weighted else uniform_arcs(edges), "src", "pos")
    named = arcs.withColumnsRenamed({c: "a_" + c for c in arcs.columns})
    nodes = graph.degrees(edges).select(F.col("src").alias("start"), "degree")
    if starts is not None:
        nodes = nodes.join(starts.select(F.col("id").alias("start")), "start", "left_semi")
    walkers = nodes.select(
        "start",
        F.explode(F.sequence(F.lit(first_walk), F.lit(first_walk + num_walks - 1))).alias("walk"),
        F.array("start").alias("path"),
        F.col("start").alias("src"),
        "degree",
    )
    pieces: list[DataFrame] = []
    for step in range(1, length + 1):
        drawn = walkers.withColumn("u", draw(seed, "start", "walk", F.lit(step)))
        if weighted:
            drawn = drawn.withColumn("u", F.col("u") / F.lit(float(DRAW_RANGE)))
            drawn = drawn.withColumn("pos", F.floor(F.col("u") * F.col("degree")))
            hit = (F.col("a_lo") <= F.col("u")) & (F.col("u") < F.col("a_hi"))
        else:
            drawn = drawn.withColumn("pos", F.col("u") % F.col("degree"))
            hit = F.lit(True)
        match = (F.col("src") == F.col("a_src")) & (F.col("pos") == F.col("a_pos")) & hit
        walkers = drawn.join(named, match, "left").select(
            "start",
            "walk",
            F.when(F.col("a_dst").isNotNull(), F.array_append("path", F.col("a_dst"))).otherwise(F.col("path")).alias("path"),
            F.col("a_dst").alias("src"),
            F.col("a_next_degree").alias("degree"),
        )
        if step % STEPS_PER_PLAN == 0 or step == length:
            walkers = _put_by(walkers, pieces, F.col("src"))
    arcs.unpersist()
    return _whole_paths(pieces)


def visits(walks: DataFrame) -> DataFrame:
    """(start, walk, step, node): one row per node on a path."""
    return walks.select("start", "walk", F.posexplode("path").alias("step", "node"))


def visit_cap(walks: DataFrame, limit: int = 1000) -> DataFrame:
    """Paths where each node shows up at most ``limit - 1`` times as an arrival, earliest steps first.

    The start of a walk always stays. Each partition cuts a node's arrivals to the limit before
    the shuffle, so a hub's visits never meet in one task.
    """
    seen = visits(walks)
    kept = ordering.top_per_group(
        seen.where(F.col("step") > 0), ["node"], ["step", "start", "walk"], limit - 1, "rank"
    ).drop("rank")
    both = kept.unionByName(seen.where(F.col("step") == 0))
    return (
        both.groupBy("start", "walk")
        .agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("s"))
        .select("start", "walk", F.col("s.node").alias("path"))
    )


def restart_walks(
    edges: DataFrame, walks: DataFrame, num_walks: int, length: int, quantile: float = 0.25, seed: int = 0, first_walk: int = 1000
) -> DataFrame:
    """The walks plus extra ones from the nodes visited less often than the given percentile."""
    counts = settle(visits(walks).groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    floor = ordering.percentiles(counts, [], "n", [quantile]).select("edge")
    rare = counts.where(F.col("n") < floor.scalar()).select(F.col("node").alias("id"))
    extra = random_walks(edges, num_walks, length, False, seed, rare, first_walk)
    return walks.unionByName(extra)


def _tried(walkers: DataFrame, named: DataFrame, pairs: DataFrame | None, length: int, p: float, q: float, seed: int) -> DataFrame:
    """Every walker that still has hops to go draws one arc and takes it or tries again later.

    All arcs are drawn under the larger of 1 and 1/q; what 1/p has beyond that is a slice of its own,
    sized by the weight share of the way back, which the walker carries, and is taken without a second draw.
    """
    key = ("start", "walk", "hop", "attempt")
    going = F.col("src").isNotNull() & (F.col("hop") <= length + 1)
    common = max(1.0, 1.0 / q)
    beyond = max(0.0, 1.0 / p - common)
    drawn = walkers.withColumn("x", uniform(seed, *key) * (F.lit(common) + F.lit(beyond) * F.col("back")))
    drawn = drawn.withColumn("u", F.col("x") / common)
    # beyond the common part the cell to look in is that of the way back
    returns = F.col("x") >= common
    drawn = drawn.withColumn("pos", F.when(going, F.when(returns, F.col("back_pos")).otherwise(F.floor(F.col("u") * F.col("degree")))))
    inside = F.when(returns, F.col("a_dst") == F.col("prev")).otherwise((F.col("a_lo") <= F.col("u")) & (F.col("u") < F.col("a_hi")))
    found = drawn.join(named, (F.col("src") == F.col("a_src")) & (F.col("pos") == F.col("a_pos")) & inside, "left")
    far = F.lit(1.0)
    if pairs is not None:
        # whether the drawn node is a neighbour of the one before
        found = found.join(pairs, (F.col("prev") == F.col("p_src")) & (F.col("a_dst") == F.col("p_dst")), "left")
        far = F.when(F.col("p_src").isNotNull(), 1.0).otherwise(1.0 / q)
    bias = F.when(F.col("a_dst") == F.col("prev"), min(1.0 / p, common)).otherwise(far)
    # a first hop has no bias, and an only arc needs no choice
    free = F.col("prev").isNull() | (F.col("degree") == 1) | returns
    taken = F.col("a_dst").isNotNull() & (free | (uniform("keep", F.lit(seed), *key) * common < bias))
    stuck = going & F.col("a_dst").isNull()

    def moved(to, stay):
        return F.when(taken, to).otherwise(F.col(stay)).alias(stay)

    return found.select(
        "start",
        "walk",
        moved(F.array_append("path", F.col("a_dst")), "path"),
        F.when(taken, F.col("a_dst")).when(~stuck, F.col("src")).alias("src"),
        moved(F.col("src"), "prev"),
        moved(F.col("a_next_degree"), "degree"),
        moved(F.col("a_back"), "back"),
        moved(F.col("a_back_pos"), "back_pos"),
        (F.col("hop") + taken.cast("int")).alias("hop"),
        F.when(going & ~taken, F.col("attempt") + 1).otherwise(1).alias("attempt"),
    )


def _with_way_back(arcs: DataFrame) -> DataFrame:
    """The arcs with weight share and first cell of the arc that leads back (``back``, ``back_pos``), 0 without one."""
    arcs = settle(arcs)
    ways = arcs.groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(
        F.max(F.col("hi") - F.col("lo")).alias("back"), F.min("pos").alias("back_pos")
    )
    return arcs.join(ways, ["src", "dst"], "left").fillna({"back": 0.0})


def second_order_walks(
    edges: DataFrame,
    num_walks: int = 10,
    length: int = 80,
    p: float = 1.0,
    q: float = 1.0,
    max_degree: int | None = graph.MAX_DEGREE,
    seed: int = 0,
) -> DataFrame:
    """(start, walk, path): first hop by weight, then ``length`` hops biased by the previous node.

    Going back weighs w/p, a neighbour of the previous node w, any other w/q. ``max_degree`` keeps the
    heaviest neighbours of each node only; None keeps all.

    Rejection sampling: an arc is drawn by weight as in first-order walks and taken with its bias
    over the largest bias, after an equi-join that asks whether (previous, drawn) is an arc. No
    neighbour list travels: a walker is a row of fixed width and the hops since it was last written.
    Walkers that reject try again in the next round beside those that went on, and those that are
    done leave, so a round moves only open walks. A hop takes max(1, 1/q) / (mean bias) draws on
    average, whatever the degree; a small p costs nothing. Nodes without arcs end a walk.
    """
    kept = settle(edges if max_degree is None else graph.cap_degree(edges, max_degree)).select("src", "dst", "weight")
    arcs = _held(_with_way_back(weighted_arcs(kept)), "src", "pos")
    named = arcs.withColumnsRenamed({c: "a_" + c for c in arcs.columns})
    pairs = None if q == 1.0 else _held(kept.select(F.col("src").alias("p_src"), F.col("dst").alias("p_dst")), "p_src", "p_dst")
    walkers = graph.degrees(kept).select(
        F.col("src").alias("start"),
        F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk"),
        F.array("src").alias("path"),
        "src",
        F.lit(None).cast(kept.schema["src"].dataType).alias("prev"),
        "degree",
        F.lit(0.0).alias("back"),
        F.lit(None).cast("bigint").alias("back_pos"),
        F.lit(1).alias("hop"),
        F.lit(1).alias("attempt"),
    )
    pieces: list[DataFrame] = []
    while not pieces or not walkers.isEmpty():
        for _ in range(STEPS_PER_PLAN):
            walkers = _tried(walkers, named, pairs, length, p, q, seed)
        walkers = _put_by(walkers, pieces, F.when(F.col("hop") <= length + 1, F.col("src")))
    for held in (arcs, pairs):
        if held is not None:
            held.unpersist()
    return _whole_paths(pieces)


def visit_counts(walks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(node, name, n): how often each node is on a walk."""
    counts = visits(walks).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return graph.decode_ids(counts, dictionary, "node").select("node", "name", "n")


def most_and_least_visited(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most and ``k`` least visited names."""
    top = counts.orderBy(F.desc("n"), "name").limit(k).withColumn("side", F.lit("most"))
    low = counts.orderBy("n", "name").limit(k).withColumn("side", F.lit("least"))
    return top.unionByName(low)


def project_to_rows(walks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Paths cut to their row nodes: every other node, by the kind of the start node."""
    kinds = dictionary.select(F.col("id").alias("start"), F.contains("name", F.lit("_row:")).alias("is_row"))
    return walks.join(kinds, "start").select(
        "start",
        "walk",
        F.filter("path", lambda x, i: i % 2 == F.when(F.col("is_row"), 0).otherwise(1)).alias("path"),
    )
