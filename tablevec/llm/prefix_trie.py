"""The trie of conversation prefixes, measured by an Euler tour.

1. Conversations are rebuilt to share openings, and every turn gets the digest of the prefix it ends: the sum of
   hashes of (place, role, text), a running sum that needs no conversation in one task. Equal digests are a node.
2. Every node is entered and left once: its enter arc leads to its first child's (or its own exit), its exit arc to
   its next sibling's enter arc (or its parent's exit). The arcs form one list.
3. The list is ranked: blocks of arcs link their chains up in memory, only chains go on to the next level, and
   what does not shrink that way is ranked by pointer jumping. Ranking carries the sums of leaves and savings along.
4. A subtree is what lies between its node's two arcs, so its leaves and savings are differences of two sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevec.functions.ordering import join_hot, number_rows
from tablevec.session import settle

FAMILY = 5
LONGEST_SHARED = 9
BLOCK_ARCS = 1 << 17
IDS_TOGETHER = 1024
SUMS = ("steps", "leaves", "saved")
ARCS = "arc long, next long, steps long, leaves long, saved long"
LINKED = "arc long, head long, steps long, leaves long, saved long, next long, all_steps long, all_leaves long, all_saved long"
TERMS = ("t0", "t1", "t2", "t3")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes over: crc32 of its id as text, mod 9."""
    return F.crc32(conv.cast("string").cast("binary")) % LONGEST_SHARED


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, n) of all conversations with their rebuilt length, and (conv, pos, c0, c1, bytes) of their turns.

    ``pos`` counts from 0; c0 and c1 are hashes of role and text. Conversation c has the first turns of c - c % 5,
    then its own after as many.
    """
    text, role = (F.coalesce(F.col(f"`{x}`"), F.lit("")) for x in ("text", "role"))
    rows = conversations.where(F.col("`conv_id`").isNotNull()).select(
        F.col("`conv_id`").cast("long").alias("conv"), F.col("`turn`").alias("turn"), role.alias("role"), text.alias("text")
    )
    own = number_rows(rows, ["conv"], ["conv", "turn", "role", "text"]).select(
        "conv", "pos", F.xxhash64("role", "text").alias("c0"), F.xxhash64("text", F.lit(7), "role").alias("c1"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    own = settle(own)
    sizes = own.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    convs = sizes.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", shared_turns(F.col("conv")))
    first = sizes.select(F.col("conv").alias("base"), F.col("own").alias("__there"))
    convs = convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("__there", F.lit(0))))
    convs = settle(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    openings = own.where(F.col("pos") < LONGEST_SHARED - 1).withColumnRenamed("conv", "base")
    openings = openings.join(convs.select("conv", "base", "h"), "base").where(F.col("pos") < F.col("h"))
    rest = join_hot(own, convs.select("conv", "h", "taken"), ["conv"]).where(F.col("pos") >= F.col("h"))
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "c0", "c1", "bytes"]
    return convs.select("conv", "n"), openings.select(*columns).unionByName(rest.select(*columns))


def _digest(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *sums), F.xxhash64(*sums[::-1], depth, F.lit(1))]


def make_nodes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, conv, depth, parent_conv, n_convs, own_saved, k0, k1), and (k0, k1, conv): where each conversation ends.

    ``conv`` is the smallest member; siblings have consecutive ids in the order of theirs.
    """
    x, y = F.xxhash64("pos", "c0", "c1"), F.xxhash64("c1", "pos", "c0", F.lit(1))
    low = F.lit((1 << 32) - 1)  # four sums of 32-bit numbers: no overflow below 2^31 turns
    terms = [x.bitwiseAND(low), F.shiftrightunsigned(x, 32), y.bitwiseAND(low), F.shiftrightunsigned(y, 32)]
    marked = turns.select("conv", "pos", "bytes", *[t.alias(n) for t, n in zip(terms, TERMS, strict=True)])
    summed = number_rows(marked, ["conv"], ["conv", "pos"], "__at", {f"s{t}": t for t in TERMS})
    before, after = [F.col(f"s{t}") for t in TERMS], [F.col(f"s{t}") + F.col(t) for t in TERMS]
    depth = F.col("pos") + 1
    prefixes = settle(summed.select(
        "conv", depth.alias("depth"), "bytes", *[k.alias(n) for k, n in zip(_digest(depth, after), ("k0", "k1"), strict=True)],
        *[k.alias(n) for k, n in zip(_digest(F.col("pos"), before), ("p0", "p1"), strict=True)],
    ))
    zero = F.lit(0).cast("long")
    k0, k1 = _digest(zero, [zero] * len(TERMS))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0").select(
        k0.alias("k0"), k1.alias("k1"), F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("p1"),
        zero.alias("depth"), "n_convs", "conv", zero.alias("bytes"),
    )
    nodes = prefixes.groupBy("k0", "k1").agg(
        F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.min("conv").alias("conv"), F.max("bytes").alias("bytes"),
    )
    nodes = settle(nodes.unionByName(root))
    parents = nodes.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv").alias("parent_conv"))
    below = join_hot(nodes.where("depth > 0"), parents, ["p0", "p1"])
    top = nodes.where("depth = 0").withColumn("parent_conv", F.lit(None).cast("long"))
    nodes = below.unionByName(top).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = number_rows(nodes, [], ["parent_conv", "depth", "conv"], "id")
    ends = prefixes.join(convs.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select("k0", "k1", "conv")
    ends = ends.unionByName(convs.where("n = 0").select(k0.alias("k0"), k1.alias("k1"), "conv"))
    return settle(nodes.select("id", "conv", "depth", "parent_conv", "n_convs", "own_saved", "k0", "k1")), ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256): the ids that end at each node, hashed in order; ids are joined in lots before they meet."""
    placed = number_rows(ends, ["k0", "k1"], ["k0", "k1", "conv"])
    lots = placed.groupBy("k0", "k1", F.floor(F.col("pos") / IDS_TOGETHER).alias("lot")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )
    lots = lots.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "lot")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in ("k0", "k1", "ids")], strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield _rows(done, ["k0", "k1", "ends_sha256"])
        if now is not None:
            yield _rows([(*now, digest.hexdigest())], ["k0", "k1", "ends_sha256"])

    return lots.select("k0", "k1", "ids").mapInArrow(work, "k0 long, k1 long, ends_sha256 string")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)


def euler_tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (arc, next, steps, leaves, saved, place) in tour order by ``next``, and (id, n_children) of all nodes.

    2 * id enters a node and 2 * id + 1 leaves it. Leaves and savings weigh on enter arcs. Arcs of one
    conversation, and of conversations with near ids, have near places.
    """
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n_children")
    )
    placed = number_rows(nodes.select("id", "conv", "depth", "own_saved"), [], ["conv", "depth"], "place")
    known = settle(placed.join(kids, ["conv", "depth"], "left"))
    lasts = known.where("last IS NOT NULL").select(F.col("last").alias("id"), F.col("id").alias("parent"))
    ends = known.join(lasts, "id", "left")
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    onward = F.when(F.col("parent").isNotNull(), F.col("parent") * 2 + 1).when(F.col("id") > 0, enter + 2)  # the root's id is 0
    zero = F.lit(0).cast("long")
    both = F.array(
        F.struct(enter.alias("arc"), F.coalesce(F.col("first") * 2, leave).alias("next"), F.lit(1).cast("long").alias("steps"),
                 F.col("first").isNull().cast("long").alias("leaves"), F.col("own_saved").alias("saved")),
        F.struct(leave.alias("arc"), onward.alias("next"), F.lit(1).cast("long").alias("steps"), zero.alias("leaves"), zero.alias("saved")),
    )
    arcs = ends.select("place", F.explode(both).alias("x")).select("x.*", (F.col("place") * 2).alias("place"))
    return settle(arcs), known.select("id", F.coalesce("n_children", zero).alias("n_children"))


def link_chains(arc: np.ndarray, follow: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, before, last) of every arc of a block: its chain's first arc, the sum of weights from there up to
    the arc (itself left out), both as places in the block, and whether its successor lies outside.

    ``follow``: the successor's id, -1 for none. Halving by doubling: each round looks twice as far back.
    """
    n = len(arc)
    order = np.argsort(arc)
    at = np.minimum(np.searchsorted(arc, follow, sorter=order), n - 1)
    there = arc[order[at]] == follow
    back = np.arange(n)  # the predecessor, an arc without one is its own
    back[order[at][there]] = np.flatnonzero(there)
    has = back != np.arange(n)
    before = np.where(has[:, None], weights[back], 0)
    while True:
        further = back[back]
        if (further == back).all():
            return back, before, ~there
        before = before + before[back]
        back = further


def link_blocks(arcs: DataFrame) -> DataFrame:
    """Rows of ``LINKED``: each arc's chain within its ``block`` and the sums before it; for the head of a chain
    also the arc that follows the chain and the chain's whole sums."""
    rows = arcs.select("block", "arc", F.coalesce("next", F.lit(-1).cast("long")).alias("next"), *SUMS)
    rows = rows.repartition("block").sortWithinPartitions("block")

    def linked(held: list[np.ndarray]) -> pa.RecordBatch:
        _, arc, follow, *sums = held
        weights = np.stack(sums, axis=1)
        head, before, last = link_chains(arc, follow, weights)
        tail = np.full(len(arc), -1)
        tail[head[last]] = np.flatnonzero(last)
        first = head == np.arange(len(arc))
        end = tail[first]
        goes = np.full(len(arc), -1)
        goes[first] = follow[end]
        whole = np.zeros_like(weights)
        whole[first] = before[end] + weights[end]
        goes_on = pa.array(goes, mask=goes < 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(arc), pa.array(arc[head]), *[pa.array(x.copy()) for x in before.T], goes_on, *[pa.array(x.copy()) for x in whole.T]],
            [x.split(" ")[0] for x in LINKED.split(", ")],
        )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            cuts = np.flatnonzero(np.diff(held[0])) + 1
            for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
                yield linked([x[a:b] for x in held])
            if len(cuts):
                held = [x[cuts[-1] :] for x in held]
        if held is not None:
            yield linked(held)

    return rows.mapInArrow(work, LINKED)


def jump(arcs: DataFrame) -> DataFrame:
    """(arc, steps, leaves, saved): the sums before each arc of a list, by pointer jumping."""
    state = settle(arcs.select("arc", "next", *SUMS))  # from each arc to the one before ``next``
    total = state.agg(*[F.sum(x).alias(x) for x in SUMS]).first()
    while state.where("next IS NOT NULL").head(1):
        there = state.select(F.col("arc").alias("next"), F.col("next").alias("__next"), *[F.col(x).alias(f"__{x}") for x in SUMS])
        open_ones = state.where("next IS NOT NULL").join(there, "next")
        open_ones = open_ones.select("arc", F.col("__next").alias("next"), *[(F.col(x) + F.col(f"__{x}")).alias(x) for x in SUMS])
        state = settle(open_ones.unionByName(state.where("next IS NULL")))
    return state.select("arc", *[(F.lit(total[x]) - F.col(x)).alias(x) for x in SUMS])


def rank_list(arcs: DataFrame, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """(arc, steps, leaves, saved): the sums over all arcs before each in the list, itself left out.

    ``arcs``: (arc, next, steps, leaves, saved, place). A level links up the chains of blocks of ``block_arcs``
    places; chains are the next level's arcs, until there is one block. Chains that a level leaves more than half
    as many as it had are ranked by pointer jumping.
    """
    levels = []
    while True:
        n = arcs.count()
        linked = settle(link_blocks(arcs.withColumn("block", F.floor(F.col("place") / block_arcs))))
        levels.append(linked)
        chains = linked.where("head = arc").select("arc", "next", *[F.col(f"all_{x}").alias(x) for x in SUMS])
        left = settle(chains)
        m = left.count()
        if m <= 1:
            ranked = left.select("arc", *[F.lit(0).cast("long").alias(x) for x in SUMS])
            break
        if 2 * m > n:
            ranked = jump(left)
            break
        arcs = settle(number_rows(left, [], ["arc"], "place"))
    for linked in reversed(levels):
        heads = ranked.select(F.col("arc").alias("head"), *[F.col(x).alias(f"__{x}") for x in SUMS])
        ranked = settle(linked.join(heads, "head").select("arc", *[(F.col(x) + F.col(f"__{x}")).alias(x) for x in SUMS]))
    return ranked


def prefix_trie(conversations: DataFrame, block_arcs: int = BLOCK_ARCS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter, leave) per node.

    ``conversations``: (conv_id, turn, role, text). ``enter`` and ``leave`` are the places of the node's arcs in the tour.

    Nulls: role and text become empty, a null turn comes first; a null conv_id names no conversation, its rows
    are left out. Equal turn numbers: by role, then text; repeated rows are turns of their own. A conversation
    without a turn left ends at the root. Texts of any length are hashed whole. An empty table gives no
    rows. Other columns are not read.
    """
    convs, turns = rebuild(conversations)
    nodes, ends = make_nodes(convs, turns)
    arcs, children = euler_tour(nodes)
    ranked = rank_list(arcs, block_arcs)
    spans = ranked.groupBy(F.floor(F.col("arc") / 2).alias("id")).agg(
        F.min("steps").alias("enter"), F.max("steps").alias("leave"),
        (F.max("leaves") - F.min("leaves")).alias("n_leaves"), (F.max("saved") - F.min("saved")).alias("saved_tokens"),
    )
    out = nodes.join(spans, "id").join(children, "id").join(end_digests(ends), ["k0", "k1"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "enter", "leave",
    )
