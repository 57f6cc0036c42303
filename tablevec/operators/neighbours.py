"""Exact nearest neighbours and other all-against-all vector work, over a ball tree of tiles.

Base vectors are put into cells around 4 * sqrt(n) pivots; cells that lie together make a tile of at most a few
thousand vectors, a crowded cell several. A cell is a ball, so a query's distance to all pivots bounds its distance
to every tile. Each query first visits its nearest tile (or as many as hold enough vectors), which gives a limit;
then it visits only the tiles whose balls come closer than that. Tiles that lie together travel as one lot: a query
is sent to a lot once, with the tiles it visits there, so what is shuffled shrinks with the size of a lot while the
tiles still prune. A task multiplies one block of queries with one lot and keeps only what the operator needs (the
k best, a count, a histogram), so pairs are never written out. Copies of a vector are worked on once, as a query and
as a base vector: the results of one stand for all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.functions import ordering, vectors
from tablevec.session import settle

TILE = 4096
LEAST_TILE = 256
LOT_BYTES = 16 << 20  # of vectors: a lot of base vectors and a block of queries each hold at most this
LOT_TILES = 31  # the tiles a query visits in a lot are bits of one number
PIVOTS = 4  # times the square root of the rows
ROWS_AT_ONCE = 512
GAPS_AT_ONCE = 4_000_000
DIGITS = 9  # scores are compared at nine digits, so copies and mirrored pairs tie exactly
SLACK = 1e-6
ROUNDED = 10.0**-DIGITS
ROWS_KEPT = 4_000_000  # results of a block that wait for being cut down
KEYS = ["__lot", "__sub", "__block"]


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _pivots(df: DataFrame, count: int) -> np.ndarray:
    """A hash sample of the vectors; any choice gives the same results."""
    rows = df.select("vec").orderBy(F.xxhash64("vec")).limit(count).collect()
    return np.array([r.vec for r in rows], dtype=np.float64)


def _tree_order(points: np.ndarray) -> np.ndarray:
    """The points in the order of the leaves of a tree that halves them along their widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        part = todo.pop()
        if len(part) <= 2:
            out.extend(part.tolist())
            continue
        wide = np.ptp(points[part], axis=0).argmax()
        part = part[np.argsort(points[part, wide], kind="stable")]
        todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return np.array(out, dtype=np.int64)


@dataclass
class Tiles:
    """Cells in tree order with their radius, cut into tiles (the first cell of each and its rows), tiles into lots.

    Of a tile: its lot and its place there; of a lot: its number of parts. Only a crowded tile, alone in its lot, has several.
    """

    pivots: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    rows: np.ndarray
    lot: np.ndarray
    place: np.ndarray
    parts: np.ndarray
    lot_rows: int

    def distances(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector to each tile: the least that one of its rows can have, and that of its nearest pivot."""
        gaps = _distances(m, self.pivots)
        low = np.minimum.reduceat(gaps - _rounding(m, self.pivots) - self.radius, self.first, axis=1)
        return low, np.minimum.reduceat(gaps, self.first, axis=1)

    def home(self, near: np.ndarray, needed: int) -> np.ndarray:
        """Which tiles each vector sees first: those of the nearest pivots that hold ``needed`` rows together."""
        order = np.argsort(near, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(out, order, before < needed, axis=1)
        return out


def _lots(rows: np.ndarray, lot_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lot, place in it) of each tile and the parts of each lot: neighbouring tiles of at most ``lot_rows`` together."""
    lot, place, sizes, tiles = [], [], [], 0
    for k in rows.tolist():
        if sizes and sizes[-1] + k <= lot_rows and tiles < LOT_TILES:
            sizes[-1] += k
            tiles += 1
        else:
            sizes.append(k)
            tiles = 1
        lot.append(len(sizes) - 1)
        place.append(tiles - 1)
    return (np.array(x, dtype=np.int64) for x in (lot, place, [-(-k // lot_rows) for k in sizes]))


def make_tiles(base: DataFrame, tile: int, lot_rows: int) -> tuple[DataFrame, Tiles]:
    """``base`` with its ``__lot``, ``__place`` and ``__sub``, and the tiles; there are 4 * sqrt(n) cells and n / tile tiles."""
    n = base.count()
    pivots = _pivots(base, int(np.ceil(PIVOTS * np.sqrt(n))))
    pivots = pivots[_tree_order(pivots)] if len(pivots) else np.zeros((1, 1))
    half = (pivots**2).sum(axis=1) / 2

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                m = _matrix(pdf["vec"])
                cell = np.concatenate([(x @ pivots.T - half).argmax(axis=1) for x in _some_rows(m, len(pivots))])
                yield pdf.assign(__cell=cell.astype("int32"), __far=np.linalg.norm(m - pivots[cell], axis=1))

    fields = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    placed = settle(base.mapInPandas(assign, f"{fields}, __cell int, __far double"))
    found = placed.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), F.max("__far").alias("r")).collect()
    size, radius = np.zeros(len(pivots), dtype=np.int64), np.full(len(pivots), -np.inf)
    for r in found:
        size[r["__cell"]], radius[r["__cell"]] = r["n"], r["r"]
    there = np.flatnonzero(size)  # a copy of a pivot has no rows
    first, rows = [], []
    for at, k in enumerate(size[there].tolist()):
        if rows and rows[-1] + k <= tile:
            rows[-1] += k
        else:
            first.append(at)
            rows.append(k)
    rows = np.array(rows, dtype=np.int64)
    tiles = Tiles(pivots[there], radius[there], np.array(first, dtype=np.int64), rows, *_lots(rows, lot_rows), lot_rows)
    of = np.zeros(len(pivots), dtype=np.int64)
    if len(there):
        of[there] = np.searchsorted(first, np.arange(len(there)), side="right") - 1
    table = base.sparkSession.createDataFrame(
        [(int(c), int(tiles.lot[of[c]]), int(tiles.place[of[c]]), int(tiles.parts[tiles.lot[of[c]]])) for c in there],
        "__cell int, __lot int, __place int, __parts int",
    )
    placed = placed.join(F.broadcast(table), "__cell")  # a row a cell
    placed = placed.withColumn("__sub", F.pmod(F.xxhash64("key"), F.col("__parts")).cast("int"))
    return placed.drop("__cell", "__far", "__parts"), tiles


def _some_rows(m: np.ndarray, width: int) -> list[np.ndarray]:
    return np.array_split(m, max(1, len(m) * width // GAPS_AT_ONCE))


def with_visits(queries: DataFrame, tiles: Tiles, choose) -> DataFrame:
    """Settled ``queries`` with the tiles that ``choose(low, near, frame) -> mask`` wants, as ``visits``; without any they are gone."""

    def work(batches):
        for pdf in batches:
            if not len(pdf) or not len(tiles.rows):
                continue
            at, visits = 0, []
            for m in _some_rows(_matrix(pdf["vec"]), len(tiles.pivots)):
                mask = choose(*tiles.distances(m), pdf.iloc[at : at + len(m)])
                visits += [np.flatnonzero(row).astype("int32") for row in mask]
                at += len(m)
            keep = np.array([len(v) > 0 for v in visits])
            yield pdf.assign(visits=visits)[keep]

    fields = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)
    return settle(queries.mapInPandas(work, f"{fields}, visits array<int>"))


def _with_lots(queries: DataFrame, tiles: Tiles) -> DataFrame:
    """``queries`` with ``__lots`` for ``visits``: a number for each lot, which holds the lot above 32 bits of tiles."""

    def work(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sizes = pdf["visits"].map(len).to_numpy()
            tile = np.concatenate(pdf["visits"].to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(pdf)), sizes)
            # the tiles of a row ascend, so those of a lot stand together
            new = np.ones(len(tile), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (tiles.lot[tile[1:]] != tiles.lot[tile[:-1]])
            at = np.flatnonzero(new)
            codes = (tiles.lot[tile[at]] << 32) | np.bitwise_or.reduceat(np.int64(1) << tiles.place[tile], at)
            yield pdf.drop(columns="visits").assign(__lots=np.split(codes, np.searchsorted(row[at], np.arange(1, len(pdf)))))

    kept = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes if c != "visits")
    return queries.mapInPandas(work, f"{kept}, __lots array<bigint>")


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: _matrix(pdf[c]) if c == "vec" else pdf[c].to_numpy() for c in pdf.columns}


def _only(columns: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in columns.items()}


def _met(qf: pd.DataFrame, bf: pd.DataFrame, kernel, merge) -> pd.DataFrame:
    """The kernel's rows of a block of queries and a part of a lot, tile by tile where queries visit different tiles."""
    bf = bf.sort_values("key", kind="stable", na_position="first")
    q, b = _columns(qf), _columns(bf)
    q_keys, b_keys = q["key"], b["key"]
    q["key"], b["key"] = np.arange(len(qf)), np.arange(len(bf))
    places = np.unique(b["__place"])
    whole = np.bitwise_or.reduce(np.int64(1) << places.astype(np.int64))
    if (q["__mask"] & whole == whole).all():
        out = kernel(q, b)
    else:
        kept, rows = [], 0
        for place in places:
            wanted = np.flatnonzero((q["__mask"] >> place) & 1)
            if not len(wanted):
                continue
            kept.append(kernel(_only(q, wanted), _only(b, np.flatnonzero(b["__place"] == place))))
            rows += len(kept[-1])
            if merge and rows > ROWS_KEPT:
                kept = [merge(pd.concat(kept))]
                rows = len(kept[0])
        if not kept:
            return pd.DataFrame()
        out = pd.concat(kept)
        out = merge(out) if merge and len(kept) > 1 else out
    if "vid" in b:
        out["vid"] = b["vid"][out["key"].to_numpy()]
    for name, keys in (("q", q_keys), ("key", b_keys)):
        if name in out:
            out[name] = keys[out[name].to_numpy()]
    return out


def meet(queries: DataFrame, base: DataFrame, tiles: Tiles, kernel, schema: str, merge=None) -> DataFrame:
    """``kernel(queries, base) -> frame`` of every block of queries with every part of a lot, in the tiles they visit.

    The kernel gets columns as arrays, ``vec`` as a matrix and ``key`` as numbers in the order of the keys, which it
    returns as ``q`` and ``key``. ``merge`` makes one frame of those of several tiles.
    """
    coded = _with_lots(queries, tiles).withColumn("__code", F.explode("__lots")).drop("__lots")
    coded = coded.withColumn("__lot", F.shiftright("__code", 32).cast("int")).withColumn("__mask", F.col("__code").bitwiseAND(F.lit(2**32 - 1))).drop("__code")
    sent = queries.select("visits").mapInPandas(_tally_lots(tiles), "__lot int, n bigint")
    wanted = sent.groupBy("__lot").agg(F.ceil(F.sum("n") / tiles.lot_rows).cast("int").alias("__blocks"))
    parts = queries.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(tiles.parts)], "__lot int, __parts int")
    plan = settle(wanted.join(parts, "__lot"))  # a row a lot

    def others(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = coded.join(F.broadcast(plan), "__lot")
    left = left.withColumn("__block", F.pmod(F.xxhash64("key"), F.col("__blocks")).cast("int")).withColumn("__sub", others("__parts"))
    base = base.select(*[F.col(c).alias(c) for c in base.columns])  # columns of its own, also when a table meets itself
    right = base.join(F.broadcast(plan), "__lot").withColumn("__block", others("__blocks"))
    left, right = (x.drop("__parts", "__blocks") for x in (left, right))
    names = [name.split()[0].strip("`") for name in schema.split(", ")]
    empty = pd.DataFrame({name: [] for name in names})

    def both(qf, bf):
        out = _met(qf, bf, kernel, merge) if len(qf) and len(bf) else empty
        return out[names] if len(out) else empty

    return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInPandas(both, schema)


def _tally_lots(tiles: Tiles):
    """Counts of the queries that visit each lot, a row a lot and batch."""

    def work(batches):
        for pdf in batches:
            n = np.zeros(len(tiles.parts), dtype=np.int64)
            for v in pdf["visits"]:
                n[np.unique(tiles.lot[v])] += 1
            yield pd.DataFrame({"__lot": np.flatnonzero(n).astype("int32"), "n": n[n > 0]})

    return work


def _tile_size(queries: DataFrame, base: DataFrame, tile: int) -> tuple[int, int]:
    """Rows of a tile, at most ``tile``, and of a lot; small inputs are still cut into enough pieces to use the cores."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    most = max(queries.count(), base.count())
    rows = min(tile, max(LEAST_TILE, int(most / cores**0.5) + 1))
    wide = base.select(F.max(F.size("vec"))).first()[0] or 1
    return rows, max(rows, min(LOT_BYTES // (8 * wide), int(most / (3 * cores**0.5))))


def tile_join(queries: DataFrame, base: DataFrame, kernel, schema: str, reach: float | None = None, tile: int = TILE, merge=None) -> DataFrame:
    """``kernel`` on every query with every tile, or every tile that comes closer than ``reach``.

    Both sides are settled tables with a key column ``key`` and ``vec``.
    """
    base, tiles = make_tiles(base, *_tile_size(queries, base, tile))

    def choose(low, near, frame):
        return np.ones(low.shape, dtype=bool) if reach is None else low <= reach + SLACK

    return meet(with_visits(queries, tiles, choose), base, tiles, kernel, schema, merge)


def tile_search(
    queries: DataFrame, base: DataFrame, kernel, schema: str, needed: int, limit, tile: int = TILE, merge=None
) -> DataFrame:
    """``kernel`` (rows ``q``, ``score``, the best of a tile) on the tiles that can hold one of a query's ``needed`` best.

    ``limit``: Column of the distance that a ``score`` stands for. The tiles a query sees first bound what its others need;
    there the kernel finds the least score that still counts as ``floor``.
    """
    base, tiles = make_tiles(base, *_tile_size(queries, base, tile))
    near = with_visits(queries, tiles, lambda low, near, frame: tiles.home(near, needed))
    first = settle(meet(near, base, tiles, kernel, schema, merge))
    worst = ordering.top_per_group(first.select("q", "score"), ["q"], [F.desc("score")], needed, "rank")
    bounds = worst.groupBy(F.col("q").alias("key")).agg(limit(F.min("score")).alias("bound"), F.min("score").alias("floor"))
    bounded = queries.join(bounds, "key")

    def choose(low, near, frame):
        return (low <= frame["bound"].to_numpy()[:, None] + SLACK) & ~tiles.home(near, needed)

    rest = with_visits(bounded, tiles, choose).drop("bound")
    return first.unionByName(meet(rest, base, tiles, kernel, schema, merge))


def _chunks(q: np.ndarray, b: np.ndarray) -> list[slice]:
    """Rows of ``q`` to work on at once, so that ``q @ b.T`` stays small."""
    step = max(16, min(ROWS_AT_ONCE, ROWS_AT_ONCE * TILE // max(len(b), 1)))
    return [slice(at, at + step) for at in range(0, len(q), step)]


def _scores(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(q @ b.T, DIGITS)


def _distances(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By norms and a product: as exact as the vectors are long, good to choose by."""
    square = (q**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (q @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _rounding(q: np.ndarray, b: np.ndarray) -> float:
    """How far ``_distances`` can be off: the root of a rounding error of squares."""
    return 1e-7 * float(np.linalg.norm(q, axis=1).max() + np.linalg.norm(b, axis=1).max())


def _above(near: np.ndarray, floor: np.ndarray | None, slack: float, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the values that can be among the ``top`` of a row, ``slack`` below the last of them included."""
    if floor is not None:
        found = np.flatnonzero(near >= (floor - slack)[:, None])
        if len(found) <= 8 * top * len(near):
            return np.divmod(found, near.shape[1])
    edge = -np.partition(-near, top - 1, axis=1)[:, top - 1]
    edge = edge if floor is None else np.maximum(edge, floor)
    return np.divmod(np.flatnonzero(near >= (edge - slack)[:, None]), near.shape[1])


def _candidates(q: np.ndarray, b: np.ndarray, top: int, metric: str, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of all pairs that can be among the ``top`` of a row and do not score below its ``floor``."""
    if metric != "euclidean":
        s = q @ b.T
        row, col = _above(s, floor, ROUNDED, top)
        return row, col, np.round(s[row, col], DIGITS)
    row, col = _above(1.0 - _distances(q, b), floor, 2 * _rounding(q, b) + SLACK, top)
    exact = np.concatenate([
        np.sqrt(((q[row[x]] - b[col[x]]) ** 2).sum(axis=1)) for x in np.array_split(np.arange(len(row)), 1 + len(row) * q.shape[1] // GAPS_AT_ONCE)
    ])
    return row, col, np.round(1.0 - exact, DIGITS)


def _best_kernel(k: int, metric: str):
    """Per query (and base group) the k best of a tile, ties by key; and the same of several tiles' rows."""

    def merge(frame):
        by = ["q", "grp"] if "grp" in frame else ["q"]
        groups = [pd.factorize(frame[c])[0] for c in by]
        frame = frame.iloc[np.lexsort((frame["key"].to_numpy(), -frame["score"].to_numpy(), *groups[::-1]))]
        return frame[frame.groupby(by, sort=False).cumcount() < k]

    def best(q, b):
        groups = [(None, b)]
        if "grp" in b:
            codes, names = pd.factorize(b["grp"])
            groups = [(g, _only(b, np.flatnonzero(codes == i))) for i, g in enumerate(names)]
        out = [pd.DataFrame({c: [] for c in ("q", "key", "score", *(["grp"] if "grp" in b else []))}).astype({"q": "int64", "key": "int64"})]
        for g, part in groups:
            top = min(k, len(part["key"]))
            for x in _chunks(q["vec"], part["vec"]):
                row, col, score = _candidates(q["vec"][x], part["vec"], top, metric, q["floor"][x] if "floor" in q else None)
                # columns are in key order, so a stable sort leaves ties by key
                order = np.lexsort((-score, row))
                row, col, score = row[order], col[order], score[order]
                few = np.arange(len(row)) - np.searchsorted(row, row) < k
                chunk = {"q": q["key"][x][row[few]], "key": part["key"][col[few]], "score": score[few]}
                if g is not None:
                    chunk["grp"] = g
                out.append(pd.DataFrame(chunk))
        return pd.concat(out[1:] or out)

    return best, merge


def _with_digest(df: DataFrame) -> DataFrame:
    """Settled ``df`` with ``same``, equal for equal ``vec`` and not a floating number.

    Spark works out a floating key anew in every comparison of a sort, element by element; a SHA-256 of the
    numbers' text is worked out once.
    """
    return settle(df.withColumn("same", F.unhex(F.sha2(F.transform("vec", lambda x: x + F.lit(0.0)).cast("string"), 256))))


def _one_per_vector(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((key, vec, mult) one per distinct vector with its number of rows, (member, rep) of every row)."""
    rows = _with_digest(df.select(F.col(key).alias("member"), "vec"))
    reps = rows.groupBy("same").agg(F.min("member").alias("key"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("mult"))
    reps = settle(reps)
    members = ordering.join_hot(rows.select("member", "same"), reps.select("same", "key"), ["same"])
    return reps.select("key", "vec", "mult"), members.select("member", F.col("key").alias("rep"))


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "cosine",
    exclude_self: bool = True,
    group: str | None = None,
    tile: int = TILE,
) -> DataFrame:
    """(qid, id, score, rank[, group]): the ``k`` best base vectors of every query, ties by id.

    ``queries`` has (qid, vec), ``base`` (id, vec) and, if ``group`` is given, that column: then
    the ``k`` best of each group. ``metric`` is ``cosine``, ``dot`` or ``euclidean`` (score
    1 - distance). Null vectors are left out.
    """
    return nearest_of(queries, base, [k], metric, exclude_self, group, tile)[k]


def nearest_of(
    queries: DataFrame,
    base: DataFrame,
    ks: list[int],
    metric: str = "cosine",
    exclude_self: bool = True,
    group: str | None = None,
    tile: int = TILE,
) -> dict[int, DataFrame]:
    """``nearest`` for several ``k`` from one search, which looks for the most."""
    prepare = vectors.unit if metric == "cosine" else F.col
    q = queries.where(F.col("vec").isNotNull()).select("qid", prepare("vec").alias("vec"))
    extra = [F.col(group).alias("grp")] if group else []
    b = base.where(F.col("vec").isNotNull()).select(F.col("id").alias("key"), prepare("vec").alias("vec"), *extra)
    wanted = max(ks) + 1 if exclude_self else max(ks)
    # of equal vectors only the first few ids can ever be listed; they meet the queries once, as the first of them
    same = ["same", "grp"] if group else ["same"]
    b = settle(ordering.top_per_group(_with_digest(b), same, ["key"], wanted, "__rank"))
    copies = bool(b.where(F.col("__rank") > 1).head(1))
    firsts = b.where(F.col("__rank") == 1).drop("__rank")
    if copies:
        named = settle(firsts.withColumn("vid", F.monotonically_increasing_id()))
        ids = b.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("key"))).alias("ids"))
        met = [named[c].eqNullSafe(ids[c]) for c in same]
        ids = settle(named.join(ids, met).select("vid", "ids"))
        firsts = named
    firsts = firsts.drop("same")
    reps, members = _one_per_vector(q, "qid")
    reps = reps.drop("mult")
    types = dict(firsts.dtypes)
    schema = f"q {dict(reps.dtypes)['key']}, key {types['key']}, score double" + "".join(f", {c} {types[c]}" for c in ("grp", "vid") if c in types)
    kernel, merge = _best_kernel(wanted, metric)
    if metric == "dot" or group:  # no ball bounds a dot product, and a small group may lie anywhere
        found = tile_join(reps, firsts, kernel, schema, tile=tile, merge=merge)
    elif metric == "euclidean":
        found = tile_search(reps, firsts, kernel, schema, wanted, lambda s: 1 - s, tile, merge)
    else:  # of vectors of length 1, or with a zero vector of 0
        found = tile_search(reps, firsts, kernel, schema, wanted, lambda s: F.sqrt(F.greatest(2 - 2 * (s - ROUNDED), F.lit(0.0))), tile, merge)
    by = ["q", "grp"] if group else ["q"]
    best = ordering.top_per_group(found, by, [F.desc("score"), "key"], wanted, "rank")
    if copies:
        best = settle(best.drop("rank", "key"))
        full = ordering.join_hot(best, ids, ["vid"]).select(*by, "score", F.inline("ids"))
        best = ordering.top_per_group(full, by, [F.desc("score"), "key"], wanted, "rank")
    # one short list per distinct query vector (and group)
    lists = settle(
        best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "key", "score"))).alias("best"))
    )
    if group:
        joined = members.join(lists, members.rep == lists.q)
    else:
        joined = ordering.join_hot(settle(members), lists.withColumnRenamed("q", "rep"), ["rep"])
    joined = joined.withColumnRenamed("member", "qid")

    def first(k):
        items = F.slice("best", 1, k + 1 if exclude_self else k)
        items = F.filter(items, lambda c: c["key"] != F.col("qid")) if exclude_self else items
        return joined.select(
            "qid", *([F.col("grp").alias(group)] if group else []), F.posexplode(F.slice(items, 1, k)).alias("at", "hit")
        ).select(
            "qid",
            *([group] if group else []),
            F.col("hit.key").alias("id"),
            F.col("hit.score").alias("score"),
            (F.col("at") + 1).cast("int").alias("rank"),
        )

    return {k: first(k) for k in ks}


def knn(embeddings: DataFrame, k: int = 10, metric: str = "cosine", tile: int = TILE) -> DataFrame:
    """(qid, id, score, rank): ``nearest`` of a table (id, vec) against itself."""
    return nearest(embeddings.select(F.col("id").alias("qid"), "vec"), embeddings, k, metric, tile=tile)


def _weighted_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_one_per_vector`` of the vectors scaled to length 1."""
    return _one_per_vector(embeddings.select("id", vectors.unit("vec").alias("vec")), "id")


def count_within(embeddings: DataFrame, cut: float, tile: int = TILE) -> DataFrame:
    """(id, within): how many vectors, itself included, have a cosine above ``cut``."""
    reps, members = _weighted_vectors(embeddings)

    def count(q, b):
        within = np.concatenate([(_scores(q["vec"][x], b["vec"]) > cut) @ b["mult"] for x in _chunks(q["vec"], b["vec"])])
        return pd.DataFrame({"q": q["key"], "within": within})

    def merge(frame):
        return frame.groupby("q", as_index=False)["within"].sum()

    key = dict(reps.dtypes)["key"]
    reach = float(np.sqrt(max(0.0, 2 - 2 * (cut - ROUNDED))))
    parts = tile_join(reps, reps, count, f"q {key}, within bigint", reach=reach, tile=tile, merge=merge)
    totals = settle(parts.groupBy(F.col("q").alias("rep")).agg(F.sum("within").alias("within")))
    return ordering.join_hot(settle(members), totals, ["rep"], "left").select(
        F.col("member").alias("id"), F.coalesce("within", F.lit(0)).alias("within")
    )


def cosine_histogram(embeddings: DataFrame, bins: int = 50, tile: int = TILE) -> DataFrame:
    """(bin, lo, hi, n, density) of the cosines of all ordered pairs, self pairs included.

    Tiles return a range, then ``bins`` counts; the pairs themselves stay inside the tiles.
    """
    reps, _ = _weighted_vectors(embeddings)

    def spread(q, b):
        lows, highs = [], []
        for x in _chunks(q["vec"], b["vec"]):
            s = _scores(q["vec"][x], b["vec"])
            lows.append(s.min())
            highs.append(s.max())
        return pd.DataFrame({"lo": [min(lows)], "hi": [max(highs)]})

    ends = tile_join(reps, reps, spread, "lo double, hi double", tile=tile).agg(F.min("lo"), F.max("hi")).first()
    lo, hi = float(ends[0]), float(ends[1])
    width = (hi - lo) / bins

    def tally(q, b):
        counts = np.zeros(bins)
        for x in _chunks(q["vec"], b["vec"]):
            s = _scores(q["vec"][x], b["vec"])
            spot = np.minimum(np.floor((s - lo) / width), bins - 1).astype(int)
            weight = np.outer(q["mult"][x], b["mult"])
            counts += np.bincount(spot.ravel(), weights=weight.ravel(), minlength=bins)
        return pd.DataFrame({"bin": np.arange(bins), "n": counts.round().astype("int64")})

    counts = tile_join(reps, reps, tally, "bin int, n bigint", tile=tile).groupBy("bin").agg(F.sum("n").alias("n"))
    total = reps.agg((F.sum("mult") * F.sum("mult")).alias("t")).scalar()
    return counts.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        "n",
        (F.col("n") / (total * F.lit(width))).alias("density"),
    )


def neighbour_lists(knn_table: DataFrame) -> DataFrame:
    """(id, nbrs): the listed ids of each query in rank order, one row per query."""
    return knn_table.groupBy(F.col("qid").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("nbrs")
    )
