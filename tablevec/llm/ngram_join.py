"""Similarity join of documents on word n-grams, by group counts.

A document is its set of hashed n-grams; two link if their Jaccard similarity is at least ``percent``.

1. Equal ranges of the hash space are groups. Linked sets differ in at most d n-grams, so with G groups
   at least G - d are equal in both; G follows from the larger set's size class and exceeds d by a fifth.
   Documents that agree on a whole group meet in a block, linked ones in many.
2. Round one verifies each document with the lowest document of a block that it shares most blocks with.
   So a group of many copies costs one comparison a copy, and what is linked is one component.
3. Round two takes the pairs of documents in a block that are not in one component yet. The counts of 32
   groups are a document's point; the overlap of two documents is at most the sum of the coordinate minima
   of their points, of two boxes of points that of their upper corners. An R-tree over a block's points
   drops what stays below the overlap that a link needs, and pairs must share as many blocks as a link
   would. What is left is verified exactly on the whole sets, so every component is whole.
   Pairs that the 32 groups let through must also pass the same bound over ``FINE`` groups before they leave.

Components are complete; pairs inside one that are not needed to connect it are not looked at, so links are not
counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablevec.llm.batches import Cache, lean, slices, small_batches
from tablevec.llm.documents import known_ids
from tablevec.session import settle

POINT = 32
FINE = 512
CACHED_WORDS = 200_000
CACHED_SETS = 100_000
CLASS_GROWTH = 1.41
HUB_PAIRS = 2048
HELD_ROWS = 200_000
LARGEST = 1 << 40
CLASS_BITS = 7
CROWD = 32
LEAF = 16
PAIRS_AT_ONCE = 256  # of boxes; LEAF ** 2 times as many of their children are compared at once
HASH_BYTES = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct n-gram hashes of texts; A-Z lower-cased, words end at ASCII blanks."""

    def __init__(self, words: int):
        self.words = words
        self.known = Cache(CACHED_WORDS)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        split = [t.encode().lower().split() if t else [] for t in texts]
        new = self.known.missing(set().union(*split))
        if len(self.known) + len(new) > self.known.most:
            self.known.make_room(len(new))
            new = set().union(*split)
        digest = xxhash.xxh3_64_intdigest
        self.known.update((w, digest(w)) for w in new)
        get = self.known.__getitem__
        for words in split:
            h = np.fromiter(map(get, words), dtype=np.uint64, count=len(words))
            n = min(self.words, len(h))
            if not n:
                yield h
                continue
            total = np.full(len(h) - n + 1, n, dtype=np.uint64)  # a short text's n-gram is no part of a longer one's
            for i in range(n):
                total = _mix(total + h[i : len(h) - n + 1 + i])
            yield np.unique(total)


@cache
def class_table(percent: int) -> np.ndarray:
    """Rows (upper, differ, margin, spare) of the size classes; a class holds sizes above the upper before.

    ``differ`` is the largest number of n-grams in which linked sets can differ if the larger one is in
    the class, ``margin`` the number of groups beyond that, ``spare`` that of groups for such as are empty in
    both sets and say nothing.
    """
    rows, upper = [], 1
    while upper < LARGEST:
        differ = (100 - percent) * 2 * upper // (100 + percent)
        rows.append((upper, differ, 3 + differ // 5, 2 + differ // 50))
        upper = max(upper + 1, int(upper * CLASS_GROWTH))
    return np.array(rows, dtype=np.int64)


def class_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.searchsorted(class_table(percent)[:, 0], sizes)


def needed_blocks(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many blocks of the larger one's class two linked sets of these sizes share at least."""
    _, differ, margin, _ = class_table(percent)[class_of(np.maximum(a, b), percent)].T
    return differ + margin - (100 - percent) * (a + b) // (100 + percent)


def block_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """A key for each group of a sorted set, in each class where it may be linked; the last bits are the class."""
    out = []
    table = class_table(percent)
    for number in range(int(class_of(len(hashes), percent)), int(class_of(100 * len(hashes) // percent, percent)) + 1):
        _, differ, margin, spare = table[number].tolist()
        if not differ:  # only equal sets link
            continue
        groups = differ + margin + spare
        group = ((hashes >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        label = group[first] + np.uint64(number << 40)
        keys = [_mix(np.add.reduceat(_mix(hashes), first) + _mix(label))]
        if groups - len(first) > spare:  # so many empty groups that only these might agree
            empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), group[first]) + np.uint64(number << 40)
            keys.append(_mix(_mix(empty) + np.uint64(1)))
        out.append((np.concatenate(keys) << np.uint64(CLASS_BITS)) | np.uint64(number))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def point_of(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(59)).astype(np.int64), minlength=POINT).astype("<u4")


def fine_of(hashes: np.ndarray) -> bytes:
    """Counts of ``FINE`` groups, one byte each if that is enough, else four."""
    counts = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=FINE)
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def fine_rows(points: list[bytes]) -> np.ndarray:
    wide = any(len(x) > FINE for x in points)
    if not wide:
        return np.frombuffer(b"".join(points), dtype="<u1").reshape(-1, FINE)
    return np.stack([np.frombuffer(x, dtype="<u1" if len(x) == FINE else "<u4").astype("<u4") for x in points])


ROWS = "key long, node long, size long, point binary, fine binary, same long"


def _batch(key, node, size, point, fine, same) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(point, pa.binary()),
         pa.array(fine, pa.binary()), pa.array(same, pa.int64())],
        ["key", "node", "size", "point", "fine", "same"],
    )


def make_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A row with size and point for each document, and one without for each of its block keys.

    The key of the first kind is the document's content. Of equal documents in one task only the first
    meets others; the rest name it as ``same`` and are dealt out by their node.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), Cache(CACHED_SETS)
        for batch in slices(batches, 256):
            nodes = batch.column("node").to_numpy()
            spread = _mix(nodes.view(np.uint64)).view(np.int64)
            sizes, points, fine, content, same, keys, of = [], [], [], [], [], [], []
            for i, hashes in enumerate(shingler.sets(batch.column("text").to_pylist())):
                sizes.append(len(hashes))
                points.append(point_of(hashes).tobytes())
                fine.append(fine_of(hashes))
                own = int((_mix(hashes).sum() + np.uint64(len(hashes))).view(np.int64))
                met = seen.get(own) if len(hashes) else None
                same.append(met)
                content.append(spread[i] if met is not None or not len(hashes) else own)
                if len(hashes) and met is None:
                    seen.make_room(1)
                    seen[own] = int(nodes[i])
                    keys.append(block_keys(hashes, percent).view(np.int64))
                    of.append(np.full(len(keys[-1]), nodes[i]))
            yield _batch(content, nodes, sizes, points, fine, same)
            if keys:
                key, node = np.concatenate(keys), np.concatenate(of)
                for start in range(0, len(key), 20_000):
                    n = len(key[start : start + 20_000])
                    yield _batch(key[start : start + n], node[start : start + n], np.zeros(n, dtype=np.int64), *[[None] * n] * 3)

    return docs.select("node", "text").mapInArrow(lean(work), ROWS)


MET = "kind int, key long, node long, first long, size long, n long, point binary, fine binary"


def meet(rows: DataFrame) -> DataFrame:
    """From rows sorted by (point is null, key, node), whole keys to a task.

    kind 0: a document, ``first`` the lowest node of the same content; kind 3: a document, ``first`` an equal one
    of its task. kind 1: a block's lowest node (``first``) and another met ``n`` times in class ``key``, ``size``
    of these without a third. kind 2: members of blocks of ``size``, three or more, one block for all ``n`` that
    have the same members in some stretch of rows.
    """

    def out(kind, key, node, first, size, n, *points) -> pa.RecordBatch:
        rows = len(node)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, kind, dtype=np.int32)), *[pa.array(x, pa.int64()) for x in (key, node, first, size, n)],
             *(points or [pa.nulls(rows, pa.binary())] * 2)],
            [x.split(" ")[0] for x in MET.split(", ")],
        )

    def blocks(key: np.ndarray, node: np.ndarray, part: bool) -> Iterator[pa.RecordBatch]:
        """``part``: the rows are a piece of one very large block."""
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        kind = key & ((1 << CLASS_BITS) - 1)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        first, alone = np.repeat(node[start], size), np.repeat((size == 2) & (not part), size)
        other = first != node
        if other.any():
            order = np.lexsort((node[other], first[other], kind[other]))
            k, f, v, two = (x[other][order] for x in (kind, first, node, alone))
            at = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1]) | (v[1:] != v[:-1]))))
            yield out(1, k[at], v[at], f[at], np.add.reduceat(two.astype(np.int64), at), np.diff(np.append(at, len(k))))
        if part:
            ones = np.ones(len(key), dtype=np.int64)
            yield out(2, key, node, first, HELD_ROWS * ones, ones)
        elif (size > 2).any():
            members = np.add.reduceat(_mix(node.view(np.uint64)), start) + _mix(kind[start].astype(np.uint64))
            large = np.flatnonzero(size > 2)
            _, at, n = np.unique(members[large], return_index=True, return_counts=True)
            times = np.zeros(len(start), dtype=np.int64)
            times[large[at]] = n
            times = np.repeat(times, size)
            rows = times > 0
            yield out(2, key[rows], node[rows], first[rows], np.repeat(size, size)[rows], times[rows])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # content and lowest node of the last document row
        held: list[tuple[np.ndarray, np.ndarray]] = []
        large = None  # key and lowest node of a very large block that may go on

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, large
            key, node = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
            held = []
            if large is not None:
                end = int(np.searchsorted(key, large[0], side="right"))
                if end:
                    yield from blocks(np.append(key[:1], key[:end]), np.append(large[1], node[:end]), True)
                key, node = key[end:], node[end:]
                large = None if len(key) else large
            cut = len(key) if final or not len(key) else int(np.searchsorted(key, key[-1]))
            if cut:
                yield from blocks(key[:cut], node[:cut], False)
            key, node = key[cut:], node[cut:]
            if len(key) >= HELD_ROWS:
                yield from blocks(key, node, True)
                large = key[0], node[0]
            elif len(key):
                held = [(key, node)]

        for batch in batches:
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            point = batch.column("point")
            every = point.is_valid().to_numpy(zero_copy_only=False)
            follows = batch.column("same").is_valid().to_numpy(zero_copy_only=False)
            size = batch.column("size").to_numpy()
            if follows.any():
                to = batch.column("same").filter(pa.array(follows)).to_numpy()
                yield out(3, key[follows], node[follows], to, size[follows], size[follows], *[batch.column(c).filter(pa.array(follows)) for c in ("point", "fine")])
            docs = every & ~follows
            if docs.any():
                k, v = key[docs], node[docs]
                opens = np.ones(len(k), dtype=bool)
                opens[1:] = k[1:] != k[:-1]
                head = v[np.maximum.accumulate(np.where(opens, np.arange(len(k)), 0))]
                if last is not None:
                    head[k == last[0]] = last[1]
                last = k[-1], head[-1]
                yield out(0, k, v, head, size[docs], size[docs], *[batch.column(c).filter(pa.array(docs)) for c in ("point", "fine")])
            if every.all():
                continue
            held.append((key[~every], node[~every]))
            if sum(len(k) for k, _ in held) >= HELD_ROWS:
                yield from flush(False)
        if held:
            yield from flush(True)

    return rows.mapInArrow(lean(work), MET)


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap of sets of sizes a and b is that of a link."""
    return (100 + percent) * overlap.astype(np.int64) >= percent * (a + b)


def crowded(members: DataFrame, percent: int) -> DataFrame:
    """``members`` with ``over``: whether a document does without this block.

    In each class it may leave out half of the margin of its largest blocks, if over ``CROWD`` documents are in
    them: linked documents still meet in others, and a passage that many documents share brings no pairs.
    """
    allowed = F.array(*[F.lit(x) for x in (class_table(percent)[:, 2] // 2).tolist()])
    largest = Window.partitionBy("node", "kind").orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("key").bitwiseAND((1 << CLASS_BITS) - 1)
    out = members.withColumn("kind", kind).withColumn("__sum", F.sum("n").over(largest))
    return out.withColumn("over", (F.col("size") > CROWD) & (F.col("__sum") <= F.get(allowed, F.col("kind").cast("int")))).drop("__sum")


def possible(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(a, b, n) of pairs (a, b, kind, n) that met ``n`` times in class ``kind``, blocks that they did without
    included: those in the class of the larger one, met as often as a link needs, whose points allow one."""
    sides = pairs
    for x in ("a", "b"):
        sides = sides.join(points.select(
            F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("point").alias(f"point_{x}")
        ), x)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            p, q = (_matrix(batch.column(f"point_{x}")) for x in "ab")
            keep = class_of(np.maximum(x, y), percent) == batch.column("kind").to_numpy()
            keep &= batch.column("n").to_numpy() >= needed_blocks(x, y, percent)
            keep &= enough(np.minimum(p, q).sum(axis=1), x, y, percent)
            yield batch.select(["a", "b", "n"]).filter(pa.array(keep))

    return sides.mapInArrow(lean(work), "a long, b long, n long")


def _matrix(points: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(points.to_pylist()), dtype="<u4").reshape(-1, POINT)


def tree_pairs(points: np.ndarray, sizes: np.ndarray, components: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (i, j) of different components that the bound allows, by an R-tree over the points against itself.

    The tree is packed: components in order of their least size, in each the points by size, then by their
    coordinates, ``LEAF`` to a box, boxes the same way. A box is its upper corner and least size: its best
    overlap with another box is the sum of the coordinate minima of both corners, and the least that a link
    needs grows with the sizes. Two boxes of one and the same component need no look.
    """
    _, label = np.unique(components, return_inverse=True)
    start = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(start, label, sizes)
    order = np.lexsort((*points.T[:4], sizes, label, start[label]))
    only = label[order]
    levels = [(points[order].astype(np.int64), sizes[order], only, only)]
    while len(levels[-1][1]) > 1:
        corner, least, low, high = levels[-1]
        cuts = np.arange(0, len(least), LEAF)
        levels.append((
            np.maximum.reduceat(corner, cuts), np.minimum.reduceat(least, cuts), np.minimum.reduceat(low, cuts),
            np.maximum.reduceat(high, cuts),
        ))
    pairs = np.zeros((1, 2), dtype=np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        corner, least, low, high = levels[depth]
        found = []
        for part in np.array_split(pairs, 1 + len(pairs) // PAIRS_AT_ONCE):
            if depth < len(levels) - 1:
                part = _children(part, len(least))
            a, b = part.T
            part = part[(low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])]
            a, b = part.T
            ok = enough(np.minimum(corner[a], corner[b]).sum(axis=1), least[a], least[b], percent)
            found.append(part[ok])
        pairs = np.concatenate(found)
    return order[pairs]


def _children(pairs: np.ndarray, n: int) -> np.ndarray:
    """Pairs of the children of paired boxes, each once, of the ``n`` entries of the level below."""
    steps = np.arange(LEAF)
    a = np.repeat(pairs[:, 0] * LEAF, LEAF * LEAF).reshape(-1, LEAF, LEAF) + steps[None, :, None]
    b = np.repeat(pairs[:, 1] * LEAF, LEAF * LEAF).reshape(-1, LEAF, LEAF) + steps[None, None, :]
    both = np.stack([a.ravel(), b.ravel()], axis=1)
    return both[(both[:, 0] <= both[:, 1]) & (both[:, 1] < n)]


def across(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, kind, n): pairs of different components in a block, from rows (key, node, component, n, size, point, fine)
    with the rows of a key together."""

    def pairs(key, node, component, n, size, points, fine) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(start, len(key)))
        mixed = np.minimum.reduceat(component, start) != np.maximum.reduceat(component, start)
        start, length = start[mixed], length[mixed]
        found = []
        for m in np.unique(length[length <= CROWD]).tolist():  # small blocks of one length together
            i, j = np.triu_indices(m, 1)
            for some in np.array_split(start[length == m], 1 + (length == m).sum() * len(i) // 200_000):
                a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                keep = component[a] != component[b]
                a, b = a[keep], b[keep]
                keep = enough(np.minimum(points[a], points[b]).sum(axis=1), size[a], size[b], percent)
                found.append(np.stack([a[keep], b[keep]], axis=1))
        for at, m in zip(start[length > CROWD], length[length > CROWD], strict=True):
            found.append(at + tree_pairs(points[at : at + m], size[at : at + m], component[at : at + m], percent))
        for part in found:
            kind = key[part[:, 0]] & ((1 << CLASS_BITS) - 1)
            part, kind = (x[class_of(size[part].max(axis=1), percent) == kind] for x in (part, kind))
            for some in np.array_split(np.arange(len(part)), 1 + len(part) // 8192):
                a, b = part[some].T
                sharp = np.minimum(fine_rows(fine[a]), fine_rows(fine[b])).sum(axis=1, dtype=np.int64)
                some = some[enough(sharp, size[a], size[b], percent)]
                ends = node[part[some]]
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in (ends.min(axis=1), ends.max(axis=1), kind[some], n[part[some, 0]])],
                        ["a", "b", "kind", "n"],
                    )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("key", "node", "component", "n", "size")]
            columns.append(_matrix(batch.column("point")))
            fine = np.empty(batch.num_rows, dtype=object)
            fine[:] = batch.column("fine").to_pylist()
            columns.append(fine)
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last block may go on
            if cut:
                yield from pairs(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from pairs(*held)

    return members.mapInArrow(lean(work), "a long, b long, kind long, n long")


def meetings(pairs: DataFrame) -> DataFrame:
    """(node, at): for each node of the pairs (a, b) the hubs (a, piece, side) where its set is wanted.

    A hub's partners are dealt out to pieces of about ``HUB_PAIRS``, each of which also gets the hub's own set.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("__pieces"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "__pieces").alias("piece"))
    partner = dealt.select(F.col("b").alias("node"), F.struct("a", "piece", F.lit(1).alias("side")).alias("at"))
    hub = dealt.select("a", "piece").distinct().select(F.col("a").alias("node"), F.struct("a", "piece", F.lit(0).alias("side")).alias("at"))
    return settle(partner.unionAll(hub).groupBy("node").agg(F.collect_list("at").alias("at")))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(node, data): compressed texts, for the shuffle that joins them."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 1024):
            data = [pack((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(data, pa.binary())], ["node", "data"])

    return docs.select("node", "text").mapInArrow(lean(work), "node long, data binary")


def make_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, at, hashes) of rows (node, at, data): each document's sorted set, 48 bits a hash."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, unpack = Shingler(words), zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 256):
            texts = [unpack(x).decode() for x in batch.column("data").to_pylist()]
            packed = [
                np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()
                for h in shingler.sets(texts)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("at"), pa.array(packed, pa.binary())], ["node", "at", "hashes"]
            )

    rows = docs.select("node", "at", "data")
    return rows.mapInArrow(lean(work), rows.select("node", "at", F.lit(b"").alias("hashes")).schema)


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // HASH_BYTES, 8), dtype=np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, HASH_BYTES)
    return wide.reshape(-1).view("<u8")


def verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    sets = make_sets(packed_texts(docs).join(meetings(pairs), "node"), words)
    met = sets.select("node", F.explode("at").alias("at"), "hashes").select("at.*", "node", "hashes")
    met = met.repartition("a", "piece").sortWithinPartitions("a", "piece", "side", "node")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            a_out, b_out = [], []
            columns = [batch.column(c).to_pylist() for c in ("a", "side", "node", "hashes")]
            for a, side, node, data in zip(*columns, strict=True):
                if side == 0:
                    hub = _unpack(data)
                    continue
                own = _unpack(data)
                both = np.concatenate((hub, own))
                both.sort(kind="stable")
                overlap = np.count_nonzero(both[1:] == both[:-1])
                if (100 + percent) * overlap >= percent * (len(hub) + len(own)):
                    a_out.append(a)
                    b_out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return met.mapInArrow(lean(work), "a long, b long")


def connect(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots: the lowest node it is connected with.

    Alternating large and small stars; each round is written to the shared folder.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the lowest neighbour of a node is itself a neighbour from below
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = settle(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def similar_documents(
    df: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    ``component_id``: the smallest id reachable by links, its own included. Fewer than ``words`` words make one
    n-gram, the whole sequence; without words, or with a null text, the set is empty and links with nothing.
    Nulls: a row with a null id takes the smallest id of its component, null if there is none. Repeated rows
    and equal texts link (unless empty); rows with one id but different texts are judged apart. An empty table
    gives no rows. Extra columns are not read.
    """
    docs = known_ids(small_batches(df), text, key)
    docs = docs.select("key", F.when(F.col("tie") == 0, F.col("id")).otherwise(F.xxhash64("id", "text")).alias("node"), "text")
    rows = make_rows(docs, words, percent).repartition("key")
    met = settle(meet(rows.sortWithinPartitions(F.col("point").isNull(), "key", "node")))
    documents = met.where("kind = 0").select("node", "first", "size", "point", "fine")
    points = settle(documents.where("node = first").select("node", "size", "point", "fine").distinct())
    heads = documents.select("node", "first")
    names = heads.unionAll(  # a node and what stands for its content
        met.where("kind = 3").select("node", F.col("first").alias("to")).join(heads.withColumnRenamed("node", "to"), "to").select("node", "first")
    )
    names = settle(names.distinct())

    met_pairs = met.where("kind = 1").groupBy("first", "node", "key").agg(F.sum("size").alias("alone"), F.sum("n").alias("n"))
    met_pairs = met_pairs.select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("key").alias("kind"), "alone", "n")
    for x in ("a", "b"):  # between representatives
        met_pairs = met_pairs.join(names.select(F.col("node").alias(x), F.col("first").alias(f"__{x}")), x).drop(x)
    met_pairs = settle(
        met_pairs.where("__a <> __b").groupBy(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"), "kind")
        .agg(F.sum("alone").alias("alone"), F.sum("n").alias("n"))
    )

    def best(pairs: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "a")
        return pairs.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == 1).drop("__r")

    # one lowest document for each, so that a crowd of copies has no more pairs than members
    stars = possible(best(met_pairs.drop("alone"), "b", "kind"), points, percent)
    chosen = settle(best(stars, "b").select("a", "b"))
    links = settle(verify(chosen, docs, words, percent).distinct())

    # pairs in blocks that are not yet one component
    roots = connect(links)
    component = names.join(roots.withColumnRenamed("node", "first"), "first", "left").select("node", "first", F.coalesce("root", "first").alias("component"))
    members = crowded(met.where("kind = 2").select("key", "node", "size", "n").join(component, "node"), percent)
    members = settle(members.select("key", F.col("first").alias("node"), "component", "n", "kind", "over"))
    missed = members.where("over").groupBy("node", "kind").agg(F.sum("n").alias("__n"))
    missed = settle(missed)
    members = members.where("NOT over").select("key", "node", "component", "n")
    mixed = members.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h").select("key")
    members = members.join(settle(mixed), "key", "left_semi").join(points, "node")
    more = across(members.repartition("key").sortWithinPartitions("key", "node"), percent)
    ends = component.where("node = first").select("node", "component")
    alone = met_pairs.where("alone > 0").select("a", "b", "kind", F.col("alone").alias("n"))
    for x in ("a", "b"):
        alone = alone.join(ends.select(F.col("node").alias(x), F.col("component").alias(f"__{x}")), x)
    more = more.unionByName(alone.where("__a <> __b").select("a", "b", "kind", "n"))
    more = more.groupBy("a", "b", "kind").agg(F.sum("n").alias("n"))
    for x in ("a", "b"):
        more = more.join(missed.select(F.col("node").alias(x), "kind", F.col("__n").alias(f"__{x}")), [x, "kind"], "left")
    more = more.select("a", "b", "kind", (F.col("n") + F.coalesce("__a", F.lit(0)) + F.coalesce("__b", F.lit(0))).alias("n"))
    more = settle(possible(more, points, percent).select("a", "b").join(chosen, ["a", "b"], "left_anti").distinct())
    links = settle(links.unionByName(verify(more, docs, words, percent).distinct()))
    roots = connect(links)
    component = names.join(roots.withColumnRenamed("node", "first"), "first", "left").select("node", F.coalesce("root", "first").alias("root"))
    keys = docs.select("key", "node")
    placed = keys.join(component, "node", "left")
    lowest = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("key").alias("component_id"))
    sizes = met.where("kind IN (0, 3)").select("node", "size").distinct()
    out = placed.join(lowest, "root", "left").join(sizes, "node").withColumn(
        "component_id", F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component_id"))
    )
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component.

    Of repeated rows one stays. Rows with one id but different texts all stay if the id is the smallest; rows
    with a null id go if they link to a row with one. Columns and other rows are untouched.
    """
    found = similar_documents(df, words, percent, text, key)
    lowest = found.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lowest = settle(lowest.toDF("id", "n"))
    rows, stay = df.alias("rows"), lowest.alias("stay")  # names of the table's own can't clash
    same = F.col(f"rows.`{key}`").eqNullSafe(F.col("stay.id"))
    single = rows.join(stay.where("stay.n = 1"), same, "left_semi")
    repeated = rows.join(stay.where("stay.n > 1"), same, "left_semi")  # usually none, which Spark sees from the written table
    return single.unionByName(repeated.dropDuplicates([key, text]))
