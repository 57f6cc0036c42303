"""Phrases whose words occur together more often than apart, by direct-address tiling.

1. Texts are cut into words and stored as chunks of local word numbers, one language a chunk.
2. The frequent words of a language get ids by frequency. Two neighbouring ids are a cell of the matrix
   id x id, which is cut into tiles of ``SIDE`` x ``SIDE`` cells. Each chunk counts its cells by tile: a crowded
   tile with a dense ``numpy.bincount``, all sparse ones together as sorted coordinates.
3. Tiles are summed in two steps, first over salted lots of chunks, so a tile that every chunk holds is no
   single task's work. The frequent cells are the frequent phrases of two words.
4. These get ids by frequency in their turn, every chunk replaces neighbours by them, and the same step
   counts phrases one word longer: neighbouring phrases of m words that overlap are one of m + 1 words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablevec.functions.ordering import number_rows
from tablevec.llm.batches import lean, slices, small_batches
from tablevec.session import discard, settle

SIDE = 1024
CHUNK_TOKENS = 1 << 21  # of a language in a task; the larger, the fewer chunks repeat a word or a cell
DENSE = SIDE * SIDE // 16
OUT_BYTES = 8_000_000
MERGED = 4
SHORT = 64
WIDTHS = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}
SQUEEZED = 16
NO_LANG = "und"
# fixed values: what ends a piece, and what separates words (a tab counts as a space)
BREAKS = b".,;:!?\n\x0b\x0c\r"
CUT = bytes.maketrans(BREAKS + b"\t", b"." * len(BREAKS) + b" ")

CHUNKS = "chunk long, lang string, places binary, symbols binary, ids binary"
TILE = ["lang", "ti", "tj"]


def split_words(text: str | None) -> list[bytes]:
    """Words in order, A-Z lower-cased, ``.`` between pieces and at the end."""
    return [*(text or "").encode().lower().translate(CUT).replace(b".", b" . ").split(), b"."]


def squeeze(x: np.ndarray) -> bytes:
    """The bytes of ``x``, first those of all numbers' lowest places and so on, compressed; small numbers take little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers from 0 up, as wide as the largest needs, squeezed unless they are few; the first byte says how."""
    width = next(w for w, kind in WIDTHS.items() if x.max(initial=0) <= np.iinfo(kind).max)
    x = x.astype(WIDTHS[width])
    return bytes([width]) + x.tobytes() if len(x) < SHORT else bytes([SQUEEZED + width]) + squeeze(x)


def unpack_numbers(data: bytes) -> np.ndarray:
    kind = WIDTHS[data[0] % SQUEEZED]
    return (expand(data[1:], kind) if data[0] >= SQUEEZED else np.frombuffer(data, dtype=kind, offset=1)).astype(np.int64)


def pack_codes(code: np.ndarray) -> bytes:
    """Ascending codes of a tile, as gaps."""
    return pack_numbers(np.diff(code, prepend=0))


def unpack_codes(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data))


def read_chunks(df: DataFrame, text: str, lang: str, tokens: int) -> DataFrame:
    """(chunk, lang, symbols, words, counts): local word numbers (-1 between pieces), squeezed, the words, how often each.

    A chunk ends with the text that brings it to ``tokens`` words.
    """
    rows = small_batches(df).select(F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text"))
    # a task makes a chunk of each of its languages at least, so small tasks repeat more words and cells
    parts, cores = rows.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(max(1, min(parts, max(2 * cores, parts // MERGED))))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        length: dict[str, int] = {}

        def close(name: str) -> pa.RecordBatch:
            nonlocal made
            known, parts = held.pop(name)
            symbols = np.concatenate(parts)
            counts = np.bincount(symbols[symbols >= 0], minlength=len(known) - 1)
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made - 1]), pa.array([name]), pa.array([squeeze(symbols)], pa.binary()),
                 pa.array([[w.decode() for w in list(known)[1:]]], pa.list_(pa.string())),
                 pa.array([counts.tolist()], pa.list_(pa.int64()))],
                ["chunk", "lang", "symbols", "words", "counts"],
            )

        for batch in slices(batches, 64):
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                known, parts = held.setdefault(name, ({b".": -1}, []))
                words = split_words(body)
                for w in set(words):
                    if w not in known:
                        known[w] = len(known) - 1
                parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
                length[name] = length.get(name, 0) + len(words)
                if length[name] >= tokens:
                    del length[name]
                    yield close(name)
        for name in sorted(held):
            yield close(name)

    return rows.mapInArrow(lean(work), "chunk long, lang string, symbols binary, words array<string>, counts array<long>")


def relabel(places: np.ndarray, symbols: np.ndarray, old: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, symbols, ids): each symbol ``old[i]`` becomes the rank of ``ids[i]`` among the sorted ids, any other goes."""
    order = np.argsort(ids)
    rank = np.full(max(int(symbols.max(initial=-1)), int(old.max(initial=-1))) + 2, -1, dtype=np.int32)  # the last is for -1
    rank[old[order]] = np.arange(len(order), dtype=np.int32)
    symbols = rank[symbols]
    there = symbols >= 0
    return places[there], symbols[there], ids[order]


def neighbours(places: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first, first, second) of every two symbols side by side."""
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    return places[at], symbols[at], symbols[at + 1]


def first_symbols(chunks: DataFrame, frequent: DataFrame) -> DataFrame:
    """Chunks whose symbols are frequent words; the others are gone."""
    words = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    hits = words.join(frequent.select("lang", "word", "id"), ["lang", "word"])
    hits = hits.groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("hits"))  # at most a chunk's words

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column("hits")[i].values
                old, ids = (found.field(x).to_numpy().astype(np.int64) for x in ("at", "id"))
                symbols = expand(batch.column("symbols")[i].as_py(), np.int32)
                yield _chunk(batch, i, *relabel(np.arange(len(symbols), dtype=np.int32), symbols, old, ids))

    return chunks.select("chunk", "lang", "symbols").join(hits, "chunk").mapInArrow(lean(work), CHUNKS)


def _chunk(batch: pa.RecordBatch, i: int, places: np.ndarray, symbols: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    gaps = np.diff(places, prepend=np.int32(0))
    return pa.RecordBatch.from_arrays(
        [batch.column("chunk").slice(i, 1), batch.column("lang").slice(i, 1), *[pa.array([squeeze(x)], pa.binary()) for x in (gaps, symbols, ids)]],
        ["chunk", "lang", "places", "symbols", "ids"],
    )


def _read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = {"places": np.int32, "symbols": np.int32, "ids": np.int64}
    gaps, symbols, ids = (expand(batch.column(c)[i].as_py(), x) for c, x in kinds.items())
    return np.cumsum(gaps, dtype=np.int32), symbols, ids


def pack_counts(counts: np.ndarray) -> bytes:
    return counts.astype(next(x for x in ("<u1", "<u2", "<u4", "<i8") if counts.max() <= np.iinfo(x).max)).tobytes()


def unpack_cells(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(codes, dtype="<u4")
    width = len(counts) // len(code)
    return code, np.frombuffer(counts, dtype="<i8" if width == 8 else f"<u{width}").astype(np.int64)


def count_tiles(chunks: DataFrame) -> DataFrame:
    """(chunk, lang, ti, tj, codes, counts): the cells of each tile that neighbours of a chunk fall into.

    ``codes``: row * SIDE + column within the tile, ascending; both packed.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places, symbols, ids = _read(batch, i)
                _, a, b = neighbours(places, symbols)
                stripes, stripe = np.unique(ids // SIDE, return_inverse=True)
                stripe = stripe.astype(np.int32 if len(stripes) < 1 << 15 else np.int64)
                tile = stripe[a] * stripe.dtype.type(len(stripes)) + stripe[b]
                within = (ids % SIDE).astype(np.int32)
                code = within[a] * np.int32(SIDE) + within[b]
                del places, symbols, a, b
                order = np.argsort(tile, kind="stable")
                tile, code = tile[order], code[order]
                del order
                start = np.flatnonzero(np.diff(tile, prepend=-1))
                size = np.diff(np.append(start, len(tile)))
                found = []  # (tile, code, count), a tile's codes together
                for at, n in zip(start[size >= DENSE].tolist(), size[size >= DENSE].tolist(), strict=True):
                    cells = np.bincount(code[at : at + n], minlength=SIDE * SIDE)
                    there = np.flatnonzero(cells)
                    found.append((np.full(len(there), tile[at]), there, cells[there]))
                few = np.repeat(size < DENSE, size)
                cell, n = np.unique(tile[few].astype(np.int64) * (SIDE * SIDE) + code[few], return_counts=True)
                found.append((cell // (SIDE * SIDE), cell % (SIDE * SIDE), n))
                tile, code, n = (np.concatenate(x) for x in zip(*found, strict=True))
                start = np.flatnonzero(np.diff(tile, prepend=-1))
                edges = np.append(start, len(tile)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("chunk")[i].as_py()] * len(start), pa.int64()),
                     pa.array([batch.column("lang")[i].as_py()] * len(start), pa.string()),
                     pa.array(stripes[tile[start] // len(stripes)], pa.int64()), pa.array(stripes[tile[start] % len(stripes)], pa.int64()),
                     pa.array([pack_codes(code[x:y]) for x, y in pairwise(edges)], pa.binary()),
                     pa.array([pack_numbers(n[x:y]) for x, y in pairwise(edges)], pa.binary())],
                    ["chunk", *TILE, "codes", "counts"],
                )

    return chunks.mapInArrow(lean(work), "chunk long, lang string, ti long, tj long, codes binary, counts binary")


class TileSum:
    """The sum of one tile's rows: coordinates while they are few, then a dense array."""

    def __init__(self):
        self.parts: list[tuple[bytes, bytes]] = []
        self.size = 0
        self.cells: np.ndarray | None = None

    def _spread(self) -> None:
        for codes, counts in self.parts:
            code, n = unpack_cells(codes, counts)
            self.cells[code] += n  # a row names a cell once
        self.parts, self.size = [], 0

    def add(self, codes: bytes, counts: bytes) -> None:
        self.parts.append((codes, counts))
        self.size += len(codes) // 4
        if self.size >= DENSE and len(self.parts) > 1:
            if self.cells is None:
                self.cells = np.zeros(SIDE * SIDE, dtype=np.int64)
            self._spread()

    def total(self) -> tuple[bytes, bytes]:
        """(codes, counts), codes ascending."""
        if self.cells is not None:
            self._spread()
            code = np.flatnonzero(self.cells)
            n = self.cells[code]
        elif len(self.parts) == 1:
            return self.parts[0]
        else:
            code, n = (np.concatenate(x) for x in zip(*[unpack_cells(*x) for x in self.parts], strict=True))
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
            start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            code, n = code[start], np.add.reduceat(n, start)
        return code.astype("<u4").tobytes(), pack_counts(n)


def sum_tiles(tiles: DataFrame, keys: list[str], least: int | None = None) -> DataFrame:
    """Tiles with the same ``keys`` added up, one row held at a time; with ``least``, for keys ``TILE``, the cells
    (lang, a, b, n) that hold so many or more."""
    rows = tiles.select(*keys, "codes", "counts")
    names = rows.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, done, held, kinds = None, TileSum(), [], 0, None

        def out() -> pa.RecordBatch:
            if least is not None:
                lang, a, b, n = zip(*done, strict=True)
                lang = np.repeat(np.array(lang, dtype=object), [len(x) for x in n])
                return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), *[pa.array(np.concatenate(x)) for x in (a, b, n)]], ["lang", "a", "b", "n"])
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        def close() -> None:
            nonlocal held
            code, n = unpack_cells(*total.total())
            code = code.astype(np.int64)
            if least is None:
                done.append((*now, pack_codes(code), pack_numbers(n)))
                held += len(done[-1][-2]) + len(done[-1][-1])
                return
            code, n = code[n >= least], n[n >= least]
            if len(n):
                lang, ti, tj = now
                done.append((lang, ti * SIDE + code // SIDE, tj * SIDE + code % SIDE, n))
                held += 24 * len(n)

        for batch in slices(batches, 1024):
            kinds = [batch.schema.field(c).type for c in names]
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if row[:-2] != now:
                    if now is not None:
                        close()
                        if held > OUT_BYTES or len(done) >= 10_000:
                            yield out()
                            done, held = [], 0
                    now, total = row[:-2], TileSum()
                total.add(unpack_codes(row[-2]).astype("<u4").tobytes(), pack_counts(unpack_numbers(row[-1])))
        if now is not None:
            close()
        if done:
            yield out()

    schema = rows.schema if least is None else "lang string, a long, b long, n long"
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(work), schema)


def by_frequency(counts: DataFrame, order: list[str]) -> DataFrame:
    """``counts`` with ``id``: its place in its language by falling ``n``, then ``order``."""
    return settle(number_rows(counts.withColumn("__less", -F.col("n")), ["lang"], ["lang", "__less", *order], "id").drop("__less"))


def next_symbols(chunks: DataFrame, tiles: DataFrame, lots: DataFrame, frequent: DataFrame) -> DataFrame:
    """Chunks whose symbols are the frequent pairs of neighbours; chunks without any are gone.

    The frequent cells go to the lots of chunks that hold their tile (``lots``), there to the chunks.
    """
    cells = frequent.select(
        "lang", F.floor(F.col("a") / SIDE).alias("ti"), F.floor(F.col("b") / SIDE).alias("tj"),
        F.struct((F.col("a") % SIDE * SIDE + F.col("b") % SIDE).alias("code"), "id").alias("cell"),
    ).groupBy(*TILE).agg(F.collect_list("cell").alias("cells"))  # at most a tile's cells

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [[x.values.field(c).to_numpy() for c in ("code", "id")] for x in batch.column("cells")]
            found = [(code[order], ids[order]) for code, ids in found for order in [np.argsort(code)]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in TILE], pa.array([pack_codes(code) for code, _ in found], pa.binary()),
                 pa.array([pack_numbers(ids) for _, ids in found], pa.binary())],
                [*TILE, "cells", "new"],
            )

    cells = cells.mapInArrow(pack, "lang string, ti long, tj long, cells binary, new binary")
    near = tiles.join(lots.join(cells, TILE), [*TILE, "lot"])

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows, codes, ids = [], [], []
            for i in range(batch.num_rows):
                code, own = (unpack_codes(batch.column(x)[i].as_py()) for x in ("cells", "codes"))
                here = own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code
                if here.any():
                    rows.append(i)
                    codes.append(pack_codes(code[here]))
                    ids.append(pack_numbers(unpack_numbers(batch.column("new")[i].as_py())[here]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(rows, pa.int64())) for c in ("chunk", "ti", "tj")], *[pa.array(x, pa.binary()) for x in (codes, ids)]],
                ["chunk", "ti", "tj", "codes", "new"],
            )

    hits = near.select("chunk", "ti", "tj", "codes", "cells", "new").mapInArrow(lean(pick), "chunk long, ti long, tj long, codes binary, new binary")
    hits = hits.groupBy("chunk").agg(F.collect_list(F.struct("ti", "tj", "codes", "new")).alias("hits"))  # at most a chunk's pairs

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places, symbols, ids = _read(batch, i)
                found = batch.column("hits")[i].values
                a, b, new = [], [], []
                for ti, tj, codes, own in zip(*[found.field(x).to_pylist() for x in ("ti", "tj", "codes", "new")], strict=True):
                    cell = unpack_codes(codes)
                    a.append(ti * SIDE + cell // SIDE)
                    b.append(tj * SIDE + cell % SIDE)
                    new.append(unpack_numbers(own))
                a, b, new = (np.concatenate(x) for x in (a, b, new))
                code = np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b)
                order = np.argsort(code)
                code, new = code[order], new[order]
                places, a, b = neighbours(places, symbols)
                pairs = a.astype(np.int64) * len(ids) + b
                at = np.minimum(np.searchsorted(code, pairs), len(code) - 1)
                at = np.where(code[at] == pairs, at, -1)
                yield _chunk(batch, i, *relabel(places, at, np.arange(len(new)), new))

    return chunks.join(hits, "chunk").mapInArrow(lean(work), CHUNKS)


def frequent_phrases(df: DataFrame, least: int, longest: int, text: str, lang: str, tokens: int) -> tuple[DataFrame, list[DataFrame]]:
    """The number of words of each language (lang, total), and for each length 1 to ``longest`` its phrases:
    (lang, id, a, b, n, phrase, last), ``a`` and ``b`` the ids of the phrases one word shorter in them."""
    chunks = settle(read_chunks(df, text, lang, tokens))
    spread = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words = settle(spread.groupBy("lang", "word").agg(F.sum("c").alias("n")))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    known = by_frequency(words.where(F.col("n") >= least), ["word"])
    none = F.lit(None).cast("long")
    levels = [known.select("lang", "id", none.alias("a"), none.alias("b"), "n", F.col("word").alias("phrase"), F.col("word").alias("last"))]
    per_lot = F.lit(max(1, round(chunks.count() ** 0.5)))
    state = settle(first_symbols(chunks, known))
    discard(chunks)
    while len(levels) < longest:
        tiles = settle(count_tiles(state).withColumn("lot", F.pmod(F.xxhash64("chunk"), per_lot)))
        lots = sum_tiles(tiles, [*TILE, "lot"])
        found = by_frequency(sum_tiles(lots, TILE, least), ["a", "b"])
        head = levels[-1].select("lang", F.col("id").alias("a"), F.col("phrase").alias("__head"))
        tail = levels[-1].select("lang", F.col("id").alias("b"), F.col("last").alias("__tail"))
        named = found.join(head, ["lang", "a"]).join(tail, ["lang", "b"])
        levels.append(settle(named.select(
            "lang", "id", "a", "b", "n", F.concat_ws(" ", "__head", "__tail").alias("phrase"), F.col("__tail").alias("last")
        )))
        after = settle(next_symbols(state, tiles, tiles.select(*TILE, "lot").distinct(), found)) if len(levels) < longest else None
        discard(state, tiles, found)  # each is as large as the texts' own numbers
        state = after
    return total, levels


def whole_only(phrases: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Phrases that no longer one holds every time; one word more is enough to look at, as counts only fall."""
    if longer is None:
        return phrases
    ends = longer.select("lang", F.col("a").alias("id"), "n").unionAll(longer.select("lang", F.col("b").alias("id"), "n"))
    return phrases.join(ends.groupBy("lang", "id", "n").agg(F.lit(1).alias("__x")).drop("__x"), ["lang", "id", "n"], "left_anti")


def mine_phrases(
    df: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, text: str = "text", lang: str = "lang",
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` phrases of each language that stick together best.

    A phrase has 2 to ``longest`` words of one piece and occurs ``least`` times or more (``a``). Its score is
    floor(1000 * a * n / (l * r)) at the cut that scores lowest, ``l`` and ``r`` the counts of what comes before and
    after, ``n`` all words of the language; of equal cuts the first. Phrases that always stand in one longer phrase
    are left out. Order: score, then ``a``, both falling, then phrase (bytes).

    Nulls: a null text is empty, a null language ``und``. Repeated rows count each. Texts of any length are read
    whole. An empty table, or one without frequent words, gives no rows. Other columns are not read.
    """
    total, levels = frequent_phrases(df, least, longest, text, lang, chunk_tokens)
    counts = levels[0].select("lang", "phrase", "n")
    for level in levels[1:]:
        counts = counts.unionAll(level.select("lang", "phrase", "n"))
    counts = settle(counts)
    kept = [whole_only(x, y).select("lang", "phrase", "n") for x, y in zip(levels[1:], [*levels[2:], None], strict=True)]
    out = kept[0]
    for x in kept[1:]:
        out = out.unionAll(x)
    words = F.split("phrase", " ")
    cuts = out.withColumnRenamed("n", "a").select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"),
    )
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    cuts = cuts.join(F.broadcast(total.withColumnRenamed("total", "n")), "lang")  # one row a language
    wide = {x: F.col(x).cast("decimal(19,0)") for x in "alnr"}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)  # so that few rows of a language meet
    scored = scored.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= most)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
