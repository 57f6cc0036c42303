"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Documents are tokenised and cut in one pass; only lengths and positions travel on. They are dealt
out evenly into groups of bounded size, whatever their keys, and each group is packed on its own:
best fit, longest first, then pieces move or are exchanged (one for one, two for one) between all
underfull bins as long as the sum of squared fills grows, which empties the lightest bins.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.llm.batches import Cache, kept, slices, small_batches
from tablevec.session import settle

CACHED_WORDS = 500_000
GROUP_PIECES = 100_000
ID_BYTES = 4
# fixed value: how byte-level vocabularies of this family split text
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BEYOND_LATIN = re.compile(r"[^\x00-\x7f\u00a1-\u024f]")
TOGETHER = re.compile(r"  | \n|\n |[^\S \n]")


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    A byte-level splitter of this family always begins a new pre-token at a single space between two
    other characters, so a text cut there can be encoded word by word, and words seen before are looked
    up. New words of Latin letters go together through tiktoken, given the very vocabulary of the file (it
    yields the same ids in a fifth of the time); texts with other white space next to a space, with
    an added token, and words of other scripts go through the file's own library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or splitter.get("type") != "ByteLevel" or splitter["add_prefix_space"] or not splitter["use_regex"]:
            raise ValueError("a byte-level vocabulary without normaliser is needed")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("ids must rise with merge ranks")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in x): i for x, i in model["vocab"].items() if x not in self.added}
        self.quick = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(1 + max(ranks.values()), dtype=np.int64)
        for x, i in ranks.items():
            self.size[i] = len(x)
        self.known = Cache(CACHED_WORDS)

    def _slow(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of each word with one space before it."""
        latin = [
            w for w in words if w and (w.isascii() or not BEYOND_LATIN.search(w)) and w[0] != "\n" and w[-1] != "\n"
        ]
        rest = sorted(set(words).difference(latin))
        self.known.update(zip(rest, self._slow([" " + w for w in rest]), strict=True))
        if latin:
            ids = np.array(self.quick.encode_ordinary(" " + " ".join(latin)), dtype="<u4")
            ends = np.cumsum(self.size[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in latin]))
            edges, all_ids = [0, *(ID_BYTES * (cuts + 1)).tolist()], ids.tobytes()
            self.known.update(zip(latin, [all_ids[a:b] for a, b in pairwise(edges)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if TOGETHER.search(t) or any(a in t for a in self.added) else t.split(" ") for t in texts]
        new = self.known.missing(set().union(*[words[1:] for words in cut if words]))
        if len(self.known) + len(new) > self.known.most:
            self.known.make_room(len(new))
            new = set().union(*[words[1:] for words in cut if words])
        self._learn(sorted(new))
        first = iter(self._slow([t if words is None else words[0] for t, words in zip(texts, cut, strict=True)]))
        get = self.known.__getitem__
        return [next(first) + b"".join(map(get, words[1:] if words else ())) for words in cut]


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def encoder(path: str) -> Encoder:
    """The one of this worker."""
    return kept(("encoder", path), lambda: Encoder(path))


def cut_pieces(df: DataFrame, tokenizer: str, size: int, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each row's ids with ``end_id`` last, cut into pieces of ``size``.

    Only longer rows are cut; then the first piece takes the remainder and all others are full.
    """
    rows = small_batches(df).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, 256):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(coder.encode(batch.column("text").to_pylist())):
                ids += last
                n = len(ids) // ID_BYTES
                edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(pairwise(edges)):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a * ID_BYTES : b * ID_BYTES]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["key", "piece", "start", "length", "ids_crc32"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    there = 0  # bit f: some bin has f places free
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = there >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                there &= ~(1 << free)
        else:
            free, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        by_free[free - n].append(b)
        there |= 1 << (free - n)
    return bins


class OpenBins:
    """Underfull bins, looked up by free space and by the lengths they hold."""

    def __init__(self, size: int):
        self.lengths = [0] * (size + 1)  # by free space; bit n: a bin holds a piece of length n, bit 0: there is a bin
        self.bins: list[dict[int, dict[int, None]]] = [{} for _ in range(size + 1)]  # by free space, then length

    def add(self, b: int, free: int, held: Iterable[int]) -> None:
        for n in {0, *held}:
            self.bins[free].setdefault(n, {})[b] = None
            self.lengths[free] |= 1 << n

    def remove(self, b: int, free: int, held: Iterable[int]) -> None:
        for n in {0, *held}:
            there = self.bins[free][n]
            del there[b]
            if not there:
                del self.bins[free][n]
                self.lengths[free] ^= 1 << n

    def partner(self, held: Iterable[int], free: int) -> int | None:
        """The bin with at most ``free`` places that gains most from one or two of the lengths ``held`` of a bin
        that is not in here, for one length or none given back; None if no bin gains."""
        one = sums = 0
        for n in held:
            sums |= one << n
            one |= 1 << n
        sums |= one
        there = 0
        for gain in range(free, 0, -1):
            there |= self.lengths[gain]
            fitting = there << gain & sums
            if fitting:
                back = fitting.bit_length() - 1 - gain
                room = next(f for f in range(gain, free + 1) if self.lengths[f] >> back & 1)
                return next(iter(self.bins[room][back]))
        return None


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Local search over all underfull bins, until no step is left.

    A step takes pieces from a lighter bin ``a`` and gives some back from a heavier bin ``b``: one piece
    (a move), one for one, or two of ``a`` for one of ``b``. It is made if ``b`` gets fuller and still fits, so
    the sum of squared fills grows with every step, and the search ends. Full bins can neither get fuller nor
    give to a heavier one.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    full = [b for b, n in zip(bins, fill, strict=True) if n >= size]
    work = [list(b) for b, n in zip(bins, fill, strict=True) if n < size]
    fill = [n for n in fill if n < size]
    known = OpenBins(size)

    def held(b: int) -> list[int]:
        return [lengths[i] for i in work[b]]

    def place(b: int) -> None:
        if work[b] and fill[b] < size:
            known.add(b, size - fill[b], held(b))

    for b in range(len(work)):
        place(b)
    changed = True
    while changed:
        changed = False
        for a in sorted(range(len(work)), key=fill.__getitem__):
            if not work[a] or fill[a] >= size:
                continue
            known.remove(a, size - fill[a], held(a))
            while work[a] and (b := known.partner(held(a), size - fill[a])) is not None:
                known.remove(b, size - fill[b], held(b))
                give, take = _step(sorted(work[a], key=lambda i: lengths[i]), work[b], lengths, size - fill[b])
                gain = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                work[a] = [i for i in work[a] if i not in give] + take
                work[b] = [i for i in work[b] if i not in take] + give
                fill[a], fill[b] = fill[a] - gain, fill[b] + gain
                place(b)
                changed = True
            place(a)
    return full + [b for b in work if b]


def _step(light: list[int], heavy: list[int], lengths: list[int], free: int) -> tuple[list[int], list[int]] | None:
    """What to give and take so that the heavy bin gains most, at most ``free``; None if it can't gain."""
    best, found = 0, None
    sizes = [lengths[i] for i in light]
    k = bisect_right(sizes, free)
    if k:
        best, found = sizes[k - 1], ([light[k - 1]], [])
    for y in heavy:
        if best == free:
            return found
        room = free + lengths[y]
        k = bisect_right(sizes, room)
        if k and sizes[k - 1] - lengths[y] > best:
            best, found = sizes[k - 1] - lengths[y], ([light[k - 1]], [y])
        j = len(sizes) - 1
        for i in range(len(sizes) - 1):  # two pointers: the largest pair that fits
            while j > i and sizes[i] + sizes[j] > room:
                j -= 1
            if j <= i:
                break
            if sizes[i] + sizes[j] - lengths[y] > best:
                best, found = sizes[i] + sizes[j] - lengths[y], ([light[i], light[j]], [y])
    return found


def pack(pieces: DataFrame, size: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` added; each sequence holds at most ``size``.

    Pieces are dealt out evenly into groups of about ``group_pieces``, so a key with many rows is no
    heavier than others; the last bin of a group may stay light, one in some ten thousand.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    columns = pieces.columns
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table.column("length").to_pylist()
        base = TaskContext.get().partitionId() << 32
        order, sequence, offset = [], [], []
        for number, members in enumerate(improve(best_fit(lengths, size), lengths, size)):
            place = 0
            for i in members:
                order.append(i)
                sequence.append(base + number)
                offset.append(place)
                place += lengths[i]
        table = table.take(pa.array(order, pa.int64()))
        table = table.append_column("sequence_id", pa.array(sequence, pa.int64()))
        table = table.append_column("offset", pa.array(offset, pa.int64()))
        yield from table.select([*columns, "sequence_id", "offset"]).to_batches(max_chunksize=10_000)

    return pieces.repartition(groups).mapInArrow(work, schema)


def pack_documents(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Nulls: a null or empty text is the end id alone; a null key stays. Repeated rows are packed each.
    Texts of any length are read whole. An empty table gives no rows. Extra columns are not read.
    """
    pieces = settle(cut_pieces(df, tokenizer, size, end_id, text, key))
    return pack(pieces, size).withColumnRenamed("key", key)
