"""Removal of repeated byte strings, after the manner of a suffix array, over sampled suffixes.

A string of ``size`` bytes (100) is cut if the same string starts earlier: in a document with a smaller
id, or earlier in the same one. Sorting every suffix of the corpus would shuffle a hundred times its size,
so only suffixes at synchronising points are: the window of ``size`` bytes at each position is named by
the lowest hash of its ``GRAM``-byte substrings (its leading token), and neighbouring windows of the same
name form a run. Equal windows have equal names, so only runs of the same name need comparing.

1. Runs are range-partitioned by name with sampled splitters and sorted in their bucket. Runs of equal
   content are settled there: all but the first repeat. Equal names never straddle two buckets.
2. Runs whose name occurs with other content, or that hold equal windows themselves, fetch their bytes, and
   the windows of each name are sorted and compared one by one. A name with very many bytes is compared window by window in Spark instead.
3. The union of the repeated windows is removed from each document.

Contents are compared by 64-bit names together with 64-bit (in step 1: 48-bit) polynomial hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablevec.functions.ordering import join_hot
from tablevec.llm.batches import slices, small_batches
from tablevec.llm.documents import known_ids
from tablevec.session import settle

SIZE = 100
GRAM = 24
LONGEST_RUN = 512
SEGMENT = 1 << 20
HELD_RUNS = 1_000_000
HOT_BYTES = 4_000_000
COUNT_BITS = 10
REPEATS = 1 << 60  # in the content of a run: some of its windows are equal
_BASE = 0x9E3779B97F4A7C15


@cache
def _byte_values() -> np.ndarray:
    """An odd 64-bit number for each byte value."""
    return np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, SEGMENT + 2 * SIZE)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    _, down = _power(len(sums))
    return _mix((sums[end] - sums[start]) * down[: len(sums)][start])


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values) - width + 1
    blocks = np.append(values, np.full(-len(values) % width, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, count, name, content) of the runs of windows of all texts.

    ``content`` holds the count, 48 bits of the hash of the bytes from the first window's start to the last
    one's end, and ``REPEATS`` if two windows of the run are equal. Long texts are worked on in overlapping segments.
    """
    whole = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    parts = []
    for at in range(0, max(len(whole) - SIZE + 1, 0), SEGMENT):
        data = whole[at : at + SEGMENT + SIZE - 1]
        n = len(data) - SIZE + 1
        own = owner[at : at + n]
        inside = own == owner[at + SIZE - 1 : at + SIZE - 1 + n]
        sums = _sums(data)
        grams = _hashes(sums, slice(0, len(data) - GRAM + 1), slice(GRAM, len(data) + 1))
        name = _lowest(grams, SIZE - GRAM + 1)
        new = np.ones(n, dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        keep = inside[first]
        first, count = first[keep], count[keep]
        if len(count) and count.max() > LONGEST_RUN:
            pieces = -(-count // LONGEST_RUN)
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            end = np.repeat(first + count, pieces)
            first = np.repeat(first, pieces) + step * LONGEST_RUN
            count = np.minimum(end - first, LONGEST_RUN)
        content = _hashes(sums, first, first + count + SIZE - 1)
        packed = (content >> np.uint64(16)) << np.uint64(COUNT_BITS) | count.astype(np.uint64)
        packed[_repeating(sums, grams, name, first, count)] |= np.uint64(REPEATS)
        parts.append((own[first], at + first - begin[own[first]], count, name[first].view(np.int64), packed.view(np.int64)))
    if not parts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _repeating(sums, grams, name, first, count) -> np.ndarray:
    """Numbers of the runs of which two windows are equal.

    The stretch from one window to an equal one has the distance as its period, so between the two some
    window begins and some window ends with the gram that names the run, at different places.
    """
    n, width = len(name), SIZE - GRAM
    begins, ends = np.flatnonzero(grams[:n] == name), np.flatnonzero(grams[width:] == name)
    a, b = np.searchsorted(begins, first), np.searchsorted(ends, first + count) - 1
    place = np.append(begins, n)[a]
    maybe = np.flatnonzero((place < first + count) & (b >= 0) & (np.append(ends, -1)[b] >= first) & (place < np.append(ends, -1)[b] + width))
    row = np.repeat(maybe, count[maybe])
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count[maybe]) - count[maybe], count[maybe])
    window = _hashes(sums, at, at + SIZE)
    order = np.lexsort((window, row))
    same = (row[order][1:] == row[order][:-1]) & (window[order][1:] == window[order][:-1])
    return np.unique(row[order][1:][same])


def _settle_here(ident, tie, start, count, name, content) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one task: those to send on, and whether each of the others repeats one of them."""
    mixed = _mix(name.view(np.uint64) + _mix(content.view(np.uint64)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    shared = np.zeros(len(order), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    rows = order[shared]
    rows = rows[np.lexsort((start[rows], tie[rows], ident[rows], content[rows], name[rows]))]
    later = np.zeros(len(name), dtype=bool)
    if len(rows):
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (name[rows][1:] != name[rows][:-1]) | (content[rows][1:] != content[rows][:-1])
        head = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        later[rows] = (ident[rows] != ident[head]) | (tie[rows] != tie[head]) | (start[rows] != start[head])
        twice = ~fresh & ~later[rows]  # repeated rows of the table: one is enough
        return ~later & ~np.isin(np.arange(len(name)), rows[twice]), later
    return ~later, later


RUN_ROWS = "bucket int, name long, content long, id long, tie long, start long"


def _run_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 5]
    names = [x.split(" ")[0] for x in RUN_ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def make_runs(docs: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Rows of runs; and of stretches known to repeat, with minus their length as content, dealt out by their id."""

    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ident, tie, start, count, name, content = (np.concatenate(x) for x in zip(*held, strict=True))
        on, later = _settle_here(ident, tie, start, count, name, content)
        bucket = np.searchsorted(splitters, name.view(np.uint64)).astype(np.int32)
        yield from _cut(_run_batch([x[on] for x in (bucket, name, content, ident, tie, start)]))
        if later.any():  # stretches of neighbouring runs that repeat
            end = start + count + SIZE - 1
            opens = later.copy()
            opens[1:] &= ~(later[:-1] & (ident[1:] == ident[:-1]) & (tie[1:] == tie[:-1]) & (start[1:] <= end[:-1]) & (start[1:] > start[:-1]))
            first = np.flatnonzero(opens)
            group = np.cumsum(opens)[later] - 1
            last = np.zeros(len(first), dtype=np.int64)
            np.maximum.at(last, group, end[later])
            spread = _mix(ident[first].view(np.uint64) + first.astype(np.uint64))
            yield from _cut(_run_batch([
                (spread % np.uint64(len(splitters) + 1)).astype(np.int32), spread.view(np.int64), start[first] - last,
                ident[first], tie[first], start[first],
            ]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in slices(batches, 256):
            ident, tie = batch.column("id").to_numpy(), batch.column("tie").to_numpy()
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for part in _about(texts, SEGMENT):
                at, start, count, name, content = runs_of(texts[part])
                held.append((ident[part][at], tie[part][at], start, count, name, content))
                rows += len(at)
                if rows >= HELD_RUNS:
                    yield from send(held)
                    held, rows = [], 0
        if rows:
            yield from send(held)

    return docs.mapInArrow(work, RUN_ROWS)


def _about(texts: list[bytes], most: int) -> Iterator[slice]:
    """Neighbouring texts of together about ``most`` bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _cut(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


FOUND_ROWS = "open boolean, name long, id long, tie long, start long, count long"


def settle_buckets(runs: DataFrame) -> DataFrame:
    """From sorted buckets: stretches that repeat (``count`` bytes), and open runs (``count`` windows), whose
    name occurs with other content too or whose own windows repeat."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_(), *[pa.int64()] * 5]
        names = [x.split(" ")[0] for x in FOUND_ROWS.split(", ")]
        # the last row of the batch before, the head of its content, and the only head of its name if not yet sent
        last = head = waiting = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("name", "content", "id", "tie", "start")])
            if not rows.shape[1]:
                continue
            known = rows[1] < 0
            out = [(np.zeros(known.sum(), dtype=bool), rows[0][known], rows[2][known], rows[3][known], rows[4][known], -rows[1][known])]
            rows = rows[:, ~known]
            n = rows.shape[1]
            if n:
                before = np.concatenate((rows[:, :1] if last is None else last, rows[:, :-1]), axis=1)
                new_name = rows[0] != before[0]
                new_content = new_name | (rows[1] != before[1])
                if last is None:
                    new_name[0] = new_content[0] = True
                # heads[0] is what was carried over
                heads = np.concatenate((rows[:, :1] if head is None else head, rows[:, new_content]), axis=1)
                mine = heads[:, np.cumsum(new_content)]
                later = ~new_content & (rows[2:] != mine[2:]).any(axis=0)
                count = rows[1] & ((1 << COUNT_BITS) - 1)
                out.append((np.zeros(later.sum(), dtype=bool), rows[0][later], rows[2][later], rows[3][later], rows[4][later], count[later] + SIZE - 1))
                # heads of names with at least two contents, and those that repeat within
                heads, fresh = rows[:, new_content], new_name[new_content]
                if waiting is not None:
                    heads, fresh = np.concatenate((waiting, heads), axis=1), np.concatenate(([True], fresh))
                    carried = True
                else:
                    carried = False
                if heads.shape[1]:
                    several = np.zeros(heads.shape[1], dtype=bool)
                    several[1:] |= ~fresh[1:]
                    several[:-1] |= ~fresh[1:]
                    several |= (heads[1] & REPEATS) != 0
                    if not carried and not fresh[0]:
                        several[0] = True  # its name's first head went out with an earlier batch
                    lone = not several[-1]
                    waiting = heads[:, -1:] if lone else None
                    heads = heads[:, several]
                    out.append((np.ones(heads.shape[1], dtype=bool), heads[0], heads[2], heads[3], heads[4], heads[1] & ((1 << COUNT_BITS) - 1)))
                last = rows[:, -1:]
                head = mine[:, -1:]
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return runs.mapInArrow(work, FOUND_ROWS)


def window_rows(open_runs: DataFrame) -> DataFrame:
    """(name, window, id, tie, start): every window of runs given with their bytes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            row, offset, window = _windows([x.as_py() for x in batch.column("bytes")])
            take = pa.array(row, pa.int64())
            start = batch.column("start").to_numpy()[row] + offset
            yield pa.RecordBatch.from_arrays(
                [batch.column("name").take(take), pa.array(window.view(np.int64)), batch.column("id").take(take),
                 batch.column("tie").take(take), pa.array(start, pa.int64())],
                ["name", "window", "id", "tie", "start"],
            )

    return open_runs.mapInArrow(work, "name long, window long, id long, tie long, start long")


def _windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, hash) of all windows of the rows' bytes."""
    lengths = np.array([len(x) for x in data], dtype=np.int64)
    begin, counts = np.cumsum(lengths) - lengths, lengths - SIZE + 1
    row = np.repeat(np.arange(len(data)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    sums = _sums(np.frombuffer(b"".join(data), dtype=np.uint8))
    at = begin[row] + offset
    return row, offset, _hashes(sums, at, at + SIZE)


SPANS = "id long, tie long, start long, count long"


def compare_runs(open_runs: DataFrame) -> DataFrame:
    """Stretches that repeat, from runs with bytes, sorted by (name, id, tie, start) and whole names to a task."""

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        name, ident, tie, start = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        row, offset, window = _windows([r[4] for r in rows])
        order = np.argsort(window, kind="stable")
        again = np.zeros(len(order), dtype=bool)
        again[order[1:]] = (window[order][1:] == window[order][:-1]) & (name[row[order]][1:] == name[row[order]][:-1])
        opens = again.copy()
        opens[1:] &= ~(again[:-1] & (row[1:] == row[:-1]))
        first = np.flatnonzero(opens)
        count = np.bincount(np.cumsum(opens)[again] - 1, minlength=len(first)).astype(np.int64)
        at = row[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (ident[at], tie[at], start[at] + offset[first], count + SIZE - 1)],
            ["id", "tie", "start", "count"],
        )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, previous = [], 0, None
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("name", "id", "tie", "start", "bytes")], strict=True):
                if size >= HOT_BYTES // 2 and r[0] != previous[0]:
                    yield compare(held)
                    held, size = [], 0
                if previous is None or r[:4] != previous[:4]:  # repeated rows of the table: one is enough
                    held.append(r)
                    size += len(r[4])
                previous = r
        if held:
            yield compare(held)

    return open_runs.mapInArrow(work, SPANS)


def _splitters(docs: DataFrame, buckets: int, sample: int = 500) -> np.ndarray:
    """Bucket limits from the names of runs of ``sample`` documents that can hold one, those of lowest hash; any limits
    give the same results."""
    long = docs.where(F.octet_length("text") >= SIZE)
    drawn = long.select("id", "tie", F.xxhash64("id", "tie").alias("h")).orderBy("h", "id", "tie").limit(sample).select("id", "tie")
    some = long.join(F.broadcast(drawn), ["id", "tie"], "left_semi")  # at most ``sample`` rows are sent
    names = make_runs(some, np.zeros(0, dtype=np.uint64)).where("content >= 0").select("name")
    names = names.orderBy(F.xxhash64("name"), "name").limit(200_000)
    values = np.sort(np.array([r.name for r in names.collect()], dtype=np.int64).view(np.uint64))
    if not len(values):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(values[np.arange(1, buckets) * len(values) // buckets])


def remove_repeats(
    df: DataFrame, text: str = "text", key: str = "doc_id", hot_bytes: int = HOT_BYTES, buckets: int | None = None
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row; ``kept`` is null where nothing went.

    ``kept``: the remaining bytes; ``n_spans``: maximal removed stretches. Nulls: a null text is empty; a
    null id counts as the smallest. Repeated rows (same id and text) are one document and get the same
    result; rows with the same id but other texts are documents in an arbitrary fixed order. Texts shorter
    than 100 bytes lose nothing. An empty table gives no rows. Extra columns are not read. ``hot_bytes``:
    names with more bytes to compare are compared by Spark instead of in one task; results are the same.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = known_ids(small_batches(df), text, key)
    splitters = _splitters(docs, buckets)
    runs = make_runs(docs.select("id", "tie", "text"), splitters).repartitionById(buckets, F.col("bucket"))
    found = settle(settle_buckets(runs.sortWithinPartitions("name", "content", "id", "tie", "start")))

    # texts of documents with something found, written once for the two steps that read them
    per_doc = found.groupBy("id", "tie").agg(
        F.collect_list(F.when(F.col("open"), F.struct("name", "start", "count"))).alias("runs")
    )
    texts = settle(docs.select("id", "tie", "text").join(per_doc, ["id", "tie"]))
    data = texts.withColumn("data", F.encode("text", "UTF-8")).select("id", "tie", F.explode(F.transform(
        "runs",
        lambda r: F.struct(
            r["name"].alias("name"), r["start"].alias("start"),
            F.substring("data", r["start"].cast("int") + 1, (r["count"] + SIZE - 1).cast("int")).alias("bytes"),
        ),
    )).alias("r"))
    opened = data.select("r.name", "id", "tie", "r.start", "r.bytes")
    heavy = settle(
        found.where("open").groupBy("name").agg(F.sum(F.col("count") + SIZE).alias("n")).where(F.col("n") > hot_bytes).select("name")
    )
    usual = opened.join(heavy, "name", "left_anti").repartition("name").sortWithinPartitions("name", "id", "tie", "start")
    place = F.struct("id", "tie", "start")
    windows = settle(window_rows(opened.join(heavy, "name", "left_semi")))
    first = windows.groupBy("name", "window").agg(F.min(place).alias("first"))  # a window may be that of a million runs
    hot = join_hot(windows, first, ["name", "window"]).where(place > F.col("first")).select(
        "id", "tie", "start", F.lit(SIZE).cast("long").alias("count")
    )
    spans = found.where("NOT open").select("id", "tie", "start", "count").unionByName(compare_runs(usual)).unionByName(hot)
    per_doc = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "count")).alias("spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            removed, stretches, kept, digest = [], [], [], []
            for data, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = data.encode()
                out, at, n = [], 0, 0
                for start, end in _joined((s["start"], s["start"] + s["count"]) for s in spans):
                    out.append(data[at:start])
                    at, n = end, n + 1
                out = b"".join([*out, data[at:]])
                removed.append(len(data) - len(out))
                stretches.append(n)
                kept.append(out)
                digest.append(hashlib.sha256(out).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tie"), pa.array(removed, pa.int64()), pa.array(stretches, pa.int64()),
                 pa.array(kept, pa.binary()), pa.array(digest, pa.string())],
                ["id", "tie", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    changed = (
        texts.select("id", "tie", "text").join(per_doc, ["id", "tie"]).dropDuplicates(["id", "tie"])
        .mapInArrow(cut, "id long, tie long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    )
    all_docs = docs.select(
        "key", "id", "tie", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("__whole")
    )
    return all_docs.join(changed, ["id", "tie"], "left").select(
        F.col("key").alias(key), "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        "kept", F.coalesce("kept_sha256", "__whole").alias("kept_sha256"),
    )


def _joined(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Sorted, with touching and overlapping ones joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out
