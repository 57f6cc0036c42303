"""Corpus counts, subsampling, noise, context pairs, phrases, skip-gram training."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.functions import ordering, text, vectors
from tablevec.functions.draws import DRAW_RANGE, draw, uniform
from tablevec.llm.batches import small_batches
from tablevec.operators.classes import directional_classes
from tablevec.operators.factorize import truncated_svd
from tablevec.session import discard, settle

# Training defaults that results depend on.
SAMPLE = 1e-3
NOISE_POWER = 0.75
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 100.0
PHRASE_PASSES = (200.0, 100.0)
STEP = 0.025
NEGATIVES = 5
PART_TOKENS = 400_000  # a task trains on at most about so many
LOT_PAIRS = 10_000_000  # a task counts about so many pairs at once
LOT_WORDS = 500_000  # words of the sentences that are merged together
OUT_ROWS = 10_000  # rows of a record batch that a task hands back

def sentences(df: DataFrame, key: str, column: str) -> DataFrame:
    """(doc, sent, words): the lines of each text as word arrays.

    Whole texts are dealt out first, as a file may be a single piece for its readers.
    """
    texts = df.select(F.col(key).alias("doc"), F.col(column).alias("text")).repartition(F.xxhash64("doc", "text"))
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("sent", "line"))
    return lines.select("doc", "sent", text.words("line").alias("words")).where(F.size("words") > 0)


def positions(sents: DataFrame) -> DataFrame:
    """(doc, sent, pos, word): one row per word."""
    return sents.select("doc", "sent", F.posexplode("words").alias("pos", "word"))


def vocab_counts(words: DataFrame, min_count: int = 1) -> DataFrame:
    """(word, n) of words that occur at least ``min_count`` times; hot words are summed map-side."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def keep_probability(counts: DataFrame, sample: float = SAMPLE) -> DataFrame:
    """(word, n, keep): chance that an occurrence survives subsampling."""
    total = counts.agg(F.sum("n").alias("t")).scalar()
    limit = F.lit(sample) * total
    return counts.select("word", "n", ((F.sqrt(F.col("n") / limit) + 1) * limit / F.col("n")).alias("keep"))


def subsample(words: DataFrame, sample: float = SAMPLE, seed: int = 0) -> DataFrame:
    """The surviving (doc, sent, pos, word); a draw per occurrence decides."""
    placed = settle(words)
    keep = settle(keep_probability(vocab_counts(placed), sample)).select("word", "keep")
    return (
        ordering.join_hot(placed, keep, ["word"])
        .where(F.col("keep") >= uniform(seed, "doc", "sent", "pos"))
        .select(*words.columns)
    )


def noise_distribution(counts: DataFrame, power: float = NOISE_POWER) -> DataFrame:
    """(word, p, lo, hi): share of n**power and its slice of [0, 1), in word order."""
    weighted = settle(counts.select("word", F.pow(F.col("n").cast("double"), F.lit(power)).alias("w")))
    cum = ordering.number_rows(weighted, [], ["word"], "k", {"before": "w"}, {"total": "w"})
    return cum.select(
        "word",
        (F.col("w") / F.col("total")).alias("p"),
        (F.col("before") / F.col("total")).alias("lo"),
        ((F.col("before") + F.col("w")) / F.col("total")).alias("hi"),
    )


def negative_samples(pairs: DataFrame, noise: DataFrame, keys: list[str], n: int = 5, seed: int = 0) -> DataFrame:
    """Each pair with ``n`` words drawn from the noise; a draw that hits the pair's context is dropped.

    [0, 1) is cut into as many cells as there are words, every word listed in the cells its slice
    touches, so a draw finds its word by an equi-join on its cell.
    """
    table = settle(noise.select("word", "lo", "hi"))
    size = table.count()
    first = F.floor(F.col("lo") * size)
    last = F.least(F.floor(F.col("hi") * size), F.lit(size - 1))
    cells = table.select(
        F.col("word").alias("negative"), "lo", "hi", F.explode(F.sequence(first, F.greatest(first, last))).alias("cell")
    )
    draws = pairs.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.withColumn("u", draw(seed, *keys, "draw") / F.lit(float(DRAW_RANGE))).withColumn(
        "cell", F.floor(F.col("u") * size)
    )
    hit = (F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi"))
    return draws.join(cells, "cell").where(hit & (F.col("negative") != F.col("context"))).select(*pairs.columns, "draw", "negative")


def _lots(batches, most: int):
    """Tables of about ``most`` words (column ``words``), made of record batches; a row stays whole."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(int(np.searchsorted(ends, before + most - n)) + 1, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            n += int(ends[stop - 1] - before)
            at = stop
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _coded(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code, row, dictionary) of all words of a table; a null word has a code too."""
    words = table["words"].combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(words)), sizes), coded.dictionary


def _tally(a: np.ndarray, b: np.ndarray, known: pa.Array, names: tuple[str, str]) -> pa.Table:
    """(first name, others): the different pairs of codes as words, one row per first word, others as (second name, n)."""
    size = max(len(known), 1)
    pair, n = np.unique(a * size + b, return_counts=True)
    first, second = pair // size, pair % size
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    others = pa.StructArray.from_arrays([known.take(pa.array(second)), pa.array(n)], [names[1], "n"])
    ends = pa.array(np.append(starts, len(pair)).astype(np.int32))
    return pa.table({names[0]: known.take(pa.array(first[starts])), "others": pa.ListArray.from_arrays(ends, others)})


def _summed(lots: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of the counts of all lots: counted already, they are shuffled as they are and summed once."""
    return lots.repartition(a).select(a, F.inline("others")).groupBy(a, b).agg(F.sum("n").alias("n"))


def _near(words: np.ndarray, row: np.ndarray, window: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(center, context) of all words in the reach of a center in the same row."""
    center, context = [], []
    for off in range(1, window + 1):
        if off < len(words):
            same = row[off:] == row[:-off]
            for here, there in ((slice(off, None), slice(None, -off)), (slice(None, -off), slice(off, None))):
                use = same & (reach[here] >= off)
                center.append(words[here][use])
                context.append(words[there][use])
    if not center:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(center), np.concatenate(context)


def _following(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, next word) inside a row."""
    same = row[1:] == row[:-1]
    return words[:-1][same], words[1:][same]


def _word_type(sents: DataFrame) -> str:
    return dict(sents.dtypes)["words"].removeprefix("array<").removesuffix(">")


def context_pairs(sents: DataFrame, window: int = 5, seed: int = 0, counted: bool = False) -> DataFrame:
    """(doc, sent, pos, center, context): words within a drawn distance of 1..window.

    Pairs are read out of the sentence array in place; nothing is joined or shuffled. ``counted`` gives
    (center, context, n) of the same pairs instead: a task counts lots of pairs as numbers, and only
    the different pairs of a lot are rows that are shuffled and summed.
    """
    if counted:
        return _counted_contexts(sents, window, seed)
    reach = (F.lit(window) - draw(seed, "doc", "sent", "pos") % window).cast("int")
    last = F.size("words") - 1
    # built-in generators in one codegen stage: the word array is read in place, not copied per center
    centers = sents.where(F.size("words") > 0).select("doc", "sent", "words", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    near = F.sequence(-F.least("reach", "pos"), F.least(F.col("reach"), last - F.col("pos")))
    placed = centers.withColumn("reach", reach).select("doc", "sent", "words", "pos", F.explode(near).alias("off"))
    return placed.where(F.col("off") != 0).select(
        "doc", "sent", "pos", F.get("words", F.col("pos")).alias("center"), F.get("words", F.col("pos") + F.col("off")).alias("context")
    )


def _counted_contexts(sents: DataFrame, window: int, seed: int) -> DataFrame:
    places = F.sequence(F.lit(0), F.size("words") - 1)
    reach = F.transform(places, lambda pos: (F.lit(window) - draw(seed, "doc", "sent", pos) % window).cast("int"))

    def count(batches):
        for table in _lots(batches, max(1, LOT_PAIRS // window)):
            words, row, known = _coded(table)
            reached = table["reach"].combine_chunks().flatten().to_numpy()
            yield from _tally(*_near(words, row, window, reached), known, ("center", "context")).to_batches(OUT_ROWS)

    word = _word_type(sents)
    rows = small_batches(sents.where(F.size("words") > 1).select("words", reach.alias("reach")))
    lots = rows.mapInArrow(count, f"center {word}, others array<struct<context: {word}, n: bigint>>")
    return _summed(lots, "center", "context")


def bigram_scores(sents: DataFrame, min_count: int = PHRASE_MIN_COUNT) -> DataFrame:
    """(a, b, n, score) of neighbouring words inside a sentence that all occur often enough."""
    words = vocab_counts(positions(sents))
    total = words.agg(F.sum("n").alias("t")).scalar()
    common = words.where(F.col("n") >= min_count)
    def count(batches):
        for table in _lots(batches, LOT_PAIRS):
            words, row, known = _coded(table)
            yield from _tally(*_following(words, row), known, ("a", "b")).to_batches(OUT_ROWS)

    # pairs are counted as numbers, lot by lot, before they are shuffled or meet the word counts
    word = _word_type(sents)
    rows = small_batches(sents.where(F.size("words") > 1).select("words"))
    lots = rows.mapInArrow(count, f"a {word}, others array<struct<b: {word}, n: bigint>>")
    pairs = _summed(lots, "a", "b").where(F.col("n") >= min_count)
    left = common.select(F.col("word").alias("a"), F.col("n").alias("na"))
    right = common.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    score = (F.col("n") - min_count).cast("double") / F.col("na") / F.col("nb") * total
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", score.alias("score"))


def _in_lots(sents: DataFrame) -> DataFrame:
    """Sentences with the ``lot`` of about ``LOT_WORDS`` words that they belong to, written once."""
    names = sents.columns

    def number(batches):
        first = TaskContext.get().partitionId() << 32
        for i, table in enumerate(_lots(batches, LOT_WORDS)):
            lot = pa.array(np.full(table.num_rows, first + i, dtype=np.int64))
            yield from table.select(names).append_column("lot", lot).to_batches()

    schema = ", ".join(f"{n} {t}" for n, t in sents.dtypes)
    return settle(small_batches(sents).mapInArrow(number, f"{schema}, lot bigint"))


def _merged(words: np.ndarray, row: np.ndarray, known: pa.Array, a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(joins, kept) of all words: whether one is joined to the next, and whether one is not the end of a phrase."""
    first, second = (pc.index_in(c, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b))
    hit = np.zeros(len(words), dtype=bool)
    hit[:-1] = (row[1:] == row[:-1]) & np.isin(words[:-1] * len(known) + words[1:], first * len(known) + second)
    # in a run of phrases that overlap, every second one is passed over, as its first word is taken
    place = np.arange(len(words))
    begins = hit & ~np.concatenate([[False], hit[:-1]])
    joins = hit & ((place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0)
    return joins, ~np.concatenate([[False], joins[:-1]])


def _merge_lot(sents: pa.Table, phrases: pa.Table) -> pa.Table:
    """A lot's sentences with its phrases joined."""
    sents = sents.drop_columns(["lot"])
    if not phrases.num_rows or not sents.num_rows:
        return sents
    sents = sents.combine_chunks()
    words, row, known = _coded(sents)
    joins, kept = _merged(words, row, known, phrases["a"].combine_chunks(), phrases["b"].combine_chunks())
    flat = known.take(pa.array(words))
    at = np.flatnonzero(joins)
    joined = pc.binary_join_element_wise(flat.take(pa.array(at)), flat.take(pa.array(at + 1)), "_")
    flat = pc.replace_with_mask(flat, pa.array(joins), joined).filter(pa.array(kept))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=sents.num_rows))]).astype(np.int32)
    missing = pc.is_null(sents["words"].combine_chunks())
    merged = pa.ListArray.from_arrays(pa.array(ends), flat, mask=missing)
    return sents.set_column(sents.column_names.index("words"), "words", merged)


def merge_phrases(sents: DataFrame, phrases: DataFrame) -> DataFrame:
    """Sentences with the phrases (a, b) joined by ``_``, left to right, without overlap.

    Sentences are dealt into lots of about ``LOT_WORDS`` words. Only the different pairs of a lot look for their
    phrase; those found go back to the lot, where the merging happens on numbers. Both inputs are written
    anew, so tables they come from can be discarded once this returns.
    """
    return _merging(sents, phrases)[0]


def _merging(sents: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``merge_phrases`` and the two written tables that it reads."""
    rows = _in_lots(sents.select("doc", "sent", "words"))

    def pairs(batches):
        for table in _lots(batches, LOT_PAIRS):
            for lot in pc.unique(table["lot"]).to_pylist():
                words, row, known = _coded(table.filter(pc.equal(table["lot"], lot)))
                found = _tally(*_following(words, row), known, ("a", "b"))
                yield from found.append_column("lot", pa.array(np.full(found.num_rows, lot))).to_batches(OUT_ROWS)

    known = settle(phrases.select("a", "b").distinct())  # its size is known, so Spark picks the join
    lots = rows.where(F.size("words") > 1).select("lot", "words")
    found = lots.mapInArrow(pairs, "a string, others array<struct<b: string, n: bigint>>, lot bigint").select("lot", "a", F.inline("others"))
    hits = found.join(known, ["a", "b"], "left_semi").select("lot", "a", "b")
    schema = ", ".join(f"{n} {t}" for n, t in rows.drop("lot").dtypes)
    return rows.groupBy("lot").cogroup(hits.groupBy("lot")).applyInArrow(_merge_lot, schema), rows, known


def learn_phrases(sents: DataFrame, threshold: float = PHRASE_THRESHOLD, min_count: int = PHRASE_MIN_COUNT) -> DataFrame:
    """(a, b, n, score) above the threshold."""
    return bigram_scores(sents, min_count).where(F.col("score") > threshold)


def phrase_corpus(sents: DataFrame, thresholds=PHRASE_PASSES, min_count: int = PHRASE_MIN_COUNT) -> DataFrame:
    """Sentences after one merging pass per threshold; later passes can grow longer phrases.

    What a pass wrote is deleted as soon as nothing reads it any more; the sentences given are left to the caller.
    """
    written = []
    for t in thresholds:
        phrases = settle(learn_phrases(sents, t, min_count))
        merged, *read = _merging(sents, phrases)
        discard(phrases, *written)  # the pass reads its own tables from here on
        sents = settle(merged)
        discard(*read)
        written = [sents]
    return sents


def _first_vectors(tokens: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Vectors of [-0.5, 0.5) / dim fixed by token and seed, by a mixing of 64 bits."""
    names = (hashlib.blake2b(f"{seed}|{t}".encode(), digest_size=8).digest() for t in tokens)
    x = np.frombuffer(b"".join(names), dtype="<u8")[:, None] + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53 / dim - 0.5 / dim


def _window_pairs(words: np.ndarray, row: np.ndarray, window: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(center, context) of all words within a drawn distance of 1..window in the same row, in a drawn order."""
    center, context = _near(words, row, window, rng.integers(1, window + 1, len(words)))
    order = rng.permutation(len(center))
    return center[order], context[order]


def _train_part(docs: pd.DataFrame, known: pd.DataFrame | None, dim: int, window: int, step: float, seed: tuple) -> pd.DataFrame:
    """(token, weight, vec, out) of the tokens of some documents after one pass over them, in small batches."""
    docs = docs.sort_values("doc")
    sizes = docs["tokens"].map(len).to_numpy()
    words, tokens = pd.factorize(np.concatenate(docs["tokens"].to_numpy()) if sizes.sum() else np.zeros(0, dtype=object), sort=True)
    rng = np.random.default_rng(seed[1:])
    if known is None:
        vec, out = _first_vectors(tokens, dim, seed[0]), np.zeros((len(tokens), dim))
    else:
        known = known.sort_values("token")
        vec, out = (np.stack(known[c].to_numpy()).astype(np.float64) for c in ("vec", "out"))
    count = np.bincount(words[words >= 0], minlength=len(tokens))
    noise = np.cumsum(count**NOISE_POWER)
    row = np.repeat(np.arange(len(docs)), sizes)[words >= 0]
    center, context = _window_pairs(words[words >= 0], row, window, rng)
    batch = min(4096, max(16, len(tokens) // 2))  # so that few words occur in it often
    for at in range(0, len(center), batch):
        c, o = center[at : at + batch], context[at : at + batch]
        rate = step * max(1 - at / len(center), 1e-4)
        other = np.searchsorted(noise, rng.random((len(c), NEGATIVES)) * noise[-1], side="right")
        other = np.minimum(np.concatenate([o[:, None], other], axis=1), len(tokens) - 1)
        right = np.zeros(other.shape)
        right[:, 0] = 1.0
        v, w = vec[c], out[other]
        miss = right - 1 / (1 + np.exp(-np.clip(np.einsum("id,ijd->ij", v, w), -30, 30)))
        miss[:, 1:][other[:, 1:] == o[:, None]] = 0  # a draw that hits the context is passed over
        np.add.at(vec, c, rate * np.einsum("ij,ijd->id", miss, w))
        np.add.at(out, other.ravel(), rate * (miss[:, :, None] * v[:, None, :]).reshape(-1, vec.shape[1]))
    return pd.DataFrame({"token": tokens, "weight": count.astype("float64"), "vec": list(vec), "out": list(out)})


def fit_skipgram(docs: DataFrame, dim: int = 100, window: int = 5, min_count: int = 0, iterations: int = 1, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(token, vec) by skip-gram with negative samples; the vectors stay in tables of any length.

    ``docs`` has ``tokens`` (array of text). As in Spark ML's trainer, parts of the documents are trained apart
    and a token's vectors are averaged after each pass (by its occurrences); a part reads the vectors
    of its own tokens only, and its negatives are drawn from them, so no task and no driver holds the vocabulary.
    ``partitions`` is the least number of parts; there are more so that a part has at most about 400,000 tokens.
    """
    rows = settle(docs.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("doc"), "tokens"))
    if min_count > 1:
        placed = rows.select("doc", F.posexplode("tokens").alias("pos", "word"))
        often = settle(vocab_counts(placed, min_count).select("word"))
        kept = placed.join(often, "word").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("t"))
        rows = settle(kept.select("doc", F.col("t.word").alias("tokens")))
    size = rows.agg(F.sum(F.size("tokens")).alias("n")).scalar()
    parts = F.greatest(F.lit(partitions or rows.sparkSession.sparkContext.defaultParallelism), F.ceil(F.coalesce(size, F.lit(0)) / PART_TOKENS))
    rows = settle(rows.withColumn("part", F.pmod(F.xxhash64("doc"), parts)))
    schema = "token string, weight double, vec array<double>, out array<double>"
    needed = settle(rows.select("part", F.explode("tokens").alias("token")).distinct()) if iterations > 1 else None

    def trainer(i, first):
        def work(key, docs, known):
            return _train_part(docs, known, dim, window, STEP * (1 - i / iterations), (seed, abs(seed), i, int(key[0])))

        return (lambda key, docs: work(key, docs, None)) if first else (lambda key, docs, known: work(key, docs, known))

    known = None
    for i in range(iterations):
        task = trainer(i, known is None)
        if known is None:
            trained = rows.groupBy("part").applyInPandas(task, schema)
        else:
            there = needed.where(F.col("token").isNotNull()).join(known, "token")
            trained = rows.groupBy("part").cogroup(there.groupBy("part")).applyInPandas(task, schema)
        mean = trained.groupBy("token").agg(vectors.mean_vector(F.concat("vec", "out"), F.col("weight")).alias("both"))
        known = settle(mean.select("token", F.slice("both", 1, dim).alias("vec"), F.slice("both", dim + 1, dim).alias("out")))
    return known.select("token", "vec")


def mutual_information(pairs: DataFrame, shift: float = 5.0, power: float = NOISE_POWER, min_count: int = 1) -> DataFrame:
    """(row, col, v): shifted positive mutual information of (center, context) pairs, stored where it is positive.

    v = ln(n(w, c) / n(w)) - ln(n(c)**power / sum of n**power) - ln(shift): what skip-gram with ``shift``
    negatives drawn from n**power approximates. Pairs are summed before anything is joined, and a
    word's counts are looked up apart for hot words; pairs that come counted have a column ``n``. Centers or contexts with fewer than
    ``min_count`` pairs are left out before the shares are formed; null words are dropped.
    """
    counted = pairs.where(F.col("center").isNotNull() & F.col("context").isNotNull())
    times = F.sum("n") if "n" in pairs.columns else F.count(F.lit(1))
    counted = settle(counted.groupBy("center", "context").agg(times.alias("n")))
    rows = counted.groupBy("center").agg(F.sum("n").alias("n_center")).where(F.col("n_center") >= min_count)
    cols = counted.groupBy("context").agg(F.sum("n").alias("n_context")).where(F.col("n_context") >= min_count)
    noise = settle(cols.select("context", F.pow(F.col("n_context").cast("double"), F.lit(power)).alias("g")))
    total = noise.agg(F.sum("g").alias("g")).scalar()
    joined = ordering.join_hot(ordering.join_hot(counted, settle(rows), ["center"]), noise, ["context"])
    v = F.ln(F.col("n") / F.col("n_center")) - F.ln(F.col("g") / total) - F.lit(math.log(shift))
    return joined.select(F.col("center").alias("row"), F.col("context").alias("col"), v.alias("v")).where(F.col("v") > 0)


def factorized_words(pairs: DataFrame, dim: int = 100, shift: float = 5.0, power: float = NOISE_POWER, min_count: int = 1, iterations: int = 3, seed: int = 0) -> DataFrame:
    """(token, vec): word vectors as the factors of ``mutual_information``.

    Vectors stay in tables of any length; the driver holds (dim + 10) x (dim + 10) numbers. Words
    without a positive entry have no vector.
    """
    matrix = settle(mutual_information(pairs, shift, power, min_count))
    return truncated_svd(matrix, dim, iterations, seed).select(F.col("id").alias("token"), "vec")


def word_classes(emb: DataFrame, k: int, iterations: int = 10) -> DataFrame:
    """(token, cluster): Lloyd's rounds on directions, started from classes dealt out in token order."""
    return directional_classes(emb.select(F.col("token").alias("id"), "vec"), k, iterations).select(F.col("id").alias("token"), "cluster")


def sweep(fit, **grid):
    """(parameters, result) of ``fit`` for every combination of a parameter grid."""
    names = sorted(grid)
    for values in itertools.product(*[grid[n] for n in names]):
        params = dict(zip(names, values))
        yield params, fit(**params)
