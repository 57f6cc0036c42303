"""Benchmark decontamination with DataFrame functions only: size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles. An item's sketch holds its lowest hashes, as
many as its partition needs: if a document contains the share ``least`` of an item of n shingles, it
misses at most n - ceil(least * n) of them, so one more than that many lowest hashes must include one
that the document has, and no contained item is missed however long the document is. Documents keep
their full set of hashes, cut to the hashes of all sketches right where they are made. Candidates are
verified by counting the item's shingles, compared as text, in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevec.session import settle

BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased words between ASCII blanks; none for a null text."""
    return F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), BLANK), lambda w: w != "")


def _shingles(words_: str, size: int, make) -> Column:
    """``make`` of the words of every window; with fewer words the whole sequence; nothing without words."""
    n = F.size(words_)
    return (
        F.when(n >= size, F.transform(
            F.sequence(F.lit(0), n - size), lambda i: make([F.get(words_, i + j) for j in range(size)])
        ))
        .when(n > 0, F.array(make([F.array_join(words_, " ")])))
        .otherwise(F.array().cast("array<long>" if make is _hash else "array<string>"))
    )


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _text(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def item_sketches(items: DataFrame, least: float, size: int, partition_growth: float = 1.25) -> DataFrame:
    """(item_id, n_shingles, partition, hash): the sketch of each item, one row per hash.

    Partition p holds items of up to ``partition_growth`` ** p shingles; its sketch length follows from
    that bound, and an item with fewer shingles than that gives all it has.
    """
    made = items.withColumn("w", words(F.col("text"))).where(F.size("w") > 0)
    made = made.select("item_id", F.array_sort(F.array_distinct(_shingles("w", size, _hash))).alias("h"))
    n = F.size("h")
    made = made.withColumn("partition", F.ceil(F.log(n.cast("double")) / F.log(F.lit(partition_growth))).cast("int"))
    most = F.floor(F.pow(F.lit(partition_growth), F.col("partition")) + 1)
    length = F.greatest(most - F.ceil(most * least) + 1, n - F.ceil(n * least) + 1)
    return made.select(
        "item_id", n.alias("n_shingles"), "partition", F.explode(F.slice("h", 1, F.least(length, n).cast("int"))).alias("hash")
    )


def _judged(docs: DataFrame, items: DataFrame, least: float, size: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, part, item_id, n_shingles, n_shared): ``part`` tells the texts of one id apart, items likewise."""
    items = items.select(F.col("`item_id`").alias("item_id"), F.col("`text`").alias("text")).distinct()
    items = settle(items.select(F.struct("item_id", F.xxhash64("text").alias("part")).alias("item_id"), "text"))
    sketches = settle(item_sketches(items, least, size))
    hashes = sketches.select("hash").distinct()
    # the benchmark side is broadcast only while its size, counted here, allows it
    small = sketches.count() <= broadcast_rows
    docs = docs.select(F.col("`doc_id`").alias("doc_id"), F.xxhash64(F.col("`text`")).alias("part"), F.col("`text`").alias("text"))
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = docs.withColumn("w", words(F.col("text"))).select("doc_id", "part", F.explode(_shingles("w", size, _hash)).alias("hash"))
    if small:
        rows = rows.join(F.broadcast(hashes), "hash", "left_semi")
    hits = rows.distinct()
    found = hits.join(F.broadcast(sketches) if small else sketches, "hash")
    found = settle(found.select("doc_id", "part", "item_id", "n_shingles").distinct())
    # exact: shingles as text, of candidate pairs only
    texts = docs.join(found.select("doc_id", "part").distinct(), ["doc_id", "part"], "left_semi").dropDuplicates(["doc_id", "part"])
    texts = texts.withColumn("w", words(F.col("text"))).select("doc_id", "part", F.explode(F.array_distinct(_shingles("w", size, _text))).alias("s"))
    parts = items.withColumn("w", words(F.col("text"))).select("item_id", F.explode(F.array_distinct(_shingles("w", size, _text))).alias("s"))
    wanted = found.join(parts, found["item_id"].eqNullSafe(parts["item_id"])).select("doc_id", "part", found["item_id"], "n_shingles", "s")
    shared = wanted.join(texts, ["doc_id", "part", "s"])
    counts = shared.groupBy("doc_id", "part", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    return counts.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * least)).withColumn("item_id", F.col("item_id.item_id"))


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, size: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document that holds at least the share
    ``least`` of an item's different ``size``-word shingles.

    Words are lower-cased and end at ASCII blanks. Texts with fewer words count as one shingle, so a short
    item is only found as a whole short text. Nulls: a null text holds nothing and a null item id stays;
    rows without a document id are left out, as a pair needs one. Repeated rows give one pair. Texts that share
    an id, of documents or of items, are judged apart; of equal ids and numbers of shingles the best is given.
    Empty tables give no rows. Extra columns are not read. Sketches of over ``broadcast_rows`` hashes are
    joined by a shuffle instead of a broadcast.
    """
    judged = _judged(docs, items, least, size, broadcast_rows)
    best = judged.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return best.withColumns({
        "n_shingles": F.col("n_shingles").cast("long"), "containment": F.col("n_shared") / F.col("n_shingles")
    }).select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def without_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, size: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows whose own text holds an item; rows without an id or a text stay."""
    leaks = _judged(docs, items, least, size, broadcast_rows).select("doc_id", "part").distinct()
    rows, bad = docs.alias("rows"), settle(leaks).alias("bad")  # names of the table's own can't clash
    met = (F.col("rows.`doc_id`") == F.col("bad.doc_id")) & (F.xxhash64(F.col("rows.`text`")) == F.col("bad.part")) & F.col("rows.`text`").isNotNull()
    return rows.join(bad, met, "left_anti")
