"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its longest
character n-grams that any language knows (4, 3, 2, then 1 characters, word ends marked). A text's
score is the posterior probability of its best language with equal priors.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevec.llm.batches import Cache, kept, small_batches
from tablevec.session import settle

UNKNOWN = "und"
LONGEST = 4
CACHED_NUMBERS = 800_000
AT_ONCE = 50_000
MOST_ITEMS = 5_000_000
LOTS = 64
RUNS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_languages(labelled: DataFrame, per_language: int = 1500, longest: int = 200_000) -> dict:
    """The model from rows (doc_id, text, lang): {"langs", "words", "grams"}.

    Fitted on a bounded sample: of each language the ``per_language`` rows of up to ``longest`` characters whose
    hashed id is lowest (equal texts count once). All their words and n-grams are kept; only these counts come to
    the driver, and a sample with more than ``MOST_ITEMS`` of them is refused, as the model is broadcast. Rows
    without text, language or id teach nothing.
    """
    known = labelled.where(
        F.col("lang").isNotNull() & (F.length("text") <= longest) & F.col("doc_id").isNotNull()
    ).select("doc_id", "lang", "text")
    ids = known.select("doc_id", "lang")
    for group in (["lang", F.pmod(F.hash("doc_id"), F.lit(LOTS))], ["lang"]):  # few rows of a language meet
        by_hash = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("__r", F.row_number().over(by_hash)).where(F.col("__r") <= per_language).drop("__r")
    # at most per_language ids for each language
    sample = known.join(F.broadcast(ids.distinct()), ["doc_id", "lang"], "left_semi").select("lang", "text").distinct()
    words = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    )
    words = settle(words)
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = words.select("lang", "n", marked.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size"))
    grams = grams.where(F.length("w") >= F.col("size")).select(
        "lang", "size", "n",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.length("w") - F.col("size") + 1), lambda i: F.substr("w", i, F.col("size"))
        )).alias("gram"),
    )
    grams = settle(grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    if words.count() + grams.count() > MOST_ITEMS:
        raise ValueError("too many words to broadcast: learn from fewer rows a language")
    words, grams = words.toArrow(), grams.toArrow()
    langs = sorted(pc.unique(words["lang"]).to_pylist())
    tables = [log_frequencies(words["word"], words["lang"], words["n"], langs)]
    for size in range(1, LONGEST + 1):
        some = grams.filter(pc.equal(grams["size"], size))
        tables.append(log_frequencies(some["gram"], some["lang"], some["n"], langs))
    return {"langs": langs, "words": tables[0], "grams": tables[1:]}


class LogTable(Mapping):
    """Item -> log frequency in each language: sorted items and one array, as small as it can be sent."""

    def __init__(self, items: list[str], values: np.ndarray):
        self.items_, self.values_ = items, values

    def __getitem__(self, item: str) -> np.ndarray:
        at = bisect_left(self.items_, item)
        if at == len(self.items_) or self.items_[at] != item:
            raise KeyError(item)
        return self.values_[at]

    def __iter__(self) -> Iterator[str]:
        return iter(self.items_)

    def __len__(self) -> int:
        return len(self.items_)


def log_frequencies(items: pa.ChunkedArray, lang: pa.ChunkedArray, n: pa.ChunkedArray, langs: list[str]) -> LogTable:
    """From counts of (item, language): half a count added everywhere."""
    names = sorted(pc.unique(items).to_pylist())
    rows = pc.index_in(items, value_set=pa.array(names, pa.string())).to_numpy()
    columns = pc.index_in(lang, value_set=pa.array(langs, pa.string())).to_numpy()
    counts = np.zeros((len(names), len(langs)))
    np.add.at(counts, (rows, columns), n.to_numpy())
    norm = np.log(counts.sum(axis=0) + 0.5 * len(names)) if names else np.zeros(len(langs))
    return LogTable(names, (np.log(counts + 0.5) - norm).astype(np.float32))


class Scorer:
    """Scores texts; evidence for new words is worked out together and kept in a bounded cache."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        # a word's ends are no letters: alone they say nothing
        self.tables = [({x: i for i, x in enumerate(t) if x not in "^$"}, t.values_) for t in (model["words"], *model["grams"])]
        most = max(1000, CACHED_NUMBERS // max(1, len(self.langs)))
        self.rows = np.zeros((most, len(self.langs)), dtype=np.float32)
        self.known = Cache(most)

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log frequencies of each word: its own, or the mean over its longest known n-grams, or none."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        index, values = self.tables[0]
        at = np.array([index.get(w, -1) for w in words], dtype=np.int64)
        out[at >= 0] = values[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for size in range(LONGEST, 0, -1):
            index, values = self.tables[size]
            if not len(left) or not len(values):
                continue
            flat: list[int] = []
            lengths = []
            for i in left:
                marked = f"^{words[i]}$"
                lengths.append(max(0, len(marked) - size + 1))
                flat += [index.get(marked[j : j + size], -1) for j in range(lengths[-1])]
            grams, owner = np.array(flat, dtype=np.int64), np.repeat(np.arange(len(left)), lengths)
            hit = grams >= 0
            count = np.bincount(owner[hit], minlength=len(left))
            for k in range(len(self.langs)):
                total = np.bincount(owner[hit], weights=values[grams[hit], k], minlength=len(left))
                out[left, k] = np.where(count > 0, total / np.maximum(count, 1), 0)
            left = left[count == 0]
        return out

    def learn(self, words: set[str]) -> None:
        start, words = len(self.known), sorted(words)
        self.rows[start : start + len(words)] = self.evidence(words)
        self.known.update(zip(words, range(start, start + len(words)), strict=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = RUNS.findall(text.lower()) if text else []
        if not any(c.isalpha() for w in words for c in w) or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        step = min(AT_ONCE, self.known.most)
        for start in range(0, len(words), step):  # bounds the new words of one step
            part = words[start : start + step]
            new = self.known.missing(set(part))
            if len(self.known) + len(new) > self.known.most:
                self.known.make_room(len(new))
                new = set(part)
            self.learn(new)
            spots = np.fromiter(map(self.known.__getitem__, part), dtype=np.int64, count=len(part))
            total += self.rows[spots].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def identify(df: DataFrame, model: dict, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``df`` with the language and its score (0 to 1) added, named ``into``.

    ``und`` with score 0 if the text is null, empty or has no letter, or nothing was learned; of equal
    scores the first language by name. Nulls in other columns, repeated rows and clashing names pass
    through, an empty table stays empty: columns that have the names in ``into`` are replaced. Texts are read whole.
    """
    shared = small_batches(df).sparkSession.sparkContext.broadcast(model)
    name = uuid4().hex

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        scorer = kept(("languages", name), lambda: Scorer(shared.value))
        return pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang", "score"])

    own = [F.col(f"`{c}`") for c in df.columns if c not in into]
    judged = df.select(F.struct(*own).alias("row"), judge(F.col(f"`{text}`")).alias("found"))
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in df.columns if c not in into],
        F.col("found.lang").alias(into[0]), F.col("found.score").alias(into[1]),
    )
