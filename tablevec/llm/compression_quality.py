"""Text quality by compression: which class's dictionary packs a text better.

One zstandard dictionary is built from texts labelled good, one from texts labelled bad. A text is compressed in
blocks with either; the difference of the two sizes, normalised by their sum and by the text's length, and
the rate of the good dictionary are calibrated into a probability on labelled rows that no dictionary saw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevec.llm.batches import kept, small_batches

FOLDS = 5
HELD_OUT = 0
CALIBRATION = 1
BLOCK = 128
LEVEL = 3
DICTIONARY_BYTES = 110_000
LEAST_SCORE = 0.3


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def sample_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, label, calibrate): of each class at most ``per_class`` ids for its dictionary and as many for calibration.

    Lowest hashes first. Held-out ids, null ids, and ids with no or contradicting labels are left out.
    """
    known = labels.select(F.col("`doc_id`").alias("doc_id"), F.col("`quality`").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("__other")).where("label = __other")
    known = known.where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", "label", (fold(F.col("doc_id")) == CALIBRATION).alias("calibrate"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    for group in (["label", "calibrate", F.pmod(F.hash("doc_id"), F.lit(64))], ["label", "calibrate"]):  # few rows of a class meet
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        known = known.withColumn("__r", rank).where(F.col("__r") <= per_class).drop("__r")
    return known


def make_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there is too little to train on."""
    if sum(map(len, texts)) < 8:  # no dictionary is shorter
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


class Packer:
    """Compressed sizes of texts with the dictionaries of both classes, bad first."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.pack = []
        for content in dictionaries:
            made = zstandard.ZstdCompressionDict(content) if content else None
            if made:
                made.precompute_compress(level=LEVEL)
            self.pack.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress)

    def features(self, text: str | None) -> list[float]:
        """The differences normalised by both sizes and by length, and the rate with the good dictionary."""
        data = (text or "").encode()
        blocks = [data[i : i + BLOCK] for i in range(0, max(1, len(data)), BLOCK)]
        bad, good = (sum(len(pack(x)) for x in blocks) for pack in self.pack)
        length = len(data) + 16  # a few bytes say little
        return [(bad - good) / (bad + good), (bad - good) / length, good / length]


def calibrate(features: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Logistic weights, the constant first, by damped Newton steps; a ridge keeps separable classes finite."""
    rate = (labels.sum() + 1) / (len(labels) + 2)
    start = np.append(np.log(rate / (1 - rate)), np.zeros(features.shape[1]))
    if len(np.unique(labels)) < 2:
        return start.tolist()
    scale = np.append(1, np.maximum(features.std(axis=0), 1e-6))
    x = np.column_stack([np.ones(len(features)), features]) / scale
    penalty = np.append(0, np.full(features.shape[1], ridge))

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - labels @ z + (penalty * w * w).sum() / 2

    w = start * scale
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - labels) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), slope)
        size = 1.0
        while size > 1e-9 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return (w / scale).tolist()


def packer(dictionaries: tuple[bytes, bytes]) -> Packer:
    """The one of this worker."""
    return kept(("packer", dictionaries), lambda: Packer(dictionaries))


def learn_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000, longest: int = 20_000) -> dict:
    """{"dictionaries", "weights"} from labelled rows that are not held out.

    Bounded sample: ``per_class`` ids of each class for its dictionary, of which texts over ``longest``
    characters teach nothing, and ``per_class`` of each for calibration, whose texts stay in Spark. Repeated
    texts count once; rows without text teach nothing.
    """
    ids = sample_labels(labels, per_class)
    small_batches(docs)
    texts = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = texts.join(F.broadcast(ids), "doc_id")  # at most 4 * per_class ids
    teach = texts.where((~F.col("calibrate")) & (F.length("text") <= longest)).select("label", "text").distinct()
    rows = sorted((r.label, r.text.encode()) for r in teach.collect())
    dictionaries = tuple(make_dictionary([t for label, t in rows if label == wanted]) for wanted in (0, 1))
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        return text.map(packer(shared.value).features)

    found = texts.where("calibrate").select("label", features("text").alias("x")).collect()
    x = np.array([r.x for r in found], dtype=np.float64).reshape(-1, 3)
    weights = calibrate(x, np.array([r.label for r in found], dtype=np.float64))
    return {"dictionaries": dictionaries, "weights": weights}


def score_quality(df: DataFrame, model: dict, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 as ``into`` (a column of that name is replaced).

    A null text counts as empty; an empty one has a score too. Texts are read whole, whatever their length. Equal
    texts score alike; an empty table stays empty; other columns and repeated rows pass through.
    """
    shared = small_batches(df).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        pack = packer(shared.value["dictionaries"])
        constant, *weights = shared.value["weights"]
        x = np.array([pack.features(t) for t in texts], dtype=np.float64).reshape(-1, 3)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights + constant, -500, 500))))

    return df.withColumn(into, score(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
