import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tablevec.llm import compression_quality as cq
from tablevec.llm.queries import classified, read


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = classified(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 600
    bad, good = ([r for r in held if r.quality == x] for x in (0, 1))
    assert np.mean([r.predicted == 0 for r in bad]) > 0.95
    assert np.mean([r.predicted == 1 for r in good]) > 0.99
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # calibrated: what is scored as good so often is good so often
    assert abs(np.mean([r.score for r in held]) - np.mean([r.quality for r in held])) < 0.02


def test_sizes_by_hand():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "river", "runs", "slow", "today"]) for _ in range(60)).encode() for _ in range(300)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "click", "now###", "free"]) for _ in range(60)).encode() for _ in range(300)]
    dictionaries = cq.make_dictionary(bad), cq.make_dictionary(good)
    text = "the river runs " * 40 + "é"
    data, sizes = text.encode(), []
    for content in dictionaries:
        total = 0
        for i in range(0, len(data), 128):
            pack = zstandard.ZstdCompressor(
                level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False,
                write_dict_id=False,
            )
            total += len(pack.compress(data[i : i + 128]))
        sizes.append(total)
    bad_size, good_size = sizes
    got = cq.Packer(dictionaries).features(text)
    n = len(data) + 16
    assert got == [(bad_size - good_size) / (bad_size + good_size), (bad_size - good_size) / n, good_size / n] and got[0] > 0.1


def test_calibration():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3))
    p = 1 / (1 + np.exp(-(0.5 + x @ [2.0, -1.0, 0.0])))
    w = cq.calibrate(x, (rng.random(4000) < p).astype(float))
    assert np.allclose(w, [0.5, 2, -1, 0], atol=0.2)
    apart = cq.calibrate(x, (x[:, 0] > 0).astype(float))  # separable: finite all the same
    assert np.isfinite(apart).all() and apart[1] > 5
    assert cq.calibrate(x, np.ones(4000))[1:] == [0, 0, 0]


def test_learns_only_from_its_folds(spark):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(400)] + [(1, 0), (401, None), (None, 1)] + [(2, 0)] * 3, "doc_id long, quality int"
    )
    ids = cq.sample_labels(labels, 30).collect()
    by = {}
    for r in ids:
        by.setdefault((r.label, r.calibrate), []).append(r.doc_id)
    assert {k: len(v) for k, v in by.items()} == {(0, True): 30, (0, False): 30, (1, True): 30, (1, False): 30}
    assert 1 not in [r.doc_id for r in ids] and len({r.doc_id for r in ids}) == 120
    folds = spark.createDataFrame([(r.doc_id, r.calibrate) for r in ids], "doc_id long, c boolean").withColumn("f", cq.fold(F.col("doc_id")))
    assert {(r.c, r.f) for r in folds.select("c", "f").distinct().collect()} <= {(True, 1), (False, 2), (False, 3), (False, 4)}


def test_odd_tables(spark):
    rows = [(1, "good words", "x", 7.5), (1, None, None, None), (None, "", "y", 1.0), (3, "w" * 3_000_000, "z", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, predicted double")
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    model = cq.learn_quality(df, labels)  # nothing to learn from
    assert model["dictionaries"] == (b"", b"")
    out = cq.score_quality(df, model)
    assert out.columns == [*df.columns, "score"] and out.count() == 4
    assert {r.score for r in out.collect()} == {0.5} and {r["a.b"]: r.predicted for r in out.collect()}["x"] == 7.5
    assert cq.score_quality(df.limit(0), model).count() == 0
    few = cq.learn_quality(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))  # too few to train
    assert all(0 <= r.score <= 1 for r in cq.score_quality(df, few).collect())
