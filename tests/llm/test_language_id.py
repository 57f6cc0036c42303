import numpy as np
from pyspark.sql import functions as F

from tablevec.llm import language_id as lid
from tablevec.llm.queries import languages, read


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = languages(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_backs_off_to_shorter_grams(spark):
    rows = [(1, "haus haus maus", "de"), (2, "house mouse the", "en"), (3, "the the", "en"), (4, None, "fr"), (5, "x", None), (None, "y", "en")]
    model = lid.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scorer = lid.Scorer(model)
    assert model["langs"] == ["de", "en"]
    found = scorer.evidence(["haus", "hausx", "zzuz", "qqq", "the"])
    assert np.array_equal(found[0], model["words"]["haus"])
    assert np.allclose(found[1], np.mean([model["grams"][3][g] for g in ("^hau", "haus")], axis=0))
    assert np.array_equal(found[2], model["grams"][0]["u"]) and not found[3].any()
    total = 2 * model["words"]["haus"].astype(float) + found[4]
    assert scorer.predict("Haus, HAUS 12 the!")[1] == np.float64(1 / np.exp(total - total.max()).sum())


def test_odd_tables(spark):
    model = lid.learn_languages(read(spark, "/root/testdata/sf0.001", "documents"), per_language=20)
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 -- ½", "c"), (4, "the of and " * 30_000, "d"), (4, "le de et", None), (None, "la que los", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in lid.identify(df, model).collect()}
    assert got[1, None] == got[2, ""] == got[3, "12 -- ½"] == ("und", 0.0)
    assert got[4, "the of and " * 30_000][0] == "en" and got[4, "le de et"][0] == "fr"
    assert lid.identify(df.limit(0), model).columns == ["doc_id", "text", "lang_pred", "score"]
    nothing = lid.learn_languages(df.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in lid.identify(df, nothing).collect()} == {"und"}


def test_clearing_the_cache_changes_nothing(spark):
    model = lid.learn_languages(read(spark, "/root/testdata/sf0.001", "documents"), per_language=20)
    texts = [r.text for r in read(spark, "/root/testdata/sf0.001", "documents").limit(40).collect()]
    small, large = lid.Scorer(model), lid.Scorer(model)
    small.known.most = 3000
    assert [small.predict(t)[0] for t in texts] == [large.predict(t)[0] for t in texts]
