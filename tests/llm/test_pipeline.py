"""The pipeline against a brute-force version of each stage's decision, on a fixture with planted cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablevec.llm import language_id
from tablevec.session import settle
from tests.llm.test_decontaminate import shingles
from tests.llm.test_ngram_join import brute as components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(8)
    words = {
        "en": "the of and that with this from have house water".split(), "de": "der die und nicht mit von haus wasser ein ist".split(),
    }

    def prose(lang, n):
        return " ".join(rng.choice(words[lang]) + rng.choice(["", "", "x", "ing", "ung", "er"]) + rng.choice("abcdefgh") for _ in range(n))

    docs = [(i, prose(lang := rng.choice(["en", "de"]), rng.randint(30, 300)), lang) for i in range(120)]
    items = [(i, prose("en", 20)) for i in range(4)] + [(9, None)]
    secret = "0123456789abcdef0123456789abcdef"
    docs += [
        (200, None, "en"), (201, "", "en"), (202, "123 --- 456 ½", "de"), (203, docs[5][1], "en"), (204, docs[5][1] + " end", None),
        (1, docs[1][1], docs[1][2]), (205, docs[7][1].upper(), "en"), (206, prose("en", 40) + " " + items[2][1] + " " + prose("en", 30), "en"),
        (207, items[0][1].upper(), "en"), (208, f"a note with token = '{secret}' and AKIA" + "B2" * 8 + " in it of the house", "en"),
        (209, prose("de", 3000), "de"), (210, prose("en", 12), None),
    ]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, x, "s", len(t) if t is not None else None) for i, t, x in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items, secret


def test_stages_decide_as_brute_force(spark, fixture):
    folder, docs, items, secret = fixture
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    columns = kept.columns
    rows = [kept.collect()]
    for _, stage in corpus_pipeline.STAGES:
        kept = settle(stage(spark, kept, folder))
        rows.append(kept.collect())
        if len(rows) < len(corpus_pipeline.STAGES) + 1:
            assert kept.columns == columns

    def ids(k):
        return sorted(r.doc_id for r in rows[k])

    scorer = language_id.Scorer(language_id.learn_languages(
        spark.read.parquet(f"{folder}/documents.parquet").where(~language_id.held_out(language_id.F.col("doc_id")))
    ))
    judged = [(r.doc_id, *scorer.predict(r.text)) for r in rows[0]]
    assert ids(1) == sorted(i for i, lang, score in judged if lang != "und" and score >= 0.5)
    assert not {200, 201, 202} & set(ids(1)) and set(range(120)) <= set(ids(1))

    groups = components([(r.doc_id, r.text) for r in rows[1]], 5, 80)
    assert ids(2) == sorted({i for i, _, c in groups if i == c})
    assert not {203, 204, 205} & set(ids(2)) and ids(2).count(1) == 1

    held = [shingles(t) for _, t in items if t]
    clean = [r.doc_id for r in rows[2] if not any(10 * len(shingles(r.text) & s) >= 8 * len(s) for s in held)]
    assert ids(3) == sorted(clean) and not {206, 207} & set(ids(3))

    before, after = ({r.doc_id: r for r in rows[k]} for k in (3, 4))
    assert before.keys() == after.keys()
    assert after[208].text == "a note with [secret]' and [secret] in it of the house" and secret not in after[208].text
    assert all(after[i].text == before[i].text for i in after if i != 208)
    assert all(r.n_chars == len(r.text) for r in rows[4])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fills = {}
    for r in rows[5]:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    whole = {i: [*library.encode(r.text, add_special_tokens=False).ids, 0] for i, r in after.items()}
    assert max(fills.values()) <= 2048 and sum(fills.values()) == sum(map(len, whole.values()))
    for r in rows[5]:
        ids_ = np.array(whole[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids_.tobytes())
    assert len([r for r in rows[5] if r.doc_id == 209]) > 1


def test_run_gives_the_last_stage(spark, fixture):
    folder, *_ = fixture
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[0] == "doc_id" and out.count() > 100


def test_empty_and_null_documents(spark, fixture):
    folder, *_ = fixture
    for rows in ([], [(None, None, None, None, None), (None, "", None, None, 3), (None, "the house", None, None, None)]):
        docs = spark.createDataFrame(rows, SCHEMA + ", lang_pred string").select("*") if not rows else spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, folder))
        assert docs.count() == len(rows)


def test_own_columns_survive(spark, fixture):
    folder, *_ = fixture
    extra = [F.lit(7.5).alias("score"), F.lit("own").alias("lang_pred"), (F.col("doc_id") * 3).alias("a.b"), F.lit(1).alias("__id"), F.lit("t").alias("__text")]
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("n_chars").select("*", *extra)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = settle(stage(spark, docs, folder))
        assert kept.columns == docs.columns
        docs = kept
        rows = docs.collect()
        assert len(rows) > 100 and all((r.score, r.lang_pred, r["a.b"], r["__id"], r["__text"]) == (7.5, "own", r.doc_id * 3, 1, "t") for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 100
