import hashlib
import random

import pytest

from tablevec.llm import suffix_dedup


def brute(docs):
    """doc -> (n_bytes, n_removed, n_spans, digest); docs: ordered (id, text), ids unique."""
    seen, out = set(), {}
    for key, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def documents():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghiéß ", k=rng.randint(2, 8))) for _ in range(120)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    passages = [prose(rng.randint(15, 60)) for _ in range(6)]
    texts = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "y" * 2000, "ab" * 1500, "y" * 150 + "z"]
    for _ in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else prose(rng.randint(1, 60)) for _ in range(rng.randint(1, 5))]
        texts.append("\n".join(parts))
    texts += [texts[20]] * 3 + [texts[30][: len(texts[30]) // 2], texts[30][7:], texts[40] + texts[41]]
    long = prose(3000)
    texts += [long, long[: len(long) // 2] + "!" + long[len(long) // 2 :]]
    return list(enumerate(texts))


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot_bytes", [suffix_dedup.HOT_BYTES, 2000])
def test_equals_brute_force(spark, hot_bytes):
    docs = documents()
    shuffled = random.Random(1).sample(docs, len(docs))
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
    assert rows(suffix_dedup.remove_repeats(df, hot_bytes=hot_bytes)) == brute(docs)


def test_small_pieces_change_nothing(spark, monkeypatch):
    """Runs over segment ends, several flushes in a task and one row a batch."""
    docs = documents()
    base = rows(suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)))
    assert base == brute(docs)
    texts = [(t or "").encode() for _, t in docs]
    whole = suffix_dedup.runs_of(texts)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    parts = suffix_dedup.runs_of(texts)
    assert whole[2].sum() == parts[2].sum() == sum(max(len(t) - 99, 0) for t in texts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert rows(suffix_dedup.remove_repeats(df, buckets=2)) == base
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_within_one_run(spark):
    """Periodic stretches that share their name with no other text."""
    rng = random.Random(8)
    plain = "".join(rng.choices("abcdefgh ", k=400))
    texts = [plain, "q" * 300, plain[:150] + "rst" * 60 + plain[150:]]
    for period in (1, 2, 5, 23, 24, 40, 75, 76, 77, 90, 130):
        unit = "".join(rng.choices("ijklmnop", k=period))
        texts += [(unit * 700)[: period + 98 + extra] for extra in (1, 2, 30)] + [(unit * 700)[: 99 + suffix_dedup.LONGEST_RUN * 2]]
    for text in texts[1:]:
        alone = [(1, text)]
        batch = suffix_dedup.runs_of([text.encode()])
        windows = [text[i : i + 100] for i in range(len(text) - 99)]
        flags = [bool(c & suffix_dedup.REPEATS) for c in batch[4].tolist()]
        assert flags == [len(set(windows[s : s + c])) < c for s, c in zip(batch[1].tolist(), batch[2].tolist())], alone
    assert rows(suffix_dedup.remove_repeats(spark.createDataFrame([(1, "q" * 300)], "doc_id long, text string")))[1][1] == 299
    docs = list(enumerate(texts[:4] + texts[4::5]))
    assert rows(suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)
    assert rows(suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))) == brute(
        list(enumerate(texts))
    )


def test_odd_tables(spark):
    text = "".join(random.Random(2).choices("abcdefg ", k=300))
    df = spark.createDataFrame(
        [(1, text, "a"), (1, text, "b"), (2, text, "c"), (None, text, "d"), (3, None, "e"), (4, "x", None), (2, text + "!", "f")],
        "doc_id long, text string, id string",
    )
    got = sorted(((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert (False, None, 300, 0) in got  # a null id counts as the smallest
    assert [g for g in got if g[1] == 1] == [(True, 1, 300, 300)] * 2  # one document twice
    assert sorted(g[2:] for g in got if g[1] == 2) in ([(300, 300), (301, 300)], [(300, 300), (301, 300)])
    empty = suffix_dedup.remove_repeats(df.limit(0))
    assert empty.count() == 0 and "kept_sha256" in empty.columns
