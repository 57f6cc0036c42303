import random
import re

from tablevec.llm import quality_votes as q
from tablevec.llm.queries import read


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "x " * 40, "l\nl\nl \n\n\nl", "😀 é#*$ %&|<>", "a\x1cb c\x0bd", "a b c d e f " * 3]
    for _ in range(60):
        pool = [f"w{i}" for i in range(rng.choice([3, 8, 200]))]
        out.append(rng.choice([" ", "\n", " \r\n"]).join(rng.choices(pool, k=rng.randint(1, 120))))
    return out


def test_measures_equal_brute_force(spark):
    rows = list(enumerate(texts() + texts()[:4]))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.judge_quality(df).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_em_finds_the_better_rule():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.7
        row = tuple(int(good if rng.random() < right else not good) if rng.random() < 0.9 else None for right in (0.95, 0.9, 0.6))
        counts[row] = counts.get(row, 0) + 1
    model = q.fit_rules(sorted(counts.items(), key=str), 3)
    on_good = model["right"][1]
    assert abs(model["good"] - 0.7) < 0.15 and on_good[0] > 0.88 and on_good[2] < 0.75
    assert q.fit_rules([], 3)["good"] > 0.5


def test_agrees_with_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    judged = q.judge_quality(read(spark, sf_dir, "documents"))
    rows = judged.join(read(spark, sf_dir, "labels"), "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert q.judge_quality(df).count() == 0
    plan = q.measures(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
