import random
import re

from tablevec.llm.decontaminate import find_leaks, item_sketches, without_leaks


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items, least=0.8):
    out = set()
    for i, a in docs:
        for j, b in items:
            x, y = shingles(a), shingles(b)
            if i is not None and y and 100 * len(x & y) >= round(100 * least) * len(y):
                out.add((i, j, len(y), len(x & y)))
    return sorted(out)


def tables():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 6, 9, 20, 60])))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "common words in every text here"), (93, "common words in every text there"), (5, items[5][1])]
    docs = [(0, None), (1, ""), (2, items[0][1]), (None, items[7][1]), (3, "w1")]
    for i in range(10, 150):
        parts = rng.choices(words, k=rng.randint(0, 400)) + "common words in every text".split()
        for _ in range(rng.randint(0, 2)):
            item = (rng.choice(items)[1] or "").upper().split()
            if item and rng.random() < 0.5:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(parts))
            parts[at:at] = item
        docs.append((i, rng.choice([" ", "\n"]).join(parts)))
    return docs + docs[5:8], items


def test_equals_brute_force(spark):
    docs, items = tables()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in find_leaks(df, bench).collect())
    assert got == brute(docs, items) and len(got) > 40
    kept = without_leaks(df, bench).collect()
    leaky = {i for i, *_ in got}
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if r.doc_id is not None) == sorted((False, i) for i, _ in docs if i is not None and i not in leaky)
    assert sum(r.doc_id is None for r in kept) == 1
    assert find_leaks(df.limit(0), bench).count() == find_leaks(df, bench.limit(0)).count() == 0


def test_shared_ids_are_judged_apart(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    halves = item.split()
    docs = [(1, " ".join(halves[:7]), 1.5), (1, " ".join(halves[5:]), 2.5), (2, "x " + item, 3.5), (2, "clean words here", 4.5), (2, None, 5.5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, `a.b` double")
    bench = spark.createDataFrame([(7, item), (8, " ".join(halves[:6])), (8, " ".join(halves[4:])), (None, item)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id or -1, r.n_shingles, r.n_shared) for r in find_leaks(df, bench).collect())
    assert found == [(1, 8, 2, 2), (2, -1, 8, 8), (2, 7, 8, 8), (2, 8, 2, 2), (2, 8, 4, 4)]
    kept = without_leaks(df, bench.where("item_id = 7")).collect()
    assert sorted(r["a.b"] for r in kept) == [1.5, 2.5, 4.5, 5.5]


def test_large_benchmarks_are_not_broadcast(spark):
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in find_leaks(df, bench, broadcast_rows=0).collect())
    assert got == brute(docs, items)


def test_sketch_is_long_enough(spark):
    """Any fifth of an item's shingles may be missing and its sketch still meets the rest."""
    _, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    counts = {r.item_id: r for r in item_sketches(bench, 0.8, 5).groupBy("item_id", "n_shingles").count().collect()}
    for r in counts.values():
        missing = r.n_shingles - -(-r.n_shingles * 8 // 10)
        assert r["count"] >= min(r.n_shingles, missing + 1)


def test_plan_has_no_python(spark):
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plan = find_leaks(df, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
