import random
import re
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pytest

from tablevec import session
from tablevec.llm import collocations as col

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, most):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in good.items():
            if any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in good.items()
            ):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(300)] + ["É", "日本", "a b", "x\x00y", "[S]"]
    fixed = ["New York city hall", "as far as I know", "A A A A A A", "to be or not"]
    rows = []
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(60)):
            text.append(rng.choice(fixed) if rng.random() < 0.1 else rng.choice(words))
            text.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";", "\x0b"]))
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(text)))
    return [*rows, ("en", None), ("en", ""), ("de", " . \t,"), (None, None), *rows[:10]]


@pytest.mark.parametrize(("seed", "chunk", "side"), [(1, 50, 1024), (2, 100_000, 4), (3, 700, 16)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk, side):
    monkeypatch.setattr(col, "SIDE", side)
    monkeypatch.setattr(col, "DENSE", max(2, side * side // 16))
    rows = made(seed)
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "lang string, text string, phrase long, `a.b` long").repartition(5)
    got = col.mine_phrases(df, least=4, most=40, chunk_tokens=chunk)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 4, 5, 40)
    assert len(want) > 60 and sorted(tuple(r) for r in got.collect()) == want


def test_odd_tables(spark):
    schema = "lang string, text string"
    assert col.mine_phrases(spark.createDataFrame([], schema)).count() == 0
    assert col.mine_phrases(spark.createDataFrame([("en", "a b c"), (None, None)], schema)).count() == 0
    long = "over and over again " * 40_000  # one piece
    got = {r.phrase: r.a for r in col.mine_phrases(spark.createDataFrame([("en", long)], schema)).collect()}
    assert got["over and over again over"] == 39_999 and "over and over" not in got and got["over and over again"] == 40_000


def test_scores_beyond_64_bits(spark):
    """The products pass 64 bits, the quotient does not."""
    a, n, left, right = 3_000_000_007, 90_000_000_000_001, 4_000_000_009, 5_000_000_021
    wide = [f"CAST({x} AS DECIMAL(19,0))" for x in (a, n, left, right)]
    got = spark.sql(f"SELECT CAST(1000 AS DECIMAL(4,0)) * {wide[0]} * {wide[1]} div ({wide[2]} * {wide[3]}) AS x").first().x
    assert got == 1000 * a * n // (left * right)


def test_tile_sums_dense_or_not():
    rng = np.random.default_rng(4)
    for rows, most in ((1, 9), (3, 9), (4000, 300), (5, 1 << 40)):
        total, want = col.TileSum(), np.zeros(col.SIDE**2, dtype=np.int64)
        for _ in range(rows):
            codes = np.unique(rng.integers(0, col.SIDE**2, 30))
            n = rng.integers(1, most, len(codes))
            want[codes] += n
            total.add(codes.astype("<u4").tobytes(), col.pack_counts(n))
        codes, n = col.unpack_cells(*total.total())
        assert (total.cells is not None) == (rows == 4000)
        assert np.array_equal(codes, np.flatnonzero(want)) and np.array_equal(n, want[want > 0])


@pytest.mark.parametrize("numbers", [[0], [3] * 70, [255, 256, 0] * 40, [1 << 40, 5], list(range(0, 9_000_000, 100_001))])
def test_packed_numbers_come_back(numbers):
    x = np.array(numbers, dtype=np.int64)
    assert col.unpack_numbers(col.pack_numbers(x)).tolist() == numbers
    assert col.unpack_codes(col.pack_codes(np.unique(x))).tolist() == sorted(set(numbers))


def test_cells_travel_in_little_room(spark):
    """A cell of a spread tile takes about two bytes, not five."""
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 1000, 40_000).astype(np.int32)
    row = (1, "en", col.squeeze(np.ones(len(symbols), dtype=np.int32)), col.squeeze(symbols), col.squeeze(np.arange(1000)))
    rows = col.count_tiles(spark.createDataFrame([row], col.CHUNKS)).collect()
    cells = len(set(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)))
    assert sum(len(col.unpack_numbers(bytes(r.counts))) for r in rows) == cells
    assert sum(int(col.unpack_numbers(bytes(r.counts)).sum()) for r in rows) == len(symbols) - 1
    assert sum(len(r.codes) + len(r.counts) for r in rows) < 3 * cells


def test_tables_of_numbers_are_gone_at_the_end(spark, monkeypatch):
    written = []

    def settle(df):
        written.append(out := session.settle(df))
        return out

    monkeypatch.setattr(col, "settle", settle)
    got = col.mine_phrases(spark.createDataFrame([("en", "a b c d")] * 6, "lang string, text string"), least=2).collect()
    assert [r.phrase for r in got] == ["a b c d"]
    large = [df for df in written if {"symbols", "codes"} & set(df.columns)]
    assert len(large) == 9  # chunks, four states, four times tiles
    there = [f for df in large for f in df.inputFiles() if Path(unquote(urlparse(f).path)).exists()]
    assert not there
