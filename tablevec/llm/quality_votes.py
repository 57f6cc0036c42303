"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (null). Texts with the same votes are counted, which
leaves at most 3 to the number of rules rows whatever the input; expectation-maximisation on these
counts estimates how often each rule is right on good and on bad texts, and the share of good texts.
A text is kept if its posterior probability of being good is at least ``least``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevec.session import settle

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 5


def measures(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: key and whole-text counts.

    n_words; word_chars (code points in words); n_symbols; n_lines and n_dup_lines (lines with a word,
    and those equal to an earlier one); n_repeat_words (words in a 5-word window found twice or more,
    the first included; windows are told apart by 64-bit hashes); n_chars; n_upper; n_letters (digits too); n_distinct
    (words); n_stops (sentence ends). A null text counts as empty: all zero.
    """
    t = F.col("__t")
    rows = df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = rows.withColumn("__w", F.filter(F.split(t, BLANK), lambda w: w != ""))
    n = F.size("__w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({
        "__l": lines,
        "__h": F.when(
            n >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), n - WINDOW),
                lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(WINDOW)]),
            ),
        ),
    })
    # repeated windows: equal neighbours once hashes are sorted with their positions
    rows = rows.withColumn("__p", F.when(
        F.size(F.array_distinct("__h")) < F.size("__h"),
        F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    spots = F.sort_array(F.transform(
        F.filter("__p", lambda p, k: _same(p, k - 1, k > 0) | _same(p, k + 1, k + 1 < F.size("__p"))), lambda p: p["i"]
    ))
    covered = F.aggregate(
        spots, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct(
            (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")
        ),
        lambda s: s["n"],
    )
    def without(chars: str) -> Column:
        return F.length(F.translate(t, chars, ""))

    return rows.select(
        key, n.cast("long").alias("n_words"), without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length(t) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"), F.length(t).cast("long").alias("n_chars"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        (F.length(t) - without(".!?")).cast("long").alias("n_stops"),
        F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_letters"),
    )


def _same(p: Column, k: Column, inside: Column) -> Column:
    return F.when(inside, F.get("__p", k)["h"] == p["h"]).otherwise(F.lit(False))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def votes() -> dict[str, Column]:
    """Rule name -> vote over the columns of ``measures``. In between its two limits a rule abstains."""
    words, chars = F.col("n_words"), F.col("word_chars")
    per_word = F.when(words > 0, chars / words)
    symbols = F.when(words > 0, F.col("n_symbols") / words)
    letters = F.when(chars > 0, F.col("n_letters") / chars)
    upper = F.when(chars > 0, F.col("n_upper") / chars)
    repeated = F.when(words > 0, F.col("n_repeat_words") / words)
    doubled = F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines"))
    distinct = F.when(words >= 20, F.col("n_distinct") / F.sqrt(words))
    stops = F.when(words >= 20, F.col("n_stops") / words)
    return {
        "length": _vote(words >= 20, words < 10),
        "word_length": _vote(per_word.between(2.5, 12), (per_word < 1.5) | (per_word > 20)),
        "symbols": _vote(symbols < 0.02, symbols > 0.25),
        "letters": _vote(letters > 0.92, letters < 0.88),
        "capitals": _vote(upper < 0.15, upper > 0.5),
        "repeats": _vote(repeated < 0.05, repeated > 0.25),
        "lines": _vote(doubled < 0.1, doubled > 0.4),
        "variety": _vote(distinct > 3, distinct < 1.5),
        "stops": _vote(stops.between(0.005, 0.5), (stops < 0.0005) | (stops > 0.8)),
    }


def fit_rules(
    counts: list[tuple[tuple[int | None, ...], int]], rules: int, rounds: int = 50,
    on_good: float = 0.99, on_bad: float = 0.15, prior: float = 0.8,
) -> dict:
    """EM over (votes, count) rows: share of good texts, and per rule the chance of a right vote on bad and on good texts.

    It starts from rules that seldom fire on good texts and each know one of several kinds of bad ones. A
    rule never counts against itself (it fires on bad texts at least as often as on good ones), so good and
    bad can't trade places, and no single vote is certain.
    """
    right = [[on_bad] * rules, [on_good] * rules]
    good = prior
    for _ in range(rounds):
        share, total = 0.0, 0
        hit = [[0.0] * rules, [0.0] * rules]
        seen = [[0.0] * rules, [0.0] * rules]
        for row, n in counts:
            p = posterior(row, good, right)
            share, total = share + n * p, total + n
            for r, v in enumerate(row):
                if v is None:
                    continue
                for side, weight in ((0, n * (1 - p)), (1, n * p)):
                    seen[side][r] += weight
                    hit[side][r] += weight * (v == side)
        if total:
            good = min(0.99, max(0.05, share / total))
        # one text's worth of the starting belief keeps rules that rarely vote defined
        of_good = [min(0.999, max(0.5, (hit[1][r] + on_good) / (seen[1][r] + 1))) for r in range(rules)]
        of_bad = [(hit[0][r] + on_bad) / (seen[0][r] + 1) for r in range(rules)]
        right = [[min(0.99, max(1.01 - g, b)) for g, b in zip(of_good, of_bad, strict=True)], of_good]
    return {"good": good, "right": right}


def posterior(row: tuple[int | None, ...], good: float, right: list[list[float]]) -> float:
    odds = math.log(good / (1 - good))
    for r, v in enumerate(row):
        if v == 1:
            odds += math.log(right[1][r] / (1 - right[0][r]))
        elif v == 0:
            odds += math.log((1 - right[1][r]) / right[0][r])
    return 1 / (1 + math.exp(-odds))


def posterior_column(names: list[str], model: dict) -> Column:
    """``posterior`` as an expression over vote columns."""
    good, right = model["good"], model["right"]
    odds = F.lit(math.log(good / (1 - good)))
    for r, name in enumerate(names):
        odds = odds + (
            F.when(F.col(name) == 1, F.lit(math.log(right[1][r] / (1 - right[0][r]))))
            .when(F.col(name) == 0, F.lit(math.log((1 - right[1][r]) / right[0][r])))
            .otherwise(F.lit(0.0))
        )
    return 1 / (1 + F.exp(-odds))


def judge_quality(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """``measures`` with one vote column per rule (``vote_...``), ``base_failed``, ``posterior`` and ``kept``.

    Rows that fail the base rules (fewer than 10 words, or over a fifth of the words repeated) are
    never kept. Nulls: a null text is empty and fails; a null key stays. Repeated rows are judged
    each, equal texts alike. An empty table gives no rows. Extra columns are not read.
    """
    rules = votes()
    names = [f"vote_{x}" for x in rules]
    judged = settle(
        measures(df, text, key)
        .withColumns({f"vote_{x}": v for x, v in rules.items()})
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )
    counted = judged.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    model = fit_rules(sorted(((tuple(r[:-1]), r["n"]) for r in counted), key=str), len(names))
    return judged.withColumn("posterior", posterior_column(names, model)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= least)
    )
