"""Secret scan: fixed patterns first, then strings that a learned credential format makes likely.

The patterns find assignments, access keys and hexadecimal runs. What they find labels credentials;
from a bounded sample of these, one probabilistic automaton per kind is inferred by merging
statistically compatible states of the prefix tree. Every long run of credential characters is a
candidate, also one that a pattern matches in part, scored by each automaton against a model of
ordinary long words, which is that of the runs that touch no match.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablevec.llm.batches import Cache, slices, small_batches
from tablevec.session import settle

# fixed values: the patterns, in the order in which kinds are listed
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
HINTS = ("password", "passwd", "secret", "token", "api")
CACHED_WORDS = 200_000
LONGEST_KNOWN = 100
LETTERS = 67  # credential characters and the end
ARRIVALS = 20
LEAN = 10
LOTS = 64


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, number of the kind, credential) of every match of the fixed patterns."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, bool]]:
    """(start, end, value, whether it touches no base span) of long runs of credential characters.

    Only a run that lies in a base span from end to end is left out: it is found already.
    """
    out, near, i = [], [], 0
    reach = sorted((s, e) for s, e, _, _ in base)
    for m in RUN.finditer(text):
        value = m[0].rstrip(".")
        start, end = m.start(), m.start() + len(value)
        if len(value) < 12:
            continue
        while i < len(reach) and reach[i][0] < end:
            near.append(reach[i])
            i += 1
        near = [(s, e) for s, e in near if e > start]
        if not any(s <= start and end <= e for s, e in near):
            out.append((start, end, value, not near))
    return out


class Automaton:
    """A probabilistic automaton inferred from strings, by merging compatible states of their prefix tree.

    Two states are compatible if no ending or next-character frequency differs by more than the Hoeffding bound
    at ``alpha``, and two distributions don't explain what follows them better than one (likelihood ratio, three
    deviations), for them and for all states that merging would fold together. States of one depth are merged
    first, siblings before others, so that places are learned before anything repeats: each goes to the
    compatible one whose next characters are most like its own. Then states of different depths are, which closes loops, but only where
    ``ARRIVALS`` strings passed either: with fewer nothing could tell them apart, and length and place would be lost.
    """

    def __init__(self, strings: Iterable[str], alpha: float = 0.05):
        strings = list(strings)
        self.alpha = alpha
        self.spread = math.sqrt(0.5 * math.log(2 / alpha))
        held = strings[::4] if len(strings) >= 40 else []
        self._infer([s for i, s in enumerate(strings) if not held or i % 4])
        tried = held or strings  # strings that were not learned from, if there are enough
        self.least, self.least_typical = (
            sorted(map(measure, tried))[len(tried) // 50] if tried else math.inf for measure in (self.score, self.typical)
        )
        if held:
            self._infer(strings)

    def _infer(self, strings: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[Counter] = [Counter()]
        self.ended, self.arrived = [0], [0]
        for s in strings:
            self._add(s)
        self.letters: Counter = Counter()
        for x in self.passed:
            self.letters.update(x)
        self.total = max(1, self.letters.total())
        self._close_loops(self._merge_layers())
        self.surprise: dict[int, float] = {}
        self.usual: dict[int, int] = {}

    def _add(self, s: str) -> None:
        at = 0
        self.arrived[0] += 1
        for c in s:
            self.passed[at][c] += 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.passed.append(Counter())
                self.ended.append(0)
                self.arrived.append(0)
            at = self.next[at][c]
            self.arrived[at] += 1
        self.ended[at] += 1

    def _bound(self, n: int, m: int) -> float:
        return self.spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, n: int, ended: int, passed: Counter, m: int, ended_too: int, passed_too: Counter) -> bool:
        bound = self._bound(n, m)
        if bound >= 1:
            return True
        both = [(ended, ended_too), *((passed[c], passed_too[c]) for c in passed.keys() | passed_too.keys())]
        if any(abs(x / n - y / m) > bound for x, y in both):
            return False
        gain = sum(  # of two distributions over one, twice the log-likelihood
            2 * k * math.log(k / size * (n + m) / (x + y)) for x, y in both for k, size in ((x, n), (y, m)) if k
        )
        free = max(1, sum(x + y > 0 for x, y in both) - 1)
        return gain <= free + 3 * math.sqrt(2 * free)

    def _compatible(self, a: int, b: int) -> bool:
        """For two roots of trees."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._bound(self.arrived[a], self.arrived[b]) >= 1:
                continue  # and further down even less is known
            if not self._alike(
                self.arrived[a], self.ended[a], self.passed[a], self.arrived[b], self.ended[b], self.passed[b]
            ):
                return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """``b``, the root of a tree, goes into ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.arrived[a] += self.arrived[b]
            self.ended[a] += self.ended[b]
            self.passed[a].update(self.passed[b])
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _shared(self, a: int, b: int) -> float:
        """How much the next characters of two states overlap, 0 to 1."""
        n, m = self.arrived[a], self.arrived[b]
        both = sum(min(self.passed[a][c] / n, k / m) for c, k in self.passed[b].items())
        return both + min(self.ended[a] / n, self.ended[b] / m)

    def _merge_layers(self) -> list[int]:
        """Merges within each depth, from the first on; the states that are left, by depth."""

        def merge(states: Iterable[int]) -> dict[int, int]:
            """State -> where it went; itself if it stays."""
            went: dict[int, int] = {}
            for state in sorted(states, key=lambda x: (-self.arrived[x], x)):
                fitting = [r for r, to in went.items() if r == to and self._compatible(r, state)]
                went[state] = state
                if fitting:
                    went[state] = max(fitting, key=lambda r: (self._shared(r, state), self.arrived[r], -r))
                    self._fold(went[state], state)
            return went

        left, layer = [0], [0]
        while layer:
            for source in layer:
                went = merge(set(self.next[source].values()))
                self.next[source] = {c: went[x] for c, x in self.next[source].items()}
            went = merge({x for source in layer for x in self.next[source].values()})
            for source in layer:
                self.next[source] = {c: went[x] for c, x in self.next[source].items()}
            layer = sorted({*went.values()})
            left += layer
        return left

    def _close_loops(self, order: list[int]) -> None:
        kept: list[int] = []
        gone: set[int] = set()
        for state in order:
            if state in gone:
                continue
            plan = None
            if state and self.arrived[state] >= ARRIVALS:
                for r in sorted(kept, key=lambda r: (-self.arrived[r], r)):
                    if self.arrived[r] >= ARRIVALS and (plan := self._joined(r, state)) is not None:
                        break
            if plan is None:
                kept.append(state)
            else:
                gone |= self._apply(plan, order)
                kept = [r for r in kept if r not in gone]
        self.states = len([s for s in order if s not in gone])

    def _joined(self, a: int, b: int) -> dict[int, tuple] | None:
        """Every state that merging ``a`` and ``b`` changes -> (representative, arrived, ended, passed, next); None if
        some states that would fold together differ."""
        leader: dict[int, int] = {}
        facts: dict[int, tuple] = {}

        def find(x: int) -> int:
            while leader.get(x, x) != x:
                x = leader[x]
            return x

        def of(x: int) -> tuple:
            return facts.get(x) or (self.arrived[x], self.ended[x], self.passed[x], self.next[x])

        todo = [(a, b)]
        while todo:
            x, y = (find(z) for z in todo.pop())
            if x == y:
                continue
            x, y = min(x, y), max(x, y)
            (n, e, p, f), (m, g, q, h) = of(x), of(y)
            if not self._alike(n, e, p, m, g, q):
                return None
            leader[y] = x
            facts[x] = (n + m, e + g, p + q, {**h, **f})
            todo += [(f[c], h[c]) for c in f.keys() & h.keys()]
        return {x: (find(x), *of(find(x))) for x in {*leader, *facts}}

    def _apply(self, plan: dict[int, tuple], order: list[int]) -> set[int]:
        leader = {x: facts[0] for x, facts in plan.items()}
        for x, (first, arrived, ended, passed, following) in plan.items():
            if x == first:
                self.arrived[x], self.ended[x], self.passed[x], self.next[x] = arrived, ended, passed, dict(following)
        for x in order:
            self.next[x] = {c: leader.get(t, t) for c, t in self.next[x].items()}
        return {x for x, first in leader.items() if x != first}

    def _step(self, at: int, c: str) -> float:
        """Log-likelihood of a character; unseen ones lean on the letters of all states."""
        n = self.arrived[at] if at >= 0 else 0
        seen = self.passed[at][c] if n else 0
        return math.log((seen + LEAN * self.letters[c] / self.total + 0.5 / LETTERS) / (n + LEAN + 0.5))

    def _goes_on(self, at: int, c: str) -> int:
        """The next state; after a character that is new there, the one that most strings reach."""
        if c in self.next[at]:
            return self.next[at][c]
        if at not in self.usual:
            reached: Counter = Counter()
            for x, state in self.next[at].items():
                reached[state] += self.passed[at][x]
            self.usual[at] = max(reached, key=lambda x: (reached[x], -x), default=-1)
        return self.usual[at]

    def _steps(self, s: str) -> list[tuple[int, float]]:
        """State and log-likelihood of each character and of the end; -1 once no state is left."""
        out, at = [], 0
        for c in s:
            out.append((at, self._step(at, c)))
            at = self._goes_on(at, c) if at >= 0 else -1
        n = self.arrived[at] if at >= 0 else 0
        return [*out, (at, math.log(((self.ended[at] if n else 0) + 0.5 / LETTERS) / (n + 0.5)))]

    def _expected(self, at: int) -> float:
        """The mean log-likelihood of what follows a state; 0 off the automaton, where nothing is expected."""
        if at < 0:
            return 0.0
        if at not in self.surprise:
            n = self.arrived[at]
            parts = [k / n for k in (self.ended[at], *self.passed[at].values()) if k]
            self.surprise[at] = sum(p * math.log(p) for p in parts)
        return self.surprise[at]

    def score(self, s: str) -> float:
        """Mean log-likelihood of a character, the end included."""
        return sum(x for _, x in self._steps(s)) / (len(s) + 1)

    def typical(self, s: str) -> float:
        """``score`` less what the states on the way lead to expect, so that formats of many and of few letters compare."""
        return sum(x - self._expected(at) for at, x in self._steps(s)) / (len(s) + 1)

    def accepts(self, s: str) -> bool:
        return self.score(s) >= self.least and self.typical(s) >= self.least_typical


def pairs_of(words: Iterable[str]) -> Counter:
    """How often each two characters follow each other, "^" before the first and "$" after the last."""
    out: Counter = Counter()
    for w in words:
        out.update(zip("^" + w, w + "$", strict=True))
    return out


class Ordinary:
    """Character-pair model of ordinary long words, from the counts of their pairs."""

    def __init__(self, pairs: Counter):
        self.pairs = pairs
        self.first: Counter = Counter()
        for (a, _), n in pairs.items():
            self.first[a] += n

    def score(self, s: str) -> float:
        """Mean log-likelihood of a pair, without what the string itself added to the counts."""
        steps = list(zip("^" + s, s + "$", strict=True))
        own, own_first = Counter(steps), Counter(a for a, _ in steps)
        total = 0.0
        for (a, b), k in own.items():
            n, of = max(0, self.pairs[a, b] - k), max(0, self.first[a] - own_first[a])
            total += k * math.log((n + 0.5) / (of + 0.5 * LETTERS))
        return total / (len(s) + 1)


def scan_base(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, base, found): base spans with their credentials, and candidates, of every row."""
    rows = small_batches(df).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("apart", pa.bool_())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            base, found = [], []
            for t in batch.column("text").to_pylist():
                spans = base_spans(t)
                base.append([dict(zip(("start", "end", "kind", "value"), s, strict=True)) for s in spans])
                found.append([dict(zip(("start", "end", "value", "apart"), s, strict=True)) for s in candidates(t, spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(base, base_type), pa.array(found, found_type)], ["key", "base", "found"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        work, f"key {kind}, base array<struct<start:int,end:int,kind:int,value:string>>, "
        "found array<struct<start:int,end:int,value:string,apart:boolean>>"
    )


def count_pairs(words: DataFrame) -> Counter:
    """``pairs_of`` the column ``value``; no more rows come to the driver than there are pairs of characters."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, 1024):
            total.update(pairs_of(batch.column("value").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([a + b for a, b in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"]
        )

    counts = words.select("value").mapInArrow(work, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return Counter({(r.pair[0], r.pair[1]): r.n for r in counts.collect()})


def learn_formats(scanned: DataFrame, per_kind: int = 400, longest: int = 100) -> tuple[list[Automaton], Ordinary]:
    """Automata from at most ``per_kind`` different labelled credentials of each kind, lowest hashes first
    and none of over ``longest`` characters, and the model of ordinary words from all different candidates that touch no base span."""
    labelled = scanned.select(F.explode("base").alias("b")).select("b.kind", "b.value").where(F.length("value") <= longest).distinct()
    for group in (["kind", F.pmod(F.hash("value"), F.lit(LOTS))], ["kind"]):  # few rows of a kind meet
        by_hash = Window.partitionBy(*group).orderBy(F.xxhash64("value"), "value")
        labelled = labelled.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= per_kind).drop("r")
    strings: dict[int, list[str]] = {}
    for r in labelled.collect():
        strings.setdefault(r.kind, []).append(r.value)
    words = scanned.select(F.explode("found").alias("f")).where("f.apart").select("f.value").distinct()
    return [Automaton(sorted(v)) for _, v in sorted(strings.items())], Ordinary(count_pairs(words))


class Formats:
    """Decides on candidates: some automaton must give at least the likelihood of the least likely fiftieth of
    the credentials it was tried on, and ``margin`` per character more than ordinary words give."""

    def __init__(self, automata: list[Automaton], ordinary: Ordinary, margin: float):
        self.automata, self.ordinary, self.margin = automata, ordinary, margin
        self.known = Cache(CACHED_WORDS)

    def likely(self, value: str) -> bool:
        if len(value) > LONGEST_KNOWN:
            return self._likely(value)
        if value not in self.known:
            self.known.make_room(1)
            self.known[value] = self._likely(value)
        return self.known[value]

    def _likely(self, value: str) -> bool:
        plain = self.ordinary.score(value) + self.margin
        return any(a.accepts(value) and a.score(value) >= plain for a in self.automata)


def scan_secrets(df: DataFrame, text: str = "text", key: str = "doc_id", margin: float = 0.5) -> DataFrame:
    """(key, spans) of every row; spans: array of (start, end, kind), by start, then kind as in ``KINDS``.

    Code points, end exclusive; ``format`` spans are candidates that ``Formats`` accepts. Nulls: a null text
    has no spans; a null key stays. Repeated rows are scanned each. Without any labelled credential only base
    spans (so none) are found. An empty table gives no rows. Extra columns are not read.
    """
    scanned = settle(scan_base(df, text, key))
    shared = df.sparkSession.sparkContext.broadcast(Formats(*learn_formats(scanned), margin))

    @F.pandas_udf("array<boolean>")
    def likely(values: pd.Series) -> pd.Series:
        judge = shared.value.likely
        return values.map(lambda vs: None if vs is None else [judge(v) for v in vs])

    judged = scanned.withColumn("likely", likely("found.value"))
    more = F.transform(
        F.filter(F.arrays_zip("found", "likely"), lambda x: x["likely"]),
        lambda x: F.struct(x["found"]["start"].alias("start"), F.lit(3).alias("kind"), x["found"]["end"].alias("end")),
    )
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    return judged.select(
        F.col("key").alias(key),
        F.transform(
            F.array_sort(F.concat(base, more)),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind")),
        ).alias("spans"),
    )


def mask_spans(text: str, spans: Iterable[tuple[int, int]], mask: str) -> str:
    """The text with every span, overlapping ones joined, replaced by ``mask``."""
    out, at = [], 0
    joined: list[list[int]] = []
    for start, end in sorted(spans):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    for start, end in joined:
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, text: str = "text", mask: str = "[secret]", margin: float = 0.5) -> DataFrame:
    """All rows and columns of ``df``, every secret in ``text`` replaced; null texts stay null."""
    learned = learn_formats(settle(scan_base(df.select(F.lit(0).cast("long").alias("key"), F.col(f"`{text}`").alias("text")), key="key")))
    shared = df.sparkSession.sparkContext.broadcast(Formats(*learned, margin))

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        spans = [(s, e) for s, e, _, _ in base]
        spans += [(s, e) for s, e, v, _ in candidates(t, base) if shared.value.likely(v)]
        return mask_spans(t, spans, mask) if spans else t

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean)

    return df.withColumn(text, cleaned(F.col(f"`{text}`")))
