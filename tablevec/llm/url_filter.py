"""URL filter: a broadcast trie over reversed host labels and path segments.

An entry is a host and a path prefix. It fits its host and every subdomain of it if the path of
the url starts with its path. The entry with the most host labels wins, then the one with the
longest path, then block before allow.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class PathNode:
    """Children by whole segment; ``ends`` are the beginnings of a next segment at which an entry ends."""

    __slots__ = ("children", "ends", "lengths", "always")

    def __init__(self):
        self.children, self.ends, self.lengths, self.always = {}, {}, (), None

    def add(self, path: str, entry: int) -> None:
        if not path:
            self.always = entry
            return
        *whole, last = path[1:].split("/")
        node = self
        for segment in whole:
            node = node.children.setdefault(segment, PathNode())
        node.ends[last] = entry
        node.lengths = sorted({len(x) for x in node.ends}, reverse=True)

    def find(self, path: str) -> int | None:
        found, node = self.always, self
        if not path:
            return found
        segments = path[1:].split("/")
        for i, segment in enumerate(segments):
            for n in node.lengths:
                entry = node.ends.get(segment[:n]) if n <= len(segment) else None
                if entry is not None:
                    found = entry
                    break
            node = node.children.get(segment) if i + 1 < len(segments) else None
            if node is None:
                break
        return found


class HostNode:
    __slots__ = ("children", "paths")

    def __init__(self):
        self.children, self.paths = {}, None

    def add(self, host: str, path: str, entry: int) -> None:
        node = self
        for label in reversed(host.split(".")):
            node = node.children.setdefault(label, HostNode())
        node.paths = node.paths or PathNode()
        node.paths.add(path, entry)

    def find(self, host: str, path: str) -> int:
        """Number of the entry that decides, or -1."""
        best, node = -1, self
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            entry = node.paths.find(path) if node.paths else None
            best = best if entry is None else entry
        return best


def build_trie(entries: list[tuple[str, str, str]]) -> HostNode:
    """``entries``: (verdict, host, path); a path is empty or starts with a slash."""
    root = HostNode()
    for i in sorted(range(len(entries)), key=lambda i: entries[i][0] == "block"):
        verdict, host, path = entries[i]
        if verdict not in ("allow", "block") or (path and not path.startswith("/")):
            raise ValueError(f"not an entry: {entries[i]}")
        root.add(host.translate(str.maketrans(UPPER, LOWER)), path, i)
    return root


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty if there is no ``://`` or no url."""
    parts = r"(?s)://([^/?#]*)([^?#]*)"
    return df.withColumns({
        "host": F.coalesce(F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.lit("")),
        "path": F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")),
    })


def judge_urls(
    df: DataFrame, entries: list[tuple[str, str, str]], url: str = "url", key: str = "page_id",
    default: str = "allow", most_entries: int = 2_000_000,
) -> DataFrame:
    """(key, host, path, rule, verdict) of every row; ``rule`` is null where the default holds.

    Nulls: a null url has an empty host and path, so only the default fits. A null key stays.
    Repeated rows are judged each. Other columns are not read. The trie is broadcast; it may hold
    ``most_entries`` entries, more are refused.
    """
    if len(entries) > most_entries:
        raise ValueError(f"{len(entries)} entries; at most {most_entries} are broadcast")
    trie = df.sparkSession.sparkContext.broadcast(build_trie(entries))

    @F.pandas_udf("int")
    def entry(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        find = trie.value.find
        return pd.Series([find(h, p) for h, p in zip(hosts, paths, strict=True)], dtype="int32")

    rules = F.array(*[F.lit(h + p) for _, h, p in entries]) if entries else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(v) for v, _, _ in entries]) if entries else F.array().cast("array<string>")
    at = split_url(df.select(F.col(key).alias(key), F.col(url).alias("__url")), "__url").withColumn(
        "__entry", entry("host", "path")
    )
    return at.select(
        key, "host", "path",
        F.get(rules, F.col("__entry")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("__entry")), F.lit(default)).alias("verdict"),
    )
