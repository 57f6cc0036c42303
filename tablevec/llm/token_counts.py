"""Token counts of a word-end byte-pair vocabulary by rank-synchronous merging of ragged arrays.

A text is cut at ASCII white space, which this family of tokenizers drops and never joins across,
so a text's count is the sum over its chunks. Chunks not seen before by the worker go through the
vocabulary file's own normaliser and splitter; their pre-tokens are held together as one flat array
of symbols with row lengths, and in each pass every row merges its lowest-ranked pair, all rows at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevec.llm.batches import Cache, kept, slices, small_batches

CACHED_CHUNKS = 1_000_000


class Merger:
    """Counts symbols left after all merges; ``path`` is a tokenizers file with a BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a plain BPE vocabulary is needed")
        if spec["pre_tokenizer"] is None or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("a splitter, and added tokens that match exactly, are needed")
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        suffix = model.get("end_of_word_suffix") or ""
        self.folds = any(x.get("type") == "Lowercase" for x in (spec["normalizer"] or {}).get("normalizers", []))
        vocab = model["vocab"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        # the splitter writes each byte as one character; a vocabulary must know them all
        letters = [x for x in vocab if len(x) == 1]
        self.inner = np.zeros(1 + max(map(ord, letters)), dtype=np.int64)
        self.final = self.inner.copy()
        for x in letters:
            self.inner[ord(x)], self.final[ord(x)] = vocab[x], vocab[x + suffix]
        self.known = Cache(CACHED_CHUNKS)

    def symbols(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol ids of all pre-tokens one after another, and the row of each; the last of a row carries the word end."""
        codes = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, pre_tokens), dtype=np.int64, count=len(pre_tokens))
        flat = self.inner[codes]
        last = np.cumsum(lengths) - 1
        flat[last] = self.final[codes[last]]
        return flat, np.repeat(np.arange(len(pre_tokens)), lengths)

    def merged_lengths(self, flat: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        """How many symbols each row has after all merges."""
        out, never = np.zeros(rows, dtype=np.int64), np.iinfo(np.int64).max
        while len(flat):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lengths = np.diff(np.append(starts, len(flat)))
            pair = flat[:-1] << 32 | flat[1:]
            spot = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[spot] == pair, self.ranks[spot], never), never)
            rank[starts[1:] - 1] = never  # no pair reaches into the next row
            best = np.minimum.reduceat(rank, starts)
            # rows without a pair left are finished and leave the arrays
            done = best == never
            out[owner[starts[done]]] = lengths[done]
            stay = np.repeat(~done, lengths)
            at = np.flatnonzero(_apart((rank == np.repeat(best, lengths)) & stay))
            flat[at] = self.made[spot[at]]
            stay[at + 1] = False
            flat, owner = flat[stay], owner[stay]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Counts of chunks that hold no blank: normalised, split and merged together."""
        if not chunks:
            return
        clean = self.normalize(" ".join(chunks))
        if clean.count(" ") != len(chunks) - 1:  # white space beyond ASCII, or all of a chunk went
            for chunk in chunks:
                clean = self.normalize(chunk)
                self.known[chunk] = int(self._merge([t for t, _ in self.splitter.pre_tokenize_str(clean)]).sum())
            return
        starts = np.cumsum([0, *[len(x) + 1 for x in clean.split(" ")]])
        split = self.splitter.pre_tokenize_str(clean)
        at = np.fromiter((span[0] for _, span in split), dtype=np.int64, count=len(split))
        of = np.searchsorted(starts, at, side="right") - 1
        counts = np.bincount(of, weights=self._merge([t for t, _ in split]), minlength=len(chunks))
        self.known.update(zip(chunks, counts.astype(int).tolist(), strict=True))

    def normalize(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _merge(self, pre_tokens: list[str]) -> np.ndarray:
        flat, owner = self.symbols(pre_tokens)
        return self.merged_lengths(flat, owner, len(pre_tokens))

    def count(self, texts: list[str]) -> list[int]:
        out = []
        texts = [self.cut(t) for t in texts]
        new = {c for _, chunks in texts for c in chunks if c not in self.known}
        if new and len(self.known) + len(new) > self.known.most:
            self.known.make_room(len(new))
            new = {c for _, chunks in texts for c in chunks}
        self.learn(sorted(new))
        known = self.known
        for special, chunks in texts:
            out.append(special + sum(map(known.__getitem__, chunks)))
        return out

    def cut(self, text: str) -> tuple[int, list[str]]:
        """Number of added tokens that stand in the text, and the chunks around them."""
        if not any(s in text for s in self.special):
            return 0, self.chunks(text)
        n, chunks = 0, []
        while text:
            found = min(((text.find(s), -len(s), s) for s in self.special if s in text), default=None)
            if found is None:
                break
            chunks += self.chunks(text[: found[0]])
            text = text[found[0] + len(found[2]):]
            n += 1
        return n, chunks + self.chunks(text)

    def chunks(self, text: str) -> list[str]:
        if self.folds:
            try:
                text.encode("latin-1")
                text = text.lower()  # what the normaliser does to these characters, so that more chunks are alike
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _apart(take: np.ndarray) -> np.ndarray:
    """Of neighbouring marks, every second one goes (left to right): ``aaa`` merges its first two."""
    if not (take[1:] & take[:-1]).any():
        return take
    at = np.arange(len(take))
    start = np.maximum.accumulate(np.where(take & ~np.concatenate(([False], take[:-1])), at, 0))
    return take & ((at - start) % 2 == 0)


def merger(path: str) -> Merger:
    """The one of this worker."""
    return kept(("merger", path), lambda: Merger(path))


def count_tokens(df: DataFrame, tokenizer: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; ``over_limit``: more than ``limit`` tokens.

    ``tokenizer`` is a vocabulary file that every worker can open. Nulls: a null text counts as empty
    (no bytes, no tokens); a null key stays. Repeated rows are counted each. Texts of any length are
    read whole. Extra columns are not read.
    """
    rows = small_batches(df).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(tokenizer)
        for batch in slices(batches, 512):
            texts = batch.column("text").to_pylist()
            counts = counter.count(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(size, pa.int64()), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(work, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
