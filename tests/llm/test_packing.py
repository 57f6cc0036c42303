import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tablevec.llm import packing
from tablevec.llm.queries import read

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(0)
    out = ["", " ", "a", "a  b", " a", "a ", "a\n", "\na b", "<|endoftext|>a <|endoftext|> b", "can't DON'T we'll", "a\x85 b", "a\u00a0b c", "a \u200bb", "x" * 3000]
    alphabet = "abc É́12'. . <|>\u2003 \n\t\x1e\x85\u00a0\u200b\u180e한😀"
    return out + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(1500)]


def test_ids_equal_the_library(spark):
    texts = odd_texts() + [r.text for r in read(spark, "/root/testdata/sf0.001", "documents").collect()]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert packing.Encoder(PATH).encode(texts) == want
    small = packing.Encoder(PATH)
    small.known.most = 50
    assert [x for i in range(0, len(texts), 20) for x in small.encode(texts[i : i + 20])] == want


def test_pieces_and_sequences(spark):
    texts = [None, *odd_texts(), *[r.text for r in read(spark, "/root/testdata/sf0.001", "documents").collect()]]
    rows = [*enumerate(texts), (None, "null id"), (3, "repeated"), (3, "repeated")]
    df = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, piece int")
    size = 300
    got = packing.pack_documents(df, PATH, size).collect()
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        if i == 3:
            continue
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.length for p in pieces) == len(ids) and pieces[0].start == 0
        assert len(ids) > size or len(pieces) == 1
        assert all(p.length == size for p in pieces[1:]) and 0 < pieces[0].length <= size
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    assert len(by_doc[3]) == 3 and len(by_doc[None]) == 1
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert len(by_sequence) <= math.ceil(sum(r.length for r in got) / size) + 1
    assert packing.pack_documents(df.limit(0), PATH, size).count() == 0


def test_search_grows_squared_fill_and_empties_bins():
    rng = random.Random(2)
    lengths = [rng.randint(100, 700) for _ in range(300)]
    bins, at = [], 0
    while at < len(lengths):  # next fit: a poor start
        members = []
        while at < len(lengths) and sum(lengths[i] for i in members) + lengths[at] <= 1000:
            members.append(at)
            at += 1
        bins.append(members)
    before = sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    better = packing.improve(bins, lengths, 1000)
    fills = [sum(lengths[i] for i in b) for b in better]
    assert sorted(i for b in better for i in b) == list(range(300)) and max(fills) <= 1000
    assert sum(f * f for f in fills) > before and len(better) < len(bins)
    assert len(better) <= math.ceil(sum(lengths) / 1000) * 1.08
    # each of the three steps
    sizes = [5, 4, 3, 2]
    assert packing._step([2], [0], sizes, 3) == ([2], [])
    assert packing._step([0], [2], sizes, 2) == ([0], [2])
    assert packing._step([3, 2], [1], sizes, 1) == ([3, 2], [1])


def test_search_leaves_no_step_in_any_bin():
    """More underfull bins than any bound on them, and no step left between two of all."""
    rng = random.Random(4)
    lengths = [rng.randint(300, 900) for _ in range(4000)]
    start = packing.best_fit(lengths, 2048)
    assert sum(sum(lengths[i] for i in b) < 2048 for b in start) > 400
    better = packing.improve(start, lengths, 2048)
    assert sorted(i for b in better for i in b) == list(range(4000)) and len(better) < len(start)
    fills = [sum(lengths[i] for i in b) for b in better]
    assert max(fills) <= 2048 and sum(f * f for f in fills) > sum(sum(lengths[i] for i in b) ** 2 for b in start)
    open_ = [(f, sorted(b, key=lambda i: lengths[i])) for f, b in zip(fills, better) if f < 2048]
    assert not any(f <= g and a is not b and packing._step(a, b, lengths, 2048 - g) for f, a in open_ for g, b in open_)


def test_groups_of_any_size_hold_all_pieces(spark):
    rows = [(i, 0, 0, 1 + i * 37 % 400, 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "key long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df, 500, group_pieces=700).collect()
    fills = {}
    for r in got:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert sorted(r.key for r in got) == list(range(5000)) and max(fills.values()) <= 500
