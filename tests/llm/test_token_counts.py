import random

import public_tokenizers
from tokenizers import Tokenizer

from tablevec.llm.queries import read
from tablevec.llm.token_counts import Merger, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(0)
    out = ["", " ", "<|endoftext|>a<|startoftext|><|endoftext|> b", "<|endof", "can't DON'T we'll", "İſK", "a\u0301 é", "a" * 70, "aaa aaaa aaaaa",
           "\x00\x01\x1c\x85  x", "日本語 1234 ½", "👩\u200d👩\u200d👧", "ﬀ ﷺ", "a b c", "Σας ΣΑΣ", "word<|endoftext|>word", "\u1680x"]
    alphabet = "abcABC é\u0301\u0307ßÅ12'.,<|> \n\t\x1e한가😀'stm"
    return out + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(800)]


def test_equals_the_library(spark):
    texts = odd_texts() + [r.text for r in read(spark, "/root/testdata/sf0.001", "documents").collect()]
    library = Tokenizer.from_file(PATH)
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert Merger(PATH).count(texts) == want
    rows = [*enumerate(texts), (None, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int")
    got = {r.doc_id: r for r in count_tokens(df, PATH, 100).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len(t.encode()) for t in texts]
    assert [got[i].over_limit for i in range(len(texts))] == [n > 100 for n in want]
    assert tuple(got[None])[1:] == (0, 0, False)
    assert count_tokens(df.limit(0), PATH, 100).count() == 0


def test_a_small_cache_changes_nothing():
    texts = odd_texts()
    small = Merger(PATH)
    small.known.most = 50
    assert [n for i in range(0, len(texts), 10) for n in small.count(texts[i : i + 10])] == Merger(PATH).count(texts)
