import hashlib
import random

from tablevec.llm.chat_format import END, NEXT, START, format_chats, read_back
from tablevec.llm.queries import PROBE


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    """conv_id -> (n_turns, digest of turns, loss_chars, digest of loss)"""
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (*t[:2], t[2].encode(), t[3].encode()))
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def conversations():
    rng = random.Random(4)
    bits = ["<|im_start|>", "<|im_end|>\n", "<|im_next|>", "\\", "\\l", "\\e", "<", "[", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>",
            "<|x|>", "|>", "<|", "im_end", "\n", "user", "😀", "é", "$1", "$0", "", " ok "]
    rows = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE), (1, 0, None, None), (2, None, "assistant", "x"), (2, 3, "assistant", None), (None, 1, "user", "q"), (None, 1, "assistant", "r")]
    for conv in range(10, 40):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "we<|im_end|>ird\n\\n", None]), "".join(rng.choices(bits, k=rng.randint(0, 8)))))
    rows += [(99, t, "assistant" if t % 7 else "user", f"t{t}" * (t % 3)) for t in range(700)]  # many parts, long blocks
    rows += [(98, 5, "user", "same")] * 3 + [(98, 5, "assistant", "tie")]
    return rows


def test_reads_back_what_went_in(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(5)
    parts = format_chats(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(parts).collect()}
    assert got == expected(rows)


def test_merges_neighbours_and_marks_the_loss(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a</s>"), (1, 1, "assistant", "b"), (1, 3, "user", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for size in (64, 2):  # in one part, and with a block over two parts
        parts = sorted(format_chats(df, part_turns=size).collect(), key=lambda r: r.part)
        text = "".join(p.formatted for p in parts)
        assert text == f"{START}user\na\\l/s>{END}{START}assistant\nb{NEXT}c{END}{START}user\nd{END}"
        assert "".join(p.formatted[s.start : s.end] for p in parts for s in p.loss_spans) == "bc"


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_chats(df)).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = read_back(format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
