"""Chat formatting with Spark expressions only.

A conversation becomes parts of at most ``part_turns`` consecutive turn numbers, so a conversation
of any length never has to meet in one row; its text is its parts' texts one after another. Turns
are collected as structs and sorted, neighbours of the same role are merged into one block (across
parts too), and the pieces are concatenated. The loss mask is a list of spans in each part's text.

Block: ``<|im_start|>role\\n`` text ``<|im_next|>`` text ... ``<|im_end|>\\n``. In texts and roles the first
character of anything that reads as a control string is replaced by a backslash code, and a backslash
by ``\\e``, so no text holds a control string and three plain replacements undo it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
# fixed values: control strings of this and of common other templates, as patterns of what follows the first character
AFTER_ANGLE = r"\|[^<>|]*\|>|/?s>|/?SYS>>|</?SYS>>"
AFTER_SQUARE = r"/?INST\]"


def escape(text: Column) -> Column:
    """Text without control strings; ``unescape`` gives the text back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    out = F.regexp_replace(out, f"<(?={AFTER_ANGLE})", "\\\\l")
    return F.regexp_replace(out, rf"\[(?={AFTER_SQUARE})", "\\\\b")


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(df: DataFrame, learned: tuple[str, ...] = ("assistant",), part_turns: int = 64) -> DataFrame:
    """(conv_id, part, formatted, loss_spans) of rows (conv_id, turn, role, text).

    ``loss_spans``: array of (start, end) in code points of ``formatted``, one for each text of a
    learned role, in order. Nulls: a null text or role is empty; null turns come first; null
    conversation ids form one conversation. Turns with the same number go by role, then text, so the
    result doesn't depend on row order; repeated rows are repeated turns. Empty texts keep their turn.
    Extra columns are not read.
    """
    rows = df.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = (
        rows.groupBy("conv_id", F.floor(F.col("turn") / part_turns).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    order = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.withColumns({
        "before": F.lag(F.element_at("turns", -1)["role"]).over(order),
        "after": F.lead(F.element_at("turns", 1)["role"]).over(order),
    })

    def piece(turn: Column, i: Column) -> Column:
        previous = F.when(i > 0, F.get("turns", i - 1)["role"]).otherwise(F.col("before"))
        following = F.when(i + 1 < F.size("turns"), F.get("turns", i + 1)["role"]).otherwise(F.col("after"))
        opening = F.concat(F.lit(START), _role(turn["role"]), F.lit("\n"))
        return F.struct(
            F.when(previous.eqNullSafe(turn["role"]), F.lit(NEXT)).otherwise(opening).alias("lead"),
            escape(turn["text"]).alias("body"),
            F.when(following.eqNullSafe(turn["role"]), F.lit("")).otherwise(F.lit(END)).alias("tail"),
            turn["role"].isin(*learned).alias("learned"),
        )

    pieces = parts.select("conv_id", "part", F.transform("turns", piece).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"], p["tail"])), "")
    # a part is short, so carrying the list along is cheap
    empty = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["lead"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(p["learned"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + F.length(p["tail"])).alias("at"), spans.alias("spans"))

    return pieces.select(
        "conv_id", "part", text.alias("formatted"),
        F.aggregate("pieces", empty, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column, opened: Column) -> Column:
    """Array of (role, text) of a part's text; ``opened`` is the role of a block that an earlier part began."""
    cut = F.split(formatted, r"(?=<\|im_start\|>|<\|im_next\|>)")
    marked = F.filter(cut, lambda x: x != "")
    plain = F.transform(marked, lambda x: F.regexp_replace(x, r"<\|im_end\|>\n\z", ""))

    def header(x: Column) -> Column:
        return F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)

    heads = F.transform(plain, lambda x: F.when(x.startswith(START), header(x)))
    # the role of a continued text is that of the nearest header before it
    known = F.aggregate(
        heads, F.struct(opened.alias("role"), F.expr("CAST(array() AS array<string>)").alias("all")),
        lambda s, h: F.struct(
            F.coalesce(h, s["role"]).alias("role"), F.array_append(s["all"], F.coalesce(h, s["role"])).alias("all")
        ),
        lambda s: s["all"],
    )
    return F.transform(
        F.arrays_zip(known.alias("role"), heads.alias("head"), plain.alias("body")),
        lambda x: F.struct(
            _unrole(x["role"]).alias("role"),
            unescape(
                F.when(x["head"].isNull(), F.substr(x["body"], F.lit(len(NEXT) + 1)))
                .otherwise(F.substr(x["body"], F.length(x["head"]) + len(START) + 2))
            ).alias("text"),
        ),
    )


def read_back(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from ``format_chats`` rows.

    A digest of a conversation needs its text in one row; only here do its parts meet.
    """
    order = Window.partitionBy("conv_id").orderBy("part")
    last = F.element_at(F.split("formatted", r"<\|im_start\|>"), -1)
    opened = F.when(F.contains("formatted", F.lit(START)), F.substring_index(last, "\n", 1))
    seen = parts.withColumn("opened", F.last(opened, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("turns", read_turns(F.col("formatted"), F.col("opened")))
    masked = F.transform(
        "loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))
    )
    seen = seen.select(
        "conv_id", "part", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(masked, "").alias("loss"),
    )
    whole = seen.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("part", "said", "loss"))).alias("all"),
    )
    said, loss = F.array_join("all.said", ""), F.array_join("all.loss", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
