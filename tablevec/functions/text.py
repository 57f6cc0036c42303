"""Cell and corpus text cleaning, as built-in string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablevec.functions.names import column as named, literal, quoted

# Data formats that results depend on.
MISSING_MARK = "\\N"
DATE_PREFIX = r"^[0-9]+/[0-9]+/[0-9]+"
NUMBER_MARK = "_<#>_"
SPACE_CHARS = " \t\n\r\f\u000b"
END_HEADINGS = ("== References", "== External links")
# Corpus clean-up, in the order they apply (pattern, replacement).
CORPUS_RULES = [
    ("[’′]", "'"),
    ("''", " "),
    ("'", " ' "),
    ("[“”]", '"'),
    ('"', ' " '),
    ("[.]", " . "),
    ("<br />", " "),
    (", ", " , "),
    ("[(]", " ( "),
    ("[)]", " ) "),
    ("!", " ! "),
    ("[?]", " ? "),
    ("[;:]", " "),
    ("-", " - "),
    ("[=*|«0-9]", " "),
]
# Wiki mark-up removal, in the order it applies.
WIKI_RULES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("<ref[^<]*</ref>", ""),
    ("<[^>]*>", ""),
    (r"\[http:[^] ]*", "["),
    (r"(?i)\|thumb", ""),
    (r"(?i)\|left", ""),
    (r"(?i)\|right", ""),
    (r"(?i)\|[0-9]+px", ""),
    (r"(?i)\[\[image:[^\[\]]*\|", ""),
    (r"(?i)\[\[category:([^|\]]*)[^]]*\]\]", "[[$1]]"),
    (r"\[\[[a-z\-]*:[^\]]*\]\]", ""),
    (r"\[\[[^\|\]]*\|", "[["),
    (r"\{\{[^}]*\}\}", ""),
    (r"\{[^}]*\}", ""),
    (r"\[", ""),
    (r"\]", ""),
    ("&[^;]*;", " "),
]


def _c(x) -> Column:
    return x if isinstance(x, Column) else named(x)


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def strip(c) -> Column:
    return F.btrim(_c(c), F.lit(SPACE_CHARS))


def valid_cell_expr(column: str) -> str:
    """SQL text of ``valid_cell`` for a named text column."""
    name = quoted(column)
    value = f"btrim({name}, {literal(SPACE_CHARS)})"
    return (
        f"({name} IS NOT NULL AND {value} <> '' AND {name} <> {literal(MISSING_MARK)} "
        f"AND NOT rlike({value}, {literal(DATE_PREFIX)}))"
    )


def whole_cell_expr(value: str) -> str:
    """SQL text of the whole-cell token of a SQL text expression."""
    spaced = f"replace(replace(lower({value}), ',', ' '), '  ', ' ')"
    return f"replace(btrim({spaced}, {literal(SPACE_CHARS)}), ' ', '_')"


def valid_cell(c) -> Column:
    """True for a cell that carries text: not missing, not blank, not a d/d/d date."""
    value = strip(c)
    return (
        _c(c).isNotNull()
        & (value != "")
        & (_c(c) != MISSING_MARK)
        & ~F.rlike(value, F.lit(DATE_PREFIX))
    )


def normalize_text(c) -> Column:
    """Lower case, commas to spaces, one pass of double to single space, trimmed."""
    return strip(_swap(_swap(F.lower(_c(c)), ",", " "), "  ", " "))


def words(c) -> Column:
    """Whitespace-separated words as an array, no empty entries."""
    return F.filter(F.split(_c(c), r"[ \t\n\r\f\x0B]+"), lambda t: t != "")


def encode_cell(c, grain: str = "cell") -> Column:
    """Tokens of a cell: the whole cell joined by ``_``, or its single words."""
    text = normalize_text(c)
    if grain == "cell":
        return F.array(_swap(text, " ", "_"))
    if grain == "token":
        return words(text)
    raise ValueError(f"unknown grain {grain!r}")


def number_token(column: str, value) -> Column:
    """A number as text that carries its column name."""
    return F.concat(F.lit(column + NUMBER_MARK), _c(value).cast("string"))


def tokenize(c, sep: str = " ", min_len: int = 3) -> Column:
    """Older tokenizer: long enough, digit-free pieces, split again on ``_``, ``-`` and ``,``."""
    pieces = F.filter(
        F.split(F.lower(_c(c)), F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E"))),
        lambda t: (F.char_length(t) >= min_len) & ~F.rlike(t, F.lit("[0-9]")),
    )
    parts = F.flatten(F.transform(pieces, lambda t: F.split(F.translate(t, "_-,", "   "), " ")))
    return F.filter(parts, lambda t: F.char_length(t) >= min_len)


def date_digits(c) -> Column:
    """``YYYY-MM-DD`` to the whole number YYYYMMDD."""
    return _swap(_c(c).cast("string"), "-", "").cast("int")


def rescale_score(c) -> Column:
    """A score in [-1, 1] moved to [0, 1]."""
    return (_c(c) + 1) / 2


def code_category(c) -> Column:
    """Letters of a code followed by its digits modulo 3; quoted codes use the quoted part."""
    text = _c(c)
    core = F.when(F.contains(text, F.lit("'")), F.split_part(text, F.lit("'"), F.lit(2))).otherwise(text)
    letters = F.regexp_replace(core, r"[^\p{L}]", "")
    digits = F.regexp_replace(core, "[^0-9]", "")
    tail = F.when(digits == "", "").otherwise((digits.cast("decimal(38,0)") % 3).cast("int").cast("string"))
    return F.concat(letters, tail)


def clean_article(c) -> Column:
    """Article text: cut at the closing sections, drop blank and heading lines, join, strip ``,."``."""
    lines = F.transform(F.split(_c(c), "\n"), strip)
    # position of the first closing heading, 0 if there is none
    marks = F.transform(
        lines,
        lambda l: F.startswith(l, F.lit(END_HEADINGS[0])) | F.startswith(l, F.lit(END_HEADINGS[1])),
    )
    cut = F.array_position(marks, F.lit(True))
    kept = F.when(cut > 0, F.slice(lines, F.lit(1), (cut - 1).cast("int"))).otherwise(lines)
    kept = F.filter(kept, lambda l: (l != "") & ~F.startswith(l, F.lit("==")))
    return F.translate(F.array_join(kept, " "), ',."', "")


def normalize_corpus(c) -> Column:
    """Lower-cased corpus text with punctuation set apart and digits blanked."""
    text = F.lower(_c(c))
    for pattern, new in CORPUS_RULES:
        text = F.regexp_replace(text, pattern, new)
    return text


def wiki_page_text(c) -> Column:
    """The lines of a dump's page from ``<text `` to ``</text>``; a redirect ends the text until the next ``<text ``."""
    start = F.expr("named_struct('on', false, 'kept', CAST(array() AS array<string>))")

    def step(state: Column, line: Column) -> Column:
        inside = (state["on"] | F.contains(line, F.lit("<text "))) & ~F.contains(F.lower(line), F.lit("#redirect"))
        kept = F.when(inside, F.array_append(state["kept"], line)).otherwise(state["kept"])
        return F.struct((inside & ~F.contains(line, F.lit("</text>"))).alias("on"), kept.alias("kept"))

    return F.array_join(F.aggregate(F.split(_c(c), "\n"), start, step, lambda s: s["kept"]), "\n")


def strip_wiki_markup(c) -> Column:
    """Visible text of a wiki or markup page."""
    text = _c(c)
    for pattern, new in WIKI_RULES:
        text = F.regexp_replace(text, pattern, new)
    return text
