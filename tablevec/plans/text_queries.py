"""Queries: rows and columns as token sequences, pairs, terms, corpus cleaning."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablevec.functions import text
from tablevec.functions.ordering import number_rows
from tablevec.operators import textify
from tablevec.plans.tables import COLUMNS, DIMENSIONS, EVERYTHING, cells_sql, norm_sql, read, repository, row_ids, tokens_sql

WORDY = ("p_name",)
STRATEGIES = {"part": {"p_name": ("augment", "token")}}


def _tokens(spark, d, names=DIMENSIONS, strategies=STRATEGIES):
    return textify.repository_tokens(repository(spark, d, names), row_ids(names), strategies)


def _lists(spark, d, names=DIMENSIONS, strategies=STRATEGIES):
    return textify.repository_lists(repository(spark, d, names), row_ids(names), strategies)


TOK = tokens_sql(DIMENSIONS, token_cols=WORDY)


def cells(spark, d):
    """Valid cells of every table with their numeric text, by row and column."""
    return textify.repository_cells(repository(spark, d, DIMENSIONS), row_ids(), STRATEGIES).select(
        "relation", "row_id", "col", "pos", "value", "grain"
    )


CELLS_SQL = cells_sql(DIMENSIONS, token_cols=WORDY)


def textify_rows(spark, d):
    return textify.row_documents(_lists(spark, d)).select(
        "relation", "row_id", F.array_join("tokens", " ").alias("tokens")
    )


ROWS_SQL = f"""SELECT relation, row_id, string_agg(token, ' ' ORDER BY pos, tpos) AS tokens FROM ({TOK}) GROUP BY ALL"""


def textify_row_nodes(spark, d):
    return textify.base_table_documents(_lists(spark, d, ("customer",))).select(
        "row_id", F.array_join("tokens", " ").alias("tokens")
    )


ROW_NODES_SQL = f"""SELECT row_id, string_agg(token, ' ' ORDER BY pos, tpos) || ' customer_row:' || row_id AS tokens
FROM ({tokens_sql(('customer',))}) GROUP BY row_id"""


def textify_cols(spark, d):
    return textify.column_sequence(_tokens(spark, d))


COLS_SQL = f"""SELECT relation, col, row_number() OVER (PARTITION BY relation, col ORDER BY row_id, tpos) - 1 AS seq, token
FROM ({TOK})"""


def token_frequencies(spark, d):
    """Every token of the whole repository with its tables and columns."""
    toks = _tokens(spark, d, EVERYTHING)
    return toks.groupBy("relation", "col", "token").agg(F.count(F.lit(1)).alias("n"))


FREQ_SQL = f"""SELECT relation, col, token, count(*) AS n FROM ({tokens_sql(EVERYTHING, token_cols=WORDY)}) GROUP BY ALL"""


def _draw_sql(seed, *keys) -> str:
    return "('0x' || substr(md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(keys) + ")), 1, 8))::BIGINT"


def permuted_rows(spark, d):
    return textify.permuted_rows(_lists(spark, d), 20, seed=7).select(
        F.col("perm").cast("bigint").alias("perm"), "relation", "row_id", F.array_join("tokens", " ").alias("tokens"), "line"
    )


def permuted_pairs(spark, d):
    return textify.permuted_pairs(_lists(spark, d, ("region", "nation", "supplier")), 20, seed=7).select(
        F.col("perm").cast("bigint").alias("perm"), "relation", "row_id", F.array_join("tokens", " ").alias("tokens"), "line"
    )


def _permuted_sql(tok, word) -> str:
    u = _draw_sql(7, "perm", "relation", "row_id", "col")
    return f"""WITH t AS ({tok}), p AS (SELECT t.*, perm FROM t, range(0, 20) AS r(perm))
SELECT perm, relation, row_id, string_agg({word}, ' ' ORDER BY {u}, pos, tpos) AS tokens,
{_draw_sql(7, 'perm', 'relation', 'row_id')} AS line FROM p GROUP BY perm, relation, row_id"""


def permuted_columns(spark, d):
    """The drawn order of each column's rows, summed up per permutation."""
    p = textify.permuted_columns(_tokens(spark, d), 20, seed=7)
    return textify.permuted_ends(p).withColumn("perm", F.col("perm").cast("bigint"))


PERM_COLS_SQL = f"""WITH t AS ({TOK}), p AS (SELECT t.*, perm, {_draw_sql(7, 'perm', 'relation', 'col', 'row_id')} AS place
FROM t, range(0, 20) AS r(perm))
SELECT perm, relation, col, count(*) AS n, first(token ORDER BY place, row_id, tpos) AS first_token,
last(token ORDER BY place, row_id, tpos) AS last_token FROM p GROUP BY perm, relation, col"""


def _text_cells(name) -> str:
    return ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c, _ in COLUMNS[name])


def row_strings(spark, d):
    out = None
    for n in ("region", "nation", "customer", "part"):
        s = textify.row_strings(read(spark, d, n))
        out = s if out is None else out.unionAll(s)
    return out


ROW_STRINGS_SQL = " UNION ALL ".join(
    f"SELECT concat_ws(',', {_text_cells(n)}) AS line FROM {n}" for n in ("region", "nation", "customer", "part")
)


def row_strings_filter_digits(spark, d):
    out = None
    for n in ("customer", "part", "orders"):
        s = textify.row_strings_filter_digits(read(spark, d, n)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
        out = s if out is None else out.unionAll(s)
    return out


FILTER_DIGITS_SQL = " UNION ALL ".join(
    f"SELECT array_to_string([lower(v) FOR v IN [{_text_cells(n)}] IF length(v) >= 3 AND NOT regexp_matches(v, '[0-9]')], ',') AS line, "
    f"count(*) AS n FROM {n} GROUP BY 1"
    for n in ("customer", "part", "orders")
)


def row_strings_with_header(spark, d):
    named = read(spark, d, "part").withColumnsRenamed({"p_name": "part name", "p_type": "part type", "p_brand": "brand"})
    return textify.row_strings_with_header(named)


HEADER_SQL = f"SELECT concat_ws(',', {_text_cells('part')}, 'brand', 'name', 'part', 'partkey', 'retailprice', 'size', 'type') AS line FROM part"


def row_pairs(spark, d):
    out = None
    for n in ("nation", "customer"):
        s = textify.row_pair_combinations(read(spark, d, n)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
        out = s if out is None else out.unionAll(s)
    return out


ROW_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT concat_ws(' ', '{a}', coalesce({a}::VARCHAR, 'nan'), '{b}', coalesce({b}::VARCHAR, 'nan')) AS line, count(*) AS n FROM {n} GROUP BY 1"
    for n in ("nation", "customer")
    for (a, _), (b, _) in combinations(COLUMNS[n], 2)
)


def qa_triples(spark, d):
    return textify.qa_triples(read(spark, d, "customer"))


QA_SQL = " UNION ALL ".join(
    f"SELECT c_custkey::VARCHAR AS key, '{c}' AS attribute, {c}::VARCHAR AS answer FROM customer WHERE coalesce({c}::VARCHAR, '') <> ''"
    for c, _ in COLUMNS["customer"][1:]
)

PAIR_COLUMNS = ("p_type", "p_name", "p_brand")


def _pair_table(spark, d):
    return read(spark, d, "part").select(*PAIR_COLUMNS, "p_partkey")


def pair_samples(spark, d):
    """Positives and negatives against the next row and against the four rows before each fifth."""
    part = _pair_table(spark, d)
    out = None
    for buffer in (1, 4):
        numbered = number_rows(part, [], ["p_partkey"], "row_no")
        s = textify.pair_samples(numbered.drop("p_partkey").select(*PAIR_COLUMNS, "row_no"), "row_no", buffer)
        s = s.where(F.col("value").isNotNull()).groupBy("key", "value", "label").agg(F.count(F.lit(1)).alias("n"))
        s = s.withColumn("buffer", F.lit(buffer))
        out = s if out is None else out.unionByName(s)
    return out


_CAND = " UNION ALL ".join(
    f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_no, p_type AS key, '{c}' AS col, {c} AS value FROM part"
    for c in PAIR_COLUMNS
)
_OK = "key <> value AND NOT regexp_matches(key, '[0-9]') AND NOT regexp_matches(value, '[0-9]')"
PAIR_SQL = f"""WITH c AS ({_CAND}), u AS (SELECT * FROM c WHERE {_OK}),
p1 AS (SELECT u.*, o.key AS ok, o.value AS ov FROM u JOIN c o ON o.row_no = u.row_no + 1 AND o.col = u.col),
h AS (SELECT * FROM u WHERE row_no % 5 = 4),
p4 AS (SELECT h.*, o.key AS ok, o.value AS ov FROM h JOIN c o ON o.row_no // 5 = h.row_no // 5 AND o.row_no % 5 < 4 AND o.col = h.col),
a AS (SELECT key, value, 0 AS label, 1 AS buffer FROM p1
UNION ALL SELECT key, ov, 1, 1 FROM p1 WHERE key <> ok AND value <> ov
UNION ALL SELECT key, value, 0, 4 FROM h
UNION ALL SELECT key, ov, 1, 4 FROM p4 WHERE key <> ok AND value <> ov)
SELECT key, value, label, buffer, count(*) AS n FROM a GROUP BY ALL"""


def negative_counts(spark, d):
    numbered = _pair_table(spark, d).withColumnRenamed("p_partkey", "row_no")
    return textify.negative_counts(numbered, "row_no").where(F.col("col") != "row_no")


NEGATIVE_SQL = f"""WITH c AS ({_CAND}), u AS (SELECT * FROM c WHERE {_OK})
SELECT u.col, u.key, u.value, count(DISTINCT u.row_no) AS positives, count(o.row_no) AS negatives
FROM u LEFT JOIN c o ON o.col = u.col AND o.key <> u.key AND o.value <> u.value GROUP BY ALL"""


def legacy_column_tokens(spark, d):
    """Older tokenizer over text columns, headers included, tokens counted per column."""
    out = None
    for n in ("part", "customer", "orders"):
        t = textify.legacy_cell_tokens(read(spark, d, n), row_ids((n,))[n], with_header=True)
        c = t.groupBy("col", "token").agg(F.count(F.lit(1)).alias("n"))
        out = c if out is None else out.unionAll(c)
    return out


def _legacy_tokens_sql(x: str, sep: str = " ") -> str:
    piece = f"[translate(p, '_-,', '   ') FOR p IN string_split(lower({x}), '{sep}') IF length(p) >= 3 AND NOT regexp_matches(p, '[0-9]')]"
    return f"[q FOR q IN flatten([string_split(p2, ' ') FOR p2 IN {piece}]) IF length(q) >= 3]"


def _legacy_sql() -> str:
    parts = []
    for n in ("part", "customer", "orders"):
        for c, kind in COLUMNS[n]:
            if kind == "str":
                toks = f"list_concat({_legacy_tokens_sql(c)}, {_legacy_tokens_sql(chr(39) + c + chr(39))})"
                parts.append(f"SELECT col, token, count(*) AS n FROM (SELECT '{c}' AS col, unnest({toks}) AS token FROM {n}) GROUP BY ALL")
    return " UNION ALL ".join(parts)


def row_token_strings(spark, d):
    return textify.row_token_strings(read(spark, d, "part"), "p_partkey", with_header=True)


ROW_TOKEN_SQL = f"""SELECT p_partkey::VARCHAR AS row_id, array_to_string(flatten([{_legacy_tokens_sql('p_name')}, {_legacy_tokens_sql('p_brand')},
{_legacy_tokens_sql('p_type')}, ['brand', 'name', 'partkey', 'retailprice', 'size', 'type']]), ',') AS line FROM part"""


def term_counts(spark, d):
    return textify.term_counts(repository(spark, d, (*DIMENSIONS, "orders")))


def _term_sql() -> str:
    parts = []
    for n in (*DIMENSIONS, "orders"):
        for c, _ in COLUMNS[n]:
            cell = f"coalesce({c}::VARCHAR, 'nan')"
            parts.append(f"SELECT unnest({_legacy_tokens_sql(cell, ',')}) AS term FROM {n}")
            parts.append(f"SELECT unnest({_legacy_tokens_sql(chr(39) + c + chr(39))}) AS term")
    return f"SELECT term, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY term"


def vocabulary(spark, d):
    return textify.vocabulary(repository(spark, d, (*DIMENSIONS, "orders")), 2)


VOCAB_SQL = "SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (" + " UNION ".join(
    f"SELECT {norm_sql(f'coalesce({c}::VARCHAR, ' + chr(39) + 'nan' + chr(39) + ')')} AS term FROM {n}"
    for n in (*DIMENSIONS, "orders")
    for c, _ in COLUMNS[n]
) + ") WHERE length(term) > 2"


def unique_text_cells(spark, d):
    tables = repository(spark, d, EVERYTHING) | {"documents": read(spark, d, "documents"), "pages": read(spark, d, "pages")}
    return textify.unique_text_cells(tables)


UNIQUE_SQL = "SELECT count(*) AS unique_cells FROM (" + " UNION ".join(
    [f"SELECT {c} AS v FROM {n} WHERE {c} IS NOT NULL" for n in EVERYTHING for c, k in COLUMNS[n] if k == "str"]
    + [f"SELECT {c} FROM documents WHERE {c} IS NOT NULL" for c in ("text", "lang", "source")]
    + [f"SELECT {c} FROM pages WHERE {c} IS NOT NULL" for c in ("url", "html")]
) + ")"


def _article(x):
    """Every text with a heading after its first line, each third one with closing sections."""
    headed = F.regexp_replace(x, "^([^\n]*)\n", "$1\n == Life ==\n\n")
    closing = F.concat(headed, F.lit('\n== References ==\nhidden "text".\n== External links\nmore'))
    return F.when(F.col("doc_id") % 3 == 0, closing).otherwise(headed)


def clean_article(spark, d):
    """Cleaned documents by digest; every document is read as an article with lines."""
    docs = read(spark, d, "documents").withColumn("text", _article(F.col("text")))
    return docs.select("doc_id", F.md5(text.clean_article("text")).alias("digest"), F.char_length(text.clean_article("text")).alias("n"))


_LINES = "[trim(l, E' \\t\\n\\r\\f\\v') FOR l IN string_split(text, E'\\n')]"
ARTICLE_SQL = f"""WITH a AS (SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10))) || E' == Life ==\\n\\n' || substr(text, strpos(text, chr(10)) + 1) ELSE text END AS text FROM documents),
b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || E'\\n== References ==\\nhidden "text".\\n== External links\\nmore' ELSE text END AS text FROM a),
l AS (SELECT doc_id, {_LINES} AS ls FROM b),
m AS (SELECT doc_id, ls, list_position([starts_with(x, '== References') OR starts_with(x, '== External links') FOR x IN ls], true) AS cut FROM l),
k AS (SELECT doc_id, CASE WHEN cut > 0 THEN ls[1:cut - 1] ELSE ls END AS ls FROM m),
t AS (SELECT doc_id, translate(coalesce(array_to_string([x FOR x IN ls IF x <> '' AND NOT starts_with(x, '==')], ' '), ''), ',."', '') AS t FROM k)
SELECT doc_id, md5(t) AS digest, length(t)::INTEGER AS n FROM t"""


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _steps_sql(x: str, steps) -> str:
    """SQL of replacements one after another; three parts: a pattern with its options."""
    for old, new, *options in steps:
        args = f"{x}, {_sql_text(old)}, {_sql_text(new)}"
        x = f"regexp_replace({args}, '{options[0]}')" if options else f"replace({args})"
    return x


def normalize_corpus(spark, d):
    """Documents with every mark that the clean-up knows."""
    marked = F.concat(F.col("text"), F.lit(CORPUS_MARKS))
    return read(spark, d, "documents").select("doc_id", F.md5(text.normalize_corpus(marked)).alias("digest"))


CORPUS_MARKS = "It’s ''so'' “said” \"x\".a<br />b, c(d) e!f?g;h:i-j=k*l|m«n 2024 o′p"
# what the clean-up must do, written apart from the code's own rules
CORPUS_STEPS = [
    ("’", "'"), ("′", "'"), ("''", " "), ("'", " ' "), ("“", '"'), ("”", '"'), ('"', ' " '), (".", " . "), ("<br />", " "),
    (", ", " , "), ("(", " ( "), (")", " ) "), ("!", " ! "), ("?", " ? "), (";", " "), (":", " "), ("-", " - "), ("=", " "),
    ("*", " "), ("|", " "), ("«", " "), *[(str(n), " ") for n in range(10)],
]
CORPUS_SQL = f"SELECT doc_id, md5({_steps_sql(f'lower(text || {_sql_text(CORPUS_MARKS)})', CORPUS_STEPS)}) AS digest FROM documents"


def strip_wiki_markup(spark, d):
    """Pages as dump pages: text lines between other lines, with mark-up, some of them redirects."""
    body = F.concat(F.lit(WIKI_HEAD), F.replace("html", F.lit("\n"), F.lit(" ")), F.lit(WIKI_TAIL))
    page = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<text x>#REDIRECT [[Home]]\n"), F.replace(body, F.lit("<text "), F.lit("<none ")))).otherwise(body)
    visible = text.strip_wiki_markup(text.wiki_page_text(page))
    return read(spark, d, "pages").select("page_id", F.md5(visible).alias("digest"), F.char_length(visible).alias("n"))


WIKI_HEAD = "<title>no</title>\nbefore\n<text xml:space='preserve'>start\n"
WIKI_TAIL = (
    "\nA [[link|shown]] and [[Plain]] &amp; [http://x.example/a b] [[Image:p.png|thumb|left|20px|A cap]] [[category:Kin|key]]"
    " [[fr:Maison]] {{cite|x}} {tab} a&nbsp;b &lt;i&gt;r&lt;/i&gt;<ref name=a>gone</ref> [[x|RIGHT]]</text>\nafter"
)
WIKI_STEPS = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("<ref[^<]*</ref>", "", "g"), ("<[^>]*>", "", "g"), (r"\[http:[^] ]*", "[", "g"),
    (r"\|thumb", "", "gi"), (r"\|left", "", "gi"), (r"\|right", "", "gi"), (r"\|[0-9]+px", "", "gi"),
    (r"\[\[image:[^\[\]]*\|", "", "gi"), (r"\[\[category:([^|\]]*)[^\]]*\]\]", r"[[\1]]", "gi"), (r"\[\[[a-z\-]*:[^\]]*\]\]", "", "g"),
    (r"\[\[[^\|\]]*\|", "[[", "g"), (r"\{\{[^}]*\}\}", "", "g"), (r"\{[^}]*\}", "", "g"), ("[", ""), ("]", ""), ("&[^;]*;", " ", "g"),
]
# between <text and </text>: the opening line, the page and the last line; nothing of a redirect
WIKI_SQL = f"""WITH w AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE '<text xml:space=''preserve''>start' || chr(10)
|| replace(html, chr(10), ' ') || chr(10) || {_sql_text(WIKI_TAIL.split(chr(10))[1])} END AS x FROM pages),
t AS (SELECT page_id, {_steps_sql('x', WIKI_STEPS)} AS x FROM w) SELECT page_id, md5(x) AS digest, length(x)::INTEGER AS n FROM t"""

QUERIES = {
    "cells": (cells, CELLS_SQL),
    "textify_rows": (textify_rows, ROWS_SQL),
    "textify_row_nodes": (textify_row_nodes, ROW_NODES_SQL),
    "textify_cols": (textify_cols, COLS_SQL),
    "token_frequencies": (token_frequencies, FREQ_SQL),
    "permuted_rows": (permuted_rows, _permuted_sql(TOK, "token")),
    "permuted_pairs": (permuted_pairs, _permuted_sql(tokens_sql(("region", "nation", "supplier")), "token || ' ' || col")),
    "permuted_columns": (permuted_columns, PERM_COLS_SQL),
    "row_strings": (row_strings, ROW_STRINGS_SQL),
    "row_strings_filter_digits": (row_strings_filter_digits, FILTER_DIGITS_SQL),
    "row_strings_with_header": (row_strings_with_header, HEADER_SQL),
    "row_pairs": (row_pairs, ROW_PAIRS_SQL),
    "qa_triples": (qa_triples, QA_SQL),
    "pair_samples": (pair_samples, PAIR_SQL),
    "negative_counts": (negative_counts, NEGATIVE_SQL),
    "legacy_column_tokens": (legacy_column_tokens, _legacy_sql()),
    "row_token_strings": (row_token_strings, ROW_TOKEN_SQL),
    "term_counts": (term_counts, _term_sql()),
    "vocabulary": (vocabulary, VOCAB_SQL),
    "unique_text_cells": (unique_text_cells, UNIQUE_SQL),
    "clean_article": (clean_article, ARTICLE_SQL),
    "normalize_corpus": (normalize_corpus, CORPUS_SQL),
    "strip_wiki_markup": (strip_wiki_markup, WIKI_SQL),
}
