"""Textification: rows and columns of relations to tokens."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevec.functions import ordering, text
from tablevec.functions.draws import draw
from tablevec.functions.names import column as named, literal, quoted
from tablevec.operators.prep import kinds, quantize
from tablevec.session import settle

DEFAULT_STRATEGY = ("augment", "cell")
ROW_ID = "__rid"


def cell_value(df: DataFrame, column: str, policy: str) -> Column | None:
    """Cell text under a numeric policy; None means that the column is left out."""
    if kinds(df)[column] == "str":
        return named(column).cast("string")
    if policy == "skip":
        return None
    if policy == "stringify":
        return named(column).cast("string")
    return text.number_token(column, named(column))


def row_cells(df: DataFrame, relation: str, row_id, strategies: dict | None = None) -> DataFrame:
    """(relation, row_id, col, pos, value, grain): valid cells of every row, a pure projection.

    ``row_id`` is a column expression that identifies a row of the relation.
    """
    strategies = strategies or {}
    rid = (row_id if isinstance(row_id, Column) else named(row_id)).cast("string")
    entries = []
    for pos, c in enumerate(df.columns):
        if c == ROW_ID:
            continue
        policy, grain = strategies.get(c, DEFAULT_STRATEGY)
        value = cell_value(df, c, policy)
        if value is None:
            continue
        # only text can be blank, a missing mark or a d/d/d date
        valid = text.valid_cell(c) if isinstance(df.schema[c].dataType, T.StringType) else named(c).isNotNull()
        entries.append(
            F.struct(
                F.lit(c).alias("col"),
                F.lit(pos).alias("pos"),
                F.when(valid, value).alias("value"),
                F.lit(grain).alias("grain"),
            )
        )
    return df.select(
        F.lit(relation).alias("relation"), rid.alias("row_id"), F.inline(F.array(*entries))
    ).where(F.col("value").isNotNull())


def cell_tokens(cells: DataFrame) -> DataFrame:
    """Cells with ``token`` and ``tpos``: one row per token of each cell."""
    tokens = F.when(
        F.col("grain") == "token", text.encode_cell("value", "token")
    ).otherwise(text.encode_cell("value", "cell"))
    keep = [c for c in cells.columns if c not in ("value", "grain")]
    return cells.select(*keep, F.posexplode(tokens).alias("tpos", "token")).where(F.col("token") != "")


def _token_struct(col: str, pos: int, tpos: str, token: str) -> str:
    return f"named_struct('col', {literal(col)}, 'pos', {pos}, 'tpos', {tpos}, 'token', {token})"


def _row_items(df: DataFrame, strategies: dict | None) -> tuple[DataFrame, str]:
    """(table, SQL of the row's token structs): the token work of one relation as one projection.

    The grain of a column is known when the plan is made, so whole-cell columns stay plain
    compiled string expressions and only word-grain columns pay for array work.
    """
    strategies = strategies or {}
    kind = kinds(df)
    types_ = dict(df.dtypes)
    whole, split = [], []
    for pos, c in enumerate(df.columns):
        if c == ROW_ID:
            continue
        policy, grain = strategies.get(c, DEFAULT_STRATEGY)
        as_text = f"CAST({quoted(c)} AS STRING)"
        if kind[c] != "str":
            if policy == "skip":
                continue
            # the column name is a constant, so cleaning the joined text costs one lower()
            token = as_text if policy == "stringify" else f"concat({literal(c + text.NUMBER_MARK)}, {as_text})"
            whole.append(_token_struct(c, pos, "0", text.whole_cell_expr(token) if "," in c or " " in c else f"lower({token})"))
        elif types_[c] != "string":
            whole.append(_token_struct(c, pos, "0", text.whole_cell_expr(as_text)))
        elif grain == "token":
            found = text.encode_cell(F.when(F.expr(text.valid_cell_expr(c)), named(c)), "token")
            split.append((c, pos, found))
        else:
            token = f"CASE WHEN {text.valid_cell_expr(c)} THEN {text.whole_cell_expr(quoted(c))} END"
            whole.append(_token_struct(c, pos, "0", token))
    # word lists get columns of their own, so the rest of the projection stays compiled
    wide = df.select("*", *[F.coalesce(words, F.array().cast("array<string>")).alias(f"__w{pos}") for _, pos, words in split])
    lists = [f"array({', '.join(whole)})"] if whole else []
    lists += [f"transform(__w{pos}, (w, i) -> {_token_struct(c, pos, 'i', 'w')})" for c, pos, _ in split]
    return wide, lists[0] if len(lists) == 1 else f"concat({', '.join(lists)})"


def _id_of(row_id) -> Column:
    return (row_id if isinstance(row_id, Column) else named(row_id)).cast("string")


def row_tokens(df: DataFrame, relation: str, row_id, strategies: dict | None = None) -> DataFrame:
    """(relation, row_id, col, pos, tpos, token): one row per token of one relation."""
    wide, items = _row_items(df, strategies)
    return wide.select(F.lit(relation).alias("relation"), _id_of(row_id).alias("row_id"), F.expr(f"inline({items})")).where(
        "token IS NOT NULL AND token <> ''"
    )


def row_lists(df: DataFrame, relation: str, row_id, strategies: dict | None = None) -> DataFrame:
    """(relation, row_id, items): the tokens of each row as one array, in column order.

    A row's tokens come from that row, so nothing is shuffled to bring them together.
    """
    wide, items = _row_items(df, strategies)
    ordered = (
        f"sort_array(transform(filter({items}, x -> x.token IS NOT NULL AND x.token <> ''), "
        "x -> named_struct('pos', x.pos, 'tpos', x.tpos, 'col', x.col, 'token', x.token)))"
    )
    return wide.select(F.lit(relation).alias("relation"), _id_of(row_id).alias("row_id"), F.expr(ordered).alias("items"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _keyed(df: DataFrame, row_id) -> DataFrame:
    """The relation with its row id kept aside, so that binning a key column does not change ids."""
    return df.withColumn(ROW_ID, (row_id if isinstance(row_id, Column) else named(row_id)).cast("string"))


def repository_cells(tables: dict[str, DataFrame], row_ids: dict, strategies: dict | None = None) -> DataFrame:
    """(relation, row_id, col, pos, value, grain) of all relations, quantized where asked."""
    strategies = strategies or {}
    parts = []
    for name, df in tables.items():
        plan = strategies.get(name, {})
        binned = quantize(_keyed(df, row_ids[name]), plan)
        parts.append(row_cells(binned, name, ROW_ID, plan))
    return _union(parts)


def repository_tokens(tables: dict[str, DataFrame], row_ids: dict, strategies: dict | None = None) -> DataFrame:
    """(relation, row_id, col, pos, tpos, token) of all relations, quantized where asked."""
    strategies = strategies or {}
    parts = []
    for name, df in tables.items():
        plan = strategies.get(name, {})
        binned = quantize(_keyed(df, row_ids[name]), plan)
        parts.append(row_tokens(binned, name, ROW_ID, plan))
    return _union(parts)


def repository_lists(tables: dict[str, DataFrame], row_ids: dict, strategies: dict | None = None) -> DataFrame:
    """(relation, row_id, items) of all relations, quantized where asked."""
    strategies = strategies or {}
    parts = []
    for name, df in tables.items():
        plan = strategies.get(name, {})
        binned = quantize(_keyed(df, row_ids[name]), plan)
        parts.append(row_lists(binned, name, ROW_ID, plan))
    return _union(parts)


def row_documents(lists: DataFrame) -> DataFrame:
    """(relation, row_id, tokens): tokens of a row in column order; rows without tokens drop out."""
    return lists.where(F.size("items") > 0).select("relation", "row_id", F.col("items.token").alias("tokens"))


def base_table_documents(lists: DataFrame) -> DataFrame:
    """Row tokens followed by the row's own node name."""
    node = F.concat(F.col("relation"), F.lit("_row:"), F.col("row_id"))
    return row_documents(lists).select("relation", "row_id", F.array_append("tokens", node).alias("tokens"))


def column_sequence(tokens: DataFrame) -> DataFrame:
    """Tokens of a column in row order as numbered lines (relation, col, seq, token).

    A column can be as long as its table, so it stays one row per token instead of one array.
    """
    keyed = tokens.select("relation", "col", "row_id", "tpos", "token")
    return ordering.number_rows(keyed, ["relation", "col"], ["row_id", "tpos"], "seq").select(
        "relation", "col", "seq", "token"
    )


def _perms(n_perm: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm")


def permuted_rows(lists: DataFrame, n_perm: int = 20, seed: int = 0, with_column: bool = False) -> DataFrame:
    """(perm, relation, row_id, tokens, line): each row ``n_perm`` times, its cells in a drawn order.

    Permutations are made inside the row, without a shuffle. ``line`` is the drawn place of the
    row inside a permutation; writers sort by it. With ``with_column`` each token is followed by
    the name of its column.
    """
    many = lists.where(F.size("items") > 0).select(_perms(n_perm), "relation", "row_id", "items")
    placed = F.sort_array(
        F.transform(
            "items",
            lambda i: F.struct(
                draw(seed, "perm", "relation", "row_id", i["col"]).alias("u"),
                i["pos"],
                i["tpos"],
                (F.concat_ws(" ", i["token"], i["col"]) if with_column else i["token"]).alias("token"),
            ),
        )
    )
    return many.select(
        "perm",
        "relation",
        "row_id",
        F.transform(placed, lambda i: i["token"]).alias("tokens"),
        draw(seed, "perm", "relation", "row_id").alias("line"),
    )


def permuted_columns(tokens: DataFrame, n_perm: int = 20, seed: int = 0) -> DataFrame:
    """(perm, relation, col, place, token): each column ``n_perm`` times, its rows in a drawn order.

    ``place`` sorts a column's rows; a column stays in long form, it may be as long as its table.
    """
    return tokens.select("*", _perms(n_perm)).select(
        "perm", "relation", "col", draw(seed, "perm", "relation", "col", "row_id").alias("place"), "row_id", "tpos", "token"
    )


def permuted_ends(permuted: DataFrame) -> DataFrame:
    """(perm, relation, col, n, first_token, last_token) of ``permuted_columns``.

    Places are plain numbers, so their ends are hashed; whole rows would be sorted. Only rows at an end are compared further.
    """
    keys = ["perm", "relation", "col"]
    ends = permuted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    # one row per permutation and column
    outer = permuted.join(F.broadcast(settle(ends)), keys).where("place = lo OR place = hi")
    whole = F.struct("place", "row_id", "tpos", "token")
    return outer.groupBy(*keys, "n").agg(
        F.min(whole)["token"].alias("first_token"), F.max(whole)["token"].alias("last_token")
    )


def permuted_pairs(lists: DataFrame, n_perm: int = 20, seed: int = 0) -> DataFrame:
    """As ``permuted_rows``, each token followed by its column name."""
    return permuted_rows(lists, n_perm, seed, with_column=True)


def row_strings(df: DataFrame, joiner: str = ",") -> DataFrame:
    """Rows as joined strings."""
    return df.select(F.concat_ws(joiner, *[F.coalesce(named(c).cast("string"), F.lit("nan")) for c in df.columns]).alias("line"))


def row_strings_filter_digits(df: DataFrame, joiner: str = ",") -> DataFrame:
    """Joined strings of the lower-cased cells that have no digit and 3 or more characters."""
    cells = F.array(*[F.coalesce(named(c).cast("string"), F.lit("nan")) for c in df.columns])
    kept = F.filter(cells, lambda v: (F.char_length(v) >= 3) & ~F.rlike(v, F.lit("[0-9]")))
    return df.select(F.array_join(F.transform(kept, F.lower), joiner).alias("line"))


def header_tokens(df: DataFrame) -> Column:
    """Distinct tokens of the column names, in name order."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(names, lambda n: text.tokenize(n, " ")))))


def row_strings_with_header(df: DataFrame) -> DataFrame:
    """Joined rows followed by the header tokens."""
    cells = F.array(*[F.coalesce(named(c).cast("string"), F.lit("nan")) for c in df.columns])
    return df.select(F.array_join(F.concat(cells, header_tokens(df)), ",").alias("line"))


def row_pair_combinations(df: DataFrame, with_header: bool = True) -> DataFrame:
    """Every pair of columns of a row as one string."""
    entries = []
    for a, b in combinations(df.columns, 2):
        va, vb = (F.coalesce(named(c).cast("string"), F.lit("nan")) for c in (a, b))
        parts = [F.lit(a), va, F.lit(b), vb] if with_header else [va, vb]
        entries.append(F.concat_ws(" ", *parts))
    return df.select(F.explode(F.array(*entries)).alias("line"))


def qa_triples(df: DataFrame) -> DataFrame:
    """(key, attribute, answer): the first column is the key; empty cells are left out."""
    key, *rest = df.columns
    entries = [F.struct(F.lit(c).alias("attribute"), named(c).cast("string").alias("answer")) for c in rest]
    return df.select(named(key).cast("string").alias("key"), F.inline(F.array(*entries))).where(
        F.coalesce(F.col("answer"), F.lit("")) != ""
    )


def _pair_candidates(df: DataFrame, row_no) -> DataFrame:
    key = df.columns[0]
    entries = [F.struct(F.lit(c).alias("col"), named(c).cast("string").alias("value")) for c in df.columns]
    return df.select(
        (row_no if isinstance(row_no, Column) else named(row_no)).cast("bigint").alias("row_no"),
        named(key).cast("string").alias("key"),
        F.inline(F.array(*entries)),
    )


def _usable() -> Column:
    no_digit = ~F.rlike("key", F.lit("[0-9]")) & ~F.rlike("value", F.lit("[0-9]"))
    return (F.col("key") != F.col("value")) & no_digit


def positive_pairs(df: DataFrame, row_no) -> DataFrame:
    """(key, value) of the same row where both are digit-free and differ."""
    return _pair_candidates(df, row_no).where(_usable())


def pair_samples(df: DataFrame, row_no, buffer: int = 1) -> DataFrame:
    """(key, value, label): own values as 0, values of other rows in a small buffer as 1.

    ``buffer=1`` takes the next row as the source of negatives; ``buffer=4`` takes the four
    rows before each fifth row. ``row_no`` numbers the rows from 0. The buffer bounds the
    output, so a join on (buffer, column) never meets a large group. Both sides grow with the
    table and unfold from small files, so Spark's size estimate would broadcast them: they are merged.
    """
    cand = _pair_candidates(df, row_no)
    if buffer == 1:
        # row i is scored against row i + 1; the last row only fills the buffer
        other = cand.select((F.col("row_no") - 1).alias("row_no"), "col", F.col("key").alias("o_key"), F.col("value").alias("o_value"))
        pairs = cand.where(_usable()).join(other.hint("merge"), ["row_no", "col"])
        positives = pairs
    else:
        size = buffer + 1
        block = F.floor(F.col("row_no") / size)
        in_block = F.col("row_no") % size
        heads = cand.where((in_block == buffer) & _usable()).withColumn("block", block)
        fill = cand.where(in_block < buffer).select(
            block.alias("block"), "col", F.col("key").alias("o_key"), F.col("value").alias("o_value")
        )
        positives = heads
        pairs = heads.join(fill.hint("merge"), ["block", "col"])
    negatives = pairs.where((F.col("key") != F.col("o_key")) & (F.col("value") != F.col("o_value")))
    return positives.select("key", "value", F.lit(0).alias("label")).unionAll(
        negatives.select("key", F.col("o_value").alias("value"), F.lit(1).alias("label"))
    )


def negative_counts(df: DataFrame, row_no) -> DataFrame:
    """(col, key, value, positives, negatives): how many negatives the whole table offers a pair.

    Sampling against all rows would list every pair of rows; the number follows from counts:
    all rows, less those with the same key, less those with the same value, plus those with both.
    """
    cand = _pair_candidates(df, row_no).where(F.col("value").isNotNull() & F.col("key").isNotNull())
    both = cand.groupBy("col", "key", "value").agg(F.count(F.lit(1)).alias("positives"))
    by_key = both.groupBy("col", "key").agg(F.sum("positives").alias("same_key"))
    by_value = both.groupBy("col", "value").agg(F.sum("positives").alias("same_value"))
    rows = both.groupBy("col").agg(F.sum("positives").alias("all_rows"))
    return (
        both.where(_usable())
        .join(by_key, ["col", "key"])
        .join(by_value, ["col", "value"])
        .join(rows, "col")
        .select(
            "col",
            "key",
            "value",
            "positives",
            (F.col("positives") * (F.col("all_rows") - F.col("same_key") - F.col("same_value") + F.col("positives"))).alias("negatives"),
        )
    )


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def legacy_cell_tokens(df: DataFrame, row_id, with_header: bool = False) -> DataFrame:
    """(row_id, col, pos, tpos, token): older tokenizer on text cells, optionally the headers too."""
    rid = (row_id if isinstance(row_id, Column) else named(row_id)).cast("string")
    entries = []
    for pos, c in enumerate(string_columns(df)):
        toks = text.tokenize(c, " ")
        if with_header:
            toks = F.concat(toks, text.tokenize(F.lit(c), " "))
        entries.append(F.struct(F.lit(c).alias("col"), F.lit(pos).alias("pos"), toks.alias("toks")))
    long = df.select(rid.alias("row_id"), F.inline(F.array(*entries)))
    return long.select("row_id", "col", "pos", F.posexplode("toks").alias("tpos", "token"))


def row_token_strings(df: DataFrame, row_id, with_header: bool = False) -> DataFrame:
    """(row_id, line): a row's older-style tokens, comma-joined."""
    rid = (row_id if isinstance(row_id, Column) else named(row_id)).cast("string")
    toks = [text.tokenize(F.coalesce(named(c), F.lit("")), " ") for c in string_columns(df)]
    if with_header:
        toks.append(header_tokens(df))
    return df.select(rid.alias("row_id"), F.array_join(F.flatten(F.array(*toks)), ",").alias("line"))


def term_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(term, n) over headers and cells of all tables, most frequent first when sorted."""
    out = None
    for df in tables.values():
        cells = F.flatten(
            F.array(*[text.tokenize(F.coalesce(named(c).cast("string"), F.lit("nan")), ",") for c in df.columns])
        )
        terms = df.select(F.explode(cells).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        names = df.sparkSession.range(1).select(
            F.explode(F.flatten(F.array(*[text.tokenize(F.lit(c), " ") for c in df.columns]))).alias("term")
        ).select("term", F.lit(1).cast("bigint").alias("n"))
        both = terms.unionByName(names)
        out = both if out is None else out.unionByName(both)
    return out.groupBy("term").agg(F.sum("n").alias("n"))


def vocabulary(tables: dict[str, DataFrame], min_len: int = 0) -> DataFrame:
    """(term, idx): distinct normalized cells longer than ``min_len``, numbered in order."""
    out = None
    for df in tables.values():
        cells = F.array(*[text.normalize_text(F.coalesce(named(c).cast("string"), F.lit("nan"))) for c in df.columns])
        terms = df.select(F.explode(cells).alias("term")).where(F.char_length("term") > min_len).distinct()
        out = terms if out is None else out.unionByName(terms)
    return ordering.number_rows(out.distinct(), [], ["term"], "idx")


def unique_text_cells(tables: dict[str, DataFrame], exact: bool = True) -> DataFrame:
    """Number of different values in the text columns of all tables."""
    out = None
    for df in tables.values():
        cols = string_columns(df)
        if not cols:
            continue
        cells = df.select(F.explode(F.array(*[named(c) for c in cols])).alias("value"))
        out = cells if out is None else out.unionByName(cells)
    if not exact:
        return out.agg(F.approx_count_distinct("value").alias("unique_cells"))
    # distinct first: the plain count then runs on spread partitions
    return out.where(F.col("value").isNotNull()).distinct().agg(F.count(F.lit(1)).alias("unique_cells"))
