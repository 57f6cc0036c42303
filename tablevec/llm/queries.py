"""The registered queries of the operators in this folder: name -> (Spark query, SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevec.llm import (
    chat_format, collocations, compression_quality, decontaminate, language_id, ngram_join, packing, prefix_trie,
    quality_votes, secret_scan, suffix_dedup, token_counts, url_filter,
)

URL_ENTRIES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048
    )


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_ENTRIES)


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _longest_first() -> list[tuple[str, str, str]]:
    return sorted(URL_ENTRIES, key=lambda e: (-e[1].count("."), -len(e[2])))


URL_SQL = f"""
WITH cut AS (
  SELECT page_id, contains(url, '://') AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), parts AS (
  SELECT page_id,
    CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut
)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _longest_first())} END AS rule,
  CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _longest_first())} ELSE 'allow' END AS verdict
FROM parts"""

PROBE = "</s>[INST] ok [/INST]"


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.read_back(chat_format.format_chats(rows))


CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), near AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), sized AS (
  SELECT *,
    -- every escaped character becomes two; a new line in a role too
    length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '<\|[^<>|]*\|>|</?s>|</?SYS>>|<</?SYS>>|\[/?INST\]')) AS body,
    length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, chr(10), ''))
      + len(regexp_extract_all(role, '<\|[^<>|]*\|>|</?s>|</?SYS>>|<</?SYS>>|\[/?INST\]')) AS head
  FROM near
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  -- a block: 12 + role + 1 before its first text and 11 after its last; 11 before each further text
  CAST(sum(body + CASE WHEN opens THEN 12 + head + 1 + 11 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_votes.judge_quality(read(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "posterior",
    )


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents"))

    def listed(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    base = F.filter("spans", lambda s: s["kind"] != "format")

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _shingle_sql(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, md5(text) AS part, CASE WHEN len(w) >= 5 THEN array_to_string(w[u.i:u.i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT {key}, text, list_filter(string_split_regex(lower(text), '[ \t-\r]+'), lambda x: x <> '') AS w FROM {table}),
    unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)
  WHERE len(w) > 0"""


LEAK_SQL = f"""
WITH d AS ({_shingle_sql("documents", "doc_id")}
), b AS ({_shingle_sql("benchmark", "item_id")}
), sizes AS (SELECT item_id, part, count(*) AS n_shingles FROM b GROUP BY item_id, part
), pairs AS (
  SELECT doc_id, d.part, b.item_id, n_shingles, count(*) AS n
  FROM d JOIN b ON d.s = b.s JOIN sizes ON sizes.item_id IS NOT DISTINCT FROM b.item_id AND sizes.part = b.part
  WHERE doc_id IS NOT NULL
  GROUP BY doc_id, d.part, b.item_id, b.part, n_shingles HAVING count(*) >= ceil(n_shingles * 0.8)
)
SELECT doc_id, item_id, n_shingles, max(n) AS n_shared, max(n) / n_shingles AS containment
FROM pairs GROUP BY doc_id, item_id, n_shingles"""


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.learn_languages(docs.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read(spark, sf_dir, "documents"), words=4, percent=85)


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(read(spark, sf_dir, "documents"))


PHRASE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM cut GROUP BY lang
), f AS (
  SELECT lang, m, array_to_string(w[u.i:u.i + m - 1], ' ') AS phrase, count(*) AS a
  FROM cut, range(1, 6) AS s(m), unnest(range(1, len(w) - m + 2)) AS u(i)
  GROUP BY ALL
), good AS (SELECT * FROM f WHERE m > 1 AND a >= 100
), whole AS (
  SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM good p WHERE NOT EXISTS (
    SELECT 1 FROM good q WHERE q.lang = p.lang AND q.m > p.m AND 100 * q.a >= 100 * p.a
      AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))
), cuts AS (
  SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM whole c, range(1, 5) AS s(k) WHERE k < len(w)
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, t.n,
    1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(l.a AS HUGEINT) * r.a) AS score, k
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = head JOIN f r ON r.lang = c.lang AND r.phrase = tail
    JOIN total t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000"""

def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = compression_quality.learn_quality(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(compression_quality.fold(F.col("doc_id")) == compression_quality.HELD_OUT, F.lit(False))
    scored = compression_quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= compression_quality.LEAST_SCORE).cast("int").alias("predicted")
    )


def tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations")).drop("enter", "leave")


#: crc32 bit by bit, as DuckDB has none; a prefix is named by the digest of its turns' digests.
TRIE_SQL = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % 5 AS base, n, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 8 * len(s)), lambda i:
      CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(s, 1 + i // 8, 1)) AS BIGINT) ELSE 0 END)),
      lambda acc, x: xor(xor(acc, x) >> 1, (xor(acc, x) & 1) * 3988292384)), 4294967295) AS BIGINT) % 9 AS h
  FROM (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM own GROUP BY c)
), convs AS (
  SELECT i.c, i.base, i.h, least(i.h, coalesce(b.n, 0)) AS taken FROM ids i LEFT JOIN ids b ON b.c = i.base
), turns AS (
  SELECT v.c, o.p, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.p <= v.h
  UNION ALL SELECT v.c, o.p - v.h + v.taken, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h
), prefixes AS (
  SELECT c, p, octet_length(encode(text)) AS bytes,
    md5(string_agg(md5(role) || md5(text), '' ORDER BY p) OVER (PARTITION BY c ORDER BY p)) AS key
  FROM turns
  UNION ALL SELECT c, 0, 0, 'root' FROM convs
), nodes AS (
  SELECT key, min(p) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM prefixes GROUP BY key
), up AS (
  SELECT n.*, q.key AS parent FROM nodes n LEFT JOIN prefixes q ON q.c = n.conv_id AND q.p = n.depth - 1
), kids AS (SELECT parent AS key, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY parent
), under AS (
  SELECT q.key, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(n.saved) AS saved
  FROM nodes n JOIN prefixes q ON q.c = n.conv_id AND q.p <= n.depth LEFT JOIN kids k ON k.key = n.key
  GROUP BY q.key
), last_of AS (SELECT c, key FROM prefixes QUALIFY p = max(p) OVER (PARTITION BY c)
), digests AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest FROM last_of GROUP BY key)
SELECT u.conv_id, u.depth, r.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n, 0) AS n_children,
  CAST(d.leaves AS BIGINT) AS n_leaves, CAST(d.saved AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM up u JOIN under d ON d.key = u.key LEFT JOIN nodes r ON r.key = u.parent LEFT JOIN kids k ON k.key = u.key
  LEFT JOIN digests e ON e.key = u.key"""

QUERIES = {
    "op1_ngram_jaccard_join": (similar, None),
    "op2_token_counts": (token_count, None),
    "op3_url_filters": (url_verdicts, URL_SQL),
    "op4_secret_scans": (secrets, None),
    "op5_chat_formatting": (chats, CHAT_SQL),
    "op6_benchmark_decontamination": (leaks, LEAK_SQL),
    "op7_language_id": (languages, None),
    "op8_quality_rules": (quality, None),
    "op9_best_fit_packing": (packed, None),
    "op10_suffix_array_dedup": (repeats, None),
    "op11_phrase_collocations": (phrases, PHRASE_SQL),
    "op12_quality_classifier": (classified, None),
    "op13_conversation_prefix_trie": (tries, TRIE_SQL),
}
