"""Queries on hashing, chunking and text filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, privacy, rules, text
from ..operators import chunking
from ..session import spread, table


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), canonical.short_hash(F.col("text")).alias("short_hash"))


def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.word_chunks(spread(table(spark, d, "documents").select("doc_id", "text")))
    return c.select("doc_id", "chunk_index", "total_chunks", "token_count", F.sha2("chunk_text", 256).alias("text_hash"))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.word_chunks(spread(table(spark, d, "documents").select("doc_id", "source", "text")))
    return c.groupBy("source").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.sum("token_count").cast("bigint").alias("n_tokens"), F.max("token_count").cast("bigint").alias("largest")
    )


#: Words of a text, chunk bounds and rest for 1024 words with 100 in common.
_CHUNKS = r"""
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT *, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 1024 THEN 1 ELSE (len(w) - 100) // 924 + 1 END AS c FROM w),
j AS (SELECT *, unnest(range(c)) AS j FROM k),
chunk AS (SELECT doc_id, source, j AS chunk_index, c AS total_chunks,
                 CASE WHEN n <= 1024 THEN w ELSE list_concat(w[j * 924 + 1 : j * 924 + 1024], CASE WHEN j = c - 1 AND n > c * 924 THEN w[c * 924 + 1 :] ELSE [] END) END AS own,
                 n, text FROM j)"""


def tabular_flag(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text")
    tsv = F.regexp_replace("text", " ", "\t")
    return t.select("doc_id", text.is_tabular(F.col("text")).alias("plain"), text.is_tabular(tsv).alias("with_tabs"))


def chunk_tabular(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order as a table, chunked by lines (an order has a few)."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"),
        F.concat_ws("\t", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("line"),
    )
    sheets = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    c = chunking.chunks(sheets, id_col="l_orderkey", most=16)
    return c.select("l_orderkey", "chunk_index", "total_chunks", "token_count", F.sha2("chunk_text", 256).alias("text_hash"))


def line_noise(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "documents").select("doc_id", "text"))
    out = text.without_noise(F.col("text"))
    return t.select("doc_id", F.sha2(out, 256).alias("clean_hash"), F.length(out).cast("bigint").alias("clean_chars"))


def truncated(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", text.preview(c).alias("preview"), text.truncate_text(c).alias("short"), text.truncate_text(c, 40).alias("shorter"), F.sha2(text.truncate_lines(c, 2), 256).alias("lines_hash")
    )


def redact_router(spark: SparkSession, d: str) -> DataFrame:
    out = privacy.redact_router(F.col("text"), cards=False, emails=True, phones=True)
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(out, 256).alias("redacted_hash"), (out != F.col("text")).alias("changed"))


def redact_cards(spark: SparkSession, d: str) -> DataFrame:
    out = privacy.redact_cards(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(out, 256).alias("redacted_hash"), (out != F.col("text")).alias("changed"))


def redact_ocr(spark: SparkSession, d: str) -> DataFrame:
    out = privacy.redact_ocr(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(out, 256).alias("redacted_hash"), (out != F.col("text")).alias("changed"))


def luhn(spark: SparkSession, d: str) -> DataFrame:
    digits = F.lpad(F.col("o_orderkey").cast("string"), 16, "4539")
    return table(spark, d, "orders").select("o_orderkey", privacy.is_card(digits).alias("is_card"))


def meaningful(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.is_meaningful(F.col("text")).alias("meaningful"))


QUERIES = {
    "content_hash": content_hash,
    "chunk_words": chunk_words,
    "chunk_stats": chunk_stats,
    "tabular_flag": tabular_flag,
    "chunk_tabular": chunk_tabular,
    "line_noise": line_noise,
    "truncate_text": truncated,
    "redact_router": redact_router,
    "redact_cards": redact_cards,
    "redact_ocr": redact_ocr,
    "luhn": luhn,
    "meaningful_text": meaningful,
}

_TABULAR = "len(string_split(x, chr(10))) >= 2 AND len(list_filter((string_split(x, chr(10)))[1:10], lambda l: contains(l, chr(9)))) >= 2"


def _nested(patterns: list[tuple[str, str]], start: str = "text") -> str:
    out = start
    for pattern, mark in patterns:
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{mark.replace('$1', chr(92) + '1')}', 'g')"
    return out


def _redacted(patterns: list[tuple[str, str]]) -> str:
    return f"SELECT doc_id, sha256(r) AS redacted_hash, r <> text AS changed FROM (SELECT doc_id, text, {_nested(patterns)} AS r FROM documents)"



_NOISE = ", ".join("'" + p.replace("'", "''") + "'" for p in rules.NOISE)
_SHORT = ", ".join(f"'{p}'" for p in rules.SHORT_NOISE)
_UNMEANING = ", ".join(f"'{p}'" for p in rules.UNMEANING)

ORACLES = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 12) AS short_hash FROM documents",
    "chunk_words": f"""WITH {_CHUNKS}
SELECT doc_id, chunk_index::INTEGER AS chunk_index, total_chunks::INTEGER AS total_chunks, len(own)::INTEGER AS token_count,
       sha256(CASE WHEN n <= 1024 THEN text ELSE array_to_string(own, ' ') END) AS text_hash FROM chunk""",
    "chunk_stats": f"""WITH {_CHUNKS}
SELECT source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, sum(len(own))::BIGINT AS n_tokens, max(len(own))::BIGINT AS largest FROM chunk GROUP BY source""",
    "tabular_flag": f"""SELECT doc_id, {_TABULAR.replace('(x,', '(text,')} AS plain, {_TABULAR.replace('(x,', "(replace(text, ' ', chr(9)),")} AS with_tabs FROM documents""",
    "line_noise": rf"""
WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) >= 3
    AND NOT (length(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[^\pL\pN]+', '', 'g')) / length(regexp_replace(x, '^\s+|\s+$', '', 'g')) < 0.5 AND length(regexp_replace(x, '^\s+|\s+$', '', 'g')) < 20)
    AND len(list_filter([{_NOISE}], lambda p: contains(regexp_replace(x, '^\s+|\s+$', '', 'g'), p))) = 0
    AND NOT (length(regexp_replace(x, '^\s+|\s+$', '', 'g')) < 30 AND len(list_filter([{_SHORT}], lambda p: contains(x, p))) > 0)) AS l FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM l)
SELECT doc_id, sha256(t) AS clean_hash, length(t)::BIGINT AS clean_chars FROM c""",
    "truncate_text": r"""
WITH c AS (SELECT doc_id, text, strpos(reverse(left(text, 148)), ' ') AS r, strpos(reverse(left(text, 38)), ' ') AS s, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT *, CASE WHEN r > 0 AND 148 - r > 147 * 0.8 THEN 148 - r ELSE 147 END AS e, CASE WHEN s > 0 AND 38 - s > 37 * 0.8 THEN 38 - s ELSE 37 END AS f FROM c)
SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 147) || '...' ELSE text END AS preview,
       CASE WHEN length(text) <= 150 THEN text ELSE regexp_replace(left(text, e::INTEGER), '\s+$', '') || '...' END AS short,
       CASE WHEN length(text) <= 40 THEN text ELSE regexp_replace(left(text, f::INTEGER), '\s+$', '') || '...' END AS shorter,
       sha256(CASE WHEN len(l) <= 2 THEN text ELSE regexp_replace(array_to_string(l[1:2], chr(10)), '\s+$', '') || '...' END) AS lines_hash
FROM b""",
    "redact_router": _redacted([*rules.ROUTER_REDACTIONS, rules.EMAIL, rules.PHONE]),
    "redact_ocr": _redacted(rules.OCR_REDACTIONS),
    "redact_cards": r"""
WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '\b(?:\d{4}[-\s]?){3,4}\d{1,4}\b') AS m, regexp_split_to_array(text, '\b(?:\d{4}[-\s]?){3,4}\d{1,4}\b') AS b FROM documents),
e AS (SELECT *, list_transform(m, lambda x: regexp_replace(x, '\D', '', 'g')) AS ds FROM m),
k AS (SELECT *, list_transform(ds, lambda s: length(s) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN (length(s) - i) % 2 = 0 THEN s[i]::INTEGER
      ELSE 2 * s[i]::INTEGER - CASE WHEN s[i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0) AS c FROM e),
r AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i > len(m) THEN '' WHEN c[i] THEN '[REDACTED_CARD]' ELSE m[i] END), '') AS r FROM k)
SELECT doc_id, sha256(r) AS redacted_hash, r <> text AS changed FROM r""",
    "chunk_tabular": """
WITH l AS (SELECT l_orderkey, concat_ws(chr(9), l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS x,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, concat_ws(chr(9), l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)) AS i FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, list(x ORDER BY i) AS x FROM l GROUP BY l_orderkey),
j AS (SELECT *, greatest(1, n - 2) AS c, unnest(range(greatest(1, n - 2))) AS j FROM g),
o AS (SELECT *, CASE WHEN j = 0 THEN x[1:3] ELSE x[j:j + 3] END AS own FROM j)
SELECT l_orderkey, j::INTEGER AS chunk_index, c::INTEGER AS total_chunks, (5 * len(own))::INTEGER AS token_count, sha256(array_to_string(own, chr(10))) AS text_hash FROM o""",
    "luhn": """
WITH d AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 16, '4539') AS s FROM orders),
x AS (SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN s[i]::INTEGER
      ELSE 2 * s[i]::INTEGER - CASE WHEN s[i]::INTEGER > 4 THEN 9 ELSE 0 END END)) AS t FROM d)
SELECT o_orderkey, t % 10 = 0 AS is_card FROM x""",
    "meaningful_text": rf"""
SELECT doc_id, strlen(text) BETWEEN 2 AND 5000 AND length(regexp_replace(text, '[^\pL\pN\s.,!?;:''"\-()\[\]{{}}]+', '', 'g')) / length(text) >= 0.8
       AND length(regexp_replace(text, '[^\pL]+', '', 'g')) >= 2 AND len(list_filter([{_UNMEANING}], lambda p: contains(lower(text), p))) = 0 AS meaningful FROM documents""",
}
