"""Queries on what captures look like when they come in, on trees of elements, and on vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, text
from ..operators import nearby, nearest, ui, upsert
from ..operators.sequential import sequential
from ..sources import documents, payloads
from ..session import spread, table
from ..streaming import steps
from .capture import TITLES, _key, _pick, _pick_sql


def _json(t: DataFrame) -> Column:
    """Documents as payload lines; some lack a field or are cut off."""
    whole = F.to_json(F.struct(F.col("source"), F.concat(F.lit("https://s.example/"), F.col("lang"), F.lit("?q=1")).alias("url"), F.col("text").alias("content"), F.lit("T").alias("title"), F.col("doc_id").alias("timestamp"), F.lit(1).alias("other")))
    return F.when(F.col("doc_id") % 11 == 5, '{"source":"x","url":"u"}').when(F.col("doc_id") % 11 == 7, F.left(whole, F.lit(40))).otherwise(whole)


def payload_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    p = payloads.parse_payloads(t.select("doc_id", _json(t).alias("value")))
    return p.select("doc_id", "source", "url", F.sha2("content", 256).alias("content_hash"), "title", "timestamp", "error")


def stored_lines(spark: SparkSession, d: str) -> DataFrame:
    """Actions of lines that come into an empty store, bad ones among them."""
    t = table(spark, d, "documents")
    lines = t.select(F.col("doc_id").alias("seq"), _json(t).alias("value"))
    none = spark.createDataFrame([], "source_path string, doc_uid string, source_type string, content_hash string, chunk_count int, updated_seq long")
    chunks = spark.createDataFrame([], "doc_uid string, chunk_index int, total_chunks int, chunk_text string, token_count int, is_deleted boolean")
    m = upsert.store_lines(lines, none, chunks)
    return m.responses.select("seq", "action")


def framed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a browser's extension in frames; those that aren't content go."""
    t = table(spark, d, "documents")
    message = F.to_json(F.struct(F.when(F.col("doc_id") % 3 != 0, "content").otherwise("ping").alias("type"), F.lit("web").alias("source"), F.col("text").alias("content")))
    size = F.octet_length(message)
    head = F.unhex(F.concat(*[F.lpad(F.hex(F.pmod(F.floor(size / 256**i), F.lit(256))), 2, "0") for i in range(4)]))
    frame = F.concat(head, F.encode(message, "UTF-8"))
    files = t.select(F.col("doc_id").alias("path"), F.concat(frame, frame, F.unhex(F.lit("00000000"))).alias("content"))
    m = payloads.extension_messages(payloads.frames(files))
    return m.select("path", "number", F.sha2("content", 256).alias("content_hash"), "app_name", "bundle_id", "confidence")


def reader_output(spark: SparkSession, d: str) -> DataFrame:
    """Output of the interface reader and of the text recogniser, and which of it failed."""
    k = F.col("doc_id")
    raw = F.when(k % 4 == 0, "{}").otherwise(F.to_json(F.struct(F.col("text").alias("content"), F.col("text").alias("text"), F.when(k % 4 == 1, 0.5).alias("confidence"), F.when(k % 4 == 2, "no").alias("error"))))
    t = table(spark, d, "documents").select("doc_id", raw.alias("value"))
    a = payloads.accessible(t).select("doc_id", F.col("failed").alias("interface_failed"))
    r = payloads.recognised(t).select("doc_id", F.col("failed").alias("recogniser_failed"), "confidence")
    return a.join(r, "doc_id")


def exports(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 7 == 3, 429).when(F.col("doc_id") % 7 == 4, 500).otherwise(200)
    body = F.when(F.col("doc_id") % 7 == 5, " ").otherwise(F.concat(F.lit(" "), F.col("text"), F.lit(" x ")))
    e = payloads.exports(table(spark, d, "documents").select("doc_id", status.alias("status"), body.alias("body")))
    return e.select("doc_id", F.sha2("content", 256).alias("content_hash"), "error")


def office_dispatch(spark: SparkSession, d: str) -> DataFrame:
    bundle = _pick(_key(), ["com.microsoft.Excel", "com.microsoft.Word", "com.apple.iWork.Keynote", "com.apple.Notes"])
    path = F.concat(F.lit("/a.b/file"), _pick(F.floor(_key() / 4), [".XLSX", ".docx", ".key", "", ".ods"]))
    return table(spark, d, "orders").select("o_orderkey", documents.office_reader(bundle, path).alias("reader"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as trees: each line hangs on the first, every third one's role is a button."""
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    low = F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))
    n = F.col("l_linenumber")
    role = F.when(n % 3 == 0, "AXButton").when(n % 3 == 1, "AXStaticText").otherwise("AXCell")
    return one.withColumn("first", low).select(
        F.col("l_orderkey").alias("tree"), n.alias("node"), F.when(n != F.col("first"), F.col("first")).alias("parent"), n.alias("ord"), F.when(n == F.col("first"), "AXGroup").otherwise(role).alias("role"),
        F.when(F.col("p") % 2 == 0, F.concat(F.lit(" v"), F.col("p").cast("string"))).alias("value"), F.when(F.col("p") % 3 == 0, "a. b").otherwise(" d ").alias("description"),
    )


def ui_trees(spark: SparkSession, d: str) -> DataFrame:
    return ui.tree_text(_nodes(spark, d)).withColumnRenamed("tree", "l_orderkey")


def ui_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of a role, and what they say."""
    return ui.dump(ui.find(_nodes(spark, d), "AXCell")).withColumnRenamed("tree", "l_orderkey")


def ocr_titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 != 0, _pick(F.col("doc_id"), TITLES))
    return table(spark, d, "documents").select("doc_id", text.ocr_title(title, F.col("text"), canonical.clean_window_title).alias("title"), text.preview(F.concat(F.lit("https://s.example/"), F.translate("text", "\n ", "__")), 100).alias("short_url"))


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation less than two minutes apart that share words."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 30.0).alias("at"))
    p = nearby.similar_in_time(c, "conv_id", "at", "text", 120, 0.05)
    return p.select("conv_id", "turn", F.col("turn_").alias("later"), F.round("jaccard", 9).alias("jaccard"))


def path_cache(spark: SparkSession, d: str) -> DataFrame:
    """Captures of a path against the last one, which an idle path forgets."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("content_hash"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return sequential(e, ["user_id"], ["at", "event_id"], steps.dedup_step(7200), "action string").select("user_id", "event_id", "action")


def retrieval_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every twentieth one, itself included, by cosine."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nearest.by_cosine(e.where("id % 20 = 0"), e, 10)
    return found.select("query_id", F.col("id").alias("vec_id"), "score")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Values as a sheet's cells show them."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(text.cell_string(F.col("text")), 256).alias("shown_hash"))


QUERIES = {
    "payload_lines": payload_lines,
    "stored_lines": stored_lines,
    "framed_messages": framed_messages,
    "reader_output": reader_output,
    "exports": exports,
    "office_dispatch": office_dispatch,
    "ui_trees": ui_trees,
    "ui_elements": ui_elements,
    "ocr_titles": ocr_titles,
    "jaccard_pairs": jaccard_pairs,
    "path_cache": path_cache,
    "retrieval_topk": retrieval_topk,
    "cells": cells,
}

_T = f"""t AS (SELECT o.l_orderkey, o.n, min(n) OVER (PARTITION BY l_orderkey) = n AS top, CASE WHEN p % 2 = 0 THEN 'v' || p WHEN p % 3 <> 0 THEN 'd' END AS said, n % 3 AS r, p
  FROM (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL) o)"""

ORACLES = {
    "payload_lines": """
SELECT doc_id, CASE doc_id % 11 WHEN 5 THEN 'x' WHEN 7 THEN NULL ELSE source END AS source, CASE doc_id % 11 WHEN 5 THEN 'u' WHEN 7 THEN NULL ELSE 'https://s.example/' || lang || '?q=1' END AS url,
       CASE WHEN doc_id % 11 NOT IN (5, 7) THEN sha256(text) END AS content_hash, CASE WHEN doc_id % 11 NOT IN (5, 7) THEN 'T' END AS title, CASE WHEN doc_id % 11 NOT IN (5, 7) THEN doc_id END AS timestamp,
       CASE doc_id % 11 WHEN 5 THEN 'Parse error: missing content' WHEN 7 THEN 'Parse error: not a payload' END AS error FROM documents""",
    "stored_lines": """
WITH p AS (SELECT doc_id AS seq, lang, sha256(text) AS h, doc_id % 11 IN (5, 7) AS bad FROM documents),
g AS (SELECT seq, CASE WHEN lag(h) OVER w IS NULL THEN 'created' WHEN lag(h) OVER w = h THEN 'skipped' ELSE 'updated' END AS action FROM p WHERE NOT bad WINDOW w AS (PARTITION BY lang ORDER BY seq))
SELECT seq, action FROM g UNION ALL SELECT seq, 'failed' FROM p WHERE bad""",
    "framed_messages": """SELECT doc_id AS path, n::INTEGER AS number, sha256(text) AS content_hash, 'Chrome' AS app_name, 'com.google.Chrome' AS bundle_id, 1.0::FLOAT AS confidence
FROM documents, (SELECT unnest([0, 1]) AS n) WHERE doc_id % 3 <> 0""",
    "reader_output": """SELECT doc_id, doc_id % 4 = 0 OR text = '' AS interface_failed, doc_id % 4 IN (0, 2) OR text = '' AS recogniser_failed, CASE WHEN doc_id % 4 = 1 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM documents""",
    "exports": r"""SELECT doc_id, CASE WHEN doc_id % 7 NOT IN (3, 4, 5) THEN sha256(regexp_replace(text || ' x', '^\s+', '')) END AS content_hash,
  CASE doc_id % 7 WHEN 3 THEN 'Rate limited (429) - try again later' WHEN 4 THEN 'Export failed with status 500' WHEN 5 THEN 'Export returned empty content' END AS error FROM documents""",
    "office_dispatch": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey // 4 % 5 IN (0, 4) THEN 'xlsx' WHEN o_orderkey % 4 = 1 AND o_orderkey // 4 % 5 = 1 THEN 'docx' WHEN o_orderkey % 4 = 2 AND o_orderkey // 4 % 5 = 2 THEN 'key' END AS reader FROM orders""",
    "ui_trees": f"WITH {_T} SELECT l_orderkey, coalesce(string_agg(said || chr(10), '' ORDER BY n) FILTER (NOT top AND r <> 0), '') AS content FROM t GROUP BY l_orderkey",
    "ui_elements": f"WITH {_T} SELECT l_orderkey, n AS node, concat_ws(' | ', CASE WHEN p % 2 = 0 THEN 'value=v' || p END, 'description=' || CASE WHEN p % 3 = 0 THEN 'a. b' ELSE 'd' END) AS said FROM t WHERE NOT top AND r = 2",
    "ocr_titles": rf"""
WITH t AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN {_pick_sql('doc_id', TITLES)} END AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 10 AND 200) AS l FROM documents),
u AS (SELECT *, 'https://s.example/' || translate(text, chr(10) || ' ', '__') AS u, trim(CASE WHEN ends_with(w, ' - Google Chrome') THEN left(w, length(w) - 16) WHEN ends_with(w, ' - Safari') THEN left(w, length(w) - 9) WHEN ends_with(w, ' - Opera') THEN left(w, length(w) - 8) ELSE w END) AS c FROM t)
SELECT doc_id, CASE WHEN coalesce(w, '') <> '' THEN c ELSE left(l[1], 100) END AS title, CASE WHEN length(u) > 100 THEN left(u, 97) || '...' ELSE u END AS short_url FROM u""",
    "jaccard_pairs": r"""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS x FROM conversations),
p AS (SELECT a.conv_id, a.turn, b.turn AS later, len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) AS j FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn < a.turn + 4)
SELECT conv_id, turn, later, round(j, 9) AS jaccard FROM p WHERE j >= 0.05""",
    "path_cache": """SELECT user_id, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 'created' WHEN lag(event_type) OVER w = event_type THEN 'skipped' ELSE 'updated' END AS action
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "retrieval_topk": """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "cells": "SELECT doc_id, sha256(replace(replace(replace(text, chr(9), '    '), chr(10), ' '), chr(13), '')) AS shown_hash FROM documents",
}
