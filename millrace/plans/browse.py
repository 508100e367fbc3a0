"""Queries on stored sources: pages, previews, details, deletes, messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import infix, store
from ..session import scratch, table


def _payloads(spark: SparkSession, d: str, per_path: bool = True) -> DataFrame:
    """Documents as captures: forty share a path, so paths get new content."""
    t = table(spark, d, "documents")
    n = F.floor(F.col("doc_id") / 40) if per_path else F.col("doc_id")
    url = F.concat(F.lit("https://site.example/"), F.col("lang"), F.lit("/"), n.cast("string"), F.lit("?v=1"))
    return store.payloads(t, F.concat(F.lit("web-"), F.col("lang")), url, F.col("text"), F.col("doc_id"))


def dedup_actions(spark: SparkSession, d: str) -> DataFrame:
    return store.actions(_payloads(spark, d)).select("seq", "source_path", "action")


def action_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.actions(_payloads(spark, d)).groupBy("source", "action").agg(F.count("*").alias("n"))


def latest_source(spark: SparkSession, d: str) -> DataFrame:
    return store.newest(_payloads(spark, d), ["content_hash"]).select("source_path", "seq", "content_hash", "n_seen", "first_seq")


def _snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return store.snapshot(_payloads(spark, d))


def live_counts(spark: SparkSession, d: str) -> DataFrame:
    sources, chunks = _snapshot(spark, d)
    gone = sources.where(F.col("updated_seq") % 3 == 0)
    left, marked = store.delete(sources, chunks, gone)
    a = left.agg(F.count("*").alias("n_sources"))
    b = marked.agg(F.count_if(~F.col("is_deleted")).alias("n_live"), F.count_if(F.col("is_deleted")).alias("n_deleted"))
    return a.join(b)  # one row each


def page_sources(spark: SparkSession, d: str, page: int = 1, limit: int = 10) -> DataFrame:
    """A page of sources, newest first, and whether more follow."""
    p = _payloads(spark, d)
    sources = store.newest(p, ["source"])
    total = sources.agg(F.count("*").alias("total"))
    rows = sources.select("source_path", F.col("source").alias("source_type"), F.col("seq").alias("updated_seq")).orderBy(F.desc("updated_seq"), "source_path").offset(page * limit).limit(limit)
    # contents are met by the page's rows alone
    counted = p.select("source_path", F.col("seq").alias("updated_seq"), "content").join(F.broadcast(rows), ["source_path", "updated_seq"])
    shown = counted.select("source_path", "source_type", text.chunk_count(F.col("content")).alias("chunk_count"), "updated_seq")
    return shown.join(F.broadcast(total)).withColumn("has_more", F.lit(page * limit + limit) < F.col("total"))


def source_preview(spark: SparkSession, d: str) -> DataFrame:
    """Every source with the start of its first live chunk."""
    sources, chunks = _snapshot(spark, d)
    first = chunks.where("NOT is_deleted").groupBy("doc_uid").agg(F.min_by("chunk_text", "chunk_index").alias("t"))
    return sources.join(first, "doc_uid", "left").select("source_path", "chunk_count", text.preview(F.coalesce("t", F.lit(""))).alias("preview"))


def doc_detail(spark: SparkSession, d: str) -> DataFrame:
    sources, chunks = _snapshot(spark, d)
    full = store.reconstruct(chunks, "\n")
    return sources.join(full, "doc_uid").select("source_path", "source_type", "n_live", F.sha2("content", 256).alias("content_hash_joined"), F.length("content").cast("bigint").alias("n_chars"))


def similar_sources(spark: SparkSession, d: str) -> DataFrame:
    sources, _ = _snapshot(spark, d)
    return sources.where(F.col("source_path").ilike("%SITE.example/en/%1%")).orderBy(F.desc("updated_seq"), "source_path").limit(10).select("source_path", "updated_seq")


def infix_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a piece of text, by an index of trigrams: a query each
    for a rare piece, one in two parts, and one too short for the index."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = infix.build(docs, "doc_id", "text", scratch(spark, "trigrams"))
    asked = {"rare": "%Licensed under%", "parts": "%PASSWORD%=%", "short": "%zq%"}
    return reduce(DataFrame.unionAll, [found.search(p).select(F.lit(name).alias("asked"), "doc_id") for name, p in asked.items()])


def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after replacing the content of some documents and deleting others."""
    sources, chunks = _snapshot(spark, d)
    changed = sources.where("updated_seq % 3 = 1").select("doc_uid", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit("new text").alias("chunk_text"), F.lit(2).alias("token_count"), F.lit(False).alias("is_deleted"))
    _, out = store.delete(sources, store.replace_chunks(chunks, changed), sources.where("updated_seq % 3 = 0"))
    return out.join(sources.select("doc_uid", "source_type"), "doc_uid").groupBy("source_type", "is_deleted").agg(F.count("*").alias("n"), F.sum("token_count").cast("bigint").alias("n_words"))


def append(spark: SparkSession, d: str) -> DataFrame:
    sources, chunks = _snapshot(spark, d)
    more = sources.select("doc_uid", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.lit("more text").alias("chunk_text"), F.lit(2).alias("token_count"), F.lit(False).alias("is_deleted"))
    out = store.append_chunks(chunks, more).where("chunk_text = 'more text'")
    return out.join(sources.select("doc_uid", "source_path"), "doc_uid").select("source_path", "chunk_index", "total_chunks")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "m")).where("trim(m) <> ''")
    return lines.select(F.concat(F.lit("chat://room/"), (F.col("conv_id") % 10).cast("string")).alias("source_url"), F.sha2("m", 256).alias("message_hash"), F.struct("conv_id", "turn", "line").alias("seq"), "m")


def message_dedup(spark: SparkSession, d: str) -> DataFrame:
    """New lines of later conversations against those stored from earlier ones."""
    m = _messages(spark, d)
    stored, incoming = m.where("seq.conv_id % 2 = 0"), m.where("seq.conv_id % 2 = 1")
    return store.new_messages(incoming, stored).groupBy("source_url").agg(F.count("*").alias("n_new"), F.sum(F.length("m")).alias("n_chars"))


def message_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    mark = F.concat(F.lit("["), F.date_format("ts", "h:mm a"), F.lit("] "), F.col("event_type"))
    return e.select("event_id", mark.alias("message"), text.minutes_of_day(mark).alias("message_order"))


def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    """Turns as blocks with speakers; the first user's words as title."""
    c = table(spark, d, "conversations")
    who = F.when(F.col("role") == "user", "User").otherwise("Gemini")
    block = F.concat(F.lit("["), who, F.lit("]\n"), F.col("text"))
    g = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("t"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first")
    )
    title = F.when(F.length("first") > 100, F.concat(F.left("first", F.lit(100)), F.lit("..."))).otherwise(F.col("first"))
    return g.select("conv_id", title.alias("title"), F.sha2(F.array_join(F.transform("t", lambda x: x["b"]), "\n\n"), 256).alias("text_hash"), F.size("t").alias("n_turns"))


def novelty(spark: SparkSession, d: str) -> DataFrame:
    """What each turn adds to the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("before", F.coalesce(F.lag("text").over(w), F.lit("")))
    new = text.new_content(F.col("before"), F.col("text"))
    return t.select("conv_id", "turn", F.sha2(new, 256).alias("new_hash"), F.length(new).cast("bigint").alias("n_chars"))


def turn_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of each turn with the turn before the last."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("before", F.lag("text", 2).over(w)).where("before IS NOT NULL")
    return t.select("conv_id", "turn", F.round(text.jaccard(F.col("text"), F.col("before")), 9).alias("jaccard"))


QUERIES = {
    "dedup_actions": dedup_actions,
    "action_counts": action_counts,
    "latest_source": latest_source,
    "live_counts": live_counts,
    "page_sources": page_sources,
    "source_preview": source_preview,
    "doc_detail": doc_detail,
    "similar_sources": similar_sources,
    "infix_search": infix_search,
    "soft_delete": soft_delete,
    "append_chunks": append,
    "message_dedup": message_dedup,
    "message_order": message_order,
    "conversation_text": conversation_text,
    "novelty": novelty,
    "turn_similarity": turn_similarity,
}

_P = """p AS (SELECT doc_id AS seq, 'web-' || lang AS source, 'https://site.example/' || lang || '/' || (doc_id // 40) AS source_path, text AS content, sha256(text) AS content_hash FROM documents)"""
_A = f"""{_P}, a AS (SELECT *, CASE WHEN lag(content_hash) OVER w IS NULL THEN 'created' WHEN lag(content_hash) OVER w = content_hash THEN 'skipped' ELSE 'updated' END AS action
  FROM p WINDOW w AS (PARTITION BY source_path ORDER BY seq))"""
_S = rf"""{_P},
l AS (SELECT source_path, arg_max(source, seq) AS source_type, arg_max(content, seq) AS text, max(seq) AS updated_seq FROM p GROUP BY source_path),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM l),
s AS (SELECT *, len(w) AS n, (CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 1024 THEN 1 ELSE (len(w) - 100) // 924 + 1 END)::INTEGER AS chunk_count FROM w),
j AS (SELECT *, unnest(range(chunk_count)) AS chunk_index FROM s),
c AS (SELECT *, CASE WHEN n <= 1024 THEN text ELSE array_to_string(list_concat(w[chunk_index * 924 + 1 : chunk_index * 924 + 1024],
        CASE WHEN chunk_index = chunk_count - 1 AND n > chunk_count * 924 THEN w[chunk_count * 924 + 1 :] ELSE [] END), ' ') END AS t FROM j)"""
_M = """m AS (SELECT conv_id, turn, 'chat://room/' || (conv_id % 10) AS source_url, unnest(string_split(text, chr(10))) AS m FROM conversations)"""

ORACLES = {
    "dedup_actions": f"WITH {_A} SELECT seq, source_path, action FROM a",
    "action_counts": f"WITH {_A} SELECT source, action, count(*) AS n FROM a GROUP BY ALL",
    "latest_source": f"WITH {_P} SELECT source_path, max(seq) AS seq, arg_max(content_hash, seq) AS content_hash, count(*) AS n_seen, min(seq) AS first_seq FROM p GROUP BY source_path",
    "live_counts": f"""WITH {_S} SELECT (SELECT count(*) FROM s WHERE updated_seq % 3 <> 0) AS n_sources, count(*) FILTER (updated_seq % 3 <> 0) AS n_live, count(*) FILTER (updated_seq % 3 = 0) AS n_deleted FROM c""",
    "page_sources": f"""WITH {_S} SELECT source_path, source_type, chunk_count, updated_seq, (SELECT count(*) FROM s) AS total, 20 < (SELECT count(*) FROM s) AS has_more
FROM s ORDER BY updated_seq DESC, source_path LIMIT 10 OFFSET 10""",
    "source_preview": f"""WITH {_S}, f AS (SELECT source_path, arg_min(t, chunk_index) AS t FROM c GROUP BY source_path)
SELECT source_path, chunk_count, CASE WHEN length(t) > 150 THEN left(t, 147) || '...' ELSE coalesce(t, '') END AS preview FROM s LEFT JOIN f USING (source_path)""",
    "doc_detail": f"""WITH {_S}, r AS (SELECT source_path, source_type, count(*) AS n_live, string_agg(t, chr(10) ORDER BY chunk_index) AS t FROM c GROUP BY ALL)
SELECT source_path, source_type, n_live, sha256(t) AS content_hash_joined, length(t)::BIGINT AS n_chars FROM r""",
    "similar_sources": f"""WITH {_S} SELECT source_path, updated_seq FROM s WHERE source_path ILIKE '%SITE.example/en/%1%' ORDER BY updated_seq DESC, source_path LIMIT 10""",
    "infix_search": """SELECT 'rare' AS asked, doc_id FROM documents WHERE text ILIKE '%Licensed under%' UNION ALL SELECT 'parts', doc_id FROM documents WHERE text ILIKE '%PASSWORD%=%'
UNION ALL SELECT 'short', doc_id FROM documents WHERE text ILIKE '%zq%'""",
    "soft_delete": rf"""WITH {_S}, z AS (
  SELECT source_type, updated_seq % 3 <> 2 AS is_deleted, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS k FROM c
  UNION ALL SELECT source_type, false, 2 FROM s WHERE updated_seq % 3 = 1)
SELECT source_type, is_deleted, count(*) AS n, sum(k)::BIGINT AS n_words FROM z GROUP BY ALL""",
    "append_chunks": f"WITH {_S} SELECT source_path, chunk_count AS chunk_index, chunk_count + 1 AS total_chunks FROM s",
    "message_dedup": f"""WITH {_M}, n AS (SELECT DISTINCT source_url, m FROM m WHERE conv_id % 2 = 1 AND trim(m) <> ''
  AND (source_url, m) NOT IN (SELECT (source_url, m) FROM m WHERE conv_id % 2 = 0 AND trim(m) <> ''))
SELECT source_url, count(*) AS n_new, sum(length(m))::BIGINT AS n_chars FROM n GROUP BY source_url""",
    "message_order": """
SELECT event_id, '[' || strftime(ts, '%-I:%M %p') || '] ' || event_type AS message, (date_part('hour', ts) * 60 + date_part('minute', ts))::INTEGER AS message_order FROM events""",
    "conversation_text": """
WITH g AS (SELECT conv_id, string_agg('[' || CASE WHEN role = 'user' THEN 'User' ELSE 'Gemini' END || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS t,
  arg_min(text, turn) FILTER (role = 'user') AS f, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(f) > 100 THEN left(f, 100) || '...' ELSE f END AS title, sha256(t) AS text_hash, n::INTEGER AS n_turns FROM g""",
    "novelty": r"""
WITH t AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM conversations),
l AS (SELECT *, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l,
  list_transform(string_split(b, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS bl, list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '') AS bw FROM t),
n AS (SELECT conv_id, turn, coalesce(array_to_string(list_filter(l, lambda x: strlen(x) >= 10 AND NOT (strlen(x) > 10 AND list_contains(bl, x))
  AND len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: list_contains(bw, y))) / len(regexp_split_to_array(x, '\s+')) < 0.8), chr(10)), '') AS s FROM l)
SELECT conv_id, turn, sha256(s) AS new_hash, length(s)::BIGINT AS n_chars FROM n""",
    "turn_similarity": r"""
WITH t AS (SELECT conv_id, turn, text, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b), '\s+'), lambda x: x <> '')) AS y FROM t WHERE b IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM w""",
}
