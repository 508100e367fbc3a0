"""Queries on payloads against stored sources, messages and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy, text
from ..operators import buckets, lookup, paging, store, upsert
from ..session import scratch, table
from ..sources.changes import stored_changes
from ..streaming.replay import replayed


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as captures, forty to a path, some with the same text as others of it."""
    t = table(spark, d, "documents")
    url = F.concat(F.lit("https://site.example/"), F.col("lang"), F.lit("/"), F.floor(F.col("doc_id") / 40).cast("string"), F.lit("?v=1"))
    content = F.when(F.floor(F.col("doc_id") / 4) % 3 == 0, F.concat(F.lit("same text in "), F.col("lang"))).otherwise(F.col("text"))
    return store.payloads(t, F.concat(F.lit("web-"), F.col("lang")), url, content, F.col("doc_id"))


def _is_stored() -> Column:
    return (F.col("seq") % 40 < 30) & (F.floor(F.col("seq") / 40) % 4 != 0)


def _merged(spark: SparkSession, d: str) -> upsert.Merged:
    p = _payloads(spark, d)
    sources, chunks = store.snapshot(p.where(_is_stored()))
    return upsert.merge(p.where(~_is_stored()), sources, chunks)


def payload_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored sources after the payloads that came later."""
    return _merged(spark, d).sources.select("source_path", "source_type", "content_hash", "chunk_count", "updated_seq")


def payload_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Live and flagged chunks of each source after the payloads that came later."""
    m = _merged(spark, d)
    counts = m.chunks.groupBy("doc_uid").agg(F.count_if(~F.col("is_deleted")).alias("n_live"), F.count_if(F.col("is_deleted")).alias("n_deleted"))
    return m.sources.join(counts, "doc_uid", "left").select("source_path", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """A response line for every payload that came later."""
    return _merged(spark, d).responses.select("seq", "action", "line")


def _stored(spark: SparkSession, d: str) -> str:
    """A bucketed store of the first payloads, into which the others went in two merges."""
    root = scratch(spark, "store")
    p = _payloads(spark, d)
    buckets.create(spark, root, *store.snapshot(p.where(_is_stored())), buckets=16)
    later, half = p.where(~_is_stored()), F.floor(F.col("seq") / 40) % 2 == 0
    for part in (later.where(half), later.where(~half)):
        buckets.merge(spark, root, part)
    return root


def bucketed_merge(spark: SparkSession, d: str) -> DataFrame:
    """``payload_merge`` by merges that read and write only the buckets they touch."""
    return buckets.read(spark, _stored(spark, d), "sources").select("source_path", "source_type", "content_hash", "chunk_count", "updated_seq")


def bucketed_chunks(spark: SparkSession, d: str) -> DataFrame:
    root = _stored(spark, d)
    counts = buckets.read(spark, root, "chunks").groupBy("doc_uid").agg(F.count_if(~F.col("is_deleted")).alias("n_live"), F.count_if(F.col("is_deleted")).alias("n_deleted"))
    sources = buckets.read(spark, root, "sources")
    return sources.join(counts, "doc_uid", "left").select("source_path", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"))


def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Rows that were created or updated from each state of the store to the next."""
    found = replayed(stored_changes(spark, _stored(spark, d)), "change-feed")
    return found.select("version", "change", "source_path", "content_hash", "updated_seq")


def source_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = _payloads(spark, d)
    old, _ = store.snapshot(p.where(_is_stored()))
    new, _ = store.snapshot(p.where(~_is_stored()))
    new = new.withColumn("doc_uid", F.concat(F.lit("new-"), F.col("doc_uid")))
    return upsert.upsert(old, new).select("source_path", "doc_uid", "content_hash", "updated_seq")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    sources, _ = store.snapshot(_payloads(spark, d))
    return upsert.by_path(sources, "https://site.example/en/3").select("source_path", "content_hash", "updated_seq")


def _lookup(spark: SparkSession, d: str) -> lookup.Stored:
    sources, _ = store.snapshot(_payloads(spark, d))
    return lookup.build(sources.select("source_path", "doc_uid", "content_hash", "updated_seq"), scratch(spark, "lookup"), "source_path", "doc_uid")


def path_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Stored sources of the paths of every twentieth capture, from the files that hold them."""
    wanted = _payloads(spark, d).where("seq % 20 = 0").select("source_path")
    return _lookup(spark, d).by_paths(wanted).select("source_path", "content_hash", "updated_seq")


def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A stored source by its document's name, which lies in no order."""
    uid = spark.range(1).select(store.doc_uid(F.lit("https://site.example/en/3")).alias("uid")).first()["uid"]
    return _lookup(spark, d).by_uid(uid).select("source_path", "doc_uid", "updated_seq")


def json_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order by a number in their JSON metadata."""
    t = table(spark, d, "lineitem").select("l_orderkey", F.to_json(F.struct((F.col("l_linenumber") * 4).alias("chunk_index"))).alias("meta"), F.col("l_partkey").cast("string").alias("v"))
    rows = F.array_sort(F.collect_list(F.struct(upsert.json_number(F.col("meta"), "$.chunk_index").alias("i"), "v")))
    return t.groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["v"]), ",").alias("parts"))


def pages_appended(spark: SparkSession, d: str) -> DataFrame:
    """The first three pages of sources, newest first, as a list that was scrolled."""
    p = store.latest(_payloads(spark, d)).select("source_path", F.col("seq").alias("updated_seq"))
    pages = [p.orderBy(F.desc("updated_seq"), "source_path").offset(i * 5).limit(5) for i in range(3)]
    return upsert.pages_together(*pages)


def indexed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of a hundred events, newest first, found by the index, and (as
    page -1) what follows the last row of the second by its key."""
    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.col("event_id").cast("string").alias("path"))
    pages = paging.build(e, scratch(spark, "pages"), "seq", "path", per_file=1500)
    found = [pages.page(n, 100).select(F.lit(n).alias("page"), "event_id", "has_more") for n in (0, 7, 99)]
    last = pages.page(7, 100).orderBy("seq", F.desc("path")).first()
    if last is not None:
        found.append(pages.after(last["seq"], last["path"], 50).select(F.lit(-1).alias("page"), "event_id", F.lit(True).alias("has_more")))
    return reduce(DataFrame.unionAll, found)


def content_suppress(spark: SparkSession, d: str) -> DataFrame:
    """Redacted captures of a window, without those equal to the one before."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.concat(F.lit("saw "), F.col("event_type"), F.lit(" id 123-45-6789")).alias("text"))
    e = e.withColumn("text", privacy.redact_router(F.col("text")))
    return upsert.unrepeated(e, ["user_id"], ["ts", "event_id"], "text").select("user_id", "event_id", "text")


def order_check(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a user's events by id that are out of order in time."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return upsert.disorder(e, ["user_id"], ["event_id"], "ts")


def _timed_messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    mark = F.concat(F.lit("["), (F.col("turn") * 5 % 12 + 1).cast("string"), F.lit(":05 PM] "))
    lines = c.select("conv_id", "turn", mark.alias("mark"), F.posexplode(F.split("text", "\n")).alias("line", "t")).where("trim(t) <> ''")
    m = lines.select(F.concat(F.lit("chat://"), F.col("conv_id").cast("string")).alias("source_url"), "conv_id", F.struct("turn", "line").alias("seq"), F.concat("mark", "t").alias("m"))
    return m.withColumns({"message_hash": F.sha2("m", 256), "message_order": text.minutes_of_day(F.col("m"))})


def message_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Chats from all their messages by time, against the text that was stored of
    the first turns."""
    every = _timed_messages(spark, d)
    early = every.where("seq.turn < 3")
    none = every.limit(0).select("source_url", "message_hash")
    # each hash of a chat once, those of the first turns from what is stored
    stored = store.new_messages(early, none)
    messages = stored.unionByName(store.new_messages(every, stored))
    before = upsert.rebuilt(stored.where("conv_id % 3 <> 0"), none.withColumnRenamed("message_hash", "content_hash"))
    return upsert.rebuilt(messages, before.select("source_url", "content_hash")).select("source_url", "n_messages", "content_hash", "chunk_count", "status")


QUERIES = {
    "payload_merge": payload_merge,
    "payload_chunks": payload_chunks,
    "bucketed_merge": bucketed_merge,
    "bucketed_chunks": bucketed_chunks,
    "change_feed": change_feed,
    "responses": responses,
    "source_upsert": source_upsert,
    "point_lookup": point_lookup,
    "path_lookups": path_lookups,
    "document_lookup": document_lookup,
    "json_order": json_order,
    "pages_appended": pages_appended,
    "indexed_pages": indexed_pages,
    "content_suppress": content_suppress,
    "order_check": order_check,
    "message_rebuild": message_rebuild,
}

_P = r"""p AS (SELECT *, sha256(content) AS h, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS n, (seq % 40 < 30 AND (seq // 40) % 4 <> 0) AS old
  FROM (SELECT doc_id AS seq, 'web-' || lang AS source, 'https://site.example/' || lang || '/' || (doc_id // 40) AS path,
               CASE WHEN (doc_id // 4) % 3 = 0 THEN 'same text in ' || lang ELSE text END AS content FROM documents)),
k AS (SELECT *, (CASE WHEN n = 0 THEN 0 WHEN n <= 1024 THEN 1 ELSE (n - 100) // 924 + 1 END)::INTEGER AS c FROM p),
st AS (SELECT path, arg_max(h, seq) AS h, arg_max(c, seq) AS c, max(seq) AS seq, arg_max(source, seq) AS source FROM k WHERE old GROUP BY path)"""
_A = f"""{_P},
a AS (SELECT *, CASE WHEN b IS NULL THEN 'created' WHEN b = h THEN 'skipped' ELSE 'updated' END AS action
  FROM (SELECT k.*, lag(k.h) OVER w IS NULL AS first, coalesce(lag(k.h) OVER w, st.h) AS b FROM k LEFT JOIN st USING (path) WHERE NOT old WINDOW w AS (PARTITION BY path ORDER BY k.seq))),
z AS (SELECT path, arg_max(h, seq) AS h, arg_max(c, seq) AS c, max(seq) AS seq, arg_max(source, seq) AS source FROM a WHERE action <> 'skipped' GROUP BY path),
f AS (SELECT path, CASE WHEN z.h IS NULL OR z.h = st.h THEN 'old' WHEN st.h IS NULL THEN 'new' ELSE 'both' END AS kind, st.h AS h0, st.c AS c0, st.seq AS s0, st.source AS o0, z.h AS h1, z.c AS c1, z.seq AS s1, z.source AS o1
  FROM st FULL JOIN z USING (path))"""
_UID = "concat_ws('-', substr(x, 1, 8), substr(x, 9, 4), substr(x, 13, 4), substr(x, 17, 4), substr(x, 21, 12))"

ORACLES = {
    "payload_merge": f"""WITH {_A} SELECT path AS source_path, coalesce(o0, o1) AS source_type, CASE kind WHEN 'old' THEN h0 ELSE h1 END AS content_hash,
  CASE kind WHEN 'old' THEN c0 ELSE c1 END AS chunk_count, CASE kind WHEN 'old' THEN s0 ELSE s1 END AS updated_seq FROM f""",
    "payload_chunks": f"""WITH {_A} SELECT path AS source_path, (CASE kind WHEN 'old' THEN c0 ELSE c1 END)::BIGINT AS n_live, (CASE kind WHEN 'both' THEN c0 ELSE 0 END)::BIGINT AS n_deleted FROM f""",
    "responses": f"""WITH {_A}, u AS (SELECT *, sha256(path) AS x FROM a)
SELECT seq, action, CASE action WHEN 'skipped' THEN '{{"status":"ok","action":"skipped","message":"Content unchanged (' || CASE WHEN first THEN 'db' ELSE 'cache' END || ')"}}'
  ELSE '{{"status":"ok","action":"' || action || '","doc_uid":"' || {_UID} || '","chunk_count":' || c || '}}' END AS line FROM u""",
    "source_upsert": f"""WITH {_P}, nw AS (SELECT path, arg_max(h, seq) AS h, max(seq) AS seq FROM k WHERE NOT old GROUP BY path),
j AS (SELECT path, sha256(path) AS x, st.h AS h0, st.seq AS s0, nw.h AS h1, nw.seq AS s1 FROM st FULL JOIN nw USING (path))
SELECT path AS source_path, CASE WHEN h0 IS NULL THEN 'new-' ELSE '' END || {_UID} AS doc_uid, coalesce(h1, h0) AS content_hash, coalesce(s1, s0) AS updated_seq FROM j""",
    "point_lookup": f"""WITH {_P} SELECT path AS source_path, arg_max(h, seq) AS content_hash, max(seq) AS updated_seq FROM k WHERE path = 'https://site.example/en/3' GROUP BY path""",
    "path_lookups": f"""WITH {_P} SELECT path AS source_path, arg_max(h, seq) AS content_hash, max(seq) AS updated_seq FROM k GROUP BY path HAVING bool_or(seq % 20 = 0)""",
    "document_lookup": f"""WITH {_P}, l AS (SELECT path, sha256(path) AS x, max(seq) AS updated_seq FROM k GROUP BY path)
SELECT path AS source_path, {_UID} AS doc_uid, updated_seq FROM l WHERE path = 'https://site.example/en/3'""",
    "json_order": """WITH m AS (SELECT l_orderkey, '{"chunk_index":' || (l_linenumber * 4) || '}' AS meta, l_partkey::VARCHAR AS v FROM lineitem)
SELECT l_orderkey, string_agg(v, ',' ORDER BY (meta->>'$.chunk_index')::INTEGER, v) AS parts FROM m GROUP BY l_orderkey""",
    "pages_appended": f"""WITH {_P}, l AS (SELECT path AS source_path, max(seq) AS updated_seq FROM k GROUP BY path)
SELECT source_path, updated_seq, ((row_number() OVER (ORDER BY updated_seq DESC, source_path) - 1) // 5)::INTEGER AS page FROM l QUALIFY page < 3""",
    "content_suppress": """SELECT user_id, event_id, 'saw ' || event_type || ' id [REDACTED_SSN]' AS text FROM events
QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)""",
    "order_check": """WITH p AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events)
SELECT user_id, count(*) AS n_pairs, count(*) FILTER (nx < ts) AS n_wrong FROM p WHERE nx IS NOT NULL GROUP BY user_id""",
    "message_rebuild": r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM conversations),
m AS (SELECT conv_id, turn, line, turn * 5 % 12 + 1 AS hr, '[' || (turn * 5 % 12 + 1) || ':05 PM] ' || t AS m FROM l WHERE trim(t) <> ''),
u AS (SELECT conv_id, m, arg_min(hr, (turn, line)) AS hr, min((turn, line)) AS seq, min(turn) AS turn FROM m GROUP BY conv_id, m),
o AS (SELECT *, CASE WHEN hr = 12 THEN 12 ELSE hr + 12 END * 60 + 5 AS minutes FROM u),
a AS (SELECT conv_id, count(*) AS n_messages, string_agg(m, chr(10) ORDER BY minutes, seq) AS t, string_agg(m, chr(10) ORDER BY minutes, seq) FILTER (turn < 3) AS early FROM o GROUP BY conv_id),
w AS (SELECT *, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS n FROM a)
SELECT 'chat://' || conv_id AS source_url, n_messages, sha256(t) AS content_hash, (CASE WHEN n = 0 THEN 0 WHEN n <= 1024 THEN 1 ELSE (n - 100) // 924 + 1 END)::INTEGER AS chunk_count,
       CASE WHEN conv_id % 3 = 0 OR early IS NULL THEN 'New' WHEN early = t THEN 'Duplicate' ELSE 'Updated' END AS status FROM w""",
}

ORACLES["bucketed_merge"] = ORACLES["payload_merge"]
ORACLES["bucketed_chunks"] = ORACLES["payload_chunks"]
#: Paths of one language and forty documents are of one half: state 1 or 2.
ORACLES["change_feed"] = f"""WITH {_A}, g AS (SELECT *, CASE (regexp_extract(path, '/([0-9]+)$', 1)::BIGINT) % 2 WHEN 0 THEN 1 ELSE 2 END AS later FROM f)
SELECT 0 AS version, 'created' AS change, path AS source_path, h0 AS content_hash, s0 AS updated_seq FROM g WHERE h0 IS NOT NULL
UNION ALL SELECT later, CASE WHEN h0 IS NULL THEN 'created' ELSE 'updated' END, path, h1, s1 FROM g WHERE kind <> 'old'"""
ORACLES["indexed_pages"] = """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id::VARCHAR) - 1 AS n, count(*) OVER () AS total FROM events)
SELECT (n // 100)::INTEGER AS page, event_id, (n // 100 + 1) * 100 < total AS has_more FROM n WHERE n // 100 IN (0, 7, 99) UNION ALL SELECT -1, event_id, true FROM n WHERE n BETWEEN 800 AND 849"""
