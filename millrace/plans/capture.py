"""Queries on URLs, sources, block lists and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, labels, privacy, rules
from ..session import table


def _pick(key: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _pick_sql(key: str, values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


BUNDLES = [
    "com.microsoft.Word", "com.apple.Safari", "com.google.Chrome", "org.mozilla.firefox", "com.tinyspeck.slackmacgap", "com.microsoft.teams2", "us.zoom.xos",
    "com.search.tool", "com.operasoftware.Opera", "com.jetbrains.pycharm", "dev.kiro.app", "x.viewer-app.y", "com.mybank.app", "com.1password.mac", "org.DaVinciResolve",
    "com.apple.keychainaccess", "com.bitwarden.desktop", "md.obsidian", "com.figma.Desktop", "com.example.plain",
]
TITLES = [
    "Report - Google Chrome", "a/b: c.d, 'e' -- Inbox - Safari", "Sign In to Bank", "Pay.example.com", "Weekly Teams sync", "JIRA board", "My Google Docs file", "--x--", "Notes",
    "Checkout - Shop - Opera", "GitHub pull request", "", "login.example.org", "Word count",
]


def _key() -> Column:
    return F.col("o_orderkey")


def _built(spark: SparkSession, d: str) -> DataFrame:
    k = _key().cast("string")
    urls = [
        ("gdocs", F.concat(F.lit("https://docs.google.com/document/d/doc_"), k, F.lit("/edit?usp=sharing"))),
        ("gsheets", F.concat(F.lit("https://docs.google.com/spreadsheets/d/sh-"), k, F.lit("/edit#gid="), k)),
        ("gslides", F.concat(F.lit("https://docs.google.com/presentation/d/p"), k, F.lit("/edit"))),
        ("gemini", F.concat(F.lit("https://gemini.google.com/app/c"), k)),
        ("google-search", F.concat(F.lit("https://www.google.com/search?hl=en&q=Big%20Data+"), k, F.lit("&udm=14"))),
        ("google-ai", F.concat(F.lit("https://www.google.com/search?q=%20Wide~x*"), k, F.lit("&udm=50"))),
        ("jira", F.concat(F.lit("https://team.atlassian.net/browse/AB-"), k, F.lit("?filter=1"))),
        ("jira", F.concat(F.lit("https://team.atlassian.net/issues?selectedIssue=CD-"), k)),
        ("slack", F.concat(F.lit("https://acme.slack.com/archives/C"), k, F.lit("?x=1"))),
        ("teams", F.concat(F.lit("https://teams.microsoft.com/l/channel/"), k)),
        ("chrome", F.concat(F.lit("HTTPS://Shop.Example.COM:443?item="), k)),
        ("chrome", F.concat(F.lit("not a url "), k)),
    ]
    n = F.lit(len(urls))
    at = F.pmod(_key(), n).cast("int")
    t = table(spark, d, "orders").select("o_orderkey")
    return t.select(
        "o_orderkey", F.get(F.array(*[F.lit(s) for s, _ in urls]), at).alias("source"), F.get(F.array(*[u for _, u in urls]), at).alias("url")
    )


_BUILT = """b AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, (o_orderkey % 12)::INTEGER AS m,
  ['gdocs', 'gsheets', 'gslides', 'gemini', 'google-search', 'google-ai', 'jira', 'jira', 'slack', 'teams', 'chrome', 'chrome'][(o_orderkey % 12)::INTEGER + 1] AS source,
  ['https://docs.google.com/document/d/doc_' || o_orderkey || '/edit?usp=sharing', 'https://docs.google.com/spreadsheets/d/sh-' || o_orderkey || '/edit#gid=' || o_orderkey,
   'https://docs.google.com/presentation/d/p' || o_orderkey || '/edit', 'https://gemini.google.com/app/c' || o_orderkey,
   'https://www.google.com/search?hl=en&q=Big%20Data+' || o_orderkey || '&udm=14', 'https://www.google.com/search?q=%20Wide~x*' || o_orderkey || '&udm=50',
   'https://team.atlassian.net/browse/AB-' || o_orderkey || '?filter=1', 'https://team.atlassian.net/issues?selectedIssue=CD-' || o_orderkey,
   'https://acme.slack.com/archives/C' || o_orderkey || '?x=1', 'https://teams.microsoft.com/l/channel/' || o_orderkey,
   'HTTPS://Shop.Example.COM:443?item=' || o_orderkey, 'not a url ' || o_orderkey][(o_orderkey % 12)::INTEGER + 1] AS url FROM orders)"""


def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", canonical.source_path(F.lit("chrome"), F.col("url")).alias("source_path"))


def canonical_sites(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).select("o_orderkey", "source", canonical.source_path(F.col("source"), F.col("url")).alias("source_path"))


def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).select("o_orderkey", canonical.cache_key(F.col("url"), F.lit(0)).alias("cache_key"))


def site_extractor(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).select("o_orderkey", canonical.site_extractor(F.col("url")).alias("extractor"))


def synth_url(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    method = F.when(F.col("doc_id") % 2 == 0, "ocr").otherwise("accessibility")
    bundle = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("com.app."), F.col("source")))
    title = F.when(F.col("doc_id") % 5 != 0, F.left("text", F.lit(30)))
    url = canonical.payload_url(F.lit(None).cast("string"), method, bundle, F.concat(F.lit("My App "), F.col("lang")), title, F.col("text"))
    return t.select("doc_id", url.alias("url"), canonical.accessibility_url(F.lit("My App"), title).alias("plain_url"))


def ocr_url(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    title = F.concat(_pick(_key(), TITLES), F.when(_key() % 3 == 0, F.concat(F.lit(" #"), _key().cast("string"))).otherwise(""))
    return t.select("o_orderkey", canonical.ocr_url(F.lit("chrome"), title).alias("url"), canonical.clean_window_title(title).alias("title"))


def source_type(spark: SparkSession, d: str) -> DataFrame:
    bundle = F.when(_key() % 7 != 0, _pick(_key(), BUNDLES))
    return table(spark, d, "orders").select(
        "o_orderkey",
        canonical.source_type(bundle, F.lit("My Own App")).alias("source_type"),
        canonical.ocr_source(bundle, _pick(_key(), TITLES)).alias("ocr_source"),
        canonical.app_source(_pick(_key(), TITLES)).alias("app_source"),
    )


def extractor_choice(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(canonical.extractor_choice(_pick(_key(), BUNDLES)).alias("extractor"))
    return t.groupBy("extractor").agg(F.count("*").alias("n"))


def app_block(spark: SparkSession, d: str) -> DataFrame:
    b = _pick(_key(), BUNDLES)
    return table(spark, d, "orders").select(
        "o_orderkey",
        privacy.always_blocked(b).alias("always"),
        privacy.app_blocked(b).alias("blocked"),
        privacy.capture_blocked(b, _pick(_key(), TITLES)).alias("no_capture"),
    )


def display_assign(spark: SparkSession, d: str) -> DataFrame:
    """Windows (line items) to the first display (nations on a grid) that has their centre.

    A machine's displays are a few, and go along as one array: no row of windows
    is moved, and none can match twice.
    """
    x0, y0 = F.col("n_nationkey") % 5 * 1000, (F.floor(F.col("n_nationkey") / 5) * 800).cast("int")
    one = F.struct(F.col("n_nationkey").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 1000).alias("x1"), (y0 + 800).alias("y1"))
    shown = table(spark, d, "nation").agg(F.array_sort(F.collect_list(one)).alias("displays"))
    wins = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") * 7 % 5200 + F.expr("CAST(l_quantity AS INT) div 2")).alias("cx"), (F.col("l_suppkey") * 13 % 4300).alias("cy")
    )
    found = wins.join(F.broadcast(shown))  # one row
    return found.select("l_orderkey", "l_linenumber", "cx", "cy", labels.display_of(F.col("displays"), F.col("cx"), F.col("cy")).alias("display_id"))


def capture_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether to capture, from pending switch, seconds since the last, idle and scroll."""
    pending, since = F.col("event_type") == "click", F.col("value") % 40
    idle, settled = F.col("event_id") % 7, F.col("event_id") % 3
    yes = F.when(pending & (since >= 5), True).when(since >= 30, True).when(since < 5, False).otherwise((idle >= 2) & (settled >= 1))
    interval = F.lit(10) * F.when(F.col("user_id") % 2 == 0, 3).otherwise(1) * F.when(F.col("user_id") % 3 == 0, 2).otherwise(1)
    return table(spark, d, "events").select("event_id", yes.alias("capture"), interval.cast("bigint").alias("interval_s"))


def hamming(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("doc_id") * 2654435761 % 4294967296, F.col("quality") * 255 + F.col("toxic") * 65280
    return table(spark, d, "labels").select("doc_id", F.bit_count(a.bitwiseXOR(b)).alias("distance"), F.lpad(F.lower(F.hex(a)), 16, "0").alias("hash_hex"))


def average_hash(values: Column) -> Column:
    """Bit i is set if value i is over the (integer) mean; least bit first."""
    mean = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x, lambda s: F.floor(s / F.size(values)))
    bits = F.transform(values, lambda x, i: F.when(x > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def gray(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 255))).cast("long"))


def ahash(spark: SparkSession, d: str) -> DataFrame:
    h = average_hash(F.slice(gray(F.col("embedding")), 1, 64))
    return table(spark, d, "embeddings").select("vec_id", F.lpad(F.lower(F.hex(h)), 16, "0").alias("hash_hex"), F.bit_count(h).alias("n_bits"))


def source_config(spark: SparkSession, d: str) -> DataFrame:
    """How the sources of all documents are shown; they are none of the known ones, but for every fifth."""
    source = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" Slack"), F.lit(" "))).otherwise(F.col("source"))
    t = table(spark, d, "documents").select(labels.shown(source).alias("s")).select("s.*")
    return t.groupBy("logo", "colour", "known").agg(F.count("*").alias("n"))


QUERIES = {
    "canonical_url": canonical_url,
    "canonical_sites": canonical_sites,
    "cache_key": cache_key,
    "site_extractor": site_extractor,
    "synth_url": synth_url,
    "ocr_url": ocr_url,
    "source_type": source_type,
    "extractor_choice": extractor_choice,
    "app_block": app_block,
    "display_assign": display_assign,
    "capture_decision": capture_decision,
    "hamming": hamming,
    "ahash": ahash,
    "source_config": source_config,
}


def _cases(subject: str, cases: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({subject}, '{a}') THEN '{b}'" for a, b in cases) + f" ELSE {otherwise} END"


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_TITLE = _pick_sql("o_orderkey", TITLES)
_BUNDLE = _pick_sql("o_orderkey", BUNDLES)
_STRIP = "".join(f"WHEN ends_with(t, '{s}') THEN left(t, length(t) - {len(s)}) " for s in rules.TITLE_SUFFIXES)
_BY_BUNDLE = "CASE b " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.OCR_SOURCES.items()) + " END"
_GLOBS = privacy.glob_regex(rules.ALWAYS_BLOCKED_GLOBS).replace("'", "''")
_OWN = privacy.glob_regex(rules.DEFAULT_BLOCKED_GLOBS).replace("'", "''")

ORACLES = {
    "canonical_url": r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS source_path FROM pages",
    "canonical_sites": rf"""WITH {_BUILT}
SELECT o_orderkey, source, CASE m WHEN 0 THEN 'gdocs://doc_' || k WHEN 1 THEN 'gsheets://sh-' || k WHEN 2 THEN 'gslides://p' || k WHEN 3 THEN 'gemini://conversation/c' || k
  WHEN 4 THEN 'google://search/big%20data%20' || k WHEN 5 THEN 'google-ai://search/wide~x%2A' || k WHEN 6 THEN 'jira://team.atlassian.net:AB-' || k
  WHEN 7 THEN 'jira://team.atlassian.net:CD-' || k WHEN 8 THEN 'slack://acme.slack.com:/archives/C' || k WHEN 9 THEN 'teams://teams.microsoft.com:/l/channel/' || k
  WHEN 10 THEN 'https://shop.example.com/' ELSE url END AS source_path FROM b""",
    "cache_key": rf"""WITH {_BUILT}
SELECT o_orderkey, CASE m WHEN 0 THEN 'gdocs:doc_' || k WHEN 1 THEN 'gsheets:sh-' || k || ':' || k WHEN 2 THEN 'gslides:p' || k WHEN 3 THEN 'gemini:c' || k
  WHEN 4 THEN 'google-search:big data ' || k WHEN 5 THEN 'google-ai:wide~x*' || k ELSE url END AS cache_key FROM b""",
    "site_extractor": rf"""WITH {_BUILT}
SELECT o_orderkey, ['gdocs', 'gsheets', 'gslides', 'gemini', 'google-search', 'google-ai', 'jira', 'jira', 'slack', 'generic', 'generic', 'generic'][m + 1] AS extractor FROM b""",
    "synth_url": r"""
WITH t AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN left(text, 30) ELSE 'untitled' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'accessibility' END AS method,
  CASE WHEN doc_id % 3 <> 0 THEN 'com_app_' || replace(source, '.', '_') ELSE 'My_App_' || lang END AS app FROM documents)
SELECT doc_id, method || '://' || app || '/' || url_encode(title) || CASE WHEN method = 'ocr' THEN '/' || left(sha256(text), 12) ELSE '' END AS url,
       'accessibility://My_App/' || title AS plain_url FROM t""",
    "ocr_url": rf"""
WITH a AS (SELECT o_orderkey, {_TITLE} || CASE WHEN o_orderkey % 3 = 0 THEN ' #' || o_orderkey ELSE '' END AS t FROM orders),
b AS (SELECT o_orderkey, trim(CASE {_STRIP} ELSE t END) AS t FROM a)
SELECT o_orderkey, 'ocr://chrome/' || left(trim(replace(regexp_replace(translate(lower(t), ' /\:.', '-----'), '[,''"]', '', 'g'), '--', '-'), '-'), 80) AS url, t AS title FROM b""",
    "source_type": f"""
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN {_BUNDLE} END AS b, {_TITLE} AS t FROM orders)
SELECT o_orderkey, {_cases('lower(b)', rules.SOURCE_TYPES, "'my_own_app'")} AS source_type,
       coalesce({_BY_BUNDLE}, {_cases('lower(t)', rules.OCR_TITLE_SOURCES, "'ocr-capture'")}) AS ocr_source,
       {_cases('lower(t)', [(w, w) for w in rules.APP_WORDS], "'unknown'")} AS app_source FROM a""",
    "extractor_choice": f"""
SELECT extractor, count(*) AS n FROM (SELECT CASE WHEN b IN ({_list(rules.BROWSER_BUNDLES)}) THEN 'chrome' WHEN b IN ({_list(rules.ACCESSIBLE_BUNDLES)}) THEN 'accessibility' ELSE 'ocr' END AS extractor
  FROM (SELECT {_BUNDLE} AS b FROM orders)) GROUP BY extractor""",
    "app_block": f"""
WITH a AS (SELECT o_orderkey, {_BUNDLE} AS b, {_TITLE} AS t FROM orders),
c AS (SELECT *, b IN ({_list(rules.ALWAYS_BLOCKED)}) OR regexp_matches(b, '{_GLOBS}') OR len(list_filter([{_list(rules.ALWAYS_BLOCKED_LOWER)}], lambda p: contains(lower(b), p))) > 0 AS always FROM a)
SELECT o_orderkey, always, always OR regexp_matches(b, '{_OWN}') AS blocked,
       b IN ({_list(rules.CAPTURE_BLOCKED)}) OR len(list_filter([{_list(rules.CAPTURE_BLOCKED_TITLES + rules.CAPTURE_BLOCKED_URLS)}], lambda p: contains(lower(t), p))) > 0 AS no_capture FROM c""",
    "display_assign": """
WITH s AS (SELECT n_nationkey AS display_id, n_nationkey % 5 * 1000 AS x0, n_nationkey // 5 * 800 AS y0 FROM nation),
w AS (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, l_partkey * 7 % 5200 + floor(l_quantity)::INTEGER // 2 AS cx, l_suppkey * 13 % 4300 AS cy FROM lineitem)
SELECT l_orderkey, l_linenumber, cx, cy, coalesce(min(display_id), 0) AS display_id
FROM w LEFT JOIN s ON cx >= x0 AND cx < x0 + 1000 AND cy >= y0 AND cy < y0 + 800 GROUP BY r, l_orderkey, l_linenumber, cx, cy""",
    "capture_decision": """
SELECT event_id, CASE WHEN event_type = 'click' AND value % 40 >= 5 THEN true WHEN value % 40 >= 30 THEN true WHEN value % 40 < 5 THEN false ELSE event_id % 7 >= 2 AND event_id % 3 >= 1 END AS capture,
       (10 * CASE WHEN user_id % 2 = 0 THEN 3 ELSE 1 END * CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS interval_s FROM events""",
    "hamming": """
SELECT doc_id, bit_count(xor(doc_id * 2654435761 % 4294967296, (quality * 255 + toxic * 65280)::BIGINT))::INTEGER AS distance,
       lpad(lower(to_hex(doc_id * 2654435761 % 4294967296)), 16, '0') AS hash_hex FROM labels""",
    "ahash": """
WITH g AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: greatest(0, least(255, floor((x::DOUBLE + 0.5) * 255)))::BIGINT) AS g FROM embeddings),
m AS (SELECT vec_id, g, floor(list_sum(g) / len(g)) AS mean FROM g),
b AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN g[i + 1] > mean THEN 1 ELSE 0 END) AS b FROM m)
SELECT vec_id, array_to_string(list_transform(range(15, -1, -1), lambda q: '0123456789abcdef'[(b[4 * q + 1] + 2 * b[4 * q + 2] + 4 * b[4 * q + 3] + 8 * b[4 * q + 4] + 1)::INTEGER]), '') AS hash_hex,
       list_sum(b)::INTEGER AS n_bits FROM b""",
    "source_config": """
WITH d AS (SELECT doc_id % 5 = 0 AS k FROM documents)
SELECT CASE WHEN k THEN 'slack' ELSE 'document' END AS logo, CASE WHEN k THEN '#4A154B' ELSE '#6B7280' END AS colour, k AS known, count(*) AS n FROM d GROUP BY k""",
}
