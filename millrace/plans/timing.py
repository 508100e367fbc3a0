"""Queries on captures in time, windows, applications and what is shown of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, labels, privacy, rules, text
from ..operators import store, toggles
from ..operators.sequential import sequential
from ..session import spread, table
from ..streaming import steps
from .capture import BUNDLES, _key, _pick, _pick_sql
from .chunks import ORACLES as CHUNK_ORACLES


def _events(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, d, "events").select("user_id", "event_id", "event_type", "value", at.alias("at"), "ts")


def url_cache(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are read again, by key: talks every half minute, others every five."""
    url = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("https://gemini.google.com/app/c"), F.col("user_id"))).otherwise(F.concat(F.lit("https://site.example/"), F.col("user_id")))
    e = _events(spark, d).withColumn("key", canonical.cache_key(url, F.lit(0)))
    e = e.withColumn("ttl", labels.cache_ttl(F.col("key")) * 20).select("user_id", "key", "event_id", "at", "ttl")
    return sequential(e, ["key"], ["at", "event_id"], steps.interval_step("ttl"), "accepted boolean").select("key", "event_id", "accepted")


def tab_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Tabs of a browser that were not just processed. The last one is a browser's
    own, so that browsers go side by side."""
    url = F.when(F.col("event_type") == "view", "https://docs.google.com/document/d/1").otherwise(F.concat(F.lit("https://site.example/"), F.col("event_type")))
    e = _events(spark, d).select((F.col("user_id") % 50).alias("browser"), "event_id", "at", (F.col("user_id") % 3).alias("tab"), url.alias("url"))
    e = e.withColumn("wait", labels.tab_wait(F.col("url")) * 600)
    return sequential(e, ["browser"], ["at", "event_id"], steps.tab_step(), "accepted boolean").select("browser", "event_id", "accepted")


def export_rate(spark: SparkSession, d: str) -> DataFrame:
    """When the fetches of a browser may start."""
    e = _events(spark, d).select((F.col("user_id") % 50).alias("browser"), "event_id", "at", (F.col("event_type") == "error").alias("limited"))
    out = sequential(e, ["browser"], ["at", "event_id"], steps.export_step(rules.EXPORT_GAP * 10, rules.EXPORT_PENALTY * 10), "start double, waited double")
    return out.select("browser", "event_id", F.round("waited", 3).alias("waited"))


def app_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Switches away from an application that no other one follows in time."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    after = F.lead("at").over(w) - F.col("at")
    return _events(spark, d).select("user_id", "event_id", F.coalesce(after >= rules.APP_DEBOUNCE * 60, F.lit(True)).alias("fires"))


def capture_backoff(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "at", (F.col("event_type") != "error").alias("ok"))
    return sequential(e, ["user_id"], ["at", "event_id"], steps.backoff_step(rules.CAPTURE_BACKOFF * 120), "tried boolean").select("user_id", "event_id", "tried")


def retry_result(spark: SparkSession, d: str) -> DataFrame:
    """Tries of an order (its lines in turn): the first content or the last error."""
    blank = F.when(F.col("l_linenumber") % 2 == 0, " ")
    content = F.when(F.col("l_quantity") < 20, blank).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    error = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("no part "), F.col("l_partkey").cast("string")))
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    tries = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", content.alias("content"), error.alias("error")))).alias("tries"))
    r = labels.retried(F.transform("tries", lambda t: F.struct(t["content"].alias("content"), t["error"].alias("error"))), 3)
    return tries.select("l_orderkey", r.alias("r")).select("l_orderkey", "r.content", "r.error", F.col("r.used").alias("used"), labels.retry_delay(F.col("r.used")).alias("delay_ms"))


def router_status(spark: SparkSession, d: str) -> DataFrame:
    """Windows, displays and reads in all, with the rate of good ones."""
    e = _events(spark, d)
    per = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("good"))
    a = per.agg(F.count("*").alias("windows"), F.countDistinct(F.col("user_id") % 3).alias("displays"), F.sum("n").alias("reads"), F.sum("good").alias("good"))
    return a.select("windows", "displays", "reads", F.round(labels.success_rate(F.col("good"), F.col("reads")), 9).alias("success_rate"))


def idle_time(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", labels.idle(v, F.col("event_id") % 17 + F.lit(0.5), F.col("user_id") % 5 + F.lit(1.25)).alias("idle_s"))


def window_scan(spark: SparkSession, d: str) -> DataFrame:
    """Normal windows with their display, and which of them are to be read now."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    width, height, layer = F.col("p") * 7 % 900, F.col("s") * 13 % 700, F.when(F.col("l_linenumber") == 3, 25).otherwise(0)
    shown = F.array(*[F.struct(F.lit(i + 1).alias("id"), F.lit(i * 1000).alias("x0"), F.lit(0).alias("y0"), F.lit((i + 1) * 1000).alias("x1"), F.lit(800).alias("y1")) for i in range(3)])
    x, y = F.col("p") * 3 % 3600 + F.floor(width / 2), F.col("s") * 5 % 900 + F.floor(height / 2)
    name = F.concat(F.lit("App "), (F.col("p") % 4).cast("string"))
    bundle = F.coalesce(F.when(F.col("p") % 3 != 0, _pick(F.col("p"), BUNDLES)), name)
    w = t.where(labels.is_window(layer, width, height)).select("l_orderkey", "l_linenumber", labels.display_of(shown, x, y).alias("display_id"), bundle.alias("bundle"), "q", "p")
    since = F.when(F.col("p") % 5 != 0, F.col("q") % 6)
    now = labels.eligible(privacy.app_blocked(F.col("bundle")), canonical.extractor_choice(F.col("bundle")), F.col("p") % 7 != 0, since)
    return w.select("l_orderkey", "l_linenumber", "display_id", "bundle", now.alias("eligible"))


#: Every bundle that a fixed table names, and others; and names that hold each part that is looked for.
APP_BUNDLES = [*dict.fromkeys([*rules.BUNDLE_APPS, *rules.ELECTRON_BUNDLES, *rules.SERVICE_APPS, *BUNDLES, "org.LibreOffice.script", "com.microsoft.word", "com.tinyspeck.slackmacgap2"])]
APP_NAMES = [*[f"My {part.title()} View" for part, _ in rules.APP_BUNDLES], *[part.upper() for part, _ in rules.APP_BUNDLES], "Plain Tool", "Wor d", "Slack Pages", "Numbers in Excel"]


def app_names(spark: SparkSession, d: str) -> DataFrame:
    b, name = _pick(_key(), APP_BUNDLES), F.concat(_pick(_key(), APP_NAMES), F.lit(" "), F.left("o_orderpriority", F.lit(1)))
    return table(spark, d, "orders").select(
        "o_orderkey", labels.app_of_bundle(b).alias("app"), labels.bundle_of_app(name).alias("bundle"), labels.is_electron(b).alias("electron"), labels.service_app(b).alias("service")
    )


#: Every key as it is, in capitals with blanks about it, and as a part of another.
SHOWN_KEYS = [form for k in rules.SHOWN for form in (k, f" {k.upper()}  ", f"{k}s")]


def source_shown(spark: SparkSession, d: str) -> DataFrame:
    s = _pick(_key(), [*SHOWN_KEYS, "unknown one", ""])
    return table(spark, d, "orders").select("o_orderkey", labels.shown(s).alias("s")).select("o_orderkey", "s.*")


def cards(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(_key() % 3 != 0, F.concat(F.lit("Order "), _key().cast("string"))).when(_key() % 2 == 0, "")
    c = labels.card(title, _pick(_key(), ["gdocs", "jira", "x"]), (_key() % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", c.alias("c"), labels.shown_time(F.col("o_orderdate")).alias("shown_time")).select("o_orderkey", "c.*", "shown_time")


def chunk_meta(spark: SparkSession, d: str) -> DataFrame:
    app = F.concat(F.lit("My "), F.col("lang"), F.lit(" Word"))
    meta = labels.chunk_meta(store.doc_uid(F.col("doc_id").cast("string")), F.col("source"), F.col("doc_id") + 1_700_000_000, F.translate("text", '\n"\\', "   "), app, F.when(F.col("doc_id") % 2 == 0, "T"))
    return table(spark, d, "documents").select("doc_id", meta.alias("meta"))


def min_length(spark: SparkSession, d: str) -> DataFrame:
    """Recognised text that is long enough to keep, cut to the most that is stored."""
    t = spread(table(spark, d, "documents").select("doc_id", "text"))
    kept = labels.within_length(text.without_noise(F.col("text")))
    return t.select("doc_id", kept.isNotNull().alias("kept"), F.coalesce(F.length(kept), F.lit(0)).cast("bigint").alias("n_chars"))


def block_rules(spark: SparkSession, d: str) -> DataFrame:
    """Blocked applications after changes at run time; what is always blocked stays so."""
    globs = privacy.blocklist(rules.DEFAULT_BLOCKED_GLOBS, ["md.obsidian", "com.fig*"], ["*bank*", "com.apple.keychainaccess", "dev.kiro.app"])
    return table(spark, d, "orders").select("o_orderkey", privacy.app_blocked(_pick(_key(), BUNDLES), globs).alias("blocked"))


#: What is blocked and unblocked while windows are watched: names and patterns.
TURNED = ["md.obsidian", "com.fig*", "*bank*", "com.apple.keychainaccess", "dev.kiro.app", "com.microsoft.Word", "com.google.*", "us.zoom.xo?"]


def block_toggles(spark: SparkSession, d: str) -> DataFrame:
    """Reads of windows while applications are blocked and unblocked: every fiftieth
    event is such a change, the others are reads of a user's window."""
    e = _events(spark, d)
    is_change = F.col("event_id") % 50 == 0
    n = F.floor(F.col("event_id") / 50)
    changes = e.where(is_change).select("at", F.when(n % 3 == 0, "unblock").otherwise("block").alias("kind"), _pick(n * 5 + F.floor(n / 8), TURNED).alias("pattern"))
    reads = e.where(~is_change).select(F.col("user_id").alias("window"), "event_id", "at")
    seen = reads.groupBy("window").agg(F.min("at").alias("seen_at"))
    windows = seen.select("window", _pick(F.col("window"), BUNDLES).alias("bundle"), "seen_at")
    return toggles.read_blocked(reads, windows, changes, rules.DEFAULT_BLOCKED_GLOBS).select("event_id", "bundle", "blocked")


def focus_changes(spark: SparkSession, d: str) -> DataFrame:
    """Per device the windows that got the focus between hourly snapshots. One
    window has it at a time: the one of the last event of the hour."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("device"), hour.alias("hour"), "user_id", "ts", "event_id")
    front = e.groupBy("device", "hour").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("window"))
    w = Window.partitionBy("device").orderBy("hour")
    return front.withColumn("before", F.lag("window").over(w)).where("NOT (window <=> before)").select("device", "hour", "window", (F.col("window") % 3).alias("display_id"))


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """Paths whose last capture is at most a day before the latest one, and the cap of the cache."""
    e = _events(spark, d)
    last = e.groupBy("user_id").agg(F.max("at").alias("at"))
    newest = e.agg(F.max("at").alias("newest"))
    held = last.join(F.broadcast(newest)).where("newest - at < 86400")  # one row on the right
    return held.agg(F.count("*").alias("entries")).withColumn("cap", F.lit(10_000))


def hash_forms(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("o_orderkey") * 1_000_003
    return table(spark, d, "orders").select("o_orderkey", F.lpad(F.lower(F.hex(h)), 16, "0").alias("hex"), F.lpad(F.bin(h), 64, "0").alias("bits"))


QUERIES = {
    "url_cache": url_cache,
    "tab_debounce": tab_debounce,
    "export_rate": export_rate,
    "app_debounce": app_debounce,
    "capture_backoff": capture_backoff,
    "retry_result": retry_result,
    "router_status": router_status,
    "idle_time": idle_time,
    "window_scan": window_scan,
    "app_names": app_names,
    "source_shown": source_shown,
    "cards": cards,
    "chunk_meta": chunk_meta,
    "min_length": min_length,
    "block_rules": block_rules,
    "block_toggles": block_toggles,
    "focus_changes": focus_changes,
    "cache_stats": cache_stats,
    "hash_forms": hash_forms,
}


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _structs(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"{{'p': '{p}', 'v': '{v}'}}" for p, v in pairs)


def _sequence(select: str, key: str, first: str, step: str, out: str) -> str:
    """Rows of a key one after the other. select: n numbers them; step and first give the state and the results."""
    return f"""WITH RECURSIVE e AS ({select}),
r AS (SELECT {key}, n, {first} FROM e WHERE n = 1
  UNION ALL SELECT e.{key}, e.n, {step} FROM r JOIN e ON e.{key} = r.{key} AND e.n = r.n + 1)
SELECT {out} FROM r JOIN e USING ({key}, n)"""


_AT = "epoch_us(ts) / 1000000.0"
_WIDE = """w AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
v AS (SELECT *, p * 7 % 900 AS width, s * 13 % 700 AS height, p * 3 % 3600 + (p * 7 % 900) // 2 AS x, s * 5 % 900 + (s * 13 % 700) // 2 AS y FROM w)"""
_BUNDLE_P = _pick_sql("p", BUNDLES)

ORACLES = {
    "min_length": f"WITH n AS ({CHUNK_ORACLES['line_noise']}) SELECT doc_id, clean_chars >= 50 AS kept, CASE WHEN clean_chars >= 50 THEN least(clean_chars, 100000) ELSE 0 END AS n_chars FROM n",
    "url_cache": _sequence(
        f"""SELECT key, event_id, {_AT} AS tm, ttl, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM
  (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'gemini:c' ELSE 'https://site.example/' END || user_id AS key, CASE WHEN user_id % 2 = 0 THEN 600 ELSE 6000 END AS ttl FROM events)""",
        "key", "tm AS last, true AS accepted", "CASE WHEN e.tm - r.last >= e.ttl THEN e.tm ELSE r.last END, e.tm - r.last >= e.ttl", "key, event_id, accepted",
    ),
    "tab_debounce": _sequence(
        f"""SELECT user_id % 50 AS browser, event_id, {_AT} AS tm, user_id % 3 AS tab, event_type AS url, CASE WHEN event_type = 'view' THEN 3000 ELSE 600 END AS wait,
  row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events""",
        "browser", "tab AS t, url AS u, tm AS last, true AS accepted",
        """CASE WHEN e.tab = r.t AND e.url = r.u AND e.tm - r.last < e.wait THEN r.t ELSE e.tab END, CASE WHEN e.tab = r.t AND e.url = r.u AND e.tm - r.last < e.wait THEN r.u ELSE e.url END,
    CASE WHEN e.tab = r.t AND e.url = r.u AND e.tm - r.last < e.wait THEN r.last ELSE e.tm END, NOT (e.tab = r.t AND e.url = r.u AND e.tm - r.last < e.wait)""",
        "browser, event_id, accepted",
    ),
    "export_rate": _sequence(
        f"""SELECT user_id % 50 AS browser, event_id, {_AT} AS tm, event_type = 'error' AS limited, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events""",
        "browser", "tm + CASE WHEN limited THEN 300 ELSE 0 END AS last, 0.0::DOUBLE AS wait",
        "greatest(e.tm, r.last + 100) + CASE WHEN e.limited THEN 300 ELSE 0 END, greatest(e.tm, r.last + 100) - e.tm", "browser, event_id, round(wait, 3) AS waited",
    ),
    "app_debounce": f"""SELECT user_id, event_id, coalesce(lead({_AT}) OVER w - {_AT} >= 120, true) AS fires FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "capture_backoff": _sequence(
        f"""SELECT user_id, event_id, {_AT} AS tm, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events""",
        "user_id", "CASE WHEN ok THEN NULL ELSE tm END AS last, true AS tried",
        "CASE WHEN e.tm - r.last < 3600 THEN r.last WHEN e.ok THEN NULL ELSE e.tm END, coalesce(e.tm - r.last >= 3600, true)", "user_id, event_id, tried",
    ),
    "retry_result": """
WITH o AS (SELECT l_orderkey, l_linenumber AS l, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
t AS (SELECT *, CASE WHEN q >= 20 THEN 'part ' || p END AS content, CASE WHEN l % 2 = 1 THEN 'no part ' || p END AS error, row_number() OVER (PARTITION BY l_orderkey ORDER BY l) AS n FROM o QUALIFY n <= 3),
g AS (SELECT l_orderkey, min(n) FILTER (content IS NOT NULL) AS used, max(n) AS tries, arg_min(content, n) FILTER (content IS NOT NULL) AS content, arg_max(coalesce(error, ''), n) AS error FROM t GROUP BY l_orderkey)
SELECT l_orderkey, content, CASE WHEN content IS NULL THEN CASE WHEN error = '' THEN 'Empty content on attempt ' || tries ELSE error END END AS error,
       coalesce(used, tries)::INTEGER AS used, (100 * 2 ** (coalesce(used, tries) - 1))::BIGINT AS delay_ms FROM g""",
    "router_status": """SELECT count(DISTINCT user_id) AS windows, count(DISTINCT user_id % 3) AS displays, count(*) AS reads, round(count(*) FILTER (event_type <> 'error') / count(*), 9) AS success_rate FROM events""",
    "idle_time": "SELECT event_id, least(value, event_id % 17 + 0.5::DOUBLE, user_id % 5 + 1.25::DOUBLE) AS idle_s FROM events",
    "window_scan": f"""WITH {_WIDE},
b AS (SELECT *, CASE WHEN p % 3 <> 0 THEN {_BUNDLE_P} ELSE 'App ' || p % 4 END AS bundle, CASE WHEN x < 3000 AND y < 800 THEN x // 1000 + 1 ELSE 0 END AS display_id
  FROM v WHERE l_linenumber <> 3 AND width >= 100 AND height >= 100)
SELECT l_orderkey, l_linenumber, display_id::INTEGER AS display_id, bundle,
  bundle NOT IN ('dev.kiro.app', 'x.viewer-app.y', 'com.mybank.app', 'com.1password.mac', 'org.DaVinciResolve', 'com.apple.keychainaccess', 'com.bitwarden.desktop', 'com.google.Chrome', 'com.operasoftware.Opera')
  AND p % 7 <> 0 AND (p % 5 = 0 OR q % 6 >= 3) AS eligible FROM b""",
    "app_names": f"""
WITH a AS (SELECT o_orderkey, {_pick_sql('o_orderkey', APP_BUNDLES)} AS b, {_pick_sql('o_orderkey', APP_NAMES)} || ' ' || o_orderpriority[1] AS n FROM orders),
k AS (SELECT unnest([{_structs(rules.APP_BUNDLES)}]) AS k, generate_subscripts([{_structs(rules.APP_BUNDLES)}], 1) AS i),
f AS (SELECT n, arg_min(k.v, i) AS found FROM (SELECT DISTINCT n FROM a) JOIN k ON contains(lower(n), k.p) GROUP BY n)
SELECT o_orderkey, coalesce(map_extract_value({_map(rules.BUNDLE_APPS)}, b), CASE WHEN b ILIKE '%libreoffice%' THEN 'libreoffice' ELSE 'unknown' END) AS app,
  coalesce(found, 'com.unknown.' || lower(replace(n, ' ', ''))) AS bundle, b IN {tuple(rules.ELECTRON_BUNDLES)} AS electron, map_extract_value({_map(rules.SERVICE_APPS)}, b) AS service
FROM a LEFT JOIN f USING (n)""",
    "source_shown": f"""
WITH t AS (SELECT * FROM (VALUES {', '.join(str((k, *v)) for k, v in rules.SHOWN.items())}) t(k, logo, colour, gradient_from, gradient_to)),
s AS (SELECT o_orderkey, lower(trim({_pick_sql('o_orderkey', [*SHOWN_KEYS, 'unknown one', ''])})) AS k FROM orders),
o AS (SELECT * FROM t WHERE k = 'default')
SELECT o_orderkey, coalesce(t.logo, o.logo) AS logo, coalesce(t.colour, o.colour) AS colour, coalesce(t.gradient_from, o.gradient_from) AS gradient_from,
  coalesce(t.gradient_to, o.gradient_to) AS gradient_to, t.k IS NOT NULL AND t.k <> 'default' AS known FROM s LEFT JOIN t ON s.k = t.k, o""",
    "cards": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'Order ' || o_orderkey ELSE 'Untitled' END AS title, ['Gdocs', 'Jira', 'X'][(o_orderkey % 3)::INTEGER + 1] AS type,
  ['0 chunks', '1 chunk', '2 chunks'][(o_orderkey % 3)::INTEGER + 1] AS chunks, strftime(o_orderdate, '%-m/%-d/%Y, %-I:%M:%S %p') AS shown_time FROM orders""",
    "chunk_meta": r"""
WITH d AS (SELECT *, sha256(doc_id::VARCHAR) AS x, left(translate(text, chr(10) || '"\', '   '), 200) AS h FROM documents)
SELECT doc_id, '{"id":"' || concat_ws('-', substr(x, 1, 8), substr(x, 9, 4), substr(x, 13, 4), substr(x, 17, 4), substr(x, 21, 12)) || '","source":"' || source || '","timestamp":' || (doc_id + 1700000000)
  || ',"header":"' || h || '","chunk_idx":0,"total_chunks":1,"app_id":"com.microsoft.Word","url":"accessibility://My_' || lang || '_Word/' || CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE 'untitled' END
  || '","title":"' || CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE 'untitled' END || '"}' AS meta FROM d""",
    "block_rules": f"""SELECT o_orderkey, {_pick_sql('o_orderkey', BUNDLES)} IN ('dev.kiro.app', 'x.viewer-app.y', 'com.1password.mac', 'org.DaVinciResolve', 'com.bitwarden.desktop', 'md.obsidian', 'com.figma.Desktop') AS blocked FROM orders""",
    "block_toggles": f"""
WITH e AS (SELECT user_id AS w, event_id, {_AT} AS tm, event_id // 50 AS n FROM events),
c AS (SELECT tm, CASE WHEN n % 3 = 0 THEN 'unblock' ELSE 'block' END AS kind, {_pick_sql('(n * 5 + n // 8)', TURNED)} AS pattern FROM e WHERE event_id % 50 = 0),
g AS (SELECT pattern, kind, tm AS a, lead(tm) OVER (PARTITION BY pattern ORDER BY tm) AS z FROM (SELECT * FROM c UNION ALL SELECT -1, 'block', unnest({rules.DEFAULT_BLOCKED_GLOBS}))),
s AS (SELECT w, min(tm) AS seen, {_pick_sql('w', BUNDLES)} AS bundle FROM e WHERE event_id % 50 <> 0 GROUP BY w),
i AS (SELECT w, seen, bundle, bundle IN ('dev.kiro.app', 'x.viewer-app.y', 'org.DaVinciResolve') OR EXISTS (FROM g WHERE kind = 'block' AND bundle GLOB pattern AND a <= seen AND seen < coalesce(z, 1e18)) AS blocked FROM s)
SELECT event_id, bundle, coalesce((SELECT arg_max(kind, c.tm) = 'block' FROM c WHERE pattern = bundle AND c.tm > seen AND c.tm <= e.tm), blocked) AS blocked FROM e JOIN i USING (w) WHERE event_id % 50 <> 0""",
    "focus_changes": """
WITH f AS (SELECT user_id % 10 AS device, floor(epoch(ts) / 3600)::BIGINT AS hour, arg_max(user_id, (ts, event_id)) AS w FROM events GROUP BY ALL)
SELECT device, hour, w AS "window", w % 3 AS display_id FROM f QUALIFY w IS DISTINCT FROM lag(w) OVER (PARTITION BY device ORDER BY hour)""",
    "cache_stats": f"""WITH l AS (SELECT user_id, max({_AT}) AS tm FROM events GROUP BY user_id)
SELECT count(*) AS entries, 10000 AS cap FROM l WHERE (SELECT max({_AT}) FROM events) - tm < 86400""",
    "hash_forms": "SELECT o_orderkey, lpad(lower(to_hex(o_orderkey * 1000003)), 16, '0') AS hex, lpad(bin(o_orderkey * 1000003), 64, '0') AS bits FROM orders",
}
