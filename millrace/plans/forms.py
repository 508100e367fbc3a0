"""Queries on texts made of the parts of pages, mails, issues, sheets and chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat, formats, labels, markup
from ..operators import talk
from ..session import spread, table
from .capture import _BUILT, _built, _pick_sql


def chat_lines(spark: SparkSession, d: str) -> DataFrame:
    """A channel's messages as lines; every third has no author, blank ones go."""
    c = table(spark, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 3600)
    m = F.struct("turn", F.when(F.col("turn") % 3 != 2, F.col("role")).alias("author"), at.alias("time"), F.when(F.col("turn") % 4 != 3, F.col("text")).otherwise(" ").alias("text"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return g.select("conv_id", F.sha2(formats.chat(F.col("m")), 256).alias("text_hash"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines in turn, one a number."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").cast("string").alias("part"), F.min("l_suppkey").cast("string").alias("supp"), F.min("l_returnflag").alias("flag")
    )


def mail_lists(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("l_linenumber", F.concat(F.lit("s"), F.col("supp")).alias("sender"), F.concat(F.lit("part "), F.col("part")).alias("subject"), F.col("flag").alias("snippet"), F.lit("May 1").alias("date"))
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return g.select("l_orderkey", formats.mail_list(F.col("m")).alias("dated"), F.sha2(formats.mail_list(F.col("m"), dated=False), 256).alias("plain_hash"))


def mails(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    subject, sender = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    return o.select("o_orderkey", formats.mail(subject, sender, F.lit("Body"), F.lit("Monday")).alias("dated"), formats.mail(subject, sender, F.lit("Body")).alias("plain"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    """Orders as issues with their lines as comments."""
    c = F.struct("l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("supp")).alias("author"), F.lit("today").alias("created"), F.col("part").alias("body"))
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(c)).alias("comments"))
    k = F.col("l_orderkey")
    i = F.struct(
        F.concat(F.lit("AB-"), k.cast("string")).alias("key"), F.lit("Sum").alias("summary"), F.lit("Open").alias("status"), F.when(k % 2 == 0, "High").alias("priority"),
        F.lit("").alias("type"), F.lit("Me").alias("assignee"), F.lit(None).cast("string").alias("reporter"), F.lit("P").alias("project"),
        F.when(k % 3 == 0, "Text").alias("description"), F.when(k % 5 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("labels"), F.col("comments"),
    )
    return g.select("l_orderkey", i.alias("i")).select("l_orderkey", formats.issue(F.col("i")).alias("content"))


def issue_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = formats.issue_page(
        F.when(k % 7 != 0, F.concat(F.lit("AB-"), k.cast("string"))), F.when(k % 14 != 0, "Sum"), F.when(k % 2 == 1, " Open "), F.when(k % 3 == 1, "Assignee Ann").otherwise("Assignee Unassigned"), F.when(k % 5 == 1, "Text")
    )
    return table(spark, d, "orders").select("o_orderkey", c.alias("content"))


def boards(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("l_linenumber", F.when(F.col("l_linenumber") != 2, F.concat(F.lit(" K-"), F.col("part"))).alias("key"), F.when(F.col("flag") != "R", F.col("supp")).alias("summary"))
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return g.select("l_orderkey", formats.board(F.col("c")).alias("content"))


def rich_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nested rich text in JSON, and their text again."""
    node = lambda t: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"))
    body = F.array(node(F.col("text")), node(F.lit(" and ")), node(F.left("text", F.lit(3))))
    raw = F.when(F.col("doc_id") % 9 == 0, "plain").otherwise(F.to_json(F.struct(F.lit("doc").alias("type"), body.alias("content"))))
    t = table(spark, d, "documents").select("doc_id", raw.alias("raw")).select("doc_id", formats.adf(F.col("raw")).alias("t"))
    return t.select("doc_id", F.sha2("t", 256).alias("text_hash"))


def one_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(formats.without_visual_breaks(F.col("text")), 256).alias("text_hash"))


def sheets(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as cells of a sheet, out of order."""
    cells = _lines(spark, d).select("l_orderkey", F.explode(F.array(*[F.struct((F.col("l_linenumber") * 3).alias("row"), F.lit(i).alias("col"), F.col(c).alias("text")) for i, c in ((2, "flag"), (10, "supp"), (0, "part"))])).alias("c"))
    return cells.groupBy("l_orderkey").agg(F.collect_list("c").alias("c")).select("l_orderkey", formats.grid(F.col("c")).alias("content"))


def decks(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("l_linenumber", F.when(F.col("flag") != "N", F.col("part")).otherwise(" ").alias("t"), F.when(F.col("flag") == "N", F.col("supp")).otherwise("").alias("n"))
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("s"))
    return g.select("l_orderkey", formats.slides(F.transform("s", lambda x: x["t"]), F.transform("s", lambda x: x["n"])).alias("content"))


def searches(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("l_linenumber", F.col("part").alias("title"), F.when(F.col("flag") != "R", F.col("flag")).alias("snippet"), F.when(F.col("flag") == "A", F.col("supp")).alias("link"))
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("r"))
    overview = F.when(F.col("l_orderkey") % 2 == 0, F.repeat(F.lit("wide "), 30)).otherwise("short")
    return g.select("l_orderkey", formats.search_results(overview, F.col("r")).alias("content"))


def ai_turns(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return g.select("conv_id", F.sha2(formats.ai_turns(F.col("t")), 256).alias("text_hash"))


def url_ids(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _built(spark, d).select("o_orderkey", formats.issue_key(u).alias("issue"), formats.conversation_id(u).alias("talk"), formats.office_ids(u).alias("i"), formats.wanted_tab(u).alias("wanted")).select(
        "o_orderkey", "issue", "talk", "i.*", "wanted"
    )


def talk_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Names of talks that have no id, from their first user's words."""
    c = table(spark, d, "conversations").where("turn = 0")
    return c.select("conv_id", formats.fingerprint(F.concat(F.lit("[User]\n"), F.left("text", F.lit(40))), F.lit(1)).alias("fingerprint"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    url = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "file://localhost").otherwise("file://"), F.lit("/a%20b+c/slide"), k, F.lit(".xml"))
    path = formats.file_path(url)
    return table(spark, d, "orders").select("o_orderkey", path.alias("path"), formats.natural_number(path).alias("number"))


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of an order, without those around or within one before."""
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "supp"))).alias("s"))
    return g.select("l_orderkey", F.array_join(formats.distinct_pieces(F.transform("s", lambda x: x["supp"])), "|").alias("pieces"))


def recognised_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Text and mean confidence of an order's blocks; a region of it in pixels."""
    one = F.struct("l_linenumber", F.col("part").alias("text"), (F.col("l_linenumber") / 8).alias("confidence"))
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("b"))
    rect = labels.pixel_rect(F.struct(F.lit(0.25).alias("x"), F.lit(0.5).alias("y"), F.lit(0.125).alias("w"), F.lit(0.75).alias("h")), F.size("b") * 100, F.lit(80))
    return g.select("l_orderkey", labels.recognised_text(F.col("b")).alias("text"), F.round(formats.mean_confidence(F.col("b")), 9).alias("confidence"), rect["x"].alias("x"), rect["h"].alias("h"))


def difference_hash(spark: SparkSession, d: str) -> DataFrame:
    """Of a vector as 8 rows of 9 values (its values from the start again)."""
    rows = F.slice(F.concat("embedding", "embedding"), 1, 72)
    h = formats.difference_hash(rows)
    return table(spark, d, "embeddings").select("vec_id", F.lpad(F.lower(F.hex(h)), 16, "0").alias("hash_hex"))


def chat_titles(spark: SparkSession, d: str) -> DataFrame:
    """Messages from the titles of elements, as two applications write them."""
    body = F.translate("text", ":", " ")
    title = F.concat(F.col("role"), F.lit(": "), body, F.lit(" 10:59 AM"))
    c = table(spark, d, "conversations").select("conv_id", "turn", chat.message(title).alias("s"), chat.teams_message(title).alias("t"))
    return c.select("conv_id", "turn", chat.rendered(F.col("s")).alias("slack"), chat.rendered(F.col("t")).alias("teams"))


def teams_windows(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as the elements of chat windows, and the messages again."""
    c = table(spark, d, "conversations")
    said = F.btrim(F.translate("text", "\n", " "))
    minute = F.lpad((F.col("turn") % 60).cast("string"), 2, "0")
    e = lambda role, t: F.struct(F.lit(role).alias("role"), t.alias("text"))
    parts = [
        e("AXHeading", F.concat(F.left("text", F.lit(10)), F.lit(" by "), F.col("role"))), e("AXStaticText", F.col("role")), e("AXStaticText", F.concat(F.lit("10:"), minute, F.lit(" AM"))),
        e("AXButton", F.lit("More message options")), e("AXStaticText", said), e("AXLink", F.concat(F.lit("Link "), F.left(said, F.lit(20)))), e("AXStaticText", F.lit("Reply")),
    ]
    end = [e("AXHeading", F.lit("Somebody joined the chat")), e("AXHeading", F.concat(F.lit("Meeting ended at "), F.col("turn").cast("string"), F.lit(" PM after 5 minutes")))]
    every = F.when(F.col("turn") % 3 == 2, F.array(*parts, *end)).otherwise(F.array(*parts))
    rows = c.select("conv_id", "turn", F.posexplode(every).alias("i", "e")).select("conv_id", (F.col("turn") * 100 + F.col("i")).alias("ord"), "e.role", "e.text")
    return talk.teams_messages(rows, "conv_id", "ord")


def chat_containers(spark: SparkSession, d: str) -> DataFrame:
    """Messages from rows of elements: a button, a link and texts."""
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("cell"), "conv_id", "turn", "role", F.translate("text", "\n", " ").alias("t"))
    n = lambda role, title, description, value: F.struct(F.lit(role).alias("role"), title.alias("title"), description.alias("description"), value.alias("value"))
    none = F.lit(None).cast("string")
    nodes = F.array(
        n("AXButton", F.lit("Apps"), none, none), n("AXButton", F.when(F.col("turn") % 5 != 4, F.col("role")), none, none), n("AXLink", none, F.when(F.col("turn") % 2 == 0, "Yesterday at 7"), none),
        n("AXStaticText", none, none, F.col("t")), n("AXStaticText", none, none, F.lit("10:59")), n("AXStaticText", none, none, F.lit(" more ")),
    )
    rows = c.select("cell", F.posexplode(nodes).alias("ord", "n")).select("cell", "ord", F.lit(1).alias("depth"), "n.*")
    return talk.container_messages(rows, "cell", "ord")


def chat_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each message of a room once, numbered as they came first."""
    c = table(spark, d, "conversations").select((F.col("conv_id") % 25).alias("room"), F.col("role").alias("author"), F.lit("Unknown").alias("date"), F.left("text", F.lit(2)).alias("content"), (F.col("conv_id") * 100 + F.col("turn")).alias("at"))
    return talk.numbered(talk.distinct_messages(c, "room", "at"), "room", "at").select("room", "author", "content", "number")


#: Every label, mark, day and month of the fixed lists, and texts that are nearly one.
CHAT_TEXTS = [
    *dict.fromkeys([*chat.UI_LABELS, *chat.TEAMS_LABELS, *chat.TIME_MARKS, *chat.TEAMS_MARKS, *chat.DAYS, *chat.MONTHS]),
    "February 3", "May 3, 24", "Maybe", "9:41", "12:59:59", "1234:5678:9", "1234", "5 p.m.", "Friday night", "Marked", "plain words", "reply", " Home", "March third", "  Monday ", "",
]


def chat_filters(spark: SparkSession, d: str) -> DataFrame:
    """Lines of turns, each line's first three words, and the fixed texts: which of them are
    labels, times or headers of a day."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("n"), F.posexplode(F.split("text", "\n")).alias("line", "whole"))
    fixed = F.get(F.array(*map(F.lit, CHAT_TEXTS)), F.pmod(F.col("n") * 7 + F.col("line"), F.lit(len(CHAT_TEXTS))).cast("int"))
    texts = F.array(F.col("whole"), F.substring_index("whole", " ", 3), fixed, F.concat(fixed, F.lit(" "), F.col("line").cast("string")))
    t = F.col("text")
    return c.select("n", "line", F.posexplode(texts).alias("form", "text")).select(
        "n", "line", "form", chat.is_ui_text(t).alias("slack_label"), chat.is_ui_text(t, chat.TEAMS_LABELS).alias("teams_label"), chat.looks_like_time(t).alias("slack_time"), chat.looks_like_teams_time(t).alias("teams_time"), chat.is_date_header(t).alias("date_header")
    )


def _escaped(text: Column) -> Column:
    """As text of XML: what XML has no form for becomes a blank."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\uFFFE\uFFFF]", " ")
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def word_xml(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the XML of word files, a paragraph a line in runs of a word, and their text again."""
    run = lambda w: F.concat(F.lit('<w:r><w:t xml:space="preserve">'), w, F.lit("</w:t></w:r>"))
    words = lambda line: F.array_join(F.transform(F.split(line, "(?<= )"), run), "")
    paragraphs = F.transform(F.split(_escaped(F.col("text")), "\n"), lambda line: F.concat(F.lit("<w:p>"), words(line), F.lit("</w:p>")))
    xml = F.concat(F.lit('<w:document xmlns:w="urn:w"><w:body>'), F.array_join(paragraphs, ""), F.lit("</w:body></w:document>"))
    t = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", xml.alias("xml"))
    return t.select("doc_id", F.sha2(markup.word_text(F.col("xml")), 256).alias("text_hash"))


def sheet_xml(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as the XML of a sheet with shared strings, out of order, and its grid again."""
    cell = lambda name, kind, value: F.concat(F.lit(f'<c r="{name}'), F.col("l_linenumber").cast("string"), F.lit(f'"{kind}><v>'), value, F.lit("</v></c>"))
    flag = F.when(F.col("flag") == "A", "0").when(F.col("flag") == "N", "1").otherwise("2")
    row = F.concat(F.lit("<row>"), cell("AB", "", F.col("supp")), cell("C", ' t="s"', flag), cell("A", "", F.col("part")), F.lit("</row>"))
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("x"))), asc=False)
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.concat(F.lit("<worksheet><sheetData>"), F.array_join(F.transform(rows, lambda r: r["x"]), ""), F.lit("</sheetData></worksheet>")).alias("xml"))
    strings = markup.shared_strings(F.lit("<sst><si><t>A</t></si><si><t>N</t></si><si><r><t>R</t></r></si></sst>"))
    return g.select("l_orderkey", formats.grid(markup.sheet_cells(F.col("xml"), strings)).alias("content"))


QUERIES = {
    "word_xml": word_xml,
    "sheet_xml": sheet_xml,
    "chat_lines": chat_lines,
    "mail_lists": mail_lists,
    "mails": mails,
    "issues": issues,
    "issue_pages": issue_pages,
    "boards": boards,
    "rich_text": rich_text,
    "one_line": one_line,
    "sheets": sheets,
    "decks": decks,
    "searches": searches,
    "ai_turns": ai_turns,
    "url_ids": url_ids,
    "talk_fingerprints": talk_fingerprints,
    "file_names": file_names,
    "pieces": pieces,
    "recognised_blocks": recognised_blocks,
    "difference_hash": difference_hash,
    "chat_titles": chat_titles,
    "teams_windows": teams_windows,
    "chat_containers": chat_containers,
    "chat_distinct": chat_distinct,
    "chat_filters": chat_filters,
}

_L = "l AS (SELECT l_orderkey, l_linenumber AS n, min(l_partkey)::VARCHAR AS part, min(l_suppkey)::VARCHAR AS supp, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"
_NL = "chr(10)"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

ORACLES = {
    "word_xml": rf"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x{{FFFE}}\x{{FFFF}}]', ' ', 'g'), chr(10)) AS lines FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(lines, lambda t: {_TRIM.format('t')} <> ''), chr(10))) AS text_hash FROM p""",
    "sheet_xml": f"""WITH {_L} SELECT l_orderkey, string_agg(part || chr(9) || flag || chr(9) || supp, {_NL} ORDER BY n) AS content FROM l GROUP BY l_orderkey""",
    "chat_lines": rf"""
WITH m AS (SELECT conv_id, turn, '[' || CASE WHEN turn % 3 <> 2 THEN role ELSE 'unknown' END || ' ' || strftime(make_timestamp((1700000000 + turn * 3600) * 1000000), '%H:%M') || '] ' || {_TRIM.format('text')} AS x
  FROM conversations WHERE turn % 4 <> 3 AND {_TRIM.format('text')} <> '')
SELECT conv_id, sha256(coalesce(string_agg(x, {_NL} ORDER BY turn), '')) AS text_hash FROM m RIGHT JOIN (SELECT DISTINCT conv_id FROM conversations) USING (conv_id) GROUP BY conv_id""",
    "mail_lists": f"""WITH {_L} SELECT l_orderkey, string_agg('[s' || supp || '] part ' || part || ' - ' || flag || ' (May 1)', {_NL} ORDER BY n) AS dated,
  sha256(string_agg('[s' || supp || '] part ' || part || ' - ' || flag, {_NL} ORDER BY n)) AS plain_hash FROM l GROUP BY l_orderkey""",
    "mails": f"""WITH o AS (SELECT o_orderkey, 'Subject: Order ' || o_orderkey || {_NL} || 'From: ' || CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE 'unknown' END AS h FROM orders)
SELECT o_orderkey, h || {_NL} || 'Date: Monday' || {_NL} || {_NL} || 'Body' AS dated, h || {_NL} || {_NL} || 'Body' AS plain FROM o""",
    "issues": f"""
WITH {_L}, c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC) AS back FROM l),
g AS (SELECT l_orderkey AS k, string_agg('[' || CASE WHEN n % 2 = 0 THEN supp ELSE 'Unknown' END || ' - today]' || {_NL} || part || {_NL}, {_NL} ORDER BY n) FILTER (back <= 3) AS c FROM c GROUP BY ALL)
SELECT k AS l_orderkey, {_TRIM.format(f"'# AB-' || k || ': Sum' || {_NL} || {_NL} || 'Status: Open' || CASE WHEN k % 2 = 0 THEN ' | Priority: High' ELSE '' END || ' | Assignee: Me | Project: P' || {_NL} || {_NL} || CASE WHEN k % 3 = 0 THEN '## Description' || {_NL} || 'Text' || {_NL} || {_NL} ELSE '' END || CASE WHEN k % 5 = 0 THEN 'Labels: x, y' || {_NL} || {_NL} ELSE '' END || '## Recent Comments' || {_NL} || c")} AS content FROM g""",
    "issue_pages": f"""
WITH p AS (SELECT o_orderkey, o_orderkey AS k FROM orders),
t AS (SELECT o_orderkey, k, '# ' || CASE WHEN k % 7 <> 0 THEN 'AB-' || k ELSE 'UNKNOWN' END || ':' || CASE WHEN k % 14 <> 0 THEN ' Sum' ELSE '' END AS h,
  concat_ws(' | ', CASE WHEN k % 2 = 1 THEN 'Status: Open' END, CASE WHEN k % 3 = 1 THEN 'Assignee: Ann' END) AS f, CASE WHEN k % 5 = 1 THEN '## Description' || {_NL} || 'Text' END AS d FROM p)
SELECT o_orderkey, CASE WHEN k % 14 = 0 AND f = '' AND d IS NULL THEN NULL ELSE {_TRIM.format(f"CASE WHEN k % 14 = 0 THEN h || ' ' ELSE h END || {_NL} || {_NL} || CASE WHEN f <> '' THEN f || {_NL} || {_NL} ELSE '' END || coalesce(d, '')")} END AS content FROM t""",
    "boards": f"""WITH {_L} SELECT l_orderkey, string_agg('K-' || part || ': ' || CASE WHEN flag <> 'R' THEN supp ELSE '' END, {_NL} ORDER BY n) FILTER (n <> 2) AS content FROM l GROUP BY l_orderkey""",
    "rich_text": rf"""SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN 'plain' ELSE {_TRIM.format("text || ' and ' || left(text, 3)")} END) AS text_hash FROM documents""",
    "one_line": rf"""SELECT doc_id, sha256({_TRIM.format(r"regexp_replace(text, '\s+', ' ', 'g')")}) AS text_hash FROM documents""",
    "sheets": f"""WITH {_L} SELECT l_orderkey, string_agg(part || chr(9) || flag || chr(9) || supp, {_NL} ORDER BY n) AS content FROM l GROUP BY l_orderkey""",
    "decks": f"""WITH {_L}, s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS i FROM l)
SELECT l_orderkey, coalesce(string_agg('Slide ' || i || ': ' || part, {_NL} ORDER BY n) FILTER (flag <> 'N'), string_agg(supp, {_NL} ORDER BY n) FILTER (flag = 'N'), '') AS content FROM s GROUP BY l_orderkey""",
    "searches": f"""WITH {_L}, s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS i FROM l),
g AS (SELECT l_orderkey, string_agg(i || '. ' || part || {_NL} || '   ' || flag || {_NL} || '   ' || CASE WHEN flag = 'A' THEN supp ELSE '' END, {_NL} || {_NL} ORDER BY n) FILTER (flag <> 'R' AND i <= 10) AS r FROM s GROUP BY l_orderkey)
SELECT l_orderkey, concat_ws({_NL} || {_NL}, CASE WHEN l_orderkey % 2 = 0 THEN '## AI Overview' || {_NL} || trim(repeat('wide ', 30)) END, '## Search Results' || {_NL} || r) AS content FROM g""",
    "ai_turns": f"""SELECT conv_id, sha256(string_agg('[' || CASE WHEN role = 'user' THEN 'User' ELSE 'AI' END || ']' || {_NL} || {_TRIM.format('text')}, {_NL} || {_NL} ORDER BY turn) FILTER ({_TRIM.format('text')} <> '')) AS text_hash
FROM conversations GROUP BY conv_id""",
    "url_ids": rf"""WITH {_BUILT}
SELECT o_orderkey, CASE m WHEN 1 THEN 'sh-' || k WHEN 6 THEN 'AB-' || k WHEN 7 THEN 'CD-' || k END AS issue, CASE m WHEN 3 THEN 'c' || k END AS talk, CASE m WHEN 0 THEN 'doc_' || k END AS doc, CASE m WHEN 1 THEN 'sh-' || k END AS sheet,
  CASE m WHEN 1 THEN k END AS gid, CASE m WHEN 2 THEN 'p' || k END AS deck, m < 10 AS wanted FROM b""",
    "talk_fingerprints": rf"""
WITH t AS (SELECT conv_id, lower({_TRIM.format("regexp_extract(left(text, 40), '^\\s*(.*)', 1)")}) AS s FROM conversations WHERE turn = 0),
h AS (SELECT conv_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM t),
v AS (SELECT conv_id, CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END AS v FROM h)
SELECT conv_id, lower(coalesce(nullif(ltrim(array_to_string(list_transform(range(6, -1, -1), lambda i: '0123456789abcdefghijklmnopqrstuvwxyz'[((v // (36 ** i)::BIGINT) % 36)::INTEGER + 1]), ''), '0'), ''), '0')) AS fingerprint FROM v""",
    "file_names": "SELECT o_orderkey, '/a b+c/slide' || o_orderkey || '.xml' AS path, o_orderkey::INTEGER AS number FROM orders",
    "pieces": f"""
WITH RECURSIVE {_L}, s AS (SELECT l_orderkey, supp, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS i, count(*) OVER (PARTITION BY l_orderkey) AS c FROM l),
r AS (SELECT l_orderkey, i, c, [supp] AS k FROM s WHERE i = 1
  UNION ALL SELECT s.l_orderkey, s.i, s.c, CASE WHEN len(list_filter(r.k, lambda x: contains(x, s.supp) OR contains(s.supp, x))) > 0 THEN r.k ELSE list_append(r.k, s.supp) END FROM r JOIN s ON s.l_orderkey = r.l_orderkey AND s.i = r.i + 1)
SELECT l_orderkey, array_to_string(k, '|') AS pieces FROM r WHERE i = c""",
    "recognised_blocks": f"""WITH {_L} SELECT l_orderkey, string_agg(part, {_NL} ORDER BY n) AS text, round(avg(n / 8), 9) AS confidence, count(*) * 100 * 0.25::DOUBLE AS x, 60.0::DOUBLE AS h FROM l GROUP BY l_orderkey""",
    "difference_hash": """
WITH v AS (SELECT vec_id, list_concat(embedding, embedding)[1:72] AS v FROM embeddings),
b AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN v[(i // 8) * 9 + i % 8 + 1] > v[(i // 8) * 9 + i % 8 + 2] THEN 1 ELSE 0 END) AS b FROM v)
SELECT vec_id, array_to_string(list_transform(range(15, -1, -1), lambda q: '0123456789abcdef'[(b[4 * q + 1] + 2 * b[4 * q + 2] + 4 * b[4 * q + 3] + 8 * b[4 * q + 4] + 1)::INTEGER]), '') AS hash_hex FROM b""",
    "chat_titles": r"""
WITH b AS (SELECT conv_id, turn, role, translate(text, ':', ' ') AS b FROM conversations),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(b, '[.\s]+$', ''), '^\s+', ''), '\s+', ' ', 'g') AS s, regexp_replace(regexp_replace(regexp_replace(b, '[,.\s]+$', ''), '^\s+', ''), '\s+', ' ', 'g') AS t FROM b)
SELECT conv_id, turn, CASE WHEN strlen(s) >= 3 THEN '[' || role || '] [10:59 AM] ' || s END AS slack, CASE WHEN strlen(t) >= 3 THEN '[' || role || '] [10:59 AM] ' || t END AS teams FROM c""",
    "teams_windows": r"""
WITH s AS (SELECT conv_id, turn, role, trim(translate(text, chr(10), ' ')) AS said FROM conversations),
m AS (SELECT conv_id, turn * 2 AS o, role AS author, '10:' || lpad((turn % 60)::VARCHAR, 2, '0') || ' AM' AS date, said AS content FROM s WHERE strlen(said) > 2 AND NOT ends_with(said, '...')
  UNION ALL SELECT conv_id, turn * 2 + 1, 'System', turn || ' PM', 'Meeting ended (duration: 5 minutes)' FROM s WHERE turn % 3 = 2)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1)::INTEGER AS number, author, date, content FROM m""",
    "chat_containers": r"""
WITH c AS (SELECT conv_id || '-' || turn AS cell, turn, role, regexp_replace(translate(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE turn % 5 <> 4)
SELECT cell, role AS author, CASE WHEN turn % 2 = 0 THEN 'Yesterday at 7' ELSE 'Unknown' END AS date, CASE WHEN strlen(t) > 2 THEN t || ' more' ELSE 'more' END AS content FROM c""",
    "chat_distinct": """
WITH m AS (SELECT conv_id % 25 AS room, role AS author, left(text, 2) AS content, min(conv_id * 100 + turn) AS a FROM conversations GROUP BY ALL)
SELECT room, author, content, row_number() OVER (PARTITION BY room ORDER BY a)::INTEGER AS number FROM m""",
    "chat_filters": rf"""
WITH l AS (SELECT conv_id * 100 + turn AS n, unnest(string_split(text, chr(10))) AS whole, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations),
f AS (SELECT *, {_pick_sql('(n * 7 + line)', CHAT_TEXTS)} AS fixed FROM l),
x AS (SELECT n, line, unnest([0, 1, 2, 3]) AS form, unnest([whole, array_to_string(string_split(whole, ' ')[1:3], ' '), fixed, fixed || ' ' || line]) AS t FROM f),
y AS (SELECT *, {_TRIM.format('t')} AS s, length(t) <= 8 AND contains(t, ':') AND translate(t, '0123456789: ', '') = '' AS clock,
  len(list_filter({chat.TIME_MARKS}, lambda m: contains(t, m))) > 0 AS marked FROM x)
SELECT n, line::INTEGER AS line, form::INTEGER AS form, t IN {tuple(chat.UI_LABELS)} OR clock AS slack_label, t IN {tuple(chat.TEAMS_LABELS)} OR clock AS teams_label, marked AS slack_time,
  marked OR contains(s, 'a.m.') OR contains(s, 'p.m.') OR len(list_filter({chat.DAYS}, lambda d: starts_with(s, d))) > 0 AS teams_time,
  s IN {tuple([*chat.DAYS, 'Today', 'Yesterday'])} OR len(list_filter({chat.MONTHS}, lambda m: starts_with(s, m) AND {_TRIM.format('translate(substr(s, length(m) + 1), $$0123456789,$$, $$$$)')} = '')) > 0 AS date_header FROM y""",
}
