"""Canonical paths, cache keys, source types and synthesised URLs (Column -> Column)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def first_case(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), reversed(cases), otherwise)


def percent_encode(text: Column) -> Column:
    """RFC 3986 unreserved characters stay, a space is %20, the rest upper hex."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def query_value(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded as a form value; null without one."""
    return F.try_url_decode(found(url, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)"))


def host(url: Column) -> Column:
    return F.lower(found(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def path(url: Column) -> Column:
    return F.coalesce(found(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"), F.lit("/"))


def plain_url(url: Column) -> Column:
    """Without query and fragment; scheme and host in lower case, default port
    dropped, an empty path as a slash. What is no URL stays as it is."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
    scheme = F.lower(F.regexp_extract(url, parts, 1))
    rest = F.lower(F.regexp_extract(url, parts, 2))
    web = scheme.isin("http", "https")
    rest = F.when(scheme == "http", F.regexp_replace(rest, ":80$", "")).when(scheme == "https", F.regexp_replace(rest, ":443$", "")).otherwise(rest)
    tail = F.regexp_extract(url, parts, 3)
    return F.when(url.rlike(parts), F.concat(scheme, F.lit("://"), rest, F.when(web & (tail == ""), "/").otherwise(tail))).otherwise(url)


def source_path(source: Column, url: Column) -> Column:
    """The path under which a payload is stored, by source."""
    doc = lambda kind: F.concat(source, F.lit("://"), found(url, rf"/{kind}/d/([A-Za-z0-9_-]+)"))
    search = lambda prefix: F.concat(F.lit(f"{prefix}://search/"), percent_encode(F.trim(F.lower(query_value(url, "q")))))
    issue = F.coalesce(query_value(url, "selectedIssue"), found(path(url), r"/browse/([A-Z][A-Z0-9]+-\d+)"))
    chat = lambda name, where: F.when(path(url).rlike(where), F.concat(F.lit(f"{name}://"), host(url), F.lit(":"), path(url)))
    own = first_case(
        [
            (source == "gdocs", doc("document")),
            (source == "gsheets", doc("spreadsheets")),
            (source == "gslides", doc("presentation")),
            (source == "gemini", F.when(url.startswith("gemini://"), url).otherwise(F.concat(F.lit("gemini://conversation/"), found(url, r"/(?:app|c)/([A-Za-z0-9_-]+)")))),
            (source == "google-ai", F.when(url.startswith("google-ai://"), url).otherwise(search("google-ai"))),
            (source == "google-search", F.when(url.startswith("google://"), url).otherwise(search("google"))),
            (source == "jira", F.concat(F.lit("jira://"), host(url), F.lit(":"), issue)),
            (source == "slack", chat("slack", "/archives/")),
            (source == "teams", F.when(url.startswith("accessibility://"), url).otherwise(chat("teams", "/conversations/|/channel/"))),
        ],
        plain_url(url),
    )
    return F.coalesce(own, url)


def cache_key(url: Column, now: Column) -> Column:
    """The key under which a tab's URL is rate limited."""
    gid = F.coalesce(found(url, r"gid=(\d+)"), F.lit("0"))
    query = query_value(url, "q")
    prefix = F.when(query_value(url, "udm") == "50", "google-ai:").otherwise("google-search:")
    key = first_case(
        [
            (url.contains("docs.google.com/spreadsheets"), F.concat(F.lit("gsheets:"), found(url, r"/spreadsheets/d/([a-zA-Z0-9_-]+)"), F.lit(":"), gid)),
            (url.contains("docs.google.com/document"), F.concat(F.lit("gdocs:"), found(url, r"/document/d/([a-zA-Z0-9_-]+)"))),
            (url.contains("docs.google.com/presentation"), F.concat(F.lit("gslides:"), found(url, r"/presentation/d/([a-zA-Z0-9_-]+)"))),
            (
                url.contains("gemini.google.com"),
                F.coalesce(F.concat(F.lit("gemini:"), found(url, r"/(?:app|c)/([a-zA-Z0-9_-]+)")), F.concat(F.lit("gemini:new:"), now.cast("string"))),
            ),
            (url.contains("google.com/search") & (query != ""), F.concat(prefix, F.trim(F.lower(query)))),
        ],
        url,
    )
    return F.coalesce(key, url)


def site_extractor(url: Column) -> Column:
    """Which text extractor a page is for."""
    h, p = host(url), path(url)
    has = h.contains
    return first_case(
        [
            (has("slack.com"), F.lit("slack")),
            (has("mail.google.com"), F.lit("gmail")),
            (has("outlook.live.com") | has("outlook.office.com"), F.lit("outlook")),
            (has("atlassian.net") | has("jira"), F.lit("jira")),
            (has("docs.google.com") & p.contains("/spreadsheets/"), F.lit("gsheets")),
            (has("docs.google.com") & p.contains("/presentation/"), F.lit("gslides")),
            (has("docs.google.com"), F.lit("gdocs")),
            (has("gemini.google.com"), F.lit("gemini")),
            (has("google.com") & p.startswith("/search") & ((query_value(url, "udm") == "50") | query_value(url, "ai").isNotNull()), F.lit("google-ai")),
            (has("google.com") & p.startswith("/search"), F.lit("google-search")),
            (has("discord.com"), F.lit("discord")),
        ],
        F.lit("generic"),
    )


def source_type(bundle: Column, app: Column) -> Column:
    lower = F.lower(bundle)
    return first_case([(lower.contains(part), F.lit(name)) for part, name in rules.SOURCE_TYPES], F.replace(F.lower(app), F.lit(" "), F.lit("_")))


def payload_url(url: Column, method: Column, bundle: Column, app: Column, title: Column, content: Column) -> Column:
    """The given URL, else one made of method, application and title; for
    recognised text with a short hash of the content."""
    name = F.coalesce(F.replace(bundle, F.lit("."), F.lit("_")), F.replace(app, F.lit(" "), F.lit("_")))
    base = F.concat(method, F.lit("://"), name, F.lit("/"), percent_encode(F.coalesce(title, F.lit("untitled"))))
    return F.coalesce(url, F.when(method == "ocr", F.concat(base, F.lit("/"), short_hash(content))).otherwise(base))


def accessibility_url(app: Column, title: Column) -> Column:
    return F.concat(F.lit("accessibility://"), F.replace(app, F.lit(" "), F.lit("_")), F.lit("/"), F.coalesce(title, F.lit("untitled")))


def extractor_choice(bundle: Column) -> Column:
    return F.when(bundle.isin(rules.BROWSER_BUNDLES), "chrome").when(bundle.isin(rules.ACCESSIBLE_BUNDLES), "accessibility").otherwise("ocr")


def clean_window_title(title: Column) -> Column:
    """Without browser suffixes, each taken off once, in order."""
    out = title
    for suffix in rules.TITLE_SUFFIXES:
        out = F.regexp_replace(out, re.escape(suffix) + r"\z", "")
    return F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")


def ocr_url(source: Column, title: Column) -> Column:
    """A stable URL of a window's text; double dashes are halved in one pass."""
    t = F.lower(clean_window_title(F.coalesce(title, F.lit("unknown"))))
    t = F.replace(F.translate(t, " /\\:.,'\"", "-----"), F.lit("--"), F.lit("-"))
    return F.concat(F.lit("ocr://"), source, F.lit("/"), F.left(F.btrim(t, F.lit("-")), F.lit(80)))


def ocr_source(bundle: Column, title: Column) -> Column:
    by_bundle = F.create_map(*[F.lit(x) for pair in rules.OCR_SOURCES.items() for x in pair])[bundle]
    lower = F.lower(title)
    by_title = first_case([(lower.contains(part), F.lit(name)) for part, name in rules.OCR_TITLE_SOURCES], F.lit(rules.OCR_SOURCE_ELSE))
    return F.coalesce(by_bundle, by_title)


def app_source(title: Column) -> Column:
    lower = F.lower(title)
    return first_case([(lower.contains(w), F.lit(w)) for w in rules.APP_WORDS], F.lit("unknown"))
