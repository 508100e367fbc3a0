"""What is shown of sources, chunks and windows, and pure rules over their columns (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .canonical import accessibility_url, first_case
from .text import let


def by_map(values: dict[str, str], key: Column, otherwise: str | None = None) -> Column:
    """The value of a key in a fixed table."""
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


# ---------------------------------------------------------------- applications


def app_of_bundle(bundle: Column) -> Column:
    office = F.when(F.lower(bundle).contains("libreoffice"), "libreoffice").otherwise("unknown")
    return F.coalesce(by_map(rules.BUNDLE_APPS, bundle), office)


def bundle_of_app(app: Column) -> Column:
    """A known bundle for an application's name, else one made of the name."""
    lower = F.lower(app)
    made = F.concat(F.lit("com.unknown."), F.lower(F.replace(app, F.lit(" "), F.lit(""))))
    return first_case([(lower.contains(part), F.lit(bundle)) for part, bundle in rules.APP_BUNDLES], made)


def is_electron(bundle: Column) -> Column:
    return F.coalesce(bundle.isin(rules.ELECTRON_BUNDLES), F.lit(False))


def service_app(bundle: Column) -> Column:
    """The application's name if the background service reads it, else null."""
    return by_map(rules.SERVICE_APPS, bundle)


# ---------------------------------------------------------------- cards


def shown(source: Column) -> Column:
    """(logo, colour, gradient from, gradient to, known) of a source; unknown ones have a default."""
    key = F.lower(F.btrim(source))
    known = key.isin([k for k in rules.SHOWN if k != "default"])
    name = F.when(key.isin(list(rules.SHOWN)), key).otherwise("default")
    of = lambda i: by_map({k: v[i] for k, v in rules.SHOWN.items()}, name)
    return F.struct(of(0).alias("logo"), of(1).alias("colour"), of(2).alias("gradient_from"), of(3).alias("gradient_to"), F.coalesce(known, F.lit(False)).alias("known"))


def card(title: Column, source: Column, chunks: Column) -> Column:
    """(title, type, chunks) as a card shows them."""
    kind = F.concat(F.upper(F.left(source, F.lit(1))), F.substring(source, F.lit(2), F.length(source)))
    count = F.concat(chunks.cast("string"), F.lit(" chunk"), F.when(chunks == 1, "").otherwise("s"))
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")).alias("title"), kind.alias("type"), count.alias("chunks"))


def shown_time(at: Column) -> Column:
    return F.date_format(at, "M/d/yyyy, h:mm:ss a")


def header(text: Column) -> Column:
    return F.left(text, F.lit(200))


def chunk_meta(doc_uid: Column, source: Column, at: Column, content: Column, app: Column, title: Column) -> Column:
    """Metadata of an only chunk as JSON; empty fields are left out."""
    return F.to_json(
        F.struct(
            doc_uid.alias("id"),
            source.alias("source"),
            at.alias("timestamp"),
            header(content).alias("header"),
            F.lit(0).alias("chunk_idx"),
            F.lit(1).alias("total_chunks"),
            bundle_of_app(app).alias("app_id"),
            accessibility_url(app, title).alias("url"),
            F.coalesce(title, F.lit("untitled")).alias("title"),
        )
    )


# ---------------------------------------------------------------- recognised text


def recognised_text(blocks: Column) -> Column:
    """Best candidates of all blocks, a line each, from structs with a text."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def within_length(cleaned: Column) -> Column:
    """Cleaned text cut to the most that is stored; null if it is too short to keep."""
    return F.when(F.length(cleaned) >= rules.LEAST_RECOGNISED, F.left(cleaned, F.lit(rules.MOST_RECOGNISED)))


def pixel_rect(region: Column, width: Column, height: Column) -> Column:
    """A normalised region (x, y, w, h) in pixels."""
    return F.struct(*[(region[c] * of).alias(c) for c, of in (("x", width), ("y", height), ("w", width), ("h", height))])


# ---------------------------------------------------------------- windows and tries


def display_of(displays: Column, x: Column, y: Column) -> Column:
    """The first display of an array (id, x0, y0, x1, y1) that a point is in, 0 without one."""
    inside = F.filter(displays, lambda d: (x >= d["x0"]) & (x < d["x1"]) & (y >= d["y0"]) & (y < d["y1"]))
    return F.coalesce(F.get(inside, F.lit(0))["id"], F.lit(0))


def is_window(layer: Column, width: Column, height: Column) -> Column:
    """Normal windows, not tiny ones."""
    return (F.coalesce(layer, F.lit(0)) == 0) & (width >= rules.LEAST_WINDOW) & (height >= rules.LEAST_WINDOW)


def eligible(blocked: Column, extractor: Column, on_screen: Column, since: Column) -> Column:
    """Whether a window is to be read now. since: seconds since the last time, null if never."""
    rested = F.coalesce(since >= rules.LEAST_INTERVAL, F.lit(True))
    return ~blocked & (extractor != "chrome") & on_screen & rested


def idle(*ways: Column) -> Column:
    """Seconds since any input: the least over the kinds of input."""
    return F.least(*ways)


def success_rate(good: Column, all_: Column) -> Column:
    return F.coalesce(F.try_divide(good, all_), F.lit(0.0))


def retried(tries: Column, most: int) -> Column:
    """(content, error, used) of tries (content, error) in turn: the first content
    that isn't blank, else the last error."""
    if most <= 0:
        return F.struct(F.lit(None).cast("string").alias("content"), F.lit("No attempts made (max_attempts was 0)").alias("error"), F.lit(0).alias("used"))

    def result(t: Column) -> Column:
        good = F.filter(F.transform(t, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n"))), lambda y: F.coalesce(F.regexp_replace(y["x"]["content"], r"(?U)\s+", ""), F.lit("")) != "")
        first, last = F.get(good, F.lit(0)), F.get(t, F.size(t) - 1)
        empty = F.concat(F.lit("Empty content on attempt "), F.size(t).cast("string"))
        error = F.when(F.size(t) == 0, "No attempts made").otherwise(F.coalesce(last["error"], empty))
        return F.struct(first["x"]["content"].alias("content"), F.when(first.isNull(), error).alias("error"), F.coalesce(first["n"], F.size(t)).alias("used"))

    return let(F.slice(tries, 1, most), lambda t: result(t))


def retry_delay(attempt: Column) -> Column:
    """Milliseconds to wait after a failed try, numbered from 1."""
    return (F.lit(100) * F.pow(F.lit(2), attempt - 1)).cast("long")


def cache_ttl(key: Column) -> Column:
    """Seconds for which a page isn't read again; talks change faster."""
    talk = [key.startswith(p) for p in rules.TALK_KEYS]
    return F.when(talk[0] | talk[1], rules.TALK_TTL).otherwise(rules.CACHE_TTL).cast("double")


def tab_wait(url: Column) -> Column:
    return F.when(url.contains(rules.OFFICE_TAB), rules.OFFICE_TAB_DEBOUNCE).otherwise(rules.TAB_DEBOUNCE).cast("double")
