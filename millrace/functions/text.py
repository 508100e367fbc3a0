"""Chunking, truncation, line filters and novelty of texts (Column -> Column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line does not count."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n$", ""), "\n")


def chunk_words(text: Column, most: int = 1024, overlap: int = 100) -> Column:
    """Chunks of at most ``most`` words, each ``overlap`` words into the one
    before; a short rest is appended to the last. Array of (text, token_count)."""
    step = most - overlap

    def chunks(w: Column) -> Column:
        n = F.size(w)
        count = F.floor((n - overlap) / step).cast("int") + 1
        rest = F.greatest(F.lit(0), n - count * step)

        def chunk(j: Column) -> Column:
            own = F.slice(w, j * step + 1, F.lit(most))
            last = (j == count - 1) & (rest > 0)
            all_ = F.when(last, F.concat(own, F.slice(w, n - F.greatest(rest, F.lit(1)) + 1, F.greatest(rest, F.lit(1))))).otherwise(own)
            return let(all_, lambda a: F.struct(F.array_join(a, " ").alias("text"), F.size(a).alias("token_count")))

        whole = F.array(F.struct(text.alias("text"), n.alias("token_count")))
        none = F.slice(whole, 1, 0)
        return F.when(n == 0, none).when(n <= most, whole).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda j: chunk(j)))

    return let(words(F.coalesce(text, F.lit(""))), lambda w: chunks(w))


def chunk_count(text: Column, most: int = 1024, overlap: int = 100) -> Column:
    """How many chunks ``chunk_words`` makes, from the number of words alone."""
    n = F.size(words(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, 0).when(n <= most, 1).otherwise(F.floor((n - overlap) / (most - overlap)).cast("int") + 1)


def is_tabular(text: Column) -> Column:
    """At least two of the first ten lines hold a tab, of two lines or more."""
    some = F.slice(lines(text), 1, 10)
    return F.coalesce((F.size(some) >= 2) & (F.size(F.filter(some, lambda x: x.contains("\t"))) >= 2), F.lit(False))


def preview(text: Column, most: int = 150) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def truncate_text(text: Column, limit: int = 150) -> Column:
    """Cut at the last space if it is near the end, with an ellipsis."""
    if limit <= 0:
        return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise("...")
    cut = limit - 3
    if cut <= 0:
        return F.when(F.length(F.coalesce(text, F.lit(""))) <= limit, F.coalesce(text, F.lit(""))).otherwise("...")
    head = F.left(text, F.lit(cut + 1))
    space = F.when(head.contains(" "), F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))).otherwise(-1)
    end = F.when(space > cut * 0.8, space).otherwise(cut)
    out = F.concat(F.regexp_replace(F.substring(text, F.lit(1), end), r"(?U)\s+$", ""), F.lit("..."))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.length(text) <= limit, text).otherwise(out)


def truncate_lines(text: Column, most: int = 4) -> Column:
    if most <= 0:
        return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise("...")
    all_ = F.split(text, "\n")
    head = F.regexp_replace(F.array_join(F.slice(all_, 1, most), "\n"), r"(?U)\s+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.size(all_) <= most, text).otherwise(F.concat(head, F.lit("...")))


def without_noise(text: Column) -> Column:
    """Recognised text without lines that are menus, tabs and the like."""

    def keep(t: Column) -> Column:
        n = F.length(t)
        letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
        noise = F.exists(F.array(*map(F.lit, rules.NOISE)), lambda p: t.contains(p))
        short = F.exists(F.array(*map(F.lit, rules.SHORT_NOISE)), lambda p: t.contains(p))
        return (n >= 3) & ~((letters / F.greatest(n, F.lit(1)) < 0.5) & (n < 20)) & ~noise & ~((n < 30) & short)

    kept = F.array_join(F.filter(F.split(text, "\r\n|\n|\r"), lambda x: let(strip(x), lambda t: keep(t))), "\n")
    return strip(F.regexp_replace(F.regexp_replace(kept, "\n{3,}", "\n\n"), " {2,}", " "))


def cell_string(text: Column) -> Column:
    """A string as a sheet's cell shows it: on one line, tabs as spaces."""
    return F.replace(F.replace(F.replace(text, F.lit("\t"), F.lit("    ")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def ocr_title(window_title: Column, text: Column, clean: Callable[[Column], Column]) -> Column:
    long = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (F.length(x) >= 10) & (F.length(x) <= 200))
    return F.when(F.coalesce(window_title, F.lit("")) != "", clean(window_title)).otherwise(F.left(F.get(long, F.lit(0)), F.lit(100)))


def is_meaningful(text: Column) -> Column:
    n = F.length(text)
    printable = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s.,!?;:'\"\-()\[\]{}]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    skipped = let(F.lower(text), lambda lower: F.exists(F.array(*map(F.lit, rules.UNMEANING)), lambda p: lower.contains(p)))
    fits = (F.octet_length(text) >= 2) & (F.octet_length(text) <= 5000)
    return F.when(fits, (printable / n >= 0.8) & (letters >= 2) & ~skipped).otherwise(False)


def new_content(existing: Column, incoming: Column) -> Column:
    """Lines of ``incoming`` that are new to ``existing``: not a line of it, and
    fewer than four fifths of their words in it."""
    old_lines = F.filter(F.transform(lines(existing), strip), lambda x: F.octet_length(x) > 10)
    trimmed = F.filter(F.transform(lines(incoming), strip), lambda x: F.octet_length(x) >= 10)

    def fresh(old: Column) -> Column:
        def new(x: Column) -> Column:
            share = let(words(x), lambda w: F.size(F.filter(w, lambda y: F.array_contains(old["words"], y))) / F.size(w))
            return ~F.array_contains(old["lines"], x) & (share < 0.8)

        return F.filter(trimmed, new)

    old = F.struct(old_lines.alias("lines"), F.array_distinct(words(existing)).alias("words"))
    return F.array_join(let(old, lambda o: fresh(o)), "\n")


def minutes_of_day(text: Column) -> Column:
    """Minutes since midnight of the first ``[h:mm AM]`` mark, 0 without one."""
    p = r"\[(\d{1,2}):(\d{2})\s*(AM|PM)\]"
    hour = F.regexp_extract(text, p, 1).cast("int")
    hour = F.when((F.regexp_extract(text, p, 3) == "PM") & (hour != 12), hour + 12).when((F.regexp_extract(text, p, 3) == "AM") & (hour == 12), 0).otherwise(hour)
    return F.when(text.rlike(p), hour * 60 + F.regexp_extract(text, p, 2).cast("int")).otherwise(0)


def jaccard(a: Column, b: Column) -> Column:
    """Of lower-cased word sets; 1 if both are empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.when(F.size(F.array_union(x, y)) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
