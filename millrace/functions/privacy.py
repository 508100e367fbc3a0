"""Block lists and redaction (Column -> Column)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import let


def glob_regex(globs: list[str]) -> str:
    """One anchored pattern for globs with ``*``, ``?`` and ``[...]``."""

    def one(glob: str) -> str:
        parts = re.split(r"(\*|\?|\[[^\]]*\])", glob)
        return "".join(".*" if p == "*" else "." if p == "?" else p.replace("[!", "[^") if p[:1] == "[" and p[-1:] == "]" else re.escape(p) for p in parts)

    return "^(?s:" + "|".join(one(g) for g in globs) + ")$"


def always_blocked(bundle: Column) -> Column:
    lower = F.lower(bundle)
    part = F.exists(F.array(*map(F.lit, rules.ALWAYS_BLOCKED_LOWER)), lambda p: lower.contains(p))
    return bundle.isin(rules.ALWAYS_BLOCKED) | bundle.rlike(glob_regex(rules.ALWAYS_BLOCKED_GLOBS)) | part


def app_blocked(bundle: Column, globs: list[str] | None = None) -> Column:
    own = rules.DEFAULT_BLOCKED_GLOBS if globs is None else globs
    return always_blocked(bundle) | (bundle.rlike(glob_regex(own)) if own else F.lit(False))


def capture_blocked(bundle: Column, title: Column, bundles: list[str] = (), titles: list[str] = ()) -> Column:
    """Whether a window must not be captured, by bundle or by its title."""
    lower = F.lower(title)
    parts = [*rules.CAPTURE_BLOCKED_TITLES, *[t.lower() for t in titles], *rules.CAPTURE_BLOCKED_URLS]
    return F.coalesce(bundle.isin([*rules.CAPTURE_BLOCKED, *bundles]), F.lit(False)) | F.coalesce(
        F.exists(F.array(*map(F.lit, parts)), lambda p: lower.contains(p)), F.lit(False)
    )


def is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def redact_cards(text: Column) -> Column:
    """Runs in card form whose 13 to 19 digits pass the check sum, each at its own
    place: the text between the runs, and in turn each run or the mark for it."""

    def rebuilt(runs: Column) -> Column:
        between = F.split(text, rules.CARD, -1)
        shown = F.transform(runs, lambda m: F.when(is_card(F.regexp_replace(m, r"\D", "")), F.lit(rules.CARD_MARK)).otherwise(m))
        pieces = F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.array_join(pieces, "")

    runs = F.regexp_extract_all(text, F.lit(rules.CARD), F.lit(0))
    return F.when(F.exists(runs, lambda m: is_card(F.regexp_replace(m, r"\D", ""))), let(runs, lambda r: rebuilt(r))).otherwise(text)


def blocklist(globs: list[str], block: list[str] = (), unblock: list[str] = ()) -> list[str]:
    """A block list after changes at run time: what is never captured stays out of
    reach of ``unblock`` (see ``always_blocked``), others go by their exact text."""
    return [g for g in [*globs, *block] if g not in unblock]


def redact_patterns(text: Column, patterns: list[tuple[str, str]]) -> Column:
    for pattern, mark in patterns:
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_router(text: Column, cards: bool = True, emails: bool = False, phones: bool = False) -> Column:
    text = redact_cards(text) if cards else text
    return redact_patterns(text, [*rules.ROUTER_REDACTIONS, *([rules.EMAIL] if emails else []), *([rules.PHONE] if phones else [])])


def redact_ocr(text: Column) -> Column:
    return redact_patterns(text, rules.OCR_REDACTIONS)
