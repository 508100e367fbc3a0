"""Chat messages from the titles of interface elements (Column -> Column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, words

# ---- fixed values: labels of the interface, marks of a time, and what content drops
UI_LABELS = [
    "Home", "Activity", "Files", "More", "Threads", "Huddles", "Drafts & sent", "Directories", "Starred", "Channels", "Direct Messages", "Apps", "Messages",
    "Add canvas", "Canvas", "List", "Folder", "Channel", "AM", "PM",
]
TIME_MARKS = ["AM", "PM", "ago", "Yesterday", "Today", "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
TIME = r"(\d{1,2}:\d{2}\s*(?:AM|PM))"
TIME_ENDS = [
    r"[.\s]+" + TIME + r"\.(?:\s*\d+\s*(?:reaction|link|file|reply|replies|attachment)s?\.?)*\s*$",
    r"\.\s*" + TIME + r"\.\s*$",
    r"[.\s]+" + TIME + r"\s*$",
]
ARTIFACTS = ["Image: No alt text.", "Image:", "Attachment:", "File:"]
TEAMS_LABELS = [
    "Chat", "Teams", "Calendar", "Calls", "Files", "Activity", "More", "Search", "Settings", "Help", "New chat", "New meeting", "Meet", "Join", "Leave",
    "Mute", "Unmute", "Share", "React", "Reply", "Forward", "Copy", "Delete", "Edit", "Pin", "Save", "Mark as unread", "Turn on notifications", "Hide",
    "Mentions", "Favourites", "Chats", "Shared", "Recap", "Q&A", "OneDrive", "Apps", "Type a message", "AM", "PM",
]
TEAMS_MARKS = ["a.m.", "p.m."]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
TEAMS_ENDS = [r"[,.\s]+" + TIME + r"\s*$", r"[,.\s]+((?:Today|Yesterday)\s+at\s+\d{1,2}:\d{2}\s*(?:AM|PM))\s*$"]
TEAMS_ARTIFACTS = ["Image", "Attachment", "File", "GIF", "Sticker", "Edited"]


def is_ui_text(text: Column, labels: list[str] | None = None) -> Column:
    """A label of the interface, or a bare time of at most eight characters."""
    return text.isin(UI_LABELS if labels is None else labels) | (text.rlike(r"^[0-9: ]{1,8}$") & text.contains(":"))


def looks_like_time(text: Column) -> Column:
    return text.rlike("|".join(TIME_MARKS))


def looks_like_teams_time(text: Column) -> Column:
    t = strip(text)
    return looks_like_time(t) | t.rlike("|".join(m.replace(".", r"\.") for m in TEAMS_MARKS)) | t.rlike("^(?:" + "|".join(DAYS) + ")")


def is_date_header(text: Column) -> Column:
    """A day's name, or a month and a number."""
    t = strip(text)
    return t.isin([*DAYS, "Today", "Yesterday"]) | t.rlike("^(?:" + "|".join(MONTHS) + r")\s*[0-9, ]*$")


def _teams_timed(rest: Column) -> Column:
    """(content, date) by the time at the end, null without one."""
    out = F.struct(rest.alias("content"), F.lit(None).cast("string").alias("date"))
    for end in reversed(TEAMS_ENDS):
        split = F.struct(strip(F.regexp_replace(rest, end, "")).alias("content"), strip(F.regexp_extract(rest, end, 1)).alias("date"))
        out = F.when(rest.rlike(end), split).otherwise(out)
    return out


def _timed(rest: Column) -> Column:
    """(content, date) of a message that ends in a time; date is null without one."""
    split = lambda content, date: F.struct(strip(content).alias("content"), date.alias("date"))
    out = split(rest, F.lit(None).cast("string"))
    time = F.regexp_extract(F.right(rest, F.lit(30)), TIME, 1)
    before = F.left(rest, F.length(rest) - F.position(F.reverse(time), F.reverse(rest)) + 1 - F.length(time))
    before = F.regexp_replace(before, r"[. ]+$", "")
    out = F.when((F.length(rest) > 30) & (time != "") & (strip(before) != ""), split(before, time)).otherwise(out)
    for end in reversed(TIME_ENDS):
        out = F.when(rest.rlike(end), split(F.regexp_replace(rest, end, ""), F.regexp_extract(rest, end, 1))).otherwise(out)
    return out


def _message(title: Column, labels: list[str], timed: Callable[[Column], Column], artifacts: list[str]) -> Column:
    """(author, date, content) of ``Author: text. time``, null if it is no message."""

    def parsed(t: Column) -> Column:
        author = strip(F.regexp_extract(t, r"(?s)^([^:]*):", 1))
        rest = strip(F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1))

        def result(r: Column) -> Column:
            content = r["content"]
            for artifact in artifacts:
                content = F.replace(content, F.lit(artifact), F.lit(""))
            clean = F.array_join(words(content), " ")
            bad = (F.octet_length(t) < 10) | is_ui_text(t, labels) | ~t.contains(":") | (author == "") | is_ui_text(author, labels) | (F.octet_length(r["content"]) < 3) | (clean == "")
            return F.when(~bad, F.struct(author.alias("author"), F.coalesce(r["date"], F.lit("Unknown")).alias("date"), clean.alias("content")))

        return let(timed(rest), lambda r: result(r))

    return let(strip(title), lambda x: parsed(x))


def message(title: Column) -> Column:
    return _message(title, UI_LABELS, _timed, ARTIFACTS)


def teams_message(title: Column) -> Column:
    return _message(title, TEAMS_LABELS, _teams_timed, TEAMS_ARTIFACTS)


def rendered(m: Column) -> Column:
    return F.concat(F.lit("["), m["author"], F.lit("] ["), m["date"], F.lit("] "), m["content"])
