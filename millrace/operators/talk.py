"""Chat messages from the elements of chat windows, given as flat rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chat
from ..functions.text import strip

# ---- fixed values: headings that end a message, and what content leaves out
SYSTEM_PARTS = [" joined ", " left ", " was invited ", " named the meeting "]
OPTIONS_LABEL = "More message options"
LINK_PREFIXES = ["Link ", "Url Preview for "]
SEPARATORS = [" - ", " "]

Message = tuple[str, str, str]


def _is_label(text: str) -> bool:
    bare_time = len(text.encode()) <= 8 and ":" in text and all(c in "0123456789: " for c in text)
    return text in chat.TEAMS_LABELS or bare_time


def _is_time(text: str) -> bool:
    t = text.strip()
    return any(m in t for m in [*chat.TIME_MARKS, *chat.TEAMS_MARKS]) or t.startswith(tuple(chat.DAYS))


def _meeting(text: str) -> Message | None:
    """A start or an end of a meeting, with its time and, at the end, its length."""
    kind = next((k for k in ("Meeting started", "Meeting ended") if text.startswith(k)), None)
    if kind is None:
        return None
    _, at, rest = text.partition(" at ")
    date = rest.partition(" after ")[0].strip() if at else "Unknown"
    _, after, length = text.partition(" after ")
    if kind == "Meeting ended" and after:
        kind = f"{kind} (duration: {length.strip()})"
    return "System", date, kind


class TeamsReader:
    """Goes through (role, text) of a window's elements and gives messages as they end."""

    def __init__(self) -> None:
        self.author: str | None = None  # of the message that is open
        self.heading, self.date, self.named, self.parts = "", None, False, []

    def close(self) -> Iterator[Message]:
        if self.author is not None:
            kept: list[str] = []
            for p in self.parts:
                if not any(k in p or p in k for k in kept):
                    kept.append(p)
            if kept:
                yield self.author, self.date or "Unknown", " ".join(kept)
            self.author = None

    def _open(self, author: str, heading: str) -> None:
        self.author, self.heading, self.date, self.named, self.parts = author, heading, None, False, []

    def _take(self, role: str, text: str) -> None:
        if text == self.heading or text == OPTIONS_LABEL or _is_label(text):
            return
        if text == self.author and not self.named:
            self.named = True
        elif self.named and self.date is None and _is_time(text):
            self.date = text
        elif role in ("AXStaticText", "AXLink"):
            for prefix in LINK_PREFIXES:
                text = text.removeprefix(prefix)
            if len(text.encode()) > 2 and not text.endswith("...") and text not in SEPARATORS:
                self.parts.append(text)

    def read(self, role: str, text: str) -> Iterator[Message]:
        heading = role == "AXHeading"
        by = heading and " by " in text
        if self.author is not None:
            if not (by or heading and (text.startswith("Meeting ") or any(p in text for p in SYSTEM_PARTS))):
                self._take(role, text)
                return
            yield from self.close()
        if by and (author := text.rpartition(" by ")[2].strip()) and not _is_label(author):
            self._open(author, text)
        elif heading and (event := _meeting(text)):
            yield event


def teams_messages(elements: DataFrame, key: str, order: str) -> DataFrame:
    """(key, number, author, date, content) from (key, order, role, text).

    A message goes on until the next heading, which no window expresses; rows are
    dealt by window and sorted, and a task reads them once with one message open.
    """
    kind = elements.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, number = object(), TeamsReader(), 0
        rows: list[tuple] = []

        def put(messages: Iterator[Message]) -> None:
            nonlocal number
            for m in messages:
                rows.append((now, number, *m))
                number += 1

        for b in batches:
            for own, role, text in zip(*[b.column(c).to_pylist() for c in ("key", "role", "text")], strict=True):
                if own != now:
                    put(reader.close())
                    now, number, reader = own, 0, TeamsReader()
                put(reader.read(role or "", text or ""))
            if rows:
                yield _batch(rows, b.schema.field("key").type)
                rows.clear()
            kept = b.schema.field("key").type
        put(reader.close())
        if rows:
            yield _batch(rows, kept)

    thin = elements.select(F.col(key).alias("key"), F.col(order).alias("ord"), "role", "text")
    dealt = thin.repartition("key").sortWithinPartitions("key", "ord")
    return dealt.mapInArrow(run, f"key {kind}, number int, author string, date string, content string").withColumnRenamed("key", key)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [kind, pa.int32(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "number", "author", "date", "content"])


def container_messages(
    nodes: DataFrame, container: str, order: str, labels: list[str] | None = None, is_time: Callable[[Column], Column] = chat.looks_like_time, most_depth: int = 10
) -> DataFrame:
    """(container, author, date, content) from a container's nodes (role, depth,
    title, description, value): the first button's title, the first link's time,
    and all static texts in order. Containers without author or text give none."""
    near = nodes.where(F.col("depth") <= most_depth)
    value = strip(F.col("value"))
    spoken = (F.col("role") == "AXStaticText") & (F.octet_length(value) > 2) & ~chat.is_ui_text(value, labels)
    named = (F.col("role") == "AXButton") & (F.octet_length("title") > 2) & ~chat.is_ui_text(F.col("title"), labels)
    timed = (F.col("role") == "AXLink") & is_time(F.col("description"))
    first = lambda c, when: F.min_by(c, F.when(when, F.col(order)))
    parts = F.array_sort(F.collect_list(F.when(spoken, F.struct(F.col(order).alias("o"), value.alias("v")))))
    g = near.groupBy(container).agg(first("title", named).alias("author"), first("description", timed).alias("date"), parts.alias("parts"))
    content = F.array_join(F.transform("parts", lambda p: p["v"]), " ")
    out = g.select(container, "author", F.coalesce("date", F.lit("Unknown")).alias("date"), content.alias("content"))
    return out.where("author IS NOT NULL AND octet_length(content) >= 3")


def distinct_messages(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Each (author, date, content) of a key once, where it came first."""
    same = [key, "author", "date", "content"]
    return messages.groupBy(*same).agg(F.min(order).alias(order))


def numbered(messages: DataFrame, key: str, order: str) -> DataFrame:
    return messages.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(order)))
