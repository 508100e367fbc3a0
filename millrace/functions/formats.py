"""Text of messages, mails, issues, sheets and searches from their parts (Column -> Column)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import found, query_value
from .text import let, strip, words


def filled(value: Column, otherwise: str) -> Column:
    """The stripped value, or a stand-in for none."""
    return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit(otherwise))


def chat(messages: Column) -> Column:
    """Lines ``[author HH:mm] text`` from structs (author, time, text); blank texts are left out."""
    kept = F.filter(messages, lambda m: F.coalesce(strip(m["text"]), F.lit("")) != "")
    line = lambda m: F.concat(F.lit("["), filled(m["author"], "unknown"), F.lit(" "), F.coalesce(F.date_format(m["time"], "HH:mm"), F.lit("")), F.lit("] "), strip(m["text"]))
    return F.array_join(F.transform(kept, line), "\n")


def mail_list(mails: Column, dated: bool = True) -> Column:
    """Lines ``[sender] subject - snippet``, with the date where the list has one."""

    def line(m: Column) -> Column:
        base = F.concat(F.lit("["), m["sender"], F.lit("] "), m["subject"], F.lit(" - "), m["snippet"])
        return F.concat(base, F.lit(" ("), m["date"], F.lit(")")) if dated else base

    return F.array_join(F.transform(mails, line), "\n")


def mail(subject: Column, sender: Column, body: Column, date: Column | None = None) -> Column:
    head = [F.concat(F.lit("Subject: "), subject), F.concat(F.lit("From: "), filled(sender, "unknown"))]
    if date is not None:
        head.append(F.concat(F.lit("Date: "), date))
    return F.concat(F.concat_ws("\n", *head), F.lit("\n\n"), body)


def issue(i: Column) -> Column:
    """A tracker issue from a struct: key, summary, status, priority, type,
    assignee, reporter, project, description, labels, comments (author, created, body)."""
    named = [("Status", "status"), ("Priority", "priority"), ("Type", "type"), ("Assignee", "assignee"), ("Reporter", "reporter"), ("Project", "project")]
    facts = F.concat_ws(" | ", *[F.when(i[c] != "", F.concat(F.lit(f"{label}: "), i[c])) for label, c in named])
    some = lambda value, text: F.when(F.coalesce(value, F.lit("")) != "", text)
    labels = F.array_join(i["labels"], ", ")
    last = F.slice(i["comments"], F.greatest(F.lit(1), F.size(i["comments"]) - 2), F.lit(3))
    comment = lambda c: F.concat(F.lit("["), F.coalesce(c["author"], F.lit("Unknown")), F.lit(" - "), c["created"], F.lit("]\n"), c["body"], F.lit("\n"))
    return strip(
        F.concat_ws(
            "\n",
            F.concat(F.lit("# "), i["key"], F.lit(": "), F.coalesce(i["summary"], F.lit("")), F.lit("\n")),
            some(facts, F.concat(facts, F.lit("\n"))),
            some(i["description"], F.concat(F.lit("## Description\n"), i["description"], F.lit("\n"))),
            some(labels, F.concat(F.lit("Labels: "), labels, F.lit("\n"))),
            F.when(F.size(i["comments"]) > 0, F.concat(F.lit("## Recent Comments\n"), F.array_join(F.transform(last, comment), "\n"))),
        )
    )


def without_visual_breaks(text: Column) -> Column:
    """A document's text on one line: all white space runs become one space."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def grid(cells: Column) -> Column:
    """Rows by tab and newline from structs (row, col, text), in numeric order. Cells
    without a text take no place, cells without a row are left out.

    Cells are sorted once, those without a text at the end of their row; each puts out
    its text behind what parts it from the cell before it."""
    keyed = F.transform(F.filter(cells, lambda c: c["row"].isNotNull()), lambda c: F.struct(c["row"].alias("row"), c["text"].isNull().alias("none"), c["col"].alias("col"), c["text"].alias("text")))

    def joined(s: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            new = (i == 0) | (F.get(s, i - 1)["row"] != c["row"])
            between = F.when(i == 0, "").when(new, "\n").when(c["none"], "").otherwise("\t")
            return F.concat(between, F.coalesce(c["text"].cast("string"), F.lit("")))

        return F.array_join(F.transform(s, piece), "")

    return let(F.array_sort(keyed), joined)


def slides(texts: Column, notes: Column) -> Column:
    """``Slide i: text`` of filled slides, else the notes."""
    numbered = F.transform(texts, lambda t, i: F.when(strip(t) != "", F.concat(F.lit("Slide "), (i + 1).cast("string"), F.lit(": "), strip(t))))
    own = F.array_join(F.filter(numbered, lambda x: x.isNotNull()), "\n")
    return F.coalesce(F.nullif(own, F.lit("")), F.array_join(F.filter(notes, lambda x: strip(x) != ""), "\n"))


def search_results(overview: Column, results: Column, most: int = 10) -> Column:
    """An overview of over 100 characters and the first numbered results (title, snippet, link)."""
    full = F.transform(F.slice(results, 1, most), lambda r, i: F.struct((i + 1).alias("n"), r.alias("r")))
    full = F.filter(full, lambda x: (F.coalesce(x["r"]["title"], F.lit("")) != "") & (F.coalesce(x["r"]["snippet"], F.lit("")) != ""))
    one = lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["r"]["title"], F.lit("\n   "), x["r"]["snippet"], F.lit("\n   "), F.coalesce(x["r"]["link"], F.lit("")))
    listed = F.array_join(F.transform(full, one), "\n\n")
    return F.concat_ws(
        "\n\n",
        F.when(F.length(strip(overview)) > 100, F.concat(F.lit("## AI Overview\n"), strip(overview))),
        F.when(listed != "", F.concat(F.lit("## Search Results\n"), listed)),
    )


def issue_key(url: Column) -> Column:
    key = r"([A-Za-z][A-Za-z0-9]+-\d+)"
    return F.coalesce(F.nullif(query_value(url, "selectedIssue"), F.lit("")), found(url, f"/browse/{key}"), found(url, key))


def conversation_id(url: Column) -> Column:
    return F.coalesce(*[found(url, p + "([a-zA-Z0-9_-]+)") for p in ("/app/", "/c/", "[?&]c=")])


def fingerprint(content: Column, now: Column) -> Column:
    """Base 36 of a 31-multiplier hash (32 bits, signed) of the first user's words."""
    own = F.lower(strip(found(content, r"\[User\]\s*(.{0,100})")))
    codes = F.transform(F.filter(F.split(own, ""), lambda c: c != ""), lambda c: F.ascii(c))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    signed = F.when(wrapped >= 1 << 31, (1 << 32) - wrapped).otherwise(wrapped)
    return F.coalesce(F.lower(F.conv(signed.cast("string"), 10, 36)), F.lower(F.conv(now.cast("string"), 10, 36)))


def wanted_tab(url: Column) -> Column:
    """Web pages, but not the home pages of documents, sheets and slides."""
    home = [url.contains(f"docs.google.com/{k}") & ~url.contains(f"/{k}/d/") for k in ("document", "spreadsheets", "presentation")]
    return F.coalesce(url.startswith("http") & ~(home[0] | home[1] | home[2]), F.lit(False))


def file_path(url: Column) -> Column:
    """The path of a file URL, decoded (a plus sign stays one)."""
    return F.try_url_decode(F.replace(F.regexp_replace(url, r"^file://(?:localhost)?", ""), F.lit("+"), F.lit("%2B")))


def natural_number(name: Column) -> Column:
    """The number before a name's extension, 0 without one: slide10 after slide2."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)\.[A-Za-z]+$", 1).try_cast("int"), F.lit(0))


def difference_hash(rows: Column) -> Column:
    """Of 8 rows of 9 values: bit i is set if a value is over its right neighbour."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.when(
            F.get(rows, (F.floor(i / 8) * 9 + i % 8).cast("int")) > F.get(rows, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int")), F.call_function("shiftleft", F.lit(1).cast("long"), i)
        ).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def distinct_pieces(pieces: Column) -> Column:
    """Pieces in order, without those equal to, within or around one kept before."""
    empty = F.array().cast("array<string>")
    clash = lambda kept, p: F.exists(kept, lambda k: k.contains(p) | p.contains(k))
    return F.aggregate(pieces, empty, lambda kept, p: F.when(clash(kept, p), kept).otherwise(F.concat(kept, F.array(p))))


def mean_confidence(blocks: Column) -> Column:
    """Mean of the blocks' confidence, 0 without blocks."""
    total = F.aggregate(blocks, F.lit(0.0), lambda s, b: s + b["confidence"].cast("double"))
    return F.when(F.size(blocks) > 0, total / F.size(blocks)).otherwise(0.0)


def word_count(text: Column) -> Column:
    return let(words(text), lambda w: F.size(w))


def ai_turns(turns: Column) -> Column:
    """``[User]`` and ``[AI]`` blocks from structs (role, text); null without any text."""
    full = F.filter(turns, lambda t: F.coalesce(strip(t["text"]), F.lit("")) != "")
    block = lambda t: F.concat(F.lit("["), F.when(t["role"] == "user", "User").otherwise("AI"), F.lit("]\n"), strip(t["text"]))
    return F.nullif(F.array_join(F.transform(full, block), "\n\n"), F.lit(""))


def board(cards: Column) -> Column:
    """Lines ``KEY: summary`` of a board or a backlog, of cards that have a key; null without one."""
    keyed = F.filter(cards, lambda c: F.coalesce(strip(c["key"]), F.lit("")) != "")
    line = lambda c: F.concat(strip(c["key"]), F.lit(": "), F.coalesce(strip(c["summary"]), F.lit("")))
    return F.nullif(F.array_join(F.transform(keyed, line), "\n"), F.lit(""))


def issue_page(key: Column, summary: Column, status: Column, assignee: Column, description: Column) -> Column:
    """An issue as its page shows it; null if there is nothing but the key."""
    some = lambda c: F.nullif(F.coalesce(strip(c), F.lit("")), F.lit(""))
    who = some(F.regexp_replace(assignee, r"(?i)^Assignee\s*", ""))
    who = F.nullif(who, F.lit("Unassigned"))
    name = F.coalesce(some(key), F.lit("UNKNOWN"))
    facts = F.concat_ws(" | ", F.concat(F.lit("Status: "), some(status)), F.concat(F.lit("Assignee: "), who))
    head = F.concat(F.lit("# "), name, F.lit(": "), F.coalesce(some(summary), F.lit("")))
    content = strip(F.concat_ws("\n", head, F.lit(""), F.when(facts != "", F.concat(facts, F.lit("\n"))), F.concat(F.lit("## Description\n"), some(description))))
    return F.nullif(content, F.concat(F.lit("# "), name, F.lit(":")))


def office_ids(url: Column) -> Column:
    """(doc, sheet, gid, deck) of an office URL; gid is 0 where a sheet has none."""
    of = lambda kind: found(url, rf"/{kind}/d/([a-zA-Z0-9_-]+)")
    gid = F.when(of("spreadsheets").isNotNull(), F.coalesce(found(url, r"[#&?]gid=(\d+)"), F.lit("0")))
    return F.struct(of("document").alias("doc"), of("spreadsheets").alias("sheet"), gid.alias("gid"), of("presentation").alias("deck"))


def adf_text(raw: str | None) -> str:
    """Text of a rich document in JSON (or plain text as it is): all its text nodes in order."""
    try:
        root = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return raw.strip()
    if isinstance(root, str):
        return root
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if node.get("type") == "text":
                out.append(node.get("text") or "")
            elif isinstance(node.get("content"), list):
                todo += reversed(node["content"])
    return "".join(out).strip()


def adf(raw: Column) -> Column:
    """``adf_text`` of a column: the depth of a document isn't known, which SQL has no form for."""

    def texts(column: pd.Series) -> pd.Series:
        return column.map(adf_text)

    return F.pandas_udf(texts, "string")(raw)


__all__ = ["adf", "adf_text", "ai_turns", "board", "chat", "conversation_id", "difference_hash", "distinct_pieces", "file_path", "fingerprint", "grid", "issue", "issue_key", "issue_page", "mail", "mail_list", "mean_confidence",
           "natural_number", "office_ids", "search_results", "slides", "wanted_tab", "without_visual_breaks", "word_count"]
