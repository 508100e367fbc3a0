"""Text of the XML parts of office files, by ``from_xml`` (Column -> Column).

For parts that are already text (unpacked, or sent as they are); ``sources.documents``
unpacks files. Broken XML and null give null. Prefixes of names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
_RUN = "r: array<struct<t: array<string>>>"
_WORD = f"body struct<p: array<struct<{_RUN}>>>, _broken string"
_SHEET = "sheetData struct<row: array<struct<_r: long, c: array<struct<_r: string, _t: string, v: string>>>>>, _broken string"
_STRINGS = f"si array<struct<t: string, {_RUN}>>, _broken string"


def _parsed(xml: Column, kind: str) -> Column:
    return F.from_xml(xml, kind, _OPTIONS)


def _runs(runs: Column) -> Column:
    return F.array_join(F.flatten(F.filter(F.transform(runs, lambda r: r["t"]), lambda t: t.isNotNull())), "")


def word_text(xml: Column) -> Column:
    """The paragraphs of a document's body that have text, a line each."""

    def text(d: Column) -> Column:
        lines = F.transform(F.coalesce(d["body"]["p"], F.array()), lambda p: F.coalesce(_runs(p["r"]), F.lit("")))
        return F.when(d.isNotNull() & d["_broken"].isNull(), F.array_join(F.filter(lines, lambda x: strip(x) != ""), "\n"))

    return let(_parsed(xml, _WORD), text)


def shared_strings(xml: Column) -> Column:
    """The strings that cells name by their number."""
    of = lambda s: F.coalesce(s["t"], _runs(s["r"]), F.lit(""))
    return let(_parsed(xml, _STRINGS), lambda d: F.when(d.isNotNull() & d["_broken"].isNull(), F.transform(F.coalesce(d["si"], F.array()), of)))


def sheet_cells(xml: Column, strings: Column) -> Column:
    """Structs (row, col, text) for ``formats.grid``: row from 1, col from 0 of the
    cell's name, text from ``strings`` where the cell says so. Cells without a value
    are left out."""

    def col(name: Column) -> Column:
        letters = F.split(F.regexp_extract(name, "^([A-Z]+)", 1), "")
        return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1

    def cell(c: Column) -> Column:
        text = F.when(c["_t"] == "s", F.get(strings, c["v"].try_cast("int"))).when(c["_t"] == "b", F.when(c["v"] == "1", "TRUE").otherwise("FALSE")).otherwise(c["v"])
        return F.struct(F.regexp_extract(c["_r"], r"(\d+)$", 1).try_cast("long").alias("row"), col(c["_r"]).alias("col"), text.alias("text"))

    def cells(d: Column) -> Column:
        own = F.flatten(F.transform(F.coalesce(d["sheetData"]["row"], F.array()), lambda r: F.coalesce(r["c"], F.array())))
        return F.when(d.isNotNull() & d["_broken"].isNull(), F.transform(F.filter(own, lambda c: c["v"].isNotNull()), cell))

    return let(_parsed(xml, _SHEET), cells)
