"""Capture payloads as JSON lines and as framed messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "url", "content", "title", "author", "channel", "app_name", "bundle_id")]
    + [T.StructField("timestamp", T.LongType())]
)
REQUIRED = ("source", "url", "content")


def parse_payloads(lines: DataFrame, column: str = "value") -> DataFrame:
    """The other columns, the payload's, and error (null if the line is a payload).

    A line that is no JSON, or lacks a required field, becomes a row of its own
    with an error; the rows around it go on.
    """
    kept = T.StructType([*PAYLOAD.fields, T.StructField("_bad", T.StringType())])
    j = F.from_json(column, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rest = [c for c in lines.columns if c != column and c not in PAYLOAD.names]
    p = lines.select(*rest, j.alias("p"))
    missing = F.filter(F.array(*[F.when(F.col(f"p.{c}").isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    error = F.when(F.col("p").isNull() | F.col("p._bad").isNotNull(), "Parse error: not a payload").when(
        F.size(missing) > 0, F.concat(F.lit("Parse error: missing "), F.array_join(missing, ", "))
    )
    return p.select(*rest, *[F.col(f"p.{f.name}").alias(f.name) for f in PAYLOAD.fields], error.alias("error"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return parse_payloads(spark.read.text(path))


def split_frames(raw: bytes, most: int | None = 1 << 20) -> list[str]:
    """Messages after a four-byte little-endian length; a zero length, a message
    over ``most`` or a cut one ends them."""
    out, at = [], 0
    while at + 4 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "little")
        if size == 0 or most is not None and size > most or at + 4 + size > len(raw):
            break
        out.append(raw[at + 4 : at + 4 + size].decode("utf-8", "replace"))
        at += 4 + size
    return out


def frames(files: DataFrame, most: int | None = 1 << 20) -> DataFrame:
    """(path, number, value) of the framed messages in (path, content)."""
    kind = files.schema["path"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, content in enumerate(b.column(1)):
                got = split_frames(content.as_py() or b"", most)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(got), pa.int64())), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.string())], ["path", "number", "value"])

    return files.select("path", "content").mapInArrow(run, f"path {kind}, number int, value string")


def read_frames(spark: SparkSession, path: str, most: int | None = 1 << 20) -> DataFrame:
    """The framed messages in files."""
    return frames(spark.read.format("binaryFile").load(path), most)


def extension_messages(values: DataFrame, column: str = "value") -> DataFrame:
    """Content messages of the browser extension as extracted content."""
    j = F.from_json(column, "type string, source string, title string, content string, url string, timestamp bigint")
    rest = [c for c in values.columns if c != column]
    m = values.select(*rest, j.alias("m")).where("m.type = 'content'").select(*rest, "m.*")
    fixed = {"app_name": F.lit("Chrome"), "bundle_id": F.lit("com.google.Chrome"), "extraction_method": F.lit("chrome_extension"), "confidence": F.lit(1.0).cast("float")}
    return m.drop("type").withColumns(fixed)


def recognised(values: DataFrame, column: str = "value") -> DataFrame:
    """Output of the text recogniser: rows with an error or without text fail."""
    j = F.from_json(column, "text string, confidence double, error string")
    m = values.select(*[c for c in values.columns if c != column], j.alias("m")).select("*", "m.*").drop("m")
    return m.withColumns({"confidence": F.coalesce("confidence", F.lit(0.9)), "failed": F.col("error").isNotNull() | (F.coalesce("text", F.lit("")) == "")})


def accessible(values: DataFrame, column: str = "value") -> DataFrame:
    """Output of the interface reader with its window's title, application and
    bundle: rows without content fail."""
    j = F.from_json(column, "content string")
    rest = [c for c in values.columns if c != column]
    m = values.select(*rest, F.coalesce(j["content"], F.lit("")).alias("content"))
    fixed = {"source": F.lit("accessibility"), "url": F.lit(None).cast("string"), "extraction_method": F.lit("accessibility"), "confidence": F.lit(1.0).cast("float")}
    return m.withColumns({**fixed, "failed": F.col("content") == ""})


def exports(answers: DataFrame) -> DataFrame:
    """(…, content, error) of fetched exports from (…, status, body): refused, failed or empty ones are errors."""
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"(?U)^\s+|\s+$", "")
    error = (
        F.when(F.col("status") == 429, "Rate limited (429) - try again later")
        .when((F.col("status") < 200) | (F.col("status") > 299), F.concat(F.lit("Export failed with status "), F.col("status").cast("string")))
        .when(body == "", "Export returned empty content")
    )
    rest = [c for c in answers.columns if c not in ("status", "body")]
    return answers.select(*rest, F.when(error.isNull(), body).alias("content"), error.alias("error"))


def batch_of_recognised(results: DataFrame) -> DataFrame:
    """A parallel batch's results: those that failed are left out."""
    return results.where("NOT failed")
