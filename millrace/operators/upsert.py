"""Payloads against what is stored: decisions, responses, merged sources and chunks.

Stored sources have one row a path: source_path, doc_uid, source_type,
content_hash, chunk_count, updated_seq. Decisions need paths and hashes only;
contents meet them by seq, and only those that are stored anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.payloads import parse_payloads
from . import chunking, store

#: What a response says of unchanged content, by where its equal was found.
SAME_IN_BATCH, SAME_IN_STORE = "Content unchanged (cache)", "Content unchanged (db)"


def decide(p: DataFrame, sources: DataFrame) -> DataFrame:
    """(seq, source_path, content_hash, doc_uid, action, message) for each payload,
    as if they came one after the other: against the payload before it on its
    path, the first one against what is stored."""
    thin = p.select("seq", "source_path", "content_hash")
    known = sources.select("source_path", F.col("doc_uid").alias("stored_uid"), F.col("content_hash").alias("stored_hash"))
    both = thin.join(known, "source_path", "left")
    before = F.lag("content_hash").over(Window.partitionBy("source_path").orderBy("seq"))
    last = F.coalesce(before, F.col("stored_hash"))
    action = F.when(last.isNull(), "created").when(last == F.col("content_hash"), "skipped").otherwise("updated")
    out = both.select(
        "seq", "source_path", "content_hash", F.coalesce("stored_uid", store.doc_uid(F.col("source_path"))).alias("doc_uid"), action.alias("action"),
        F.when(before.isNull(), SAME_IN_STORE).otherwise(SAME_IN_BATCH).alias("same"),
    )
    return out.withColumn("message", F.when(F.col("action") == "skipped", F.col("same"))).drop("same")


def responses(p: DataFrame, decided: DataFrame) -> DataFrame:
    """(seq, action, line): a JSON line for each payload; order by seq to write them.
    Payloads with an error fail with its text."""
    count = chunking.count(F.col("content"))
    sized = p.select("seq", "content").withColumn("n", count).drop("content")
    told = decided.join(sized, "seq").where("action <> 'skipped'").select("seq", "n")
    r = decided.join(told, "seq", "left")
    stored = F.col("action") != "skipped"
    line = F.to_json(
        F.struct(F.lit("ok").alias("status"), "action", F.when(stored, F.col("doc_uid")).alias("doc_uid"), F.when(stored, F.col("n")).alias("chunk_count"), "message")
    )
    return r.select("seq", "action", line.alias("line"))


def failures(parsed: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, action, line) of lines that are no payload."""
    line = F.to_json(F.struct(F.lit("error").alias("status"), F.lit("failed").alias("action"), F.col("error").alias("message")))
    return parsed.where("error IS NOT NULL").select(F.col(seq).alias("seq"), F.lit("failed").alias("action"), line.alias("line"))


@dataclass
class Merged:
    sources: DataFrame
    chunks: DataFrame
    responses: DataFrame


def merge(p: DataFrame, sources: DataFrame, chunks: DataFrame) -> Merged:
    """What is stored after all payloads: of a path with new content the last
    payload's, with its old document name; chunks of older content are flagged."""
    decided = decide(p, sources)
    changed = decided.where("action <> 'skipped'").groupBy("source_path").agg(F.max("seq").alias("seq"))
    last = decided.join(changed, ["source_path", "seq"]).select("seq", "source_path", "doc_uid", "content_hash")
    # an earlier change that the last one undid leaves the stored content as it was
    known = sources.select("source_path", F.col("content_hash").alias("stored_hash"))
    last = last.join(known, "source_path", "left").where("NOT coalesce(content_hash = stored_hash, false)").drop("stored_hash")
    fresh = p.select("seq", "source", "content").join(last, "seq")
    new_chunks = chunking.chunks(fresh.select("doc_uid", "content"), "doc_uid", "content").withColumn("is_deleted", F.lit(False))
    new_sources = fresh.select(
        "source_path", "doc_uid", F.col("source").alias("source_type"), "content_hash", chunking.count(F.col("content")).alias("chunk_count"), F.col("seq").alias("updated_seq")
    )
    return Merged(upsert(sources, new_sources), store.replace_chunks(chunks, new_chunks), responses(p, decided))


def store_lines(lines: DataFrame, sources: DataFrame, chunks: DataFrame) -> Merged:
    """JSON lines (seq, value) into what is stored: bad ones get a failed response,
    the others are merged in the order of seq."""
    parsed = parse_payloads(lines)
    good = parsed.where("error IS NULL")
    m = merge(store.payloads(good, F.col("source"), F.col("url"), F.col("content"), F.col("seq")), sources, chunks)
    return Merged(m.sources, m.chunks, m.responses.unionByName(failures(parsed)))


def upsert(sources: DataFrame, new: DataFrame) -> DataFrame:
    """``sources`` with the rows of ``new`` in the place of those of their path; the
    document's name and type stay as they were."""
    old = sources.select("source_path", F.col("doc_uid").alias("old_uid"), F.col("source_type").alias("old_type"))
    kept = new.join(old, "source_path", "left").select(
        "source_path", F.coalesce("old_uid", "doc_uid").alias("doc_uid"), F.coalesce("old_type", "source_type").alias("source_type"), "content_hash", "chunk_count", "updated_seq"
    )
    names = kept.columns
    return sources.select(*names).join(new.select("source_path"), "source_path", "left_anti").select(*names).unionByName(kept)


def by_path(sources: DataFrame, path: str) -> DataFrame:
    """A filter that reaches the scan."""
    return sources.where(F.col("source_path") == path)


def by_document(rows: DataFrame, uid: str) -> DataFrame:
    return rows.where(F.col("doc_uid") == uid)


def json_number(meta: Column, path: str) -> Column:
    """A number in a JSON field: as text, 10 would come before 2."""
    return F.get_json_object(meta, path).try_cast("int")


def pages_together(*pages: DataFrame) -> DataFrame:
    """Pages in a row, as they were loaded; rows that are on two stay twice."""
    out = None
    for i, page in enumerate(pages):
        own = page.withColumn("page", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def unrepeated(rows: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """Rows whose content differs from the row before it of their key. (What was
    passed on last is what was seen last, so that ``lag`` is enough.)"""
    w = Window.partitionBy(*keys).orderBy(*order)
    h = F.sha2(content, 256)
    return rows.withColumn("__h", h).withColumn("__b", F.lag("__h").over(w)).where("NOT (__h <=> __b)").drop("__h", "__b")


def disorder(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n_pairs, n_wrong): adjacent pairs whose second value is smaller."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pairs = rows.withColumn("__next", F.lead(value).over(w)).where("__next IS NOT NULL")
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("__next") < F.col(value)).alias("n_wrong"))


def rebuilt(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """(source_url, n_messages, content, content_hash, chunk_count, status): each
    URL's text from all its messages by time (message_order, then seq).
    stored: source_url, content_hash. status: New, Updated or Duplicate."""
    parts = F.array_sort(F.collect_list(F.struct("message_order", "seq", "m")))
    g = messages.groupBy("source_url").agg(parts.alias("parts"), F.count("*").alias("n_messages"))
    content = F.array_join(F.transform("parts", lambda x: x["m"]), "\n")
    c = g.select("source_url", "n_messages", content.alias("content")).withColumn("content_hash", F.sha2("content", 256))
    j = c.join(stored.select("source_url", F.col("content_hash").alias("stored_hash")), "source_url", "left")
    status = F.when(F.col("stored_hash").isNull(), "New").when(F.col("stored_hash") == F.col("content_hash"), "Duplicate").otherwise("Updated")
    return j.select("source_url", "n_messages", "content", "content_hash", text.chunk_count(F.col("content")).alias("chunk_count"), status.alias("status"))
