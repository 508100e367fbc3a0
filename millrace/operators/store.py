"""Content sources and chunks: decisions, snapshots, merges and deletes.

A snapshot is two tables. ``sources`` has a row a path (source_path, doc_uid,
source_type, content_hash, chunk_count, status, seq); ``chunks`` has their texts
(doc_uid, chunk_index, chunk_text, is_deleted). Snapshots are written to a new
version folder, and a pointer file written last makes it current, so that
readers see a whole version and a failed write leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, text
from .chunking import exploded


def doc_uid(path: Column) -> Column:
    """A name made of the path, in the form of a UUID; equal in every run."""
    h = F.sha2(path, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def payloads(df: DataFrame, source: Column, url: Column, content: Column, seq: Column) -> DataFrame:
    """seq, source, url, content with its path and hash."""
    out = df.select(seq.alias("seq"), source.alias("source"), url.alias("url"), content.alias("content"))
    return out.withColumns({"source_path": canonical.source_path(F.col("source"), F.col("url")), "content_hash": F.sha2("content", 256)})


def actions(p: DataFrame) -> DataFrame:
    """created, skipped or updated for each payload, by arrival within its path."""
    before = F.lag("content_hash").over(Window.partitionBy("source_path").orderBy("seq"))
    action = F.when(before.isNull(), "created").when(before == F.col("content_hash"), "skipped").otherwise("updated")
    return p.withColumn("action", action)


def latest(p: DataFrame) -> DataFrame:
    """The last payload of each path. seq is one payload's own, so only paths and
    numbers are aggregated, and the payloads meet the last numbers."""
    last = p.groupBy("source_path").agg(F.max("seq").alias("seq"), F.count("*").alias("n_seen"), F.min("seq").alias("first_seq"))
    return p.join(last, ["source_path", "seq"]).select("source_path", *[c for c in p.columns if c != "source_path"], "n_seen", "first_seq")


def newest(p: DataFrame, carried: list[str]) -> DataFrame:
    """(source_path, seq, n_seen, first_seq) and the ``carried`` columns of the last
    payload of each path. For numbers and names: they go through one aggregation and
    the payloads are read once, where ``latest`` reads them twice to move fewer texts."""
    last = p.groupBy("source_path").agg(F.max_by(F.struct("seq", *carried), "seq").alias("last"), F.count("*").alias("n_seen"), F.min("seq").alias("first_seq"))
    return last.select("source_path", "last.*", "n_seen", "first_seq")


def snapshot(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, live chunks) after all payloads."""
    now = latest(p)
    cut = now.select(
        "source_path", doc_uid(F.col("source_path")).alias("doc_uid"), F.col("source").alias("source_type"), "url", "content_hash", F.col("seq").alias("updated_seq"), "content"
    )
    chunks = exploded(cut.select("doc_uid", "content"), text.chunk_words(F.col("content")), "content").withColumn("is_deleted", F.lit(False))
    sources = cut.withColumn("chunk_count", text.chunk_count(F.col("content"))).drop("content").withColumn("status", F.lit("ingested"))
    return sources, chunks


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Old chunks of the documents of ``new`` are flagged, the new ones added."""
    touched = new.select("doc_uid").distinct().withColumn("__touched", F.lit(True))
    old = chunks.join(touched, "doc_uid", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("__touched", F.lit(False))).drop("__touched")
    return old.unionByName(new)


def append_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks numbered on from the stored ones; old totals stay as they were."""
    stored = chunks.where("NOT is_deleted").groupBy("doc_uid").agg(F.count("*").cast("int").alias("__from"))
    on = new.join(stored, "doc_uid", "left").withColumn("__from", F.coalesce("__from", F.lit(0)))
    on = on.withColumns({"chunk_index": F.col("chunk_index") + F.col("__from"), "total_chunks": F.col("total_chunks") + F.col("__from")}).drop("__from")
    return chunks.unionByName(on)


def delete(sources: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources removed, their chunks flagged. ``gone`` has doc_uid."""
    marked = gone.select("doc_uid").distinct()
    flagged = chunks.join(marked.withColumn("__gone", F.lit(True)), "doc_uid", "left")
    return sources.join(marked, "doc_uid", "left_anti"), flagged.withColumn("is_deleted", F.col("is_deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def reconstruct(chunks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Live chunks of each document in order, joined; overlaps stay."""
    live = chunks.where("NOT is_deleted").groupBy("doc_uid").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"), F.count("*").alias("n_live"))
    return live.select("doc_uid", "n_live", F.array_join(F.transform("c", lambda x: x["chunk_text"]), separator).alias("content"))


# ---------------------------------------------------------------- versions


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes a version of all tables and makes it current."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    jvm, new, fs = _files(spark, f"{root}/CURRENT.{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    _, current, _ = _files(spark, f"{root}/CURRENT")
    # one step: a reader sees the old version or the new one
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(current), options)
    _, log, _ = _files(spark, f"{root}/log/{version}")
    out = fs.create(log, True)
    out.write(bytearray(version.encode()))
    out.close()
    return version


def changes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of versions (value) as they are committed."""
    return spark.readStream.text(f"{root}/log")


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{version}/{name}")


# ---------------------------------------------------------------- messages


def new_messages(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages of ``incoming`` (source_url, message_hash, seq, ...) that
    ``stored`` lacks, each hash of a URL once, the first to come."""
    # the first of equal messages by a partial aggregate: a line that a third of all rows say is no one task's
    rest = [c for c in incoming.columns if c not in ("source_url", "message_hash")]
    once = incoming.groupBy("source_url", "message_hash").agg(F.min_by(F.struct(*rest), "seq").alias("__first")).select("source_url", "message_hash", "__first.*")
    return once.join(stored.select("source_url", "message_hash").distinct(), ["source_url", "message_hash"], "left_anti")
