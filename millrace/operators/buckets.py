"""Stored sources and chunks in buckets of their path.

A merge reads and writes the buckets that its payloads fall into and leaves the
other files alone, so that its bytes follow the payloads and not the store. A state
of the store is a small file, numbered from 0, that says for each bucket which
folder holds it. A writer makes the next number from the last one it knows; if
another writer had that number first, and has changed none of the same buckets,
the work stands and goes on top of theirs, otherwise it is done again from there.
So no writer's rows are lost, and a reader sees one state of all buckets.

Folders of older states stay until they are removed by hand; ``stored_changes``
(sources/changes.py) reads what changed from one state to the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from . import store, upsert

BUCKETS = 64
TABLES = ("sources", "chunks")
SOURCE = ["source_path", "doc_uid", "source_type", "content_hash", "chunk_count", "updated_seq"]

Tables = tuple[DataFrame, DataFrame]


def bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    _, p, fs = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last state, -1 if there is none."""
    return max((int(n) for n in _names(spark, f"{root}/states") if n.isdigit()), default=-1)


def state(spark: SparkSession, root: str, number: int) -> dict:
    jvm, p, fs = _hadoop(spark, f"{root}/states/{number:09d}")
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put(spark: SparkSession, root: str, number: int, value: dict) -> bool:
    """Whether this became the state of that number. It is written aside and
    renamed, which fails where the name is taken."""
    jvm, aside, fs = _hadoop(spark, f"{root}/aside/{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    _, p, _ = _hadoop(spark, f"{root}/states/{number:09d}")
    fs.mkdirs(p.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(p), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if "already exists" in str(e):
            return False
        raise
    return True


def read(spark: SparkSession, root: str, name: str, number: int | None = None, only: list[int] | None = None) -> DataFrame:
    """A table as of a state (the last one), with its bucket; ``only`` some buckets of it."""
    known = state(spark, root, latest(spark, root) if number is None else number)
    schema = T.StructType([*T.StructType.fromJson(known["schema"][name]).fields, T.StructField("bucket", T.IntegerType())])
    by_folder: dict[str, list[str]] = {}
    for b, folder in known[name].items():
        if only is None or int(b) in only:
            by_folder.setdefault(folder, []).append(b)
    out = spark.createDataFrame([], schema)
    for folder, own in sorted(by_folder.items()):
        base = f"{root}/{folder}/{name}"
        out = out.unionByName(spark.read.option("basePath", base).schema(schema).parquet(*[f"{base}/bucket={b}" for b in own]))
    return out


def _write(spark: SparkSession, root: str, sources: DataFrame, chunks: DataFrame) -> str:
    folder = uuid.uuid4().hex
    for name, df in zip(TABLES, (sources, chunks), strict=True):
        df.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}/{name}")
    return folder


def _found(spark: SparkSession, root: str, folder: str, name: str) -> dict[str, str]:
    return {n.removeprefix("bucket="): folder for n in _names(spark, f"{root}/{folder}/{name}") if n.startswith("bucket=")}


def create(spark: SparkSession, root: str, sources: DataFrame, chunks: DataFrame, buckets: int = BUCKETS) -> None:
    """State 0. Chunks go with the source of their document."""
    s = sources.select(*SOURCE).withColumn("bucket", bucket(F.col("source_path"), buckets))
    c = chunks.join(s.select("doc_uid", "bucket"), "doc_uid")
    folder = _write(spark, root, s, c)
    made = {"buckets": buckets, "schema": {"sources": s.drop("bucket").schema.jsonValue(), "chunks": c.drop("bucket").schema.jsonValue()}}
    if not _put(spark, root, 0, made | {n: _found(spark, root, folder, n) for n in TABLES}):
        raise FileExistsError(f"{root} has a store")


def change(spark: SparkSession, root: str, paths: DataFrame, make: Callable[[DataFrame, DataFrame], Tables], before: Callable[[], None] = lambda: None) -> int:
    """``make`` over the sources and chunks of all buckets that ``paths``
    (source_path) fall into; returns the number of the new state. ``before`` runs
    ahead of the first try to become it."""
    made = since = None
    while True:
        number = latest(spark, root)
        base = state(spark, root, number)
        if made is None or any(base[n].get(b) != since[n].get(b) for n in TABLES for b in map(str, touched)):
            # numbers of buckets, of which there are few
            touched = sorted(r[0] for r in paths.select(bucket(F.col("source_path"), base["buckets"])).distinct().collect())
            sources, chunks = (read(spark, root, n, number, touched) for n in TABLES)
            new_sources, new_chunks = make(sources.drop("bucket"), chunks.drop("bucket"))
            new_sources = new_sources.select(*SOURCE).withColumn("bucket", bucket(F.col("source_path"), base["buckets"]))
            # a document's chunks stay in their bucket, those of a new one go with its source
            home = new_sources.select("doc_uid", "bucket").unionByName(chunks.select("doc_uid", "bucket")).distinct()
            made, since = _write(spark, root, new_sources, new_chunks.join(home, "doc_uid")), base
            before()
        new = dict(base)
        for n in TABLES:
            new[n] = {b: f for b, f in base[n].items() if int(b) not in touched} | _found(spark, root, made, n)
        if _put(spark, root, number + 1, new):
            return number + 1


def merge(spark: SparkSession, root: str, p: DataFrame, before: Callable[[], None] = lambda: None) -> DataFrame:
    """Payloads into the store; their responses, stored."""
    out = ""

    def make(sources: DataFrame, chunks: DataFrame) -> Tables:
        nonlocal out
        m = upsert.merge(p, sources, chunks)
        out = scratch(spark, "responses")
        m.responses.write.parquet(out)
        return m.sources, m.chunks

    change(spark, root, p.select("source_path"), make, before)
    return spark.read.parquet(out)


def delete(spark: SparkSession, root: str, paths: DataFrame) -> int:
    """Sources of these paths go, their chunks are flagged."""

    def make(sources: DataFrame, chunks: DataFrame) -> Tables:
        return store.delete(sources, chunks, sources.join(paths.select("source_path").distinct(), "source_path", "left_semi"))

    return change(spark, root, paths, make)


