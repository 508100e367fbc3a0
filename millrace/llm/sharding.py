"""Two-pass external shuffle into shards.

Pass one scatters records by a seeded hash of document id and text into buckets
of about ``bucket_bytes``, one task a bucket. Pass two orders a bucket by that
hash (so that the result does not depend on the order of arrival), shuffles it
by Fisher-Yates under a seed of its own, and writes it. Buckets in a row are
the shuffled table; shards are even cuts of it, so that their counts differ by
one at most (law ``rows``). Bucket sizes are counted beforehand, which is one
scan of ids and lengths, and no task holds more than a bucket of twice
``bucket_bytes`` (and one record).

Equal texts scatter, as the document id is part of the hash. Rows that are equal
in id and text hash alike; a bucket that grows past twice its size by them is cut
into parts, among which rows go by their place in the input files. More buckets
than ``most_buckets`` would make too many pairs of tasks for one exchange: records
are then dealt into groups of buckets first, written, and each group is
scattered by itself. Neither changes which bucket a hash is in.

Results for odd input: a null text has size 1 and the checksum of the empty
text, and is written as null; null ids are hashed like any value; repeated rows
each take a slot; an empty table writes no shard and gives an empty result;
other columns are carried along, but ones named shard or slot give way to the
added columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, store, with_place, work_path


def record_hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n) that depends on seed and bucket only."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def write_shards(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 20240501,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = 64 << 20,
    most_buckets: int = 16384,
    path: str | None = None,
) -> DataFrame:
    """Writes ``docs`` as Parquet, a folder a shard, and returns the written table
    with shard int and slot long (a shard's rows from 0 without gaps)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    names, schema = docs.columns, docs.schema
    bucket_col, order_col = fresh("__bucket", names), fresh("__order", names)
    spark = docs.sparkSession
    path = path or work_path(spark, "shards")
    h = record_hash(id_col, text_col, seed)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    hashed = F.pmod(F.xxhash64(F.lit(seed + 1), h), F.lit(buckets)).cast("int")
    # a number for each bucket of memory size: bounded by the input over bucket_bytes
    each = docs.groupBy(hashed.alias("b")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    counts, weight = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in each.toLocalIterator():
        counts[r["b"]], weight[r["b"]] = r["n"], r["bytes"]
    parts = np.where(weight > 2 * bucket_bytes, -(-weight // bucket_bytes), 1)
    first = np.r_[0, np.cumsum(parts)]
    bucket = hashed
    if len(counts) != first[-1]:
        # buckets that equal rows make too large: a row for each, at most one for bucket_bytes of input
        large = np.flatnonzero(parts > 1)
        cut = spark.createDataFrame([(int(i), int(parts[i])) for i in large], "b int, parts int")
        starts = spark.createDataFrame([(i, int(v)) for i, v in enumerate(first[:-1])], "b int, first int")
        docs, file, row = with_place(docs)
        number = fresh("__number", docs.columns)
        of = F.broadcast(starts.join(cut, "b", "left").select(F.col("b").alias(number), "first", F.coalesce("parts", F.lit(1)).alias("parts")))
        placed = docs.withColumn(number, hashed).join(of, number)
        bucket = (F.col("first") + F.pmod(F.xxhash64(F.lit(seed + 2), file, row), F.col("parts"))).cast("int")
        docs = placed.withColumn(bucket_col, bucket).select(*names, bucket_col)
        bucket = F.col(bucket_col)
        buckets = int(first[-1])
        counts = np.zeros(buckets, np.int64)
        for r in docs.groupBy(bucket.alias("b")).count().toLocalIterator():
            counts[r["b"]] = r["count"]
    base = np.r_[0, np.cumsum(counts)]
    n = int(base[-1])
    # shard s has rows [cut[s], cut[s + 1]) of the shuffled table
    edges = np.array([n * s // shards for s in range(shards + 1)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        del held
        number = t.column(bucket_col)[0].as_py()
        rank = base[number] + np.arange(t.num_rows)
        t = t.take(pa.array(fisher_yates(t.num_rows, seed, number))).select(names)
        shard = np.searchsorted(edges, rank, "right") - 1
        t = t.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(rank - edges[shard]))
        yield from t.to_batches(max_chunksize=2000)

    dealt = docs.withColumns({bucket_col: bucket, order_col: h})
    out = T.StructType([*schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def scatter(rows: DataFrame, start: int, number: int) -> None:
        one = rows.repartitionById(number, F.col(bucket_col) - start)
        one.sortWithinPartitions(order_col, id_col, text_col).mapInArrow(run, out).write.mode("append").partitionBy("shard").parquet(path)

    if buckets <= most_buckets:
        scatter(dealt, 0, buckets)
    else:
        group = fresh("__group", dealt.columns)
        grouped = dealt.withColumn(group, F.floor(F.col(bucket_col) / most_buckets).cast("int"))
        # few files for a group in each task, and no group in one task
        tasks = -(-buckets // 16)
        grouped = store(spark, grouped.repartition(tasks, F.col(group), F.pmod(F.col(bucket_col), F.lit(most_buckets // 16 + 1))), "shard-groups", partition_by=(group,))
        for start in range(0, buckets, most_buckets):
            scatter(grouped.where(F.col(group) == start // most_buckets).drop(group), start, min(most_buckets, buckets - start))
    return spark.read.schema(out).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = write_shards(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
