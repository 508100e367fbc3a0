"""What live state did, batch by batch, read from the state's own record of changes.

A query whose state is stored by its changes (``state.rocksdb``) leaves, for each
batch, which keys were written and which went. Counts are worked out of that: a
running query is not asked, state is not read whole for each batch, and what has
ended can be looked at later, as far back as batches are kept
(``spark.sql.streaming.minBatchesToRetain``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .state import held


def changes(spark: SparkSession, checkpoint: str, since: int = 0) -> DataFrame:
    """(key, batch, put, gone): whether a batch wrote a key's value and whether it
    ended it. Input comes before timers, so that of both the end is what stays."""
    feed = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held")
    rows = feed.option("readChangeFeed", True).option("changeStartBatchId", since).load()
    put = F.max(F.col("change_type") == "update").alias("put")
    gone = F.max(F.col("change_type") == "delete").alias("gone")
    return rows.groupBy(F.col("user_map_key").alias("key"), F.col("batch_id").alias("batch")).agg(put, gone)


def counts(spark: SparkSession, checkpoint: str, since: int = 0) -> DataFrame:
    """(batch, written, added, evicted, entries) of each batch from ``since`` on that
    changed anything. added: keys that had no value; evicted: those whose value ended;
    entries: values held after the batch."""
    each = changes(spark, checkpoint, since)
    if since:
        earlier = held(spark, checkpoint, since - 1).select("key", F.lit(since - 1).cast("long").alias("batch"), F.lit(True).alias("put"), F.lit(False).alias("gone"))
        each = each.unionByName(earlier)
    there = F.col("put") & ~F.col("gone")
    before = F.coalesce(F.lag(there).over(Window.partitionBy("key").orderBy("batch")), F.lit(False))
    known = each.withColumn("before", before)
    added, evicted = F.col("put") & ~F.col("before"), F.col("gone") & (F.col("put") | F.col("before"))
    per = known.groupBy("batch").agg(F.count_if("put").alias("written"), F.count_if(added).alias("added"), F.count_if(evicted).alias("evicted"))
    # a row a batch that is kept: not many
    total = F.sum(F.col("added") - F.col("evicted")).over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("entries", total).where(F.col("batch") >= since)
