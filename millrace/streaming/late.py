"""Late rows kept aside.

Spark's own operators let rows go that come after the watermark has passed their
time. Here a row goes to one of two places instead: a batch's rows are written once,
by whether they are late, in a folder of the batch's number. A batch that is tried
again after a loss writes the same folder anew, so that nothing is lost or doubled.

A row is late if its time is more than ``late`` before the newest time of all earlier
batches. Rows without a time are not late and do not move the newest time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split(stream: DataFrame, time: str, late: str, root: str) -> None:
    """Takes the stream to its end; ``root`` has its rows and its checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max(time).alias("newest"))
        newest = None
        if number:
            before = spark.read.parquet(f"{root}/newest/batch={number - 1}")
            newest = before.first()["newest"]
            now = now.unionByName(before).agg(F.max("newest").alias("newest"))
        now.write.mode("overwrite").parquet(f"{root}/newest/batch={number}")
        mark = F.lit(newest).cast("timestamp") - F.expr(f"interval {late}")
        is_late = F.coalesce(F.col(time) < mark, F.lit(False))
        batch.withColumn("late", is_late).write.mode("overwrite").partitionBy("late").parquet(f"{root}/rows/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
    q.trigger(availableNow=True).start().awaitTermination()


def rows(spark: SparkSession, root: str, stream: DataFrame) -> DataFrame:
    """All rows so far, with batch and late; a filter by either reads only its folders."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields]
    return spark.read.schema(", ".join([*names, "batch long", "late boolean"])).parquet(f"{root}/rows")
