"""Tables played as streams: rows land in files in the order of their time, a
query takes a file at a time and ends with the last."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .state import rocksdb

#: Files that a table becomes, each a micro-batch.
FILES = 4


def landed(df: DataFrame, order: str, files: int = FILES, part: Column | None = None) -> DataFrame:
    """``df`` as a stream of ``files`` files with ascending ranges of ``order``, or of
    a file for each value of ``part`` (a number, not null), in its order."""
    spark = df.sparkSession
    path = scratch(spark, "landed")
    if part is None:
        df.repartitionByRange(files, order).write.parquet(path)
    else:
        numbered = df.withColumn("__part", part.cast("long"))
        numbered.repartition("__part").sortWithinPartitions("__part", order).write.partitionBy("__part").parquet(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "part-*" if part is None else "__part=*/part-*"))
    names = [s.getPath() for s in found]
    names.sort(key=(lambda p: p.getName()) if part is None else (lambda p: int(p.getParent().getName().split("=")[1])))
    began = int(time.time() * 1000) - 1000 * len(names)
    for i, name in enumerate(names):  # a stream reads the oldest file first
        fs.setTimes(name, began + 1000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).select(df.columns)


def ticked(df: DataFrame, time: str, seconds: int, **values: int) -> DataFrame:
    """``df`` with one more row, ``seconds`` after the last: the clock goes on when
    nothing happens. values: the row's key, and other columns that need one."""
    last = df.agg((F.max(time) + F.expr(f"interval {seconds} seconds")).alias(time))
    return df.unionByName(last.where(F.col(time).isNotNull()).withColumns({k: F.lit(v) for k, v in values.items()}), allowMissingColumns=True)


def replayed(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """All that the query puts out until the stream's files are used up, and before
    if it has run in ``folder``, which then has its output and its checkpoint."""
    spark: SparkSession = stream.sparkSession
    folder = folder or scratch(spark, name)
    out = f"{folder}/out"
    with rocksdb(spark):
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        q.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
