"""Stored rows that are found by a key without reading the others.

Rows lie in files sorted by one key, the path. A small table says which paths each file
begins and ends with, so that a path names its file (two, if it lies across a
border), and in the file the row groups' least and greatest paths name the
group. A second key, the document's name, lies in no order: each row group has a
Bloom filter of its names, and groups that cannot have the one asked for are not read
(their footers are). Many paths at once go to their files by the same table, and
only files that are named are read.

Rows without a path are kept, and no path finds them; so with names. Equal paths are
all found. An empty table finds nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Stored:
    spark: SparkSession
    root: str
    path: str
    uid: str
    files: DataFrame
    """name, low, high: a row a file."""

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def _of(self, names: list[str]) -> DataFrame:
        every = self.rows()
        if not names:
            return every.where(F.lit(False))
        return self.spark.read.schema(every.schema).parquet(*[f"{self.root}/rows/{n}" for n in sorted(names)])

    def by_path(self, path: str) -> DataFrame:
        """The rows of a path, from the files whose range it is in."""
        having = self.files.where(F.lit(path).between(F.col("low"), F.col("high")))
        return self._of([r["name"] for r in having.collect()]).where(F.col(self.path) == path)

    def by_uid(self, uid: str) -> DataFrame:
        """The rows of a name, from the row groups whose filter may have it."""
        return self.rows().where(F.col(self.uid) == uid)

    def by_paths(self, wanted: DataFrame) -> DataFrame:
        """The rows whose path is in the first column of ``wanted``, each once."""
        one = wanted.select(F.col(wanted.columns[0]).alias("__wanted")).where("__wanted IS NOT NULL").distinct()
        ends = [(r["high"], r["low"], r["name"]) for r in self.files.where("high IS NOT NULL").collect()]  # a row a file
        if not ends:
            return self._of([])
        found = _files_of(one, ends)
        names = [r["name"] for r in found.collect()]  # at most a row a file
        return self._of(names).join(one, F.col(self.path) == F.col("__wanted"), "left_semi")


def _files_of(one: DataFrame, ends: list[tuple[str, str, str]]) -> DataFrame:
    """(name) of the files in whose range a wanted path lies, found by bisection."""
    ends.sort(key=lambda e: (e[0].encode(), e[1].encode()))
    highs = [e[0].encode() for e in ends]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for frame in frames:
            for w in frame["__wanted"]:
                key = w.encode()
                i = bisect_left(highs, key)
                while i < len(ends) and ends[i][1].encode() <= key:
                    seen.add(ends[i][2])
                    i += 1
        if seen:
            yield pd.DataFrame({"name": sorted(seen)})

    return one.mapInPandas(search, T.StructType([T.StructField("name", T.StringType())])).distinct()


def build(rows: DataFrame, root: str, path: str, uid: str, per_file: int = 1_000_000, group_bytes: int = 128 << 20, names: int = 1_000_000) -> Stored:
    """Sorts ``rows`` once into files of about ``per_file``. names: how many a row
    group's filter is made for."""
    files = max(1, -(-rows.count() // per_file))
    # equal paths may be more than a file: they are cut by name
    placed = rows.repartitionByRange(files, F.col(path), F.col(uid)).sortWithinPartitions(path, uid)
    writer = placed.write.option("parquet.block.size", group_bytes)
    writer = writer.option(f"parquet.bloom.filter.enabled#{uid}", "true").option(f"parquet.bloom.filter.expected.ndv#{uid}", names)
    writer.option(f"parquet.enable.dictionary#{uid}", "false").parquet(f"{root}/rows")
    stored = rows.sparkSession.read.parquet(f"{root}/rows")
    name = stored.metadataColumn("_metadata")["file_name"].alias("name")
    stored.groupBy(name).agg(F.min(path).alias("low"), F.max(path).alias("high")).coalesce(1).write.parquet(f"{root}/files")
    return opened(rows.sparkSession, root, path, uid)


def opened(spark: SparkSession, root: str, path: str, uid: str) -> Stored:
    return Stored(spark, root, path, uid, spark.read.parquet(f"{root}/files"))
