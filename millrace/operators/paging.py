"""Pages of rows, newest first, from files that are sorted once.

Rows are written in ranges of (seq descending, path), a sorted file each. The index
has a row a file: how many rows it has and its first and last key. A page is found
in it by counting and reads the one or two files that hold its rows; what comes
after a given row is found by that row's key, so that rows that were added before
it meanwhile repeat nothing. Without an index, a page is a sort of all rows.

Rows without a seq come last; equal keys are in any order, so that (seq, path)
should be distinct. An empty table has no pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Held:
    """A file: its rows are numbers begin to begin + count of all."""

    name: str
    begin: int
    count: int
    first: tuple[int, str]
    last: tuple[int, str]


#: A seq that rows without one are sorted by.
NONE = -(1 << 63)


@dataclass
class Pages:
    spark: SparkSession
    root: str
    seq: str
    path: str
    index: list[Held]

    @property
    def total(self) -> int:
        return self.index[-1].begin + self.index[-1].count if self.index else 0

    def _order(self) -> list[Column]:
        return [F.desc_nulls_last(self.seq), F.asc(self.path)]

    def _read(self, files: list[Held]) -> DataFrame:
        whole = self.spark.read.parquet(f"{self.root}/rows")
        if not files:
            return whole.where(F.lit(False))
        return self.spark.read.schema(whole.schema).parquet(*[f"{self.root}/rows/{h.name}" for h in files]).orderBy(*self._order())

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of the page with has_more: whether there is another after it."""
        low, high = number * size, min((number + 1) * size, self.total)
        files = [h for h in self.index if h.begin < high and h.begin + h.count > low]
        rows = self._read(files)
        if files:
            rows = rows.offset(low - files[0].begin).limit(max(high - low, 0))
        return rows.withColumn("has_more", F.lit(high < self.total))

    def after(self, seq: int | None, path: str, size: int) -> DataFrame:
        """The next rows after one with this key."""
        key = (-(NONE if seq is None else seq), path)
        files: list[Held] = []
        for h in self.index:
            # the file of the key, and those after it until there are enough rows
            if h.last > key and sum(x.count for x in files[1:]) < size:
                files.append(h)
        s = F.coalesce(F.col(self.seq), F.lit(NONE))
        later = (s < -key[0]) | ((s == -key[0]) & (F.col(self.path) > path))
        return self._read(files).where(later).limit(size)


def build(rows: DataFrame, root: str, seq: str, path: str, per_file: int = 100_000) -> Pages:
    """Sorts ``rows`` once into files of about ``per_file``; the index is a row a file."""
    spark = rows.sparkSession
    files = max(1, -(-rows.count() // per_file))
    order = [F.desc_nulls_last(seq), F.asc(path)]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{root}/rows")
    return opened(spark, root, seq, path)


def opened(spark: SparkSession, root: str, seq: str, path: str) -> Pages:
    stored = spark.read.parquet(f"{root}/rows")
    key = F.struct((-F.coalesce(F.col(seq).cast("decimal(20,0)"), F.lit(NONE))).alias("k"), F.col(path).alias("p"))
    each = stored.groupBy(stored.metadataColumn("_metadata")["file_name"].alias("name")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    index, begin = [], 0
    for r in sorted(each.collect(), key=lambda r: (int(r["first"]["k"]), r["first"]["p"])):  # a row a file
        index.append(Held(r["name"], begin, r["n"], (int(r["first"]["k"]), r["first"]["p"]), (int(r["last"]["k"]), r["last"]["p"])))
        begin += r["n"]
    return Pages(spark, root, seq, path, index)
