"""The nearest vectors of many by cosine, exactly, in blocks of queries.

Queries are stored first. A task goes through its rows a batch at a time, reads the
queries block by block, and keeps the best ``k`` of each query; Spark keeps the best
of those. A task holds one batch, one block and k rows a query of its batch, so
neither side has to fit in memory, and rows of vectors are not shuffled.

Vectors that are null, of another size than the first query's, or hold a null or
not-a-number take no part; the cosine with a vector of zeros is null and is no
neighbour. Scores are rounded to ``DIGITS`` before they are compared, so that sums in
another order give the same ranks; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

DIGITS = 6
#: Queries that are held against a batch at once.
BLOCK = 1024


def _blocks(path: str) -> Iterator[pa.RecordBatch]:
    where, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    for info in sorted(where.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(BLOCK)


def _units(vectors: pa.Array, size: int) -> np.ndarray:
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.sqrt((v * v).sum(1))[:, None]


def by_cosine(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: for each query (id long, vector) the ``k`` best of ``rows`` (id long, vector)."""
    spark = queries.sparkSession
    first = queries.where("vector IS NOT NULL").select(F.size("vector")).head()
    size = first[0] if first else 0

    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
        return df.select("id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") == size)).where(fine)

    path = scratch(spark, "queries")
    usable(queries).write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, unit = b.column("id").to_numpy(), _units(b.column("vector"), size)
            for block in _blocks(path):
                score = np.round(_units(block.column("vector"), size) @ unit.T, DIGITS)
                score[np.isnan(score)] = -np.inf
                some = min(k, len(ids))
                # all that reach the k-th best score, so that no tie is cut off
                least = np.partition(score, len(ids) - some, axis=1)[:, len(ids) - some]
                q, at = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                order = np.lexsort((ids[at], -score[q, at], q))
                q, at = q[order], at[order]
                begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
                keep = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)])) < k
                q, at = q[keep], at[keep]
                yield pa.RecordBatch.from_arrays([block.column("id").take(pa.array(q)), pa.array(ids[at]), pa.array(score[q, at])], ["query_id", "id", "score"])

    found = usable(rows).mapInArrow(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
