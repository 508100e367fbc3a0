"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors become integers. Tasks index ``SHARD_ROWS`` of their own rows each: a
component's impact is its size in ``LEVELS`` steps up to the shard's largest, and
the rows that have one impact in one dimension, with one sign, are a posting
segment. Segments are stored by descending impact. A shard also has, for each row
and impact, the norm of what segments up to that impact leave of the row.

Queries pass a shard by the block. For each impact in descending order its segments
add weight times impact to the sums of their rows. By Cauchy and Schwarz, what is
left of a row changes its score by at most the norm of the query times what is
left, which gives each sum a bound to either side. The k-th largest lower bound,
or the k-th best score of rows seen before, is a score that k rows are proven to
have; rows whose upper bound is under it cannot be among the k best. When few
enough can, no more segments are read, and those rows are scored exactly from
their integer vectors. Without that proof all segments are read.

A task holds one block of queries at a time, reads query blocks from the shared
folder, and returns at most k rows a query and batch of shards. So neither the
index nor the queries pass the driver or a shuffle; candidates do, for Spark to
keep the k best of each query.

Results for odd input: vectors that are null or hold a null, infinite, NaN or too
large component (``vectors.LIMIT``) take no part; shorter vectors, and empty ones,
count as ending in zeros; a row with a null id is no query but a candidate, after
others at ties; rows that repeat an id are queries and candidates of their own;
with fewer than k candidates a query returns all; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import open_fs, store, work_path
from .vectors import matrix, whole_vectors

SHARD_ROWS, LEVELS = 4096, 16
#: Queries that go through a shard together, and rows of a file group of queries.
QUERIES, QUERY_BLOCK = 128, 4096
#: Members of the result are looked for exactly when at most this share of rows may be some.
FEW = 1 / 64


@dataclass
class Shard:
    """Posting segments by descending impact: rows start[i] to start[i + 1] of
    ``posting`` have weight ``impact[i]`` in dimension ``dim[i]``. The segments up
    to ``until[t]`` are those of impacts LEVELS to LEVELS - t; ``rest[t]`` is then
    the norm of what is left of each row."""

    row: np.ndarray
    ids: pa.Array
    v: np.ndarray
    posting: np.ndarray
    start: np.ndarray
    dim: np.ndarray
    impact: np.ndarray
    until: np.ndarray
    rest: np.ndarray


def index(v: np.ndarray) -> dict[str, np.ndarray]:
    """The index of these vectors, as the fields of a shard."""
    size = np.abs(v.astype(np.int64))
    step = -(-int(size.max(initial=0)) // LEVELS) or 1
    level = -(-size // step)
    row, dim = np.nonzero(level)
    own, sign = level[row, dim], np.where(v[row, dim] < 0, -1, 1)
    # by descending impact, then dimension and sign
    order = np.lexsort((row, sign, dim, -own))
    row, dim, own, sign = row[order], dim[order], own[order], sign[order]
    cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (dim[1:] != dim[:-1]) | (sign[1:] != sign[:-1])]) if len(row) else np.zeros(0, np.int64)
    # the middle of an impact's sizes, which are own * step - step + 1 ... own * step
    impact = sign[cut] * ((2 * own[cut] - 1) * step + 1) // 2
    left, rest, until = v.astype(np.float64), [], []
    ends = np.r_[cut, len(row)]
    for t in range(LEVELS):
        here = slice(*np.searchsorted(-own[cut], [t - LEVELS, t - LEVELS + 1]))
        a, z = ends[here.start], ends[here.stop]
        left[row[a:z], dim[a:z]] -= np.repeat(impact[here], np.diff(ends[here.start : here.stop + 1]))
        rest.append(np.sqrt((left * left).sum(1)))
        until.append(here.stop)
    return {"posting": row.astype(np.int32), "start": ends, "dim": dim[cut].astype(np.int32), "impact": impact, "until": np.array(until), "rest": np.array(rest)}


def members(shard: Shard, queries: np.ndarray, own: np.ndarray, k: int, proven: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, query) pairs that hold the k best rows of each query, and how many
    impacts were read. own: the queries' row numbers; proven: for each query a
    score that k rows are known to reach, or -inf."""
    n = len(shard.row)
    q = queries.astype(np.int64)
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    most = float(np.abs(queries).astype(np.float64).sum(1).max(initial=0)) * float(np.abs(shard.impact).max(initial=0))
    kind = np.int32 if most < 2**31 else np.int64
    weights = np.ascontiguousarray(q.T).astype(kind if most < 2**31 else np.int64)
    sums = np.zeros((n, len(q)), kind)
    itself = np.searchsorted(shard.row, own)
    is_own = itself < n
    is_own[is_own] = shard.row[itself[is_own]] == own[is_own]
    done = 0
    for t in range(LEVELS):
        for i in range(done, int(shard.until[t])):
            rows = shard.posting[shard.start[i] : shard.start[i + 1]]
            # a row is in a segment once
            sums[rows] += kind(shard.impact[i]) * weights[shard.dim[i]]
        done = int(shard.until[t])
        last = t == LEVELS - 1
        if not last and shard.start[done] * 4 < len(shard.posting):
            continue
        slack = np.outer(norm, shard.rest[t]) * (1 + 1e-9) + 1
        sum_t = sums.T.astype(np.float64)
        lower = sum_t - slack
        lower[np.flatnonzero(is_own), itself[is_own]] = -np.inf
        if n >= k:
            proven = np.maximum(proven, np.partition(lower, n - k, axis=1)[:, n - k])
        may = sum_t + slack >= proven[:, None]
        may[np.flatnonzero(is_own), itself[is_own]] = False
        if last or np.count_nonzero(may) <= FEW * may.size:
            at, row = np.nonzero(may)
            return row, at, t + 1
    raise AssertionError


def best(score: np.ndarray, at: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of the k best of each ``at``: by score, then id, null ids last."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), null, -score, at))
    a = at[order]
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)]))
    return order[place < k]


_ARRAYS = [("row", np.int64), ("v", np.int32), ("posting", np.int32), ("start", np.int64), ("dim", np.int32), ("impact", np.int64), ("until", np.int64), ("rest", np.float64)]
_INDEX = "ids array<long>, size int, " + ", ".join(f"{name} binary" for name, _ in _ARRAYS)


def shards(vectors: DataFrame, size: int) -> DataFrame:
    """Stored index, a row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SHARD_ROWS):
                some = b.slice(at, SHARD_ROWS)
                some = some.take(pa.array(np.argsort(some.column("row").to_numpy())))
                v = matrix(some.column("v"), size)
                parts = {"row": some.column("row").to_numpy(), "v": v, **index(v)}
                arrays = [pa.array([np.ascontiguousarray(parts[name], kind).tobytes()], pa.binary()) for name, kind in _ARRAYS]
                ids = pa.array([some.column("id")], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([size], pa.int32()), *arrays], ["ids", "size", *[name for name, _ in _ARRAYS]])

    return store(vectors.sparkSession, vectors.mapInArrow(run, _INDEX), "impact-index")


def _shard(batch: pa.RecordBatch, i: int) -> Shard:
    got = {name: np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in _ARRAYS}
    got["v"] = got["v"].reshape(len(got["row"]), batch.column("size")[i].as_py())
    got["rest"] = got["rest"].reshape(LEVELS, -1)
    return Shard(ids=batch.column("ids")[i].values, **got)


def _query_blocks(path: str) -> Callable[[], Iterator[pa.RecordBatch]]:
    def blocks() -> Iterator[pa.RecordBatch]:
        where, base = open_fs(path)
        names = sorted(f.path for f in where.get_file_info(_selector(base)) if f.path.endswith(".parquet"))
        for name in names:
            with where.open_input_file(name) as f:
                yield from pq.ParquetFile(f).iter_batches(QUERY_BLOCK)

    return blocks


def _selector(base: str):
    from pyarrow import fs

    return fs.FileSelector(base)


def search(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int) -> DataFrame:
    """query_row long, query_id long, rank int, id long, score long: for each row
    where ``is_query`` (a condition on the column ``id``) its k best other rows."""
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vec_col)
    size = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    path = work_path(spark, "queries")
    vectors.where(is_query).write.parquet(path)
    blocks = _query_blocks(path)
    names = ["query_row", "query_id", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [_shard(b, i) for i in range(b.num_rows)]
            for block in blocks():
                whole = matrix(block.column("v"), size)
                for a in range(0, len(whole), QUERIES):
                    yield from of_queries(held, block.slice(a, QUERIES), whole[a : a + QUERIES])

    def of_queries(held: list[Shard], block: pa.RecordBatch, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = block.column("row").to_numpy()
        proven = np.full(len(q), -np.inf)
        score, at, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.int64())
        for shard in held:
            row, to, _ = members(shard, q, own, k, proven)
            exact = np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", shard.v[row[i : i + 8192]], q[to[i : i + 8192]], dtype=np.int64) for i in range(0, len(row), 8192)]])
            score, at = np.r_[score, exact], np.r_[at, to]
            ids = pa.concat_arrays([ids, shard.ids.take(pa.array(row))])
            keep = best(score, at, ids, k)
            score, at, ids = score[keep], at[keep], ids.take(pa.array(keep))
            # kept by query, best first: the last of k is proven
            full = np.flatnonzero(np.bincount(at, minlength=len(q)) == k)
            proven[full] = np.maximum(proven[full], score[np.searchsorted(at, full, "right") - 1])
        yield pa.RecordBatch.from_arrays([block.column("row").take(pa.array(at)), block.column("id").take(pa.array(at)), ids, pa.array(score)], names)

    found = shards(vectors, size).mapInArrow(run, "query_row long, query_id long, id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "id", "score")


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE_SQL = """
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = len(list_filter(embedding, lambda x: isfinite(x::DOUBLE)))),
x AS MATERIALIZED (SELECT rid, vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM kept),
s AS (SELECT q.rid AS query, q.vec_id AS query_id, c.rid, c.vec_id, sum(q.x * c.x)::BIGINT AS score
      FROM x q JOIN x c ON q.i = c.i AND q.rid <> c.rid WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 5
"""
