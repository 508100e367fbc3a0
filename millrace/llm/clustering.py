"""Lloyd's algorithm on whole numbers, with ball trees that assign points by the ball.

Vectors become integers, and tasks build metric trees of their own rows: a
ball has a centre, the radius around it, its number of vectors and their integer
sum. In a round, a task takes each tree from its root: a ball whose farthest point
is nearer to one centroid than its nearest point can be to any other (by the
triangle inequality, with a margin for rounding) goes to that centroid whole, by
count and sum; otherwise only the centroids that may still win go down to its
children, and at a leaf exact integer distances decide. A ball of radius 0, such as
copies of one vector, is one point however many it holds.

Trees are built once and stored, ``TREE_ROWS`` vectors each; a round reads them, and
returns a count and a sum for each centroid and task. Spark adds these up; only
centroids (``k``, a parameter) reach the driver or travel to tasks. No vector is
shuffled. Sums are decimals of 38 digits, means exact floors.

Results for odd input: vectors that are null, of another size, or hold a null,
infinite, NaN or too large component (``vectors.LIMIT``) take no part; equal
vectors and repeated ids are rows of their own; rows with a null id are
clustered but start no cluster unless fewer others than clusters are left; ties go to the smaller
number; with fewer vectors than clusters there are as many clusters as vectors; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store
from .vectors import matrix, whole_vectors

TREE_ROWS, LEAF = 8192, 32
#: Relative margin of distances worked out in floating point.
MARGIN = 1e-9


@dataclass
class Tree:
    """Vectors in the order of the tree, and its balls: those of ball i are rows
    first[i] to last[i]; children are i's left[i] and left[i] + 1, none if 0."""

    v: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    most = int(max(abs(int(m)) for x in (a, b) if x.size for m in (x.min(), x.max())) if a.size and b.size else 0)
    if a.shape[1] * (2 * most) ** 2 < 2**53:  # then sums of products are exact in doubles too
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((a.astype(np.int64) - c) ** 2).sum(1) for c in b.astype(np.int64)], 1)


def build(v: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The order of rows and the tree of these vectors."""
    order = np.arange(len(v))
    first, last, left, centre, radius, total = [0], [len(v)], [], [], [], []
    at = 0
    while at < len(first):
        own = v[order[first[at] : last[at]]].astype(np.int64)
        total.append(own.sum(0))
        centre.append(total[-1] // len(own))
        away = squared(own, centre[-1][None])[:, 0]
        far = int(away.max())
        radius.append(float(np.sqrt(float(far))) * (1 + MARGIN))
        if len(own) <= LEAF or far == 0:
            left.append(0)
        else:
            # split half and half along the line between two far points
            one = own[int(away.argmax())]
            other = own[int(squared(own, one[None])[:, 0].argmax())]
            along = own.astype(np.float64) @ (other - one).astype(np.float64)
            half = len(own) // 2
            order[first[at] : last[at]] = order[first[at] : last[at]][np.argpartition(along, half)]
            left.append(len(first))
            first += [first[at], first[at] + half]
            last += [first[at] + half, last[at]]
        at += 1
    return order, Tree(v[order], np.array(first), np.array(last), np.array(left), np.array(centre), np.array(radius), np.array(total))


def assign(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Balls that go to one centroid whole, and single rows: yields (balls,
    centroid of each, none) and (rows, centroid of each, squared distance)."""
    balls, may = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(balls):
        d = np.sqrt(squared(tree.centre[balls], centroids).astype(np.float64))
        r = tree.radius[balls][:, None]
        slack = MARGIN * (d + r)
        farthest = np.where(may, d + r + slack, np.inf).min(1, keepdims=True)
        may &= d - r - slack <= farthest
        one = may.sum(1) == 1
        yield balls[one], may[one].argmax(1), np.zeros(0, np.int64)
        balls, may = balls[~one], may[~one]
        leaf = tree.left[balls] == 0
        for b, m in zip(balls[leaf].tolist(), may[leaf], strict=True):
            a, z = int(tree.first[b]), int(tree.last[b])
            some = np.flatnonzero(m)
            same = tree.radius[b] == 0
            exact = squared(tree.v[a : a + 1] if same else tree.v[a:z], centroids[some])
            best = exact.argmin(1)  # the first of equals, and some ascends
            near = exact[np.arange(len(best)), best]
            n = z - a if same else 1
            yield np.arange(a, z), np.repeat(some[best], n), np.repeat(near, n)
        down = tree.left[balls[~leaf]]
        balls, may = np.r_[down, down + 1], np.r_[may[~leaf], may[~leaf]]


def _tree_rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Tree]]:
    for ids, n, size, v, *own in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
        n, size = n.as_py(), size.as_py()
        kinds = [("first", np.int64), ("last", np.int64), ("left", np.int64), ("centre", np.int64), ("radius", np.float64), ("total", np.int64)]
        got = {name: np.frombuffer(b.as_buffer(), kind) for (name, kind), b in zip(kinds, own, strict=True)}
        for name in ("centre", "total"):
            got[name] = got[name].reshape(-1, size)
        yield ids.values, Tree(v=np.frombuffer(v.as_buffer(), np.int32).reshape(n, size), **got)


_TREES = "ids array<long>, n int, size int, v binary, first binary, last binary, left binary, centre binary, radius binary, total binary"


def trees(vectors: DataFrame, size: int) -> DataFrame:
    """Stored trees of the rows of each task."""
    names = ["ids", "n", "size", "v", "first", "last", "left", "centre", "radius", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TREE_ROWS):
                some = b.slice(at, TREE_ROWS)
                order, t = build(matrix(some.column("v"), size))
                ids = pa.array([some.column("id").take(pa.array(order))], pa.list_(pa.int64()))
                parts = [t.v.astype(np.int32), t.first, t.last, t.left, t.centre, t.radius, t.total]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(order)], pa.int32()), pa.array([size], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names)

    return store(vectors.sparkSession, vectors.select("id", "v").mapInArrow(run, _TREES), "trees")


def round_sums(stored: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that has any: its number of vectors and their exact sum."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
            for _, tree in _tree_rows(b):
                for at, to, near in assign(tree, centroids):
                    whole = not len(near)
                    np.add.at(n, to, tree.last[at] - tree.first[at] if whole else 1)
                    np.add.at(s, to, tree.total[at] if whole else tree.v[at])
            have = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(n[have]), pa.array(list(s[have]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(20,0)"))

    found = stored.mapInArrow(run, "cluster int, n long, s array<long>").groupBy("cluster")
    rows = found.agg(total(F.col("n")).alias("n"), F.array(*[total(F.col("s")[i]) for i in range(size)]).alias("s")).collect()
    return {r["cluster"]: (int(r["n"]), [int(x) for x in r["s"]]) for r in rows}


def assigned(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id long, cluster int, distance long (squared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, tree in _tree_rows(b):
                cluster, distance = np.zeros(len(tree.v), np.int32), np.zeros(len(tree.v), np.int64)
                for at, to, near in assign(tree, centroids):
                    if len(near):
                        cluster[at], distance[at] = to, near
                        continue
                    for ball, c in zip(at.tolist(), to.tolist(), strict=True):
                        own = slice(int(tree.first[ball]), int(tree.last[ball]))
                        cluster[own], distance[own] = c, squared(tree.v[own], centroids[c : c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return stored.mapInArrow(run, "id long, cluster int, distance long")


def cluster(df: DataFrame, id_col: str, vec_col: str, k: int, rounds: int, size: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """Stored (id, cluster, distance) of every vector, and the final centroids.
    They start as the vectors with the least hashes of seed and id."""
    vectors = whole_vectors(df, id_col, vec_col, size)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, size)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    stored = trees(vectors, size)
    for _ in range(rounds):
        for c, (n, s) in round_sums(stored, centroids).items():
            centroids[c] = [x // n for x in s]
    return store(df.sparkSession, assigned(stored, centroids), "clusters"), centroids


def op12_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", k=40, rounds=5, size=64, seed=2)
    # a row a cluster
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.withColumnRenamed("id", "vec_id").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    rounds = ["""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = 64),
x AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(v) AS m FROM (SELECT v, row_number() OVER (ORDER BY h) - 1 AS c FROM (SELECT v, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT 40)))"""]  # fmt: skip
    nearest = "SELECT rid, c, d FROM (SELECT rid, c, sum((x - m) * (x - m))::BIGINT AS d FROM x JOIN c{0} USING (i) GROUP BY rid, c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1"
    for r in range(5):
        rounds.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
        rounds.append(f"s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} JOIN x USING (rid) GROUP BY c, i)")
        floor = "CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END"
        rounds.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN m ELSE {floor} END AS m FROM c{r} LEFT JOIN s{r} USING (c, i))")
    rounds.append(f"a5 AS MATERIALIZED ({nearest.format(5)})")
    rounds.append("g AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY c)")
    return ",\n".join(rounds) + """
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN kept USING (rid) JOIN g USING (c)
"""


ORACLE_SQL = _oracle()
