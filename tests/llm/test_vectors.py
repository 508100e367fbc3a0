"""Clusters by ball trees and impact-ordered search against plain loops over whole integers."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import clustering, impact_search

KIND = "vec_id long, embedding array<float>, label int, cluster string, `row` int, id string, v string"


def rounded(x):
    return None if x is None or any(c is None or not math.isfinite(c) for c in x) else [math.floor(256 * c) for c in x]


@pytest.fixture(scope="module")
def odd_vectors():
    """Nulls, not-a-numbers, other sizes, copies, repeated and null ids, hot copies, ties."""
    rng = random.Random(5)
    f = lambda x: float(np.float32(x))
    draw = lambda n=64: [f(rng.gauss(0, 0.125)) for _ in range(n)]
    rows = [(i, draw()) for i in range(420)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # copies: whole balls, ties
    rows += [(50, draw()), (50, rows[50][1]), (None, draw()), (None, rows[7][1]), (2000, None), (2050, []), (2100, draw(63)), (2150, draw(65))]
    rows += [(2200, [float("nan"), *draw(63)]), (2250, [None, *draw(63)]), (2300, [float("inf"), *draw(63)]), (2350, [f(1e30), *draw(63)]), (-50, [f(2.0**18)] * 64), (2400, [0.0] * 64)]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, odd_vectors, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, v, 1, "c", 2, "x", "y") for i, v in odd_vectors], KIND).repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d


def fits(v):
    return v is not None and all(abs(c) < 1 << 27 for c in v)


def test_op12_against_plain_rounds(spark, sf_dir, odd_vectors):
    kept = [(i, v) for i, x in odd_vectors if fits(v := rounded(x)) and len(v) == 64]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(v) for _, v in sorted(kept, key=key)[:40]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(5):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, own in groups.items():
            centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    final = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in final if m == n) for n in range(40)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = [(i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in final]
    got = clustering.op12_ball_clusters(spark, sf_dir)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_op13_against_plain_loops(spark, sf_dir, odd_vectors):
    kept = [(i, v) for i, x in odd_vectors if fits(v := rounded(x))]
    want = []
    for n, (i, q) in enumerate(kept):
        if i is not None and i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for m, (j, v) in enumerate(kept) if m != n)[:5]
            want += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(found)]
    got = impact_search.op13_impact_search(spark, sf_dir)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_small_and_empty_tables(spark, sf_dir, tmp_path):
    whole = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for name, n in (("none", 0), ("one", 1), ("three", 3)):
        whole.where("vec_id in (100, 150, 201)").orderBy("vec_id").limit(n).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        clusters = clustering.op12_ball_clusters(spark, f"{tmp_path}/{name}").collect()
        assert sorted(r.cluster for r in clusters) == list(range(n)) and all(r.distance == 0 for r in clusters)
        found = impact_search.op13_impact_search(spark, f"{tmp_path}/{name}").collect()
        assert len(found) == {0: 0, 1: 0, 3: 4}[n]


def test_tight_balls_go_whole_and_ties_do_not():
    """Separated groups are decided by balls; few rows are looked at one by one."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (8, 16))
    v = (centres[rng.integers(0, 8, 6000)] + rng.integers(-3, 4, (6000, 16))).astype(np.int32)
    order, tree = clustering.build(v)
    assert sorted(order.tolist()) == list(range(6000)) and (tree.v == v[order]).all()
    whole = singly = 0
    for at, _, near in clustering.assign(tree, centres):
        whole += 0 if len(near) else int((tree.last[at] - tree.first[at]).sum())
        singly += len(near)
    assert whole + singly == 6000 and singly < 600
    # two centroids at one distance: the smaller number, though the ball is far smaller than the distance
    _, tree = clustering.build(np.zeros((100, 16), np.int32))
    ((_, to, near),) = [x for x in clustering.assign(tree, np.array([[3] * 16, [-3] * 16])) if len(x[2])]
    assert set(to.tolist()) == {0} and set(near.tolist()) == {144} and len(to) == 100


def test_large_components_are_exact():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-(1 << 27), 1 << 27, (5, 64)), rng.integers(-(1 << 27), 1 << 27, (3, 64))
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert clustering.squared(a, b).tolist() == want


@pytest.mark.parametrize("kind", ["grouped", "sparse", "dense", "zero", "large"])
def test_members_hold_all_of_the_best_and_stop_early(kind):
    rng = np.random.default_rng(3)
    v = {
        "grouped": np.repeat(rng.choice([-100, 100], (90, 64)), 10, 0) + rng.integers(-3, 4, (900, 64)),
        "dense": rng.integers(-120, 120, (900, 24)),
        "sparse": rng.integers(0, 50, (900, 24)) ** 3 * (rng.random((900, 24)) < 0.1),
        "zero": np.zeros((900, 24), np.int64),
        "large": rng.integers(-(1 << 26), 1 << 26, (900, 24)),
    }[kind].astype(np.int32)
    shard = impact_search.Shard(row=np.arange(900), ids=pa.array(range(900)), v=v, **impact_search.index(v))
    q = v[:60]
    row, at, read = impact_search.members(shard, q, np.arange(60), 5, np.full(60, -np.inf))
    got = set(zip(at.tolist(), row.tolist(), strict=True))
    score = q.astype(np.int64) @ v.astype(np.int64).T
    for i in range(60):
        rest = sorted((-int(s), j) for j, s in enumerate(score[i]) if j != i)
        fifth = -rest[4][0]
        assert (i, i) not in got and all((i, j) in got for s, j in rest if -s >= fifth)
    if kind == "grouped":
        assert read < impact_search.LEVELS and len(got) < 60 * 10  # proven before all segments were read
    # what rows seen before have proven prunes more
    high = np.full(60, 4.0 * float(score.max()) + 100)
    assert not len(impact_search.members(shard, q, np.arange(60), 5, high)[0])


def test_postings_by_descending_impact():
    v = np.random.default_rng(6).integers(-99, 99, (50, 4)).astype(np.int32)
    got = impact_search.index(v)
    sizes = np.abs(got["impact"])
    assert (sizes[:-1] >= sizes[1:]).all() and got["until"][-1] == len(got["impact"]) and len(got["posting"]) == np.count_nonzero(v)
    for i, (a, z) in enumerate(zip(got["start"][:-1], got["start"][1:], strict=True)):
        own = v[got["posting"][a:z], got["dim"][i]]
        assert len(set(got["posting"][a:z].tolist())) == z - a and (np.abs(own - got["impact"][i]) <= 7).all()
