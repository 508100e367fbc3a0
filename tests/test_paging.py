"""Pages by their index, and the nearest vectors, against sorted lists."""

import math
import random

import pytest

from millrace.operators import nearest, paging


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    rows = [(rng.choice([None, 0, -3, *range(500)]), f"p{i:04d}é" if i % 7 else f"p{i:04d}") for i in range(1003)]
    return rows, sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))


@pytest.fixture(scope="module")
def pages(spark, made, tmp_path_factory):
    df = spark.createDataFrame(made[0], "seq long, path string").repartition(5)
    return paging.build(df, str(tmp_path_factory.mktemp("pages") / "t"), "seq", "path", per_file=90)


def test_pages_read_one_or_two_files(made, pages):
    ordered = made[1]
    assert pages.total == 1003 and len(pages.index) >= 8
    for n in (0, 3, 17, 50, 100, 101):
        page = pages.page(n, 10)
        assert [(r.seq, r.path) for r in page.collect()] == ordered[n * 10 : n * 10 + 10]
        assert all(r.has_more == (n < 100) for r in page.collect()) and len(page.inputFiles()) <= 2 or n > 100


def test_scrolling_by_key_is_all_rows_once(spark, made, pages):
    ordered, got = made[1], []
    key = (1 << 40, "")
    while True:
        rows = pages.after(*key, 160)
        assert len(rows.inputFiles()) <= 4 or not got
        rows = [(r.seq, r.path) for r in rows.collect()]
        if not rows:
            break
        got += rows
        key = rows[-1]
    assert got == ordered
    again = paging.opened(spark, pages.root, "seq", "path")
    assert again.index == pages.index


def test_pages_of_no_rows(spark, tmp_path):
    none = paging.build(spark.createDataFrame([], "seq long, path string"), str(tmp_path / "none"), "seq", "path")
    assert none.total == 0 and none.page(0, 10).count() == 0 and none.after(5, "a", 10).count() == 0


def test_nearest_of_odd_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(6)]) for i in range(80)]
    rows += [(100, None), (101, [0.0] * 6), (102, [1.0]), (103, [float("nan")] * 6), (104, [None] * 6), (105, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    fine = [(i, v) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and x == x for x in v)]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    want = set()
    for i, q in fine:
        if i % 20 == 0 and norm(q):
            scores = [(-round(sum(a * b for a, b in zip(q, v, strict=True)) / norm(q) / norm(v), 6), j) for j, v in fine if norm(v)]
            want |= {(i, j, -s + 0.0) for s, j in sorted(scores)[:5]}
    got = {(r.query_id, r.id, r.score + 0.0) for r in nearest.by_cosine(df.where("id % 20 = 0"), df, 5).collect()}
    assert got == want
    assert nearest.by_cosine(df.limit(0), df, 5).count() == 0
