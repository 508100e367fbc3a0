"""Rows found by a key, against filters; how many rows the scans gave out."""

import random

import pytest

from millrace.operators import lookup


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(f"p/{i:05d}{'é' if i % 9 == 0 else ''}", f"u{rng.random():.17f}", i) for i in range(6000)]
    out += [("p/00500", f"same{i}", -i) for i in range(2500)]  # one path, more than a file
    return [*out, (None, "u-null", 1), ("p/none", None, 2), (None, None, 3)]


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "path string, uid string, v long").repartition(7)
    return lookup.build(df, str(tmp_path_factory.mktemp("stored") / "t"), "path", "uid", per_file=2000, group_bytes=8 << 10, names=1000)


def scanned(df):
    """(rows, number of rows that the scan gave out before the filter)."""
    got = [tuple(r) for r in df.collect()]
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return got, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_paths(rows, stored):
    assert stored.files.count() >= 4 and stored.rows().count() == len(rows)
    for path in ("p/00000é", "p/00500", "p/04001", "p/05999", "p/none", "p/00501x", "", "zzz"):
        got, read = scanned(stored.by_path(path))
        want = [r for r in rows if r[0] == path]
        assert sorted(got) == sorted(want) if path != "p/none" else got == want
        assert read <= len(want) + 1000  # groups at the borders of what is asked for
        assert len(stored.by_path(path).inputFiles()) <= (3 if path == "p/00500" else 1) or not want


def test_names(rows, stored):
    for i in (0, 17, 3000, 5999, 7000):
        got, read = scanned(stored.by_uid(rows[i][1]))
        assert got == [rows[i]] and read < 2500  # of 8503: a group, and now and then one by chance
    got, read = scanned(stored.by_uid("u-absent"))
    assert got == [] and read < 1500


def test_many_paths(spark, rows, stored):
    wanted = spark.createDataFrame([("p/00500",), ("p/00500",), ("p/00009é",), ("absent",), (None,), ("zzz",)], "w string")
    found = stored.by_paths(wanted)
    assert sorted(tuple(r) for r in found.collect()) == sorted(r for r in rows if r[0] in ("p/00500", "p/00009é"))
    assert stored.by_paths(wanted.where("w = 'absent'")).count() == 0
    few = stored.by_paths(wanted.where("w = 'p/00009é'"))
    assert few.count() == 1 and len(few.inputFiles()) <= 2


def test_opened_again_and_empty(spark, stored, tmp_path):
    again = lookup.opened(spark, stored.root, "path", "uid")
    assert again.by_path("p/04001").count() == 1
    none = lookup.build(spark.createDataFrame([], "path string, uid string"), str(tmp_path / "none"), "path", "uid")
    assert none.by_path("a").count() == none.by_uid("a").count() == none.by_paths(spark.createDataFrame([("a",)], "w string")).count() == 0
