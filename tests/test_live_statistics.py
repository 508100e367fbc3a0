"""Statistics of live state, rows that are delivered again, late rows kept aside."""

from collections import Counter

from test_live_state import DAY, Feed, cached

from pyspark.sql import functions as F

from millrace.streaming import late, state, statistics
from millrace.streaming.replay import landed


def stats(spark, folder, since=0):
    rows = statistics.counts(spark, str(folder / "checkpoint"), since).collect()
    return {r.batch: (r.written, r.added, r.evicted, r.entries) for r in rows}


def test_counts_follow_the_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, "path string, id long, content_hash string, at double")
    feed.land([("a", 1, "x", 1.0), ("b", 2, "x", 10.0), ("a", 3, "y", 20.0)])
    feed.land([("a", 4, "y", DAY - 5.0), ("c", 5, "x", DAY - 5.0)])
    feed.run(cached, "one")
    first = stats(spark, tmp_path)
    assert first[0] == (2, 2, 0, 2) and first[1] == (2, 1, 0, 3)
    feed.land([("c", 6, "x", DAY + 100.0)])  # b was last seen a day before that
    feed.run(cached, "two")
    every = stats(spark, tmp_path)
    assert sum(s[1] for s in every.values()) - sum(s[2] for s in every.values()) == state.held(spark, str(tmp_path / "checkpoint")).count() == 2
    assert sum(s[2] for s in every.values()) == 1
    last = max(every)
    for since in range(1, last + 1):  # from a later batch on: the same counts
        assert stats(spark, tmp_path, since) == {b: s for b, s in every.items() if b >= since}


def test_delivered_again(spark, tmp_path):
    feed = Feed(spark, tmp_path, "path string, id long, content_hash string, at double")
    query = lambda s: state.once(s, ["id"], "time", "100 seconds").select("id")
    feed.land([("a", 1, "x", 1.0), ("a", 1, "x", 1.0), ("a", 2, "x", 5.0)])
    feed.land([("a", 1, "x", 1.0), (None, 3, None, 50.0), ("a", None, "x", 50.0)])
    assert sorted(feed.run(query, "one"), key=str) == [(1,), (2,), (3,), (None,)]
    feed.land([("a", 9, "x", 1000.0)])
    assert feed.run(query, "two") == [(9,)]
    feed.land([("a", 2, "x", 1000.0)])  # long after: a row of its own
    assert feed.run(query, "three") == [(2,)]


def parts(spark, rows):
    df = spark.createDataFrame(rows, "id long, part long, at double").withColumn("time", F.timestamp_seconds("at"))
    return landed(df, "at", part=F.col("part"))


def test_late_rows_go_aside_and_none_is_lost(spark, tmp_path):
    rows = [(1, 0, 100.0), (2, 0, 5.0), (3, 1, 89.0), (4, 1, 90.0), (5, 1, None), (6, 2, 300.0), (7, 10, 289.0), (7, 10, 289.0), (8, 10, 295.0)]
    stream = parts(spark, rows)
    late.split(stream, "time", "10 seconds", str(tmp_path))
    got = late.rows(spark, str(tmp_path), stream)
    assert Counter((r.id, r.batch) for r in got.collect()) == Counter([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2), (7, 3), (7, 3), (8, 3)])
    assert sorted(r.id for r in got.where("late").collect()) == [3, 7, 7]


def test_a_batch_that_is_tried_again_doubles_nothing(spark, tmp_path):
    stream = parts(spark, [(1, 0, 100.0), (2, 1, 80.0), (3, 1, 120.0)])
    late.split(stream, "time", "10 seconds", str(tmp_path))
    (tmp_path / "checkpoint/commits/1").unlink()  # its end was not recorded
    (tmp_path / "checkpoint/commits/.1.crc").unlink(missing_ok=True)
    late.split(stream, "time", "10 seconds", str(tmp_path))
    assert sorted((r.id, r.batch, r.late) for r in late.rows(spark, str(tmp_path), stream).collect()) == [(1, 0, False), (2, 1, True), (3, 1, False)]


def test_empty_streams(spark, tmp_path):
    stream = spark.readStream.schema("id long, time timestamp").parquet(_empty(spark, tmp_path))
    late.split(stream, "time", "10 seconds", str(tmp_path / "late"))
    assert late.rows(spark, str(tmp_path / "late"), stream).count() == 0


def _empty(spark, tmp_path):
    folder = str(tmp_path / "none")
    spark.createDataFrame([], "id long, time timestamp").write.parquet(folder)
    return folder
