"""Typed live state: what event time forgets, and streams against their batch forms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators.sequential import sequential
from millrace.streaming import state, steps
from millrace.streaming.replay import replayed

DAY = 24 * 3600


class Feed:
    """A folder in which rows land, a file at a time, and the query that reads it."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.rows = spark, folder, schema, Counter()

    def land(self, rows):
        df = self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").json(str(self.folder / "in"))

    def stream(self):
        made = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))
        return made.withColumn("time", F.timestamp_seconds("at"))

    def run(self, query, name):
        """What the query adds since it last ran: it starts again from its checkpoint."""
        rows = Counter(tuple(r) for r in replayed(query(self.stream()), name, str(self.folder)).collect())
        assert not self.rows - rows
        new, self.rows = rows - self.rows, rows
        return list(new.elements())


@pytest.fixture()
def captures(spark, tmp_path):
    return Feed(spark, tmp_path, "path string, id long, content_hash string, at double")


def cached(stream):
    return state.path_cache(stream, "path", "time", "1 second", DAY)


def test_idle_paths_are_forgotten_by_event_time(spark, captures):
    captures.land([("a", 1, "x", 5.0), ("b", 2, "x", 10.0), ("a", 3, "x", 20.0), (None, 4, "x", 20.0)])
    first = captures.run(cached, "first")
    assert sorted((r[1], r[4]) for r in first) == [(1, "created"), (2, "created"), (3, "skipped")]
    folder = str(captures.folder / "checkpoint")
    assert {r.key.path: (r.value.content_hash, r.value.at) for r in state.held(spark, folder).collect()} == {"a": ("x", 20.0), "b": ("x", 10.0)}
    # a second start, from the checkpoint: a is refreshed, b is not
    captures.land([("a", 5, "y", DAY - 5.0)])
    assert [(r[1], r[4]) for r in captures.run(cached, "second")] == [(5, "updated")]
    captures.land([("c", 6, "z", DAY + 100.0)])
    captures.run(cached, "third")
    assert {r.key.path for r in state.held(spark, folder).collect()} == {"a", "c"}
    captures.land([("c", 7, "z", 3.0 * DAY), ("b", 8, "x", 3.0 * DAY)])
    assert sorted((r[1], r[4]) for r in captures.run(cached, "fourth")) == [(7, "created"), (8, "created")]
    assert {r.key.path for r in state.held(spark, folder).collect()} == {"b", "c"}  # a went without being seen again


def test_stream_is_the_batch_form_over_many_starts(spark, captures):
    rng = random.Random(4)
    rows, at = [], 0.0
    for i in range(200):
        at += rng.choice([1, 60, 5000, 40_000])
        rows.append((rng.choice("abcd"), i, rng.choice("xy"), at))
    got = []
    for n, a in enumerate(range(0, 200, 50)):
        captures.land(rows[a : a + 30])
        captures.land(rows[a + 30 : a + 50])
        got += captures.run(cached, f"part-{n}")
    df = spark.createDataFrame(rows, captures.schema)
    want = sequential(df, ["path"], ["at", "id"], steps.dedup_step(DAY), "action string").collect()
    assert sorted((r[1], r[4]) for r in got) == sorted((r.id, r.action) for r in want) and len(got) == 200


def test_windows_that_vanish_leave_no_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, "window long, snapshot long, title string, at double")
    query = lambda s: state.window_changes(s, "window", "time", "1 second", 10)
    row = lambda w, n, t: (w, n, t, n * 10.0)
    feed.land([row(1, 1, "a"), row(2, 1, "b"), row(3, 1, None)])
    feed.land([row(1, 2, "a2"), row(2, 2, "b"), row(3, 2, None)])
    assert sorted(feed.run(query, "one"), key=str) == [(1, 1, "created", "a"), (1, 2, "title_changed", "a2"), (2, 1, "created", "b"), (3, 1, "created", None)]
    feed.land([row(1, 3, "a2"), row(3, 3, "c")])
    feed.land([row(1, 4, "a2"), row(3, 4, "c")])
    # window 2 was in no snapshot 3: it goes when the clock is past it, without a row of its own
    assert sorted(feed.run(query, "two")) == [(2, 3, "destroyed", "b"), (3, 3, "title_changed", "c")]
    assert {r.key.window for r in state.held(spark, str(tmp_path / "checkpoint")).collect()} == {1, 3}
    feed.land([row(2, 7, "back")])
    assert sorted(feed.run(query, "three")) == [(1, 5, "destroyed", "a2"), (2, 7, "created", "back"), (3, 5, "destroyed", "c")]


def test_debounce_fires_without_another_row(spark, tmp_path):
    feed = Feed(spark, tmp_path, "app long, id long, at double")
    query = lambda s: state.debounced(s, "app", "id", "time", "1 second", 2.0)
    feed.land([(1, 1, 0.1), (1, 2, 1.5), (2, 3, 0.2), (1, 4, 3.5), (1, 5, 4.0)])
    # 2 fires at 3.5, as 4 is two seconds after it; 3 as the clock (4 - 1) passes 2.2
    assert sorted(feed.run(query, "one")) == [(1, 2, 3.5), (2, 3, 2.2)]
    feed.land([(9, 6, 100.0)])
    assert sorted(feed.run(query, "two")) == [(1, 5, 6.0)]
    assert [r.key.app for r in state.held(spark, str(tmp_path / "checkpoint")).collect()] == [9]
