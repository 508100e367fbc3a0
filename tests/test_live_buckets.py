"""Live state whose keys share buckets: what it holds and ends is what a loop by key holds and ends."""

import random
from collections import Counter

import pytest
from test_live_state import Feed

from pyspark.sql import functions as F

from millrace.streaming import state, statistics

TTL = 40


def plain(batches):
    """Actions, (written, added, evicted, held) of each batch, and what is held at the end."""
    held, actions, counts, mark, newest = {}, [], [], None, 0.0
    for rows in [*batches, []]:
        seen, written, added, n_held = {}, set(), 0, len(held)
        for key, i, content, at in sorted(rows, key=lambda r: (r[3], r[1])):
            if mark is not None and at < mark:
                continue
            last = held.get(key, None) if key not in seen else seen[key]
            alive = last is not None and at - last[1] < TTL
            actions.append((key, i, content, at, "created" if not alive else "skipped" if last[0] == content else "updated"))
            seen[key] = (content, at)
        for key, value in seen.items():
            if held.get(key) != value:
                written.add(key)
                added += key not in held
        held.update(seen)
        gone = [k for k, v in held.items() if mark is not None and v[1] + TTL <= mark]
        for k in gone:
            del held[k]
        counts.append((len(written), added, len(gone), len(held)))
        assert len(held) == n_held + added - len(gone)
        newest = max([newest, *(r[3] for r in rows)])
        mark = newest - 1
    return actions, counts, held


@pytest.mark.parametrize("buckets,keys", [(1, 12), (3, 40)])
def test_buckets_are_a_loop_by_key(spark, tmp_path, monkeypatch, buckets, keys):
    monkeypatch.setattr(state, "BUCKETS", buckets)
    rng = random.Random(buckets)
    batches, at, i = [], 0, 0
    for b in range(6):
        rows = []
        for _ in range(60 if b != 3 else 2):  # few rows of many keys: they are read one by one
            at += rng.choice([0, 1, 2, 9])
            i += 1
            rows.append((f"k{rng.randrange(keys)}", i, rng.choice("xy"), float(at)))
        batches.append(rows)
    feed = Feed(spark, tmp_path, "path string, id long, content_hash string, at double")
    for rows in batches:
        feed.land(rows)
    got = feed.run(lambda s: state.path_cache(s, "path", "time", "1 second", TTL), "once")
    actions, counts, held = plain(batches)
    assert Counter(got) == Counter(actions)
    folder = str(tmp_path / "checkpoint")
    assert {r.key.path: (r.value.content_hash, r.value.at) for r in state.held(spark, folder).collect()} == held
    stats = {r.batch: (r.written, r.added, r.evicted, r.entries) for r in statistics.counts(spark, folder).collect()}
    assert stats == {b: c for b, c in enumerate(counts) if c[:3] != (0, 0, 0)} and sum(c[2] for c in counts) > 5


def test_python_is_called_by_bucket(spark, tmp_path, monkeypatch):
    """Two thousand paths are a few groups of rows, not a group each."""
    monkeypatch.setattr(state, "BUCKETS", 4)
    feed = Feed(spark, tmp_path, "path string, id long, content_hash string, at double")
    feed.land([(f"p{i}", i, "x", 1.0) for i in range(2000)])
    feed.run(lambda s: state.path_cache(s, "path", "time", "1 second", TTL), "once")
    raw = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "held").load()
    assert raw.select("key").distinct().count() <= 4 and state.held(spark, str(tmp_path / "checkpoint")).select(F.col("key.path")).distinct().count() == 2000
