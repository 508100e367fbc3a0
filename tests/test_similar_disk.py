"""What similar texts leave on disk, and hashes that are equal by chance."""

import os
import random
import uuid

from test_similar import jaccard, made

from pyspark.sql import functions as F

from millrace.operators import similar


def test_stored_tables_are_small(spark, tmp_path, monkeypatch):
    """Only digests, places and pairs are stored, no texts and no word lists: below a tenth of the texts' size here, 2.4 times it when they were."""
    monkeypatch.setattr(similar, "scratch", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    rows = [(i, float(i), " ".join(word() for _ in range(200))) for i in range(300)]
    rows += [(1000 + i, float(i), t + " more") for i, _, t in rows[:40]]
    df = spark.createDataFrame(rows, "id long, at double, text string")
    got = {r.id: r.n_links for r in similar.links_in_time(df, "id", "at", "text", 300, 0.9).collect()}
    assert got == {i: int(i < 40 or i >= 1000) for i, _, _ in rows}
    stored = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet"))
    assert stored < sum(len(t) for _, _, t in rows) / 10


def test_a_word_goes_to_two_windows(spark):
    """One row for a word of the prefix and window; rare words are not dealt out by size."""
    sets = similar.word_sets(spark.createDataFrame([(f"w{i} " * 3 + " ".join(f"u{i}x{j}" for j in range(99)),) for i in range(20)], "text string"), "text")
    thin = sets.select(F.xxhash64("class").alias("short"), F.lit(0).cast("long").alias("span"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    assert similar._prefixes(thin, 0.9).count() <= 20 * 11 * 4


def test_equal_hashes_change_nothing(spark, monkeypatch):
    """Classes and words that share their hashes with others give the same links."""
    whole = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda c: F.pmod(whole(c), F.lit(7)))
    rows = made(6, 120, 4.0)
    df = spark.createDataFrame(rows, "id long, at double, text string").repartition(3)
    got = {r.id: r.n_links for r in similar.links_in_time(df, "id", "at", "text", 30, 0.8).collect()}
    assert got == {i: sum(j != i and abs(at - u) <= 30 and jaccard(text, t) >= 0.8 for j, u, t in rows) for i, at, text in rows}
