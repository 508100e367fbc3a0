"""Shards and scores worked out again, a row at a time; tables of runs side by side."""

import math
import os
import random
import re
import threading

import numpy as np
import pytest
from conftest import LOWER
from pyspark.sql import functions as F

from millrace.llm import common, sharding, toxicity


def brute_shards(spark, docs, shards, seed, bucket_bytes):
    """(doc_id, text, shard, slot): buckets by hash, each shuffled, in a row, cut evenly."""
    h = sharding.record_hash("doc_id", "text", seed)
    rows = [(r.h, r.g, r.doc_id, r.text) for r in docs.select("doc_id", "text", h.alias("h"), F.xxhash64(F.lit(seed + 1), h).alias("g")).collect()]
    total = sum(len((t or "").encode()) + 1 for _, _, _, t in rows)
    buckets = max(1, math.ceil(total / bucket_bytes))
    table = []
    for b in range(buckets):
        own = sorted([(h, i, t) for h, g, i, t in rows if g % buckets == b])
        assert sum(len((t or "").encode()) + 1 for _, _, t in own) <= 2 * bucket_bytes
        order = np.random.Generator(np.random.PCG64([seed, b])).permutation(len(own))
        table += [own[k][1:] for k in order]
    n, out = len(table), []
    for s in range(shards):
        out += [(*row, s, slot) for slot, row in enumerate(table[n * s // shards : n * (s + 1) // shards])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shards, seed, bucket_bytes", [(4, 20240501, 3000), (7, 5, 1 << 20), (1, 9, 900)])
def test_shards_are_buckets_shuffled_and_cut(spark, shards, seed, bucket_bytes):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("abé \n") for _ in range(rng.randrange(40)))) for i in range(700)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.write_shards(docs, shards=shards, seed=seed, bucket_bytes=bucket_bytes).collect()
    assert sorted([(r.doc_id, r.text, r.shard, r.slot) for r in got], key=str) == brute_shards(spark, docs, shards, seed, bucket_bytes)


def one_hash(raw):
    data = np.frombuffer(raw, np.uint8)
    return int(common.spans_hash(data, np.array([0]), np.array([len(data)]))[0])


def brute_features(text):
    """Whole words and their first four and five bytes, each once."""
    out = set()
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").translate(LOWER).encode()):
        out.add(one_hash(w))
        out |= {one_hash(w[:k]) ^ (0xA24BAED4963EE407 * k & (1 << 64) - 1) for k in (4, 5) if len(w) > k}
    return out


def test_model_and_scores(spark):
    rng = random.Random(3)
    mild, foul = [f"mild{i}é" for i in range(30)], [f"foul{i}" for i in range(6)]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        words = [rng.choice(mild) for _ in range(rng.randrange(3, 12))] + ([rng.choice(foul)] if toxic or rng.random() < 0.03 else []) + (["Women"] if i % 7 == 0 else [])
        rows.append((i, ", ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(400, None), (401, ""), (402, "?!"), (403, "WOMEN foul1 foul1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~toxicity.held_out())
    learnt = {r.doc_id for r in docs.where(~toxicity.held_out()).collect()}
    # the features that tell labels apart, counted one by one
    y = {i: t for i, t in labels if i in learnt}
    of = {i: brute_features(t) for i, t in rows}
    rate = sum(y.values()) / len(y)
    want = set()
    for f in set().union(*[of[i] for i in y]):
        n, pos = sum(f in of[i] for i in y), sum(t for i, t in y.items() if f in of[i])
        if n >= 3 and (pos - n * rate) ** 2 / (n * rate * (1 - rate)) > 6.6:
            want.add(f)
    terms = set().union(*[brute_features(t) for t in toxicity.IDENTITY_TERMS])
    want |= {f for f in terms if any(f in of[i] for i in y)}
    assert {int(k) for k in model.keys} == want and list(model.keys) == sorted(model.keys)
    weight = {int(k): w for k, w in zip(model.keys, model.weights)}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, _ in rows:
        z = model.intercept + sum(weight.get(f, 0.0) for f in of[i])
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert got[400] == got[401] == got[402] and got[403] > 0.7


def test_runs_side_by_side_clear_their_own_tables(spark):
    """A run that clears while another one writes takes nothing of it."""
    there = lambda df: all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())
    wrote, cleared, out = threading.Event(), threading.Event(), {}

    def beside():
        began = common.mark()
        out["theirs"] = common.store(spark, spark.range(5), "test-beside")
        wrote.set()
        cleared.wait(60)
        out["kept"] = there(out["theirs"])
        common.clear(spark, began)
        out["gone"] = not there(out["theirs"])

    began = common.mark()
    t = threading.Thread(target=beside)
    t.start()
    mine = common.store(spark, spark.range(5), "test-mine")
    assert wrote.wait(60)
    last = common.store(spark, spark.range(6), "test-last")
    common.clear(spark, began, keep=1)
    cleared.set()
    t.join()
    assert out["kept"] and out["gone"] and not there(mine) and there(last)
    common.clear(spark, began)
