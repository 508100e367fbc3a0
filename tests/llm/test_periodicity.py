import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np

from millrace.llm import periodicity


def brute_runs(x):
    """Every period, every stretch of words that agree that far on; the smallest period of an interval."""
    best = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i > start and i + q - start >= max(24, 3 * q):
                best.setdefault((start, i + q), q)
            i = max(i, start + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def of_texts(texts):
    return periodicity.find_runs(np.array(sum(texts, []), np.int64), np.cumsum([0, *map(len, texts)]))


def test_runs_are_those_of_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 3)):
            x, n = [], rng.randint(0, 150)
            while len(x) < n:
                block = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 30))]
                x += (block * rng.randint(1, 7))[: rng.randint(1, 7 * len(block))]
            texts.append(x)
        got = of_texts(texts)
        assert [got.get(i, []) for i in range(len(texts))] == [brute_runs(x) for x in texts]


def test_bounds_of_a_run():
    assert of_texts([[1] * 23, [1] * 24, [1, 2] * 12]) == {1: [(0, 24, 1)], 2: [(0, 24, 2)]}  # 24 words, and not across texts
    eight = list(range(8))
    assert of_texts([eight * 3, (eight * 3)[:-1] + [99]]) == {0: [(0, 24, 8)]}  # three whole periods
    ten = list(range(10))
    assert of_texts([(ten * 3)[:-1]]) == {}


def test_long_periodic_texts_take_n_log_n():
    took = []
    for n in (10_000, 80_000):
        began = time.process_time()
        assert of_texts([[7] * n]) == {0: [(0, n, 1)]}
        took.append(time.process_time() - began)
    assert took[1] < 8 * 4 * took[0]


def test_columns_of_odd_rows(spark, odd_docs):
    """The operator beside columns of its own names, on nulls, empties, repeated and very long texts."""
    long = "q " * 50 + " ".join(f"w{i}" for i in range(300_000)) + " a b c" * 9
    more = spark.createDataFrame([(40, long, "s", 1, "c", 5), (41, "\x0ba\t" * 30 + "\x85z", "s", 1, "c", 5)], odd_docs.schema)
    docs = odd_docs.unionByName(more).withColumnRenamed("shard", "runs").withColumnRenamed("slot", "N_WORDS")
    got = periodicity.with_runs(docs)
    assert got.columns == [*docs.columns, "_n_words", "_runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        found = [tuple(x) for x in r["_runs"]]
        assert r["_n_words"] == len(words)
        if r.doc_id == 40:
            assert found == [(0, 50, 1), (300_050, 27, 3)]
        else:
            assert len(words) > 3000 or found == brute_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_query_on_odd_rows(spark, odd_docs, tmp_path):
    rng = random.Random(3)
    more = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 200))), "s", 1, "c", 5) for i in range(100, 160)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema)).where("doc_id is null or doc_id <> 9")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = [], 0
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((r.doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in periodicity.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and planted > 3 and any(w[1] for w in want)
