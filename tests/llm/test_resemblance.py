"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import resemblance


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def firsts(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and similar(sets[i], sets[j]):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, words, times):
    w = list(words)
    for _ in range(times):
        w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    """Families of copies on both sides of 0.8, a dense one, a common passage, and odd texts."""
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    passage = " ".join(prose(40))
    out = [None, "", " ", "one", "one two", "one"]
    for _ in range(40):
        base = prose(rng.choice([60, 150, 700]))
        out += [" ".join(base), edited(rng, base, len(base) // 45), edited(rng, base, len(base) // 30)]
    base = prose(200)
    out += [edited(rng, base, rng.randint(1, 9)) for _ in range(150)]
    out += [passage + " " + " ".join(prose(60)) for _ in range(100)]
    return out


def test_all_pairs_of_the_similarity_are_linked(spark, texts):
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string").repartition(3)
    got = [r.row for r in resemblance.beside_another(docs, "row", "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == set(range(len(texts))) - firsts(texts)


def test_stage_removes_a_copy_at_the_threshold(spark):
    """Similarities around 0.8, which fingerprints at six of 64 bits mostly miss."""
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        texts += [" ".join(base), edited(rng, base, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == len(firsts(texts)) == 30


def test_the_survivor_is_that_of_the_least_doc_id(spark):
    """Whatever the files and numbers of rows; equal ids go by the text."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    rows = [(9, " ".join(base)), (3, edited(rng, base, 2)), (None, " ".join(base)), (3, edited(rng, base, 1)), (5, "another text of six words here")]
    out = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(2)
        out.add(tuple(sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())))
    assert len(out) == 1 and [d for d, _ in next(iter(out))] == [3, 5]


def test_bitmaps_never_say_more_than_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.r_[x[: int(rng.integers(0, n + 1))], rng.integers(0, 2**63, int(rng.integers(1, 200))).astype(np.uint64)])
        assert resemblance.least_difference(resemblance.parity(x), resemblance.parity(y)) <= len(np.setxor1d(x, y))
