"""Similar texts near in time, and the global ring, against plain loops over all rows."""

import random

import pytest

from millrace.operators import similar


def jaccard(a, b):
    x, y = ({*(t or "").lower().split()} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def made(seed, n, gap):
    """Near copies in chains, exact copies, empties, nulls, one-word texts; several rows at one time."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 60)}" for _ in range(rng.choice([1, 5, 12, 25, 40]))] for _ in range(12)]
    rows, at = [], 5.0
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = f"w{rng.randint(0, 60)}"
        at += rng.choice([0, gap, gap, 4 * gap])
        rows.append((i, at, rng.choice([None, "", " \n", "Only"]) if i % 9 == 0 else " ".join(text)))
    return rows


def plain_ring(rows, seconds, similarity, size):
    ring, out = [], {}
    for i, at, text in sorted(rows, key=lambda r: (r[1], r[0])):
        ring = [x for x in ring if at - x[0] <= seconds]
        out[i] = any(jaccard(text, t) >= similarity for _, t in ring)
        if not out[i]:
            ring = [*ring, (at, text)][-size:]
    return out


@pytest.mark.parametrize("seed,gap,size,spans", [(1, 3.0, 100, 12), (2, 7.0, 4, 1), (3, 1.0, 6, 2)])
def test_ring_is_one_pass_over_all_rows(spark, seed, gap, size, spans):
    """Small blocks, so that what one refuses reaches into the next; a ring so small that it forgets."""
    rows = made(seed, 260, gap)
    df = spark.createDataFrame(rows, "id long, at double, text string").repartition(3)
    got = {r.id: r.duplicate for r in similar.ring(df, "id", "at", "text", 20, 0.8, size, spans).collect()}
    want = plain_ring(rows, 20, 0.8, size)
    assert got == want and 10 < sum(want.values()) < 240


def test_links_are_those_of_all_pairs(spark):
    rows = made(4, 240, 4.0)
    rows += [(1000 + i, 400.0 + i / 4, "the very same words in many rows") for i in range(150)]
    df = spark.createDataFrame([*rows, (5000, None, "no time")], "id long, at double, text string").repartition(3)
    got = {r.id: (r.class_id, r.n_links) for r in similar.links_in_time(df, "id", "at", "text", 30, 0.8).collect()}
    for i, at, text in rows:
        like = [j for j, _, t in rows if {*(t or "").lower().split()} == {*(text or "").lower().split()}]
        near = sum(j != i and abs(at - u) <= 30 and jaccard(text, t) >= 0.8 for j, u, t in rows)
        assert got[i] == (min(like), near), (i, text)
    assert len(got) == len(rows)


def test_pairs_are_of_classes_not_rows(spark):
    """A thousand copies of two near texts are one pair."""
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k"]
    df = spark.createDataFrame([(i, i / 100, texts[i % 2]) for i in range(1000)], "id long, at double, text string")
    pairs = similar.similar_classes(similar.word_sets(df, "text"), "at", 300, 0.9).collect()
    assert len(pairs) == 1 and pairs[0].jaccard == 10 / 11


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, at double, text string")
    assert similar.ring(none, "id", "at", "text").count() == 0 and similar.links_in_time(none, "id", "at", "text", 300, 0.9).count() == 0
