"""op7's score learns from the training rows: word edges, classes and what they leave to pieces."""

import collections
import math

import numpy as np
from conftest import LOWER
from pyspark.sql import functions as F

from millrace.llm import common, lattice, registry

PATH = lattice.default_vocabulary()


def test_held_out_scores_stand_beside_the_word_counts(spark):
    got = registry.QUERIES["op7_lattice"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(r.score is not None and math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens - 0.2


def test_lexical_scores_worked_out_again(spark, odd_docs, odd_rows):
    import sentencepiece

    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    got = lattice.likelihood(odd_docs, held, PATH, rounds=0, block_bytes=3000, per_range=300).collect()
    assert all(math.isfinite(r.lexical_score) for r in got)

    def classes(docs, size):
        return lattice.classes_of(common.store(spark, lattice.to_blocks(docs, "doc_id", "text", held, size), "test-blocks"))

    # classes don't depend on how rows are dealt
    model, docs = classes(odd_docs, 3000)
    other, same = classes(odd_docs.repartition(1), 1 << 20)
    assert (model.weights == other.weights).all() and (model.prior == other.prior).all() and (docs == same).all()
    assert len(docs) > 1 and docs.sum() == sum(not (d is not None and d % 3 == 0) for d, _ in odd_rows)

    split = lambda t: (t or "").translate(LOWER).split()

    def class_of(text):
        x = np.zeros((1, lattice.FEATURES))
        for w in split(text):
            raw = np.frombuffer(w.encode(), np.uint8)
            x[0, int(common.spans_hash(raw, np.array([0]), np.array([len(raw)]))[0]) >> 54] += 1
        return int(model.choose(x)[0])

    train = [t for d, t in odd_rows if not (d is not None and d % 3 == 0)]
    by = [collections.Counter() for _ in docs]
    for t in train:
        by[class_of(t)].update(split(t))
    every = sum(by, collections.Counter())
    # discounts, and the share that goes to the counts of all classes
    n = [sum(c == i for b in by for c in b.values()) for i in (1, 2, 3, 4)]
    cut = [0.5] * 3
    if min(n):
        y = n[0] / (n[0] + 2 * n[1])
        cut = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
    single = [w for b in by for w, c in b.items() if c == 1]
    shared = sum(every[w] > 1 for w in single) / (len(single) + 1)
    less = lambda c: cut[min(c, 3) - 1] if c else 0.0
    # paths of pieces
    v, sp = lattice.vocabulary_of(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    piece = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    prior = v.prior[:-1] - np.logaddexp.reduce(v.prior[:-1])

    def paths(w):
        s = "▁" + w
        a = [0.0] + [-math.inf] * len(s)
        for e in range(1, len(s) + 1):
            own = [a[e - 1] + sum(prior[v.bytes_[b]] for b in s[e - 1].encode())]
            a[e] = np.logaddexp.reduce(own + [a[b] + prior[piece[s[b:e]]] for b in range(e) if s[b:e] in piece])
        return a[-1]

    want = []
    for d, t in odd_rows:
        z = class_of(t)
        size = sum(by[z].values()) + docs[z] + 1
        rest = (sum(less(c) for c in by[z].values()) + 0.5) / size
        score = math.log((docs[z] + 1) / (docs.sum() + len(docs))) + math.log((docs[z] + 0.5) / size)
        for w in split(t):
            c = by[z][w]
            whole = (c - less(c)) / size + rest * shared * every[w] / sum(every.values())
            score += np.logaddexp(math.log(whole) if whole else -math.inf, math.log(rest * (1 - shared)) + paths(w))
        want.append((str(d), len(split(t)), score / math.log(10)))
    mine = sorted((str(r.doc_id), r.n_tokens - 1, r.lexical_score) for r in got)
    assert [x[:2] for x in mine] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in mine], [x[2] for x in sorted(want)], rtol=1e-9)


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "new words"), (2, None), (3, "one")], "doc_id long, text string")
    got = lattice.likelihood(docs, F.lit(True), PATH, plain=False).collect()
    assert len(got) == 3 and all(math.isfinite(r.lexical_score) and r.lexical_score < 0 and r.plain_score is None for r in got)


def test_weights_of_a_class_sum_to_one():
    seen = np.array([5, 2, 1, 1, 3, 5 + 4 + 3 + 4 + 9, 0, 0, 0, 0, 0, 0, 5, 2])  # the second class has nothing
    lexicon = lattice.Lexicon.of(seen, np.array([4, 0]), 25)
    counts = np.array([1] * 5 + [2, 2, 3, 4, 9])
    whole = (counts - lexicon.left(counts)).sum() / lexicon.size[0]
    assert math.isclose(whole + lexicon.rest[0] + lexicon.end[0], 1) and math.isclose(lexicon.rest[1] + lexicon.end[1], 1)
