"""Each operator against a brute-force version on a small table of odd rows, and on an empty one."""

import array
import collections
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import common, contamination, lattice, packing, quality, registry, secrets, sharding, simhash, substring_dedup, toxicity, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def key(row):
    return tuple(str(x) for x in row)


def test_contamination(spark, odd_docs, odd_rows):
    by_id = dict(odd_rows)
    items = [(1, " ".join(by_id[4].split()[35:60])), (1, "one"), (None, by_id[12]), (2, None), (3, "no such words here"), (4, "W1 w2"), (5, " ".join(by_id[9].split()[100:113]))]
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")

    def brute(width=13, within=9):
        wins = collections.defaultdict(set)
        for i, t in items:
            w = ITEM_WORD.findall((t or "").translate(LOWER))
            for p in range(max(1, len(w) - width + 1)) if w else ():
                wins[tuple(w[p : p + width])].add("" if i is None else str(i))
        texts = [ITEM_WORD.findall((t or "").translate(LOWER)) for _, t in odd_rows]
        seen = collections.Counter(x for w in texts for x in w)
        out = []
        for (d, _), w in zip(odd_rows, texts, strict=True):
            hit, found, near = set(), set(), set()
            for win, own in wins.items():
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit |= set(range(p, p + len(win)))
                        found |= own
                rarest = min(win, key=lambda x: seen[x])
                if any(x == rarest and set(win) <= set(w[max(0, p - within) : p + within + 1]) for p, x in enumerate(w)):
                    near |= own
            out.append((d, len(w), len(hit), sorted(found), sorted(near), bool(hit) and 20 * len(hit) >= len(w)))
        return sorted(out, key=key)

    for batch in (1 << 20, 20):  # one batch, and several that are merged
        got = contamination.contaminated(odd_docs, bench, within=9, batch_words=batch)
        assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"]), list(r.near_items), r.contaminated) for r in got.collect()], key=key) == brute()
    assert contamination.contaminated(odd_docs.limit(0), bench).count() == 0
    assert contamination.contaminated(odd_docs, bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0


def test_long_items_are_cut_without_losing_a_window(spark):
    text = " ".join(f"u{i}" for i in range(500))
    bench = spark.createDataFrame([(1, text), (2, "u1 u2"), (3, "")], "item_id long, text string")
    pieces = contamination.item_pieces(bench, "item_id", "text", 13, most=50).collect()
    assert sorted(r.n for r in pieces if r.item == "1") == sorted([62] * 9 + [50]) and [r.n for r in pieces if r.item == "2"] == [2]
    p = contamination.Phrases([(r["item"], np.frombuffer(bytes(r.words), np.uint64)) for r in pieces], 13)
    assert len(p.start) == 500 - 12 + 1


def test_phrases_of_a_large_benchmark_stay_small():
    """A batch of half a million words, which is about 3 MB of text."""
    import pickle

    rng = np.random.default_rng(4)
    pieces = [(str(i), rng.integers(0, 2**63, 60).astype(np.uint64)) for i in range((1 << 19) // 60)]
    assert len(pickle.dumps(contamination.Phrases(pieces, 13))) < 30 << 20


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, "gamma alpha beta"), (3, "alpha beta"), (4, "beta " * 5 + "alpha x x x x x x x gamma"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = contamination.contaminated(docs, bench, within=5).collect()
    assert {r.doc_id for r in got if r.near_items} == {1, 2} and not [r for r in got if r["items"]]


def test_packing(spark, odd_docs, odd_rows):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tk = Tokenizer.from_file(path)
    size = 64
    out = packing.pack(odd_docs, path, size=size).collect()
    want = []
    for d, t in odd_rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, n, a, array.array("I", ids[a : a + size]).tobytes()) for n, a in enumerate(range(0, len(ids), size))]
    assert sorted([(r.doc_id, r.piece, r.start, bytes(r.ids)) for r in out], key=key) == sorted(want, key=key)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack(odd_docs.limit(0), path, digest=F.crc32("ids")).count() == 0


def test_packing_keeps_the_ids_of_rows_with_one_id(spark):
    """Null and repeated ids: each piece has its own text's ids."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_vocabulary())
    rows = [(None if i % 2 else 1, f"text {i % 50}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(docs, packing.default_vocabulary(), size=32).collect()
    want = collections.Counter((d, array.array("I", [*tk.encode(t, add_special_tokens=False).ids, 0]).tobytes()) for d, t in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tk, cache = Tokenizer.from_file(path), packing.WordCache(path)
    for t in ["It's DON'T (we'll) x_y", "a\x1cb \x85c", "<|endoftext|> a<|endoftext|>b", "é ẹ́ İstanbul ΣΑΣ", "12٣4,5... --- ß", "日本 語　x", "'s 's't"]:
        assert cache.encode(t) == np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_best_fit_fills_and_places_each_once():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 65, rng.integers(1, 400)).tolist()
        hist = collections.Counter(sizes)
        bins, seen = collections.defaultdict(list), collections.Counter()
        for r in packing.best_fit(dict(hist), 64):
            for i in range(r.count):
                bins[r.first + i // r.each].append((r.offset + i % r.each * r.length, r.length))
                seen[(r.length, r.rank + i)] += 1
        assert seen == collections.Counter((n, i) for n, c in hist.items() for i in range(c))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 64
        free: list[int] = []  # plain best-fit decreasing
        for s in sorted(sizes, reverse=True):
            fit = [f for f in free if f >= s]
            if fit:
                free.remove(min(fit))
            free.append((min(fit) if fit else 64) - s)
        assert len(bins) == len(free)


def test_warc_round_trip(spark):
    rows = [(1, "http://a.org/x", "same", 0), (2, "http://a.org/x", "same", 0), (2, "http://a.org/x", "same", 0), (3, "https://b.a.org/y?z", "other", 0), (None, "http://n", "same", 0), (5, None, None, 0), (6, "::bad::", "", 0)]
    rows += [(100 + i, f"http://h{i % 3}.org:8080/{i}", "é" * i, 0) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    a = warc.write(pages, block_lines=4, archive_bytes=2000)
    top = collections.defaultdict(int)
    for p, _, h, _ in rows:
        top[h or ""] = max(top[h or ""], p or 0)
    want = []
    for p, u, h, _ in rows:
        raw = (h or "").encode()
        to = top[h or ""] if p is not None and p < top[h or ""] else None
        want.append((p, u, None if to else raw, len(raw), warc.digest_of(raw), "revisit" if to else "response", to))
    for out in (warc.read(a), warc.lookup(a, pages)):
        got = [(r.page_id, r.url, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    some = spark.createDataFrame([("http://a.org/x",), ("http://a.org/x",), ("http://absent/",), (None,)], "url string")
    assert sorted(str(r.page_id) for r in warc.lookup(a, some).collect()) == ["1", "2", "2", "5"]
    look = warc.Lookup(a)
    for u in {r[1] for r in rows if r[1]}:
        assert sorted(str(c[1]) for c in look.captures(u)) == sorted(str(r[0]) for r in rows if r[1] and warc.surt(r[1]) == warc.surt(u))
    assert [p for _, _, p in look.records("http://h1.org:8080/7")] == [("é" * 7).encode()] and look.captures("http://absent/") == []
    # ids are distinct, and revisits refer to the record of a response of their payload
    fields = [f for u in {r[1] for r in rows} for f, _, _ in look.records(u)]
    names = [f["warc-record-id"] for f in fields]
    assert len(set(names)) == len(names) == len(rows)
    by_name = {f["warc-record-id"]: f for f in fields}
    for f in fields:
        if f["warc-type"] == "revisit":
            to = by_name[f["warc-refers-to"]]
            assert to["warc-type"] == "response" and to["warc-payload-digest"] == f["warc-payload-digest"] and to["x-page-id"] == f["x-refers-to-page-id"]
    empty = warc.write(pages.limit(0))
    assert warc.read(empty).count() == 0 and warc.lookup(empty, pages).count() == 0
    named = spark.createDataFrame([("a", "http://x/", "p"), ("7", "http://x/", "p"), ("6", "http://x/", "p")], "page_id string, url string, html string")
    assert sorted((str(r.page_id), r.record_type) for r in warc.read(warc.write(named)).collect()) == [("6", "revisit"), ("7", "response"), ("None", "response")]
    assert warc.surt("HTTP://www.B.a.org:80/p?q") == "org,a,b)/p?q"


def test_pages_are_never_shuffled(spark):
    """With no broadcast at all, an exchange moves digests and places, not html."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
        placed, _, _ = common.with_place(pages.select("page_id", "url", "html"))
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert warc.read(warc.write(pages)).count() == pages.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decisions_find_their_rows(spark):
    docs = spark.range(5000).selectExpr("id", "concat('t', id) as t").repartition(3)
    placed, file, row = common.with_place(docs)
    assert placed.select(file, row).distinct().count() == 5000
    numbered = common.store(spark, docs.withColumn("__row", F.monotonically_increasing_id()), "test-rows")
    gone = numbered.where("id % 7 = 0").select("__row")
    left = common.without(numbered, gone, "__row")
    assert left.columns == ["id", "t"] and sorted(r.id for r in left.collect()) == [i for i in range(5000) if i % 7]
    assert common.without(numbered, gone.limit(0), "__row").count() == 5000


def test_sharding(spark, odd_docs, odd_rows):
    out = sharding.write_shards(odd_docs, shards=4, bucket_bytes=4000)
    rows = out.collect()
    assert sorted([(r.doc_id, r.text) for r in rows], key=key) == sorted(odd_rows, key=key)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.write_shards(odd_docs.repartition(2), shards=4, bucket_bytes=4000)
    place = lambda df: sorted([(r.doc_id, r.text, r["shard"], r["slot"]) for r in df.collect()], key=key)
    assert place(out) == place(again)
    assert place(out) != place(sharding.write_shards(odd_docs, shards=4, bucket_bytes=4000, seed=1))
    # groups of buckets first: the same places
    assert place(out) == place(sharding.write_shards(odd_docs, shards=4, bucket_bytes=4000, most_buckets=3))
    assert sharding.write_shards(odd_docs.limit(0)).count() == 0


def test_equal_rows_are_not_one_bucket(spark):
    """Half of all rows equal in id and text: the largest task holds two buckets' worth at most."""
    docs = spark.createDataFrame([(None, "same text") if i % 2 else (i, f"text {i}") for i in range(4000)], "doc_id long, text string").repartition(4)
    out = sharding.write_shards(docs, shards=3, bucket_bytes=4000)
    rows = out.collect()
    assert len(rows) == 4000 and sum(r.text == "same text" for r in rows) == 2000
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append((r["slot"], r.text == "same text"))
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in slots.values())
    # a written file is a bucket's part of a shard, and none holds all the equal rows
    files = out.where("text = 'same text'").groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) * 10 <= 2 * 4000


def made_labels(n=900):
    """Toxic texts name one group far more often than others do; neutral mentions exist too."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [words[j] for j in rng.integers(0, 300, 40)]
        if bad and rng.random() < 0.9:
            text[5] = f"vile{i % 7}"
        if rng.random() < (0.8 if bad else 0.05):
            text[9] = "muslims"
        elif rng.random() < 0.2:
            text[9] = "christians"
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(bad), 9))
    return rows, labels


def test_toxicity_learns_and_is_fair(spark):
    rows, labels = made_labels()
    rows += [(None, "vile1", "x"), (7001, None, "x"), (7002, "", "x"), (5, "vile2 x", "x"), (9, "long " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, toxic int, text int")
    plain = toxicity.learn(docs, lab, ~toxicity.held_out(), fairness=0.0)
    fair = toxicity.learn(docs, lab, ~toxicity.held_out())
    gap = lambda m: abs(m.logits(*_packed("muslims")) - m.logits(*_packed("christians")))[0]
    assert gap(fair) < 0.5 * gap(plain)
    # held-out neutral texts that mention the group: false positives before and after
    held = {r.doc_id for r in docs.where(toxicity.held_out()).select("doc_id").collect()}
    clean = {i for i, y, _ in labels if y == 0} & held
    neutral = [t for i, t, _ in rows if i in clean and t and "word" in t]
    neutral = [" ".join([*t.split()[:9], "muslims", *t.split()[10:]]) for t in neutral]
    wrong = lambda m: np.mean([toxicity.sigmoid(m.logits(*_packed(t)))[0] >= 0.5 for t in neutral])
    print("false positives on neutral mentions", wrong(plain), wrong(fair), "of", len(neutral))
    assert wrong(plain) > 0.2 and wrong(fair) < 0.5 * wrong(plain)
    got = toxicity.score(docs, fair)
    found = got.where(toxicity.held_out()).join(lab.select("doc_id", "toxic"), "doc_id").where("doc_id NOT IN (5, 9)").collect()
    assert np.mean([(r.score >= 0.7) == bool(r.toxic) for r in found]) > 0.93
    assert got.count() == len(rows) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    nothing = toxicity.learn(docs, lab.limit(0), ~toxicity.held_out())
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), fair).count() == 0


def test_swaps_are_those_of_the_swapped_text():
    """Features lost and gained against the text with the term written over."""
    terms = ["christians", "christmas", "men", "women", "frauen"]
    text = "the men and the christians sang Christians songs for men; chris womenfolk"

    def of(t):
        return set(toxicity.features(*_packed(t))[1].tolist())

    keys = np.array(sorted(set().union(*(of(re.sub(rf"(?i)\b{a}\b", b, text)) for a in terms for b in terms))), np.uint64)
    design = toxicity.Design(keys, terms)
    (cols, swaps), = design.rows(*_packed(text))
    before = of(text)
    assert set(keys[cols].tolist()) == before
    want = collections.Counter()
    for a in ("christians", "men"):
        for b in terms:
            if b != a:
                after = of(re.sub(rf"(?i)\b{a}\b", b, text))
                if after != before:
                    want[frozenset(before - after), frozenset(after - before)] += 1 / 4
    got = collections.Counter()
    for lost, gained, weight in swaps:
        got[frozenset(keys[lost].tolist()), frozenset(keys[gained].tolist())] += weight
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def _packed(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_quality(spark, odd_docs, odd_rows):
    judged = quality.judge(odd_docs)
    assert judged.columns == [*odd_docs.columns, "_rejected_by"]
    got = judged.collect()
    assert {r.rejected_by for r in got} == {"c"}  # the table's own column stays
    verdict = {(r.doc_id, r.text): r._rejected_by for r in got}
    assert verdict[(11, "x " * 300)] is not None and verdict[(6, None)] == verdict[(7, "")] and verdict[(7, "")] is not None
    assert verdict[(1, dict(odd_rows)[1])] is None
    kept = quality.keep(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r._rejected_by is None for r in got)
    order = quality.cascade(quality.DEFAULT_RULES[::-1], quality.measures(F.col("text"), quality.words_of(F.col("text"))).__getitem__)
    flipped = odd_docs.where("text IS NOT NULL").select("doc_id", "text", order.alias("r")).collect()
    assert all((r.r is None) == (verdict[(r.doc_id, r.text)] is None) for r in flipped)  # the order never changes the verdict
    assert quality.judge(odd_docs.limit(0)).count() == 0


def test_rules_go_by_rejection_per_cost_of_what_is_left():
    rules = [quality.Rule(n, None) for n in "abc"]
    # a and b reject the same texts, c others: once a is chosen, b rejects nothing more
    verdicts = {0b011: 40, 0b100: 20, 0: 40}
    assert [i for i, _ in quality.ordered(rules, [1.0, 2.0, 4.0], verdicts)] == [0, 2, 1]
    assert [i for i, _ in quality.ordered(rules, [8.0, 2.0, 0.5], verdicts)] == [2, 1, 0]
    assert [i for i, _ in quality.ordered(rules, [1.0, 1.0, 1.0], {})] == [0, 1, 2]


def test_the_order_of_rules_is_stable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    orders = {tuple(r.name for r, _, _ in quality.profile(docs, quality.DEFAULT_RULES)) for _ in range(3)}
    assert {o[0] for o in orders} <= {"few_words", "symbols"}
    assert quality.profile(docs.limit(0), quality.DEFAULT_RULES)[0][0] is quality.DEFAULT_RULES[0]


def test_lattice(spark, odd_docs, odd_rows):
    import sentencepiece

    path = lattice.default_vocabulary()
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    got = sorted(lattice.likelihood(odd_docs, held, path, rounds=1, block_bytes=3000, per_range=300).collect(), key=key)
    train = [t for d, t in odd_rows if not (d is not None and d % 3 == 0)]
    c = collections.Counter(w for t in train for w in WORD.findall((t or "").translate(LOWER)))
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = []
    for d, t in odd_rows:
        w = WORD.findall((t or "").translate(LOWER))
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((d, d is not None and d % 3 == 0, len(w) + 1, sum(x in c for x in w) + 1, n, base))
    bare = {(r.doc_id, r.n_tokens): (r.score, r.plain_score) for r in lattice.likelihood(odd_docs, held, path, rounds=0, block_bytes=3000).collect()}
    assert all(math.isclose(a, b, rel_tol=1e-5) for a, b in bare.values())
    assert all(math.isclose(bare[(r.doc_id, r.n_tokens)][1], r.plain_score, rel_tol=1e-5) for r in got)
    assert [tuple(r)[:5] for r in got] == [x[:5] for x in sorted(want, key=key)]
    assert np.allclose([r.base_score for r in got], [x[5] for x in sorted(want, key=key)])
    assert lattice.likelihood(odd_docs.limit(0), held, path).count() == 0
    # the recursion against all segmentations of short words, and expected counts against them
    v_, sp = lattice.vocabulary_of(path), sentencepiece.SentencePieceProcessor(model_file=path)
    piece = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def paths(s):
        if not s:
            return [[]]
        out = [[*(v_.bytes_[b] for b in s[0].encode()), *rest] for rest in paths(s[1:])]
        return out + [[piece[s[:k]], *rest] for k in range(1, len(s) + 1) if s[:k] in piece for rest in paths(s[k:])]

    for w in ("the", "één", "中", "zq1"):
        raw = np.frombuffer(w.encode(), np.uint8)
        _, lat = next(lattice.Words(raw, np.array([0, len(raw)])).lattices(v_))
        logs = [sum(v_.prior[i] for i in p) for p in paths("▁" + w)]
        total = np.logaddexp.reduce(logs)
        assert np.isclose(lat.marginal(v_.prior)[0], total)
        out, exp = np.zeros(len(v_.prior)), np.zeros(len(v_.prior))
        lat.expected(v_.prior, np.array([2]), out)
        for p, lp in zip(paths("▁" + w), logs, strict=True):
            for i in p:
                exp[i] += 2 * math.exp(lp - total)
        assert np.allclose(out, exp)


def test_one_very_long_word(spark):
    docs = spark.createDataFrame([(1, "ab1é" * 10_000), (2, "short one")], "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.likelihood(docs, F.lit(False), lattice.default_vocabulary(), rounds=1).collect()}
    assert got[1].n_tokens == 2 and -1e6 < got[1].score < -1e3 and -1e6 < got[1].plain_score < -1e3


def test_fitting_raises_the_likelihood(spark, odd_docs):
    score = lambda k: sum(r.score for r in lattice.likelihood(odd_docs, F.lit(False), lattice.default_vocabulary(), rounds=k).collect())
    assert score(0) < score(1) < score(2)


@pytest.mark.parametrize(
    "text,found",
    [
        ("password = hunter22", [("assign", 0, 19)]),
        ("x AKIA" + "A" * 16 + " AKIAB", [("access", 2, 22)]),
        ("k = 'pl4inV4lue!9'\ndb_password = k", [("literal", 5, 17)]),
        ('cfg["client_secret"] = "s3cr3tS3cr3t!"', [("literal", 24, 37)]),
        ("<apiKey>Ab12Cd34Ef56</apiKey>", [("literal", 8, 20)]),
        ("passphrase: 'Zx9' + 'Yw8Vv7'", [("literal", 13, 16), ("literal", 21, 27)]),
        ("token_url = 'https://x.example/y1'", []),
        ("name = 'Ab12Cd34Ef56'", []),
        ("auth_token := ${TOKEN_FROM_ENV}", []),
        ("", []),
        (None, []),
        ("ſecret=abcdefgh", []),
    ],
)
def test_secret_spans(text, found):
    assert secrets.spans(text) == found


def test_a_dropped_match_uses_up_its_text():
    assert secrets.base_spans("token=token:abcdefgh") == []


def test_secret_operator(spark):
    rows = [(1, "a password=abcdef1 b", 1), (None, None, 2), (2, "", 3), (1, "a password=abcdef1 b", 1), (3, "z" * 200_000 + "=" + "y" * 200_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = secrets.redact(docs)
    assert got.columns == docs.columns and sorted(str(r.text)[:30] for r in got.collect())[:4] == ["", "None", "a [SECRET] b", "a [SECRET] b"]
    assert secrets.find(docs).count() == 5 and secrets.find(docs.limit(0)).count() == 0


def test_substring_dedup(spark, odd_docs, odd_rows):
    width = 12
    words = [WORD.findall(t or "") for _, t in odd_rows]
    ids = [math.inf if d is None else d for d, _ in odd_rows]
    least = {}
    for d, w in zip(ids, words, strict=True):
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            least[k] = min(least.get(k, math.inf), d)
    want = []
    for (d, _), i, w in zip(odd_rows, ids, words, strict=True):
        gone = {q for p in range(len(w) - width + 1) if least[tuple(w[p : p + width])] < i for q in range(p, p + width)}
        want.append((d, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    got = substring_dedup.remove_repeats(odd_docs, window=width, block_bytes=2500, per_range=500).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=key) == sorted(want, key=key)
    assert all(sum(r.intervals[1::2]) - sum(r.intervals[::2]) == r.n_removed for r in got)
    assert substring_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


def test_windows_of_one_hash_are_told_apart_by_their_check():
    h = np.array([5, 5, 5, 7, 5], np.uint64)
    check = np.array([1, 2, 1, 1, 2], np.uint32)
    order, new = substring_dedup.distinct(h, check)
    groups = np.cumsum(new)[np.argsort(order, kind="stable")]
    assert groups[0] == groups[2] != groups[1] == groups[4] and len(set(groups.tolist())) == 3


def brute_components(fps, budget):
    v = sorted(set(fps))
    parent = list(range(len(v)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(v)):
        for j in range(i):
            if (v[i] ^ v[j]).bit_count() <= budget:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {f: v[top(i)] for i, f in enumerate(v)}


def test_simhash(spark, odd_docs, odd_rows):
    def fp(t):
        w = WORD.findall((t or "").translate(LOWER))
        sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in odd_rows]
    comp = brute_components(fps, 3)
    least = {}
    for (d, _), f in zip(odd_rows, fps, strict=True):
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    got = simhash.near_duplicates(odd_docs).collect()
    want = [(d, f, least.get(comp[f])) for (d, _), f in zip(odd_rows, fps, strict=True)]
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("budget,segments,split", [(3, 16, 4096), (3, 16, 8), (6, 32, 8)])
def test_links_span_all_components(spark, budget, segments, split):
    """Dense clusters and chains; small ``split`` forces second rings and blocks."""
    rng = np.random.default_rng(budget + split)
    fps = set()
    for _ in range(4):
        centre = int(rng.integers(0, 2**63))
        for _ in range(40):
            f = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                f ^= 1 << int(b)
            fps.add(f)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(spark, df, budget, split, segments).collect()]
    assert all((a ^ b).bit_count() <= budget for a, b in edges)
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    want = brute_components(fps, budget)
    groups = lambda m: {frozenset(f for f in fps if m(f) == r) for r in {m(f) for f in fps}}
    assert groups(top) == groups(want.get)


def test_star_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    got = {r.node: r.root for r in simhash.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {x: top(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_hot_keys_meet_by_broadcast(spark):
    left = spark.range(3000).selectExpr("IF(id % 2 = 0, 7, id) AS k", "id AS v")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = common.join_hot(left, right, "k", "n")
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect())) and got.count() == 3000


def test_a_third_of_all_texts_in_one_group(spark):
    """Copies, and a star of near fingerprints around one of them."""
    rows = [(i, "one two three four five") if i % 3 == 0 else (i, f"text number {i} of this") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.near_duplicates(docs)
    fps = {r.doc_id: r.fp % 2**64 for r in got.collect()}
    comp = brute_components(list(fps.values()), 3)
    least = {}
    for d, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], d), d)
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: least[comp[f]] for d, f in fps.items()}


def test_the_chain_filter_prunes():
    rings = simhash.Rings(3)
    rng = np.random.default_rng(1)
    key0 = int(rings.keys[0])
    fp = np.unique((rng.integers(0, 2**63, 2000).astype(np.uint64) & np.uint64(~key0 & 0xFFFFFFFFFFFFFFFF)))
    tally = np.zeros(len(rings.chains) + 2, np.int64)
    simhash.forest(fp, np.full(len(fp), len(fp)), [np.full(len(fp), m[0]) for m in rings.chains], 3, tally=tally)
    assert tally[1] < tally[0] / 50 and tally[-1] <= tally[2] <= tally[1]


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLES) <= set(registry.QUERIES)


def test_quality_sample_is_read_by_all_tasks(spark, tmp_path):
    """A table of many files: the scan that draws the sample keeps its partitions, and its rows meet in one."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    docs.repartition(24).write.parquet(str(tmp_path / "docs"))
    tracker = spark.sparkContext.statusTracker()
    with_conf = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "4096"}
    old = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        many = spark.read.parquet(str(tmp_path / "docs"))
        assert many.rdd.getNumPartitions() >= 24
        spark.sparkContext.setJobGroup("quality-sample", "")
        sample = quality.sampled(many, "text", 400)
        tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("quality-sample") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sample.count() > 200 and sum(t >= 24 for t in tasks) >= 2 and 1 in tasks  # the count and the sample


def test_quality_prices_are_of_what_is_not_known(spark, odd_docs):
    """Rules on measures that are worked out anyhow cost next to nothing."""
    docs = spark.range(300).select(F.repeat(F.lit("Some plain words of a text 12 # and more. "), 200).alias("text"))
    known = {r.name: cost for r, cost, _ in quality.profile(docs, quality.DEFAULT_RULES, known=quality.BASE_COLUMNS, repeats=3)}
    bare = {r.name: cost for r, cost, _ in quality.profile(docs, quality.DEFAULT_RULES, repeats=3)}
    assert known["repeated_windows"] < bare["repeated_windows"] and known["repeated_windows"] <= 2 * quality.LEAST_COST
    assert len(known) == len(quality.DEFAULT_RULES)
