"""The corpus pipeline, each stage against a brute-force version on its own input."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from millrace.llm import common, packing, secrets
from millrace.llm.common import store

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rejected(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {q for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for q in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    letters = sum(any(c.isalpha() for c in x) for x in w)
    chars = sum(map(len, w))
    return (
        len(w) < 50
        or 100 * len(again) > 50 * len(w)
        or 10 * len(re.findall(r"[#*$%&|<>]", text)) > len(w)
        or 2 * (len(lines) - len(set(lines))) > len(lines)
        or 10 * letters < 8 * len(w)
        or sum(c.isupper() for c in text) > sum(c.islower() for c in text)
        or not 2 * len(w) <= chars <= 20 * len(w)
    )


def groups(texts, shingle=5):
    """Labels of connected texts of a Jaccard similarity of 4/5 or more."""
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set() for w in words]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def hit_share(text, items, width=13):
    w, hit = ITEM_WORD.findall((text or "").translate(LOWER)), set()
    for t in items:
        own = ITEM_WORD.findall((t or "").translate(LOWER))
        for p in range(max(1, len(own) - width + 1)) if own else ():
            win = own[p : p + width]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
    return bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def sf_dir(spark, odd_docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    by_id = {r.doc_id: r.text for r in odd_docs.collect()}
    item = " ".join(by_id[12].split()[:20])
    rng = random.Random(11)
    secret = " ".join(f"v{rng.randint(0, 500)}" for _ in range(80)) + " api_key = 'Zx81hdkqPLx92' and more"
    more = spark.createDataFrame([(20, secret, "clash", 1, "c", 5), (21, by_id[12] + " " + by_id[9][:200], "clash", 1, "c", 5)], odd_docs.schema)
    docs = odd_docs.unionByName(more).selectExpr("*", "cast(length(text) as int) as n_chars", "'en' as lang", "'s' as source")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, item


def rows(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_stages(spark, sf_dir):
    d, item = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secret scan", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = store(spark, stage(spark, docs, d), "test-stage")
        if name != "best-fit packing":
            assert out.columns == docs.columns, name
        before = docs.collect()
        if name == "quality rules":
            assert rows(out) == sorted((str(r.doc_id), str(r.text)) for r in before if not rejected(r.text))
        elif name == "near duplicates":
            label = groups([r.text for r in before])
            of = {}
            for r, g in zip(before, label, strict=True):
                of.setdefault((r.doc_id, r.text), g)
            kept = [of[(r.doc_id, r.text)] for r in out.collect()]
            assert sorted(kept) == sorted(set(label))
            for r in out.collect():  # the least id of its group
                own = [x.doc_id for x, g in zip(before, label, strict=True) if g == of[(r.doc_id, r.text)]]
                assert r.doc_id == min((d for d in own if d is not None), default=None)
        elif name == "decontamination":
            assert rows(out) == sorted((str(r.doc_id), str(r.text)) for r in before if not hit_share(r.text, [item]))
            assert len(before) > out.count()
        elif name == "secret scan":
            want = sorted((str(r.doc_id), secrets.redacted(r.text, secrets.spans(r.text), "[SECRET]")) for r in before)
            assert rows(out) == want and any("[SECRET]" in t for _, t in want)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        else:
            cache = packing.WordCache(packing.default_vocabulary())
            want = Counter()
            for r in before:
                want[r.doc_id] += len(cache.encode(r.text)) // 4 + 1
            got, ids = Counter(), Counter()
            for r in out.collect():
                got[r.doc_id] += r.length
                ids[bytes(r.ids)] += 1
            assert got == want
            assert ids == Counter(raw[a : a + 8192] for raw in (cache.encode(r.text) + bytes(4) for r in before) for a in range(0, len(raw), 8192))
        docs = out


def test_empty_table(spark, sf_dir, tmp_path):
    d, _ = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = store(spark, stage(spark, docs, d), "test-empty")
        assert docs.count() == 0


def test_stages_keep_nulls_and_repeats_apart(spark, sf_dir):
    """Every stage on rows that quality rules would not let through."""
    d, _ = sf_dir
    docs = spark.createDataFrame([(None, None, 1), (None, "x", None), (1, "", 3), (1, "", 3), (2, None, 4)], "doc_id long, text string, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, docs, d).count()
        assert n == {"quality rules": 0, "near duplicates": 2, "decontamination": 5, "secret scan": 5, "best-fit packing": 5}[name], name


def test_run_leaves_only_its_result(spark, sf_dir):
    d, _ = sf_dir
    before = list(common._written)
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and len(common._written) == len(before) + 1
