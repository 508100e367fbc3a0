"""The queries' own columns on a small table of odd rows, and every query on empty tables."""

import array
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import lattice, packing, registry, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def key(row):
    return tuple(str(x) for x in row)


@pytest.fixture(scope="module")
def sf_dir(spark, odd_docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    more = [
        (30, "é password: 'hunter22' AKIA" + "B" * 16 + " " + "a1" * 12 + " then token=abc and Secret = longer_value", "clash", 1, "c", 5),
        (31, "token=token:abcdefgh api_key=\"zz1122\" AKIAX " + "f" * 23, "clash", 1, "c", 5),
        (32, "k = 'pl4inV4lue!9'\ndb_password = k + k\npwd: str = k", "clash", 1, "c", 5),
    ]
    odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema)).write.parquet(f"{d}/documents.parquet")
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(1, 40)] + [(3, None, None), (None, 1, 1), (3, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2"), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a/", "x"), (2, None, "x"), (None, "http://b/", None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, [0.5] * 64)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def crc(doc_id, divisor):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % divisor


def test_op2(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_vocabulary())
    got = registry.QUERIES["op2_packing"](spark, sf_dir).collect()
    want = collections.Counter()
    for d, t in docs:
        ids = array.array("I", [*tk.encode(t or "", add_special_tokens=False).ids, 0])
        for n, a in enumerate(range(0, len(ids), 2048)):
            own = ids[a : a + 2048]
            want[(d, n, a, len(own), zlib.crc32(own.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_op4(spark, sf_dir, docs):
    got = registry.QUERIES["op4_sharding"](spark, sf_dir).collect()
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs]
    assert sorted([(r.doc_id, r["size"], r.text_crc32) for r in got], key=key) == sorted(want, key=key)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None} and {r["shard"] for r in got} == set(range(8))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op5(spark, sf_dir, docs):
    got = registry.QUERIES["op5_toxicity"](spark, sf_dir).collect()
    assert sorted([(r.doc_id, r.held_out) for r in got], key=key) == sorted([(d, crc(d, 3) == 1) for d, _ in docs], key=key)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    # labels of held-out rows are not learnt from
    flipped = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = sf_dir + "-flipped"
    flipped.write.mode("overwrite").parquet(f"{other}/labels.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.mode("overwrite").parquet(f"{other}/documents.parquet")
    again = registry.QUERIES["op5_toxicity"](spark, other).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)


def test_op7(spark, sf_dir, docs):
    got = registry.QUERIES["op7_lattice"](spark, sf_dir).collect()
    assert sorted([(r.doc_id, r.held_out) for r in got], key=key) == sorted([(d, crc(d, 7) == 2) for d, _ in docs], key=key)
    assert all(r.score < 0 and r.fitted_score < 0 and r.base_score < 0 for r in got) and len({r.train_tokens for r in got}) == 1
    # score: all segmentations by the vocabulary's own weights
    v = lattice.vocabulary_of(lattice.default_vocabulary())
    sp = sentencepiece.SentencePieceProcessor(model_file=lattice.default_vocabulary())
    piece = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def paths(s):
        if not s:
            return [0.0]
        out = [sum(v.prior[v.bytes_[b]] for b in s[0].encode()) + rest for rest in paths(s[1:])]
        return out + [v.prior[piece[s[:k]]] + rest for k in range(1, len(s) + 1) if s[:k] in piece for rest in paths(s[k:])]

    short = [(r.score, t) for r in got for d, t in docs if d == r.doc_id and d in (6, 7, 8, 10)]
    assert len(short) == 4
    for score, t in short:
        logs = [np.logaddexp.reduce(paths("▁" + w.lower())) for w in (t or "").split()]
        assert math.isclose(score, (sum(logs) + v.prior[-1]) / math.log(10), rel_tol=1e-12)


def test_op8(spark, sf_dir, docs):
    """All columns: base spans from the patterns as they are written, and the method's own beside them."""

    def base(text):
        out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        order = ["assign", "access", "hex"]
        return sorted(out, key=lambda s: (s[1], order.index(s[0])))

    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = []
    for d, t in docs:
        own = base(t or "")
        n = collections.Counter(k for k, _, _ in own)
        want.append((d, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(own).encode()).hexdigest()))
    got = registry.QUERIES["op8_secrets"](spark, sf_dir).collect()
    assert sorted([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got], key=key) == sorted(want, key=key)
    by_text = {d: t for d, t in docs if d is not None}
    for r in got:
        own = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert [s for s in own if s[0] != "literal"] == base(by_text.get(r.doc_id) or "" if r.doc_id is not None else "")
    (constant,) = [r for r in got if r.doc_id == 32]
    assert constant.spans == "literal:5:17"  # where it was written, once


def test_secrets_stay_linear():
    """Constants that double, and many spans: both were quadratic or worse once."""
    import time

    doubling = "a='xY9zQ1kk'\n" + "".join(f"b{i}=b{i - 1}+b{i - 1}\n" if i else "b0=a+a\n" for i in range(200)) + "db_password=b199\n"
    assert secrets.spans(doubling) == [("literal", 3, 11)]
    took = []
    for n in (4000, 16000):
        text = "".join(f"password='ab{i}Zq9k'\ntoken_{i} = 'zz{i}Q1kkkq'\n" for i in range(n))
        began = time.perf_counter()
        secrets.spans(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_every_query_on_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in registry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
