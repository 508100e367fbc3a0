"""Merges that touch what changed, two writers, and the feed of changes."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import buckets, store, upsert
from millrace.sources.changes import stored_changes
from millrace.streaming.replay import replayed


def payloads(spark, rows):
    """(seq, page, content)"""
    df = spark.createDataFrame(rows, "seq long, page string, content string")
    return store.payloads(df, F.lit("web"), F.concat(F.lit("https://site.example/"), "page"), F.col("content"), F.col("seq"))


@pytest.fixture()
def root(spark, tmp_path):
    r = str(tmp_path / "store")
    buckets.create(spark, r, *store.snapshot(payloads(spark, [(i, f"p{i}", f"text number {i} " * 50) for i in range(200)])), buckets=32)
    return r


def rows(spark, root, number=None):
    return {r.source_path.rsplit("/", 1)[1]: (r.doc_uid, r.updated_seq) for r in buckets.read(spark, root, "sources", number).collect()}


def live(spark, root):
    chunks = buckets.read(spark, root, "chunks").where("NOT is_deleted").join(buckets.read(spark, root, "sources").select("doc_uid", "source_path"), "doc_uid")
    return {r.source_path.rsplit("/", 1)[1]: r.chunk_text for r in chunks.collect()}


def test_a_merge_writes_only_its_buckets(spark, root):
    before = {p for p, _, _ in os.walk(root)}
    answers = buckets.merge(spark, root, payloads(spark, [(1000, "p7", "new words"), (1001, "p9", "text number 9 " * 50), (1002, "fresh", "first words")]))
    assert {r.seq: r.action for r in answers.collect()} == {1000: "updated", 1001: "skipped", 1002: "created"}
    assert buckets.latest(spark, root) == 1
    new = [d for d, _, _ in os.walk(root) if d not in before and "/sources/bucket=" in d]
    touched = {r[0] for r in payloads(spark, [(0, p, "") for p in ("p7", "p9", "fresh")]).select(buckets.bucket(F.col("source_path"), 32)).collect()}
    assert {int(d.rsplit("=", 1)[1]) for d in new} == touched and len(touched) <= 3
    # states share the folders of all other buckets
    one, two = buckets.state(spark, root, 0), buckets.state(spark, root, 1)
    assert {int(b) for b in two["sources"] if one["sources"].get(b) != two["sources"][b]} == touched
    assert live(spark, root)["p7"] == "new words" and live(spark, root)["fresh"] == "first words" and len(rows(spark, root)) == 201
    # a plan over touched buckets reads no other files
    plan = buckets.read(spark, root, "sources", only=sorted(touched)).inputFiles()
    assert all(int(f.split("bucket=")[1].split("/")[0]) in touched for f in plan)


def test_merges_equal_one_merge_of_the_whole_store(spark, root):
    later = [(1000 + i, f"p{i * 3 % 260}", f"other {i % 7} text") for i in range(150)]
    sources, chunks = (buckets.read(spark, root, n).drop("bucket") for n in buckets.TABLES)
    m = upsert.merge(payloads(spark, later), sources, chunks)
    want = {tuple(r) for r in m.sources.select(*buckets.SOURCE).collect()}
    want_chunks = sorted(map(str, (r.asDict() for r in m.chunks.select(sorted(m.chunks.columns)).collect())))
    for a in range(0, 150, 50):
        buckets.merge(spark, root, payloads(spark, later[a : a + 50]))
    assert {tuple(r) for r in buckets.read(spark, root, "sources").select(*buckets.SOURCE).collect()} == want
    got = buckets.read(spark, root, "chunks").drop("bucket")
    # flagged chunks of contents in between are kept, too; the live ones are equal
    now = sorted(map(str, (r.asDict() for r in got.where("NOT is_deleted").select(sorted(got.columns)).collect())))
    assert now == [c for c in want_chunks if "'is_deleted': False" in c]


@pytest.mark.parametrize("page,tries", [("p8", 1), ("p7", 2)])
def test_two_writers_lose_nothing(spark, root, page, tries):
    """The second writer commits while the first is about to: in other buckets, or in the same."""
    b = dict(payloads(spark, [(0, "p7", ""), (1, "p8", "")]).select("source_path", buckets.bucket(F.col("source_path"), 32)).collect())
    assert len(set(b.values())) == 2
    began = []

    def other():
        began.append(1)
        if len(began) == 1:
            buckets.merge(spark, root, payloads(spark, [(2000, page, "theirs"), (2001, "p7x" if page == "p7" else page, "theirs")]))

    buckets.merge(spark, root, payloads(spark, [(3000, "p7", "ours")]), before=other)
    found = live(spark, root)
    assert found["p7"] == "ours" and len(began) == tries and buckets.latest(spark, root) == 2
    assert found["p8" if page == "p8" else "p7x"] == "theirs"
    assert rows(spark, root)["p7"][1] == 3000


def test_a_number_is_taken_once(spark, root):
    assert not buckets._put(spark, root, 0, {}) and buckets._put(spark, root, 1, buckets.state(spark, root, 0))
    with pytest.raises(FileExistsError):
        buckets.create(spark, root, *store.snapshot(payloads(spark, [(1, "a", "b")])))


def test_the_feed_loses_and_repeats_nothing(spark, root, tmp_path):
    folder = str(tmp_path / "feed")
    feed = lambda: [(r.version, r.change, r.source_path.rsplit("/", 1)[1]) for r in replayed(stored_changes(spark, root), "feed", folder).collect()]
    first = feed()
    assert len(first) == 200 and {c for _, c, _ in first} == {"created"}
    buckets.merge(spark, root, payloads(spark, [(1000, "p7", "new words"), (1001, "p9", "text number 9 " * 50), (1002, "fresh", "x")]))
    buckets.delete(spark, root, buckets.read(spark, root, "sources").where("source_path LIKE '%/p1_'").select("source_path"))
    # started again from its checkpoint, over two states at once
    added = [r for r in feed() if r not in set(first)]
    assert sorted(added) == sorted([(1, "created", "fresh"), (1, "updated", "p7"), *[(2, "deleted", f"p1{i}") for i in range(10)]])
    assert len(feed()) == 212  # nothing new: nothing again
    flagged = buckets.read(spark, root, "chunks").where("is_deleted").count()
    assert flagged == 10 + 1 and len(rows(spark, root)) == 191
    # the first page, kept by the feed's rows alone
    page = {p: (v, c) for v, c, p in sorted(feed())}
    assert {p for p, (_, c) in page.items() if c != "deleted"} == set(rows(spark, root))
