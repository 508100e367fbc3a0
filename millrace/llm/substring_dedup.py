"""Removal of repeated word windows (exact substring deduplication).

Texts are stored in blocks of a few MB. Each block takes Rabin-Karp hashes of
every window of ``window`` words (modulo 2**64, over 64-bit word hashes, by
prefix sums; a second one of 24 bits, of another base, goes with it) and keeps
for each hash its least document id: later documents of the same block are
decided at once. What is left, one entry for a hash and
block, is dealt out by ranges of the hash and counted in Spark: an entry is
repeated if another block has the hash under a smaller id. The tasks that read
the blocks again look their repeated entries up, and repeated windows merge into
maximal removal intervals; texts are never shuffled.

A passage that a third of all documents share makes one entry a block, not one
a document. A range of hashes holds about ``per_range`` entries at every size
of input. Entries travel as byte planes of sorted arrays, which shuffle
compression shortens to about eleven bytes a window.

Results for odd input: null and wordless texts have no words and nothing
removed; a null document id counts as larger than every other, so such a text
loses what others have and keeps what only null ids share; rows of the same
document id never remove each other's windows; documents of fewer words than a
window are kept; an empty table gives an empty result; columns beyond the two
named ones are not read; ids that are no whole numbers count as null. Two
different windows are taken for equal with a chance of 2**-88 a pair, which is
less than one false pair among the 2e13 windows of 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_SPACE, Decisions, Finder, from_planes, planes, powers, scramble, spans_hash, store, text_chunks, word_spans

NO_ID = np.iinfo(np.int64).max
_ROLL = 0xD6E8FEB86659FD93
_CHECK = 0x9FB21C651E98DF25


def window_hashes(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows within documents, 24-bit checks beside them, and the word each starts at."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at = np.arange(int(n.sum())) + np.repeat(first[:-1] - np.r_[0, np.cumsum(n)[:-1]], n)

    def rolled(base: int) -> np.ndarray:
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(base, len(words)), out=total[1:])
        return scramble((total[at + window] - total[at]) * powers(pow(base, -1, 2**64), len(words))[at])

    return rolled(_ROLL), (rolled(_CHECK) >> np.uint64(40)).astype(np.uint32), at


def check_bytes(check: np.ndarray) -> bytes:
    """The three bytes that a check has, by their place."""
    return planes(check)[: 3 * len(check)]


def from_check_bytes(raw: bytes) -> np.ndarray:
    return from_planes(bytes(raw) + bytes(len(raw) // 3), np.uint32)


def distinct(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash and check, and where in it a new pair begins."""
    order = np.argsort(h, kind="stable")
    s, c = h[order], check[order]
    same = s[1:] == s[:-1]
    if (same & (c[1:] != c[:-1])).any():  # two windows of one hash: their rows may stand mixed
        order = np.lexsort((check, h))
        s, c = h[order], check[order]
        same = s[1:] == s[:-1]
    new = np.ones(len(s), bool)
    new[1:] = ~same | (c[1:] != c[:-1])
    return order, new


class Block:
    """The windows of one block of texts."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, window: int):
        self.data, self.window = data, window
        self.start, self.end, self.first = word_spans(data, bounds, NON_SPACE)
        h, check, self.at = window_hashes(spans_hash(data, self.start, self.end), self.first, window)
        of = ids[np.searchsorted(self.first, self.at, "right") - 1] if len(h) else np.zeros(0, np.int64)
        self.order, new = distinct(h, check)
        self.ids = of[self.order]
        self.group = np.cumsum(new) - 1
        lead = np.flatnonzero(new)
        self.hashes, self.checks = h[self.order[lead]], check[self.order[lead]]
        self.least = np.minimum.reduceat(self.ids, lead) if len(lead) else self.ids

    def ranges(self, count: int) -> np.ndarray:
        """Where each of ``count`` even ranges of the hash begins among the entries."""
        edges = np.array([(i << 64) // count for i in range(count)], np.uint64)
        return np.r_[np.searchsorted(self.hashes, edges), len(self.hashes)]

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        """For each word whether to remove it, given the entries that another
        block has under a smaller id."""
        out = repeated[self.group] | (self.ids > self.least[self.group]) if len(self.group) else np.zeros(0, bool)
        at = self.at[self.order[out]]
        depth = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + self.window, -1)
        return np.cumsum(depth[:-1]) > 0


BLOCK = "block long, n_words long, texts binary"


def to_blocks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows of about ``size`` bytes of text: an Arrow stream of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        bytes_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, held, bytes_held
            t = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            words = 0
            for b in t.to_batches():
                for _, _, data, bounds in text_chunks(b, "text", 1 << 20):
                    words += len(word_spans(data, bounds, NON_SPACE)[0])
            out = pa.RecordBatch.from_arrays([pa.array([serial]), pa.array([words]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "n_words", "texts"])
            serial, held, bytes_held = serial + 1, [], 0
            return out

        for b in batches:
            b = b.set_column(1, "text", b.column(1).fill_null(""))
            for i, j, data, _ in text_chunks(b, "text", size):
                if held and bytes_held + len(data) > size:
                    yield flush()
                held.append(b.slice(i, j - i))
                bytes_held += len(data)
        if held:
            yield flush()

    thin = docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(run, BLOCK)


def open_block(raw: bytes, window: int) -> tuple[pa.Array, Block, np.ndarray]:
    t = pa.ipc.open_stream(raw).read_all().combine_chunks()
    ids = t.column("id").chunk(0)
    (_, _, data, bounds) = next(text_chunks(t.to_batches()[0], "text", 1 << 62))
    return ids, Block(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), data, bounds, window), bounds


def repeated_entries(spark: SparkSession, blocks: DataFrame, window: int, ranges: int) -> DataFrame:
    """(block, part, entries): entries that another block has under a smaller id."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("texts"), strict=True):
                _, own, _ = open_block(raw.as_buffer(), window)
                cut = own.ranges(ranges)
                full = np.flatnonzero(np.diff(cut))
                for some in np.array_split(full, max(1, len(full) // 512)):
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(some.astype(np.int32)),
                                pa.array(np.full(len(some), block)),
                                pa.array([planes(own.hashes[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                                pa.array([check_bytes(own.checks[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                                pa.array([planes(own.least[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                            ],
                            ["part", "block", "hashes", "checks", "ids"],
                        )

    def count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        names = t.column("block").to_numpy()
        hashes = [from_planes(x.as_buffer(), np.uint64) for x in t.column("hashes")]
        h = np.concatenate(hashes)
        ids = np.concatenate([from_planes(x.as_buffer(), np.int64) for x in t.column("ids")])
        order, new = distinct(h, np.concatenate([from_check_bytes(x.as_buffer()) for x in t.column("checks")]))
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        late = np.zeros(len(h), bool)
        late[order] = ids[order] > least
        out_block, out = [], []
        at = 0
        for name, own in zip(names, hashes, strict=True):
            found = np.flatnonzero(late[at : at + len(own)]).astype(np.uint32)
            at += len(own)
            if len(found):
                out_block.append(name)
                out.append(found.tobytes())
        part = pa.array([key[0].as_py()] * len(out), pa.int32())
        return pa.table({"block": pa.array(out_block, pa.int64()), "part": part, "entries": pa.array(out, pa.binary())})

    dealt = blocks.select("block", "texts").mapInArrow(deal, "part int, block long, hashes binary, checks binary, ids binary")
    return dealt.groupBy("part").applyInArrow(count, "block long, part int, entries binary")


OUT = "id long, n_words long, n_removed long, kept_text string, intervals array<int>"


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block_bytes: int = 4 << 20, per_range: int = 1 << 20
) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text, intervals): one row per document.

    intervals: starts and ends (exclusive) of the removed runs of words, in
    turn. kept_text: the other words, one space between.
    """
    spark = docs.sparkSession
    blocks = store(spark, to_blocks(docs, id_col, text_col, block_bytes), "repeat-blocks")
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // per_range))
    found = store(spark, repeated_entries(spark, blocks, window, ranges), "repeat-entries")
    # a block's entries together, which are at most its windows
    of_block = found.groupBy(F.lit(0).cast("long").alias("file"), F.col("block").alias("row")).agg(F.collect_list(F.struct("part", "entries")).alias("found"))
    decisions = Decisions.write(spark, of_block, "repeat-decisions", per_file=1024)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(decisions)
        for b in batches:
            for block, raw in zip(b.column("block").to_numpy(zero_copy_only=False), b.column("texts"), strict=True):
                ids, own, _ = open_block(raw.as_buffer(), window)
                repeated = np.zeros(len(own.hashes), bool)
                edges = own.ranges(ranges)
                for _, values in finder.find(np.zeros(1, np.int64), np.array([block])):
                    for x in values.column("found")[0]:
                        repeated[edges[x["part"].as_py()] + np.frombuffer(x["entries"].as_buffer(), np.uint32)] = True
                yield from rendered(ids, own, own.removed(repeated)).to_batches()

    return blocks.select("block", "texts").mapInArrow(cut, OUT).withColumnRenamed("id", id_col)


def rendered(ids: pa.Array, own: Block, gone: np.ndarray) -> pa.Table:
    kept = np.flatnonzero(~gone)
    size = own.end[kept] - own.start[kept]
    to = np.r_[0, np.cumsum(size + 1)]
    out = np.full(int(to[-1]), 0x20, np.uint8)
    keep_byte = np.zeros(len(own.data) + 1, np.int8)
    keep_byte[own.start[kept]] += 1
    keep_byte[own.end[kept]] -= 1
    src = np.flatnonzero(np.cumsum(keep_byte[:-1], dtype=np.int8))
    out[src + np.repeat(to[:-1] - own.start[kept], size)] = own.data[src]
    raw = out.tobytes()
    first = np.searchsorted(kept, own.first)
    texts = [raw[to[a] : max(to[a], to[b] - 1)] for a, b in zip(first, first[1:], strict=False)]
    edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
    # runs end where a document ends, too
    inner = own.first[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(gone))])
    inner = inner[gone[inner - 1] & gone[inner]] if len(inner) else inner
    begin = np.sort(np.r_[np.flatnonzero(edge == 1), inner])
    stop = np.sort(np.r_[np.flatnonzero(edge == -1), inner])
    doc = np.searchsorted(own.first, begin, "right") - 1
    pairs = np.stack([begin - own.first[doc], stop - own.first[doc]], 1).astype(np.int32).ravel()
    per = np.searchsorted(begin, own.first) * 2
    total = np.diff(own.first)
    removed = np.r_[0, np.cumsum(gone)]
    return pa.table(
        {
            "id": ids,
            "n_words": pa.array(total.astype(np.int64)),
            "n_removed": pa.array((removed[own.first[1:]] - removed[own.first[:-1]]).astype(np.int64)),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            "intervals": pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(pairs)),
        }
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT rid, doc_id, p, array_to_string(w[p:p + 49], ' ') AS t
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
least AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 50)) AS k FROM win JOIN least USING (t) WHERE m < coalesce(doc_id, 9223372036854775807)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
kept AS (SELECT word.rid, string_agg(x, ' ' ORDER BY k) AS s, count(*) AS n FROM word ANTI JOIN gone USING (rid, k) GROUP BY word.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
