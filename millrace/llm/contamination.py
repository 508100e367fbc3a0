"""Benchmark decontamination over a positional inverted index.

The index is a table of segments in the shared folder, one for each few MB of
training text: the sorted 64-bit terms, the length of each term's posting list,
and the lists themselves (positions as gaps). A segment holds whole documents,
so that a phrase never crosses segments, building needs no shuffle, and a query
reads one segment at a time.

A query is a set of phrases: the windows of benchmark items. Tasks cut the items
into runs of word hashes, which go out to the index in batches of about
``batch_words`` words; a batch is arrays of some 40 bytes a word on the driver and
in each worker, whatever the size of the benchmark. Corpus-wide frequencies of
the query's terms order each phrase from its rarest term. In a segment the rarest
term's list, shifted by the term's offset, gives candidate starts; each further
list keeps those that it has at its own offset. Proximity search takes the rarest
term's postings as anchors and asks each other term for a posting of the same
document at most ``within`` words away. With several batches only hits leave the
search, and they meet the documents' sizes once.

Results for odd input: null and wordless texts have no words and are not
contaminated; null items have no windows; an item id is counted once however
often it is repeated, a null id is shown as an empty string; null and repeated
document ids pass through, each row judged by itself; an empty benchmark hits
nothing; an empty table gives an empty result; columns beyond the named ones
are not read. Words are told apart by 64-bit hashes, windows of items by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, from_planes, planes, powers, scramble, spans_hash, store, text_chunks, word_spans

SEGMENT = "segment long, ids binary, first binary, terms binary, counts binary, gaps binary"


def term_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and where each text's words begin."""
    low = LOWER[data]
    start, end, first = word_spans(low, bounds, ALNUM)
    return spans_hash(low, start, end), first


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4 << 20) -> DataFrame:
    """The segments of all documents, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        words: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, ids, words, sizes, held
            term = np.concatenate(words)
            order = np.argsort(term, kind="stable").astype(np.uint32)
            term = term[order]
            lead = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            gaps = np.diff(order, prepend=np.uint32(0))
            gaps[lead] = order[lead]
            sink = pa.BufferOutputStream()
            t = pa.table({"id": pa.chunked_array(ids)})
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            row = {
                "segment": pa.array([serial]),
                "ids": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                "first": pa.array([np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int64).tobytes()], pa.binary()),
                "terms": pa.array([planes(term[lead])], pa.binary()),
                "counts": pa.array([planes(np.diff(np.r_[lead, len(term)]).astype(np.uint32))], pa.binary()),
                "gaps": pa.array([planes(gaps)], pa.binary()),
            }
            serial, ids, words, sizes, held = serial + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(list(row.values()), list(row))

        for b in batches:
            for i, j, data, bounds in text_chunks(b, "text", size):
                if held and held + len(data) > size:
                    yield flush()
                term, first = term_hashes(data, bounds)
                ids.append(b.column("id").slice(i, j - i))
                words.append(term)
                sizes.append(np.diff(first))
                held += len(data)
        if ids:
            yield flush()

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return store(docs.sparkSession, thin.mapInArrow(run, SEGMENT), "postings")


class Segment:
    """A stored segment; only lists that are asked for are decoded."""

    def __init__(self, row: dict):
        self.ids = pa.ipc.open_stream(row["ids"]).read_all().column("id").combine_chunks()
        self.first = np.frombuffer(row["first"], np.int64)
        self.terms = from_planes(row["terms"], np.uint64)
        self.counts = from_planes(row["counts"], np.uint32).astype(np.int64)
        self._gaps = row["gaps"]

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending terms: bounds of their lists, and the lists in a row."""
        gaps = from_planes(self._gaps, np.uint32)
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        n = np.where(self.terms[at] == terms, self.counts[at], 0) if len(self.terms) else np.zeros(len(terms), np.int64)
        start = (np.cumsum(self.counts) - self.counts)[at] if len(self.terms) else n
        bounds = np.r_[0, np.cumsum(n)]
        take = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], n)
        total = np.cumsum(gaps[take].astype(np.int64))
        base = np.repeat(np.r_[0, total][bounds[:-1]], n)
        return bounds, total - base

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


class Phrases:
    """Distinct windows of items as places in one row of term numbers.

    pieces: (owner, words' hashes); a piece of fewer than ``width`` words is one
    phrase. frequency: corpus-wide postings of each of ``terms(pieces)``.
    """

    def __init__(self, pieces: list[tuple[str, np.ndarray]], width: int, frequency: np.ndarray | None = None):
        words = np.concatenate([w for _, w in pieces]) if pieces else np.zeros(0, np.uint64)
        self.terms, of = np.unique(words, return_inverse=True)
        self.of = of.astype(np.int32)
        self.seen = np.ones(len(self.terms), np.int64) if frequency is None else frequency
        self.names, name = np.unique(np.array([o for o, _ in pieces], object), return_inverse=True) if pieces else (np.zeros(0, object), np.zeros(0, np.int64))
        size = np.array([len(w) for _, w in pieces], np.int64)
        count = np.maximum(size - width + 1, np.minimum(size, 1))
        first = np.cumsum(size) - size
        start = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
        length = np.repeat(np.minimum(size, width), count)
        owner = np.repeat(name, count)
        # equal windows are one phrase with the owners of all
        marks = np.stack([self._hash(words, start, length, base) for base in (_ROLL, _ROLL + 2)], 1)
        _, lead, window = np.unique(np.ascontiguousarray(marks).view("V16").ravel(), return_index=True, return_inverse=True) if len(start) else (None, start, start)
        self.start, self.length = start[lead].astype(np.int32), length[lead].astype(np.int16)
        pairs = np.unique(window * np.int64(max(len(self.names), 1)) + owner)
        self.owner = (pairs % max(len(self.names), 1)).astype(np.int32)
        self.owner_at = np.searchsorted(pairs // max(len(self.names), 1), np.arange(len(lead) + 1)).astype(np.int32)
        self.widest = int(self.length.max()) if len(lead) else 0
        # the rarest term of each phrase (of equals the first), and its offset
        self.lead, self.lead_offset = self.of[self.start].copy() if len(lead) else self.of[:0], np.zeros(len(lead), np.int16)
        for k in range(1, self.widest):
            term = self.of[np.minimum(self.start + k, len(self.of) - 1)]
            rarer = (k < self.length) & (self.seen[term] < self.seen[self.lead])
            self.lead[rarer], self.lead_offset[rarer] = term[rarer], k

    @staticmethod
    def _hash(words: np.ndarray, start: np.ndarray, length: np.ndarray, base: int) -> np.ndarray:
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(base, len(words)), out=total[1:])
        h = (total[start + length] - total[start]) * powers(pow(base, -1, 2**64), max(len(words), 1))[start]
        return scramble(h + length.astype(np.uint64))

    def owners(self, phrase: np.ndarray) -> list[str]:
        """The sorted distinct owners of some phrases."""
        n = self.owner_at[phrase + 1] - self.owner_at[phrase]
        at = np.arange(int(n.sum())) + np.repeat(self.owner_at[phrase] - (np.cumsum(n) - n), n)
        return sorted(self.names[np.unique(self.owner[at])].tolist())

    def batches(self, counts: np.ndarray, most: int = 1 << 18, phrases: int = 1 << 15) -> Iterator[np.ndarray]:
        """Phrases all of whose terms have postings, in runs of about ``most`` candidates."""
        if not len(self.start):
            return
        lacking = np.r_[0, np.cumsum(counts[self.of] == 0)]
        alive = np.flatnonzero(lacking[self.start + self.length] == lacking[self.start])
        load = np.cumsum(counts[self.lead[alive]])
        i = 0
        while i < len(alive):
            before = load[i - 1] if i else 0
            j = max(i + 1, min(i + phrases, int(np.searchsorted(load, before + most, "right"))))
            yield alive[i:j]
            i = j

    def rarest_first(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms (-1: none) and offsets of some phrases, by rarity."""
        place = np.arange(self.widest)
        inside = place < self.length[some][:, None]
        term = np.where(inside, self.of[np.minimum(self.start[some][:, None] + place, len(self.of) - 1)], -1)
        rank = np.where(inside, self.seen[term], np.iinfo(np.int64).max)
        offset = np.argsort(rank, axis=1, kind="stable")
        return np.take_along_axis(term, offset, 1), offset

    def matches(self, seg: Segment, within: int | None) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(phrase, first position) of every occurrence within a document, and
        (phrase, position of its rarest term) of every proximity match."""
        bounds, lists = seg.lists(self.terms)
        reach = within or 0
        space = np.int64(seg.first[-1] + 1 + reach)
        keys = np.repeat(np.arange(len(self.terms)), np.diff(bounds)) * space + lists
        none = np.zeros(0, np.int64)
        exact, near = [(none, none)], [(none, none)]
        for some in self.batches(np.diff(bounds)):
            term, offset = self.rarest_first(some)
            n = bounds[self.lead[some] + 1] - bounds[self.lead[some]]
            row = np.repeat(np.arange(len(some)), n)
            at = lists[np.arange(int(n.sum())) + np.repeat(bounds[self.lead[some]] - (np.cumsum(n) - n), n)]
            if within is not None:
                close = self._close(seg, keys, space, term, row, at, within)
                near.append((some[close[0]], close[1]))
                if within >= self.widest - 1:  # an occurrence is then a proximity match, too
                    row, at = close
            start = at - offset[row, 0]
            keep = (start >= 0) & (start + self.length[some[row]] < space - reach)
            row, start = row[keep], start[keep]
            for k in range(1, self.widest):
                if not len(row):
                    break
                t = term[row, k]
                want = t * space + start + offset[row, k]
                keep = (t < 0) | (keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want)
                row, start = row[keep], start[keep]
            if len(row):
                keep = seg.doc_of(start) == seg.doc_of(start + self.length[some[row]] - 1)
                exact.append((some[row[keep]], start[keep]))
        both = [tuple(np.concatenate([f[i] for f in found]) for i in (0, 1)) for found in (exact, near)]
        return both[0], both[1]

    def _close(self, seg: Segment, keys: np.ndarray, space: np.int64, term: np.ndarray, row: np.ndarray, at: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors with every term of the phrase in their document and in reach."""
        for k in range(1, self.widest):
            if not len(row):
                break
            doc = seg.doc_of(at)
            low, high = np.maximum(at - within, seg.first[doc]), np.minimum(at + within, seg.first[doc + 1] - 1)
            t = term[row, k]
            got = keys[np.minimum(np.searchsorted(keys, t * space + low), len(keys) - 1)]
            keep = (t < 0) | ((got >= t * space + low) & (got <= t * space + high))
            row, at = row[keep], at[keep]
        return row, at


_ROLL = 0xA0761D6478BD642F


def item_pieces(benchmark: DataFrame, item_col: str, text_col: str, width: int, most: int = 1 << 15) -> DataFrame:
    """(item, words, n): hashes of the words of each item, cut into runs of at
    most ``most`` windows, each word window in exactly one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in text_chunks(b, "text", 1 << 20):
                words, first = term_hashes(data, bounds)
                names, own = [], []
                for name, a, z in zip(b.column("item").slice(i, j - i).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    for s in range(a, max(z - width + 1, min(a + 1, z)), most):
                        names.append(name)
                        own.append(words[s : min(s + most + width - 1, z)])
                cols = [pa.array(names, pa.string()), pa.array([w.tobytes() for w in own], pa.binary()), pa.array([len(w) for w in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["item", "words", "n"])

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    return items.mapInArrow(run, "item string, words binary, n long")


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Postings of each of the ascending terms over the whole index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for t, c in zip(b.column("terms"), b.column("counts"), strict=True):
                own, count = from_planes(t.as_buffer(), np.uint64), from_planes(c.as_buffer(), np.uint32)
                if len(own):
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    total += np.where(own[at] == terms, count[at], 0)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        got = index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


def _by_doc(seg: Segment, phrase: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, phrases, positions in it) of matches, by position."""
    doc = seg.doc_of(at)
    order = np.lexsort((at, doc))
    phrase, doc, at = phrase[order], doc[order], at[order]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
    for a, z in zip(cuts, [*cuts[1:], len(doc)], strict=False):
        yield int(doc[a]), phrase[a:z], at[a:z] - seg.first[doc[a]]


SIZES = "segment long, row long, id {kind}, n_words long"
FOUND = "spans array<int>, owners array<string>, near array<string>"


def search(index: DataFrame, phrases: Phrases, id_type: str, within: int | None = None, hits_only: bool = False) -> DataFrame:
    """Matches of phrases in the index: (segment, row, id, n_words, spans, owners,
    near), one row per document of it, or only of those with a match.

    spans are starts and ends (exclusive) of exact matches in words, merged where
    they overlap; owners are the sorted distinct owners of the phrases found, and
    near those of phrases found by proximity (empty without ``within``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                seg = Segment({n: b.column(n)[row].as_buffer() for n in b.schema.names if n != "segment"})
                n = len(seg.ids)
                spans: list[list[int]] = [[]] * n
                owners: list[list[str]] = [[]] * n
                near: list[list[str]] = [[]] * n
                if len(phrases.terms) and seg.first[-1]:
                    exact, close = phrases.matches(seg, within)
                    for doc, phrase, at in _by_doc(seg, *exact):
                        merged: list[int] = []
                        for s, e in zip(at.tolist(), (at + phrases.length[phrase]).tolist(), strict=True):
                            if merged and s <= merged[-1]:
                                merged[-1] = max(merged[-1], e)
                            else:
                                merged += [s, e]
                        spans[doc], owners[doc] = merged, phrases.owners(np.unique(phrase))
                    for doc, phrase, _ in _by_doc(seg, *close):
                        near[doc] = phrases.owners(np.unique(phrase))
                some = np.flatnonzero([bool(s or c) for s, c in zip(spans, near, strict=True)]) if hits_only else np.arange(n)
                cols = [
                    pa.array([b.column("segment")[row].as_py()] * len(some), pa.int64()),
                    pa.array(some),
                    seg.ids.take(pa.array(some)),
                    pa.array(np.diff(seg.first)[some]),
                    pa.array([spans[i] for i in some], pa.list_(pa.int32())),
                    pa.array([owners[i] for i in some], pa.list_(pa.string())),
                    pa.array([near[i] for i in some], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["segment", "row", "id", "n_words", "spans", "owners", "near"])

    return index.mapInArrow(run, f"{SIZES.format(kind=id_type)}, {FOUND}")


def sizes(index: DataFrame, id_type: str) -> DataFrame:
    """(segment, row, id, n_words) of every document of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, ids, first in zip(b.column("segment").to_pylist(), b.column("ids"), b.column("first"), strict=True):
                own = pa.ipc.open_stream(ids.as_buffer()).read_all().column("id").combine_chunks()
                n = np.diff(np.frombuffer(first.as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([segment] * len(n), pa.int64()), pa.array(np.arange(len(n))), own, pa.array(n)], ["segment", "row", "id", "n_words"])

    return index.select("segment", "ids", "first").mapInArrow(run, SIZES.format(kind=id_type))


def covered(spans: Column) -> Column:
    """Words in merged spans (starts and ends in turn)."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def merge_spans(spans: Column) -> Column:
    """One list of merged spans from a list of such lists."""
    full = F.filter(spans, lambda s: F.size(s) > 0)
    pairs = F.flatten(F.transform(full, lambda s: F.transform(F.sequence(F.lit(1), F.size(s), F.lit(2)), lambda i: F.array(F.get(s, i - 1), F.get(s, i)))))
    pairs = F.sort_array(pairs)
    last = lambda a: F.element_at(a, -1)
    step = lambda a, p: F.when(
        (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit(-1)) >= p[0]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.greatest(last(a), p[1]))),
    ).otherwise(F.concat(a, p))
    return F.aggregate(pairs, F.array().cast("array<int>"), step)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    share: int = 20,
    within: int | None = None,
    batch_words: int = 1 << 19,
) -> DataFrame:
    """(id_col, n_words, n_hit, items, spans, near_items, contaminated), one row per
    document.

    A word is hit if an occurrence of a window covers it. contaminated: at
    least one word in ``share`` is hit. near_items: with ``within``, the items of
    which a window's words all stand that near its rarest one (exact or not).
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    index = build_index(docs, id_col, text_col)
    pieces = store(spark, item_pieces(benchmark, item_col, item_text_col, width), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    batches = -(-total // batch_words) or 1

    def phrases(part: DataFrame) -> Phrases:
        got = part.select("item", "words").toArrow()
        own = [(o, np.frombuffer(w.as_buffer(), np.uint64)) for o, w in zip(got.column("item").to_pylist(), got.column("words"), strict=True)]
        terms = np.unique(np.concatenate([w for _, w in own])) if own else np.zeros(0, np.uint64)
        return Phrases(own, width, frequencies(index, terms))

    if batches == 1:
        found = search(index, phrases(pieces), kind, within)
    else:
        number = F.pmod(F.xxhash64("item", "words"), F.lit(batches))
        hits = [store(spark, search(index, phrases(pieces.where(number == i)), kind, within, hits_only=True), "benchmark-hits") for i in range(batches)]
        # at most a row for each batch in a group
        merged = reduce(DataFrame.unionAll, hits).groupBy("segment", "row").agg(
            merge_spans(F.collect_list("spans")).alias("spans"),
            *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("owners", "near")],
        )
        none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
        found = sizes(index, kind).join(merged, ["segment", "row"], "left").select("id", "n_words", none("spans", "int"), none("owners", "string"), none("near", "string"))
    return found.select(
        F.col("id").alias(id_col), "n_words", covered(F.col("spans")).alias("n_hit"), F.col("owners").alias("items"), "spans", F.col("near").alias("near_items")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


#: Reach of the query's proximity matches in words: two windows.
NEAR = 26


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contaminated(docs, items, within=NEAR)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + 12], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
place AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS t
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT rid, item_id, n, p FROM place JOIN win USING (n, t)),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT rid, n, p FROM hit)) GROUP BY rid),
word AS (SELECT rid, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
freq AS (SELECT t, count(*) AS f FROM word GROUP BY t),
phrase AS (SELECT DISTINCT w[p:p + 12] AS x FROM (SELECT w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lead AS (SELECT x, arg_min(t, (f, k)) AS t FROM (SELECT x, unnest(x) AS t, generate_subscripts(x, 1) AS k FROM phrase) LEFT JOIN freq USING (t)
         GROUP BY x HAVING count(f) = count(*)),
close AS (SELECT DISTINCT rid, x FROM lead JOIN word USING (t) JOIN d USING (rid)
          WHERE len(list_filter(x, lambda y: NOT list_contains(w[greatest(1, p - {NEAR}):p + {NEAR}], y))) = 0),
near AS (SELECT rid, count(DISTINCT item_id::VARCHAR) AS n_near FROM close JOIN
         (SELECT item_id, w[p:p + 12] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)) USING (x) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid) LEFT JOIN near USING (rid)
"""
