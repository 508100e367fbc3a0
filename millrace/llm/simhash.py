"""SimHash fingerprints, pigeonring candidate filter and exact components.

A fingerprint has 64 bits. Two of at most ``budget`` differing bits link. The
bits form a ring of ``SEGMENTS`` segments. By the pigeonring principle two
fingerprints with at most ``budget`` differences have a segment from which, for
every l, the first l segments clockwise have at most l * budget / SEGMENTS
differences together. The segments for which that share is below one must be
equal: they make the key under which fingerprints meet (five of sixteen
segments, 20 bits, at budget 3). Within a key, longer chains are held against
their own budgets before the full Hamming distance is taken.

Hot keys. Copies collapse first (a fingerprint stands for all its documents). A
key of more than ``split`` fingerprints is cut by a second ring over the bits
that the first left open, which makes keys of 32 bits, unless that would leave
more pairs (as in one dense group); what still exceeds ``split`` is dealt out
as pairs of blocks, so that no task holds more than two blocks of a group and
no pair is left out. A task returns a spanning forest of what it found, never
the pairs.

Components come from repeated star contraction; every round is a written table.
A node, component or fingerprint of very many rows meets them by broadcast, and
only such (see ``join_hot``).

Results for odd input: a null or wordless text has fingerprint zero and links
like any other; null document ids never become a component id unless a
component has no other (then it is null); repeated rows come out as often as
they came in; an empty table gives an empty result; columns beyond the two
named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, join_hot, store, store_seen, text_chunks, word_spans

BITS = 64
SEGMENTS = 16


# ---------------------------------------------------------------- fingerprints


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes: a bit is 1 if set in over half."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    at = bounds[:-1][full]
    for k in range(BITS):
        ones = np.add.reduceat(((hashes >> np.uint64(k)) & np.uint64(1)).astype(np.int32), at)
        out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(k)
    return out


def chunk_fingerprints(data: np.ndarray, bounds: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints of the texts data[bounds[i]:bounds[i + 1]]."""
    low = LOWER[data]
    start, end, first = word_spans(low, bounds, NON_SPACE)
    if not len(start):
        return np.zeros(len(bounds) - 1, np.uint64)
    # the words again, one space after each
    size = end - start
    to = np.r_[0, np.cumsum(size + 1)]
    joined = np.full(int(to[-1]), 0x20, np.uint8)
    inside = np.repeat(to[:-1] - start, size)
    src = np.flatnonzero(NON_SPACE[low])
    joined[src + inside] = low[src]
    raw = joined.tobytes()
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(1, n - shingle + 1))
    sh = np.r_[0, np.cumsum(count)]
    lead = np.arange(int(sh[-1])) + np.repeat(first[:-1] - sh[:-1], count)
    last = np.minimum(lead + shingle, np.repeat(first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[s:e], 42) for s, e in zip(to[lead].tolist(), (to[last] + size[last]).tolist(), strict=True)),
        np.uint64,
        len(lead),
    )
    return majority(hashes, sh)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long): the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in text_chunks(b, "text", 1 << 20):
                fp = chunk_fingerprints(data, bounds, shingle)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(fp.view(np.int64))], ["id", "fp"])

    return thin.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- pigeonring


def ring(bits: tuple[int, ...], segments: int) -> list[tuple[int, ...]]:
    """The bits of each segment, as even in size as can be."""
    cut = [len(bits) * i // segments for i in range(segments + 1)]
    return [tuple(bits[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def chain_masks(segments: list[tuple[int, ...]], budget: int) -> list[list[tuple[int, int]]]:
    """For each start, (mask of the first l segments, differences allowed), where
    longer chains of the same allowance stand for shorter ones."""
    m, out = len(segments), []
    for s in range(m):
        steps: dict[int, int] = {}
        mask = 0
        for length in range(1, m + 1):
            for b in segments[(s + length - 1) % m]:
                mask |= 1 << b
            steps[length * budget // m] = mask
        out.append([(v, k) for k, v in steps.items()])
    return out


def forest(fp: np.ndarray, end: np.ndarray, chains: list[np.ndarray], budget: int, left: np.ndarray | None = None, tally: np.ndarray | None = None) -> np.ndarray:
    """Links that span each group's components, as rows (fp, fp).

    Rows of a group stand together and end[i] is the end of row i's group.
    chains[k] has, for each row, the mask of the longest chain that may hold
    k + 1 differences. left: if given, only pairs of a left and another row
    are held against each other. tally, if given, counts pairs met, pairs left
    after each chain, and links.

    Goes through all pairs by their distance in the order, many groups at once.
    A pair that is already connected is not returned.
    """
    label = np.arange(len(fp))
    found = []
    i = np.arange(len(fp))
    gap = 0
    while len(i):
        gap += 1
        i = i[end[i] - i > gap]
        if not len(i):
            break
        at = i if left is None else i[left[i] != left[i + gap]]
        diff = fp[at] ^ fp[at + gap]
        if tally is not None:
            tally[0] += len(at)
        for k, mask in enumerate(chains):
            keep = np.bitwise_count(diff & mask[at]) <= k + 1
            at, diff = at[keep], diff[keep]
            if tally is not None:
                tally[1 + k] += len(at)
        at = at[np.bitwise_count(diff) <= budget]
        if tally is not None:
            tally[-1] += len(at)
        at = at[label[at] != label[at + gap]]
        if not len(at):
            continue
        for x in at.tolist():
            p, q = int(label[x]), int(label[x + gap])
            while label[p] != p:
                p = int(label[p])
            while label[q] != q:
                q = int(label[q])
            if p != q:
                label[max(p, q)] = min(p, q)
                found.append((x, x + gap))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return fp[np.array(found, np.int64)].reshape(-1, 2)


class Rings:
    """Keys and chains of the first ring and, for hot keys, of the second.

    A tag numbers a start: of the first ring, or of a second ring after it.
    """

    def __init__(self, budget: int, segments: int = SEGMENTS):
        self.budget = budget
        first = chain_masks(ring(tuple(range(BITS)), segments), budget)
        self.starts = len(first)
        self.key: list[int] = [self._key(s) for s in first]
        chains = list(first)
        self.second: list[list[int]] = []
        for start in range(self.starts):
            taken = self.key[start]
            rest = tuple(b for b in range(BITS) if not taken >> b & 1)
            inner = chain_masks(ring(rest, max(budget + 1, min(11, len(rest)))), budget)
            self.second.append([len(chains) + i for i in range(len(inner))])
            for s in inner:
                chains.append([(m | taken, k) for m, k in s])
                self.key.append(self._key(chains[-1]))
        self.chains = [np.array([dict((k, m) for m, k in s).get(most, 0) for s in chains], np.uint64) for most in range(1, budget)]
        self.keys = np.array(self.key, np.uint64)

    @staticmethod
    def _key(steps: list[tuple[int, int]]) -> int:
        if steps[0][1]:
            raise ValueError("a ring needs more segments than differences")
        return steps[0][0]


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], list(columns))


def _fp(b: pa.RecordBatch) -> np.ndarray:
    return b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def _first_rows(rings: Rings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _fp(b)
            for s in range(rings.starts):
                yield _batch(tag=np.full(len(fp), s, np.int32), key=fp & rings.keys[s], fp=fp)

    return run


def _second_rows(rings: Rings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, fp = b.column("tag").to_numpy(zero_copy_only=False), _fp(b)
            for s in np.unique(start):
                own = fp[start == s]
                for t in rings.second[s]:
                    yield _batch(hot_tag=np.full(len(own), s, np.int32), hot_key=own & rings.keys[s], tag=np.full(len(own), t, np.int32), key=own & rings.keys[t], fp=own)

    return run


GROUP = ("tag", "key", "x", "y")


def _compare(rings: Rings):
    """Rows come sorted by group; a group may go on in the next batch."""

    def done(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(c["fp"])
        if not n:
            return
        new = np.zeros(n, bool)
        for g in GROUP:
            new[1:] |= c[g][1:] != c[g][:-1]
        cuts = np.r_[np.flatnonzero(new), n]
        end = cuts[np.cumsum(new)]
        chains = [m[c["tag"]] for m in rings.chains]
        same = c["x"] == c["y"]
        for own, left in ((same, None), (~same, c["left"])):
            if own.any():
                to = np.cumsum(own)
                e = forest(c["fp"][own], to[end[own] - 1], [m[own] for m in chains], rings.budget, None if left is None else left[own])
                if len(e):
                    yield _batch(a=e[:, 0].copy(), b=e[:, 1].copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            c = {g: b.column(g).to_numpy(zero_copy_only=False) for g in (*GROUP, "left")} | {"fp": _fp(b)}
            if held is not None:
                c = {g: np.concatenate([held[g], c[g]]) for g in c}
            last = np.logical_and.reduce([c[g] == c[g][-1] for g in GROUP])
            cut = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
            yield from done({g: v[:cut] for g, v in c.items()})
            held = {g: v[cut:] for g, v in c.items()}
        if held is not None:
            yield from done(held)

    return run


def links(spark: SparkSession, fps: DataFrame, budget: int = 3, split: int = 4096, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): links between different fingerprints of at most ``budget``
    differing bits, enough to span every component. ``fps`` has column fp, each
    value once."""
    rings = Rings(budget, segments)
    zero = F.lit(0)
    keyed = store(spark, fps.select("fp").mapInArrow(_first_rows(rings), "tag int, key long, fp long"), "simhash-keys")
    sizes = store(spark, keyed.groupBy("tag", "key").count().where("count > 1"), "simhash-sizes")
    hot = sizes.where(F.col("count") > split)

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select("tag", "key", zero.alias("x"), zero.alias("y"), F.lit(True).alias("left"), "fp")

    def blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
        """Rows of groups over ``split`` as pairs of blocks, of others as they are."""
        n = F.ceil(F.col("count") / split).cast("int")
        own = rows.join(counts, ["tag", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), n).cast("int"))
        pairs = own.select("tag", "key", "fp", "own", F.explode(F.sequence(zero, n - 1)).alias("other"))
        return pairs.select("tag", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("left"), "fp")

    work = whole(keyed.join(sizes.where(F.col("count") <= split), ["tag", "key"], "left_semi"))
    if not hot.isEmpty():
        # the second ring only where it leaves fewer pairs than the first
        rows = keyed.join(hot, ["tag", "key"], "left_semi")
        inner = store(spark, rows.mapInArrow(_second_rows(rings), "hot_tag int, hot_key long, tag int, key long, fp long"), "simhash-hot")
        inner_sizes = inner.groupBy("hot_tag", "hot_key", "tag", "key").count()
        pairs = inner_sizes.groupBy("hot_tag", "hot_key").agg(F.sum(F.col("count") * F.col("count")).alias("inner_pairs"))
        choice = pairs.join(hot.select(F.col("tag").alias("hot_tag"), F.col("key").alias("hot_key"), "count"), ["hot_tag", "hot_key"])
        choice = store(spark, choice.withColumn("finer", F.col("inner_pairs") < F.col("count") * F.col("count")), "simhash-choice")
        coarse = choice.where("not finer").select(F.col("hot_tag").alias("tag"), F.col("hot_key").alias("key"), "count")
        work = work.unionByName(blocks(keyed, coarse))
        fine = inner.join(choice.where("finer").select("hot_tag", "hot_key"), ["hot_tag", "hot_key"], "left_semi").drop("hot_tag", "hot_key")
        work = work.unionByName(blocks(fine, fine.groupBy("tag", "key").count().where("count > 1")))
    dealt = work.repartition(*map(F.col, GROUP)).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(_compare(rings), "a long, b long")


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node on an edge the least node of its component.

    Large-star and small-star contraction. Only minima are gathered for a node,
    so a node of any degree costs no memory.
    """
    now = store(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        # large star: every larger neighbour hangs on the least of u's neighbourhood
        large = join_hot(both.where("v > u"), least.where("n > 0"), "u", "n")
        large = store(spark, large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "stars")
        # small star: u and its smaller neighbours hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low.where("n > 1"), "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        now, seen = store_seen(spark, small, "stars", n=F.count("*"), x=F.sum(F.shiftright(F.xxhash64("u", "v"), 32)))
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, split: int = 4096, segments: int = SEGMENTS
) -> DataFrame:
    """(id_col, fp long, component_id): one row per row of ``docs``."""
    spark = docs.sparkSession
    each = store(spark, fingerprints(docs, id_col, text_col, shingle), "simhash-docs")
    one = store(spark, each.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n_docs")), "simhash-fps")
    found = components(spark, store(spark, links(spark, one, budget, split, segments), "simhash-links"))
    rooted = one.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = store(spark, rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    of_fp = join_hot(rooted.select("fp", "root", "n_docs"), ids, "root", "n").drop("root")
    return join_hot(each, of_fp, "fp", "n_docs").select(id_col, "fp", "component_id")


def hex16(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- query


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")
