"""Near copies of a similarity, from SimHash links to exact Jaccard.

Two texts link if the sets of their shingles have a similarity of 4/5 or more.
SimHash fingerprints with the pigeonring filter (``simhash.links``) propose the
first links, each held against the sets themselves; they join most of a dense
group at little cost. They cannot find all: at a similarity of 4/5 two of 64-bit
fingerprints differ in ten bits on average, where no chain of segments is long
enough to be a key. What they leave apart is completed without a loss:

With the shingles of all sets in one order, two sets of that similarity share one
of the first n - ceil(4n/5) + 1 of each (prefix filter); those are the keys under
which texts meet. Any order is right; shingles that a sample of the texts often has
come last, as they would make long lists. Pairs that meet pass two exact bounds,
the ratio of sizes and the differing bits of parity bitmaps (a shingle flips one
bit, so they are never more than the differing shingles): a short bitmap of ``MARK``
words where they meet, so that members of a dense group that differ too much make no
rows, and one that grows with the text, before the shingles of their texts are
compared.

Dense groups. With the proposals, texts of keys of more than ``DENSE`` texts are
held against a few others of their lists, in ``ROUNDS`` orders; what is connected
by then is not compared again. All pairs of different components that meet are
compared after that.

Results for odd input: null and wordless texts are one group; a text of fewer
words than a shingle is one shingle; an empty table gives an empty result; rows
are told apart by ``id_col``, which must be a distinct long. Of a group the row of
the least key stays (null keys last), then of the least hash of the text, then of
the least id, so that it does not hang on how files are laid out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, join_hot, scramble, spans_hash, store, text_chunks, word_spans
from .simhash import components, links, majority

#: Differing bits at which fingerprints propose a link.
PROPOSED = 6
DENSE = 32
ROUNDS = 2
#: Other texts that a text is held against in a round.
TRIES = 4
#: One text in SAMPLE is sampled; shingles in SEEN of those are common, the first MOST_COMMON of them.
SAMPLE, SEEN, MOST_COMMON = 4, 4, 1 << 18
#: Tables of fewer rows than this, of ids only, are sent to all tasks.
FEW = 1 << 22
#: Words of 64 bits of the bitmap that goes with a text to where texts meet.
MARK = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """For each text data[bounds[i]:bounds[i + 1]] its sorted, distinct shingle hashes."""
    low = LOWER[data]
    start, end, first = word_spans(low, bounds, NON_SPACE)
    words = spans_hash(low, start, end)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, np.uint64)
            continue
        k = min(shingle, b - a)
        h = np.zeros(b - a - k + 1, np.uint64)
        for i in range(k):
            h = h * _STEP + words[a + i : b - k + 1 + i]
        yield np.unique(scramble(h + np.uint64(k)))


def parity(h: np.ndarray) -> np.ndarray:
    """Bitmap of at least two bits a shingle, a power of two: a bit is the parity of the shingles that fall on it."""
    bits = 64
    while bits < 2 * len(h):
        bits *= 2
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1)


def short_parity(h: np.ndarray) -> np.ndarray:
    """As ``parity``, but of ``MARK`` words for all sizes."""
    return np.packbits(np.bincount((h & np.uint64(64 * MARK - 1)).astype(np.int64), minlength=64 * MARK) & 1 == 1).view(np.int64)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """At most the number of shingles that one set has and the other has not."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard of 4/5 or more, in whole numbers."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _sample(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, bounds in text_chunks(b, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(shingle_sets(data, bounds, shingle))).view(np.int64))], ["h"])

    return run


def _units(shingle: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in text_chunks(b, "text", 1 << 20):
                size, digest, keys, bits, short, fps, marks = [], [], [], [], [], [], []
                for k, h in enumerate(shingle_sets(data, bounds, shingle)):
                    n = len(h)
                    at = np.searchsorted(common, h)
                    late = common[np.minimum(at, len(common) - 1)] == h if len(common) else np.zeros(n, bool)
                    order = np.r_[h[~late], h[late]]
                    size.append(n)
                    digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                    keys.append(order[: n - (4 * n + 4) // 5 + 1].view(np.int64))
                    bits.append(parity(h).tobytes())
                    short.append(short_parity(h))
                    fps.append(majority(h, np.array([0, n]))[0])
                    marks.append(xxhash.xxh64_intdigest(data[bounds[k] : bounds[k + 1]]) >> 1)
                cols = [pa.array(size, pa.int32()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(short, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(marks, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("key").slice(i, j - i), *cols], ["id", "key", "n", "digest", "keys", "bits", "short", "fp", "mark"])

    return run


def _within_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column("na").to_numpy() + b.column("nb").to_numpy()
        x, y = b.column("xa"), b.column("xb")
        keep = [9 * least_difference(np.frombuffer(p.as_py(), np.uint8), np.frombuffer(q.as_py(), np.uint8)) <= k for p, q, k in zip(x, y, n.tolist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _similar(shingle: int):
    def one(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return next(shingle_sets(raw, np.array([0, len(raw)]), shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(one(p.as_py()), one(q.as_py())) for p, q in zip(b.column("xa"), b.column("xb"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() < FEW else ids


def beside_another(docs: DataFrame, id_col: str, key_col: str, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id_col): all rows but one of each connected group of near copies."""
    spark: SparkSession = docs.sparkSession
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(key_col).alias("key"))

    seen = thin.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sample(shingle), "h long")
    top = seen.groupBy("h").count().where(F.col("count") >= SEEN).orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toArrow()
    common = np.sort(top.column("h").to_numpy().astype(np.int64).view(np.uint64))

    kind = docs.schema[key_col].dataType.simpleString()
    units = store(spark, thin.mapInArrow(_units(shingle, common), f"id long, key {kind}, n int, digest binary, keys array<long>, bits binary, short array<long>, fp long, mark long"), "near-units")
    heads = store(spark, units.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "near-heads")
    copies = store(spark, units.select("id").join(heads.select("id"), "id", "left_anti"), "near-copies")
    own = units.join(_few(copies), "id", "left_anti")

    lists = own.select("id", "n", F.explode("keys").alias("key"))
    sizes = lists.groupBy("key").agg(F.count("*").alias("g")).where("g > 1").withColumn("rows", F.col("g"))
    posts = store(spark, join_hot(lists, sizes, "key", "rows"), "near-posts")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b): those of the pairs that are similar."""

        def with_both(pairs: DataFrame, of: DataFrame, *more: str) -> DataFrame:
            for side in "ab":
                pairs = pairs.join(of.select(F.col("id").alias(side), F.col(of.columns[-1]).alias(f"x{side}"), *[F.col(m).alias(m + side) for m in more]), side)
            return pairs

        met = store(spark, pairs, "near-pairs")
        close = store(spark, with_both(met, units.select("id", "n", "bits"), "n").mapInArrow(_within_bounds, "a long, b long"), "near-close")
        ids = store(spark, close.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
        texts = store(spark, thin.select("id", "text").join(_few(ids), "id", "left_semi"), "near-texts")
        return store(spark, with_both(close, texts).repartition(F.col("a"), F.col("b")).mapInArrow(_similar(shingle), "a long, b long"), "near-links")

    def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))

    # SimHash proposals: fingerprints that link, and texts of one fingerprint
    of_fp = store(spark, own.groupBy("fp").agg(F.min("id").alias("a"), F.count("*").alias("rows")), "near-fps")
    near = store(spark, links(spark, of_fp, PROPOSED, segments=32), "near-proposed")
    end = lambda name, to: of_fp.select(F.col("fp").alias(name), F.col("a").alias(to))
    proposed = near.withColumnsRenamed({"a": "x", "b": "y"}).join(end("x", "a"), "x").join(end("y", "b"), "y").select("a", "b")
    proposed = proposed.unionAll(join_hot(own.select("fp", F.col("id").alias("b")), of_fp, "fp", "rows").where("a <> b").select("a", "b"))
    # and, in dense lists, texts that stand beside each other in orders by chance
    dense = posts.where(F.col("g") > DENSE)
    for k in range(ROUNDS):
        # a list is cut by chance, so that none is one task's
        cut = dense.withColumn("cut", F.pmod(F.xxhash64("id", F.lit(-k - 1)), F.ceil(F.col("g") / 4096)))
        by = Window.partitionBy("key", "cut").orderBy(F.xxhash64("id", "key", F.lit(k)))
        beside = cut.select(F.col("id").alias("a"), F.col("n").alias("na"), F.lag("id").over(by).alias("b"), F.lag("n").over(by).alias("nb"))
        pairs = beside.where("5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b").distinct()
        some = pairs.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))).where(F.col("k") <= TRIES)
        proposed = proposed.unionAll(some.select("a", "b"))
    edges = verified(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = store(spark, components(spark, edges), "near-found")

    def several(rows: DataFrame) -> DataFrame:
        """Rows of keys whose texts are in more than one component, with the least of these."""
        of_key = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("rows"))
        return join_hot(rows, of_key.where("least <> most").drop("most"), "key", "rows")

    # all that meet and are not connected yet: one of the two is not in its list's least component
    apart = several(rooted(posts, found)).select("key", "id", "n", "root", "least")
    words = [F.col("short")[i].alias(f"w{i}") for i in range(MARK)]
    rows = store(spark, apart.join(own.select("id", *words), "id"), "near-rooted")
    left, right = (rows.select("key", "least", F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("root").alias(f"r{s}"), *[F.col(f"w{i}").alias(f"w{i}{s}") for i in range(MARK)]) for s in "ab")
    # bits that differ are shingles that differ, of which there may be a ninth of both sizes
    differing = " + ".join(f"bit_count(w{i}a ^ w{i}b)" for i in range(MARK))
    met = left.where("ra <> least").drop("least").join(right.drop("least"), "key").where(f"5 * least(na, nb) >= 4 * greatest(na, nb) AND ra <> rb AND 9 * ({differing}) <= na + nb")
    more = verified(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not more.isEmpty():
        found = store(spark, components(spark, edges.unionAll(more)), "near-found")

    # groups of more than one row, with the one that stays
    of_head = heads.join(found.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("root"), F.col("copies").alias("rows"))
    members = store(spark, join_hot(units.select("digest", "id", "key", "mark"), of_head, "digest", "rows").drop("digest"), "near-members")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark", "id"))
    kept = members.groupBy("root").agg(first.alias("first")).select(F.col("first.id").alias("id"))
    return members.join(kept, "id", "left_anti").select(F.col("id").alias(id_col))
