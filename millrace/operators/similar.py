"""Texts that resemble each other within a span of time, and the ring that lets
only the first of them in.

Texts are sets of lower-cased words. Rows with equal sets are one class, so that
copies cost no pairs. Classes that are alive within the same span of time meet by
words of a prefix: with sets in one order of words, rare ones first, two sets of a
Jaccard similarity of s or more share a word among the first n - ceil(s * n) + 1 of
each. The key of the meeting is a window of two spans and the word's hash, for words
that are in very many sets also a window of two steps of size, a scale by 1 / s: what
is near in time, and near in size, shares a window. What goes there are hashes and
sizes, once; equal hashes of other words or classes only propose more pairs. The sets
themselves go to the proposed pairs as one string, and decide. Words are ordered by
how often words of their hash bucket occur, then by hash; any order gives the same
result. Word sets are worked out anew where they are needed and not stored.

The ring of accepted texts is sequential over all rows, as a text counts only if it
was accepted itself. Only rows that have a similar class near in time can be
duplicates; these go through it in blocks of time, all blocks at once. A block
depends on the duplicates of one span before it, which the first round takes as
none; rounds go on for the blocks whose beginning has changed, until none has. What
a block says is then what one pass over all rows says.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import words
from ..session import scratch

#: Hash buckets in which words are counted; a bound on what tasks are sent.
BUCKETS = 1 << 16


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_sets(rows: DataFrame, content: str) -> DataFrame:
    """``rows`` with words array<string>, sorted, in the place of ``content``, and class binary: a digest of them."""
    own = F.sort_array(F.array_distinct(words(F.lower(F.coalesce(F.col(content), F.lit(""))))))
    sets = rows.withColumn("words", own).drop(content)
    return sets.withColumn("class", F.unhex(F.sha2(F.to_json("words"), 256)))


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """window (of spans), step (window of sizes, or -1), word (hash), short (hash of the
    class) and n (size) for each word of the prefix of ``sets`` (short, span, hashes)."""
    bucket = F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
    often = np.zeros(BUCKETS, np.int64)
    for r in sets.select(F.explode("hashes").alias("h")).groupBy(bucket).count().collect():  # BUCKETS rows at most
        often[r["bucket"]] = r["count"]
    many = often.max(initial=0) / 100
    fields = {"window": pa.int64(), "step": pa.int32(), "word": pa.int32(), "short": pa.int64(), "n": pa.int32()}

    def rows(short: int, span: int, own: np.ndarray) -> np.ndarray:
        n = len(own)
        step = int(math.log(n) / -math.log(similarity) + 1e-9)
        counts = often[own & (BUCKETS - 1)]
        first = np.lexsort((own, counts))[: n - math.ceil(similarity * n - 1e-9) + 1]
        word, hot = own[first] >> 32, counts[first] > many
        cold = word[~hot]
        keys = [(np.full(len(cold), -1), cold)] + [(np.full(hot.sum(), t), word[hot]) for t in (step, step + 1)]
        steps, at = (np.concatenate(c) for c in zip(*keys, strict=True))
        out = np.empty((5, 2 * len(at)), np.int64)
        out[0], out[1], out[2], out[3], out[4] = np.repeat((span, span + 1), len(at)), np.tile(steps, 2), np.tile(at, 2), short, n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            done: set[tuple[int, int]] = set()
            out = [np.empty((5, 0), np.int64)]
            for i, c in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                # an empty set is only like itself, which is its class already
                if c not in done and offsets[i] < offsets[i + 1]:
                    done.add(c)
                    out.append(rows(*c, values[offsets[i] : offsets[i + 1]]))
            columns = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))

    return sets.select("short", "span", "hashes").mapInArrow(run, "window long, step int, word int, short long, n int")


def _proposed(prefix: DataFrame, similarity: float) -> DataFrame:
    """sa, sb (hashes of classes, sa < sb) that share a word of their prefix in a window, and fit in size."""
    met = prefix.repartition("window", "step", "word").dropDuplicates(["window", "step", "word", "short"])
    both = met.withColumnsRenamed({"short": "sa", "n": "na"}).join(met.withColumnsRenamed({"short": "sb", "n": "nb"}), ["window", "step", "word"])
    fits = (F.col("sa") < F.col("sb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9)
    return both.where(fits).select("sa", "sb").distinct()


def similar_classes(sets: DataFrame, at: str, seconds: float, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """Stored a, b (classes, a < b) and jaccard, of all different word sets of that
    similarity that have rows at most ``seconds`` apart, and perhaps of some that
    have rows at most three times as far apart. known: rows with all classes of
    ``sets``, if there are any that are cheaper to read."""
    span = F.floor(F.col(at) / seconds).cast("long")
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    prefix = _prefixes(sets.select(F.xxhash64("class").alias("short"), span.alias("span"), hashes.alias("hashes")), similarity)
    named = (sets if known is None else known).select("class").distinct().withColumn("short", F.xxhash64("class"))
    a, b = named.select(F.col("class").alias("a"), F.col("short").alias("sa")), named.select(F.col("class").alias("b"), F.col("short").alias("sb"))
    pairs = _proposed(prefix, similarity).join(a, "sa").join(b, "sb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    alike = a.join(b, F.col("sa") == F.col("sb")).where("a < b").select("a", "b")  # two classes of one hash
    whole = sets.groupBy("class").agg(F.first(F.array_join("words", " ")).alias("words"))
    both = pairs.unionByName(alike).join(whole.withColumnsRenamed({"class": "a", "words": "wa"}), "a").join(whole.withColumnsRenamed({"class": "b", "words": "wb"}), "b")
    split = both.select("a", "b", F.split("wa", " ").alias("wa"), F.split("wb", " ").alias("wb"))
    common = F.size(F.array_intersect("wa", "wb"))
    jaccard = common / (F.size("wa") + F.size("wb") - common)
    return _stored(split.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= similarity), "similar-classes")


def _neighbours(pairs: DataFrame) -> DataFrame:
    """class, other: both ways."""
    return pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))


def _links(thin: DataFrame, row_id: str, pairs: DataFrame, width: int) -> DataFrame:
    """``thin`` (row_id, us, class) with n_links: its other rows of similar classes
    at most ``width`` microseconds away, counted by running numbers in (class, span)."""
    span = F.floor(F.col("us") / width)
    asks = thin.withColumns({"span": span, "asks": F.lit(True)})
    near = thin.join(_neighbours(pairs), "class").withColumn("class", F.col("other")).drop("other").unionByName(thin)
    counted = near.withColumns({"span": F.explode(F.array(span - 1, span, span + 1)), "asks": F.lit(False)})
    w = Window.partitionBy("class", "span").orderBy("us")
    seen = F.when(~F.col("asks"), 1)
    until, before = (F.count(seen).over(w.rangeBetween(Window.unboundedPreceding, end)) for end in (width, -width - 1))
    return asks.unionByName(counted).withColumn("n_links", until - before - 1).where("asks").drop("asks", "span")


def _timed(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn("us", F.round(F.col(at) * 1_000_000).cast("long"))


def links_in_time(rows: DataFrame, row_id: str, at: str, content: str, seconds: float, similarity: float) -> DataFrame:
    """For each row (distinct ids) class_id, the least id of its word set, and
    n_links: the other rows at most ``seconds`` before or after it whose sets
    resemble its own. Null texts are empty; empty sets are alike. Rows without a
    time take no part."""
    sets = word_sets(_timed(rows.select(row_id, at, content).where(F.col(at).isNotNull()), at), content)
    thin = _stored(sets.select(row_id, "us", "class"), "word-classes")
    links = _links(thin, row_id, similar_classes(sets, at, seconds, similarity, thin), int(seconds * 1_000_000))
    least = thin.groupBy("class").agg(F.min(row_id).alias("class_id"))
    return links.join(least, "class").select(row_id, "class_id", "n_links")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with n, their number in this order: by ranges, with a count for each."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = _stored(ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id() % (1 << 33)}), "ordered")
    counts = sorted((r["part"], r["count"]) for r in stored.groupBy("part").count().collect())  # a row a partition
    begin = [0, *accumulate(c for _, c in counts)]
    known = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, begin, strict=False)], "part int, begin long")
    return stored.join(F.broadcast(known), "part").withColumn("n", F.col("place") + F.col("begin")).drop("part", "place", "begin")


def duplicates_of_block(rows: list[tuple], similar: dict[int, list[int]], width: int, size: int) -> list[int]:
    """Numbers of the rows that a ring of the last ``size`` accepted rows of the
    last ``width`` microseconds refuses. rows: n, time, class, and None or, for
    those before the block, whether they were refused. Of a class only the last
    accepted row matters, as both bounds favour it."""
    last: dict[int, tuple[int, int]] = {}
    gone: list[int] = []
    own: list[int] = []
    for n, at, kind, known in rows:
        refused = known
        if known is None:
            refused = False
            for c in (kind, *similar.get(kind, ())):
                if c in last:
                    i, since = last[c]
                    # of the rows from i on, those not refused are in the ring
                    if at - since <= width and n - i - (len(gone) - bisect.bisect_right(gone, i)) <= size:
                        refused = True
                        break
            if refused:
                own.append(n)
        if refused:
            gone.append(n)
        else:
            last[kind] = (n, at)
    return own


def ring(rows: DataFrame, row_id: str, at: str, content: str, seconds: float = 300, similarity: float = 0.9, size: int = 100, spans: int = 12) -> DataFrame:
    """row_id and duplicate: whether a row resembles one of the last ``size``
    accepted ones of all rows of the last ``seconds``; those that don't are
    accepted. In order of ``at``, then id (distinct). ``spans``: spans of
    ``seconds`` a block."""
    width = int(seconds * 1_000_000)
    sets = _numbered(word_sets(_timed(rows.select(row_id, at, content).where(F.col(at).isNotNull()), at), content), ["us", row_id])
    pairs = similar_classes(sets, at, seconds, similarity)
    thin = sets.select("n", row_id, "us", "class")
    number = thin.groupBy("class").agg(F.min("n").alias("kind"))
    linked = _links(thin, row_id, pairs, width).where("n_links > 0").join(number, "class").select("n", "us", "kind")
    block = F.floor(F.col("us") / (width * spans))
    # the last span of a block goes before the next one, too
    ahead = F.when(F.floor((F.col("us") + width) / (width * spans)) != block, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = _stored(linked.withColumn("home", block).withColumn("block", F.explode(ahead)), "ring-rows")
    kinds = dealt.select("block", "kind").distinct()
    named = pairs.join(number.withColumnsRenamed({"class": "a", "kind": "kind_a"}), "a").join(number.withColumnsRenamed({"class": "b", "kind": "kind_b"}), "b")
    here = named.join(kinds.withColumnRenamed("kind", "kind_a"), "kind_a").join(kinds.withColumnRenamed("kind", "kind_b"), ["block", "kind_b"])
    beside = _stored(here.select("block", "kind_a", "kind_b"), "ring-pairs")

    def of_block(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        similar: dict[int, list[int]] = defaultdict(list)
        for a, b in zip(near["kind_a"].tolist(), near["kind_b"].tolist(), strict=True):
            similar[a].append(b)
            similar[b].append(a)
        mine = mine.sort_values("n")
        known = [bool(r) if h != b else None for h, b, r in zip(mine["home"], mine["block"], mine["refused"], strict=True)]
        found = duplicates_of_block(list(zip(mine["n"].tolist(), mine["us"].tolist(), mine["kind"].tolist(), known, strict=True)), similar, width, size)
        return pd.DataFrame({"n": found, "refused": True})

    refused = rows.sparkSession.createDataFrame([], "n long, refused boolean")
    while True:
        started = dealt.join(refused, "n", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))
        found = started.groupBy("block").cogroup(beside.groupBy("block")).applyInPandas(of_block, "n long, refused boolean")
        found = _stored(found, "ring-round")
        # a block is right once its beginning is: at the latest after a round a block
        changed = found.join(refused, "n", "full").where(found["refused"].isNull() | refused["refused"].isNull())
        done = changed.isEmpty()
        refused = found
        if done:
            return thin.join(refused, "n", "left").select(row_id, F.coalesce("refused", F.lit(False)).alias("duplicate"))
