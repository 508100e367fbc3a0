"""Periodic runs of words: passages that repeat one stretch of words at least three times.

Main and Lorentz's divide and conquer over the interned words of a text. A text
is halved until its parts are shorter than the shortest run; at each midpoint the
Z-functions of both halves say, for every period p, how far the words p apart
go on agreeing to either side. A run is found in the largest part in which it
crosses the midpoint; there it lies within the part, and stretches that can be
extended beyond their part belong to a larger one. Equal intervals that come
with several periods keep the smallest.

Few parts hold a run, and to see that is cheap: words p apart that agree over
``MIN_LENGTH`` words and three periods agree, right of the midpoint or left of
it, over at least ``EDGE`` words. So all parts of all texts of a batch are first
gone through by hashes of ``EDGE`` words at once, and only parts where some
distance agrees get their Z-functions. Hashes that are equal by chance cost
time, never a result. Time is n log n in the words of a text at worst, memory
some 100 bytes a word of the largest text, next to a batch of about 4 MB.

Texts are independent, so that nothing is shuffled and a lost executor costs its
tasks alone.

Results for odd input: null, empty and wordless texts have no words and no run;
null ids and repeated rows pass through, each row by itself; very long texts are
one task's work, in time n log n, and never cut; of runs with equal exponents the
first, then that of the smallest period, is the greatest; an empty table gives
an empty result; other columns are carried along, and added columns take
underscores before their names where a column has them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import spread

from .common import fresh, text_chunks
from .quality import SPACE, let

#: A run has at least so many words and so many periods.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: With n words and period p, n - p words agree with the word p on: at least 16,
#: of which one side of the midpoint has half.
EDGE = 8
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])

Run = tuple[int, int, int]


def z_function(x: list[int]) -> list[int]:
    """For each place the length of the longest prefix of ``x`` that begins there."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(x: list[int], low: int, middle: int, high: int) -> Iterator[Run]:
    """(start, end, period) of maximal repetitions of ``x`` that cross ``middle``
    and lie within low..high, some with several periods."""
    u, v, part = x[low:middle], x[middle:high], x[low:high]
    h, n = len(u), high - low
    # agreements to the right of two places, and to the left: words after the
    # separator are compared with the half before it
    after = z_function([*v, -1, *part])
    before = z_function([*u[::-1], -1, *part[::-1]])
    for p in range(1, n // MIN_PERIODS + 1):
        if p < n - h:  # middle against middle + p
            yield from kept(x, middle - before[h + 1 + n - h - p], middle + p + after[p], p, low, high)
        if p < h:  # middle - p against middle
            yield from kept(x, middle - p - before[p], middle + after[n - h + 1 + h - p], p, low, high)


def kept(x: list[int], start: int, end: int, p: int, low: int, high: int) -> Iterator[Run]:
    if end - start < max(MIN_LENGTH, MIN_PERIODS * p):
        return
    if start == low > 0 and x[low - 1] == x[low - 1 + p]:
        return
    if end == high < len(x) and x[high] == x[high - p]:
        return
    yield start, end, p


def _edges(ids: np.ndarray) -> np.ndarray:
    """For each place a hash of the ``EDGE`` words from there on."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step, factor = 1, 0xBF58476D1CE4E5B9
    while step < EDGE:
        h[:-step] = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor % 2**64
    return h


def parts_with_runs(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, low, middle, high) of all parts whose midpoint a run may cross.
    bounds: where the texts begin in ids, and the end."""
    h = _edges(ids)
    low, high = bounds[:-1], bounds[1:]
    text = np.arange(len(low))
    while True:
        long = high - low >= MIN_LENGTH
        text, low, high = text[long], low[long], high[long]
        if not len(low):
            return
        middle = (low + high) // 2
        width = (high - low) // MIN_PERIODS
        each = np.repeat(np.arange(len(low)), width)
        p = np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width) + 1
        m = middle[each]
        here, behind = h[m], h[m - EDGE]
        found = np.zeros(len(low), bool)
        for q in (p, -p):
            at = m + q
            found[each[(h[at] == here) | (h[np.maximum(at - EDGE, 0)] == behind)]] = True
        for i in np.flatnonzero(found).tolist():
            yield int(text[i]), int(low[i]), int(middle[i]), int(high[i])
        text, low, high = np.r_[text, text], np.r_[low, middle], np.r_[middle, high]


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> dict[int, list[Run]]:
    """For texts that have any: (start, length, period) of all runs, in order."""
    found: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    words: dict[int, list[int]] = {}
    for text, low, middle, high in parts_with_runs(ids, bounds):
        first = int(bounds[text])
        if text not in words:
            words[text] = ids[first : bounds[text + 1]].tolist()
        own = found[text]
        for start, end, p in crossing(words[text], low - first, middle - first, high - first):
            own[start, end] = min(p, own.get((start, end), p))
    return {t: sorted((s, e - s, p) for (s, e), p in own.items()) for t, own in found.items() if own}


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    change = [0] * (len(words) + 1)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, depth in zip(words, accumulate(change), strict=False) if not depth]


def with_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words long, runs array<struct<start, length, period>> by
    start, then period, and collapsed string: the words that are left when each run
    keeps its first period alone, joined by one space."""
    taken = list(docs.columns)
    added = []
    for name in ("n_words", "runs", "collapsed"):
        added.append(fresh(name, taken))
        taken.append(added[-1])
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.LongType()), T.StructField(added[1], T.ArrayType(RUN, False)), T.StructField(added[2], T.StringType())])
    run_type = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in RUN.names]))

    def of_batch(batch: pa.RecordBatch) -> tuple[list, list, list]:
        n_words, runs, left = [], [], []
        for _, _, data, offsets in text_chunks(batch, text_col):
            raw = data.tobytes()
            # bytes are split at the same six characters that end a word
            texts = [raw[a:z].split() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            number: dict[bytes, int] = defaultdict(count().__next__)
            sizes = [len(t) for t in texts]
            ids = np.fromiter((number[w] for t in texts for w in t), np.int64, sum(sizes))
            found = find_runs(ids, np.cumsum([0, *sizes]))
            n_words += sizes
            for i, t in enumerate(texts):
                own = found.get(i, [])
                runs.append([dict(zip(RUN.names, r, strict=True)) for r in own])
                left.append(b" ".join(collapsed(t, own) if own else t).decode())
        return n_words, runs, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                n_words, runs, left = of_batch(b)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(left, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def greatest(runs: Column) -> Column:
    """Of an ordered array of runs the first one of the greatest exponent, else null."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, better)


def planted(doc_id: Column, text: Column) -> Column:
    """The text as the query's contract has it: one in ten gets a periodic ending."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def begun(words: Column) -> Column:
        return F.struct(words.alias("words"), (g % F.greatest(F.size(words), F.lit(1))).cast("int").alias("at"))

    def measured(x: Column) -> Column:
        return F.struct(x["words"].alias("words"), x["at"].alias("at"), (1 + F.floor((F.size(x["words"]) - x["at"]) / (3 + g % 8))).cast("int").alias("period"))

    def ending(x: Column) -> Column:
        return F.array_join(F.transform(x["words"], lambda w, i: F.when(i < x["at"], w).otherwise(F.get(x["words"], x["at"] + (i - x["at"]) % x["period"]))), " ")

    made = let(F.array_remove(F.split(text, SPACE), ""), lambda w: let(begun(w), lambda x: let(measured(x), ending)))
    return F.when(h % 10 == 0, made).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_runs(spread(docs).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n", "")
    best = found.select("doc_id", "runs", "collapsed", greatest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[n].alias(n) for n in RUN.names],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# Words in 16 equal ones from two places on make a run's period
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda k, j: xor(k >> 1, (k & 1) * 3988292384))), 4294967295) AS h FROM d),
a AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
g AS MATERIALIZED (SELECT rid, i, hash(w[i + 1:i + 16]) AS g FROM (SELECT rid, w, unnest(range(n - 15)) AS i FROM t WHERE n >= {MIN_LENGTH})),
e AS (SELECT x.rid, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.rid, y.i - x.i ORDER BY x.i) AS island FROM g x JOIN g y ON x.rid = y.rid AND x.g = y.g AND x.i < y.i),
s AS (SELECT rid, q, min(i) AS start, max(i) + 16 + q - min(i) AS length FROM e GROUP BY rid, q, island),
r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM s WHERE length >= greatest({MIN_LENGTH}, {MIN_PERIODS} * q) GROUP BY rid, start, length),
l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT rid, i, w[i + 1] AS word FROM (SELECT rid, w, unnest(range(n)) AS i FROM t WHERE rid IN (SELECT rid FROM r)) ANTI JOIN gone USING (rid, i)) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(w, ' '))) AS collapsed_sha256
FROM t LEFT JOIN l USING (rid) LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""
