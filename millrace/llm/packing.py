"""Best-fit packing of token sequences by a plan over lengths.

Documents are tokenised (an end id after each), and only those longer than a
sequence are cut. The lengths of all pieces make a histogram of at most
``size`` rows, the only thing the driver gets. Best-fit decreasing runs over
its counts: a run of equal bins takes a run of equal pieces at once, so the
plan has a few rows for each length, however many documents there are. A piece
then finds its slot by its rank among the pieces of its length: ranks come from
counts of small hash buckets, so no task sees all pieces of a length, and plan
and pieces meet in a join on length and rank.

Tokenising: a text is cut at white space, which the tokenizer's own rules never
join across, and each different word is put through the tokenizer once a worker
(two generations of at most ``CACHE`` words are kept). Plain words go to its
model without the symbols around them; bare and in lower case they are words of the
same table. The ids are those of the whole text, which the tests hold against the
tokenizer.

Results for odd input: a null or empty text is the end id alone; null and
repeated ids pass through and each row is packed; pieces of a length are ordered
by document, piece and checksum, and then by a number that each piece got when it
was stored, which also finds its token ids again; an empty table gives an empty
result; columns beyond the two named ones are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import Decisions, Finder, store

CACHE = 300_000
#: Runs of symbols whose ids are kept; of others they are made each time.
SYMBOLS = 10_000


# ---------------------------------------------------------------- tokens


#: White space to str.split that the tokenizer takes for symbols.
_CONTROL = "\x1c\x1d\x1e\x1f"
#: Symbols that may stand around a plain word.
_SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word of letters that normalising leaves alone but for case, between symbols.
_PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where
    it prints, else the next of those from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache(dict):
    """Ids of words as little-endian bytes: a table that makes missing values and keeps
    1 to 2 times ``CACHE`` of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = {b: ord(c) for b, c in byte_letters().items()}
        self.symbols: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if any(map(text.__contains__, _CONTROL)):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            # printing ASCII is written as itself
            value = packed([t.id for t in self.tokenize(word)]) if word.isascii() and word.isalpha() and word.islower() else self._word(word)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if "<|" in word:
            return self._whole(word)
        core, before = word.rstrip(_SYMBOLS), ""
        after = word[len(core) :]
        if not (core.isascii() and core.isalpha()):
            m = _PLAIN.fullmatch(word)
            if m is None:
                return self._whole(word)
            before, core, after = m.groups()
        low = core.lower()
        if low == word:
            return self._part(word)
        out = self[low]
        if before:
            out = self._symbols(before) + out
        return out + self._symbols(after) if after else out

    def _symbols(self, run: str) -> bytes:
        value = self.symbols.get(run)
        if value is None:
            value = self._part(run)
            if len(self.symbols) < SYMBOLS:
                self.symbols[run] = value
        return value

    def _part(self, part: str) -> bytes:
        """Ids of letters alone in lower case, or of symbols alone."""
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.tokenize(spelt)])


_formats = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    return _formats[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


_caches: dict[str, WordCache] = {}


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids, __key): ids are little-endian 32-bit
    numbers; __key is a number of the piece's own, once the result is stored."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        serial = TaskContext.get().partitionId() << 33
        if vocabulary not in _caches:
            _caches[vocabulary] = WordCache(vocabulary)
        cache = _caches[vocabulary]
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            rows: list[tuple[int, int, bytes]] = []
            held = 0

            def flush() -> pa.RecordBatch:
                nonlocal rows, held, serial
                of, nth, raw = zip(*rows, strict=True)
                rows, held = [], 0
                n = [len(x) // 4 for x in raw]
                keys = np.arange(serial, serial + len(raw))
                serial += len(raw)
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(of)), pa.array(nth, pa.int32()), pa.array([k * size for k in nth], pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array(keys)],
                    ["id", "piece", "start", "length", "ids", "__key"],
                )

            for i in range(b.num_rows):
                raw = cache.encode(texts[i].as_py() or "") + end
                for nth, at in enumerate(range(0, len(raw), 4 * size)):
                    rows.append((i, nth, raw[at : at + 4 * size]))
                held += len(raw)
                if held > 4 << 20:
                    yield flush()
            if rows:
                yield flush()

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary, __key long").withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- plan


@dataclass
class Run:
    """Ranks [rank, rank + count) of a length go to bins first, first + 1, ...,
    ``each`` pieces a bin, from ``offset`` on."""

    length: int
    rank: int
    count: int
    each: int
    first: int
    offset: int


def best_fit(histogram: dict[int, int], size: int) -> list[Run]:
    """Best-fit decreasing over counts.

    Bins of the same fill stand together as (first bin, number). The pieces of a
    length go to the fullest bins that still take one; a bin that took a piece
    is then the fullest, so it takes as many as fit.
    """
    plan: list[Run] = []
    free: dict[int, list[tuple[int, int]]] = {}
    bins = 0
    for length in sorted(histogram, reverse=True):
        if length > size:
            raise ValueError(f"a piece of {length} is longer than a sequence of {size}")
        left, rank = histogram[length], 0
        rooms = sorted(r for r in free if r >= length)
        while left:
            if rooms:
                room = rooms[0]
                first, number = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(0)
            else:
                room = size
                first, number = bins, -(-left // (size // length))
                bins += number
            each = room // length
            full = min(number, left // each)
            if full:
                plan.append(Run(length, rank, full * each, each, first, size - room))
                rank, left = rank + full * each, left - full * each
                if rest := room - each * length:
                    free.setdefault(rest, []).append((first, full))
            if full < number and left:  # fewer than a bin's worth: one bin takes them
                plan.append(Run(length, rank, left, left, first + full, size - room))
                if rest := room - left * length:
                    free.setdefault(rest, []).append((first + full, 1))
                left, full = 0, full + 1
            if full < number:
                free.setdefault(room, []).append((first + full, number - full))
    return plan


PLAN = T.StructType([T.StructField(f"p_{n}", T.LongType()) for n in ("length", "rank", "count", "each", "first", "offset")])


def ranked(rows: DataFrame, order: list[str], per_bucket: int = 20_000) -> DataFrame:
    """``rows`` with rank: from 0 without gaps within each length.

    Rows of a length are dealt into hash buckets; a rank is the number within
    the bucket plus the counts of the buckets before.
    """
    spark = rows.sparkSession
    n = rows.count()
    buckets = max(64, -(-n // per_bucket))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "__bucket").count()
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = store(spark, counts.select("length", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base")), "pack-base")
    inner = rows.withColumn("__n", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*order)) - 1)
    return inner.join(base.hint("merge"), ["length", "__bucket"]).withColumn("rank", F.col("__base") + F.col("__n")).drop("__bucket", "__base", "__n")


def place(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``rows`` (with a column length) with sequence_id and offset.

    ``rows`` should be a stored table: it is read a few times.
    """
    spark = rows.sparkSession
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most size rows
    plan = best_fit(histogram, size)
    runs = spark.createDataFrame([(p.length, p.rank, p.count, p.each, p.first, p.offset) for p in plan], PLAN)
    r = ranked(rows, order)
    hit = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_count"))
    at = F.col("rank") - F.col("p_rank")
    # the plan has a few rows for each of at most size lengths; past that Spark chooses the join, with the same result
    joined = r.join(F.broadcast(runs), hit) if len(plan) <= 50 * size else r.join(runs, hit)
    return joined.select(
        *rows.columns,
        (F.col("p_first") + F.expr("(rank - p_rank) div p_each")).alias("sequence_id"),
        (F.col("p_offset") + at % F.col("p_each") * F.col("length")).alias("offset"),
    )


def pack(
    docs: DataFrame,
    vocabulary: str,
    size: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Column | None = None,
    digest_name: str = "digest",
) -> DataFrame:
    """(id_col, piece, start, length, ids or digest, sequence_id, offset).

    digest: if given, an expression over ids that is kept in their place; the
    token ids then never leave the tokenising task's stage.
    """
    spark = docs.sparkSession
    cut = pieces(docs, vocabulary, size, end_id, id_col, text_col).withColumn("__crc", F.crc32("ids"))
    order = [id_col, "piece", "__crc", "__key"]
    if digest is not None:
        return place(store(spark, cut.withColumns({"__digest": digest}).drop("ids"), "pack-pieces"), size, order).select(
            id_col, "piece", "start", "length", F.col("__digest").alias(digest_name), "sequence_id", "offset"
        )
    kept = store(spark, cut, "pack-ids")
    found = place(kept.drop("ids"), size, order).select(F.lit(0).cast("long").alias("file"), F.col("__key").alias("row"), "sequence_id", "offset")
    return beside_ids(kept, Decisions.write(spark, found, "pack-places")).select(id_col, "piece", "start", "length", "ids", "sequence_id", "offset")


def beside_ids(kept: DataFrame, places: Decisions) -> DataFrame:
    """Stored pieces with their places, which are looked up by key: token ids stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(places)
        for b in batches:
            key = b.column("__key").to_numpy()
            at = np.zeros((2, len(key)), np.int64)
            for rows, found in finder.find(np.zeros(len(key), np.int64), key):
                at[:, rows] = found.column("sequence_id").to_numpy(), found.column("offset").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[0]), pa.array(at[1])], [*b.schema.names, "sequence_id", "offset"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack(docs, default_vocabulary(), digest=F.crc32("ids"), digest_name="ids_crc32")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
