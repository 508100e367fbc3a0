"""Shared folders, intermediate tables and vectorised word hashing."""

from __future__ import annotations

import bisect
import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, as in tests, where the session names no shared folder.
LOCAL_DEFAULT = "/tmp/checkpoints/millrace"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, local mode gets
    one of its own, and a cluster an error: its machines share no local folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        root = LOCAL_DEFAULT
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class _Written(threading.local):
    """Intermediate tables, archives and shards in the order of writing, for
    ``clear``. Each thread has its own: a run clears nothing of one beside it."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)

    def __iter__(self) -> Iterator[str]:
        return iter(self.paths)


_written = _Written()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.paths.append(path)
    return path


def store(spark: SparkSession, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table.

    Cuts the lineage: a lost executor costs a re-read of these files, and no
    task of ``df`` runs a second time.
    """
    path = work_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_seen(spark: SparkSession, df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, dict]:
    """As ``store``, with aggregates of the rows that were seen while writing."""
    seen = Observation()
    # the table is read under the columns of df itself
    path = work_path(spark, name)
    df.observe(seen, *[v.alias(k) for k, v in values.items()]).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out, seen.get or out.agg(*[v.alias(k) for k, v in values.items()]).first().asDict()


def mark() -> int:
    """A point in the row of intermediate tables, for ``clear``."""
    return len(_written)


def clear(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Removes the intermediate tables that this thread wrote since a mark, but for the
    last ``keep``. Nothing may still be waiting to be worked out from them."""
    jvm = spark.sparkContext._jvm
    gone = _written.paths[since : len(_written) - keep]
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.paths[since : len(_written) - keep] = []


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, most: int = 1000, least: int = 100) -> DataFrame:
    """``left`` joined with ``right`` on ``key``. right has each key once, with the
    number of left's rows of it in ``count``, and is stored on the way.

    Keys of more than one in ``most`` of left's rows, of which there are fewer than
    ``most``, go to all tasks, so that their rows stay where they are.
    """
    right, seen = store_seen(left.sparkSession, right, "join-right", total=F.sum(count), largest=F.max(count))
    bound = max((seen["total"] or 0) // most, least)
    if (seen["largest"] or 0) <= bound:
        return left.join(right.drop(count), key)
    hot = F.broadcast(right.where(F.col(count) > bound).drop(count))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(count) <= bound).drop(count), key)
    return left.join(hot, key).unionByName(cold)


# ---------------------------------------------------------------- rows and decisions about them


def _is_scan(df: DataFrame) -> bool:
    """Whether each row is one row of a file: files with filters and projections, nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation")


def with_place(df: DataFrame) -> tuple[DataFrame, str, str]:
    """``df`` with the place of each row, and the names of the two columns: a
    64-bit hash of its file's path, and its number in the file. Places don't
    depend on how files are split into tasks. What isn't read from Parquet files is
    written first. (Two of a million files share a hash with a chance of 3e-8.)"""
    file, row = fresh("__file", df.columns), fresh("__at", df.columns)
    for source in (df, None):
        if source is None:
            source = store(df.sparkSession, df, "placed")
        elif not _is_scan(source):
            continue
        try:
            meta = source.metadataColumn("_metadata")
            out = source.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row))
            out.schema  # is an error where the files have no such number
            return out, file, row
        except AnalysisException:
            if source is not df:
                raise
    raise AssertionError


_WINDOW = 20


@dataclass
class Decisions:
    """Values for some rows, by place, in files sorted by place; a directory has a
    row for each file, which is one for ``per_file`` decisions."""

    path: str
    directory: list[tuple[tuple[int, int], tuple[int, int], str]]

    @staticmethod
    def write(spark: SparkSession, df: DataFrame, name: str, per_file: int = 1 << 21) -> Decisions:
        """``df``: file long, row long, and the values."""
        thin = store(spark, df, name + "-found")
        n = -(-thin.count() // per_file) or 1
        path = work_path(spark, name)
        ordered = thin.repartitionByRange(n, "file", "row").sortWithinPartitions("file", "row")
        ordered.write.option("parquet.block.size", 16 << 20).parquet(path)
        stored = spark.read.schema(thin.schema).parquet(path)
        each = stored.select("file", "row", stored.metadataColumn("_metadata")["file_name"].alias("name"))
        place = F.struct("file", "row")
        found = each.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last")).collect()
        return Decisions(path, sorted((tuple(r["first"]), tuple(r["last"]), r["name"]) for r in found))


class Finder:
    """Looks decisions up in a task that goes through rows of files in order. It
    holds the decisions of 2**20 rows at a time."""

    def __init__(self, decisions: Decisions):
        self.of = decisions
        self.last = [d[1] for d in decisions.directory]
        self.where, self.base = open_fs(decisions.path)
        self.held: tuple[int, int] | None = None
        self.table: pa.Table | None = None
        self.rows = np.zeros(0, np.int64)

    def _load(self, file: int, window: int) -> None:
        low, high = window << _WINDOW, (window + 1) << _WINDOW
        parts = []
        for first, _, name in self.of.directory[bisect.bisect_left(self.last, (file, low)) :]:
            if first >= (file, high):
                break
            parts.append(pq.read_table(f"{self.base}/{name}", filesystem=self.where, filters=[("file", "==", file), ("row", ">=", low), ("row", "<", high)]))
        self.held = (file, window)
        self.table = pa.concat_tables(parts) if parts else None
        self.rows = self.table.column("row").to_numpy() if parts else np.zeros(0, np.int64)

    def find(self, file: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table]]:
        """For the rows at these places: numbers of those that have a decision, and the decisions."""
        if not self.of.directory or not len(row):
            return
        part = row >> _WINDOW
        cuts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (part[1:] != part[:-1]), True])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if self.held != (int(file[a]), int(part[a])):
                self._load(int(file[a]), int(part[a]))
            if len(self.rows):
                at = np.minimum(np.searchsorted(self.rows, row[a:z]), len(self.rows) - 1)
                hit = np.flatnonzero(self.rows[at] == row[a:z])
                if len(hit):
                    yield hit + a, self.table.take(pa.array(at[hit]))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` (a stored table) without the rows whose ``key`` is in ``gone``. key:
    a distinct long that ascends in each file. Only keys are moved, never rows."""
    names = [c for c in df.columns if c != key]
    found = Decisions.write(df.sparkSession, gone.select(F.lit(0).cast("long").alias("file"), F.col(key).alias("row")), "without")
    schema = df.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(found)
        for b in batches:
            row = b.column(key).to_numpy(zero_copy_only=False)
            keep = np.ones(len(row), bool)
            for at, _ in finder.find(np.zeros(len(row), np.int64), row):
                keep[at] = False
            yield b.select(names).filter(pa.array(keep))

    return df.mapInArrow(run, schema)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ---------------------------------------------------------------- words

#: Bytes that words may hold. Every byte of a non-ASCII character is one.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MIX = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 18
_pow: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls up to 2**20."""
    got = _pow.get((base, 0))
    if got is None or len(got) < n:
        got = np.full(max(n, 1024), base, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        if n <= 1 << 20:
            _pow[(base, 0)] = got
    return got[:n]


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads the bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending, non-empty spans.

    Polynomials over a random value for each byte, by prefix sums. Works
    through pieces of about 256 KB, so that the memory is a few MB besides the
    longest span.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + _STEP)))
        a, b = int(start[i]), int(end[i:j].max())
        p = powers(_BASE, b - a + 1)
        inv = powers(pow(_BASE, -1, 2**64), b - a + 1)
        c = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_MIX[data[a:b]] * p[: b - a], out=c[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64)
        i = j
    return scramble(out)


def word_spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``table`` bytes within documents, and
    for each document the number of its first word (and the total)."""
    inside = table[data]
    edge = np.diff(inside.astype(np.int8))
    cut = bounds[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    both = cut[inside[cut - 1] & inside[cut]] if len(cut) else cut
    start = np.flatnonzero(edge == 1) + 1
    end = np.flatnonzero(edge == -1) + 1
    if len(data) and inside[0]:
        start = np.r_[0, start]
    if len(data) and inside[-1]:
        end = np.r_[end, len(data)]
    if len(both):
        start = np.sort(np.r_[start, both])
        end = np.sort(np.r_[end, both])
    return start, end, np.searchsorted(start, bounds)


def planes(a: np.ndarray) -> bytes:
    """Bytes by their place in the number: in sorted or small numbers long runs that compress."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def text_chunks(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about ``most`` bytes of text.

    Yields first row, end row, the bytes, and the rows' bounds in them. Null
    texts are empty. A text is never cut.
    """
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if len(col) == 0:
        return
    _, offs, raw = col.buffers()
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
