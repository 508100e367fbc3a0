"""WARC archives with revisits and a two-level capture index.

Writing. Payload digests are counted first: of the pages with one digest the
largest page id is the response, the others become revisit records (profile
identical-payload-digest), which keep the HTTP header, and with it the length,
but not the payload, and refer to the response's record. Only digests, ids and
places of rows are shuffled; the tasks that write the pages look the decisions
up by place. Each task writes its own archives of at most ``archive_bytes`` into
the shared folder, one gzip member a record, under a name of its own attempt, so
that a task that runs twice leaves no trace in the index.

Index, level one: captures sorted by reversed-host URL key (SURT), then by page
id, in compressed blocks of ``block_lines`` lines. Level two: a sparse directory
with a line for each block (first and last key, place). Both are cut into shards
of about ``shard_lines`` captures, each an index file and its directory. A look-up
goes by bisection to the shard, in its directory to the blocks, reads the blocks'
ranges, goes by bisection to the lines in them, and then reads the records'
ranges. ``lookup`` does so for a table of URLs: keys are dealt out sorted, then
the blocks that they fall in, then the records by archive and place. The driver
holds a row a shard.

Results for odd input: a null html has the empty payload; page ids that are no
whole numbers count as null; pages of a null id are responses, and never the
target of a revisit; rows of the same payload and the same (largest) id are all
responses, and revisits refer to one of them; a null or unparsable URL is indexed
under the key of its text (a null as ``-``), and a null one is written as
about:blank with a header field that says so; equal keys keep all captures; an
empty table writes an empty index; columns beyond the three named ones are not
read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Decisions, Finder, open_fs, store, with_place, work_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, archive string, offset long, size long"


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://b.a.org:80/x?y`` is ``org,a,b)/x?y``."""
    if not url:
        return "-"
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").removeprefix("www."), p.port
    except ValueError:
        return url
    if not host:
        return url
    port_part = f":{port}" if port and (p.scheme, port) not in (("http", 80), ("https", 443)) else ""
    key = ",".join(reversed(host.split("."))) + port_part + ")" + (p.path or "/")
    return key + (f"?{p.query}" if p.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8, in SQL functions:
    each five hex digits are four base32 letters."""
    h = F.sha1(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    part = lambda i: F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(file: int, row: int) -> str:
    """By the place of the page's row, so that no two records share one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}:{row}')}>"


@dataclass
class Revisit:
    """The response that a record stands for: its page, and where its row is."""

    page_id: int
    file: int
    row: int


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, to: Revisit | None, date: str) -> bytes:
    """One record: response, or revisit if ``to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if to is not None else http + payload
    target = "about:blank" if url is None else re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if to is None else 'revisit'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is None:
        head.append("X-No-URL: true")
    if to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(to.file, to.row)}", f"X-Refers-To-Page-ID: {to.page_id}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, HTTP header, payload."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, http, payload


@dataclass
class Archive:
    """What ``write`` leaves: WARC files, index files and their directories."""

    root: str
    shards: DataFrame  # as SHARD: one row a shard of the index


def revisits(spark: SparkSession, placed: DataFrame, salts: int = 16) -> Decisions:
    """For pages (page_id, digest, file, row): which are revisits, and of what.

    Only digests of several pages are joined, against pages dealt by digest and
    a salt, so that one payload of many pages is not one task's.
    """
    thin = store(spark, placed, "warc-digests")
    place = F.struct("page_id", "file", "row")
    many = thin.where("page_id IS NOT NULL").groupBy("digest").agg(F.max(place).alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    many = store(spark, many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "warc-groups")
    salted = thin.withColumn("salt", F.pmod(F.xxhash64("file", "row"), F.lit(salts)).cast("int"))
    later = salted.join(many, ["digest", "salt"]).where(F.col("page_id") < F.col("to.page_id"))
    return Decisions.write(spark, later.select("file", "row", F.col("to.page_id").alias("target"), F.col("to.file").alias("to_file"), F.col("to.row").alias("to_row")), "warc-revisits")


def write(
    pages: DataFrame,
    root: str | None = None,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = 64 << 20,
    block_lines: int = 1000,
    shard_lines: int = 1_000_000,
) -> Archive:
    spark = pages.sparkSession
    root = root or work_path(spark, "warc")
    named = pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    placed, file_col, row_col = with_place(named)
    placed = placed.withColumnsRenamed({file_col: "file", row_col: "row"})
    found = revisits(spark, placed.select("page_id", base32_sha1(F.col("html")).alias("digest"), "file", "row"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_fs(root)
        where.create_dir(f"{base}/archive", recursive=True)
        tag = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        out, name, at, serial = None, "", 0, 0
        finder = Finder(found)
        for b in batches:
            file, row = (b.column(c).to_numpy(zero_copy_only=False) for c in ("file", "row"))
            decided: dict[int, Revisit] = {}
            for places, values in finder.find(file, row):
                decided |= {p: Revisit(*v) for p, v in zip(places.tolist(), zip(*[values.column(c).to_pylist() for c in ("target", "to_file", "to_row")], strict=True), strict=True)}
            rows: list[tuple] = []
            for i, (page_id, url, html) in enumerate(zip(*[b.column(c) for c in ("page_id", "url", "html")], strict=True)):
                page, address, payload = page_id.as_py(), url.as_py(), (html.as_py() or "").encode()
                raw = gzipped(record(record_id(int(file[i]), int(row[i])), page, address, payload, digest_of(payload), decided.get(i), date))
                if out is None or at and at + len(raw) > archive_bytes:
                    if out is not None:
                        out.close()
                    name, at, serial = f"archive/{tag}-{serial:05d}.warc.gz", 0, serial + 1
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                rows.append((surt(address), page, name, at, len(raw)))
                at += len(raw)
            if rows:
                k, p, n, o, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p, pa.int64()), pa.array(n), pa.array(o, pa.int64()), pa.array(s, pa.int64())], ["key", "page_id", "archive", "offset", "size"])
        if out is not None:
            out.close()

    captures = store(spark, placed.mapInArrow(archives, CAPTURE), "warc-captures")
    n = max(_parts(spark), -(-captures.count() // shard_lines))
    order = ("key", "page_id", "archive", "offset")
    ordered = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_fs(root)
        where.create_dir(f"{base}/index", recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"index/cdx-{shard:06d}-{uuid.uuid4().hex[:12]}.gz"
        out, at, total, directory, held = None, 0, 0, [], []

        def flush() -> None:
            nonlocal out, at, held
            if out is None:
                out = where.open_output_stream(f"{base}/{name}", compression=None)
            raw = gzipped("".join(json.dumps(x) + "\n" for x in held).encode())
            out.write(raw)
            directory.append((held[0][0], held[-1][0], at, len(raw), len(held)))
            at, held = at + len(raw), []

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                held.append(list(row))
                total += row[4]
                if len(held) >= block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with where.open_output_stream(f"{base}/{name}.directory", compression=None) as f:
                f.write(gzipped("".join(json.dumps(x) + "\n" for x in directory).encode()))
            row = [shard, directory[0][0], directory[-1][1], name, len(directory), sum(d[4] for d in directory), total]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SHARD.split(", ")])

    return Archive(root, store(spark, ordered.mapInArrow(blocks, SHARD), "warc-shards"))


SHARD = "shard int, first_key string, last_key string, file string, n_blocks long, n_lines long, bytes long"


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_range(where: fs.FileSystem, path: str, offset: int, size: int) -> bytes:
    with where.open_input_file(path) as f:
        return f.read_at(size, offset)


def unzip(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31)


def lines_of(where: fs.FileSystem, base: str, file: str, offset: int, size: int) -> list[list]:
    return [json.loads(x) for x in unzip(read_range(where, f"{base}/{file}", offset, size)).decode().splitlines()]


class Directory:
    """Finds the blocks that may hold a key: by bisection among the shards, then in the shard's directory."""

    def __init__(self, root: str, shards: list[tuple[str, str, str]]):
        self.where, self.base = open_fs(root)
        self.shards = shards  # first key, last key, file; in order
        self.last = [s[1] for s in shards]
        self.opened: tuple[str, list[list], list[str]] = ("", [], [])

    def _open(self, file: str) -> tuple[list[list], list[str]]:
        if self.opened[0] != file:
            with self.where.open_input_stream(f"{self.base}/{file}.directory", compression=None) as f:
                blocks = [json.loads(x) for x in unzip(f.read()).decode().splitlines()]
            self.opened = (file, blocks, [b[1] for b in blocks])
        return self.opened[1], self.opened[2]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, size) of each block whose keys go around ``key``."""
        for first, _, file in self.shards[bisect.bisect_left(self.last, key) :]:
            if first > key:
                return
            blocks, last = self._open(file)
            for b in blocks[bisect.bisect_left(last, key) :]:
                if b[0] > key:
                    break
                yield file, b[2], b[3]


def directory_of(archive: Archive) -> Directory:
    rows = archive.shards.orderBy("shard").collect()  # a row for each million captures
    return Directory(archive.root, [(r["first_key"], r["last_key"], r["file"]) for r in rows])


def matching(lines: list[list], key: str) -> list[list]:
    """The lines of a key, by bisection."""
    name = lambda x: x[0]
    return lines[bisect.bisect_left(lines, key, key=name) : bisect.bisect_right(lines, key, key=name)]


class Lookup:
    """Point look-ups from the driver."""

    def __init__(self, archive: Archive):
        self.directory = directory_of(archive)

    def captures(self, url: str | None) -> list[list]:
        d, key = self.directory, surt(url)
        return [x for b in d.blocks(key) for x in matching(lines_of(d.where, d.base, *b), key)]

    def records(self, url: str | None) -> list[tuple[dict[str, str], bytes, bytes]]:
        d = self.directory
        return [parse(unzip(read_range(d.where, f"{d.base}/{c[2]}", c[3], c[4]))) for c in self.captures(url)]


BLOCKS = "file string, offset long, size long, keys array<string>"
PLACE = "archive string, offset long, size long"


def _captures(archive: Archive, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The places of records in blocks: of the given keys, or of all (null)."""
    root = archive.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_fs(root)
        for b in batches:
            for file, offset, size, keys in zip(*[c.to_pylist() for c in b.columns], strict=True):
                lines = lines_of(where, base, file, offset, size)
                rows = lines if keys is None else [x for k in keys for x in matching(lines, k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in ((2, pa.string()), (3, pa.int64()), (4, pa.int64()))], ["archive", "offset", "size"])

    # as many tasks as there are blocks to read, which their thin rows don't show
    n = max(_parts(blocks.sparkSession), -(-n_blocks // 64))
    return blocks.repartition(n, "file", "offset").mapInArrow(run, PLACE)


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The records of all captures of the URLs of a table, as ``READ``. A URL
    counts once however often it is given."""
    spark = urls.sparkSession
    n_blocks, total = archive.shards.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    directory = directory_of(archive)
    shards, root = directory.shards, archive.root

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({surt(u) for u in b.column(0).to_pylist()}), pa.string())], ["key"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the keys to be found in them; keys come sorted."""
        own = Directory(root, shards)
        held: dict[tuple[str, int, int], list[str]] = {}

        def flush() -> pa.RecordBatch:
            cols = [*zip(*held, strict=True), list(held.values())]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "offset", "size", "keys"])
            held.clear()
            return out

        for b in batches:
            for key in b.column(0).to_pylist():
                for block in own.blocks(key):
                    if block not in held and len(held) >= 1000:
                        yield flush()
                    held.setdefault(block, []).append(key)
        if held:
            yield flush()

    wanted = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(keys, "key string").distinct()
    dealt = wanted.repartitionByRange(_parts(spark), "key").sortWithinPartitions("key")
    return _records(archive, _captures(archive, dealt.mapInArrow(places, BLOCKS), n_blocks), total)


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archive: Archive) -> DataFrame:
    """All records through the index, block by block: one row a capture, as ``READ``."""
    root = archive.root
    n_blocks, total = archive.shards.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Directory(root, [])
        for b in batches:
            for file in b.column(0).to_pylist():
                blocks, _ = own._open(file)
                cols = [pa.array([file] * len(blocks)), pa.array([x[2] for x in blocks], pa.int64()), pa.array([x[3] for x in blocks], pa.int64()), pa.nulls(len(blocks), pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["file", "offset", "size", "keys"])

    return _records(archive, _captures(archive, archive.shards.select("file").mapInArrow(every, BLOCKS), n_blocks), total)


def _records(archive: Archive, places: DataFrame, total: int) -> DataFrame:
    """The records at the places (archive, offset, size), each archive in order.

    payload is null for revisits. A response whose payload doesn't match its
    digest is an error. total: bytes of all records, for the number of tasks.
    """
    root = archive.root

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_fs(root)
        name, f = None, None
        for b in batches:
            rows: list[tuple] = []
            held = 0

            def flush() -> pa.RecordBatch:
                nonlocal rows, held
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])
                rows, held = [], 0
                return out

            for archive_name, offset, size in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if archive_name != name:
                    if f is not None:
                        f.close()
                    name, f = archive_name, where.open_input_file(f"{base}/{archive_name}")
                fields, http, payload = parse(unzip(f.read_at(size, offset)))
                page = fields.get("x-page-id")
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                to = fields.get("x-refers-to-page-id")
                if to is None and (digest_of(payload) != digest or len(payload) != length):
                    raise ValueError(f"record of page {page} in {archive_name} at {offset} doesn't match its digest")
                url = None if "x-no-url" in fields else fields["warc-target-uri"]
                rows.append((None if page is None else int(page), url, payload if to is None else None, length, digest, fields["warc-type"], None if to is None else int(to)))
                held += len(payload)
                if held > 4 << 20:
                    yield flush()
            if rows:
                yield flush()
        if f is not None:
            f.close()

    # as many tasks as the records need, which their places don't show
    n = max(_parts(places.sparkSession), -(-total // (32 << 20)))
    placed = places.repartition(n, F.col("archive"), F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(records, READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = lookup(write(pages), pages)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS x FROM p),
d AS (SELECT page_id, payload_bytes,
             array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM h),
m AS (SELECT payload_digest, max(page_id) AS target FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < target THEN target END AS refers_to
FROM d JOIN m USING (payload_digest)
"""
