"""Rows that were created, updated or deleted between states of a bucketed store,
as a stream: ``spark.readStream.format("stored_changes").load(root)``.

The offset is the number of a state, so that a query that starts again goes on with
the next one. Each state's changed buckets are a task each, which reads the bucket
before and after; the driver reads state files alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

DDL = "version long, change string, source_path string, doc_uid string, content_hash string, updated_seq long"
_KEPT = ["source_path", "doc_uid", "content_hash", "updated_seq"]


@dataclass
class ChangedBucket(InputPartition):
    version: int
    before: str | None
    after: str | None


class StoredChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_changes"

    def schema(self) -> str:
        return DDL

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(self.options["path"])


def _rows(root: str, folder: str | None) -> dict[str, tuple]:
    """Rows of a bucket by path."""
    if folder is None:
        return {}
    where, base = _open(root)
    t = pq.read_table(f"{base}/{folder}", filesystem=where, columns=_KEPT, partitioning=None)
    return {r[0]: r for r in zip(*(t.column(c).to_pylist() for c in _KEPT), strict=True)}


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")


class ChangeReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        where, base = _open(self.root)
        names = [f.base_name for f in where.get_file_info(fs.FileSelector(f"{base}/states", allow_not_found=True))]
        return {"version": max((int(n) for n in names if n.isdigit()), default=-1)}

    def _folders(self, version: int) -> dict[str, str]:
        if version < 0:
            return {}
        where, base = _open(self.root)
        with where.open_input_file(f"{base}/states/{version:09d}") as f:
            return {b: f"{folder}/sources/bucket={b}" for b, folder in json.loads(f.read())["sources"].items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        old = self._folders(start["version"])
        for v in range(start["version"] + 1, end["version"] + 1):
            new = self._folders(v)
            out += [ChangedBucket(v, old.get(b), new.get(b)) for b in sorted({*old, *new}) if old.get(b) != new.get(b)]
            old = new
        return out

    def read(self, partition: ChangedBucket) -> Iterator[tuple]:
        before, after = _rows(self.root, partition.before), _rows(self.root, partition.after)
        for path in sorted({*before, *after}):
            if before.get(path) != after.get(path):
                change = "created" if path not in before else "deleted" if path not in after else "updated"
                yield partition.version, change, *(after.get(path) or before[path])

    def commit(self, end: dict) -> None:
        pass


def stored_changes(spark: SparkSession, root: str):
    """The stream of changes of the store at ``root``, from its first state on."""
    spark.dataSource.register(StoredChanges)
    return spark.readStream.format("stored_changes").load(root)
