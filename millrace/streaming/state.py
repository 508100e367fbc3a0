"""Live state by key: typed values in RocksDB that event time forgets.

Each operator is a ``StatefulProcessor``: what it knows of a key is one typed value,
and as the watermark passes the time when that value stops to matter, it goes,
whether or not the key is ever seen again. So state grows
with the keys of the last ``ttl`` and not with all that ever were. Steps are those
of ``steps``, which the batch forms call, too.

Rows of a key have to come in the order of their time, as captures do; those of one
micro-batch are sorted. Rows later than the watermark are let go by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .steps import Step, dedup_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A batch stores what it changed, not a copy of all (which comes now and then).
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}

#: Buckets that keys are dealt out to; a query that has begun keeps their number.
BUCKETS = 256


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB, which typed state needs."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def milliseconds(seconds: float) -> int:
    return math.ceil(seconds * 1000)


class Timed(StatefulProcessor):
    """A value a key, which ends as the watermark reaches the time that it is due.

    ``value``: its DDL. ``seen`` takes value (a tuple or None) and row and returns
    the new value and rows to put out; ``due`` gives the second at which to end a
    value, and ``end`` the rows to put out then.

    Keys are dealt out to buckets, and a bucket's values are one map: a call of Spark
    costs far more than a row, and a frame goes for all rows of a bucket. What is
    written are the values that changed. A bucket has one timer, for the value that
    is due first; when that fires, its values are gone through.
    """

    keys: T.StructType  # of the key's column; set by ``by_key``

    def __init__(self, value: str, order: list[str], out: T.StructType):
        self.value, self.order, self.out = value, order, out

    def seen(self, value: tuple | None, row: dict[str, Any]) -> tuple[tuple, list[dict]]:
        raise NotImplementedError

    def due(self, value: tuple) -> float:
        raise NotImplementedError

    def end(self, key: tuple, value: tuple) -> list[dict]:
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", self.keys, self.value)
        self.bucket = handle.getValueState("bucket", "n long, wakes long")

    def frame(self, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.out.fieldNames())

    def values(self) -> dict[Any, tuple]:
        return {k: tuple(v) for (k,), v in self.held.iterator()}

    def known(self, keys: list, n: int) -> dict[Any, tuple]:
        """The values of some of the bucket's ``n`` keys: one call a key, or all in few calls."""
        if n <= 8 * len(keys):
            return self.values() if n else {}
        found = ((k, self.held.getValue((k,))) for k in keys)
        return {k: tuple(v) for k, v in found if v is not None}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (name,) = self.keys.fieldNames()
        frame = pd.concat(list(rows)).sort_values(self.order)
        n, wakes = self.bucket.get() or (0, None)
        before = self.known(frame[name].unique().tolist(), n)
        now: dict[Any, tuple] = {}
        out: list[dict] = []
        for row in frame.to_dict("records"):
            k = row[name]
            now[k], more = self.seen(now[k] if k in now else before.get(k), row)
            out += more
        changed = {k: v for k, v in now.items() if v != before.get(k)}
        for k, v in changed.items():
            self.held.updateValue((k,), v)
        if changed:
            n += sum(k not in before for k in changed)
            due = min(milliseconds(self.due(v)) for v in changed.values())
            if wakes is None or due < wakes:  # the timer may be early, not late
                if wakes is not None:
                    self.handle.deleteTimer(wakes)
                self.handle.registerTimer(due)
                wakes = due
            self.bucket.update((n, wakes))
        yield from self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        dues = {k: (milliseconds(self.due(v)), v) for k, v in self.values().items()}
        out: list[dict] = []
        for k, (due, v) in dues.items():
            if due <= until:
                self.held.removeKey((k,))
                out += self.end((k,), v)
        if later := [due for due, _ in dues.values() if due > until]:
            self.handle.registerTimer(min(later))
            self.bucket.update((len(later), min(later)))
        else:
            self.bucket.clear()
        yield from self.frame(out)

    def close(self) -> None:
        pass


class Remembered(Timed):
    """What a step adds to each row; its state (a tuple whose last part is the
    second at which it was set) is forgotten ``ttl`` seconds after that."""

    def __init__(self, step: Step, value: str, order: list[str], out: T.StructType, ttl: float):
        super().__init__(value, order, out)
        self.step, self.ttl = step, ttl

    def seen(self, value: tuple | None, row: dict[str, Any]) -> tuple[tuple, list[dict]]:
        value, more = self.step(value, row)
        return value, [row | more]

    def due(self, value: tuple) -> float:
        return value[-1] + self.ttl


class Windows(Timed):
    """Windows that come, go and change their title between numbered snapshots,
    ``every`` seconds apart. A window that is in no later snapshot goes with the next
    one, and nothing is kept of it."""

    def __init__(self, key: str, every: float):
        fields = f"{key} long, snapshot long, change string, title string"
        super().__init__("snapshot long, title string", ["snapshot"], T.StructType.fromDDL(fields))
        self.key, self.every = key, every

    def seen(self, value: tuple | None, row: dict[str, Any]) -> tuple[tuple, list[dict]]:
        now, title, window = int(row["snapshot"]), row["title"], row[self.key]
        out = []
        if value is not None and value[0] < now - 1:
            out += self.end((window,), value)
            value = None
        if value is None:
            out.append({self.key: window, "snapshot": now, "change": "created", "title": title})
        elif value[1] != title:
            out.append({self.key: window, "snapshot": now, "change": "title_changed", "title": title})
        return (now, title), out

    def due(self, value: tuple) -> float:
        return (value[0] + 1) * self.every

    def end(self, key: tuple, value: tuple) -> list[dict]:
        return [{self.key: key[0], "snapshot": value[0] + 1, "change": "destroyed", "title": value[1]}]


class Debounced(Timed):
    """The last row of a key fires when ``wait`` seconds have gone without another."""

    def __init__(self, key: str, row_id: str, wait: float):
        super().__init__("id long, at double", ["at", row_id], T.StructType.fromDDL(f"{key} long, {row_id} long, fired_at double"))
        self.key, self.row_id, self.wait = key, row_id, wait

    def seen(self, value: tuple | None, row: dict[str, Any]) -> tuple[tuple, list[dict]]:
        fires = value is not None and row["at"] - value[1] >= self.wait
        return (int(row[self.row_id]), float(row["at"])), self.end((row[self.key],), value) if fires else []

    def due(self, value: tuple) -> float:
        return value[1] + self.wait

    def end(self, key: tuple, value: tuple) -> list[dict]:
        return [{self.key: key[0], self.row_id: value[0], "fired_at": value[1] + self.wait}]


def by_key(stream: DataFrame, key: str, time: str, late: str, processor: Timed) -> DataFrame:
    """``processor`` over the rows of each key. time: a timestamp column; rows
    that come later than ``late`` after newer ones, or without a key, are let go."""
    processor.keys = T.StructType([T.StructField(key, stream.schema[key].dataType)])
    timed = stream.where(F.col(key).isNotNull()).withWatermark(time, late)
    dealt = timed.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return dealt.groupBy("__bucket").transformWithStateInPandas(processor, processor.out, "Append", "EventTime")


def path_cache(stream: DataFrame, path: str, time: str, late: str, ttl: float = 24 * 3600) -> DataFrame:
    """Created, updated or skipped: captures (``path``, ``id``, content_hash, at in
    seconds) against the last one of their path, which is forgotten after ``ttl``."""
    kind = {f.name: f.dataType for f in stream.schema.fields}
    out = T.StructType([*[T.StructField(n, kind[n]) for n in (path, "id", "content_hash", "at")], T.StructField("action", T.StringType())])
    return by_key(stream, path, time, late, Remembered(dedup_step(ttl), "content_hash string, at double", ["at", "id"], out, ttl))


def window_changes(stream: DataFrame, window: str, time: str, late: str, every: float) -> DataFrame:
    """``window`` long, snapshot, change, title: from rows (``window``, snapshot long, title)."""
    return by_key(stream, window, time, late, Windows(window, every))


def debounced(stream: DataFrame, key: str, row_id: str, time: str, late: str, wait: float) -> DataFrame:
    """``key``, ``row_id`` and fired_at of rows (with at in seconds) that no other follows within ``wait`` seconds."""
    return by_key(stream, key, time, late, Debounced(key, row_id, wait))


def once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each row once that is delivered again within ``late`` of its time; a key is
    forgotten after that."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def held(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """key, value: what a query keeps as of its last batch or an earlier one."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held")
    found = (reader if batch is None else reader.option("batchId", batch)).load()
    return found.select(F.col("user_map_key").alias("key"), F.col("user_map_value").alias("value"))
