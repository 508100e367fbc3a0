"""Structured Streaming forms of payload parsing and the keyed operators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.payloads import PAYLOAD, parse_payloads
from .steps import Step


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines that land in a folder; bad lines come with an error."""
    return parse_payloads(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def keyed(stream: DataFrame, keys: list[str], order: list[str], step: Step, added: str, idle: str = "24 hours") -> DataFrame:
    """The stream with the columns that ``step`` adds, state kept by key until it
    is idle for as long (processing time). Rows of a micro-batch go in order."""
    extra = T.StructType.fromDDL(added)
    out = T.StructType([*stream.schema.fields, *extra.fields])
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        more = []
        for row in rows.to_dict("records"):
            held, new = step(held, row)
            more.append(new)
        state.update((pickle.dumps(held),))
        state.setTimeoutDuration(milliseconds)
        added_rows = pd.DataFrame(more, index=rows.index)
        yield pd.concat([rows, added_rows], axis=1)[[f.name for f in out.fields]]

    return stream.groupBy(*keys).applyInPandasWithState(run, out, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(stream: DataFrame, at: str, key: Column, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts in event-time windows; rows later than ``late`` are let go."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width, slide), key.alias("key")).agg(F.count("*").alias("n"))


__all__ = ["PAYLOAD", "keyed", "payload_stream", "windowed_counts"]
