"""Keyed sequential operators over tables.

What a row becomes depends on the last accepted row of its key, which no window
expresses. Rows are dealt by key and sorted, and a task goes through them once
with one key's state in hand: memory does not grow with a key's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..streaming.steps import Step


def sequential(df: DataFrame, keys: list[str], order: list[str], step: Step, added: str) -> DataFrame:
    """``df`` with the columns ``added`` (a DDL string) that ``step`` returns.

    ``order`` should be total within a key.
    """
    extra = T.StructType.fromDDL(added)
    schema = T.StructType([*df.schema.fields, *extra.fields])
    arrow = to_arrow_schema(extra)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, None
                state, more = step(state, row)
                out.append(more)
            cols = [pa.array([r[f.name] for r in out], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*names, *arrow.names])

    return df.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
