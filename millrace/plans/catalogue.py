"""All named queries of the library with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import browse, capture, chunks, forms, intake, live, merging, stateful, timing

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (chunks, capture, browse, forms, intake, live, merging, stateful, timing):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
