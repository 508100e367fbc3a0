"""Pairs of rows of a key that are near each other in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def within_time(rows: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Each row beside the later rows of its key (columns with an underscore after
    their name) less than ``seconds`` later. Rows meet by spans of time, so that the
    pairs of a key grow with what falls into a span and not with its square."""
    span = F.floor(F.col(at) / seconds)
    first = rows.withColumn("__span", F.explode(F.array(span, span + 1)))
    second = rows.select(*[F.col(c).alias(f"{c}_") for c in rows.columns]).withColumn("__span", F.floor(F.col(f"{at}_") / seconds))
    same = (first["__span"] == second["__span"]) & (second[f"{key}_"] == first[key])
    return first.join(second, same).where((F.col(f"{at}_") > F.col(at)) & (F.col(f"{at}_") - F.col(at) < seconds)).drop("__span")


def similar_in_time(rows: DataFrame, key: str, at: str, content: str, seconds: float, similarity: float) -> DataFrame:
    """Pairs of ``within_time`` whose words overlap as much, with jaccard."""
    pairs = within_time(rows, key, at, seconds)
    return pairs.withColumn("jaccard", text.jaccard(F.col(content), F.col(f"{content}_"))).where(F.col("jaccard") >= similarity)
