"""Applications that are blocked and unblocked while windows are watched.

A window is blocked or not from when it is first seen, by the patterns in force at
that time; after that, blocking or unblocking its bundle by its exact name turns the
window at once, and patterns do not. Names that are always blocked are so for
windows that come; a known window of one is turned by its exact name like others.

Changes (at, kind, pattern) are what a user does, windows and reads are many: changes
become stretches of time, in which a pattern or a name is blocked or not, and windows
and reads meet them by equal bundle. Which bundles a pattern covers is found on the
distinct bundles. At one instant, a change comes before a window or a read. Changes
of one name at one instant: an unblock comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.privacy import always_blocked


def stretches(changes: DataFrame, begin: list[str]) -> DataFrame:
    """(pattern, kind, since, until): what the last change of a pattern made of it.
    begin: patterns that are blocked before the first change; open ends are null."""
    spark = changes.sparkSession
    last = changes.groupBy("pattern", "at").agg(F.max("kind").alias("kind"))  # unblock is after block
    first = spark.createDataFrame([(p, "block") for p in begin], "pattern string, kind string")
    all_ = last.unionByName(first, allowMissingColumns=True)
    until = F.lead("at").over(Window.partitionBy("pattern").orderBy(F.asc_nulls_first("at")))
    return all_.select("pattern", "kind", F.col("at").alias("since"), until.alias("until"))


def in_time(at: Column) -> Column:
    return (F.col("since").isNull() | (F.col("since") <= at)) & (F.col("until").isNull() | (at < F.col("until")))


def glob(bundle: Column, pattern: Column) -> Column:
    """Whether a pattern covers a name: * is any text and ? a letter, as in LIKE."""
    quoted = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    return F.like(bundle, F.translate(quoted, "*?", "%_"))


def first_blocked(windows: DataFrame, changes: DataFrame, begin: list[str]) -> DataFrame:
    """``windows`` (window, bundle, seen_at) with blocked: when they are first seen."""
    held = stretches(changes, begin).where("kind = 'block'").drop("kind")
    names = windows.select("bundle").where("bundle IS NOT NULL").distinct()
    # a bundle's stretches: few names against few patterns
    covered = names.join(held, glob(F.col("bundle"), F.col("pattern"))).select("bundle", "since", "until")
    hit = windows.join(covered, "bundle").where(in_time(F.col("seen_at"))).select("window").distinct().withColumn("__hit", F.lit(True))
    both = windows.join(hit, "window", "left")
    return both.withColumn("blocked", F.coalesce(always_blocked(F.col("bundle")), F.lit(False)) | F.coalesce("__hit", F.lit(False))).drop("__hit")


def read_blocked(reads: DataFrame, windows: DataFrame, changes: DataFrame, begin: list[str]) -> DataFrame:
    """``reads`` (window, at, ...) with bundle and blocked: what a window is at that time.
    Windows are one row each; a read before its window was seen is left out."""
    known = first_blocked(windows, changes, begin)
    met = reads.join(known, "window").where("at >= seen_at")
    turned = stretches(changes, []).withColumnRenamed("pattern", "bundle")
    # at most one stretch of its bundle has a read in it
    found = met.join(turned, (met["bundle"] == turned["bundle"]) & in_time(met["at"]) & (F.col("since") > F.col("seen_at")), "left")
    now = F.coalesce(F.col("kind") == "block", "blocked")
    return found.select(*[met[c] for c in met.columns if c != "blocked"], now.alias("blocked"))
