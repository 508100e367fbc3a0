"""Search for a piece of text anywhere in a column, by its three-letter pieces.

The index has a row for each row's different trigrams (in lower case), sorted by
trigram, so that a look-up skips the row groups of all others, and a small table of
how many rows have each. A pattern (LIKE, without regard to case) names trigrams
that a hit must have; the rarest ``RAREST`` of them are looked up and intersected,
and what is left is held against the pattern itself. What is read follows the
rarest pieces and the hits, not the table.

A pattern without three letters in a row has no trigram and scans. Null texts are
never hits. An escaped % or _ is a letter, as for LIKE.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Trigrams that are intersected; the pattern itself is checked after that.
RAREST = 4


def trigrams(text: Column) -> Column:
    def of(c: Column) -> Column:
        starts = F.when(F.size(c) >= 3, F.sequence(F.lit(0), F.size(c) - 3)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))

    # by an array of letters: a text's n-th letter is found by going through it
    return let(F.split(F.lower(text), ""), of)


def pieces(pattern: str) -> list[str]:
    """The runs of letters of a LIKE pattern, in lower case."""
    out, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out[-1] += pattern[at]
        elif c in "%_":
            out.append("")
        else:
            out[-1] += c
        at += 1
    return [p.lower() for p in out if p]


@dataclass
class Index:
    rows: DataFrame
    id_col: str
    text_col: str
    postings: DataFrame
    counts: DataFrame

    def rarest(self, pattern: str) -> list[str]:
        """The trigrams to look up: of a pattern's, those that fewest rows have."""
        wanted = sorted({p[i : i + 3] for p in pieces(pattern) for i in range(len(p) - 2)})
        if not wanted:
            return []
        known = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(wanted)).collect()}  # a row a trigram of the pattern
        return sorted(wanted, key=lambda g: (known.get(g, 0), g))[:RAREST]

    def search(self, pattern: str) -> DataFrame:
        """The rows whose text is like the pattern."""
        hit = F.col(self.text_col).ilike(pattern)
        grams = self.rarest(pattern)
        if not grams:
            return self.rows.where(hit)
        having = self.postings.where(F.col("gram").isin(grams)).groupBy(self.id_col).agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        return self.rows.join(having.select(self.id_col), self.id_col, "left_semi").where(hit)


def build(rows: DataFrame, id_col: str, text_col: str, root: str) -> Index:
    """An index of ``rows`` (distinct ids) in a new folder."""
    spark = rows.sparkSession
    each = rows.select(id_col, F.explode(trigrams(F.col(text_col))).alias("gram"))
    # a trigram that most rows have is cut by id, so that no task has all of its rows
    each.repartitionByRange("gram", id_col).sortWithinPartitions("gram", id_col).write.option("parquet.block.size", 4 << 20).parquet(f"{root}/postings")
    postings = spark.read.parquet(f"{root}/postings")
    postings.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange(8, "gram").sortWithinPartitions("gram").write.parquet(f"{root}/counts")
    return Index(rows, id_col, text_col, postings, spark.read.parquet(f"{root}/counts"))
