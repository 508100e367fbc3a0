"""Document quality rules as a short-circuit cascade, in SQL expressions only.

Each rule is one expression over the text that is true where it rejects. On a
sample of about ``SAMPLE_ROWS`` rows, drawn from all of the table, each rule is
timed (what an empty rule takes is taken off, after a first run that compiles)
and its verdicts are noted. The rule with the highest rejection per cost goes
first; the next are chosen by what they reject of what the rules before them
pass. Rules run in that order inside one CASE, so that a document pays for a
rule only if every rule before it passed. The order changes the cost and the
name of the rule that is reported, never the verdict, which is that no rule
rejects. Costs count in powers of two, so that the clock's small changes leave
the order alone; between equals the given order holds.

Expressions bind what they use more than once as a lambda variable (``let``), so
that words are cut once and a rule stays a single lazy expression.

Results for odd input: a null or wordless text has no words and is rejected by
the word count; null ids and repeated rows pass through, each row judged by
itself; an empty table gives an empty result (the rules then keep their given
order); other columns are carried along, and where one is named like the added
column, the added one takes underscores before its name. Repeated windows are
told apart by 64-bit hashes of their words.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, store

SAMPLE_ROWS = 1000
SEED = 17
#: Seconds under which a rule's cost on the sample is not told from none.
LEAST_COST = 1 / 64
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words within windows of ``width`` words that are found twice or more."""
    n = F.size(words)
    starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(width)])))))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # most texts repeat nothing, and to see that is cheaper than to sort
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, lambda s: covered(s)))

    return let(hashes, lambda h: count(h)).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def kept_chars(text: Column, unwanted: str) -> Column:
    return F.length(F.regexp_replace(text, unwanted, "")).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes, from measures by name, a condition that is never null."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Measures of a text, lazily; ``words`` are its words."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": kept_chars(text, r"[^#*$%&|<>]+"),
        "n_dup_lines": let(worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
        "n_lines": F.size(worded_lines(text)).cast("long"),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long"),
        "n_capitals": kept_chars(text, r"[^\p{Lu}]+"),
        "n_small": kept_chars(text, r"[^\p{Ll}]+"),
    }


def judged(text: Column, body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """body(measures by name), with the text's words cut once."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return let(words_of(text), lambda w: body(measures(text, w).__getitem__))


#: Bounds of the base verdict.
BASE_RULES = [
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
]
#: Bounds beyond it. Shares of symbols, letters and repeated lines as is usual for web text.
MORE_RULES = [
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("words_without_letters", lambda m: 10 * m("n_letter_words") < 8 * m("n_words")),
    Rule("capitals", lambda m: m("n_capitals") > m("n_small")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
]
DEFAULT_RULES = [*BASE_RULES, *MORE_RULES]


def sampled(docs: DataFrame, text_col: str, rows: int, known: tuple[str, ...] = ()) -> DataFrame:
    """About ``rows`` texts of the whole table with their words and ``known``
    measures, stored: all tasks of the scan draw, each row by itself, and only what
    they drew meets in one."""
    n = docs.count()
    some = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.rand(SEED) < rows / max(n, 1))
    cut = some.repartition(1).withColumn("words", words_of(F.col("text")))
    of = measures(F.col("text"), F.col("words"))
    return store(docs.sparkSession, cut.select("text", "words", *[of[m].alias(m) for m in known]), "quality-sample")


def ordered(rules: list[Rule], cost: list[float], verdicts: dict[int, int]) -> list[tuple[int, float]]:
    """Numbers of the rules as they should run, with the share that each rejects
    of what comes to it. verdicts: how many sampled texts have which set of
    rejecting rules, as bits."""
    left, rest, out = list(range(len(rules))), dict(verdicts), []
    while left:
        total = sum(rest.values())
        share = {i: sum(n for v, n in rest.items() if v >> i & 1) / total if total else 0.0 for i in left}
        best = max(left, key=lambda i: (share[i] / cost[i], -i))
        out.append((best, share[best]))
        left.remove(best)
        rest = {v: n for v, n in rest.items() if not v >> best & 1}
    return out


def profile(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = (), repeats: int = 1) -> list[tuple[Rule, float, float]]:
    """Each rule with its cost and the share it rejects of what comes to it, in
    the order in which to run them. ``known``: measures that are worked out anyhow,
    so that a rule pays for what it needs besides them."""
    sample = sampled(docs, text_col, sample_rows, known)
    other = measures(F.col("text"), F.col("words"))

    def of_sample(measure: str) -> Column:
        return F.col(measure) if measure in known else other[measure]

    bits = reduce(Column.__add__, [F.when(r.rejects(of_sample), 1 << i).otherwise(0) for i, r in enumerate(rules)])
    # at most a row for each set of rules
    counts = {r["v"]: r["n"] for r in sample.groupBy(bits.alias("v")).agg(F.count("*").alias("n")).collect()}

    def seconds(rejects: Callable[[Callable[[str], Column]], Column]) -> float:
        took = []
        for _ in range(1 + repeats):  # the first compiles
            job = sample.agg(F.count_if(rejects(of_sample)))  # a new one: a job that has run keeps its stages
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    empty = seconds(lambda of: F.col("text").isNull() | F.col("words").isNull()) if counts else 0.0  # reads both
    cost = [max(seconds(r.rejects) - empty, LEAST_COST) if counts else 1.0 for r in rules]
    rounded = [2.0 ** round(math.log2(c)) for c in cost]
    return [(rules[i], rounded[i], share) for i, share in ordered(rules, rounded, counts)]


def cascade(rules: list[Rule], of: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(of), F.lit(rule.name)).otherwise(out)
    return out


def verdict(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Column:
    """For rows of ``docs``: the name of the first rule that rejects, else null."""
    order = [r for r, _, _ in profile(docs, rules or DEFAULT_RULES, text_col, sample_rows)]
    return judged(F.col(text_col), lambda of: cascade(order, of))


def judge(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with rejected_by string (null: kept)."""
    return docs.withColumn(fresh("rejected_by", docs.columns), verdict(docs, rules, text_col, sample_rows))


def keep(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    return docs.where(verdict(docs, rules, text_col, sample_rows).isNull())


BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    order = [r for r, _, _ in profile(docs, DEFAULT_RULES, known=BASE_COLUMNS)]

    def row(of: Callable[[str], Column]) -> Column:
        # the base columns are asked for anyhow; the other measures stay lazy
        base = F.struct(*[of(c).alias(c) for c in BASE_COLUMNS])

        def result(b: Column) -> Column:
            known = lambda name: b[name] if name in BASE_COLUMNS else of(name)
            failed = BASE_RULES[0].rejects(known) | BASE_RULES[1].rejects(known)
            return F.struct(*[b[c].alias(c) for c in BASE_COLUMNS], failed.alias("base_failed"), cascade(order, known).isNull().alias("kept"))

        return let(base, lambda b: result(b))

    return docs.select("doc_id", judged(F.col("text"), row).alias("r")).select("doc_id", "r.*")


_SP = r"[\x20\x09-\x0D]+"

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT rid, p, w[p:p + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS k FROM twice) GROUP BY rid),
m AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SP}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
             length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g')) AS n_small
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_letter_words < 8 * n_words
            OR n_capitals > n_small OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
