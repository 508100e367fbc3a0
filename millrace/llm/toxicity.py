"""Counterfactually regularised toxicity classifier.

A logistic model over which words and word beginnings a text has (whole words,
and their first four and five bytes), each a 64-bit hash. From the labelled
training rows a sample of at most ``SAMPLE`` ids is drawn by hash of the id, one
row an id. Their features are counted in Spark, and the ``FEATURES`` that tell the
labels apart best (chi square) enter the model, with those of identity terms.

Every sampled text that holds an identity term is also read with the term
swapped for each other term of the list, and the squared change of its score,
averaged over the swaps, is added to the loss: what a text says about one group
it would say about another, so the terms themselves cannot carry the label. A
swapped text enters as the features that it loses and gains, which is all that
the change of its score depends on.

The driver gets, for each sampled text, the numbers of the chosen features that
it has and those of its swaps: two bytes each, however long the texts are. The
model and its training are of one size for every input; scoring goes over all
rows in place.

Results for odd input: a null, empty or wordless text gets the score of the
model's intercept; null ids are never held out and never learnt from; of
several labels of an id the largest counts, null labels are left out; of several
texts of an id the least is learnt from; without usable labels, or with one label
only, every score is the (smoothed) share of toxic labels; repeated rows are
each scored; an empty table gives an empty result; columns beyond the named
ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, spans_hash, store, text_chunks, word_spans

SAMPLE = 12_000
FEATURES = 4_000
PREFIXES = (4, 5)

#: Group names whose exchange should not change a score.
IDENTITY_TERMS = (
    "women men girls boys christians muslims jews hindus buddhists atheists immigrants refugees foreigners gays lesbians "
    "blacks whites asians africans europeans americans mexicans germans frenchmen spaniards "
    "frauen männer christen muslime juden ausländer flüchtlinge femmes hommes chrétiens musulmans juifs étrangers réfugiés "
    "mujeres hombres cristianos musulmanes judíos extranjeros refugiados"
).split()


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and word beginning."""
    low = LOWER[data]
    start, end, first = word_spans(low, bounds, ALNUM)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    docs, hashes = [doc], [spans_hash(low, start, end)]
    for k in PREFIXES:
        longer = end - start > k
        s = start[longer]
        docs.append(doc[longer])
        hashes.append(spans_hash(low, s, s + k) ^ np.uint64(0xA24BAED4963EE407 * k & 0xFFFFFFFFFFFFFFFF))
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass
class Model:
    keys: np.ndarray  # ascending
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def logits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.full(len(bounds) - 1, self.intercept)
        if not len(self.keys):
            return out
        doc, h = features(data, bounds)
        some = self.maybe[h >> np.uint64(44)]
        doc, h = doc[some], h[some]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        pair = np.unique(doc[hit] * len(self.keys) + at[hit])
        np.add.at(out, pair // len(self.keys), self.weights[pair % len(self.keys)])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def term_features(terms: list[str]) -> list[np.ndarray]:
    """The distinct features of each term."""
    out = []
    for t in terms:
        raw = np.frombuffer(t.encode(), np.uint8)
        out.append(np.unique(features(raw, np.array([0, len(raw)]))[1]))
    return out


class Design:
    """Texts as numbers of chosen features, and what swapping a term changes."""

    def __init__(self, keys: np.ndarray, terms: list[str]):
        self.keys = keys
        raw = [np.frombuffer(t.encode(), np.uint8) for t in terms]
        self.word = np.array([spans_hash(LOWER[r], np.array([0]), np.array([len(r)]))[0] for r in raw], np.uint64)
        self.own = [self.numbers(f) for f in term_features(terms)]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Of the given features the chosen ones, as numbers."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at[self.keys[at] == h]

    def swaps(self, words: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(features lost, features gained, weight) of a text for each swap of a
        term that it holds. words: its words' hashes. times: how many of its words
        give each chosen feature. The swaps of a term weigh one together; swaps
        that change the same are one."""
        for t in np.flatnonzero(np.isin(self.word, words)):
            held = int((words == self.word[t]).sum())
            only = [f for f in self.own[t].tolist() if times[f] == held]
            seen: dict[tuple[tuple[int, ...], tuple[int, ...]], float] = {}
            for u, other in enumerate(self.own):
                if u != t:
                    new = set(other.tolist())
                    change = (tuple(f for f in only if f not in new), tuple(sorted(f for f in new if not times[f])))
                    seen[change] = seen.get(change, 0.0) + 1 / (len(self.own) - 1)
            for (lost, gained), weight in seen.items():
                if lost or gained:
                    yield np.array(lost, np.int64), np.array(gained, np.int64), weight

    def rows(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, float]]]]:
        """For each text the numbers of its chosen features, and its swaps."""
        doc, h = features(data, bounds)
        low = LOWER[data]
        start, end, first = word_spans(low, bounds, ALNUM)
        words = spans_hash(low, start, end)
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        doc, at = doc[hit], at[hit]
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order]
        cut = np.searchsorted(doc, np.arange(len(bounds)))
        for i in range(len(bounds) - 1):
            times = np.bincount(at[cut[i] : cut[i + 1]], minlength=len(self.keys))
            yield np.flatnonzero(times), list(self.swaps(words[first[i] : first[i + 1]], times))


def fit(
    keys: np.ndarray,
    texts: list[np.ndarray],
    labels: np.ndarray,
    swaps: list[list[tuple[np.ndarray, np.ndarray, float]]],
    fairness: float = 20.0,
    ridge: float = 2e-4,
    steps: int = 300,
    favour: float = 3.0,
) -> Model:
    """keys: the chosen features, ascending. texts: each text's numbers of them.
    labels: 0 or 1. swaps: of each text, as ``Design.swaps``. Deterministic."""
    y = labels.astype(float)
    base = (y.sum() + 0.5) / (len(y) + 1)
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(base / (1 - base))))
    if not 0 < y.sum() < len(y) or not len(keys):
        return flat
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    col = np.concatenate(texts).astype(np.int64)
    each = [(i, lost, gained, weight) for i, own in enumerate(swaps) for lost, gained, weight in own]
    swap_doc = np.array([e[0] for e in each], np.int64)
    swap_weight = np.array([e[3] for e in each])
    swap_row = np.repeat(np.arange(len(each)), [len(e[1]) + len(e[2]) for e in each])
    swap_col = np.concatenate([np.r_[e[1], e[2]] for e in each]).astype(np.int64) if each else np.zeros(0, np.int64)
    swap_sign = np.concatenate([np.r_[-np.ones(len(e[1])), np.ones(len(e[2]))] for e in each]) if each else np.zeros(0)
    if each:
        swap_weight = swap_weight / swap_weight.sum()
    # the labels weigh ``favour`` to one, however many texts have them
    weight = np.where(y > 0, favour / y.mean(), 1 / (1 - y.mean())) / (1 + favour)
    # a weight costs less the better its feature alone tells the labels apart (log ratio of the counts)
    has, pos = np.bincount(col, minlength=len(keys)), np.bincount(col, weights=y[doc], minlength=len(keys))
    apart = np.abs(np.log((pos + 1) / (y.sum() + 2)) - np.log((has - pos + 1) / (len(y) - y.sum() + 2)))
    cost = ridge / np.maximum(apart, 0.5) ** 2
    w, b = np.zeros(len(keys)), flat.intercept
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(doc, weights=w[col], minlength=len(y))
        s = sigmoid(z)
        g = (s - y) * weight / len(y)
        grad = cost * w
        if each:
            # loss: the mean of (score of the swapped text - score)**2
            other = sigmoid(z[swap_doc] + np.bincount(swap_row, weights=swap_sign * w[swap_col], minlength=len(each)))
            mine = s[swap_doc]
            pull = 2 * fairness * swap_weight * (other - mine)
            slope = pull * other * (1 - other)
            g = g + np.bincount(swap_doc, weights=slope - pull * mine * (1 - mine), minlength=len(y))
            grad = grad + np.bincount(swap_col, weights=swap_sign * slope[swap_row], minlength=len(w))
        full = np.r_[grad + np.bincount(col, weights=g[doc], minlength=len(w)), g.sum()]
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        step_size = 0.15 * min(1.0, 2 * (1 - t / steps))
        move = step_size * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(keys, w, float(b))


def counted(rows: DataFrame) -> DataFrame:
    """(feature, n, pos): in how many texts, and in how many of label 1, a feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            for i, j, data, bounds in text_chunks(b, "text", 1 << 20):
                doc, h = features(data, bounds)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                keys, at = np.unique(h[new], return_inverse=True)
                n = np.bincount(at, minlength=len(keys))
                pos = np.bincount(at, weights=y[i:j][doc[new]], minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(pos.astype(np.int64))], ["feature", "n", "pos"])

    return rows.mapInArrow(run, "feature long, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    most_features: int = FEATURES,
    least_chi: float = 6.6,
    least_texts: int = 3,
    terms: list[str] | None = None,
    **fitting,
) -> Model:
    """A model from labelled rows for which ``usable`` (over the id) holds."""
    spark = docs.sparkSession
    terms = IDENTITY_TERMS if terms is None else terms
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(usable).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    order = F.xxhash64(F.lit(11), F.col(id_col))
    some = one.orderBy(order, id_col).limit(sample).select(F.col(id_col).alias("k"), "y")  # at most sample thin rows
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = thin.join(F.broadcast(some), F.col("id") == F.col("k")).groupBy("k").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    rows = store(spark, rows.select("y", "text"), "toxicity-sample")
    size, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not size:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    rate = positive / size
    keys = np.zeros(0, np.uint64)
    if 0 < positive < size:
        seen = store(spark, counted(rows), "toxicity-features")
        expect = F.col("n") * rate
        chi = (F.col("pos") - expect) ** 2 / (expect * (1 - rate))
        best = seen.where((F.col("n") >= least_texts) & (chi > least_chi)).orderBy(chi.desc(), "feature").limit(most_features)
        named = np.unique(np.concatenate(term_features(terms))) if terms else keys
        known = seen.where(F.col("feature").isin(named.view(np.int64).tolist())) if len(named) else seen.limit(0)
        found = [r["feature"] for r in best.select("feature").unionAll(known.select("feature")).collect()]
        keys = np.unique(np.array(found, np.int64)).view(np.uint64)
        keys.sort()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        design = Design(keys, terms)
        for b in batches:
            for i, j, data, bounds in text_chunks(b, "text", 1 << 20):
                own, swapped = [], []
                for cols, swaps in design.rows(data, bounds):
                    own.append(cols.astype(np.uint16).tobytes())
                    swapped.append([{"lost": x.astype(np.uint16).tobytes(), "gained": y.astype(np.uint16).tobytes(), "weight": w} for x, y, w in swaps])
                yield pa.RecordBatch.from_arrays([b.column("y").slice(i, j - i), pa.array(own, pa.binary()), pa.array(swapped, SWAPS)], ["y", "own", "swaps"])

    numbers = lambda raw: np.frombuffer(raw, np.uint16).astype(np.int64)
    got = rows.mapInArrow(run, "y int, own binary, swaps array<struct<lost:binary,gained:binary,weight:double>>").toArrow().sort_by([("own", "ascending"), ("y", "ascending")])  # at most sample rows
    texts = [numbers(x.as_buffer()) for x in got.column("own")]
    swaps = [[(numbers(x["lost"]), numbers(x["gained"]), x["weight"]) for x in own] for own in got.column("swaps").to_pylist()]
    return fit(keys, texts, got.column("y").to_numpy(), swaps, **fitting)


SWAPS = pa.list_(pa.struct([("lost", pa.binary()), ("gained", pa.binary()), ("weight", pa.float64())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double): one row per row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in text_chunks(b, "text", 2 << 20):
                s = sigmoid(model.logits(data, bounds))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(s)], ["id", "score"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, ~held_out())
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
