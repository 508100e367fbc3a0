"""Document likelihood over all segmentations into subword pieces.

The pieces are those of an existing vocabulary, and its scores weight them. A word is the path through a lattice of pieces (characters that are no
piece go by their byte pieces), and its probability is the sum over all paths,
by the forward recursion in log space. A document's probability is that of its
words and of one end. Pieces never cross white space, so a document's lattice
falls apart into its words', and every different word is worked out once.

There are three scores. ``plain_score`` has the vocabulary's weights as they are.
``score`` has weights fitted to the training documents by ``rounds`` of expectation
maximisation over the counts of all their words (forward and backward sums);
with no rounds the two are equal. The pieces and the end share one distribution,
so that both are probabilities.

``lexical_score`` is the query's ``score``. The lattice of a training word has one edge more,
which spans it whole and weighs its count less a discount (Kneser and Ney); the discounts
are what is left for paths of pieces, whose weights are fitted to different words, each by
its discount, and not to their occurrences. So a frequent word costs what it costs by
counts, and a new one what its pieces do. Counts and weights are those of the
document's class. Classes (eight, languages in the main) come from hard expectation
maximisation over all training documents' words, hashed to 1024 numbers; it
starts from eight of 256 of them, drawn by hash. A document is of the class that fits it best,
and its probability has the class's as a factor: a lower bound of the
mixture's, so that all texts together still have at most one. Between class and pieces stand
the counts of all classes, by the share of words single in a class that another knows.

Flow. Blocks of a few MB of text keep their documents as numbers of the block's
distinct words. The words with their training counts by class are dealt out by ranges of
a 64-bit hash and merged (a word of every document is one entry a block and class). Each
round goes over the merged words and gathers one number a piece and class. At the end
counts and log probabilities go back to the blocks. No task holds more than a
block or a range, and the driver holds the vocabulary and the classes only. The
choice of a class is exact in whole numbers, so that tasks that make it again agree.

Results for odd input: a null or empty text is the end alone; documents with a
null id are learnt from and not held out; repeated rows count and are scored
each; without training documents every piece has its first weight and nothing is
known; an empty table gives an empty result; columns beyond the two named ones
are not read. Two words are taken for equal with a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, from_planes, planes, powers, scramble, spans_hash, store, text_chunks, word_spans

BOUNDARY = 0x2581
_ROLL = 0xD1B54A32D192ED03


# ---------------------------------------------------------------- pieces


@dataclass
class Vocabulary:
    """Pieces by length in characters: ascending hashes and their numbers."""

    lengths: list[tuple[int, np.ndarray, np.ndarray]]
    maybe: list[np.ndarray]
    bytes_: np.ndarray  # number of each byte's piece, -1 if none
    prior: np.ndarray  # first log weights; the last is the end's

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        by_length: dict[int, list[tuple[int, int]]] = {}
        bytes_ = np.full(256, -1)
        score = np.array([sp.get_score(i) for i in range(n)])
        usable = np.zeros(n, bool)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            else:
                code = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
                by_length.setdefault(len(code), []).append((int(piece_hash(code[None, :])[0]), i))
            usable[i] = True
        if (score == np.round(score)).all():  # merge ranks: weights fall with the rank
            prior = -np.log(2.0 + np.argsort(np.argsort(-score, kind="stable"), kind="stable"))
        else:
            prior = score.astype(float)
        prior = np.where(usable, prior, -np.inf)
        prior = np.r_[prior, np.log(0.01)]
        prior -= np.log(np.exp(prior).sum())
        lengths, maybe = [], []
        for length, found in sorted(by_length.items()):
            found.sort()
            h = np.array([x[0] for x in found], np.uint64)
            lengths.append((length, h, np.array([x[1] for x in found])))
            bits = np.zeros(1 << 20, bool)
            bits[h >> np.uint64(44)] = True
            maybe.append(bits)
        return Vocabulary(lengths, maybe, bytes_, prior)


def _values(code: np.ndarray) -> np.ndarray:
    return scramble(code.astype(np.uint64) + np.uint64(0x51))


def piece_hash(code: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a matrix of characters."""
    return (_values(code) * powers(_ROLL, code.shape[1])).sum(axis=1, dtype=np.uint64)


class Lattice:
    """Words of one length in characters, with a leading boundary mark."""

    def __init__(self, code: np.ndarray, vocabulary: Vocabulary):
        self.n = code.shape[1]
        total = np.zeros((len(code), self.n + 1), np.uint64)
        np.cumsum(_values(code) * powers(_ROLL, self.n), axis=1, out=total[:, 1:])
        inverse = powers(pow(_ROLL, -1, 2**64), self.n)
        self.pieces: list[tuple[int, np.ndarray]] = []  # length, piece from each start or -1
        for (length, hashes, ids), maybe in zip(vocabulary.lengths, vocabulary.maybe, strict=True):
            if length > self.n:
                continue
            h = (total[:, length:] - total[:, :-length]) * inverse[: self.n - length + 1]
            out = np.full(h.shape, -1, np.int32)
            r, c = np.nonzero(maybe[h >> np.uint64(44)])
            own = h[r, c]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = hashes[at] == own
            out[r[hit], c[hit]] = ids[at[hit]]
            if hit.any():
                self.pieces.append((length, out))
        # the bytes of each character, up to four
        c = code.astype(np.int64)
        b = np.full((4, *c.shape), -1)
        one, two, three = c < 0x80, c < 0x800, c < 0x10000
        b[0] = np.where(one, c, np.where(two, 0xC0 | c >> 6, np.where(three, 0xE0 | c >> 12, 0xF0 | c >> 18)))
        b[1] = np.where(one, -1, np.where(two, 0x80 | c & 63, np.where(three, 0x80 | c >> 6 & 63, 0x80 | c >> 12 & 63)))
        b[2] = np.where(two, -1, np.where(three, 0x80 | c & 63, 0x80 | c >> 6 & 63))
        b[3] = np.where(three, -1, 0x80 | c & 63)
        self.bytes = np.where(b >= 0, vocabulary.bytes_[b], -2)

    def weights(self, logp: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        padded = np.r_[logp, -np.inf]
        by_piece = [(length, padded[np.where(p < 0, len(logp), p)]) for length, p in self.pieces]
        table = np.r_[logp, -np.inf, 0.0]  # -2: no such byte; -1: byte without a piece
        by_byte = table[np.where(self.bytes == -2, len(logp) + 1, np.where(self.bytes == -1, len(logp), self.bytes))].sum(axis=0)
        return by_piece, by_byte

    def forward(self, edges: list[tuple[int, np.ndarray]], single: np.ndarray) -> np.ndarray:
        a = np.full((len(single), self.n + 1), -np.inf)
        a[:, 0] = 0
        for e in range(1, self.n + 1):
            paths = [a[:, e - 1] + single[:, e - 1], *[a[:, e - k] + w[:, e - k] for k, w in edges if k <= e]]
            a[:, e] = np.logaddexp.reduce(paths, axis=0)
        return a

    def backward(self, edges: list[tuple[int, np.ndarray]], single: np.ndarray) -> np.ndarray:
        b = np.full((len(single), self.n + 1), -np.inf)
        b[:, self.n] = 0
        for s in range(self.n - 1, -1, -1):
            paths = [b[:, s + 1] + single[:, s], *[b[:, s + k] + w[:, s] for k, w in edges if s + k <= self.n]]
            b[:, s] = np.logaddexp.reduce(paths, axis=0)
        return b

    def marginal(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(*self.weights(logp))[:, -1]

    def expected(self, logp: np.ndarray, count: np.ndarray, out: np.ndarray) -> None:
        """Adds to ``out`` the expected number of each piece."""
        edges, single = self.weights(logp)
        a, b = self.forward(edges, single), self.backward(edges, single)
        z = a[:, -1:]
        times = np.where(np.isfinite(z[:, 0]), count, 0)[:, None]
        z = np.where(np.isfinite(z), z, 0)
        for (length, p), (_, w) in zip(self.pieces, edges, strict=True):
            share = np.exp(a[:, : self.n - length + 1] + w + b[:, length:] - z) * times
            hit = p >= 0
            out += np.bincount(p[hit], weights=share[hit], minlength=len(out))
        share = np.exp(a[:, :-1] + single + b[:, 1:] - z) * times
        for k in range(4):
            hit = self.bytes[k] >= 0
            out += np.bincount(self.bytes[k][hit], weights=share[hit], minlength=len(out))


class Words:
    """Words in a row: their bytes and bounds."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        lead = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        self.bounds = lead[bounds]
        self.code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)

    def lattices(self, vocabulary: Vocabulary, some: np.ndarray | None = None, most: int = 120_000) -> Iterator[tuple[np.ndarray, Lattice]]:
        """Words of one length at a time, about ``most`` characters together."""
        n = np.diff(self.bounds)
        of = np.arange(len(n)) if some is None else some
        of = of[np.argsort(n[of], kind="stable")]
        at = 0
        while at < len(of):
            size = int(n[of[at]])
            end = min(int(np.searchsorted(n[of], size, "right")), at + max(1, most // (size + 1)))
            own = of[at:end]
            code = np.full((len(own), size + 1), BOUNDARY, np.uint32)
            code[:, 1:] = self.code[self.bounds[own][:, None] + np.arange(size)]
            yield own, Lattice(code, vocabulary)
            at = end


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    return _vocabularies.get(path) or _vocabularies.setdefault(path, Vocabulary.load(path))


# ---------------------------------------------------------------- flow

BLOCK = "block long, n_train long, n_distinct long, ids binary, held binary, first binary, tokens binary, hashes binary, sizes binary, letters binary"


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """data[start:end] of all spans in a row."""
    size = end - start
    to = np.r_[0, np.cumsum(size)]
    return data[np.arange(to[-1]) + np.repeat(start - to[:-1], size)]


def to_blocks(docs: DataFrame, id_col: str, text_col: str, held: Column, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, j, data, bounds in text_chunks(b, "text", size):
                low = LOWER[data]
                start, end, first = word_spans(low, bounds, NON_SPACE)
                out = b.column("held").slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                h, at, tokens = np.unique(spans_hash(low, start, end), return_index=True, return_inverse=True)
                sink = pa.BufferOutputStream()
                t = pa.table({"id": b.column("id").slice(i, j - i)})
                with pa.ipc.new_stream(sink, t.schema) as w:
                    w.write_table(t)
                row = [
                    serial,
                    int((~out).sum()),
                    len(h),
                    sink.getvalue().to_pybytes(),
                    out.tobytes(),
                    first.astype(np.int64).tobytes(),
                    planes(tokens.astype(np.uint32)),
                    h.tobytes(),
                    (end - start)[at].astype(np.uint32).tobytes(),
                    gather(low, start[at], end[at]).tobytes(),
                ]
                kinds = [pa.int64()] * 3 + [pa.binary()] * 7
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])
                serial += 1

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    return thin.mapInArrow(run, BLOCK)


# ---------------------------------------------------------------- classes of documents

FEATURES = 1 << 10
_GRAIN = 1 << 14  # log weights are whole multiples of 1 / _GRAIN


@dataclass
class Block:
    """A block's documents as numbers of its distinct words."""

    tokens: np.ndarray
    first: np.ndarray
    held: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def read(b: pa.RecordBatch, row: int) -> Block:
        cell = lambda name: b.column(name)[row].as_buffer()
        return Block(from_planes(cell("tokens"), np.uint32), np.frombuffer(cell("first"), np.int64), np.frombuffer(cell("held"), bool), np.frombuffer(cell("hashes"), np.uint64))

    def histograms(self, some: np.ndarray, most: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of some documents by hash, for ``most`` documents at a time."""
        feature = (self.hashes >> np.uint64(54)).astype(np.int64)
        size = np.diff(self.first)
        for at in range(0, len(some), most):
            own = some[at : at + most]
            words = gather(self.tokens, self.first[own], self.first[own] + size[own])
            of = np.repeat(np.arange(len(own)), size[own])
            yield own, np.bincount(of * FEATURES + feature[words], minlength=len(own) * FEATURES).reshape(-1, FEATURES).astype(float)


@dataclass
class Classes:
    """Log weights of each class's features, and of the classes, in whole grains."""

    weights: np.ndarray
    prior: np.ndarray

    @staticmethod
    def of(words: np.ndarray, docs: np.ndarray) -> Classes:
        all_ = words.sum(axis=0) + 0.5
        words = words + 20 * all_ / all_.sum()
        grains = lambda p: np.round(_GRAIN * np.log(p))
        return Classes(grains(words / words.sum(axis=1, keepdims=True)), grains((docs + 1) / (docs + 1).sum()))

    def choose(self, histogram: np.ndarray) -> np.ndarray:
        # whole numbers far below 2**53: no order of summing makes a difference
        return (histogram @ self.weights.T + self.prior).argmax(axis=1)

    def entries(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class of each document, words and classes that occur together by word, and
        their number for each token."""
        of = np.zeros(len(block.held), np.int64)
        for own, x in block.histograms(np.arange(len(block.held))):
            of[own] = self.choose(x)
        k = len(self.prior)
        key = block.tokens.astype(np.int64) * k + np.repeat(of, np.diff(block.first))
        there = np.zeros(len(block.hashes) * k, bool)
        there[key] = True
        has = np.flatnonzero(there)
        return of, has // k, has % k, (np.cumsum(there) - 1)[key]


def seeds(blocks: DataFrame, k: int, drawn: int = 256, words: int = 50) -> np.ndarray:
    """Features of up to ``k`` training documents that the others drawn are near to.
    Drawn by hash of their words, each text once, those of fewer ``words`` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[bool, int], bytes] = {}
        for b in batches:
            for row in range(b.num_rows):
                block = Block.read(b, row)
                size = np.diff(block.first)
                docs = np.flatnonzero(~block.held & (size > 0))
                if not len(docs):
                    continue
                sums = np.add.reduceat(block.hashes[gather(block.tokens, block.first[docs], block.first[docs + 1])], np.cumsum(size[docs]) - size[docs])
                names = list(zip((size[docs] < words).tolist(), scramble(sums).view(np.int64).tolist(), strict=True))
                first = dict(zip(names, docs.tolist(), strict=True))
                best = sorted({*first, *kept})[:drawn]
                new = [name for name in best if name not in kept]
                kept = {name: kept[name] for name in best if name in kept}
                rows = [r.astype(np.uint32).tobytes() for _, x in block.histograms(np.array([first[name] for name in new], np.int64)) for r in x]
                kept.update(zip(new, rows, strict=True))
        short, h = zip(*kept, strict=True) if kept else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(short, pa.bool_()), pa.array(h, pa.int64()), pa.array(list(kept.values()), pa.binary())], ["short", "hash", "n"])

    each = blocks.select("tokens", "first", "held", "hashes").mapInArrow(run, "short boolean, hash long, n binary")
    got = each.groupBy("short", "hash").agg(F.first("n").alias("n")).orderBy("short", "hash").limit(drawn).collect()
    if not got:
        return np.zeros((1, FEATURES))
    x = np.array([np.frombuffer(r["n"], np.uint32) for r in got], float)
    log = np.log(weights := (x + 20 / FEATURES) / (x.sum(axis=1, keepdims=True) + 20))
    apart = (weights * log).sum(axis=1)[:, None] - weights @ log.T
    chosen: list[int] = []
    near = np.full(len(x), np.inf)
    for _ in range(min(k, len(x))):
        chosen.append(int(np.minimum(near[:, None], apart).sum(axis=0).argmin()))
        near = np.minimum(near, apart[:, chosen[-1]])
    return x[chosen]


def classes_of(blocks: DataFrame, k: int = 8, rounds: int = 3) -> tuple[Classes, np.ndarray]:
    """Classes by all training documents, and how many of these each has."""

    def of(model: Classes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # the last column counts documents
            n = np.zeros((len(model.prior), FEATURES + 1), np.int64)
            for b in batches:
                for row in range(b.num_rows):
                    block = Block.read(b, row)
                    for own, x in block.histograms(np.flatnonzero(~block.held)):
                        one = np.eye(len(n))[model.choose(x)]
                        n[:, :-1] += (one.T @ x).astype(np.int64)
                        n[:, -1] += one.sum(axis=0).astype(np.int64)
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n.ravel()[has])], ["at", "n"])

        return run

    words = seeds(blocks, k)
    model = Classes.of(words, np.ones(len(words)))
    thin = blocks.select("tokens", "first", "held", "hashes")
    for nth in range(rounds + 1):
        n = np.zeros((len(words), FEATURES + 1), np.int64)
        for r in thin.mapInArrow(of(model), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            n.ravel()[r["at"]] = r["n"]
        if nth < rounds:
            model = Classes.of(n[:, :-1], n[:, -1])
    return model, n[:, -1]


# ---------------------------------------------------------------- words

RANGE = "part int, n_known long, total long, seen array<long>, counts binary, words binary, classes binary, sizes binary, letters binary, blocks array<long>, places array<binary>"
#: For each class how many words have it once, twice, three and four times, and three or more times; all its words.
SEEN = 6


def merged_words(blocks: DataFrame, ranges: int, model: Classes) -> DataFrame:
    """Per range of the hash: the different words, their entries (one for each class that
    has the word) with training counts, and for each block which of them its entries are.
    seen: as SEEN, class by class, then the words single in a class, and those of them that others know."""
    edges = np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)
    k = len(model.prior)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                cell = lambda n, row=row, b=b: b.column(n)[row].as_buffer()
                block = Block.read(b, row)
                _, word, kind, entry = model.entries(block)
                train = np.repeat(~block.held, np.diff(block.first))
                h, c = block.hashes[word], np.bincount(entry[train], minlength=len(word)).astype(np.uint32)
                kind = kind.astype(np.uint8)
                size, letters = np.frombuffer(cell("sizes"), np.uint32), np.frombuffer(cell("letters"), np.uint8)
                start = np.cumsum(size.astype(np.int64)) - size
                size, letters = size[word], gather(letters, start[word], start[word] + size[word])
                cut = np.r_[np.searchsorted(h, edges), len(h)]
                at = np.r_[0, np.cumsum(size.astype(np.int64))]
                full = np.flatnonzero(np.diff(cut))
                for some in np.array_split(full, max(1, len(full) // 256)):
                    if not len(some):
                        continue
                    cols = [
                        pa.array(some.astype(np.int32)),
                        pa.array([b.column("block")[row].as_py()] * len(some), pa.int64()),
                        pa.array([planes(h[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                        pa.array([planes(c[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                        pa.array([kind[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary()),
                        pa.array([planes(size[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
                        pa.array([letters[at[cut[p]] : at[cut[p + 1]]].tobytes() for p in some], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "block", "hashes", "counts", "classes", "sizes", "letters"])

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        read = lambda name, kind: [from_planes(x.as_buffer(), kind) for x in t.column(name)]
        each = read("hashes", np.uint64)
        h = np.concatenate(each)
        _, at, place = np.unique(h, return_index=True, return_inverse=True)
        size = np.concatenate(read("sizes", np.uint32)).astype(np.int64)
        letters = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("letters")])
        start = np.cumsum(size) - size
        there = np.zeros(len(at) * k, bool)
        of = place * k + np.concatenate(read("classes", np.uint8))
        there[of] = True
        has = np.flatnonzero(there)
        place = (np.cumsum(there) - 1)[of]
        word, kind = has // k, has % k
        counts = np.bincount(place, weights=np.concatenate(read("counts", np.uint32)), minlength=len(has)).astype(np.int64)
        known = np.bincount(word, weights=counts, minlength=len(at))
        seen = [np.bincount(kind[hit], minlength=k) for hit in (*[counts == n for n in (1, 2, 3, 4)], counts >= 3)]
        seen.append(np.bincount(kind, weights=counts, minlength=k).astype(np.int64))
        single = counts == 1
        cut = np.r_[0, np.cumsum([len(x) for x in each])]
        row = [
            key[0].as_py(),
            int((known > 0).sum()),
            int(counts.sum()),
            [*np.array(seen).T.ravel().tolist(), int(single.sum()), int((single & (known[word] > 1)).sum())],
            planes(counts),
            planes(word.astype(np.uint32)),
            kind.astype(np.uint8).tobytes(),
            planes(size[at].astype(np.uint32)),
            gather(letters, start[at], start[at] + size[at]).tobytes(),
            t.column("block").to_pylist(),
            [planes(place[a:z].astype(np.uint32)) for a, z in zip(cut, cut[1:], strict=False)],
        ]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.binary())]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in RANGE.split(", ")])

    thin = blocks.select("block", "tokens", "first", "held", "hashes", "sizes", "letters")
    dealt = thin.mapInArrow(deal, "part int, block long, hashes binary, counts binary, classes binary, sizes binary, letters binary")
    return dealt.groupBy("part").applyInArrow(merge, RANGE)


@dataclass
class Entries:
    """A range's words, and for each entry its word, class and training count."""

    words: Words
    word: np.ndarray
    kind: np.ndarray
    counts: np.ndarray

    @staticmethod
    def read(b: pa.RecordBatch, row: int) -> Entries:
        cell = lambda name: b.column(name)[row].as_buffer()
        size = from_planes(cell("sizes"), np.uint32).astype(np.int64)
        words = Words(np.frombuffer(cell("letters"), np.uint8), np.r_[0, np.cumsum(size)])
        return Entries(words, from_planes(cell("words"), np.uint32), np.frombuffer(cell("classes"), np.uint8), from_planes(cell("counts"), np.int64))

    def lattices(self, vocabulary: Vocabulary, k: int, some: np.ndarray) -> Iterator[tuple[int, np.ndarray, Lattice]]:
        """Class, entries, and their words' lattice, a class at a time."""
        place = np.zeros(len(self.words.bounds) - 1, np.int64)
        for z in range(k):
            own = np.flatnonzero(some & (self.kind == z))
            place[self.word[own]] = own
            for of, lattice in self.words.lattices(vocabulary, self.word[own].astype(np.int64)):
                yield z, place[of], lattice


@dataclass
class Lexicon:
    """What the counts of words are worth: in class z a word that the class has c times weighs
    (c - discount[c]) / size[z], the end ``end[z]`` and all else ``rest[z]``; of that, words by all
    classes' counts have the share ``shared`` and paths of pieces what is left."""

    discount: np.ndarray
    size: np.ndarray
    end: np.ndarray
    rest: np.ndarray
    shared: float
    total: int

    @staticmethod
    def of(seen: np.ndarray, docs: np.ndarray, total: int) -> Lexicon:
        by = seen[:-2].reshape(-1, SEEN).astype(float)
        n1, n2, n3, n4 = by[:, :4].sum(axis=0)
        discount = np.array([0, 0.5, 0.5, 0.5])
        if min(n1, n2, n3, n4) > 0:  # Chen and Goodman's
            y = n1 / (n1 + 2 * n2)
            discount[1:] = np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.95, 2.95])
        # half an end and half a rest more, so that neither is ever nought
        size = by[:, 5] + docs + 1
        rest = (by[:, 0] * discount[1] + by[:, 1] * discount[2] + by[:, 4] * discount[3] + 0.5) / size
        return Lexicon(discount, size, (docs + 0.5) / size, rest, float(seen[-1] / (seen[-2] + 1)), total)

    def left(self, counts: np.ndarray) -> np.ndarray:
        return self.discount[np.minimum(counts, 3)]

    def log(self, kind: np.ndarray, counts: np.ndarray, known: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """Log probabilities of words by their counts in the class and in all, and by their paths of pieces."""
        whole = (counts - self.left(counts)) / self.size[kind] + self.rest[kind] * self.shared * known / max(self.total, 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(whole), np.log(self.rest[kind] * (1 - self.shared)) + paths)


def expectation(words: DataFrame, path: str, logp: np.ndarray, by_class: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Expected number of each piece: in the training words by their counts (the first row), and
    in each class's different words by their discounts."""
    k, n = by_class.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        out = np.zeros((k + 1, n))
        for b in batches:
            for row in range(b.num_rows):
                own = Entries.read(b, row)
                left = lexicon.left(own.counts)
                for z, of, lattice in own.lattices(vocabulary, k, own.counts > 0):
                    lattice.expected(logp, own.counts[of], out[0])
                    lattice.expected(by_class[z], left[of], out[z + 1])
        has = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(out.ravel()[has])], ["at", "n"])

    got = words.select("counts", "words", "classes", "sizes", "letters").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((k + 1) * n)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(k + 1, n)


def fitted(words: DataFrame, path: str, n_ends: int, rounds: int, lexicon: Lexicon, smooth: float = 0.1, lean: float = 50) -> tuple[np.ndarray, np.ndarray]:
    """Log weights of all pieces and, last, of the end; and, class by class, of all pieces alone,
    where those of all classes together count for ``lean`` pieces."""
    logp = vocabulary_of(path).prior
    usable = np.isfinite(logp)
    inside = usable & (np.arange(len(logp)) < len(logp) - 1)
    alone = np.where(inside, logp, -np.inf)
    by_class = np.tile(alone - np.logaddexp.reduce(alone), (len(lexicon.size), 1))
    for _ in range(rounds if n_ends else 0):
        n, *each = expectation(words, path, logp, by_class, lexicon)
        n[-1] = n_ends
        n = np.where(usable, n + smooth, 0)
        logp = np.log(np.where(usable, n, 1)) - np.log(n.sum())
        logp[~usable] = -np.inf
        every = np.where(inside, np.sum(each, axis=0) + smooth / 10, 0)
        m = np.array(each) + lean * every / every.sum()
        by_class = np.where(inside, np.log(np.where(inside, m, 1)), -np.inf) - np.log(m[:, inside].sum(axis=1, keepdims=True))
    return logp, by_class


def likelihood(
    docs: DataFrame,
    held: Column,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 2,
    block_bytes: int = 4 << 20,
    per_range: int = 1 << 19,
    plain: bool = True,
) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, lexical_score, plain_score).

    Documents for which ``held`` is true are scored but not learnt from.
    score: log10 probability of the text by the fitted weights; lexical_score: with
    edges for whole words, by classes; plain_score: by the vocabulary's weights (null if
    ``plain`` is false). base_score: of the words by their counts plus one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = store(spark, to_blocks(docs, id_col, text_col, held, block_bytes), "lattice-blocks")
    n_ends, entries = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    model, class_docs = classes_of(blocks)
    k = len(class_docs)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // per_range))
    words = store(spark, merged_words(blocks, ranges, model), "lattice-words")
    sums = [F.sum(F.col("seen")[i]) for i in range(SEEN * k + 2)]
    known, total, *seen = words.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n_known"), F.sum("total"), *sums)]).first()
    n, v = total + n_ends, known + (n_ends > 0)
    lexicon = Lexicon.of(np.array(seen), class_docs, total)
    first_weights = vocabulary_of(vocabulary).prior
    logp, by_class = fitted(words, vocabulary, n_ends, rounds, lexicon)
    names = ["counts", "values", "lexical", *["plain"] * plain]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary_of(vocabulary)
        for b in batches:
            for row in range(b.num_rows):
                own = Entries.read(b, row)
                value, paths, before = np.zeros((3, len(own.counts)))
                for z, of, lattice in own.lattices(pieces, k, np.ones(len(own.counts), bool)):
                    value[of], paths[of] = lattice.marginal(logp), lattice.marginal(by_class[z])
                    if plain:
                        before[of] = lattice.marginal(first_weights)
                counts = np.bincount(own.word, weights=own.counts)[own.word].astype(np.int64)
                results = [counts, value, lexicon.log(own.kind, own.counts, counts, paths), before][: len(names)]
                of_blocks = b.column("blocks")[row].as_py()
                for some in range(0, len(of_blocks), 64):
                    places = [from_planes(x.as_buffer(), np.uint32) for x in b.column("places")[row].values[some : some + 64]]
                    m = len(places)
                    cols = [
                        pa.array(of_blocks[some : some + m], pa.int64()),
                        pa.array([b.column("part")[row].as_py()] * m, pa.int32()),
                        *[pa.array([planes(x[p]) for p in places], pa.binary()) for x in results],
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["block", "part", *names])

    thin = words.select("part", "counts", "words", "classes", "sizes", "letters", "blocks", "places")
    returned = thin.mapInArrow(back, ", ".join(["block long, part int", *[f"{x} binary" for x in names]]))

    def by_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with entries for tokens, and the documents' classes."""
        for b in batches:
            for row in range(b.num_rows):
                kinds, _, _, entry = model.entries(Block.read(b, row))
                cols = [*[b.column(x).slice(row, 1) for x in ("block", "ids", "held", "first")], pa.array([kinds.astype(np.uint8).tobytes()], pa.binary()), pa.array([planes(entry.astype(np.uint32))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "ids", "held", "first", "kinds", "tokens"])

    # log probabilities of the class and of the end
    of_class = np.log((class_docs + 1) / (class_docs + 1).sum()) + np.log(lexicon.end)

    def score(_key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        read = lambda name, kind: np.concatenate([*[from_planes(x.as_buffer(), kind) for x in right.column(name)], np.zeros(0, kind)])
        c = read("counts", np.int64)
        cell = lambda name: left.column(name)[0].as_buffer()
        tokens, first = from_planes(cell("tokens"), np.uint32), np.frombuffer(cell("first"), np.int64)
        denominator = float(n + v + 1)

        def sums(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(first) - 1)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                out[full] = np.add.reduceat(x[tokens], first[full])
            return out

        size = np.diff(first) + 1
        kinds = np.frombuffer(cell("kinds"), np.uint8)
        return pa.table(
            {
                "id": pa.ipc.open_stream(cell("ids")).read_all().column("id"),
                "held_out": pa.array(np.frombuffer(cell("held"), bool)),
                "n_tokens": pa.array(size),
                "n_known": pa.array(sums((c > 0).astype(float)).astype(np.int64) + int(n_ends > 0)),
                "train_tokens": pa.array(np.full(len(size), n, np.int64)),
                "base_score": pa.array(sums(np.log10((c + 1) / denominator)) + np.log10((n_ends + 1) / denominator)),
                "score": pa.array((sums(read("values", np.float64)) + logp[-1]) / np.log(10)),
                "lexical_score": pa.array((sums(read("lexical", np.float64)) + of_class[kinds]) / np.log(10)),
                "plain_score": pa.array((sums(read("plain", np.float64)) + first_weights[-1]) / np.log(10)) if plain else pa.nulls(len(size), pa.float64()),
            }
        )

    out = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lexical_score double, plain_score double"
    mine = blocks.select("block", "ids", "held", "first", "tokens", "hashes").mapInArrow(by_entry, "block long, ids binary, held binary, first binary, kinds binary, tokens binary")
    return mine.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(score, out).withColumnRenamed("id", id_col)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = likelihood(docs, held, default_vocabulary(), plain=False)
    # the contract's score learns from the training rows; the one by fitted pieces alone stands beside it
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("lexical_score").alias("score"), F.col("score").alias("fitted_score"))
