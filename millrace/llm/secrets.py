"""Secret scans: fixed patterns plus an assignment-aware lexer.

The lexer reads source and configuration syntax (``name = "x"``, ``name: x``,
``"name": "x"``, ``cfg['name'] => 'x'``, ``<name>x</name>``, with a type as in
``name: str = "x"`` or ``name string = "x"``) into pairs of a target name and a
value of literals and names joined by ``+``. A type that names a secret counts
like a name (``SecretStr``, or ``env: db_pass = "x"``). Names that were
given a literal before are replaced by it, in the order of the text, so that a
constant that flows into ``db_password`` is found where it was written. The
literals of a pair are scored by the sensitivity of the target's name, part by
part, times the likeness of the value to a secret; from ``THRESHOLD`` on they
become spans of kind ``literal``, unless a pattern has the place already.

Patterns (leftmost, not overlapping, each kind by itself; matches that fail the
length are dropped after matching): assign, access and hex, see ``base_spans``.

Results for odd input: a null or empty text has no spans (and stays as it is
when redacted); null ids and repeated rows pass through, each row judged by
itself; texts of any length are scanned whole, in time and memory linear in
their length (a constant is kept as references to what it was made of, never
written out, and what its text is like is told from a table of at most 256
counts, where characters share a count by their low byte); an empty table gives an empty result; for ``redact`` other columns are carried
along whatever their names, ``find`` reads the two named ones only.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so a least length inside the pattern drops the same ones.
_HEX = re.compile(r"[0-9a-f]{24,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


# ---------------------------------------------------------------- lexer

_TERM = r"""(?:"((?:\\.|[^"\\\n])*+)"|'((?:\\.|[^'\\\n])*+)'|`((?:\\.|[^`\\\n])*+)`|([^\s"'`;,(){}\[\]<>+]++))"""
_ARGS = r"""(?:\[(?:[^\[\]\n"'`=]|\[[^\[\]\n"'`=]*+\])*+\]|<(?:[^<>\n"'`=]|<[^<>\n"'`=]*+>)*+>)"""
_TYPE_START = r"[&*]*+(?:'[a-z_]++[ ])?(?:mut[ ])?[A-Za-z_$]"
_ONE_TYPE = _TYPE_START + r"[A-Za-z0-9_.$:]*+" + _ARGS + r"*+[?!]?"
#: After | or &. A single colon ends it: what it follows is a name with a type of
#: its own, so that a row of such names is gone over once and not once a name.
_NEXT_TYPE = _TYPE_START + r"[A-Za-z0-9_.$]*+(?:::[A-Za-z0-9_.$]++)*+(?!:)" + _ARGS + r"*+[?!]?(?![?!]?[ \t]*+:)"
#: What may stand between a name and its =: a type after a colon, or one of Go's types for text.
_TYPED = (
    rf"[?!]?[ \t]*+:[ \t]*+({_ONE_TYPE}(?:[ \t]*+[|&][ \t]*+{_NEXT_TYPE})*+)[ \t]*+=(?![=>~])"
    r"|[ \t]++(?:\*|\[[0-9]*+\])*+(?:string|byte|rune|any|interface\{\})[ \t]*+=(?![=>~])"
)
_PAIR = re.compile(
    r"""(?<![A-Za-z0-9_.$-])([A-Za-z_$][A-Za-z0-9_.$-]*+)["'`]?[\])]*+(?:""" + _TYPED + r"""|[ \t]*+(?:=>|:=|=(?!=)|:(?!=|//)))[ \t]*+""" + _TERM
)
_MORE = re.compile(r"[ \t]*\+[ \t]*" + _TERM)
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)>([^<\n]++)</\1>")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_STARTS = r"<.*>|\$\{?.*\}?|%.*%|\{\{.*\}\}|(change|replace|insert).*|your.*|my.*|example.*|sample.*|dummy.*|test.*|todo.*"
#: Of long texts only the beginning and the end are looked at, which is all that these ask for.
_LONG_PLACEHOLDER = re.compile(rf"(?is){_STARTS}")
_PLACEHOLDER = re.compile(rf"(?is)(.)\1*|{_STARTS}|none|null|nil|true|false|undefined|password|secret|token")
_SPACE = re.compile(r"\s")
_KINDS_OF = [re.compile(p) for p in (r"[0-9]", r"[a-z]", r"[A-Z]", r"[^A-Za-z0-9]")]

SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 1.0,
    "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "authorization": 0.9, "bearer": 0.9, "auth": 0.5, "key": 0.4, "pin": 0.4, "signature": 0.4,
}
KEY_OF = frozenset({"api", "access", "private", "secret", "encryption", "signing", "auth", "master", "account", "ssh", "client", "service", "storage"})
HARMLESS = frozenset(
    {"id", "name", "type", "length", "len", "count", "size", "url", "uri", "path", "file", "field", "label", "hint", "prompt", "policy", "expiry", "expires", "ttl", "limit", "max", "min", "public", "format"}
)


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    score = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if "key" in parts and KEY_OF & set(parts):
        score = 1.0
    return score * (0.3 if parts and parts[-1] in HARMLESS or "public" in parts else 1.0)


#: Longest stand-in that is known by the whole of its text, and the longest beginning of one.
_HEAD = 16
#: Lengths past any use are all alike.
_LONG = 1e300


class Shape:
    """What a text is like: enough to score it, and enough of both to score two texts in a row."""

    __slots__ = ("length", "head", "tail", "spaced", "kinds", "counts")

    def __init__(self, length: float, head: str, tail: str, spaced: bool, kinds: int, counts: dict[int, float]):
        self.length, self.head, self.tail, self.spaced, self.kinds, self.counts = length, head, tail, spaced, kinds, counts

    @staticmethod
    def of(text: str) -> Shape:
        kinds = sum(1 << i for i, p in enumerate(_KINDS_OF) if p.search(text))
        counts: dict[int, float] = {}
        for c, n in Counter(text).items():
            counts[ord(c) & 255] = counts.get(ord(c) & 255, 0) + n
        return Shape(len(text), text[:_HEAD], text[-2:], bool(_SPACE.search(text)), kinds, counts)

    def then(self, other: Shape) -> Shape:
        """The shape of this text followed by the other."""
        length = min(self.length + other.length, _LONG)
        head = self.head if self.length >= _HEAD else (self.head + other.head)[:_HEAD]
        tail = other.tail if other.length >= 2 else (self.tail + other.tail)[-2:]
        counts = dict(self.counts)
        for c, n in other.counts.items():
            counts[c] = min(counts.get(c, 0) + n, _LONG)
        return Shape(length, head, tail, self.spaced or other.spaced, self.kinds | other.kinds, counts)

    def stand_in(self) -> bool:
        # a long text's middle decides nothing: its beginning and its end stand for it
        text = self.head if self.length <= _HEAD else self.head + self.tail
        return len(self.counts) == 1 or bool((_PLACEHOLDER if self.length <= _HEAD else _LONG_PLACEHOLDER).fullmatch(text))

    def score(self) -> float:
        """Likeness to a secret: 0 for short, spaced or stand-in values, then by bits a character."""
        if self.length < 6 or self.spaced or self.stand_in():
            return 0.0
        total = sum(self.counts.values())
        bits = -sum(c / total * math.log2(c / total) for c in self.counts.values())
        return min(1.0, bits / 2.5) * (0.45 if self.kinds.bit_count() == 1 and self.length < 16 else 1.0)


def literal_score(value: str) -> float:
    return Shape.of(value).score()


class Value:
    """A literal at its place, or several values in a row. Values are shared, never copied."""

    __slots__ = ("text", "start", "end", "parts", "shape", "told")

    def __init__(self, text: str = "", start: int = 0, end: int = 0, parts: tuple[Value, ...] = ()):
        self.text, self.start, self.end, self.parts = text, start, end, parts
        self.shape: Shape | None = None
        self.told = False

    def known_shape(self) -> Shape:
        """Worked out once for every value that this one is made of."""
        todo = [self]
        while todo:
            v = todo[-1]
            if v.shape is not None:
                todo.pop()
            elif not v.parts:
                v.shape = Shape.of(v.text)
            elif missing := [p for p in v.parts if p.shape is None]:
                todo += missing
            else:
                v.shape = reduce(Shape.then, [p.shape for p in v.parts])
        return self.shape

    def tell(self, out: list[Span]) -> None:
        """Adds the places of the literals; what was told before is not told again."""
        todo = [self]
        while todo:
            v = todo.pop()
            if not v.told:
                v.told = True
                todo += v.parts
                if not v.parts and v.end > v.start:
                    out.append(("literal", v.start, v.end))


def _term(m: re.Match, group: int) -> tuple[str, int, int, bool]:
    """Text, start, end, and whether it is bare."""
    for g in range(group, group + 4):
        if m[g] is not None:
            return m[g], m.start(g), m.end(g), g == group + 3
    raise AssertionError


def literal_spans(text: str) -> list[Span]:
    known: dict[str, Value] = {}
    out: list[Span] = []

    def meet(name: str, value: Value) -> None:
        s = name_score(name)
        if s and s * value.known_shape().score() >= THRESHOLD:
            value.tell(out)

    if "=" in text or ":" in text:
        at = 0
        while m := _PAIR.search(text, at):
            parts: list[Value] = []
            at, term, group = m.end(), m, 3
            while True:
                word, a, b, bare = _term(term, group)
                named = known.get(word) if bare and _NAME.fullmatch(word) else None
                parts.append(Value(word, a, b) if named is None else named)
                term, group = _MORE.match(text, at), 1
                if term is None:
                    break
                at = term.end()
            value = parts[0] if len(parts) == 1 else Value(parts=tuple(parts))
            known[m[1]] = value
            meet(m[1], value)
            if m[2]:
                meet(m[2], value)
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            meet(m[1], Value(m[2], *m.span(2)))
    return out


def spans(text: str | None) -> list[Span]:
    """All spans by start, then by kind. A literal within a pattern's span is left out."""
    if not text:
        return []
    base = sorted(base_spans(text), key=lambda s: s[1])
    added: set[Span] = set()
    if "=" in text or ":" in text or "</" in text:
        starts = [s[1] for s in base]
        reach = list(accumulate((s[2] for s in base), max))
        for s in literal_spans(text):
            before = bisect_right(starts, s[1])
            if not before or reach[before - 1] < s[2]:
                added.add(s)
    return sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, found: list[Span], mark: str) -> str:
    out, at = [], 0
    for _, a, b in found:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- operators

SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): code points, ends exclusive, by start."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, _SPAN)], ["id", "spans"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(run, f"id {kind}, spans {SPAN}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not t or not (found := spans(t)) else redacted(t, found, mark) for t in (x.as_py() for x in b.column(at))]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
