"""Extractors by name, and chunking as a table function for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import documents, payloads

Extractor = Callable[[DataFrame], DataFrame]

_extractors: dict[str, Extractor] = {
    "generic": documents.generic_pages,
    "chrome": payloads.extension_messages,
    "ocr": payloads.recognised,
    "accessibility": payloads.accessible,
}


def register(name: str, extractor: Extractor) -> None:
    """Adds an extractor or takes another's place."""
    _extractors[name] = extractor


def extractor(name: str) -> Extractor:
    if name not in _extractors:
        raise KeyError(f"no extractor {name}; there are {', '.join(sorted(_extractors))}")
    return _extractors[name]


def register_chunk_text(spark: SparkSession, name: str = "chunk_text") -> None:
    """``SELECT … FROM t, LATERAL chunk_text(t.text, 1024, 100)`` in SQL: rows
    (chunk_index, chunk_text, token_count). ``operators.chunking`` is the form for
    whole tables, which stays out of Python."""

    class Chunks:
        def eval(self, text: str | None, most: int, overlap: int) -> Iterator[tuple[int, str, int]]:
            words = (text or "").split()
            n, step = len(words), most - overlap
            if n <= most:
                if n:
                    yield 0, text, n
                return
            count = (n - overlap) // step + 1
            for j in range(count):
                own = words[j * step : j * step + most] + (words[count * step :] if j == count - 1 else [])
                yield j, " ".join(own), len(own)

    spark.udtf.register(name, F.udtf(Chunks, returnType="chunk_index int, chunk_text string, token_count int"))
