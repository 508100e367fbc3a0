"""Chunking of texts into rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def exploded(df: DataFrame, chunks: Column, text_col: str) -> DataFrame:
    c = df.withColumn("__chunks", chunks).drop(text_col)
    total = F.size("__chunks").alias("total_chunks")
    rest = [c_ for c_ in c.columns if c_ != "__chunks"]
    out = c.select(*rest, total, F.posexplode("__chunks").alias("chunk_index", "__chunk"))
    return out.select(*rest, "chunk_index", "total_chunks", F.col("__chunk.text").alias("chunk_text"), F.col("__chunk.token_count").alias("token_count"))


def word_chunks(df: DataFrame, text_col: str = "text", most: int = 1024, overlap: int = 100) -> DataFrame:
    """A row a chunk; no shuffle. Blank texts give none."""
    return exploded(df, T.chunk_words(F.col(text_col), most, overlap), text_col)


def tabular_pack(lines: list[str], most: int, carried: int = 3) -> list[tuple[str, int]]:
    """Lines packed in turn; a chunk that is full hands its last lines to the next."""
    out: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    total = 0
    for line in lines:
        size = max(1, len(line.split()))
        if held and total + size > most:
            out.append(("\n".join(x for x, _ in held), total))
            held = held[-carried:]
            total = sum(n for _, n in held)
        held.append((line, size))
        total += size
    if held:
        out.append(("\n".join(x for x, _ in held), total))
    return out


def _lines(text: str) -> list[str]:
    return text.splitlines() if "\r" in text else text.removesuffix("\n").split("\n")


def count(text: Column, most: int = 1024, overlap: int = 100) -> Column:
    """How many chunks ``chunks`` makes of a text. Only tabular ones are packed for it."""

    @F.pandas_udf("int")
    def packed(tables: pd.Series) -> pd.Series:
        return tables.map(lambda x: None if x is None else len(tabular_pack(_lines(x), most))).astype("Int32")

    tabular = T.is_tabular(text)
    return F.coalesce(packed(F.when(tabular, text)), T.chunk_count(text, most, overlap))


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, overlap: int = 100) -> DataFrame:
    """Tabular texts by lines, all others by words: (id_col, chunk_index,
    total_chunks, chunk_text, token_count).

    Packing lines carries state from line to line, which as a fold in SQL would
    copy the chunks for every line; tables therefore go through Arrow.
    """
    kind = df.schema[id_col].dataType.simpleString()
    thin = df.select(id_col, text_col)
    tabular = thin.where(T.is_tabular(F.col(text_col)))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            ids, index, total, texts, sizes = [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = tabular_pack(_lines(text), most)
                for i, (chunk, n) in enumerate(got):
                    ids.append(key)
                    index.append(i)
                    total.append(len(got))
                    texts.append(chunk)
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())],
                [id_col, "chunk_index", "total_chunks", "chunk_text", "token_count"],
            )

    schema = f"`{id_col}` {kind}, chunk_index int, total_chunks int, chunk_text string, token_count int"
    plain = word_chunks(thin.where(~T.is_tabular(F.col(text_col))), text_col, most, overlap)
    return plain.unionByName(tabular.mapInArrow(pack, schema))
