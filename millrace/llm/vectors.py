"""Vectors of whole numbers from vectors of floats, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

from .common import store

#: Components are floor(SCALE * x); they lie under LIMIT, so that squares of
#: differences and products of some hundred components fit 64 bits.
SCALE, LIMIT = 256, 1 << 27


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, size: int | None = None) -> DataFrame:
    """Stored: row long (distinct), id long, v array<int>. Rows with a null vector,
    one with a null, NaN or infinite component or one of ``LIMIT`` or more, or of
    another size than asked for, take no part."""
    x = F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * SCALE))
    fine = F.forall(F.col(vec_col), lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < LIMIT - 1, F.lit(False)) & ~F.isnan(c.cast("double")))
    kept = F.col(vec_col).isNotNull() & fine
    if size is not None:
        kept &= F.size(vec_col) == size
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).where(kept).select("id", x.cast("array<int>").alias("v"))
    return store(df.sparkSession, spread(rows).select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A batch's vectors as rows; shorter ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(len(column), size)
    out = np.zeros((len(column), size), np.int32)
    out[np.arange(size) < lengths[:, None]] = flat
    return out
