"""Integer vectors: the kept rows of an embeddings table and their packed form."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Components are held within 28 bits, so that sums of products of two of them fit in 64 bits.
LARGEST = 1 << 28


def integer_vectors(rows: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """``rows`` with ``column`` replaced by floor(scale * x) of each component, as long array.

    Rows whose vector is null or has a null, NaN or infinite component are left out.
    """
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    held = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    return rows.filter(x.isNotNull() & F.coalesce(finite, F.lit(False))).withColumn(column, held)


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as integers; shorter vectors end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def pack(rows: np.ndarray) -> list[bytes]:
    """Each row in two bytes a component where these suffice, else in four."""
    narrow = (np.abs(rows) < 1 << 15).all(axis=1)
    return [(b"2" + r.astype("<i2").tobytes()) if n else (b"4" + r.astype("<i4").tobytes()) for r, n in zip(rows, narrow.tolist())]


def unpack(packed: list[bytes], width: int) -> np.ndarray:
    if all(p[:1] == b"2" for p in packed):
        return np.frombuffer(b"".join(p[1:] for p in packed), "<i2").reshape(len(packed), width).astype(np.int64)
    return np.array([np.frombuffer(p, f"<i{p[:1].decode()}", offset=1) for p in packed], np.int64).reshape(len(packed), width)


def exact_type(largest: int, terms: int) -> type:
    """The fastest number type that adds ``terms`` products of numbers up to ``largest`` exactly."""
    return np.float64 if largest * largest * terms < 1 << 53 else np.int64
