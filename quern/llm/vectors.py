"""List columns as matrices, and which of their rows are usable vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import own


def matrix(values: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dim) doubles and a flag for each row: not null, of `dim` components, all finite, not all zero.

    Rows that are not usable are zeros.
    """
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    out = np.zeros((len(values), dim))
    good = pc.fill_null(pc.equal(pc.list_value_length(values), dim), False).to_numpy(zero_copy_only=False).copy()
    if good.any():
        picked = values.filter(pa.array(good)).flatten().cast(pa.float64())
        out[good] = pc.fill_null(picked, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good &= np.isfinite(out).all(1) & (out != 0).any(1)
    out[~good] = 0
    return out, good


def units(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in two steps so that neither tiny nor huge components get lost; zero rows stay."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), np.finfo(float).tiny)
    return x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) > 0, n, 1)


def dimensions(df: DataFrame, vector_col: str) -> list[int]:
    """The numbers of components that vectors have, by falling frequency: one row each, whatever the number of vectors."""
    sizes = df.groupBy(F.size(own(vector_col)).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0")
    return [r["d"] for r in sizes.orderBy(F.desc("n"), "d").collect()]


def stored(df: DataFrame, vector_col: str) -> type:
    """What components are stored as where rows are sent: as they are given, if that is single precision."""
    kind = df.select(own(vector_col)).schema[0].dataType
    return np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64


def rows_of(values: pa.Array | pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """Binary values of `width` numbers as a matrix of doubles."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return np.frombuffer(b"".join(x.as_buffer() for x in values), kind).reshape(-1, width).astype(np.float64, copy=False) if len(values) else np.zeros((0, width))


def binaries(x: np.ndarray, kind: type = np.float64) -> pa.Array:
    data, width = np.ascontiguousarray(x, kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
    bounds = np.arange(0, len(data) + 1, width, dtype=np.int32) if width else np.zeros(len(x) + 1, np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)])
