"""Vectors from array columns, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, id_col: str, vec_col: str, extra: str | None = None) -> DataFrame:
    """(id, vec array<double>): rows with an id and a vector of finite components, with the column ``extra`` if named.

    Of rows that share an id the one with the least (extra, vector) counts.
    """
    first = [df[extra].alias("extra")] if extra else []
    pairs = df.select(df[id_col].cast("long").alias("id"), *first, df[vec_col].cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = pairs.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(good).groupBy("id")
    if not extra:
        return rows.agg(F.min("vec").alias("vec"))
    least = rows.agg(F.min(F.struct("extra", "vec")).alias("least"))
    return least.select("id", F.col("least.extra").alias(extra), "least.vec")


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column; shorter rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    lengths = np.diff(ends)
    flat = column.values.to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width).astype(dtype)
    out = np.zeros((len(lengths), width), dtype)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def padded(rows: np.ndarray, width: int) -> np.ndarray:
    """The matrix with ``width`` columns: cut off or filled up with zeros."""
    out = np.zeros((len(rows), width), rows.dtype)
    n = min(width, rows.shape[1])
    out[:, :n] = rows[:, :n]
    return out


def whole(vec: Column, scale: int) -> Column:
    """Components as floor(scale * x) in 64 bits; larger ones are an error that shows the vector."""
    fits = F.forall(vec, lambda x: F.abs(x * scale) < F.lit(float(1 << 63)))
    return F.when(fits, F.transform(vec, lambda x: F.floor(x * scale).cast("long"))).otherwise(F.raise_error(F.concat(F.lit("a component times the scale leaves 64 bits: "), vec.cast("string"))))


def query_groups(queries: int, blocks: int, most: int, few: int = 256, tasks: int = 32) -> int:
    """Groups that queries are dealt into, each of which every block of rows is copied to.

    As many as ``most`` queries a group allows; more only while all tasks are few.
    """
    return max(1, -(-queries // most), min(-(-queries // few), tasks // blocks))


def largest(rows: np.ndarray) -> int:
    return max(abs(int(rows.max())), abs(int(rows.min()))) if rows.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact: a row for each of ``a``, a column for each of ``b``."""
    most = largest(a) * largest(b) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if ((exact >= 1 << 63) | (exact < -(1 << 63))).any():
        i, j = (int(x[0]) for x in np.nonzero((exact >= 1 << 63) | (exact < -(1 << 63))))
        raise OverflowError(f"a score leaves 64 bits: {a[i].tolist()} with {b[j].tolist()}")
    return exact.astype(np.int64)
