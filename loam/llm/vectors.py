"""Vectors as unit rows: usable ones only, as 4-byte floats in a binary column."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64


def units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable (finite, not all zero), and those rows with length 1."""
    with np.errstate(all="ignore"):
        most = np.abs(matrix).max(1, initial=0)
        good = np.isfinite(matrix).all(1) & (most > 0)
        m = matrix[good] / most[good][:, None]
        return good, m / np.linalg.norm(m, axis=1)[:, None]


def binary(matrix: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(matrix, np.float32)
    width = m.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * width), pa.py_buffer(m)])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int = DIM, kind=np.float32) -> np.ndarray:
    """The rows of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _from_lists(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    here = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = column.filter(here).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.flatnonzero(here.to_numpy(zero_copy_only=False)), rows


def _from_json(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    at, rows = [], []
    for i, text in enumerate(column.to_pylist()):
        try:
            x = json.loads(text) if text else None
            if isinstance(x, list) and len(x) == dim and all(type(v) in (int, float) for v in x):
                rows.append(np.array(x, np.float64))
                at.append(i)
        except (ValueError, RecursionError, OverflowError):
            pass
    return np.array(at, np.int64), np.array(rows).reshape(-1, dim)


def unit_rows(df: DataFrame, vec_col: str, keep: list[str], dim: int = DIM, drop: bool = True) -> DataFrame:
    """``keep`` and ``unit`` (binary) of the rows whose vector, an array of numbers or JSON text, is usable.

    Usable: exactly ``dim`` finite numbers, not all zero. Null, short, long or broken vectors are dropped, or have a
    null unit if ``drop`` is false.
    """
    source = df.select(*keep, F.col(vec_col).alias("__vector"))
    schema = T.StructType([*[source.schema[k] for k in keep], T.StructField("unit", T.BinaryType())])
    from_json = isinstance(source.schema["__vector"].dataType, T.StringType)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = (_from_json if from_json else _from_lists)(batch.column(len(keep)), dim)
            good, u = units(m)
            at = at[good]
            unit = binary(u)
            if drop:
                batch = batch.take(pa.array(at))
            else:
                index = np.full(batch.num_rows, -1)
                index[at] = np.arange(len(at))
                unit = unit.take(pa.array(index, mask=index < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], unit], names=[*keep, "unit"])

    return source.mapInArrow(rows, schema)
