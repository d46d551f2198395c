"""The deterministic local embedding: signed feature hashing of tokens and their trigrams.

Features are found with SQL functions; they are hashed and added up within each row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 256
TOKEN = r"[a-z0-9]{2,}|[㐀-鿿]+"


def features(c: Column) -> Column:
    """Distinct tokens, with all trigrams of tokens longer than three; the first 64 characters if there is none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    tokens = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    long = F.filter(tokens, lambda t: F.length(t) > 3)
    grams = F.flatten(F.transform(long, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))))
    both = F.array_distinct(F.concat(tokens, grams))
    return F.when(F.size(both) > 0, both).when(low != "", F.array(F.substring(low, 1, 64))).otherwise(F.array().cast("array<string>"))


@lru_cache(200_000)
def _place(feature: str) -> tuple[int, int]:
    """(the first four bytes of the hash, the sign by the fifth)"""
    h = hashlib.sha1(feature.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(h[:4], "big"), 1 if h[4] % 2 == 0 else -1


def _weights(features: list[str], dim: int) -> np.ndarray:
    places = [_place(f) for f in features]
    return np.bincount(np.array([p % dim for p, _ in places], np.int64), np.array([s for _, s in places], float), dim) if places else np.zeros(dim)


def vector(text: str | None, dim: int = DIM) -> list[float]:
    """The unit vector of one text, as ``embedded`` gives it; empty without features."""
    low = (text or "").lower()
    tokens = re.findall(TOKEN, low)
    both = list(dict.fromkeys([*tokens, *(t[i : i + 3] for t in tokens if len(t) > 3 for i in range(len(t) - 2))])) or ([low[:64]] if low else [])
    w = _weights(both, dim)
    n = float(np.sqrt(w @ w))
    return (w / n).tolist() if n else []


def hashed(df: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """(id, idx, w): the integer weights of each text before normalisation."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, idx, w = [], [], []
            for r, fs in enumerate(batch.column("f").to_pylist()):
                x = _weights(fs or [], dim)
                k = np.flatnonzero(x)
                at.append(np.full(len(k), r))
                idx.append(k)
                w.append(x[k])
            join = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(join(at, np.int64))), pa.array(join(idx, np.int32)), pa.array(join(w, np.int64))], names=["id", "idx", "w"])

    return df.select(F.col(id_col).alias("id"), features(F.col(text_col)).alias("f")).mapInArrow(run, f"id {kind}, idx int, w bigint")


def embedded(df: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """(id, vec): dense unit vectors; texts without features have none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for fs in batch.column("f").to_pylist():
                w = _weights(fs or [], dim)
                n = float(np.sqrt(w @ w))
                out.append((w / n).tolist() if n else None)
            keep = pa.array([v is not None for v in out])
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), pa.array([v for v in out if v is not None], pa.list_(pa.float64()))], names=["id", "vec"])

    return df.select(F.col(id_col).alias("id"), features(F.col(text_col)).alias("f")).mapInArrow(run, f"id {kind}, vec array<double>")
