"""Embedding of whole tables: each distinct text once, long texts by their chunks' mean, any embedder plugged in.

An embedder is a function from a list of texts to a list of vectors; ``local`` needs none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import embed
from loam.operators import chunking

Embedder = Callable[[list[str]], list[list[float]]]
#: Dimensions of well-known models.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "jina-embeddings-v5-text-small": 1024, "jina-embeddings-v3": 1024, "nomic-embed-text": 768, "mxbai-embed-large": 1024, "bge-m3": 1024, "local-hash": embed.DIM}


def dimensions(model: str, override: int | None = None) -> int:
    """The override, else the table's number; an unknown model is an error."""
    if override:
        return override
    if model not in DIMENSIONS:
        raise ValueError(f"no dimensions known for {model}")
    return DIMENSIONS[model]


def local(texts: list[str]) -> list[list[float]]:
    return [embed.vector(t) for t in texts]


def _long(text: str, embedder: Embedder, size: int, depth: int) -> list[float] | None:
    """The mean of the chunks' vectors; chunks that are too long still are halved, three times at most."""
    parts = [text[s:e] for s, e in chunking.chunks(text, chunking.Config(size=size, overlap=size // 20, least=min(200, size // 2)))]
    if depth and len(parts) == 1 and len(parts[0]) > size:
        parts = [parts[0][: len(parts[0]) // 2]]
    vectors = [v for v in embedder(parts) if v]
    return np.mean(np.array(vectors), axis=0).tolist() if vectors else None


def embedded(df: DataFrame, id_col: str, text_col: str, embedder: Embedder = local, batch: int = 64, longest: int = 8_000, dim: int | None = None) -> DataFrame:
    """(id, vec) for every row; texts that are null or blank have an empty vector. Equal texts are embedded once.

    Texts of more than ``longest`` characters are embedded by chunks. A vector of another length than ``dim`` is an error."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.sha2("text", 256))
    texts = rows.groupBy("h").agg(F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            hashes, all_texts = b.column("h"), b.column("text").to_pylist()
            out: list = [[] for _ in all_texts]
            short = [i for i, t in enumerate(all_texts) if t.strip() and len(t) <= longest]
            for s in range(0, len(short), batch):
                some = short[s : s + batch]
                for i, v in zip(some, embedder([all_texts[i] for i in some])):
                    out[i] = v
            for i, t in enumerate(all_texts):
                if len(t) > longest and t.strip():
                    out[i] = _long(t, embedder, longest, 3) or []
            if dim is not None and any(v and len(v) != dim for v in out):
                raise ValueError("the embedder's vectors have another length")
            yield pa.RecordBatch.from_arrays([hashes, pa.array(out, pa.list_(pa.float64()))], names=["h", "vec"])

    vectors = texts.select("h", "text").mapInArrow(run, "h string, vec array<double>")
    return rows.select("id", "h").join(vectors, "h").select(F.col("id").cast(kind).alias("id"), "vec")


def chunk_mean(chunks: DataFrame) -> DataFrame:
    """(id, vec): the mean, dimension by dimension, of the vectors of each id's chunks (id, vec)."""
    x = chunks.select("id", F.posexplode("vec").alias("k", "v")).groupBy("id", "k").agg(F.avg("v").alias("v"))
    return x.groupBy("id").agg(F.expr("transform(array_sort(collect_list(struct(k, v))), x -> x.v)").alias("vec"))


def missing(truth: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, text) of rows without a vector, the first ``limit`` by id."""
    x = truth.select("id", "text").join(vectors.select("id"), "id", "left_anti")
    return x if limit is None else x.orderBy("id").limit(limit)


def repaired(truth: DataFrame, vectors: DataFrame, embedder: Embedder = local, limit: int | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vectors after the repair, report): missing ones are made, stale ones go, unless a limit leaves rows undone.

    report: (missing, stale, rebuilt, pruned)."""
    todo = missing(truth, vectors, limit)
    stale = vectors.select("id").join(truth.select("id"), "id", "left_anti")
    report = missing(truth, vectors).agg(F.count("*").alias("missing")).crossJoin(F.broadcast(stale.agg(F.count("*").alias("stale")))).crossJoin(F.broadcast(todo.agg(F.count("*").alias("rebuilt"))))  # one row each
    report = report.select("missing", "stale", F.when(F.lit(dry_run), F.lit(0)).otherwise(F.col("rebuilt")).alias("rebuilt"), F.when(F.lit(dry_run or limit is not None), F.lit(0)).otherwise(F.col("stale")).alias("pruned"))
    if dry_run:
        return vectors, report
    kept = vectors if limit is not None else vectors.join(truth.select("id"), "id", "left_semi")
    return kept.select("id", "vec").unionByName(embedded(todo, "id", "text", embedder)), report


def noise_like(vectors: DataFrame, prototypes: DataFrame, least: float = 0.82) -> DataFrame:
    """(id) of vectors (id, vec) that are as near as ``least`` to a prototype of noise (query_id, vec)."""
    from loam.operators import search

    near = search.vector_search(vectors, prototypes, 1_000_000, 0.0)
    return near.where(2 - 1 / F.col("score") >= least).select("id").distinct()


def learned(prototypes: DataFrame, new: DataFrame, most: int = 200, same: float = 0.95) -> DataFrame:
    """Prototypes (query_id, vec, at) with new ones (query_id, vec, at) that none is like; the newest ``most`` stay."""
    from loam.operators import search

    near = search.vector_search(new.select(F.col("query_id").alias("id"), "vec"), prototypes, 1_000_000, 0.0).where(2 - 1 / F.col("score") >= same).select(F.col("id").alias("query_id")).distinct()
    return prototypes.unionByName(new.join(near, "query_id", "left_anti")).orderBy(F.desc("at"), "query_id").limit(most)
