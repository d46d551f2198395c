"""Candidate generation and ranking: many queries against many memories in one job.

Lexical candidates come from an inverted index: the tokens of the queries meet the tokens of the texts in an equi-join,
so a text without a common word is never touched. Statistics (documents, average length, document frequencies) are
those of the whole index, before any scope filter. Vector candidates are block products over a bounded set of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import scores as S
from loam.functions import text as T
from loam.operators import gates

K1, B = 1.2, 0.75
#: Queries of one call are held in each task; more are searched in several calls.
MOST_QUERIES = 10_000


def _haystack(memories: DataFrame) -> Column:
    """Text and, where the table has it, the metadata's search text."""
    text = F.coalesce("text", F.lit(""))
    return F.lower(F.concat_ws("\n", text, F.nullif(F.col("metadata_text"), F.lit(""))) if "metadata_text" in memories.columns else text)


def _allowed(scored: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Only ids of ``allowed`` (id), before any best ones are taken; statistics are those of all memories."""
    return scored if allowed is None else scored.join(allowed.select("id").distinct(), "id", "left_semi")


def lexical(memories: DataFrame, queries: DataFrame, limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): 0.68 x share of the query's tokens + 0.35 if the text contains the query, at most 1."""
    q = queries.select("query_id", F.lower(T.trim(F.col("query"))).alias("query"), T.query_tokens(F.col("query")).alias("q_tokens"))
    q = q.withColumn("n", F.size("q_tokens")).where("n > 0")
    hay = memories.select("id", "timestamp_ms", _haystack(memories).alias("hay"))
    postings = hay.select("id", F.explode(T.text_tokens(F.col("hay"))).alias("token"))
    hits = _allowed(postings.join(q.select("query_id", F.explode("q_tokens").alias("token")), "token").groupBy("query_id", "id").agg(F.count("*").alias("overlap")), allowed)
    scored = hits.join(q, "query_id").join(hay, "id")
    scored = scored.select("query_id", "id", "timestamp_ms", F.least(F.lit(1.0), F.col("overlap") / F.col("n") * 0.68 + F.when(F.col("hay").contains(F.col("query")), 0.35).otherwise(0.0)).alias("score"))
    return top(scored, limit)


def top(scored: DataFrame, limit: int) -> DataFrame:
    """The best of each query: score, then newest, then id."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("timestamp_ms"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def bm25(memories: DataFrame, queries: DataFrame, pool: int = 80, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, timestamp_ms, raw, bm25): the pool's raw scores, and these normalised to 0..1 within it."""
    words = F.regexp_extract_all(_haystack(memories), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    docs = memories.select("id", "timestamp_ms", words.alias("words")).withColumn("len", F.size("words"))
    q = queries.select("query_id", F.explode(T.query_tokens(F.col("query"))).alias("term"))
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    tf = docs.select("id", "timestamp_ms", "len", F.explode("words").alias("term")).join(q.select("term").distinct(), "term").groupBy("id", "timestamp_ms", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighted = tf.join(df, "term").join(F.broadcast(totals))  # one row
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + (F.col("len") / F.col("avg_len") * B + (1 - B)) * K1)
    raw = weighted.withColumn("part", part).join(q, "term").groupBy("query_id", "id", "timestamp_ms").agg(F.round(F.sum("part"), 9).alias("score"))
    best = top(_allowed(raw, allowed), pool).withColumnRenamed("score", "raw")
    span = W.partitionBy("query_id")
    low, high = F.min("raw").over(span), F.max("raw").over(span)
    return best.select("query_id", "id", "timestamp_ms", "raw", F.when(high == low, 1.0).otherwise((F.col("raw") - low) / (high - low)).alias("bm25"))


def lexical_search(memories: DataFrame, queries: DataFrame, limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """The larger of the lexical score and 0.96 x the normalised BM25 score."""
    pool = bm25(memories, queries, min(4 * limit, 120), allowed)
    lex = lexical(memories, queries, 10 * limit, allowed).select("query_id", "id", F.col("score").alias("lex"))
    both = pool.join(lex, ["query_id", "id"], "left")
    scored = both.select("query_id", "id", "timestamp_ms", F.greatest(F.coalesce("lex", F.lit(0.0)), F.col("bm25") * 0.96).alias("score")).where("score > 0")
    return top(scored, limit)


def vector_search(base: DataFrame, queries: DataFrame, limit: int = 20, min_score: float = 0.3) -> DataFrame:
    """(query_id, id, score) of base (id, vec) against queries (query_id, vec): score = 1 / (1 + cosine distance).

    The queries, a checked number of them, are sent to every task; each batch of the base gives its best ``limit`` per
    query, so what is shuffled is in proportion to the batches. Vectors of another length are skipped."""
    rows = queries.select("query_id", "vec").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in one call")
    names = [r[0] for r in rows]
    q = np.array([r[1] for r in rows], np.float64)
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
    kind = queries.schema["query_id"].dataType.simpleString()

    def search(batches):
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            lengths = np.array([len(v) if v is not None else -1 for v in vecs])
            at = np.flatnonzero(lengths == q.shape[1])
            if not len(at):
                continue
            x = vecs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            score = 1 / (1 + np.clip(1 - q @ x.T, 0, 2))
            k = min(limit, len(at))
            # ties at the edge are kept, so that the later order decides
            least = -np.partition(-score, k - 1, 1)[:, k - 1]
            i, j = np.nonzero((score >= least[:, None]) & (score >= min_score))
            yield pa.RecordBatch.from_arrays([pa.array([names[a] for a in i]), ids.take(pa.array(at[j])), pa.array(score[i, j])], names=["query_id", "id", "score"])

    found = base.select("id", "vec").mapInArrow(search, f"query_id {kind}, id {base.schema['id'].dataType.simpleString()}, score double")
    found = found.withColumn("score", F.round("score", 9))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fused(vector: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """Full join of both arms on (query_id, id) and the weighted sum of their scores."""
    v = vector.select("query_id", "id", F.col("score").alias("v_score"), F.col("rank").alias("v_rank"))
    b = lexical_hits.select("query_id", "id", F.col("score").alias("b_score"), F.col("rank").alias("b_rank"))
    both = v.join(b, ["query_id", "id"], "full")
    return both.withColumn("score", S.fuse(F.col("v_score"), F.col("b_score")))


def _ranked(x: DataFrame, limit: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def simple_chain(hits: DataFrame, rows: DataFrame, as_of_ms: int, limit: int = 10, hard_min: float = 0.35) -> DataFrame:
    """Recency boost, importance weight, length norm, hard cutoff, time decay by the effective half-life, noise filter;
    each stage's score is kept. ``rows`` are normalised memories."""
    count = F.col("access_count")
    days = F.greatest(F.lit(0.0), (F.lit(as_of_ms) - F.col("last_accessed_at")) / F.lit(S.DAY))
    text = F.coalesce("text", F.lit(""))
    m = rows.select("id", "importance", "timestamp_ms", T.utf16_len(text).alias("len"), S.effective_half_life(60.0, count, days).alias("half_life"), "text")
    x = hits.select("query_id", "id", F.col("score").alias("s0"), F.col("rank").alias("ord")).join(m, "id")
    x = x.withColumn("s1", S.recency_boost(F.col("s0"), F.col("timestamp_ms"), as_of_ms))
    x = x.withColumn("s2", S.importance_weight(F.col("s1"), F.col("importance")))
    x = x.withColumn("s3", S.length_norm(F.col("s2"), F.col("len"))).where(F.col("s3") >= hard_min)
    x = x.withColumn("score", F.round(S.time_decay(F.col("s3"), S.age_days(F.col("timestamp_ms"), as_of_ms), F.col("half_life")), 9))
    return _ranked(x.where(~gates.is_noise(F.col("text"))).drop("text"), limit)


def lifecycle_chain(hits: DataFrame, rows: DataFrame, as_of_ms: int, limit: int = 10, hard_min: float = 0.35) -> DataFrame:
    """Length norm, hard cutoff, decay boost, noise filter; ``rows`` have the lifecycle's columns (composite, tier)."""
    x = hits.select("query_id", "id", F.col("score").alias("s0"), F.col("rank").alias("ord")).join(rows.select("id", "len", "composite", "tier", "text"), "id")
    x = x.withColumn("s1", S.length_norm(F.col("s0"), F.col("len"))).where(F.col("s1") >= hard_min)
    x = x.withColumn("score", F.round(S.decay_boost(F.col("s1"), F.col("composite"), F.col("tier")), 9))
    return _ranked(x.where(~gates.is_noise(F.col("text"))).drop("text"), limit)


def diversified(hits: DataFrame, vecs: DataFrame, limit: int = 10, cosine: float = 0.85) -> DataFrame:
    """Greedy in rank order: a row close to one already selected is put behind all that aren't. At most 20 rows a query."""
    x = hits.join(vecs.select("id", "vec"), "id", "left").where("rank <= 20")

    def pick(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("rank").to_numpy(), kind="stable")))
        units = []
        for v in t.column("vec").to_pylist():
            a = np.array(v if v else [], float)
            n = np.linalg.norm(a)
            units.append(a / n if n else None)
        chosen, later = [], []
        for i, u in enumerate(units):
            near = u is not None and any(units[j] is not None and len(units[j]) == len(u) and units[j] @ u > cosine for j in chosen)
            (later if near else chosen).append(i)
        order = (chosen + later)[:limit]
        return pa.table({"query_id": t.column("query_id").take(pa.array(order)), "id": t.column("id").take(pa.array(order)), "new_rank": pa.array(range(1, len(order) + 1), pa.int32()), "deferred": pa.array([i in later for i in order])})

    kind = lambda c: x.schema[c].dataType.simpleString()
    return x.select("query_id", "id", "rank", "vec").groupBy("query_id").applyInArrow(pick, f"query_id {kind('query_id')}, id {kind('id')}, new_rank int, deferred boolean")


def packed(hits: DataFrame, texts: DataFrame, items: int = 3, budget: int = 600, per_item: int = 180) -> DataFrame:
    """(query_id, id, rank, chars): hits in order within a budget of characters; the first that overflows is cut, then stop."""
    x = hits.select("query_id", "id", "rank").join(texts.select("id", F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(per_item)).alias("len")), "id").where(F.col("rank") <= items)
    before = F.coalesce(F.sum("len").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("chars", F.least(F.col("len"), F.lit(budget) - before)).where("chars > 0").select("query_id", "id", "rank", "chars")


def trace(stages: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(query_id, stage, n, low, high): one row for each query and stage (name, rows, score column)."""
    out = None
    for name, df, score in stages:
        part = df.groupBy("query_id").agg(F.lit(name).alias("stage"), F.count("*").alias("n"), F.round(F.min(score), 6).alias("low"), F.round(F.max(score), 6).alias("high"))
        out = part if out is None else out.unionByName(part)
    return out
