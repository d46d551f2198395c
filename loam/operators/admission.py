"""Admission: feature scores, the weighted decision, and statistics of decisions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import gates

#: Thresholds and half-lives of the presets.
PRESETS = {"balanced": (0.45, 0.6, 8, 14.0), "conservative": (0.52, 0.68, 10, 10.0), "high-recall": (0.34, 0.52, 6, 21.0)}
WEIGHTS = {"utility": 0.1, "confidence": 0.1, "novelty": 0.1, "recency": 0.1, "type_prior": 0.6}
PRIORS = {"profile": 0.95, "preferences": 0.9, "entities": 0.75, "events": 0.45, "cases": 0.8, "patterns": 0.85}


def weights(raw: dict[str, float]) -> dict[str, float]:
    """Clamped, and divided by their total."""
    w = {k: min(1.0, max(0.0, v)) for k, v in raw.items()}
    total = sum(w.values()) or 1.0
    return {k: v / total for k, v in w.items()}


def recency_gap(gap_days: Column, half_life: float) -> Column:
    return F.when(gap_days.isNull(), 1.0).when(gap_days <= 0, 0.0).otherwise(1 - F.exp(-gap_days * F.lit(0.6931471805599453) / half_life))


def score(utility: Column, confidence: Column, novelty: Column, recency: Column, category: Column, raw: dict[str, float] = WEIGHTS) -> Column:
    w = weights(raw)
    prior = F.lit(0.5)
    for name, p in PRIORS.items():
        prior = F.when(category == name, F.lit(p)).otherwise(prior)
    return F.coalesce(utility, F.lit(0.5)) * w["utility"] + confidence * w["confidence"] + novelty * w["novelty"] + recency * w["recency"] + prior * w["type_prior"]


def decision(s: Column, preset: str = "balanced") -> Column:
    reject, admit, _, _ = PRESETS[preset]
    return F.when(s < reject, "reject").when(s >= admit, "admit").otherwise("pass_to_dedup")


def rejections(df: DataFrame, most: int = 5) -> DataFrame:
    """(reason, n, label): the most frequent normalised reasons of (reason_text); the label is the smallest spelling."""
    x = df.select(gates.reason_key(F.col("reason_text")).alias("reason"), "reason_text").where("reason <> ''")
    return x.groupBy("reason").agg(F.count("*").alias("n"), F.min("reason_text").alias("label")).orderBy(F.desc("n"), "reason").limit(most)


def breakdown(df: DataFrame) -> DataFrame:
    """(category, admitted, rejected, reject_rate) of (category, decision)."""
    a = df.where("decision <> 'reject'").groupBy("category").agg(F.count("*").alias("admitted"))
    r = df.where("decision = 'reject'").groupBy("category").agg(F.count("*").alias("rejected"))
    x = a.join(r, "category", "full").na.fill(0, ["admitted", "rejected"])
    return x.withColumn("reject_rate", F.round(F.col("rejected") / (F.col("admitted") + F.col("rejected")), 6))


def windows(df: DataFrame, at: str, as_of_ms: int) -> DataFrame:
    """(last_24h, last_7d, total) in one pass."""
    since = lambda ms: F.coalesce(F.sum((F.col(at) >= as_of_ms - ms).cast("long")), F.lit(0))
    return df.agg(since(86_400_000).alias("last_24h"), since(7 * 86_400_000).alias("last_7d"), F.count("*").alias("total"))


def rouge_l(a: list[str], b: list[str]) -> float:
    """F1 of the longest common subsequence of two token lists."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    p, r = row[-1] / len(a), row[-1] / len(b)
    return 2 * p * r / (p + r) if p + r else 0.0


def tokens(c: Column) -> Column:
    """Han characters one by one, other letters and digits in runs, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


def support_spans(c: Column) -> Column:
    """The distinct lines of a conversation and their sentences of four characters and more."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n+"), lambda x: T.trim(x)), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.filter(F.transform(F.split(x, "[。！？!?]+"), lambda y: T.trim(y)), lambda y: F.length(y) >= 4)))
    return F.array_distinct(F.concat(lines, parts))


def supported(df: DataFrame, id_col: str, candidate: str, conversation: str) -> DataFrame:
    """(id, best_support, coverage, confidence): how far a conversation supports a candidate.

    The best ROUGE-L of a line or sentence, the share of the candidate's tokens that occur at all, and
    0.7 x best + 0.3 x coverage - 0.25 x the rest within 0..1. Candidates without a token score 0."""
    kind = df.schema[id_col].dataType.simpleString()
    x = df.select(F.col(id_col).alias("id"), tokens(F.col(candidate)).alias("c"), F.transform(support_spans(F.col(conversation)), lambda s: tokens(s)).alias("spans"), F.array_distinct(tokens(F.col(conversation))).alias("all"))
    share = F.size(F.array_intersect(F.array_distinct("c"), "all")) / F.size(F.array_distinct("c"))
    x = x.withColumn("coverage", F.when(F.size("c") > 0, share).otherwise(0.0))

    def best(batches):
        for batch in batches:
            out = [max((rouge_l(c, s) for s in spans), default=0.0) for c, spans in zip(batch.column("c").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("coverage"), batch.column("empty"), pa.array(out, pa.float64())], names=["id", "coverage", "empty", "best_support"])

    y = x.select("id", "coverage", (F.size("c") == 0).alias("empty"), "c", "spans").mapInArrow(best, f"id {kind}, coverage double, empty boolean, best_support double")
    raw = F.col("best_support") * 0.7 + F.col("coverage") * 0.3 - (1 - F.col("coverage")) * 0.25
    return y.select("id", F.round("best_support", 9).alias("best_support"), F.round("coverage", 9).alias("coverage"), F.round(F.when(F.col("empty"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))), 9).alias("confidence"))


def novelty(pool: DataFrame) -> DataFrame:
    """(query_id, novelty, matched) of (query_id, id, cosine): 1 - the largest cosine, and the ids of 0.55 and more."""
    return pool.groupBy("query_id").agg(F.round(1 - F.max(F.greatest(F.col("cosine"), F.lit(0.0))), 9).alias("novelty"), F.array_sort(F.collect_list(F.when(F.col("cosine") >= 0.55, F.col("id")))).alias("matched"))


def evaluated(candidates: DataFrame, support: DataFrame, pool: DataFrame, memories: DataFrame, as_of_ms: int, preset: str = "balanced") -> DataFrame:
    """(query_id, score, decision, hint) of candidates (query_id, category, utility).

    support: of ``supported``; pool: (query_id, id, cosine); the recency gap is that of the newest row in the pool."""
    half_life = PRESETS[preset][3]
    newest = pool.join(memories.select("id", "timestamp_ms"), "id").groupBy("query_id").agg(F.max("timestamp_ms").alias("newest"))
    x = candidates.join(support.withColumnRenamed("id", "query_id"), "query_id", "left").join(novelty(pool), "query_id", "left").join(newest, "query_id", "left")
    gap = F.when(F.col("newest") > 0, F.greatest(F.lit(0.0), (F.lit(as_of_ms) - F.col("newest")) / F.lit(86_400_000.0)))
    s = score(F.col("utility"), F.coalesce("confidence", F.lit(0.0)), F.coalesce("novelty", F.lit(1.0)), recency_gap(gap, half_life), F.col("category"))
    x = x.withColumn("score", F.round(s, 9)).withColumn("decision", decision(F.col("score"), preset))
    hint = F.when((F.col("decision") == "pass_to_dedup") & (F.size(F.coalesce("matched", F.array().cast("array<string>"))) > 0), "update_or_merge").when(F.col("decision") == "pass_to_dedup", "add")
    return x.select("query_id", "score", "decision", hint.alias("hint"))


def rejection_stats(audit: DataFrame) -> DataFrame:
    """(dimension, key, n) of rejections (category, scope, reason_text): in all, by category, by scope, and the five most
    frequent normalised reasons."""
    by = lambda d, c: audit.groupBy(F.coalesce(c, F.lit("unknown")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(d).alias("dimension"), "key", "n")
    total = audit.agg(F.count("*").alias("n")).select(F.lit("total").alias("dimension"), F.lit("all").alias("key"), "n")
    top = rejections(audit).select(F.lit("reason").alias("dimension"), F.col("reason").alias("key"), "n")
    return total.unionByName(by("category", F.col("category"))).unionByName(by("scope", F.col("scope"))).unionByName(top)


def summary(audit: DataFrame, admitted: DataFrame, at: str, as_of_ms: int) -> DataFrame:
    """(last_24h, last_7d, rejected, admitted, reject_rate, observed_from) of both audits, each with a time column ``at``."""
    r = windows(audit, at, as_of_ms).withColumnRenamed("total", "rejected")
    a = admitted.agg(F.count("*").alias("admitted"), F.min(at).alias("a0")).crossJoin(F.broadcast(audit.agg(F.min(at).alias("r0"))))  # one row each
    x = r.crossJoin(F.broadcast(a))
    all_ = F.col("rejected") + F.col("admitted")
    return x.select("last_24h", "last_7d", "rejected", "admitted", F.round(F.when(all_ > 0, F.col("rejected") / all_), 6).alias("reject_rate"), F.least("a0", "r0").alias("observed_from"))
