"""Lifecycle of memories: decay scores, tiers, stale rows, and the access patch of a recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import scores as S
from loam.functions import text as T


def decay(rows: DataFrame, as_of_ms: int) -> DataFrame:
    """Normalised rows with recency, frequency, intrinsic and composite scores, and the next tier."""
    importance = S.clamp01(F.col("importance"), 0.7)
    created = F.when(F.col("timestamp_ms") > 0, F.col("timestamp_ms")).otherwise(F.lit(as_of_ms))
    last = F.when(F.col("access_count") > 0, F.col("last_accessed_at")).otherwise(created)
    days = F.greatest(F.lit(0.0), (F.lit(as_of_ms) - last) / F.lit(S.DAY))
    span = F.greatest(F.lit(0.0), (F.col("last_accessed_at") - created) / F.lit(S.DAY))
    x = rows.withColumn("recency", S.weibull_recency(importance, days, F.col("tier")))
    x = x.withColumn("frequency", S.frequency(F.col("access_count"), span)).withColumn("intrinsic", importance * F.col("confidence"))
    x = x.withColumn("composite", S.composite(F.col("recency"), F.col("frequency"), F.col("intrinsic")))
    age = (F.lit(as_of_ms) - created) / F.lit(S.DAY)
    return x.withColumn("next_tier", S.next_tier(F.col("tier"), F.col("access_count"), F.col("composite"), importance, age)).withColumn("len", T.utf16_len(F.coalesce("text", F.lit(""))))


def stale(rows: DataFrame, least: float = 0.3) -> DataFrame:
    return rows.where(F.col("composite") < least).orderBy("composite", "id")


def accessed(rows: DataFrame, hits: DataFrame, as_of_ms: int) -> DataFrame:
    """The access patch of recalled rows: one more access, now."""
    n = hits.groupBy("id").agg(F.count("*").alias("hits"))
    return rows.join(n, "id").select("id", F.least(F.col("access_count") + F.col("hits"), F.lit(10_000)).alias("access_count"), F.lit(as_of_ms).alias("last_accessed_at"))
