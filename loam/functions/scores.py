"""Score transforms of the ranking chain and of the lifecycle, as column expressions. Times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000.0
BETA = {"core": 0.8, "working": 1.0, "peripheral": 1.3}
FLOOR = {"core": 0.9, "working": 0.7, "peripheral": 0.5}


def clamp01(c: Column, fallback: float = 0.0) -> Column:
    """Within 0..1; nulls and NaN become the fallback."""
    return F.when(c.isNull() | F.isnan(c), F.lit(fallback)).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def age_days(ts: Column, as_of_ms: int) -> Column:
    return (F.lit(float(as_of_ms)) - F.when(ts > 0, ts).otherwise(F.lit(as_of_ms)).cast("double")) / F.lit(DAY)


def vector_score(cosine: Column) -> Column:
    """1 / (1 + distance), the distance being 1 - cosine within 0..2."""
    return 1 / (1 + F.least(F.greatest(1 - cosine, F.lit(0.0)), F.lit(2.0)))


def fuse(vector: Column, bm25: Column, vector_weight: float = 0.7, bm25_weight: float = 0.3) -> Column:
    """Weighted sum with a floor for strong lexical hits; lexical-only rows keep their score."""
    b = F.coalesce(bm25, F.lit(0.0))
    both = F.greatest(vector * vector_weight + b * bm25_weight, F.when(b >= 0.75, b * 0.92).otherwise(F.lit(0.0)))
    return clamp01(F.when(vector.isNull(), b).otherwise(both))


def preservation_floor(bm25: Column, original: Column, returned: bool = True) -> Column:
    high, middle, low = (0.95, 0.9, 0.5) if returned else (1.0, 0.95, 0.8)
    return original * F.when(bm25 >= 0.75, high).when(bm25 >= 0.6, middle).otherwise(low)


def rerank(original: Column, reranked: Column, bm25: Column) -> Column:
    """Mix with a reranker's score; rows it did not return lose a fifth. Never below the preservation floor."""
    kept = F.greatest(preservation_floor(bm25, original), clamp01(reranked) * 0.6 + original * 0.4)
    lost = F.greatest(preservation_floor(bm25, original, False), original * 0.8)
    return F.when(reranked.isNull(), lost).otherwise(kept)


def rerank_cosine(original: Column, cosine: Column) -> Column:
    return F.when(cosine.isNull(), original).otherwise(clamp01(original * 0.7 + cosine * 0.3))


def recency_boost(score: Column, ts: Column, as_of_ms: int, half_life: float = 14.0, weight: float = 0.1) -> Column:
    return clamp01(score + F.exp(-age_days(ts, as_of_ms) / half_life) * weight)


def importance_weight(score: Column, importance: Column) -> Column:
    return clamp01(score * (F.coalesce(importance, F.lit(0.7)) * 0.3 + 0.7))


def length_norm(score: Column, length: Column, anchor: float = 500.0) -> Column:
    return score / (F.log2(F.greatest(length / anchor, F.lit(1.0))) * 0.5 + 1)


def effective_half_life(half_life: float, count: Column, days_since: Column, factor: float = 0.5, most: float = 3.0) -> Column:
    eff = count * F.exp(-days_since * F.lit(0.6931471805599453) / 30.0)
    grown = F.lit(half_life) + F.log1p(eff) * (half_life * factor)
    return F.when(count <= 0, F.lit(half_life)).otherwise(F.least(F.lit(half_life * most), grown))


def time_decay(score: Column, age: Column, half_life: Column) -> Column:
    return score * (F.exp(-age / half_life) * 0.5 + 0.5)


def _by_tier(tier: Column, values: dict[str, float]) -> Column:
    return F.when(tier == "core", values["core"]).when(tier == "peripheral", values["peripheral"]).otherwise(values["working"])


def weibull_recency(importance: Column, days: Column, tier: Column) -> Column:
    lam = F.lit(0.6931471805599453) / (F.exp(importance * 1.5) * 30.0)
    return F.exp(-lam * F.pow(days, _by_tier(tier, BETA)))


def frequency(count: Column, span_days: Column) -> Column:
    base = 1 - F.exp(-count / 5.0)
    gap = F.greatest(F.lit(1.0), span_days) / F.greatest(count - 1, F.lit(1))
    return F.when(count > 1, base * (F.exp(-gap / 30.0) * 0.5 + 0.5)).otherwise(base)


def composite(recency: Column, freq: Column, intrinsic: Column) -> Column:
    return recency * 0.4 + freq * 0.3 + intrinsic * 0.3


def decay_boost(score: Column, comp: Column, tier: Column) -> Column:
    lifted = F.greatest(_by_tier(tier, FLOOR), comp)
    return score * F.least(F.greatest(lifted * 0.7 + 0.3, F.lit(0.3)), F.lit(1.0))


def next_tier(tier: Column, count: Column, comp: Column, importance: Column, age: Column) -> Column:
    """Promotion is tested before demotion."""
    return (
        F.when((tier == "peripheral") & (count >= 3) & (comp >= 0.4), "working")
        .when((tier == "working") & (count >= 10) & (comp >= 0.7) & (importance >= 0.8), "core")
        .when((tier == "working") & ((comp < 0.15) | ((age > 60) & (count < 3))), "peripheral")
        .when((tier == "core") & (comp < 0.15) & (count < 3), "working")
        .otherwise(tier)
    )


def reflection_score(age: Column, midpoint: Column, k: Column, weight: Column, quality: Column, fallback: Column) -> Column:
    return weight * quality * F.when(fallback, 0.75).otherwise(1.0) / (F.exp(k * (age - midpoint)) + 1)
