"""The memory table: its canonical view with normalised metadata, scans, predicates and statistics.

Metadata that is missing, not JSON or no object counts as empty. Everything is a column expression; the JSON is parsed
once, to a variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import text as T

AS_OF_MS = 1_712_000_000_000
COLUMNS = ["id", "text", "category", "scope", "importance", "timestamp_ms", "metadata"]


def entries(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Each memory once: re-delivered rows are exact copies."""
    return spark.read.parquet(f"{sf_dir}/memory_entries.parquet").select(columns or COLUMNS).dropDuplicates(["id"])


def _one_of(c: Column, values: list[str], fallback: str) -> Column:
    return F.when(c.isin(values), c).otherwise(F.lit(fallback))


def normalised(df: DataFrame, as_of_ms: int = AS_OF_MS) -> DataFrame:
    """``df`` with the normalised metadata fields as columns; unknown keys stay in ``extra`` (a variant)."""
    v = F.try_parse_json("metadata")
    df = df.withColumn("extra", v)
    get = lambda key, kind="string": F.try_variant_get("extra", f"$.{key}", kind)
    text, lower_ok = F.coalesce("text", F.lit("")), r"(?i)(?:^|\W)(?:my |i am |i'm |name is )"
    mapped = (
        F.when(F.col("category") == "preference", "preferences")
        .when(F.col("category") == "entity", "entities")
        .when(F.col("category") == "decision", "events")
        .when((F.col("category") == "fact") & text.rlike(lower_ok) & (T.utf16_len(text) < 200), "profile")
        .when(F.col("category") == "fact", "cases")
        .otherwise("patterns")
    )
    kind = get("type")
    fallback = F.when(kind == "session-summary", "session-summary").when(kind.isin("memory-reflection", "memory-reflection-item"), "reflection").otherwise("legacy")
    source = _one_of(F.coalesce(get("source"), fallback), ["manual", "auto-capture", "reflection", "session-summary", "legacy"], "legacy")
    df = df.withColumn("source", source)
    df = df.withColumn("state", _one_of(F.coalesce(get("state"), F.when(F.col("source") == "session-summary", "archived").otherwise("confirmed")), ["pending", "confirmed", "archived", "rejected"], "confirmed"))
    layer = (
        F.when(F.col("source").isin("reflection", "session-summary"), "reflection")
        .when(F.col("state").isin("archived", "rejected"), "archive")
        .when(mapped.isin("profile", "preferences", "events"), "durable")
        .otherwise("working")
    )
    confidence = get("confidence", "double")
    return df.select(
        "*",
        F.coalesce(get("l0_abstract"), text).alias("l0"),
        F.coalesce(get("l2_content"), text).alias("l2"),
        F.coalesce(get("memory_category"), mapped).alias("memory_category"),
        _one_of(get("tier"), ["core", "working", "peripheral"], "working").alias("tier"),
        _one_of(F.coalesce(get("memory_layer"), layer), ["durable", "working", "reflection", "archive"], "working").alias("layer"),
        F.when(confidence.isNull(), F.lit(0.7)).otherwise(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))).alias("confidence"),
        F.greatest(F.coalesce(get("access_count", "bigint"), F.lit(0)), F.lit(0)).alias("access_count"),
        F.coalesce(get("last_accessed_at", "bigint"), F.col("timestamp_ms")).alias("last_accessed_at"),
        F.coalesce(get("valid_from", "bigint"), F.col("timestamp_ms")).alias("valid_from"),
        get("invalidated_at", "bigint").alias("invalidated_at"),
        F.lower(F.trim(F.coalesce(get("lifecycle"), F.lit("")))).alias("lifecycle"),
    )


def active_at(as_of_ms: int = AS_OF_MS) -> Column:
    """Whether a normalised row is active."""
    return (
        ~F.col("state").isin("archived", "rejected")
        & (F.col("layer") != "archive")
        & ~F.col("lifecycle").isin("archived", "obsolete", "rejected", "superseded")
        & (F.col("valid_from") <= as_of_ms)
        & F.coalesce((F.col("invalidated_at") > as_of_ms) | (F.col("invalidated_at") == 0), F.lit(True))
    )


def in_scopes(scopes: list[str] | None, column: str = "scope") -> Column:
    """None bypasses the filter, an empty list denies all; rows without a scope are in every list."""
    if scopes is None:
        return F.lit(True)
    scopes = [s for s in scopes if s.strip()]
    return (F.col(column).isin(scopes) | F.col(column).isNull()) if scopes else F.lit(False)


def listed(df: DataFrame, scopes: list[str] | None = None, category: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; ids break ties."""
    df = df.where(in_scopes(scopes))
    if category:
        df = df.where(F.col("category") == category)
    return df.orderBy(F.desc("timestamp_ms"), "id").offset(min(offset, 1_000_000)).limit(min(limit, 10_000))


def by_prefix(df: DataFrame, prefix: str, most: int = 50) -> DataFrame:
    """Rows whose id begins with at least eight hexadecimal digits."""
    return df.where(F.col("id").startswith(prefix)).orderBy("id").limit(most)


def stats(df: DataFrame) -> DataFrame:
    """(dimension, key, n): totals by scope, by category and over all, in one pass."""
    df = df.select(F.coalesce("scope", F.lit("global")).alias("scope"), F.coalesce("category", F.lit("other")).alias("category"))
    out = df.groupingSets([[F.col("scope")], [F.col("category")], []], "scope", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g") == 1, "scope").when(F.col("g") == 2, "category").otherwise("total").alias("dimension"), F.coalesce("scope", "category", F.lit("all")).alias("key"), "n")


def scope_type(c: Column) -> Column:
    """Reflection scopes count as users'."""
    return F.when(c == "global", "global").when(c.startswith("agent:"), "agent").when(c.startswith("custom:"), "custom").when(c.startswith("project:"), "project").when(c.startswith("user:") | c.startswith("reflection:"), "user").otherwise("other")


def search_text(df: DataFrame) -> Column:
    """The non-blank metadata texts, one a line; metadata that is no object is its own search text."""
    return _joined(("l0_abstract", "l1_overview", "l2_content", "keywords", "entities", "tags", "category", "tier"))


def hygiene_text(df: DataFrame) -> Column:
    """The search text of the hygiene migration, which has the state and the layer too."""
    return _joined(("l0_abstract", "l1_overview", "l2_content", "keywords", "entities", "tags", "category", "memory_category", "tier", "state", "memory_layer"))


def _joined(keys: tuple[str, ...]) -> Column:
    one = lambda k: F.coalesce(F.try_variant_get("extra", f"$.{k}", "array<string>"), F.array(F.try_variant_get("extra", f"$.{k}", "string")))
    texts = F.filter(F.flatten(F.array(*[one(k) for k in keys])), lambda x: T.trim(F.coalesce(x, F.lit(""))) != "")
    return F.when(F.col("extra").isNull(), F.coalesce("metadata", F.lit(""))).otherwise(F.array_join(texts, "\n"))


def fact_key(category: Column, abstract: Column) -> Column:
    topic = T.trim(abstract)
    colon, arrow = F.regexp_extract(topic, "^(.{1,120}?)[：:]", 1), F.regexp_extract(topic, r"^(.{1,120}?)(?:\s*->|\s*=>)", 1)
    topic = F.when(colon != "", colon).when(arrow != "", arrow).otherwise(topic)
    clean = T.trim(F.regexp_replace(F.regexp_replace(F.lower(topic), r"\s+", " "), r"[。.!?]+\z", ""))
    return F.when(category.isin("preferences", "entities") & (clean != ""), F.concat(category, F.lit(":"), clean))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(id, canonical_id): rows whose normalised text another row of the scope has; the newest row is canonical.

    A text may be that of a third of all rows, so the newest is found by an aggregation with partial results on either
    side of the shuffle, and joined back."""
    df = df.select("id", F.coalesce("scope", F.lit("global")).alias("scope"), T.one_line(F.lower(F.coalesce("text", F.lit("")))).alias("key"), F.coalesce("timestamp_ms", F.lit(0)).alias("ts")).where("key <> ''")
    best = df.groupBy("scope", "key").agg(F.min(F.struct((-F.col("ts")).alias("neg"), "id")).alias("b"), F.count("*").alias("n")).where("n > 1")
    return df.join(best, ["scope", "key"]).where("id <> b.id").select("id", F.col("b.id").alias("canonical_id"))


def drift(truth: DataFrame, vectors: DataFrame) -> DataFrame:
    """(truth, vectors, missing, stale): ids without a vector, and vectors without a row, by one full join."""
    t, v = truth.select("id").distinct().withColumn("t", F.lit(1)), vectors.select("id").distinct().withColumn("v", F.lit(1))
    both = t.join(v, "id", "full")
    return both.agg(F.count("t").alias("n_truth"), F.count("v").alias("n_vectors"), F.count(F.when(F.col("v").isNull(), 1)).alias("missing"), F.count(F.when(F.col("t").isNull(), 1)).alias("stale"))


def latest_versions(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each key, by an aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def superseded(df: DataFrame) -> DataFrame:
    """(id, target_id, type): relation edges of the metadata."""
    rel = F.expr("try_variant_get(extra, '$.relations', 'array<struct<type string, targetId string>>')")
    return df.select("id", F.explode(rel).alias("r")).select("id", F.col("r.targetId").alias("target_id"), F.col("r.type").alias("type")).where("target_id is not null").distinct()


def keep_newest(df: DataFrame, key: str, n: int, order: str) -> DataFrame:
    return df.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), "id"))).where(F.col("r") <= n)
