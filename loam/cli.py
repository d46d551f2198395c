"""The command line's verbs as functions over a memory table and its vectors; each gives a DataFrame or writes a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import embedding, governance, memory, retrieval, search, writes
from loam.sources import io

VERSION = "0.2.0"


def list_(memories: DataFrame, scopes: list[str] | None = None, category: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    return memory.listed(memories, scopes, category, limit, offset).select("id", "category", "scope", F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd").alias("day"), F.substring("text", 1, 100).alias("text"))


def search_(memories: DataFrame, query: str, scopes: list[str] | None = None, limit: int = 10, as_of_ms: int = memory.AS_OF_MS) -> DataFrame:
    """The simple profile, without the lifecycle's scores."""
    rows = memory.normalised(memories, as_of_ms)
    q = memories.sparkSession.createDataFrame([("q", query)], "query_id string, query string")
    return search.simple_chain(retrieval.bm25_arm(memories, q, limit, retrieval.allowed_ids(rows, scopes, as_of_ms)), rows, as_of_ms, limit).select("id", "rank", "score")


def stats(memories: DataFrame) -> DataFrame:
    return memory.stats(memories)


def doctor(memories: DataFrame, vectors: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(check, severity, detail) of every issue: missing and stale vectors and index rows, repeated ids, unequal scopes,
    rows without a scope."""
    scopes = lambda df: df.groupBy(F.coalesce("scope", F.lit("global")).alias("scope")).agg(F.countDistinct("id").alias("n"))
    d = memory.drift(memories, vectors)
    text = lambda c, t: F.concat(c.cast("string"), F.lit(t))
    issues = [F.when(F.col("missing") > 0, F.struct(F.lit("vectors").alias("check"), F.lit("error").alias("severity"), text(F.col("missing"), " rows without a vector").alias("detail"))), F.when(F.col("stale") > 0, F.struct(F.lit("vectors").alias("check"), F.lit("error").alias("severity"), text(F.col("stale"), " vectors without a row").alias("detail")))]
    out = d.select(F.explode(F.array_compact(F.array(*issues))).alias("i")).select("i.*")
    if "scope" not in vectors.columns:
        vectors = vectors.join(memories.select("id", "scope"), "id", "left")
    both = scopes(memories).withColumnRenamed("n", "t").join(scopes(vectors).withColumnRenamed("n", "v"), "scope", "full").where(~F.col("t").eqNullSafe(F.col("v")))
    out = out.unionByName(both.select(F.lit("scopes").alias("check"), F.lit("warning").alias("severity"), F.concat("scope", F.lit(": "), F.coalesce("t", F.lit(0)).cast("string"), F.lit(" rows, "), F.coalesce("v", F.lit(0)).cast("string"), F.lit(" vectors")).alias("detail")))
    blank = memories.agg(F.count(F.when(F.trim(F.coalesce("scope", F.lit(""))) == "", 1)).alias("n")).where("n > 0")
    out = out.unionByName(blank.select(F.lit("scopes").alias("check"), F.lit("warning").alias("severity"), text(F.col("n"), " rows without a scope").alias("detail")))
    r = retrieval.index_report(memories, index if index is not None else memories).where("not healthy")
    return out.unionByName(r.select(F.lit("index").alias("check"), F.lit("error").alias("severity"), F.concat_ws(", ", text(F.col("missing"), " missing"), text(F.col("stale"), " stale"), text(F.col("extra"), " extra")).alias("detail")))


def repair_vectors(memories: DataFrame, vectors: DataFrame, limit: int | None = None, dry_run: bool = False, embedder=embedding.local):
    return embedding.repaired(memories, vectors, embedder, limit, dry_run)


def delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return io.delete(memories, ids)


def delete_bulk(memories: DataFrame, scopes: list[str] | None = None, before_ms: int | None = None, dry_run: bool = False):
    """(the memories left, what is or would be deleted)."""
    left, gone = writes.bulk_delete(memories, scopes, before_ms)
    return (memories if dry_run else left), gone


def export(memories: DataFrame, path: str, as_of_ms: int = memory.AS_OF_MS, scopes: list[str] | None = None, category: str | None = None) -> None:
    io.export_envelope(memories, path, as_of_ms, scopes, category)


def import_(spark: SparkSession, path: str, memories: DataFrame) -> DataFrame:
    """The memories with the new rows of an export, which may have an envelope."""
    from loam import scratch

    inner = f"{path}/memories" if "memories" in scratch.names_in(spark, path) else path
    return memories.unionByName(io.import_json(spark, inner, memories), allowMissingColumns=True)


def reembed(source: DataFrame, vectors: DataFrame, embedder=embedding.local, in_place: bool = False, force: bool = False) -> DataFrame:
    """(id, vec) of the rows of another table that have no vector yet; in the table's own place only by force."""
    if in_place and not force:
        raise ValueError("vectors are replaced in place only by force")
    todo = source.select("id", "text") if force else embedding.missing(source, vectors)
    return embedding.embedded(todo, "id", "text", embedder)


def upgrade(memories: DataFrame, as_of_ms: int = memory.AS_OF_MS) -> tuple[DataFrame, DataFrame]:
    """((category, n) of legacy rows, (id, metadata) of them as rewritten)."""
    rows = memory.normalised(memories, as_of_ms)
    return rows.where(writes.is_legacy(rows)).groupBy("category").agg(F.count("*").alias("n")), writes.upgraded(rows, as_of_ms)


def migrate(legacy: DataFrame, memories: DataFrame, scope: str = "global"):
    return io.migrate(legacy, memories, scope)


def reindex(memories: DataFrame) -> DataFrame:
    """(id, token, tf): the postings of the full-text index, made anew."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return memories.select("id", F.explode(words).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def review(memories: DataFrame, as_of_ms: int = memory.AS_OF_MS, limit: int = 200) -> DataFrame:
    return governance.review_candidates(memory.normalised(memories, as_of_ms), governance.conflicts(memories), limit)
