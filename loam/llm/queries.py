"""Queries of the training-data problems: every one runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import abuse, clustering, incremental, leaks, mixing, neighbours, pii, splitting, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized entries."""
    return splitting.split_oversized(table(spark, sf_dir, "memory_entries"), table(spark, sf_dir, "stored_chunks"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): oversized entries whose stored pieces are not a valid cut."""
    pieces = splitting.split_oversized(table(spark, sf_dir, "memory_entries"), table(spark, sf_dir, "stored_chunks"), texts=False)
    return pieces.where((F.col("chunk_no") == 0) & ~F.col("stored_valid")).select("id").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, metadata) with typed placeholders."""
    return pii.redacted(table(spark, sf_dir, "memory_entries"), "id", ["text", "metadata"], {"metadata"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, field, kind): fields that hold at least one item of the kind in clear."""
    return pii.items(table(spark, sf_dir, "memory_entries"), "id", ["text", "metadata"], {"metadata"}).select("id", "field", "kind").distinct()


def memory_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, unit): the usable vector of each memory, from its entry or from its newest record of the companion store."""
    entries = vectors.unit_rows(table(spark, sf_dir, "memory_entries"), "vector", ["id", "scope"])
    records = vectors.unit_rows(table(spark, sf_dir, "vector_records"), "vector_json", ["id", "scope", "updated_at"], drop=False)
    newest = records.groupBy("id").agg(F.max_by(F.struct("scope", "unit"), F.coalesce("updated_at", F.lit(float("-inf")))).alias("r"))
    newest = newest.select("id", "r.scope", "r.unit").where("unit is not null")
    return entries.unionByName(newest).select("id", F.col("scope").alias("grp"), "unit")


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, neighbour, cosine): the 5 most similar memories of the same scope."""
    return neighbours.nearest(memory_vectors(spark, sf_dir), 5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): pairs of cosine >= 0.9 of which one is among the 5 most similar of the other."""
    near = p3_neighbours(spark, sf_dir).where(F.col("cosine") >= 0.9)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cand_id, kept_id): kept_id is null for an accepted candidate."""
    found = incremental.replay(table(spark, sf_dir, "dedup_candidates"))
    return found.select(F.col("id").alias("cand_id"), "kept_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kept_id, cand_id): each duplicate with the smallest accepted candidate that it duplicates."""
    return p4_verdicts(spark, sf_dir).where("kept_id is not null").select("kept_id", "cand_id").distinct()


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.unit_rows(table(spark, sf_dir, "compaction_entries"), "vector", ["id", "scope"])
    return clustering.clusters(rows.select("id", F.col("scope").alias("grp"), "unit"))


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, scope, size, n_markov, typical): each cluster with its size and its three most typical members."""
    return clustering.described(_clusters(spark, sf_dir)).withColumnRenamed("grp", "scope")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): each member of a cluster but the smallest, with the smallest."""
    found = _clusters(spark, sf_dir).where(F.col("id") != F.col("cluster"))
    return found.select(F.col("cluster").alias("id_a"), F.col("id").alias("id_b")).distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, run_words, item_words, score, share): literal and edited copies of items in documents."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where((F.col("share") >= 0.5) | (F.col("run_words") >= F.least(F.lit(leaks.RUN), "item_words"))).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): the document holds 12 consecutive words of the item, or the whole item if it has fewer."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    # 12 words in a row score 24 in any alignment; what scores less holds none
    aligned = found.where(F.col("score") >= leaks.MATCH * F.least(F.lit(leaks.RUN), "item_words"))
    return aligned.where(F.col("run_words") >= F.least(F.lit(leaks.RUN), "item_words")).select("doc_id", "item_id").distinct()


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, shard, block, n_tokens, repeats): the documents of the mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and actual share."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, abusive, hateful, explicit, score) of every document."""
    return abuse.scores(table(spark, sf_dir, "documents"), keep=("source",), ratings=table(spark, sf_dir, "toxicity_labels"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of abusive, hateful and explicit documents per source."""
    return abuse.source_rates(p9_scores(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents whose score reaches the threshold."""
    return abuse.scores(table(spark, sf_dir, "documents"), ratings=table(spark, sf_dir, "toxicity_labels")).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
