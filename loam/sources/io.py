"""Sources and sinks: exports and imports of memories, backups, audit logs, session transcripts, Markdown trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T

CATEGORIES = ["preference", "fact", "decision", "entity", "reflection", "other"]


def export_json(memories: DataFrame, path: str) -> None:
    """One JSON object a line, without vectors; written in parallel."""
    memories.drop("vector").write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows of an export: texts of two characters and more, known categories, importance within 0..1, new ids only."""
    schema = "id string, text string, category string, scope string, importance double, timestamp_ms bigint, metadata string"
    x = spark.read.schema(schema).json(path).where(F.length(T.trim(F.col("text"))) >= 2)
    x = x.withColumn("category", F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("other"))
    x = x.withColumn("importance", F.least(F.greatest(F.coalesce("importance", F.lit(0.7)), F.lit(0.0)), F.lit(1.0))).withColumn("scope", F.coalesce("scope", F.lit("global")))
    x = x.withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("\x1f", "scope", "category", "text"), 256))).dropDuplicates(["id"])
    return x.join(existing.select("id"), "id", "left_anti") if existing is not None else x


def audit_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and corrupt ones are skipped."""
    x = spark.read.text(path).where(F.trim("value") != "")
    return x.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*").where("_bad is null").drop("_bad")


def transcripts(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """(file, n, role, text): user and assistant messages of session logs; content is a string or an array of text blocks."""
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b")).withColumn("n", F.monotonically_increasing_id())
    v = F.try_parse_json("value")
    x = x.withColumn("v", v).where(F.try_variant_get("v", "$.type", "string") == "message")
    blocks = F.expr("array_join(transform(filter(try_variant_get(v, '$.message.content', 'array<struct<type string, text string>>'), b -> b.type = 'text'), b -> b.text), '\n')")
    x = x.select("file", "n", F.try_variant_get("v", "$.message.role", "string").alias("role"), F.coalesce(blocks, F.try_variant_get("v", "$.message.content", "string")).alias("text")).where(F.col("role").isin("user", "assistant"))
    if last is not None:
        from loam.operators.memory import keep_newest

        x = keep_newest(x.withColumn("id", F.col("n")), "file", last, "n").drop("id", "r")
    return x


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every Markdown file below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def upsert(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``changes`` replace those of the same key; of several changes of a key the last in all columns' order counts."""
    rest = [c for c in changes.columns if c != key]
    changes = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.xxhash64(*rest) if "timestamp_ms" not in rest else F.struct(F.col("timestamp_ms"), F.xxhash64(*rest))).alias("r")).select(key, "r.*").select(changes.columns)
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def export_envelope(memories: DataFrame, path: str, as_of_ms: int, scopes: list[str] | None = None, category: str | None = None, most: int = 1_000) -> None:
    """A folder with ``memories`` (the newest ``most`` of the scopes and category, without vectors) and ``envelope``: version,
    time, count and filters."""
    from loam.operators import memory

    x = memory.listed(memories.drop("vector"), scopes, category, most)
    x.write.mode("overwrite").json(f"{path}/memories")
    head = memories.sparkSession.read.json(f"{path}/memories", schema="id string").agg(F.count("*").alias("count"))
    head.select(F.lit("1.0").alias("version"), F.date_format(F.timestamp_millis(F.lit(as_of_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("exportedAt"), "count", F.struct(F.lit(",".join(scopes) if scopes else None).cast("string").alias("scope"), F.lit(category).cast("string").alias("category")).alias("filters")).write.mode("overwrite").json(f"{path}/envelope")


def new_only(rows: DataFrame, existing: DataFrame, near: DataFrame | None = None, least: float = 0.95) -> DataFrame:
    """Rows whose id is not there; of rows that came without one, those that no stored text is similar to.

    near: (id, score) of the best stored hit of rows without an id of their own."""
    x = rows.join(existing.select("id"), "id", "left_anti")
    return x if near is None else x.join(near.where(F.col("score") > least).select("id").distinct(), "id", "left_anti")


def backup(memories: DataFrame, folder: str, day: str, most: int = 10_000, keep: int = 7) -> list[str]:
    """Writes a day's backup of seven columns and deletes all but the newest ``keep`` days; gives the days left."""
    from loam import scratch
    from loam.operators import memory

    memory.listed(memories.select(*memory.COLUMNS), None, None, most).write.mode("overwrite").json(f"{folder}/day={day}")
    days = [n for n in scratch.names_in(memories.sparkSession, folder) if n.startswith("day=")]
    for old in days[:-keep]:
        scratch.delete(memories.sparkSession, f"{folder}/{old}")
    return days[-keep:]


def append_audit(rejections: DataFrame, path: str) -> None:
    """One redacted record a rejection (category, scope, text, reason_text, at_ms), as JSON lines."""
    from loam.operators import gates

    rejections.withColumn("text", gates.redacted(F.substring("text", 1, 500))).withColumn("reason_text", gates.redacted(F.col("reason_text"))).write.mode("append").json(path)


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """(session, path, is_reset, modified): of each session the newest transcript, or the newest one kept at a reset."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").load(folder).select("path", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    x = x.select(F.regexp_replace(name, r"\.jsonl.*$", "").alias("session"), "path", name.contains(".reset.").alias("is_reset"), "modified")
    best = x.groupBy("session").agg(F.max(F.struct(~F.col("is_reset"), "modified", "path", "is_reset")).alias("b"))
    return best.select("session", "b.path", "b.is_reset", "b.modified")


def session_texts(spark: SparkSession, path: str, last: int = 20) -> DataFrame:
    """(file, text): each session's last user and assistant messages, redacted, as ``role: text`` lines in order."""
    from loam.operators import gates

    x = transcripts(spark, path, last).withColumn("line", F.concat(F.col("role"), F.lit(": "), gates.redacted(F.col("text"))))
    return x.groupBy("file").agg(F.expr("array_join(transform(array_sort(collect_list(struct(n, line))), x -> x.line), '\n')").alias("text"))


def mirror_lines(memories: DataFrame, agent: str, source: str) -> DataFrame:
    """(day, line) for a Markdown mirror: ``- time [category:scope] agent= source= text``, one line, 500 characters."""
    at = F.timestamp_millis(F.coalesce("timestamp_ms", F.lit(0)))
    line = F.concat(F.lit("- "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" ["), F.coalesce("category", F.lit("other")), F.lit(":"), F.coalesce("scope", F.lit("global")), F.lit(f"] agent={agent} source={source} "), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "), 1, 500))
    return memories.select(F.date_format(at, "yyyy-MM-dd").alias("day"), line.alias("line"))


def migrate(legacy: DataFrame, base: DataFrame, scope: str = "global", near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(memories after the migration, report): rows of a legacy table get a scope and are added if they are new.

    report: (n_legacy, n_migrated, n_skipped, complete)."""
    x = legacy.withColumn("scope", F.coalesce("scope", F.lit(scope))).dropDuplicates(["id"])
    new = new_only(x, base, near)
    n = x.agg(F.count("*").alias("n_legacy")).crossJoin(F.broadcast(new.agg(F.count("*").alias("n_migrated"))))  # one row each
    n = n.withColumn("n_skipped", F.col("n_legacy") - F.col("n_migrated")).crossJoin(F.broadcast(x.join(base.select("id").union(new.select("id")), "id", "left_anti").agg((F.count("*") == 0).alias("complete"))))
    return base.unionByName(new, allowMissingColumns=True), n
