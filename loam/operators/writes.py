"""Write paths as transformations: ingest with its gates, decisions applied as a table, supersede, forget, repair plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators import extract, gates, memory
from loam.scratch import written

#: Importance by kind of memory.
IMPORTANCE = {"profile": 0.9, "preferences": 0.8, "entities": 0.7, "events": 0.6, "cases": 0.8, "patterns": 0.85}


def ingested(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``rows`` (id, text, ...) with clean text, detected category and a verdict: 'accepted' or why not.

    Gates in order: those of ``gates.capture_verdict``, noise, an equal text that is stored already. Equal texts
    within the rows are accepted once, for the smallest id."""
    x = rows.withColumn("clean", extract.sanitized(F.col("text"))).withColumn("key", F.sha2(F.lower("clean"), 256))
    verdict = gates.capture_verdict(F.col("clean"))
    x = x.withColumn("verdict", F.when(verdict != "allowed", verdict).when(gates.is_noise(F.col("clean")), "noise").otherwise("accepted"))
    x = written(x, "ingest")  # the gates run once
    first = x.where("verdict = 'accepted'").groupBy("key").agg(F.min("id").alias("first_id"))
    x = x.join(first, "key", "left").withColumn("verdict", F.when((F.col("verdict") == "accepted") & (F.col("id") != F.col("first_id")), "duplicate").otherwise(F.col("verdict")))
    if existing is not None:
        old = existing.select(F.sha2(F.lower(extract.sanitized(F.col("text"))), 256).alias("key"), F.lit(True).alias("old")).distinct()
        x = x.join(old, "key", "left").withColumn("verdict", F.when((F.col("verdict") == "accepted") & F.col("old"), "duplicate").otherwise(F.col("verdict"))).drop("old")
    return x.withColumn("detected", gates.category(F.col("clean"))).drop("key", "first_id")


def decided(base: DataFrame, decisions: DataFrame, as_of_ms: int) -> DataFrame:
    """Memories after decisions (decision, target_id, new_id, text): create and supersede add a row, supersede and
    contradict close the target, merge replaces its text, skip and support leave it."""
    d = decisions.withColumn("destructive", F.col("decision").isin("supersede", "contradict"))
    known = base.select(F.col("id").alias("target_id"), F.lit(True).alias("known"), F.col("scope").alias("t_scope"), F.col("category").alias("t_category")).distinct()
    d = d.join(known, "target_id", "left").withColumn("decision", F.when(F.col("known").isNull() & ~F.col("decision").isin("create", "skip"), "create").otherwise(F.col("decision")))
    closed = d.where("known and destructive").groupBy("target_id").agg(F.max("new_id").alias("by"))
    merged = d.where("known and decision = 'merge'").groupBy("target_id").agg(F.max_by("text", "new_id").alias("new_text"))
    old = base.join(closed.withColumnRenamed("target_id", "id"), "id", "left").join(merged.withColumnRenamed("target_id", "id"), "id", "left")
    old = old.withColumn("text", F.coalesce("new_text", "text")).withColumn("superseded_by", F.col("by")).withColumn("closed_at", F.when(F.col("by").isNotNull(), F.lit(as_of_ms))).drop("by", "new_text")
    added = d.where("decision in ('create', 'supersede')").select(F.col("new_id").alias("id"), "text", F.coalesce("t_scope", F.lit("global")).alias("scope"), F.coalesce("t_category", F.lit("other")).alias("category"), F.lit(as_of_ms).cast("long").alias("timestamp_ms"))
    return old.unionByName(added, allowMissingColumns=True)


def repair_plan(truth: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, action): 'embed' for rows without a vector, 'delete' for vectors without a row."""
    t, v = truth.select("id").distinct(), vectors.select("id").distinct()
    return t.join(v, "id", "left_anti").withColumn("action", F.lit("embed")).unionByName(v.join(t, "id", "left_anti").withColumn("action", F.lit("delete")))


def hygiene(rows: DataFrame) -> DataFrame:
    """(id, action) of normalised rows: scratch is archived, rows without metadata are normalised, the rest is kept."""
    bare = F.try_variant_get("extra", "$.memory_category", "string").isNull()
    scratch = bare & (F.col("category") == "other") & (F.coalesce("importance", F.lit(0.7)) < 0.5)
    return rows.select("id", F.when(scratch, "archive").when(bare, "normalise").otherwise("keep").alias("action"))


def active_only(rows: DataFrame, as_of_ms: int) -> DataFrame:
    return rows.where(memory.active_at(as_of_ms))


def patched(rows: DataFrame, patches: DataFrame, as_of_ms: int) -> DataFrame:
    """(id, metadata) of normalised rows after patches (id, key, value): known keys are normalised, others kept as they are.

    Of several patches of one key the largest value counts. An end before the start is none; the fact key follows the
    category and the abstract unless it is given; counts are within 0..10,000, confidence within 0..1."""
    p = patches.groupBy("id", "key").agg(F.max("value").alias("value")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("p"))
    x = rows.join(p, "id")
    new = lambda k: F.col("p")[k]
    one_of = lambda k, values, old: F.when(new(k).isin(values), new(k)).otherwise(F.col(old))
    count = lambda k, old: F.least(F.lit(10_000), F.greatest(F.lit(0), F.coalesce(new(k).try_cast("bigint"), F.col(old))))
    text = lambda k, old: F.coalesce(F.nullif(F.trim(new(k)), F.lit("")), F.col(old))
    start = F.coalesce(new("valid_from").try_cast("bigint"), F.col("valid_from"))
    end = F.when(F.map_contains_key("p", "invalidated_at"), new("invalidated_at").try_cast("bigint")).otherwise(F.col("invalidated_at"))
    category, abstract = F.coalesce(new("memory_category"), F.col("memory_category")), text("l0_abstract", "l0")
    fields = {
        "l0_abstract": abstract, "l2_content": text("l2_content", "l2"), "memory_category": category, "source": one_of("source", ["manual", "auto-capture", "reflection", "session-summary", "legacy"], "source"),
        "state": one_of("state", ["pending", "confirmed", "archived", "rejected"], "state"), "memory_layer": one_of("memory_layer", ["durable", "working", "reflection", "archive"], "layer"), "tier": one_of("tier", ["core", "working", "peripheral"], "tier"),
        "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(new("confidence").try_cast("double"), F.col("confidence")))), "access_count": count("access_count", "access_count"),
        "last_accessed_at": F.coalesce(new("last_accessed_at").try_cast("bigint"), F.col("last_accessed_at"), F.lit(as_of_ms)), "valid_from": start, "invalidated_at": F.when(end >= start, end),
        "fact_key": F.coalesce(F.nullif(new("fact_key"), F.lit("")), F.try_variant_get("extra", "$.fact_key", "string"), memory.fact_key(category, abstract)),
    }
    known = F.array(*[F.lit(k) for k in fields])
    old = F.coalesce(F.try_variant_get("extra", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rest = F.map_filter(F.transform_values(old, lambda k, v: F.to_json(v)), lambda k, v: ~F.array_contains(known, k))
    own = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    text_of = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
    more = F.map_filter(F.transform_values("p", lambda k, v: text_of(v)), lambda k, v: ~F.array_contains(known, k))
    pairs = F.concat(F.map_entries(F.map_filter(rest, lambda k, v: ~F.map_contains_key("p", k))), F.map_entries(more))
    tail = F.array_join(F.transform(pairs, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return x.select("id", F.when(tail == "", own).otherwise(F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(","), tail, F.lit("}"))).alias("metadata"))


def with_relation(relations: Column, kind: Column, target: Column, most: int = 16) -> Column:
    """An array of (type, targetId) with one more, unless it is there; broken ones go, ``most`` stay."""
    good = F.filter(F.coalesce(relations, F.array().cast("array<struct<type:string,targetId:string>>")), lambda r: r["type"].isNotNull() & r["targetId"].isNotNull())
    there = F.exists(good, lambda r: (r["type"] == kind) & (r["targetId"] == target))
    return F.slice(F.when(there, good).otherwise(F.concat(good, F.array(F.struct(kind.alias("type"), target.alias("targetId"))))), 1, most)


def guarded(decisions: DataFrame) -> DataFrame:
    """Decisions (decision, target_id, new_brand, old_brand, new_items, old_items, ...) after the guards: merges of different
    items of one brand become creations, as do destructive ones without a target."""
    other = F.col("new_brand").isNotNull() & (F.col("new_brand") == F.col("old_brand")) & (F.size(F.array_intersect("new_items", "old_items")) == 0)
    return decisions.withColumn("decision", F.when((F.col("decision") == "merge") & other, "create").when(F.col("decision").isin("supersede", "contradict", "merge", "support", "contextualize") & F.col("target_id").isNull(), "create").otherwise(F.col("decision")))


def support_slices(base: DataFrame, decisions: DataFrame, as_of_ms: int) -> DataFrame:
    """(id, context, confirmations, contradictions, last_observed_at): support of memories after decisions.

    base: such rows; decisions: (decision, target_id, context) with support, contextualize (both confirm) and contradict."""
    d = decisions.where(F.col("decision").isin("support", "contextualize", "contradict") & F.col("target_id").isNotNull())
    no = (F.col("decision") == "contradict").cast("bigint")
    new = d.select(F.col("target_id").alias("id"), F.coalesce(F.lower(F.trim("context")), F.lit("general")).alias("context"), (1 - no).alias("confirmations"), no.alias("contradictions"), F.lit(as_of_ms).cast("bigint").alias("last_observed_at"))
    both = base.select("id", "context", "confirmations", "contradictions", "last_observed_at").unionByName(new)
    return both.groupBy("id", "context").agg(F.sum("confirmations").alias("confirmations"), F.sum("contradictions").alias("contradictions"), F.max("last_observed_at").alias("last_observed_at"))


def profile_targets(profiles: DataFrame, near: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, target_id): the nearest profile memory, of score 0.3 and more, that a new profile text is merged into."""
    hits = near.join(rows.where("memory_category = 'profile'").select("id"), "id", "left_semi").where("score >= 0.3")
    best = hits.groupBy("query_id").agg(F.max_by("id", "score").alias("target_id"))
    return profiles.select("query_id").join(best, "query_id", "left")


def updated(base: DataFrame, changes: DataFrame, as_of_ms: int) -> DataFrame:
    """Memories after manual changes (id, text, new_id): a changed text of a preference or an entity is a new version that
    supersedes the old one; others are changed in place."""
    c = changes.groupBy("id").agg(F.max_by("text", "new_id").alias("text"), F.max("new_id").alias("new_id"))
    versioned = base.where(F.col("category").isin("preference", "entity")).select("id")
    as_new = c.join(versioned, "id", "left_semi").select(F.lit("supersede").alias("decision"), F.col("id").alias("target_id"), "new_id", "text")
    in_place = c.join(versioned, "id", "left_anti").select(F.lit("merge").alias("decision"), F.col("id").alias("target_id"), "new_id", "text")
    known = base.select(F.col("id").alias("target_id")).distinct()
    return decided(base, as_new.unionByName(in_place).join(known, "target_id", "left_semi"), as_of_ms)


def promotion(as_of_ms: int) -> list[tuple[str, str]]:
    """The patch that makes a memory durable; ``archival`` that which puts it away."""
    return [("state", "confirmed"), ("memory_layer", "durable"), ("last_confirmed_use_at", str(as_of_ms)), ("lifecycle", "active")]


def archival(as_of_ms: int) -> list[tuple[str, str]]:
    return [("state", "archived"), ("memory_layer", "archive"), ("invalidated_at", str(as_of_ms)), ("lifecycle", "archived")]


def patches_of(ids: DataFrame, patch: list[tuple[str, str]]) -> DataFrame:
    """(id, key, value): the patch for each id."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in patch])
    return ids.select("id", F.explode(pairs).alias("p")).select("id", "p.*")


def forget(base: DataFrame, ids: DataFrame, confirmed: bool) -> tuple[DataFrame, DataFrame]:
    """(the memories left, what is or would be forgotten); nothing is without a confirmation."""
    gone = base.join(ids.select("id").distinct(), "id", "left_semi")
    return (base.join(ids.select("id").distinct(), "id", "left_anti") if confirmed else base), gone


def bulk_delete(base: DataFrame, scopes: list[str] | None = None, before_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the memories left, those deleted): of the scopes and older than a time; one of both must be given. No scope in the
    list deletes nothing."""
    if scopes is None and before_ms is None:
        raise ValueError("scopes or a time must be given")
    test = (F.lit(True) if scopes is None else F.col("scope").isin(scopes) if scopes else F.lit(False)) & (F.lit(True) if before_ms is None else F.col("timestamp_ms") < before_ms)
    test = F.coalesce(test, F.lit(False))
    return base.where(~test), base.where(test)


def migration_action(rows: DataFrame) -> Column:
    """'archive' for scratch rows without full metadata or of working layers, 'normalise' for durable rows that lack some, else
    'keep'; inactive rows are kept."""
    get = lambda k: F.lower(F.trim(F.coalesce(F.try_variant_get("extra", f"$.{k}", "string"), F.lit(""))))
    inactive = get("state").isin("archived", "rejected") | (get("memory_layer") == "archive") | get("lifecycle").isin("archived", "obsolete", "rejected", "superseded")
    bare = (get("memory_category") == "") | (get("state") == "") | (get("memory_layer") == "")
    scratch = (F.lower(F.trim(F.coalesce("category", F.lit("")))) == "other") & (bare | ((get("memory_layer") == "working") & (get("source").isin("legacy", "auto-capture") | (get("memory_category") == "patterns"))))
    return F.when(inactive, "keep").when(scratch, "archive").when(bare | (get("l0_abstract") == ""), "normalise").otherwise("keep")


def migrated(rows: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame]:
    """(plan, changed): (id, action) of every normalised row, and (id, metadata) of those that the migration rewrites."""
    plan = rows.select("id", migration_action(rows).alias("action"))
    archive = patches_of(plan.where("action = 'archive'"), archival(as_of_ms))
    normal = patches_of(plan.where("action = 'normalise'"), [("migrated_at", str(as_of_ms))])
    return plan, patched(rows, archive.unionByName(normal), as_of_ms)


def is_legacy(rows: DataFrame) -> Column:
    return F.coalesce(F.try_variant_get("extra", "$.memory_category", "string"), F.lit("")) == ""


def upgraded(rows: DataFrame, as_of_ms: int) -> DataFrame:
    """(id, metadata) of legacy rows: the first sentence, of at most 100 characters, is the abstract."""
    from loam.operators.capture import first_sentence

    old = rows.where(is_legacy(rows))
    abstract = old.select("id", F.lit("l0_abstract").alias("key"), first_sentence(F.coalesce("text", F.lit("")), 100).alias("value"))
    return patched(old, abstract.unionByName(patches_of(old, [("upgraded_at", str(as_of_ms))])), as_of_ms)
