"""Reflections: sections and bullets of a text, slices, and ranking of lines over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import scores as S
from loam.functions import text as T

#: Midpoint in days, slope, weight and quality by kind of line.
DECAY = {"invariant": (45.0, 0.22, 1.1, 1.0), "derived": (7.0, 0.65, 1.0, 0.95)}


def bullets(c: Column) -> Column:
    """The texts of a Markdown text's bullets."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), lambda x: T.trim(x))
    return F.transform(F.filter(lines, lambda x: x.rlike("^[-*]\\s")), lambda x: T.trim(F.substring(x, 2, 1_000_000)))


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, heading, line): bullets with the heading that they stand under; '' before the first one."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\r?\n")).alias("n", "raw")).withColumn("line", T.trim(F.col("raw")))
    w = W.partitionBy("id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("heading", F.coalesce(F.last(F.when(F.col("line").rlike("^##\\s"), F.lower(T.trim(F.substring("line", 3, 1000)))), ignorenulls=True).over(w), F.lit("")))
    return lines.where(F.col("line").rlike("^[-*]\\s")).select("id", "heading", T.trim(F.substring("line", 2, 1_000_000)).alias("line"))


def line_key(c: Column) -> Column:
    return F.lower(T.one_line(c))


def line_quality(n: Column) -> Column:
    return F.when(n <= 0, 0.2).otherwise(F.least(F.lit(1.0), F.least(n, F.lit(6)) * 0.075 + 0.55))


def ranked(lines: DataFrame, as_of_ms: int, kind: str = "derived", limit: int | None = 10, by: list[str] | None = None) -> DataFrame:
    """(*by, key, line, score, at): the scores of equal lines are added, the latest spelling wins; best first.

    lines: (*by, line, at_ms)."""
    by = by or []
    mid, k, weight, quality = DECAY[kind]
    age = F.greatest(F.lit(0.0), S.age_days(F.col("at_ms"), as_of_ms))
    x = lines.withColumn("key", line_key(F.col("line"))).where("key <> ''").withColumn("s", S.reflection_score(age, F.lit(mid), F.lit(k), F.lit(weight), F.lit(quality), F.lit(False)))
    x = x.groupBy(*by, "key").agg(F.round(F.sum("s"), 9).alias("score"), F.max_by("line", F.struct("at_ms", "line")).alias("line"), F.max("at_ms").alias("at"))
    if limit is None:
        return x
    if not by:
        return x.orderBy(F.desc("score"), F.desc("at"), "line").limit(limit)
    return x.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.desc("at"), "line"))).where(F.col("r") <= limit).drop("r")


# Fixed values.
LESSONS, DECISIONS = "Lessons & pitfalls (symptom / cause / fix / prevention)", "Decisions (durable)"
GOVERNANCE = "Learning governance candidates (.learnings / promotion / skill extraction)"
MAPPED = [("User model deltas (about the human)", "user-model", "preference"), ("Agent model deltas (about the assistant/system)", "agent-model", "preference"), (LESSONS, "lesson", "fact"), (DECISIONS, "decision", "decision")]
#: midpoint in days, slope, weight and quality by kind of mapped line; half-life and slope of legacy rows; importance by kind of row
MAPPED_DECAY = {"decision": (45.0, 0.25, 1.1, 1.0), "user-model": (21.0, 0.3, 1.0, 0.95), "agent-model": (10.0, 0.35, 0.95, 0.93), "lesson": (7.0, 0.45, 0.9, 0.9)}
IMPORTANCE = {"event": 0.55, "invariant": 0.82, "derived": 0.78, "legacy": 0.75}
INVARIANT_LIKE = r"(?i)^(always|never|when\b|if\b|before\b|after\b|prefer\b|avoid\b|require\b|only\b|do not\b|must\b|should\b)|\b(must|should|never|always|prefer|avoid|required?)\b"
DERIVED_LIKE = r"(?i)^(this run|next run|going forward|follow-up|re-check|retest|verify|confirm|avoid repeating|adjust|change|update|retry|keep|watch)\b|\b(this run|next run|delta|change|adjust|retry|re-check|retest|verify|confirm|avoid repeating|follow-up)\b"
OPEN_ACTION = r"(?i)^(investigate|verify|confirm|re-check|retest|update|add|remove|fix|avoid|keep|watch|document)\b"
EMPTY_LINES = [r"(?i)^\(none( captured)?\)\z", r"(?i)^(invariants?|reflections?|derived)[:：]\z", r"(?i)apply this session'?s deltas next run", r"(?i)apply this session'?s distilled changes next run", r"(?i)investigate why embedded reflection generation failed"]
UNSAFE_TAG = r"(?i)<\s*/?\s*(?:system|assistant|user|tool|developer|inherited-rules|derived-focus)\b[^>]*>"
TRANSIENT = ["unexpected eof", r"\beconnreset\b", r"\beconnaborted\b", r"\betimedout\b", r"\bepipe\b", "connection reset", "socket hang up", "socket (?:closed|disconnected)", "connection (?:closed|aborted|dropped)", "early close", "stream (?:ended|closed) unexpectedly", "temporar(?:y|ily).*unavailable", "upstream.*unavailable", "service unavailable", "bad gateway", "gateway timeout", r"\b(?:http|status)\s*(?:502|503|504)\b", r"\btimed out\b", r"\btimeout\b", r"\bund_err_(?:socket|headers_timeout|body_timeout)\b", "network error", "fetch failed"]
NOT_RETRIED = [r"\b401\b", r"\bunauthorized\b", "invalid api key", "invalid[_ -]?token", r"\bauth(?:entication)?_?unavailable\b", "insufficient (?:credit|credits|balance)", r"\bbilling\b", r"\bquota exceeded\b", "payment required", "model .*not found", "no such model", "unknown model", "context length", "context window", "request too large", "payload too large", "too many tokens", "token limit", "prompt too long", "session expired", "invalid session", "refusal", "content policy", "safety policy", "content filter", "disallowed"]


def clean_line(c: Column) -> Column:
    return T.trim(F.regexp_replace(F.regexp_replace(c, r"\*\*", ""), r"(?i)^(invariants?|reflections?|derived)[:：]\s*", ""))


def section_lines(text: Column, heading: str, injectable: bool = False) -> Column:
    """The clean bullets below a ``## heading``, in order, without placeholders; ``injectable``: without unsafe ones too."""
    from loam.operators.extract import UNSAFE

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: T.trim(x))
    named = lambda a, b: F.named_struct(F.lit("open"), a, F.lit("out"), b)
    # a fold over the lines carries whether the wanted section is open
    state = F.aggregate(
        lines,
        named(F.lit(False), F.array().cast("array<string>")),
        lambda acc, x: F.when(x.startswith("## "), named(F.lower(T.trim(F.substring(x, 4, 1_000))) == heading.lower(), acc["out"]))
        .when(acc["open"] & (x.startswith("- ") | x.startswith("* ")), named(acc["open"], F.concat(acc["out"], F.array(x))))
        .otherwise(acc),
    )
    found = F.transform(state["out"], lambda x: clean_line(F.substring(x, 3, 1_000_000)))
    bad = [*EMPTY_LINES, *([*UNSAFE, UNSAFE_TAG] if injectable else [])]
    return F.filter(found, lambda x: (x != "") & ~T.any_of(x, bad))


def slices(text: Column, injectable: bool = True) -> Column:
    """struct(invariants, derived): at most 8 rules and 10 changes of a reflection, from their sections, else from the merged
    section, else from durable decisions and open loops."""
    like = lambda lines, p: F.filter(lines, lambda x: x.rlike(T.bounded(p)))
    get = lambda h: section_lines(text, h, injectable)
    merged = get("Invariants & Reflections")
    rules, changes = like(get("Invariants"), INVARIANT_LIKE), like(get("Derived"), DERIVED_LIKE)
    old_rules = like(like(merged, "(?i)invariant|stable|policy|rule"), INVARIANT_LIKE)
    old_changes = like(like(merged, "(?i)reflect|inherit|derive|change|apply"), DERIVED_LIKE)
    loops = like(like(get("Open loops / next actions"), OPEN_ACTION), DERIVED_LIKE)
    first = F.when(F.size(rules) > 0, rules).when(F.size(old_rules) > 0, old_rules).otherwise(like(get(DECISIONS), INVARIANT_LIKE))
    second = F.when(F.size(changes) > 0, changes).otherwise(F.concat(old_changes, loops))
    return F.struct(F.slice(first, 1, 8).alias("invariants"), F.slice(second, 1, 10).alias("derived"))


def mapped(df: DataFrame, id_col: str, text_col: str, injectable: bool = True) -> DataFrame:
    """(id, kind, category, ordinal, group_size, text): the bullets of the four sections that become memories."""
    parts = [F.transform(section_lines(F.col(text_col), h, injectable), lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(cat).alias("category"), i.alias("ordinal"), x.alias("text"))) for h, kind, cat in MAPPED]
    x = df.select(F.col(id_col).alias("id"), F.explode(F.concat(*parts)).alias("m")).select("id", "m.*")
    return x.withColumn("group_size", F.count("*").over(W.partitionBy("id", "kind")).cast("int"))


def governance_entries(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, priority, status, area, summary, details, action) of the ``### Entry`` blocks of the governance section; if it
    has none, its bullets are one entry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    section = F.concat_ws("\n", F.slice(F.split(F.regexp_extract(F.concat(F.lit("\n"), text), rf"(?is)\n## \Q{GOVERNANCE}\E[^\n]*\n(.*?)(?=\n## |\z)", 1), "\n"), 1, 1_000_000))
    block = F.filter(F.split(section, r"(?im)(?=^###\s+Entry\b)"), lambda b: b.rlike(r"(?i)^###\s+Entry\b"))
    x = df.select(F.col(id_col).alias("id"), section_lines(text, GOVERNANCE).alias("bullets"), F.posexplode_outer(block).alias("n", "b"))
    field = lambda k: F.nullif(T.trim(F.regexp_extract("b", rf"(?im)^\*\*{k}\*\*:\s*(.+)$", 1)), F.lit(""))
    part = lambda k: F.nullif(T.trim(F.regexp_extract("b", rf"(?is)\n###\s+{k}\s*\n(.*?)(?=\n###\s+|\z)", 1)), F.lit(""))
    x = x.select("id", F.coalesce("n", F.lit(0)).alias("n"), "bullets", "b", field("Priority").alias("priority"), field("Status").alias("status"), field("Area").alias("area"), part("Summary").alias("summary"), part("Details").alias("details"), part("Suggested Action").alias("action"))
    only = F.col("b").isNull() & (F.size("bullets") > 0)
    x = x.withColumn("summary", F.when(only, "Reflection learning governance candidates").otherwise(F.col("summary"))).where("summary is not null")
    return x.select("id", "n", F.when(only, "medium").otherwise(F.col("priority")).alias("priority"), F.when(only, "pending").otherwise(F.col("status")).alias("status"), F.when(only, "config").otherwise(F.col("area")).alias("area"), "summary", F.when(only, F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("- "), b)), "\n")).otherwise(F.col("details")).alias("details"), "action")


def retry(in_scope: Column, retries: Column, useful_chars: Column, error: Column) -> Column:
    """struct(retryable, reason, error): whether a failed reflection is tried again, once, after a transient failure."""
    e = F.coalesce(error, F.lit(""))
    reason = (
        F.when(~in_scope, "not_reflection_scope").when(retries > 0, "retry_already_used").when(useful_chars > 0, "useful_output_present")
        .when(T.any_of(e, [f"(?i){p}" for p in NOT_RETRIED]), "non_retry_error").when(T.any_of(e, [f"(?i){p}" for p in TRANSIENT]), "transient_upstream_failure").otherwise("non_transient_error")
    )
    line = T.one_line(e)
    return F.struct((reason == "transient_upstream_failure").alias("retryable"), reason.alias("reason"), F.when(F.length(line) <= 260, line).otherwise(F.concat(F.substring(line, 1, 257), F.lit("..."))).alias("error"))


def is_reflection(rows: DataFrame) -> Column:
    return (F.col("category") == "reflection") | F.try_variant_get("extra", "$.type", "string").isin("memory-reflection", "memory-reflection-event", "memory-reflection-item")


def display_tag(rows: DataFrame) -> Column:
    scope = F.coalesce("scope", F.lit("global"))
    return F.when(is_reflection(rows), F.concat(F.lit("reflection:"), scope)).otherwise(F.concat(F.coalesce("category", F.lit("other")), F.lit(":"), scope))


def owned_by(agent: str) -> Column:
    """Reflections without an owner, of the agent, or of the main agent."""
    owner = T.trim(F.coalesce(F.try_variant_get("extra", "$.agentId", "string"), F.lit("")))
    return (owner == "") | (owner == agent) | (owner == "main")


def event_id(at_ms: Column, *parts: Column) -> Column:
    """``refl-YYYYMMDDHHMMSS-`` and eight hexadecimal digits."""
    return F.concat(F.lit("refl-"), F.date_format(F.timestamp_millis(at_ms), "yyyyMMddHHmmss"), F.lit("-"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8))


def stored(df: DataFrame, id_col: str, text_col: str, at_col: str) -> DataFrame:
    """(event_id, kind, ordinal, group_size, text, importance, at_ms): a row for each reflection's event and for each of its
    invariants and derived lines."""
    x = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(at_col).alias("at_ms")).withColumn("event_id", event_id(F.col("at_ms"), F.col("id").cast("string"))).withColumn("s", slices(F.col("t")))
    rows = lambda kind, c: F.transform(c, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("ordinal"), F.size(c).alias("group_size"), v.alias("text")))
    event = F.array(F.struct(F.lit("event").alias("kind"), F.lit(0).alias("ordinal"), F.lit(1).alias("group_size"), F.substring(T.one_line(F.coalesce("t", F.lit(""))), 1, 400).alias("text")))
    x = x.select("event_id", "at_ms", F.explode(F.concat(event, rows("invariant", F.col("s.invariants")), rows("derived", F.col("s.derived")))).alias("r")).select("event_id", "at_ms", "r.*")
    weight = F.create_map(*[v for k, w in IMPORTANCE.items() for v in (F.lit(k), F.lit(w))])
    return x.withColumn("importance", weight[F.col("kind")])


def loaded(items: DataFrame, as_of_ms: int, newest: int = 160) -> DataFrame:
    """(agent, kind, key, line, score, at): the 8 best invariants and 10 best derived lines of each agent, of its newest rows.

    items: (agent, kind, line, at_ms)."""
    x = items.withColumn("r", F.row_number().over(W.partitionBy("agent").orderBy(F.desc("at_ms"), "line"))).where(F.col("r") <= newest).drop("r")
    parts = [ranked(x.where(F.col("kind") == k), as_of_ms, k, n, ["agent", "kind"]) for k, n in (("invariant", 8), ("derived", 10))]
    return parts[0].unionByName(parts[1])


def ranked_mapped(items: DataFrame, as_of_ms: int, most: int = 10) -> DataFrame:
    """(kind, key, line, score, at): mapped lines (kind, line, at_ms), the best of each kind by its own decay."""
    pick = lambda i: F.create_map(*[v for k, d in MAPPED_DECAY.items() for v in (F.lit(k), F.lit(d[i]))])[F.col("kind")]
    age = F.greatest(F.lit(0.0), S.age_days(F.col("at_ms"), as_of_ms))
    x = items.withColumn("key", line_key(F.col("line"))).where(F.col("key") != "").withColumn("s", S.reflection_score(age, pick(0), pick(1), pick(2), pick(3), F.lit(False)))
    x = x.groupBy("kind", "key").agg(F.round(F.sum("s"), 9).alias("score"), F.max_by("line", F.struct("at_ms", "line")).alias("line"), F.max("at_ms").alias("at"))
    return x.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), F.desc("at"), "line"))).where(F.col("r") <= most).drop("r")
