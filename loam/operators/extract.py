"""What texts mention: artifacts, tags, brands and preferences, names and forms of address; capture clean-up; slices of reflections; search in whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T

# Fixed values.
URL = r"(?i)https?://[^\s<>'\"\])}，。；、]+"
REPOSITORY = r"(?i)https?://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)(?:/(issues|pull|pulls|commit|releases/tag)/([^\s<>'\"\])}，。；、]+))?"
SHORTHAND = r"(?:^|[^A-Za-z0-9_.-])([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#[0-9]+)"
TRAILING = r"[.,;:!?。！？、，；：)\]}）]+\z"
TAG = r"(?i)(?:proj|env|team|scope):[A-Za-z0-9_-]+"
ATTACHMENT_LINE = r"(?i)^\[Image attached at:\s*.*\]\s*\z|^\[inline image/[^\]]*data omitted\]\s*\z|^\[screenshot\]\s*\z"
ATTACHMENT_INLINE = r"(?i)\[Image attached at:\s*[^\]]*\]|\[inline image/[^\]]*data omitted\]|\[screenshot\]|(?<![^\s\]])[^\s\]]*[/\\]image_cache[/\\]img_[A-Za-z0-9_-]+\.(?:jpe?g|png|webp|gif)"
LIKES = r"(?i)(?:^|\W)(?:i|user)?\s*(?:really\s+|still\s+|also\s+)?(?:like|love|prefer|enjoy)\s+([a-z0-9'&\-\s]{1,80})\s+from\s+([a-z0-9'&\-\s]{1,40})"
NAME = [r"(?i)calls?\s+themselves\s+['\"]([^'\"]+)['\"]", r"(?i)name\s+is\s+['\"]?([^'\".,\n]+)['\"]?"]
ADDRESSED = [r"(?i)(?:被称呼为|称呼偏好(?:是)?|Preferred address(?: is)?|be addressed as|addressed as)\s*['\"]?([^'\".,\n]+)['\"]?"]
RULE = r"(?i)^(always|never|when\b|if\b|before\b|after\b|prefer\b|avoid\b|require\b|only\b|do not\b|must\b|should\b)|\b(must|should|never|always|prefer|avoid|required?)\b"
DELTA = r"(?i)\b(this run|next run|going forward|delta|change|adjust|retry|re-check|retest|verify|confirm|avoid repeating|follow-up)\b"
PLACEHOLDER = r"(?i)^\(none( captured)?\)\z|^(invariants?|reflections?|derived)[:：]\z"
UNSAFE = [r"(?i)^\s*(?:(?:next|this)\s+run\s+)?(?:ignore|disregard|forget|override|bypass)\b[\s\S]{0,80}\b(?:instructions?|guardrails?|policy|developer|system)\b", r"(?i)\b(?:reveal|print|dump|show|output)\b[\s\S]{0,80}\b(?:system prompt|developer prompt|hidden prompt|hidden instructions?|full prompt|prompt verbatim|secrets?|keys?|tokens?)\b", r"(?i)^(?:system|assistant|user|developer|tool)\s*:"]


def urls(c: Column) -> Column:
    """Distinct URLs without trailing punctuation."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, TRAILING, "")))


def artifacts(df: DataFrame, id_col: str, text_col: str, most: int = 24) -> DataFrame:
    """(id, kind, repo, item, key): repositories, issues, pulls, commits, tags, shorthands and other URLs; each key once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    short = F.regexp_extract_all(text, F.lit(SHORTHAND), F.lit(1))
    x = df.select(F.col(id_col).alias("id"), F.posexplode(F.concat(urls(text), short)).alias("n", "found"))
    part = lambda k: F.regexp_extract("found", REPOSITORY, k)
    x = x.select("id", "n", "found", part(1).alias("owner"), part(2).alias("repo"), part(3).alias("section"), part(4).alias("item"))
    url = F.col("found").rlike("(?i)^https?://")
    kind = F.when(~url, "issue").when(F.col("owner") == "", "url").when(F.col("section") == "issues", "issue").when(F.col("section").isin("pull", "pulls"), "pull").when(F.col("section") == "commit", "commit").when(F.col("section") == "releases/tag", "release").otherwise("repo")
    repo = F.when(~url, F.substring_index("found", "#", 1)).when(F.col("owner") != "", F.concat_ws("/", "owner", "repo"))
    item = F.when(~url, F.substring_index("found", "#", -1)).when(kind == "url", F.col("found")).otherwise(F.col("item"))
    x = x.select("id", "n", kind.alias("kind"), repo.alias("repo"), item.alias("item"))
    x = x.withColumn("key", F.lower(F.concat_ws(":", "kind", F.coalesce("repo", F.lit("")), F.coalesce("item", F.lit("")))))
    x = x.groupBy("id", "key").agg(F.min_by(F.struct("kind", "repo", "item"), "n").alias("a"), F.min("n").alias("n"))
    from loam.operators.memory import keep_newest

    return keep_newest(x.withColumn("before", -F.col("n")), "id", most, "before").select("id", "a.kind", "a.repo", "a.item", "key")


def tags(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TAG), F.lit(0)), lambda t: F.lower(t)))


def holds_tags(text: Column, tokens: Column) -> Column:
    return F.forall(tokens, lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t))


def sanitized(c: Column) -> Column:
    """Text for capture: without attachment lines and markers, blanks collapsed, at most one empty line in a row."""
    lines = F.filter(F.split(T.trim(F.coalesce(c, F.lit(""))), "\r?\n"), lambda x: ~T.trim(x).rlike(ATTACHMENT_LINE))
    lines = F.transform(lines, lambda x: T.trim(F.regexp_replace(F.regexp_replace(x, ATTACHMENT_INLINE, ""), "[ \t]{2,}", " ")))
    return F.regexp_replace(T.trim(F.array_join(lines, "\n")), "\n{3,}", "\n\n")


def brand_preference(c: Column) -> Column:
    """struct(brand, items) of "likes X from Y"; null without one."""
    s = T.one_line(F.coalesce(c, F.lit("")))
    token = lambda x: F.lower(F.regexp_replace(F.regexp_replace(T.trim(x), r"(?i)\b(?:the|a|an)\s+", ""), r"\s+", ""))
    raw = F.regexp_extract(s, LIKES, 1)
    items = F.filter(F.transform(F.split(F.split(raw, r"(?i)\s(?:if|when|because|but)\s")[0], r"(?i),|/| and | & "), token), lambda x: x != "")
    return F.when(raw != "", F.struct(token(F.regexp_extract(s, LIKES, 2)).alias("brand"), items.alias("items")))


def identity(c: Column) -> Column:
    """struct(name, addressed): what a text says a person is called."""
    first = lambda patterns: F.coalesce(*[F.nullif(T.trim(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1)), F.lit("")) for p in patterns])
    return F.struct(first(NAME).alias("name"), first(ADDRESSED).alias("addressed"))


def slices(lines: DataFrame) -> DataFrame:
    """(id, kind, line): lines of (id, line) that state a rule (invariant) or a change (derived), without unsafe ones."""
    line = T.trim(F.regexp_replace(F.regexp_replace("line", r"\*\*", ""), r"(?i)^(invariants?|reflections?|derived)[:：]\s*", ""))
    x = lines.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").rlike(PLACEHOLDER) & ~T.any_of(F.col("line"), UNSAFE))
    kind = F.when(F.col("line").rlike(DELTA), "derived").when(F.col("line").rlike(RULE), "invariant")
    return x.select("id", kind.alias("kind"), "line").where("kind is not null")


def search_files(files: DataFrame, query: str, limit: int = 8, least: float = 0.15, radius: int = 180) -> DataFrame:
    """(path, score, start_line, snippet) of (path, text): 0.1 + 0.35 for the whole query + up to 0.55 for its terms."""
    q = query.strip().lower()
    terms = q.split()
    hay = F.lower(F.coalesce("text", F.lit("")))
    at = [F.nullif(F.instr(hay, t), F.lit(0)) for t in [q, *terms]]
    hits = sum((a.isNotNull().cast("int") for a in at[1:]), F.lit(0))
    share = hits / float(max(1, len(terms)))
    score = F.least(F.lit(0.99), F.when(at[0].isNotNull(), 0.35).otherwise(0.0) + F.least(F.lit(0.55), share) + 0.1)
    first = F.least(*at) if len(at) > 1 else at[0]
    x = files.withColumn("score", F.round(score, 6)).withColumn("at", first).where((F.col("score") >= least) & F.col("at").isNotNull())
    start = F.greatest(F.lit(1), F.col("at") - radius)
    x = x.withColumn("start_line", F.size(F.split(F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(0), start - 1)), "\n"))).withColumn("snippet", T.trim(F.substring(F.col("text"), start, F.lit(2 * radius))))
    return x.orderBy(F.desc("score"), "path").limit(max(1, min(20, limit))).select("path", "score", "start_line", "snippet")
