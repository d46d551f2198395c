"""Conflicts, review candidates, support statistics and versions of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.scratch import written

#: Fixed values.
STOPWORDS = ["a", "an", "and", "are", "as", "be", "by", "current", "for", "in", "is", "it", "of", "on", "or", "the", "to", "with", "does", "do", "not", "no", "longer", "never"]
CLAIM = r"(?i)^\s*(.+?)\s+(is\s+not|are\s+not|was\s+not|were\s+not|does\s+not\s+use|do\s+not\s+use|doesn't\s+use|don't\s+use|no\s+longer\s+uses?|is|are|was|were|uses?|prefers?|likes?|wants?)\s+(.+?)\s*[.!?。！？]?\s*\z"
NEGATION = r"(?i)\b(no longer|not|never|doesn't|don't|does not|do not|不再|不要|不是|取消|avoid|stop)\b"


def claim_text(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[`\"'“”‘’]", "")
    return T.trim(F.regexp_replace(T.one_line(s), r"[。.!?；;，,]+\z", ""))


def claim_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(claim_text(c), F.lit(r"[a-zA-Z0-9_./:-]{2,}|[一-鿿]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(STOPWORDS)))


def similarity(a: Column, b: Column) -> Column:
    """The largest share that two token sets have in common, of either or of both."""
    shared, x, y = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.when((x == 0) | (y == 0), 0.0).otherwise(F.greatest(shared / x, shared / y, shared / (x + y - shared)))


#: Fixed value: a claim about a deployment or its command, from the first word on.
DEPLOY = r"(?i)^[^A-Za-z0-9_]*(.+?\bdeploy(?:ment)?(?:\s+command)?)\s+(is\s+not|does\s+not\s+use|do\s+not\s+use|doesn't\s+use|don't\s+use|no\s+longer\s+uses?|uses?|is|=)\s+([^.!?。！？]+)\s*[.!?。！？]?"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: a filter or a later column that reads them doesn't repeat them, as
    it does with ``withColumn``."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__once")).select("*", "__once.*").drop("__once")


def claims(df: DataFrame) -> DataFrame:
    """(id, scope, category, at, subject, predicate, value, negated) of rows that state a claim: token sets and polarity."""
    at = F.coalesce("timestamp_ms", F.lit(0)) if "timestamp_ms" in df.columns else F.lit(0)
    s = F.col("__s")
    part = lambda k: F.when(F.col("__deploys"), F.regexp_extract(s, T.bounded(DEPLOY), k)).otherwise(F.regexp_extract(s, CLAIM, k))
    x = _once(df.select("id", F.coalesce("scope", F.lit("global")).alias("scope"), "category", at.alias("at"), "text"), __s=claim_text(F.col("text"))).drop("text")
    x = _once(x, __deploys=s.contains("deploy") & s.rlike(T.bounded(DEPLOY)))
    x = _once(x, __1=part(1)).where("__1 <> ''")
    x = _once(x, subject=claim_tokens(F.col("__1")), __2=part(2), __3=part(3)).where(F.size("subject") > 0)
    x = _once(x, value=claim_tokens(F.regexp_replace(claim_text(F.col("__3")), r"(?i)^(?:not|never|no\s+longer)\s+", ""))).where(F.size("value") > 0)
    predicate = T.one_line(F.regexp_replace("__2", r"(?i)\b(?:not|no longer|doesn't|don't|does|do)\b", ""))
    return x.select("id", "scope", "category", "at", "subject", F.regexp_replace(predicate, "s$", "").alias("predicate"), "value", s.rlike(T.bounded(NEGATION)).alias("negated"))


#: The least shares of tokens that like subjects, values and predicates have in common.
LIKE_SUBJECT, LIKE_VALUE, LIKE_PREDICATE = 0.45, 0.75, 0.35


def conflicts(df: DataFrame, newest: int | None = None) -> DataFrame:
    """(id_a, id_b): claims of one scope and category about one subject with opposite polarity, like predicates and values.

    Equal claims are compared once, for all rows that state them. Like values share three quarters of the tokens of the
    smaller, so one of its rarest quarter is shared (and one more): only these tokens of a claim meet all tokens of the
    others, beside a word of the predicate. Tokens that claims of one polarity alone have are shared by no pair. Pairs meet
    as keys, with the subject as short hashes, by which most are dropped where they meet; the rest are compared by the
    tokens themselves. ``newest``: only so many rows of a scope and category are looked at, the newest ones."""
    c = claims(df)
    if newest is not None:
        c = c.withColumn("r", F.row_number().over(W.partitionBy("scope", "category").orderBy(F.desc("at"), "id"))).where(F.col("r") <= newest).drop("r")
    what = ["scope", "category", "subject", "predicate", "value", "negated"]
    c = written(c.select("id", *what, F.xxhash64(*what).alias("claim")), "claims")
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    each = c.drop("id").dropDuplicates(["claim"])
    # equal predicates without a word meet on an empty one
    by = each.select("claim", "negated", "scope", "category", "value", F.explode(F.when(F.size(words("predicate")) > 0, F.array_distinct(words("predicate"))).otherwise(F.array(F.lit("")))).alias("word"))
    keys = by.select("claim", "negated", "word", F.explode("value").alias("v"), "scope", "category").select("claim", "word", "negated", F.xxhash64("scope", "category", "word", "v").alias("key"))
    both = keys.groupBy("key").agg(F.count_if("negated").alias("no"), F.count_if(~F.col("negated")).alias("yes")).where("no > 0 and yes > 0").select("key", (F.col("no") * F.col("yes")).alias("meetings"))
    shared = keys.join(both, "key").groupBy("claim", "word").agg(F.sort_array(F.collect_list(F.struct("meetings", "key"))).alias("keys"))
    n, m = F.size("value"), F.size("keys")
    hashes = F.transform("subject", lambda t: (F.hash(t).bitwiseAND(0xFFFF) - 0x8000).cast("short"))
    met = each.select("claim", "negated", n.alias("n"), F.size("subject").alias("of"), F.array_distinct(hashes).alias("about"), "value").join(shared, "claim")
    met = met.select("claim", "negated", "n", "of", "about", (m - F.ceil(LIKE_VALUE * n)).alias("last"), F.posexplode("keys").alias("place", "k")).select("*", "k.key").drop("k")
    met = written(met, "claim-keys")
    x, y = met.where("place <= last").alias("x"), met.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & F.col("x.negated"))
    # what two tokens of a claim hash alike may count twice
    about = F.size(F.array_intersect("x.about", "y.about")) + F.col("x.of") - F.size("x.about")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.negated") != F.col("y.negated")) & smaller & (about >= LIKE_SUBJECT * F.least("x.of", "y.of") - 1e-9))
    pairs = pairs.select(F.when(F.col("x.negated"), F.col("x.claim")).otherwise(F.col("y.claim")).alias("n_claim"), F.when(F.col("x.negated"), F.col("y.claim")).otherwise(F.col("x.claim")).alias("y_claim")).distinct()
    for side in "ny":
        pairs = pairs.join(each.select(*[F.col(k).alias(f"{side}_{k}") for k in ("claim", *what[:-1])]), f"{side}_claim")
    like = lambda x, least: similarity(F.col(f"n_{x}"), F.col(f"y_{x}")) >= least
    same = (F.col("n_predicate") == F.col("y_predicate")) | (similarity(words(F.col("n_predicate")), words(F.col("y_predicate"))) >= LIKE_PREDICATE)
    one = (F.col("n_scope") == F.col("y_scope")) & F.col("n_category").eqNullSafe(F.col("y_category"))
    pairs = pairs.where(one & like("subject", LIKE_SUBJECT) & like("value", LIKE_VALUE) & same).select("n_claim", "y_claim")
    rows = c.select("id", "claim")
    pairs = pairs.join(rows.select(F.col("claim").alias("n_claim"), F.col("id").alias("n_id")), "n_claim").join(rows.select(F.col("claim").alias("y_claim"), F.col("id").alias("y_id")), "y_claim")
    return pairs.select(F.least("n_id", "y_id").alias("id_a"), F.greatest("n_id", "y_id").alias("id_b")).distinct()


def marked(pairs: DataFrame) -> DataFrame:
    """(id, conflict_ids, conflict_count) in both directions, sorted and distinct."""
    both = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("conflict_ids")).withColumn("conflict_count", F.size("conflict_ids"))


def reasons() -> Column:
    """Reasons for a review of a normalised row."""
    inactive = F.col("lifecycle").isin("superseded", "obsolete", "rejected")
    tests = [
        (F.col("state") == "rejected", F.lit("inactive_lifecycle:rejected")),
        (inactive, F.concat(F.lit("inactive_lifecycle:"), F.col("lifecycle"))),
        ((F.col("state") == "archived") | (F.col("layer") == "archive") | (F.col("lifecycle") == "archived"), F.lit("archive_review")),
        ((F.col("layer") == "working") | (F.col("category") == "other"), F.lit("local_or_working_scratch")),
        ((F.col("source") == "auto-capture") & (F.col("confidence") < 0.72), F.lit("raw_or_low_confidence_auto_capture")),
        (F.col("source") == "legacy", F.lit("legacy_metadata_review")),
        (F.col("confidence") < 0.55, F.lit("low_confidence")),
    ]
    return F.array_compact(F.array(*[F.when(t, v) for t, v in tests]))


def review_candidates(df: DataFrame, pairs: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(id, reasons, action, confidence, text) of the rows with a reason; ``pairs``: conflicts. Conflicts come first, then the
    least sure ones; ``limit`` rows at most."""
    x = df.withColumn("reasons", reasons())
    if pairs is not None:
        x = x.join(marked(pairs).select("id", F.lit("conflict_review").alias("c")), "id", "left").withColumn("reasons", F.when(F.col("c").isNotNull(), F.concat(F.array("c"), "reasons")).otherwise(F.col("reasons")))
    x = x.where(F.size("reasons") > 0)
    archive = F.exists("reasons", lambda r: r.startswith("inactive_lifecycle") | (r == "archive_review"))
    action = F.when(F.array_contains("reasons", "conflict_review"), "review").when(archive, "archive").when(F.array_contains("reasons", "low_confidence"), "promote").otherwise("review")
    x = x.select("id", "scope", "category", "reasons", action.alias("action"), "confidence", F.substring(T.one_line(F.coalesce("text", F.lit(""))), 1, 220).alias("text"))
    return x if limit is None else x.orderBy(F.desc(F.array_contains("reasons", "conflict_review")), "confidence", "id").limit(min(200, limit))


def support(slices: DataFrame, most: int = 8) -> DataFrame:
    """(id, n_slices, confirmations, contradictions, kept): totals over all slices; the newest ``most`` contexts are kept."""
    per = slices.groupBy("id", "context").agg(F.sum("confirmations").alias("c"), F.sum("contradictions").alias("d"), F.max("last_observed_at").alias("at"))
    ranked = per.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc_nulls_last("at"), "context")))
    return ranked.groupBy("id").agg(F.count("*").alias("n_slices"), F.sum("c").alias("confirmations"), F.sum("d").alias("contradictions"), F.sum((F.col("r") <= most).cast("int")).alias("kept"))


def versions(df: DataFrame, key: str, order: str) -> DataFrame:
    """SCD-2: each row with the time at which the next of its key replaces it."""
    w = W.partitionBy(key).orderBy(order, "id")
    return df.withColumn("valid_to", F.lead(order).over(w)).withColumn("superseded_by", F.lead("id").over(w))
