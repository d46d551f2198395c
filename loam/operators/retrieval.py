"""Retrieval end to end: lexical, vector and hybrid arms with scope and activity filters before any top-k, routing by
query, reranking, redundancy, boosts, resolution of references, duplicate checks, and recall into a prompt.

Queries are a DataFrame (query_id, query, ...); every stage works for many at once. Hosted embedders and rerankers are
inputs: a column of vectors, a table of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import scores as S
from loam.functions import text as T
from loam.operators import extract, gates, memory, search

#: Similarity from which a text counts as stored already, by where it comes from.
DUPLICATE = {"manual": 0.98, "auto-capture": 0.90, "mapped-reflection": 0.95, "legacy-reflection": 0.97, "import": 0.95}


def allowed_ids(rows: DataFrame, scopes: list[str] | None = None, as_of_ms: int | None = None, strict: bool = False) -> DataFrame:
    """(id) of normalised rows in the scopes, active ones if ``as_of_ms`` is given; ``strict``: a row without a scope counts
    as global, and passes only if that is listed."""
    if strict and scopes is not None:
        rows = rows.where(F.coalesce("scope", F.lit("global")).isin(scopes) if scopes else F.lit(False))
    else:
        rows = rows.where(memory.in_scopes(scopes))
    return (rows.where(memory.active_at(as_of_ms)) if as_of_ms is not None else rows).select("id")


def mode(query: Column, source: Column | None = None, has_index: bool = True, configured: str = "hybrid") -> Column:
    """'bm25' for queries with tags and for automatic recall, 'vector' if that is configured or there is no index, else 'hybrid'."""
    auto = F.coalesce(source == "auto-recall", F.lit(False)) if source is not None else F.lit(False)
    rest = "vector" if configured == "vector" or not has_index else configured
    return F.when((F.size(extract.tags(query)) > 0) | auto, "bm25").otherwise(rest)


def bm25_arm(memories: DataFrame, queries: DataFrame, limit: int = 10, allowed: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): lexical hits of a pool of 20 or twice the limit, of the category, with all of the query's tags."""
    hits = search.lexical_search(memories, queries, max(20, 2 * limit), allowed)
    return of_category(with_tags(hits, memories, queries), memories, category)


def with_tags(hits: DataFrame, memories: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits whose text holds every tag of the query."""
    tags = queries.select("query_id", extract.tags(F.col("query")).alias("tags")).where(F.size("tags") > 0)
    x = hits.join(tags, "query_id", "left").join(memories.select("id", F.col("text").alias("t")), "id")
    return x.where(F.col("tags").isNull() | extract.holds_tags(F.col("t"), F.col("tags"))).drop("tags", "t")


def of_category(hits: DataFrame, memories: DataFrame, category: str | None) -> DataFrame:
    """After the best ones are taken, so that there may be fewer."""
    return hits if category is None else hits.join(memories.where(F.col("category") == category).select("id"), "id", "left_semi")


def vector_arm(vectors: DataFrame, queries: DataFrame, limit: int = 20, least: float = 0.3, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) over (id, vec); only allowed rows are compared."""
    base = vectors if allowed is None else vectors.join(allowed, "id", "left_semi")
    return search.vector_search(base, queries, limit, least)


def substring_arm(rows: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Fallback without an index: the whole query within the text or the metadata's abstract, overview or content."""
    q = queries.select("query_id", F.lower(T.one_line(F.col("query"))).alias("q")).where("q <> ''")
    base = F.least(F.lit(0.95), F.length("q") * 0.02 + 0.72)
    l1 = F.try_variant_get("extra", "$.l1_overview", "string")
    fields = [(F.col("text"), 1.0), (F.col("l0"), 0.98), (l1, 0.92), (F.col("l2"), 0.96)]
    # queries are a configured or interactive list, which is sent to the rows: a substring has no key to meet on
    x = rows.join(F.broadcast(q.limit(search.MOST_QUERIES)), F.lower(F.concat_ws("\n", "text", "l0", l1, "l2")).contains(F.col("q")))
    score = F.greatest(*[F.when(F.lower(T.one_line(F.coalesce(c, F.lit("")))).contains(F.col("q")), base * w).otherwise(0.0) for c, w in fields])
    return search.top(x.select("query_id", "id", "timestamp_ms", F.round(score, 9).alias("score")).where("score > 0"), limit)


def raw_to_score(raw: Column) -> Column:
    """A raw full-text score, the larger the better, as 0..1."""
    return F.when(raw <= 0, 0.5).otherwise(1 / (1 + F.exp(-raw / 5)))


def reranked(hits: DataFrame, external: DataFrame | None = None, cosines: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Scores mixed with those of a reranker (query_id, id, rerank), or of the vectors (query_id, id, cosine).

    A reranker is asked about the best 2 x ``limit``; the rest is left out. Hits without a vector keep their score."""
    x = hits.where(F.col("rank") <= 2 * limit)
    if external is not None:
        b = F.col("b_score") if "b_score" in hits.columns else F.lit(0.0)
        x = x.join(external, ["query_id", "id"], "left").withColumn("score", S.rerank(F.col("score"), F.col("rerank"), F.coalesce(b, F.lit(0.0)))).drop("rerank")
    elif cosines is not None:
        x = x.join(cosines, ["query_id", "id"], "left").withColumn("score", S.rerank_cosine(F.col("score"), F.col("cosine"))).drop("cosine")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return x.withColumn("r", F.row_number().over(w)).drop("rank").withColumnRenamed("r", "rank")


def hybrid(memories: DataFrame, vectors: DataFrame, queries: DataFrame, least: float = 0.3, allowed: DataFrame | None = None, pool: int = 20) -> DataFrame:
    """(query_id, id, score, rank, v_score, b_score): both arms, fused, with the cosine rerank of hits that have a vector.

    queries: (query_id, query, vec). Lexical hits that no memory has any more are dropped."""
    v = vector_arm(vectors, queries, pool, 0.1, allowed)
    b = search.lexical_search(memories, queries, pool, allowed).join(memories.select("id"), "id", "left_semi")
    x = search.fused(v, b).where(F.col("score") >= least)
    cosine = 1 - (1 / F.col("v_score") - 1)
    x = x.withColumn("score", F.round(S.rerank_cosine(F.col("score"), F.when(F.col("v_score").isNotNull(), cosine)), 9))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("v_rank").asc_nulls_last(), F.col("b_rank").asc_nulls_last(), "id")
    return x.withColumn("rank", F.row_number().over(w)).drop("v_rank", "b_rank")


def recall(memories: DataFrame, vectors: DataFrame, queries: DataFrame, rows: DataFrame, as_of_ms: int, limit: int = 10, allowed: DataFrame | None = None, diverse: bool = True, source: Column | None = None) -> DataFrame:
    """(query_id, id, rank, score): each query by its mode, then the simple chain, then diversity. Vector-only and lexical
    queries skip fusion and rerank."""
    q = queries.withColumn("mode", mode(F.col("query"), source))
    parts = [hybrid(memories, vectors, q.where("mode = 'hybrid'"), allowed=allowed).select("query_id", "id", "score", "rank"), bm25_arm(memories, q.where("mode = 'bm25'"), limit, allowed).select("query_id", "id", "score", "rank")]
    ranked = search.simple_chain(parts[0].unionByName(parts[1]), rows, as_of_ms, 20)
    if not diverse:
        return ranked.where(F.col("rank") <= limit).select("query_id", "id", "rank", "score")
    chosen = search.diversified(ranked.select("query_id", "id", "rank"), vectors, limit)
    return chosen.join(ranked.select("query_id", "id", "score"), ["query_id", "id"]).select("query_id", "id", F.col("new_rank").alias("rank"), "score")


def intent_boost(hits: DataFrame, memories: DataFrame, queries: DataFrame, factor: float = 1.15) -> DataFrame:
    """Hits of the categories that a query is about, if it is clear, score 1.15 times as much, at most 1."""
    want = queries.select("query_id", gates.intent(F.col("query")).alias("i")).select("query_id", "i.categories", "i.confidence")
    x = hits.join(want, "query_id", "left").join(memories.select("id", "category"), "id")
    wanted = (F.col("confidence") == "high") & F.array_contains(F.split("categories", ","), F.col("category"))
    x = x.withColumn("score", F.round(F.when(wanted, F.least(F.lit(1.0), F.col("score") * factor)).otherwise(F.col("score")), 9))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return x.withColumn("new_rank", F.row_number().over(w)).drop("rank", "categories", "confidence", "category").withColumnRenamed("new_rank", "rank")


def not_repeated(hits: DataFrame, history: DataFrame, turns: int = 8) -> DataFrame:
    """Hits (session, turn, id, ...) that the session was not given within the last ``turns`` turns; 0 turns lets all pass.

    history: (session, id, turn)."""
    if turns <= 0:
        return hits
    last = history.groupBy("session", "id").agg(F.max("turn").alias("last_turn"))
    return hits.join(last, ["session", "id"], "left").where(F.col("turn") - F.coalesce("last_turn", F.lit(-999)) >= turns).drop("last_turn")


def eligible(rows: DataFrame, turn: Column | None = None) -> DataFrame:
    """Normalised rows that may be put into a prompt: confirmed, no archive or reflection, not suppressed for the turn."""
    until = F.coalesce(F.try_variant_get("extra", "$.suppressed_until_turn", "bigint"), F.lit(0))
    return rows.where((F.col("state") == "confirmed") & ~F.col("layer").isin("archive", "reflection") & (F.lit(True) if turn is None else (until <= 0) | (turn > until)))


def auto_recall(memories: DataFrame, rows: DataFrame, prompts: DataFrame, history: DataFrame, as_of_ms: int, scopes: list[str] | None = None, items: int = 3) -> DataFrame:
    """(session, turn, query_id, id, rank, chars): what each prompt (session, turn, query_id, query) is given.

    Prompts that need none are skipped; 1,000 characters of the others are searched lexically among active rows of the
    scopes; then the intent's boost, repetitions, eligibility, and the budget."""
    q = prompts.where(~gates.should_skip(F.col("query"))).withColumn("query", F.substring("query", 1, 1_000))
    hits = search.simple_chain(bm25_arm(memories, q, 10, allowed_ids(rows, scopes, as_of_ms)), rows, as_of_ms, 20)
    hits = intent_boost(hits.select("query_id", "id", "score", "rank"), memories, q).join(q.select("query_id", "session", "turn"), "query_id")
    hits = not_repeated(hits, history).join(eligible(rows).select("id"), "id", "left_semi")
    w = W.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("n", F.row_number().over(w)).drop("rank").withColumnRenamed("n", "rank")
    return search.packed(hits, memories, items).join(q.select("query_id", "session", "turn"), "query_id").select("session", "turn", "query_id", "id", "rank", "chars")


def explained(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Each hit with where its score comes from and its lifecycle."""
    arms = F.array_compact(F.array(F.when(F.col("v_score").isNotNull(), "vector"), F.when(F.col("b_score").isNotNull(), "bm25")))
    return hits.select("query_id", "id", "rank", "score", F.array_join(arms, "+").alias("sources")).join(rows.select("id", "state", "layer", "tier", "access_count", "confidence"), "id")


def resolved(refs: DataFrame, memories: DataFrame, hits: DataFrame) -> DataFrame:
    """(ref, id, outcome) of references (ref): an id, a prefix of eight hexadecimal digits and more, or words.

    Ambiguous prefixes and words whose best hit is neither alone nor above 0.85 are 'ambiguous'; others are 'found' or
    'missing'. hits: (query_id, id, score, rank) of a search for the words, query_id being the ref."""
    r = refs.select("ref").distinct().withColumn("kind", F.when(F.col("ref").rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "id").when(F.col("ref").rlike("(?i)^[0-9a-f-]{8,}$"), "prefix").otherwise("words"))
    ids = memories.select("id").distinct().withColumn("head", F.lower(F.substring("id", 1, 8)))
    exact = r.where("kind = 'id'").join(ids, F.lower("ref") == F.lower("id")).select("ref", "id", F.lit(1).alias("n"))
    by_prefix = r.where("kind = 'prefix'").withColumn("head", F.lower(F.substring("ref", 1, 8))).join(ids, "head").where(F.lower("id").startswith(F.lower("ref")))
    by_prefix = by_prefix.groupBy("ref").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    few = hits.where("rank <= 5").groupBy(F.col("query_id").alias("ref")).agg(F.min_by("id", "rank").alias("id"), F.when((F.count("*") == 1) | (F.max("score") > 0.85), 1).otherwise(2).alias("n"))
    by_words = r.where("kind = 'words'").join(few, "ref").select("ref", "id", "n")
    found = exact.unionByName(by_prefix).unionByName(by_words)
    return r.join(found, "ref", "left").select("ref", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("outcome"))


def duplicates(new: DataFrame, vectors: DataFrame, kind: str = "manual", allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, cosine) of new rows (query_id, vec) whose nearest stored vector is above the threshold of ``kind``."""
    near = vector_arm(vectors, new, 1, 0.0, allowed).withColumn("cosine", F.round(2 - 1 / F.col("score"), 9))
    return near.where(F.col("cosine") > DUPLICATE[kind]).select("query_id", "id", "cosine")


def dedup_candidates(new: DataFrame, vectors: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): up to five stored rows of score 0.7 and more, as candidates for a decision."""
    return vector_arm(vectors, new, 5, 0.7, allowed)


def novelty_pool(new: DataFrame, vectors: DataFrame, categories: DataFrame, size: int = 8, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, cosine): the nearest ``size`` (at most 20) rows of new rows (query_id, vec, category); only those of the
    same category where there are any. categories: (id, memory_category)."""
    near = vector_arm(vectors, new, min(20, size), 0.0, allowed).join(categories.select("id", "memory_category"), "id").join(new.select("query_id", "category"), "query_id")
    same = F.col("memory_category") == F.col("category")
    x = near.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("any_same", F.max("same").over(W.partitionBy("query_id")))
    return x.where(F.col("same") | ~F.col("any_same")).select("query_id", "id", F.round(2 - 1 / F.col("score"), 9).alias("cosine"))


def listed_where(rows: DataFrame, test: Column, limit: int, offset: int = 0) -> DataFrame:
    """The newest min(500, max(offset + 5 x limit, limit)) rows, of these the ones that pass, of these a page."""
    few = memory.listed(rows, None, None, min(500, max(offset + 5 * limit, limit)))
    return few.where(test).orderBy(F.desc("timestamp_ms"), "id").offset(offset).limit(limit)


def index_report(truth: DataFrame, index: DataFrame) -> DataFrame:
    """(n_truth, n_index, stale, missing, extra, healthy) of an index's ids against the table's, by one full join."""
    t = truth.select("id").distinct().withColumn("t", F.lit(1))
    i = index.groupBy("id").agg(F.count("*").alias("i"))
    x = t.join(i, "id", "full").agg(F.count("t").alias("n_truth"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_index"), F.count(F.when(F.col("t").isNull(), 1)).alias("stale"), F.count(F.when(F.col("i").isNull(), 1)).alias("missing"), F.coalesce(F.sum(F.greatest(F.col("i") - 1, F.lit(0))), F.lit(0)).alias("extra"))
    return x.withColumn("healthy", (F.col("stale") == 0) & (F.col("missing") == 0) & (F.col("extra") == 0))


def profile_boundary(rows: DataFrame, profile: bool = True, name: bool = True, addressing: bool = True) -> DataFrame:
    """Normalised rows without what belongs to a user's own profile file: profile rows and hints, names, forms of address."""
    probe = F.concat_ws("\n", "text", "l0", "l2")
    hints = [r"(?im)^User profile:", r"(?im)^##\s*(?:Background|Profile|Context)$", r"(?i)(?:^|\n)-\s*(?:Timezone|Pronouns?|Role|Language|Working style|Collaboration style)\s*:", r"(?i)(?:我的时区是|我的代词是|我是|我的身份是|my timezone is|my pronouns are|i am)\b", "(?:时区|代词|协作方式|工作方式|语言偏好)"]
    who = extract.identity(probe)
    out = F.lit(False)
    if profile:
        out = out | (F.col("memory_category") == "profile") | T.any_of(probe, hints)
    if name:
        out = out | who["name"].isNotNull()
    if addressing:
        out = out | who["addressed"].isNotNull()
    return rows.where(~out)
