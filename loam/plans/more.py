"""More queries: retrieval, capture, reflections, write paths, sessions and upkeep, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam import cli
from loam.functions import embed
from loam.operators import admission, capture, embedding, extract, governance, memory, reflection, retrieval, scopes, search, writes
from loam.operators.memory import AS_OF_MS
from loam.plans.core import _EMB, ACTIVE, BM25, CHAIN, FUSE, LEX, MEM, NORM, QUERIES, QV, TX, VEC, _s, _vectors, query_rows, sql_any, sql_line, sql_trim, table
from loam.streaming import state

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


SCOPES = ["agent:main", "global"]
LISTED = "(scope IN ('agent:main', 'global') OR scope IS NULL)"
LEXS = "lexical_all AS (SELECT bm.query_id, bm.id, bm.timestamp_ms, greatest(coalesce(l.score, 0.0), 0.96 * bm25) AS score FROM bm LEFT JOIN (SELECT * FROM lex0 WHERE rank <= 200) l ON l.query_id = bm.query_id AND l.id = bm.id), lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, timestamp_ms DESC NULLS LAST, id) AS rank FROM lexical_all WHERE score > 0)"
LEX0 = LEX.replace("lex AS (", "lex0 AS (")
FEATURES = "CASE WHEN len(tk) > 0 THEN list_distinct(list_concat(tk, flatten([[substring(t, i, 3) FOR i IN range(1, length(t) - 1)] FOR t IN tk IF length(t) > 3]))) WHEN low <> '' THEN [substring(low, 1, 64)] ELSE [] END"


def sql_hashed(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` (key, idx, w): the hash embedding of a table's texts."""
    return rf"{name} AS (SELECT {key}, (('0x' || substring(h, 1, 8))::BIGINT % 256)::INT AS idx, sum(CASE WHEN ('0x' || substring(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS w FROM (SELECT {key}, sha1(unnest({FEATURES})) AS h FROM (SELECT {key}, lower(coalesce({text}, '')) AS low, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]{{2,}}|[㐀-鿿]+') AS tk FROM {source})) GROUP BY 1, 2)"


HYBRID = f"""{sql_hashed('em', 'mem', 'id', 'text')}, {sql_hashed('eq', 'q', 'query_id', 'query')}, nm AS (SELECT id, sqrt(sum(w * w)) AS n FROM em GROUP BY id HAVING sum(w * w) > 0), nq AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM eq GROUP BY query_id),
dots AS (SELECT query_id, id, sum(em.w * eq.w) AS dot FROM em JOIN eq USING (idx) GROUP BY query_id, id), vs AS (SELECT nq.query_id, nm.id, round(1 / (1 + least(2.0, greatest(0.0, 1 - coalesce(dot, 0) / (nm.n * nq.n)))), 9) AS v FROM nm CROSS JOIN nq LEFT JOIN dots ON dots.id = nm.id AND dots.query_id = nq.query_id),
vv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, id) AS v_rank FROM vs) WHERE v_rank <= 20), bb AS (SELECT query_id, id, score AS b, rank AS b_rank FROM lex WHERE rank <= 20),
ff AS (SELECT query_id, id, v, v_rank, b_rank, {FUSE} AS s FROM vv FULL JOIN bb USING (query_id, id)), gg AS (SELECT *, round(CASE WHEN v IS NULL THEN s ELSE greatest(0.0, least(1.0, s * 0.7 + (1 - (1 / v - 1)) * 0.3)) END, 9) AS score FROM ff WHERE s >= 0.3),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v_rank NULLS LAST, b_rank NULLS LAST, id) AS rank FROM gg)"""


def _hybrid_inputs(spark, d):
    m = memory.entries(spark, d)
    q = query_rows(spark)
    return m, embed.embedded(m, "id", "text"), q.join(embed.embedded(q, "query_id", "query").withColumnRenamed("id", "query_id"), "query_id")


@query(f"WITH {MEM}, {QV}, {LEX0}, {BM25}, {LEXS}, {HYBRID} SELECT query_id, id, rank, round(score, 6) AS score FROM hybrid WHERE rank <= 10")
def recall_hybrid(spark, d):
    m, vectors, q = _hybrid_inputs(spark, d)
    return retrieval.hybrid(m, vectors, q).where("rank <= 10").select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query()
def recall_diverse(spark, d):
    m, vectors, q = _hybrid_inputs(spark, d)
    return retrieval.recall(m, vectors, q, memory.normalised(m), AS_OF_MS).withColumn("score", F.round("score", 6))


@query(f"WITH {NORM}, {QV}, {LEX0}, {BM25}, {LEXS}, {CHAIN} SELECT query_id, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def recall_bm25(spark, d):
    m = memory.entries(spark, d)
    return search.simple_chain(retrieval.bm25_arm(m, query_rows(spark), 10), memory.normalised(m), AS_OF_MS).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {MEM}, {QV}, {sql_hashed('em', 'mem', 'id', 'text')}, {sql_hashed('eq', 'q', 'query_id', 'query')}, nm AS (SELECT id, sqrt(sum(w * w)) AS n FROM em GROUP BY id HAVING sum(w * w) > 0), nq AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM eq GROUP BY query_id), dots AS (SELECT query_id, id, sum(em.w * eq.w) AS dot FROM em JOIN eq USING (idx) GROUP BY query_id, id), vs AS (SELECT query_id, id, round(1 / (1 + least(2.0, greatest(0.0, 1 - dot / (nm.n * nq.n)))), 9) AS v FROM dots JOIN nm USING (id) JOIN nq USING (query_id)) SELECT query_id, id, rank, round(v, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, id) AS rank FROM vs) WHERE rank <= 10 AND v >= 0.3")
def recall_vector(spark, d):
    _, vectors, q = _hybrid_inputs(spark, d)
    return retrieval.vector_arm(vectors, q, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {NORM}, {QV}, {LEX.replace('lexs AS (SELECT', 'lexs AS (SELECT').replace('FROM post JOIN qt USING (token) GROUP', f'FROM post JOIN qt USING (token) WHERE id IN (SELECT id FROM norm WHERE {LISTED} AND {ACTIVE}) GROUP')} SELECT query_id, id, rank, round(score, 6) AS score FROM lex WHERE rank <= 20")
def recall_scoped(spark, d):
    """Scopes and activity are tested before the best ones are taken."""
    m = memory.entries(spark, d)
    allowed = retrieval.allowed_ids(memory.normalised(m), SCOPES, AS_OF_MS)
    return search.lexical(m, query_rows(spark), 20, allowed).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


PROBES = {"s1": "search panel", "s2": "green tea", "s3": "filtro", "s4": "zeitplan"}
_L1 = "coalesce(json_extract_string(j, '$.l1_overview'), '')"
_HIT = lambda c, w: f"CASE WHEN contains(lower({sql_line(c)}), p) THEN least(0.95, 0.72 + 0.02 * length(p)) * {w} ELSE 0.0 END"
_PV = "pr AS (SELECT * FROM (VALUES " + ", ".join(f"({_s(k)}, {_s(v)})" for k, v in PROBES.items()) + ") AS v(query_id, p))"


@query(f"WITH {NORM}, {_PV}, sc AS (SELECT query_id, id, timestamp_ms, round(greatest({_HIT('t', '1.0')}, {_HIT('l0', '0.98')}, {_HIT(_L1, '0.92')}, {_HIT(chr(99) + 'oalesce(json_extract_string(j, ' + chr(39) + '$.l2_content' + chr(39) + '), t)', '0.96')}), 9) AS score FROM norm CROSS JOIN pr), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, timestamp_ms DESC NULLS LAST, id) AS rank FROM sc WHERE score > 0) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 20")
def substring_search(spark, d):
    q = spark.createDataFrame(list(PROBES.items()), "query_id string, query string")
    return retrieval.substring_arm(memory.normalised(memory.entries(spark, d)), q).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query()
def auto_recall(spark, d):
    m = memory.entries(spark, d)
    rows = [(f"session{k % 2}", 10 + k, key, text) for k, (key, text) in enumerate(QUERIES.items())]
    prompts = spark.createDataFrame(rows, "session string, turn bigint, query_id string, query string")
    history = memory.entries(spark, d, ["id"]).select(F.lit("session0").alias("session"), "id", F.lit(5).cast("bigint").alias("turn")).where(F.col("id").startswith("0"))
    return retrieval.auto_recall(m, memory.normalised(m), prompts, history, AS_OF_MS)


@query(f"WITH {VEC}, near AS (SELECT query_id, vr.id, score, a.label AS l, b.label AS m FROM vr JOIN e a ON a.vec_id = query_id JOIN e b ON b.vec_id = vr.id WHERE rank <= 8), s AS (SELECT *, max(CASE WHEN l = m THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_same FROM near) SELECT query_id, round(1 - max(greatest(2 - 1 / score, 0.0)), 6) AS novelty, count(*) FILTER (2 - 1 / score >= 0.55) AS matched FROM s WHERE l = m OR any_same = 0 GROUP BY query_id")
def admission_novelty(spark, d):
    base, q = _vectors(spark, d)
    pool = retrieval.novelty_pool(q.withColumnRenamed("label", "category"), base, base.select("id", F.col("label").alias("memory_category")))
    return admission.novelty(pool).select("query_id", F.round("novelty", 6).alias("novelty"), F.size("matched").cast("bigint").alias("matched"))


_NOT_SELF = VEC.replace("WHERE a.vec_id % 20 = 0", "WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0")


@query(f"WITH {_NOT_SELF} SELECT query_id, id, round(2 - 1 / score, 6) AS cosine FROM vr WHERE rank = 1 AND 2 - 1 / score > 0.9")
def stored_duplicates(spark, d):
    base, q = _vectors(spark, d)
    return retrieval.duplicates(q, base.where("id % 20 <> 0"), "auto-capture").withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_NOT_SELF} SELECT query_id, id, rank, round(score, 6) AS score FROM vr WHERE rank <= 5 AND score >= 0.7")
def merge_candidates(spark, d):
    base, q = _vectors(spark, d)
    return retrieval.dedup_candidates(q, base.where("id % 20 <> 0")).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


# --- capture and text ---


@query()
def capturable(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", capture.should_capture(F.col("text")).alias("capture"))


@query()
def captured_texts(spark, d):
    x = table(spark, d, "documents").select(F.coalesce("session_key", F.lit("none")).alias("conversation"), F.col("doc_id").alias("n"), F.lit("user").alias("role"), "text")
    return capture.captured(x)


_CTX = sql_line("translate(regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), '<>', '＜＞')")


@query(f"WITH {TX} SELECT id, substring({_CTX}, 1, 300) AS line FROM tx")
def context_lines(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", capture.for_context(F.col("text")).alias("line"))


_ENV = "text"
for _p in capture.ENVELOPE:
    _ENV = f"regexp_replace({_ENV}, {_s(_p)}, '', 'g')"


@query(f"WITH {TX} SELECT id, {sql_trim(f'regexp_replace({_ENV}, chr(10) || chr(123) || {_s(chr(51) + chr(44) + chr(125))}, chr(10) || chr(10), {_s(chr(103))})')} AS text FROM tx")
def unenveloped_texts(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", capture.without_envelope(F.col("text")).alias("text"))


@query()
def error_signatures(spark, d):
    x = memory.entries(spark, d, ["id", "text"])
    return x.select(capture.error_hash(F.col("text")).alias("signature"), capture.error_summary(F.col("text")).alias("summary")).groupBy("signature").agg(F.count("*").alias("n"), F.min("summary").alias("summary"))


@query("WITH d AS (SELECT coalesce(text, '') AS t FROM documents) SELECT CAST(sum(len(regexp_extract_all(t, '(?i)\\bpending\\b'))) AS BIGINT) AS pending, CAST(sum(len(regexp_extract_all(t, '(?i)\\bdecision\\b'))) AS BIGINT) AS decisions, CAST(sum(len(regexp_extract_all(t, '(?m)^- '))) AS BIGINT) AS bullets FROM d")
def backlog_counts(spark, d):
    t = F.coalesce("text", F.lit(""))
    n = lambda p: F.sum(F.regexp_count(t, F.lit(p)).cast("bigint"))
    return table(spark, d, "documents").agg(n(r"(?i)\bpending\b").alias("pending"), n(r"(?i)\bdecision\b").alias("decisions"), n("(?m)^- ").alias("bullets"))


# --- reflections ---

_WHY = f"CASE WHEN {sql_any('text', ['(?i)' + p for p in reflection.NOT_RETRIED])} THEN 'non_retry_error' WHEN {sql_any('text', ['(?i)' + p for p in reflection.TRANSIENT])} THEN 'transient_upstream_failure' ELSE 'non_transient_error' END"


@query(f"WITH {TX} SELECT {_WHY} AS reason, count(*) AS n FROM tx GROUP BY 1")
def retry_reasons(spark, d):
    r = reflection.retry(F.lit(True), F.lit(0), F.lit(0), F.col("text"))
    return memory.entries(spark, d, ["id", "text"]).select(r["reason"].alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def reflection_items(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text", F.unix_millis(F.coalesce(F.col("created_at").cast("timestamp"), F.timestamp_millis(F.lit(0)))).alias("at_ms"))
    return reflection.stored(x, "doc_id", "text", "at_ms").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"))


@query(f"WITH {NORM} SELECT id, CASE WHEN category = 'reflection' OR coalesce(json_extract_string(j, '$.type') IN ('memory-reflection', 'memory-reflection-event', 'memory-reflection-item'), false) THEN 'reflection:' ELSE coalesce(category, 'other') || ':' END || coalesce(scope, 'global') AS tag FROM norm")
def display_tags(spark, d):
    rows = memory.normalised(memory.entries(spark, d))
    return rows.select("id", reflection.display_tag(rows).alias("tag"))


@query("WITH x AS (SELECT coalesce(scope, 'global') AS agent, text AS line, coalesce(timestamp_ms, 0) AS at_ms, CASE WHEN category = 'decision' THEN 'invariant' ELSE 'derived' END AS kind FROM (SELECT DISTINCT id, scope, text, category, timestamp_ms FROM memory_entries) WHERE text IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY at_ms DESC, line) AS r FROM x) SELECT agent, kind, count(*) AS n FROM n WHERE r <= 160 GROUP BY ALL")
def reflection_window(spark, d):
    """The newest 160 rows of each agent, by kind."""
    x = memory.entries(spark, d).where("text is not null").select(F.coalesce("scope", F.lit("global")).alias("agent"), F.col("text").alias("line"), F.coalesce("timestamp_ms", F.lit(0)).alias("at_ms"), F.when(F.col("category") == "decision", "invariant").otherwise("derived").alias("kind"))
    from pyspark.sql import Window as W

    x = x.withColumn("r", F.row_number().over(W.partitionBy("agent").orderBy(F.desc("at_ms"), "line"))).where("r <= 160")
    return x.groupBy("agent", "kind").agg(F.count("*").alias("n"))


# --- writes and upkeep ---

_G = lambda k: f"lower(trim(coalesce(json_extract_string(j, '$.{k}'), '')))"
_BARE = f"({_G('memory_category')} = '' OR {_G('state')} = '' OR {_G('memory_layer')} = '')"


@query(f"WITH {NORM} SELECT id, CASE WHEN {_G('state')} IN ('archived', 'rejected') OR {_G('memory_layer')} = 'archive' OR {_G('lifecycle')} IN ('archived', 'obsolete', 'rejected', 'superseded') THEN 'keep' WHEN lower(trim(coalesce(category, ''))) = 'other' AND ({_BARE} OR ({_G('memory_layer')} = 'working' AND ({_G('source')} IN ('legacy', 'auto-capture') OR {_G('memory_category')} = 'patterns'))) THEN 'archive' WHEN {_BARE} OR {_G('l0_abstract')} = '' THEN 'normalise' ELSE 'keep' END AS action FROM norm")
def migration_plan(spark, d):
    rows = memory.normalised(memory.entries(spark, d))
    return rows.select("id", writes.migration_action(rows).alias("action"))


@query()
def migrated_metadata(spark, d):
    return writes.migrated(memory.normalised(memory.entries(spark, d)), AS_OF_MS)[1]


@query()
def upgraded_metadata(spark, d):
    return writes.upgraded(memory.normalised(memory.entries(spark, d)), AS_OF_MS)


@query(f"WITH {MEM} SELECT id FROM mem WHERE scope IN ('agent:main', 'global') AND timestamp_ms < {AS_OF_MS - 30 * 86_400_000}")
def bulk_deleted(spark, d):
    return writes.bulk_delete(memory.entries(spark, d), SCOPES, AS_OF_MS - 30 * 86_400_000)[1].select("id")


@query("WITH t AS (SELECT DISTINCT id FROM memory_entries), i AS (SELECT id, count(*) AS n FROM vector_records GROUP BY id), x AS (SELECT (SELECT count(*) FROM t) AS n_truth, (SELECT CAST(sum(n) AS BIGINT) FROM i) AS n_index, (SELECT count(*) FROM i WHERE id NOT IN (SELECT id FROM t)) AS stale, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM i)) AS missing, (SELECT CAST(sum(n - 1) AS BIGINT) FROM i) AS extra) SELECT *, stale = 0 AND missing = 0 AND extra = 0 AS healthy FROM x")
def index_report(spark, d):
    return retrieval.index_report(memory.entries(spark, d, ["id"]), table(spark, d, "vector_records"))


@query()
def doctor_issues(spark, d):
    return cli.doctor(memory.entries(spark, d), table(spark, d, "vector_records"))


@query(r"WITH d AS (SELECT DISTINCT id, text FROM memory_entries), p AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS token FROM d) SELECT id, count(*) AS n, count(DISTINCT token) AS n_distinct FROM p GROUP BY id")
def postings(spark, d):
    return cli.reindex(memory.entries(spark, d, ["id", "text"])).groupBy("id").agg(F.sum("tf").alias("n"), F.count("*").alias("n_distinct"))


@query("WITH s AS (SELECT DISTINCT coalesce(scope, 'global') AS scope FROM memory_entries) SELECT scope, regexp_matches(scope, '^[a-zA-Z0-9._:-]{1,100}$') AS valid, CASE WHEN contains(scope, ':') THEN regexp_extract(scope, '^([^:]*):', 1) END AS type, CASE WHEN contains(scope, ':') THEN regexp_extract(scope, '^[^:]*:(.*)$', 1) END AS name, nullif(trim(regexp_extract(scope, '^agent:([^:]+)', 1)), '') AS agent FROM s")
def scope_parts(spark, d):
    x = memory.entries(spark, d, ["id", "scope"]).select(F.coalesce("scope", F.lit("global")).alias("scope")).distinct()
    p = scopes.parsed(F.col("scope"))
    return x.select("scope", scopes.is_valid(F.col("scope")).alias("valid"), p["type"].alias("type"), p["id"].alias("name"), scopes.agent_of(F.col("scope")).alias("agent"))


@query(f"WITH {_EMB}, x AS (SELECT label, unnest(v) AS v, unnest(range(len(v))) AS k FROM e) SELECT label, k, round(avg(v), 6) AS mean FROM x GROUP BY label, k")
def chunk_means(spark, d):
    base, _ = _vectors(spark, d)
    x = embedding.chunk_mean(base.select(F.col("label").alias("id"), "vec"))
    return x.select(F.col("id").alias("label"), F.posexplode("vec").alias("k", "v")).select("label", F.col("k").cast("bigint").alias("k"), F.round("v", 6).alias("mean"))


@query()
def embedded_texts(spark, d):
    return embedding.embedded(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.size("vec").alias("dim"))


# --- sessions ---


@query("WITH x AS (SELECT session_key AS conversation, coalesce(text, '') AS text, row_number() OVER (PARTITION BY session_key ORDER BY doc_id DESC) AS r, doc_id FROM documents WHERE session_key IS NOT NULL) SELECT conversation, count(*) AS n, md5(string_agg(text, '|' ORDER BY doc_id)) AS digest FROM x WHERE r <= 6 GROUP BY conversation")
def recent_texts(spark, d):
    x = table(spark, d, "documents").where("session_key is not null").select(F.col("session_key").alias("conversation"), F.col("doc_id").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    return state.recent_texts(x).select("conversation", F.size("texts").cast("bigint").alias("n"), F.md5(F.array_join("texts", "|")).alias("digest"))


@query("WITH e AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events) SELECT event_id FROM e WHERE before IS NULL OR ts > before + INTERVAL 24 HOUR")
def guarded_events(spark, d):
    return state.once_within(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"]).select("event_id")


@query()
def unrepeated_hits(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("id"), F.col("event_id").alias("turn"))
    return state.unrepeated(x, 50)


@query()
def session_errors(spark, d):
    x = table(spark, d, "documents").where("session_key is not null and created_at is not null").select(F.col("session_key").alias("session"), capture.error_hash(F.col("text")).alias("signature"), "text", F.col("created_at").cast("timestamp").alias("ts"))
    return state.error_buffer(x, ttl="30 days").groupBy("session").agg(F.count("*").alias("n"))


@query()
def identities(spark, d):
    i = extract.identity(F.col("text"))
    b = extract.brand_preference(F.col("text"))
    return memory.entries(spark, d, ["id", "text"]).select("id", i["name"].alias("name"), i["addressed"].alias("addressed"), b["brand"].alias("brand"))


@query()
def conflict_review(spark, d):
    m = memory.entries(spark, d)
    return governance.review_candidates(memory.normalised(m), governance.conflicts(m), 200).select("id", F.array_join("reasons", ",").alias("reasons"), "action")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)



