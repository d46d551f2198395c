"""Queries of the memory engine's own operators over the test tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import embed
from loam.functions import scores as S
from loam.functions import text as T
from loam.operators import admission, chunking, extract, gates, governance, groups, lifecycle, memory, nesting, reflection, scopes, search, writes
from loam.operators.memory import AS_OF_MS
from loam.streaming import state

QUERIES = {"q1": "decision about the search panel", "q2": "vegetarian dinners and quiet hotels", "q3": "the import queue doubled rows", "q4": "el filtro del calendario"}
_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")


# --- SQL pieces -------------------------------------------------------------------------------------------------


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_s(p)})" for p in patterns) + ")"


SPACE = r"[\s\x{00a0}\x{3000}\x{feff}]"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_line(c: str) -> str:
    return sql_trim(f"regexp_replace({c}, '{SPACE}+', ' ', 'g')")


def sql_len16(c: str) -> str:
    return rf"(length({c}) + length(regexp_replace({c}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


MEM = "mem AS (SELECT DISTINCT id, text, category, scope, importance, timestamp_ms, metadata FROM memory_entries)"
_J = "CASE WHEN json_valid(metadata) THEN metadata::JSON END"
NORM = rf"""{MEM}, j AS (SELECT *, {_J} AS j, coalesce(text, '') AS t FROM mem),
a AS (SELECT *, json_extract_string(j, '$.source') AS src, json_extract_string(j, '$.state') AS st, json_extract_string(j, '$.memory_layer') AS ly, json_extract_string(j, '$.type') AS ty,
 CASE WHEN category = 'preference' THEN 'preferences' WHEN category = 'entity' THEN 'entities' WHEN category = 'decision' THEN 'events' WHEN category = 'fact' AND regexp_matches(t, '(?i)(?:^|\W)(?:my |i am |i''m |name is )') AND {sql_len16('t')} < 200 THEN 'profile' WHEN category = 'fact' THEN 'cases' ELSE 'patterns' END AS mapped FROM j),
b AS (SELECT *, CASE WHEN coalesce(src, CASE WHEN ty = 'session-summary' THEN 'session-summary' WHEN ty IN ('memory-reflection', 'memory-reflection-item') THEN 'reflection' ELSE 'legacy' END) IN ('manual', 'auto-capture', 'reflection', 'session-summary') THEN coalesce(src, CASE WHEN ty = 'session-summary' THEN 'session-summary' ELSE 'reflection' END) ELSE 'legacy' END AS source FROM a),
c AS (SELECT *, CASE WHEN coalesce(st, CASE WHEN source = 'session-summary' THEN 'archived' ELSE 'confirmed' END) IN ('pending', 'archived', 'rejected') THEN coalesce(st, 'archived') ELSE 'confirmed' END AS state FROM b),
norm AS (SELECT id, text, t, category, scope, importance, timestamp_ms, j, source, state, coalesce(json_extract_string(j, '$.l0_abstract'), t) AS l0, coalesce(json_extract_string(j, '$.memory_category'), mapped) AS memory_category,
 CASE WHEN json_extract_string(j, '$.tier') IN ('core', 'peripheral') THEN json_extract_string(j, '$.tier') ELSE 'working' END AS tier,
 CASE WHEN coalesce(ly, CASE WHEN source IN ('reflection', 'session-summary') THEN 'reflection' WHEN state IN ('archived', 'rejected') THEN 'archive' WHEN mapped IN ('profile', 'preferences', 'events') THEN 'durable' ELSE 'working' END) IN ('durable', 'reflection', 'archive') THEN coalesce(ly, CASE WHEN source IN ('reflection', 'session-summary') THEN 'reflection' WHEN state IN ('archived', 'rejected') THEN 'archive' ELSE 'durable' END) ELSE 'working' END AS layer,
 CASE WHEN TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) IS NULL THEN 0.7 ELSE least(1.0, greatest(0.0, TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE))) END AS confidence,
 greatest(0, coalesce(TRY_CAST(json_extract_string(j, '$.access_count') AS BIGINT), 0)) AS access_count,
 coalesce(TRY_CAST(json_extract_string(j, '$.last_accessed_at') AS BIGINT), timestamp_ms) AS last_accessed_at,
 coalesce(TRY_CAST(json_extract_string(j, '$.valid_from') AS BIGINT), timestamp_ms) AS valid_from,
 TRY_CAST(json_extract_string(j, '$.invalidated_at') AS BIGINT) AS invalidated_at,
 lower(trim(coalesce(json_extract_string(j, '$.lifecycle'), ''))) AS lifecycle FROM c)"""
ACTIVE = f"(state NOT IN ('archived', 'rejected') AND layer <> 'archive' AND lifecycle NOT IN ('archived', 'obsolete', 'rejected', 'superseded') AND valid_from <= {AS_OF_MS} AND (invalidated_at IS NULL OR invalidated_at = 0 OR invalidated_at > {AS_OF_MS}))"
QV = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({_s(k)}, {_s(v)})" for k, v in QUERIES.items()) + ") AS v(query_id, query))"
_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-zA-Z0-9]{{2,}}|[一-鿿]{{2,}}'))"
LEX = f"""qt AS (SELECT query_id, lower(query) AS query, unnest({_TOK.format('query')}) AS token, len({_TOK.format('query')}) AS n FROM q),
docs AS (SELECT id, timestamp_ms, lower(coalesce(text, '')) AS hay FROM mem), post AS (SELECT id, timestamp_ms, hay, unnest({_TOK.format('hay')}) AS token FROM docs),
lexs AS (SELECT query_id, id, any_value(timestamp_ms) AS timestamp_ms, least(1.0, count(*) / any_value(n) * 0.68 + CASE WHEN contains(any_value(hay), any_value(query)) THEN 0.35 ELSE 0.0 END) AS score FROM post JOIN qt USING (token) GROUP BY query_id, id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, timestamp_ms DESC NULLS LAST, id) AS rank FROM lexs)"""
_AGE = f"(({AS_OF_MS} - CASE WHEN m.timestamp_ms > 0 THEN m.timestamp_ms ELSE {AS_OF_MS} END) / 86400000.0)"
_NOISE = f"({sql_len16('s')} < 5 OR {sql_any('s', [*gates.DENIAL, *gates.META, *gates.BOILERPLATE, *gates.TRACE, *gates.DIAGNOSTIC])} OR ({sql_len16('s')} <= 180 AND {sql_any('s', gates.INSTRUCTION)}))"
#: the effective half-life: 60 days, longer the more and the later a memory was used
_HALF = f"CASE WHEN m.access_count <= 0 THEN 60.0 ELSE least(180.0, 60 + 30 * ln(1 + m.access_count * exp(-greatest(0.0, ({AS_OF_MS} - m.last_accessed_at) / 86400000.0) * ln(2) / 30))) END"
CHAIN = f"""x0 AS (SELECT l.query_id, l.id, l.score AS s0, l.rank AS ord, m.importance, {_AGE} AS age, {_HALF} AS half, {sql_trim('m.t')} AS s, {sql_len16("m.t")} AS len FROM lex l JOIN norm m USING (id) WHERE l.rank <= 20),
x1 AS (SELECT *, greatest(0.0, least(1.0, s0 + 0.1 * exp(-age / 14))) AS s1 FROM x0), x2 AS (SELECT *, greatest(0.0, least(1.0, s1 * (0.7 + 0.3 * coalesce(importance, 0.7)))) AS s2 FROM x1),
x3 AS (SELECT *, s2 / (1 + 0.5 * log2(greatest(len / 500.0, 1.0))) AS s3 FROM x2), x4 AS (SELECT *, round(s3 * (0.5 + 0.5 * exp(-age / half)), 9) AS score FROM x3 WHERE s3 >= 0.35 AND NOT {_NOISE}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM x4)"""


# --- table, scans, statistics ------------------------------------------------------------------------------------


@query(f"WITH {MEM}, s AS (SELECT coalesce(scope, 'global') AS scope, coalesce(category, 'other') AS category FROM mem) SELECT 'scope' AS dimension, scope AS key, count(*) AS n FROM s GROUP BY scope UNION ALL SELECT 'category', category, count(*) FROM s GROUP BY category UNION ALL SELECT 'total', 'all', count(*) FROM s")
def store_stats(spark, d):
    return memory.stats(memory.entries(spark, d))


@query(f"WITH {MEM} SELECT CASE WHEN s = 'global' THEN 'global' WHEN s LIKE 'agent:%' THEN 'agent' WHEN s LIKE 'custom:%' THEN 'custom' WHEN s LIKE 'project:%' THEN 'project' WHEN s LIKE 'user:%' OR s LIKE 'reflection:%' THEN 'user' ELSE 'other' END AS type, count(*) AS n, count(DISTINCT s) AS scopes FROM (SELECT coalesce(scope, 'global') AS s FROM mem) GROUP BY 1")
def scope_type_stats(spark, d):
    s = F.coalesce("scope", F.lit("global"))
    return memory.entries(spark, d, ["id", "scope"]).groupBy(memory.scope_type(s).alias("type")).agg(F.count("*").alias("n"), F.countDistinct(s).alias("scopes"))


@query(f"WITH {MEM} SELECT id, scope, category, timestamp_ms FROM mem WHERE (scope IN ('agent:main', 'global') OR scope IS NULL) ORDER BY timestamp_ms DESC NULLS LAST, id LIMIT 100 OFFSET 50")
def list_paged(spark, d):
    return memory.listed(memory.entries(spark, d), ["agent:main", "global"], None, 100, 50).select("id", "scope", "category", "timestamp_ms")


@query(f"WITH {MEM} SELECT id, category FROM mem WHERE scope IN ('agent:main') OR scope IS NULL")
def scope_filter(spark, d):
    return memory.entries(spark, d).where(memory.in_scopes(["agent:main", " "])).select("id", "category")


@query(f"WITH {MEM} SELECT id FROM mem WHERE false")
def scope_deny_all(spark, d):
    return memory.entries(spark, d).where(memory.in_scopes([])).select("id")


@query(f"WITH {MEM} SELECT id, text FROM mem WHERE starts_with(id, '0') ORDER BY id LIMIT 50")
def prefix_lookup(spark, d):
    return memory.by_prefix(memory.entries(spark, d), "0").select("id", "text")


@query(f"WITH {NORM} SELECT id, memory_category, source, state, tier, layer, round(confidence, 6) AS confidence, access_count, last_accessed_at, valid_from, invalidated_at, l0 FROM norm")
def metadata_normalised(spark, d):
    return memory.normalised(memory.entries(spark, d)).select("id", "memory_category", "source", "state", "tier", "layer", F.round("confidence", 6).alias("confidence"), "access_count", "last_accessed_at", "valid_from", "invalidated_at", "l0")


@query(f"WITH {NORM} SELECT id, {ACTIVE} AS active FROM norm")
def active_filter(spark, d):
    return memory.normalised(memory.entries(spark, d)).select("id", memory.active_at().alias("active"))


@query(f"WITH {NORM} SELECT state, source, layer, count(*) AS n FROM norm GROUP BY ALL")
def context_filters(spark, d):
    return memory.normalised(memory.entries(spark, d)).groupBy("state", "source", "layer").agg(F.count("*").alias("n"))


@query(f"WITH {NORM} SELECT CASE WHEN json_extract_string(j, '$.memory_category') IS NULL THEN 'legacy' ELSE 'current' END AS kind, coalesce(category, 'none') AS category, count(*) AS n FROM norm GROUP BY ALL")
def legacy_rows(spark, d):
    kind = F.when(F.try_variant_get("extra", "$.memory_category", "string").isNull(), "legacy").otherwise("current")
    return memory.normalised(memory.entries(spark, d)).groupBy(kind.alias("kind"), F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


_TOPIC = sql_trim("l0")
_COLON, _ARROW = f"regexp_extract({_TOPIC}, '^(.{{1,120}}?)[：:]', 1)", rf"regexp_extract({_TOPIC}, '^(.{{1,120}}?)(?:\s*->|\s*=>)', 1)"
_CLEAN = sql_trim(rf"regexp_replace(regexp_replace(lower(CASE WHEN {_COLON} <> '' THEN {_COLON} WHEN {_ARROW} <> '' THEN {_ARROW} ELSE {_TOPIC} END), '\s+', ' ', 'g'), '[。.!?]+\z', '')")


@query(f"WITH {NORM}, k AS (SELECT id, memory_category, {_CLEAN} AS c FROM norm WHERE memory_category IN ('preferences', 'entities')) SELECT id, memory_category || ':' || c AS fact_key FROM k WHERE c <> ''")
def fact_keys(spark, d):
    return memory.normalised(memory.entries(spark, d)).select("id", memory.fact_key(F.col("memory_category"), F.col("l0")).alias("fact_key")).where("fact_key is not null")


@query("WITH t AS (SELECT DISTINCT id FROM memory_entries), v AS (SELECT DISTINCT id FROM vector_records) SELECT (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM v) AS n_vectors, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM v)) AS missing, (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM t)) AS stale")
def vector_drift(spark, d):
    return memory.drift(memory.entries(spark, d, ["id"]), table(spark, d, "vector_records"))


@query("SELECT coalesce(scope, 'global') AS scope, count(DISTINCT id) AS n FROM vector_records GROUP BY 1")
def vector_scope_counts(spark, d):
    return table(spark, d, "vector_records").groupBy(F.coalesce("scope", F.lit("global")).alias("scope")).agg(F.countDistinct("id").alias("n"))


@query(f"WITH {MEM}, a AS (SELECT coalesce(scope, 'global') AS scope, count(*) AS n FROM mem GROUP BY 1), b AS (SELECT coalesce(scope, 'global') AS scope, count(DISTINCT id) AS n FROM vector_records GROUP BY 1) SELECT coalesce(a.scope, b.scope) AS scope, a.n AS n_truth, b.n AS n_vectors, a.n IS NOT DISTINCT FROM b.n AS equal FROM a FULL JOIN b ON a.scope = b.scope")
def doctor_scopes(spark, d):
    a = memory.entries(spark, d, ["id", "scope"]).groupBy(F.coalesce("scope", F.lit("global")).alias("scope")).agg(F.count("*").alias("n_truth"))
    return a.join(vector_scope_counts(spark, d).withColumnRenamed("n", "n_vectors"), "scope", "full").withColumn("equal", F.col("n_truth").eqNullSafe(F.col("n_vectors")))


@query("WITH t AS (SELECT id, count(*) AS n FROM memory_entries GROUP BY id) SELECT count(*) AS n_ids, sum(n) AS n_rows, sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS extra FROM t")
def duplicate_rows(spark, d):
    t = table(spark, d, "memory_entries").groupBy("id").agg(F.count("*").alias("n"))
    return t.agg(F.count("*").alias("n_ids"), F.sum("n").alias("n_rows"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("extra"))


@query("SELECT id, arg_max(text, updated_at) AS text, max(updated_at) AS updated_at FROM vector_records GROUP BY id")
def latest_vectors(spark, d):
    return memory.latest_versions(table(spark, d, "vector_records").select("id", "text", "updated_at", F.col("updated_at").alias("at")), "id", "at").select("id", "text", "updated_at")


_KEY = sql_line("lower(coalesce(text, ''))")


@query(f"WITH {MEM}, k AS (SELECT id, coalesce(scope, 'global') AS scope, {_KEY} AS key, coalesce(timestamp_ms, 0) AS ts FROM mem), r AS (SELECT *, first_value(id) OVER (PARTITION BY scope, key ORDER BY ts DESC, id) AS canonical_id FROM k WHERE key <> '') SELECT id, canonical_id FROM r WHERE id <> canonical_id")
def exact_dup_compact(spark, d):
    return memory.exact_duplicates(memory.entries(spark, d))


@query(f"WITH {NORM}, r AS (SELECT id, unnest(from_json(j->'$.relations', '[{{\"type\":\"VARCHAR\",\"targetId\":\"VARCHAR\"}}]')) AS r FROM norm WHERE json_type(j, '$.relations') = 'ARRAY') SELECT DISTINCT id, r.targetId AS target_id, r.type AS type FROM r WHERE r.targetId IS NOT NULL")
def relation_edges(spark, d):
    return memory.superseded(memory.normalised(memory.entries(spark, d)))


# --- search and ranking ------------------------------------------------------------------------------------------


@query(f"WITH {MEM}, {QV}, {LEX} SELECT query_id, id, rank, round(score, 6) AS score FROM lex WHERE rank <= 20")
def lexical_topk(spark, d):
    return search.lexical(memory.entries(spark, d), query_rows(spark)).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {NORM}, {QV}, {LEX}, {CHAIN} SELECT query_id, id, rank, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def recall_simple(spark, d):
    m = memory.entries(spark, d)
    ranked = search.simple_chain(search.lexical(m, query_rows(spark)), memory.normalised(m), AS_OF_MS)
    return ranked.select("query_id", "id", "rank", *[F.round(c, 6).alias(c) for c in ("s0", "s1", "s2", "s3", "score")])


@query(f"WITH {NORM}, {QV}, {LEX}, {CHAIN} SELECT query_id, 'search' AS stage, count(*) AS n, round(min(s0), 6) AS low, round(max(s0), 6) AS high FROM x0 GROUP BY 1 UNION ALL SELECT query_id, 'final', count(*), round(min(score), 6), round(max(score), 6) FROM ranked WHERE rank <= 10 GROUP BY 1")
def recall_trace(spark, d):
    m = memory.entries(spark, d)
    hits = search.lexical(m, query_rows(spark))
    return search.trace([("search", hits, "score"), ("final", search.simple_chain(hits, memory.normalised(m), AS_OF_MS), "score")])


BM25 = rf"""d0 AS (SELECT id, timestamp_ms, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS words FROM mem), st AS (SELECT count(*) AS n, avg(len(words)) AS al FROM d0),
qx AS (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM q), tf AS (SELECT id, any_value(timestamp_ms) AS timestamp_ms, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT id, timestamp_ms, len(words) AS dl, unnest(words) AS term FROM d0) WHERE term IN (SELECT term FROM qx) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sc AS (SELECT query_id, id, any_value(timestamp_ms) AS timestamp_ms, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 9) AS raw FROM tf JOIN dfs USING (term) JOIN qx USING (term), st GROUP BY query_id, id),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, timestamp_ms DESC NULLS LAST, id) AS r FROM sc) WHERE r <= 80),
bm AS (SELECT query_id, id, timestamp_ms, raw, CASE WHEN max(raw) OVER p = min(raw) OVER p THEN 1.0 ELSE (raw - min(raw) OVER p) / (max(raw) OVER p - min(raw) OVER p) END AS bm25 FROM pool WINDOW p AS (PARTITION BY query_id))"""


@query(f"WITH {MEM}, {QV}, {BM25} SELECT query_id, id, round(raw, 6) AS raw, round(bm25, 6) AS bm25 FROM bm")
def bm25_topk(spark, d):
    return search.bm25(memory.entries(spark, d), query_rows(spark)).select("query_id", "id", F.round("raw", 6).alias("raw"), F.round("bm25", 6).alias("bm25"))


@query(f"WITH {MEM}, {QV}, {LEX}, {BM25}, b AS (SELECT bm.query_id, bm.id, bm.timestamp_ms, greatest(coalesce(l.score, 0.0), 0.96 * bm25) AS score FROM bm LEFT JOIN (SELECT * FROM lex WHERE rank <= 200) l ON l.query_id = bm.query_id AND l.id = bm.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, timestamp_ms DESC NULLS LAST, id) AS rank FROM b WHERE score > 0) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 20")
def lexical_search(spark, d):
    return search.lexical_search(memory.entries(spark, d), query_rows(spark)).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_COS = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
_EMB = "e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)"
VEC = f"{_EMB}, vs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 / (1 + least(2.0, greatest(0.0, 1 - {_COS}))), 9) AS score FROM e a, e b WHERE a.vec_id % 20 = 0), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs WHERE score >= 0.3)"


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec", "label")


@query(f"WITH {VEC} SELECT query_id, id, rank, round(score, 6) AS score FROM vr WHERE rank <= 10")
def vector_topk(spark, d):
    base, q = _vectors(spark, d)
    return search.vector_search(base, q, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {VEC} SELECT query_id, count(*) FILTER (score > 1 / (1 + 1 - 0.9)) AS duplicates, round(1 - max(2 - 1 / score), 6) AS novelty FROM vr WHERE query_id <> id AND rank <= 20 GROUP BY query_id")
def duplicate_precheck(spark, d):
    base, q = _vectors(spark, d)
    hits = search.vector_search(base, q, 20).where("query_id <> id")
    return hits.groupBy("query_id").agg(F.count(F.when(F.col("score") > 1 / (1 + 1 - 0.9), 1)).alias("duplicates"), F.round(1 - F.max(2 - 1 / F.col("score")), 6).alias("novelty"))


@query()
def mmr_diversity(spark, d):
    base, q = _vectors(spark, d)
    return search.diversified(search.vector_search(base, q, 20), base)


FUSE = "greatest(0.0, least(1.0, CASE WHEN v IS NULL THEN coalesce(b, 0.0) ELSE greatest(0.7 * v + 0.3 * coalesce(b, 0.0), CASE WHEN coalesce(b, 0.0) >= 0.75 THEN 0.92 * coalesce(b, 0.0) ELSE 0.0 END) END))"


@query(f"WITH {NORM}, {QV}, {LEX}, {CHAIN}, pp AS (SELECT query_id, id, rank, least(180, length(coalesce(text, ''))) AS len FROM ranked JOIN mem USING (id) WHERE rank <= 3), pc AS (SELECT query_id, id, rank, least(len, 600 - coalesce(sum(len) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS chars FROM pp) SELECT query_id, id, rank, chars FROM pc WHERE chars > 0")
def pack_context(spark, d):
    m = memory.entries(spark, d)
    return search.packed(search.simple_chain(search.lexical(m, query_rows(spark)), memory.normalised(m), AS_OF_MS), m)


# --- lifecycle ---------------------------------------------------------------------------------------------------

LIFE = f"""{NORM}, l0 AS (SELECT *, greatest(0.0, least(1.0, coalesce(importance, 0.7))) AS imp, CASE WHEN timestamp_ms > 0 THEN timestamp_ms ELSE {AS_OF_MS} END AS created FROM norm),
l1 AS (SELECT *, greatest(0.0, ({AS_OF_MS} - CASE WHEN access_count > 0 THEN last_accessed_at ELSE created END) / 86400000.0) AS days, greatest(0.0, (last_accessed_at - created) / 86400000.0) AS span, ({AS_OF_MS} - created) / 86400000.0 AS age FROM l0),
l2 AS (SELECT *, exp(-(ln(2) / (30 * exp(1.5 * imp))) * pow(days, CASE tier WHEN 'core' THEN 0.8 WHEN 'peripheral' THEN 1.3 ELSE 1.0 END)) AS recency, (1 - exp(-access_count / 5.0)) * CASE WHEN access_count > 1 THEN 0.5 + 0.5 * exp(-(greatest(1.0, span) / greatest(access_count - 1, 1)) / 30) ELSE 1 END AS frequency, imp * confidence AS intrinsic FROM l1),
life AS (SELECT *, 0.4 * recency + 0.3 * frequency + 0.3 * intrinsic AS composite FROM l2)"""


@query(f"WITH {LIFE} SELECT id, tier, round(recency, 6) AS recency, round(frequency, 6) AS frequency, round(intrinsic, 6) AS intrinsic, round(composite, 6) AS composite FROM life")
def decay_scores(spark, d):
    x = lifecycle.decay(memory.normalised(memory.entries(spark, d)), AS_OF_MS)
    return x.select("id", "tier", *[F.round(c, 6).alias(c) for c in ("recency", "frequency", "intrinsic", "composite")])


@query(f"WITH {LIFE} SELECT id, tier, CASE WHEN tier = 'peripheral' AND access_count >= 3 AND composite >= 0.4 THEN 'working' WHEN tier = 'working' AND access_count >= 10 AND composite >= 0.7 AND imp >= 0.8 THEN 'core' WHEN tier = 'working' AND (composite < 0.15 OR (age > 60 AND access_count < 3)) THEN 'peripheral' WHEN tier = 'core' AND composite < 0.15 AND access_count < 3 THEN 'working' ELSE tier END AS next_tier FROM life")
def tier_transition(spark, d):
    return lifecycle.decay(memory.normalised(memory.entries(spark, d)), AS_OF_MS).select("id", "tier", "next_tier")


@query(f"WITH {LIFE} SELECT id, round(composite, 6) AS composite FROM life WHERE composite < 0.3")
def stale_memories(spark, d):
    return lifecycle.stale(lifecycle.decay(memory.normalised(memory.entries(spark, d)), AS_OF_MS)).select("id", F.round("composite", 6).alias("composite"))


@query(f"WITH {LIFE} SELECT id, round(CASE WHEN access_count <= 0 THEN 60.0 ELSE least(180.0, 60 + 30 * ln(1 + access_count * exp(-days * ln(2) / 30))) END, 6) AS half_life FROM life")
def effective_half_life(spark, d):
    x = lifecycle.decay(memory.normalised(memory.entries(spark, d)), AS_OF_MS)
    last = F.when(F.col("access_count") > 0, F.col("last_accessed_at")).otherwise(F.when(F.col("timestamp_ms") > 0, F.col("timestamp_ms")).otherwise(F.lit(AS_OF_MS)))
    days = F.greatest(F.lit(0.0), (F.lit(AS_OF_MS) - last) / F.lit(S.DAY))
    return x.select("id", F.round(S.effective_half_life(60.0, F.col("access_count"), days), 6).alias("half_life"))


@query(f"WITH {LIFE}, {QV}, {LEX.replace('FROM mem', 'FROM norm')}, y AS (SELECT l.query_id, l.id, l.rank AS ord, {sql_trim('f.t')} AS s, l.score / (1 + 0.5 * log2(greatest({sql_len16('f.t')} / 500.0, 1.0))) AS s1, greatest(CASE tier WHEN 'core' THEN 0.9 WHEN 'peripheral' THEN 0.5 ELSE 0.7 END, composite) AS lifted FROM lex l JOIN life f USING (id) WHERE l.rank <= 20), z AS (SELECT *, round(s1 * least(1.0, greatest(0.3, 0.3 + 0.7 * lifted)), 9) AS score FROM y WHERE s1 >= 0.35 AND NOT {_NOISE}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM z) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def recall_lifecycle(spark, d):
    rows = lifecycle.decay(memory.normalised(memory.entries(spark, d)), AS_OF_MS)
    return search.lifecycle_chain(search.lexical(memory.entries(spark, d), query_rows(spark)), rows, AS_OF_MS).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


# --- text gates --------------------------------------------------------------------------------------------------

_C = sql_trim("coalesce(text, '')")
TX = f"{MEM}, tx AS (SELECT id, coalesce(text, '') AS text, {_C} AS s FROM mem)"
_CJK = "regexp_matches(s, '[一-鿿぀-ゟ゠-ヿ가-힯]')"


@query(f"WITH {TX} SELECT id, {_NOISE} AS noise FROM tx")
def noise_filter(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", gates.is_noise(F.col("text")).alias("noise"))


@query(f"WITH {TX} SELECT id, regexp_matches(s, {_s(gates.TRIVIAL)}) AS trivial FROM tx")
def trivial_texts(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", gates.is_trivial(F.col("text")).alias("trivial"))


@query()
def capture_verdict(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", gates.capture_verdict(F.col("text")).alias("verdict"))


_PROMPT = sql_trim("regexp_replace(regexp_replace(regexp_replace(s0, " + ", '', 'g'), ".join(_s(p) for p in gates.PROMPT_HEADS) + ", '', 'g')")


@query(f"WITH {TX.replace('AS s FROM', 'AS s0 FROM')}, ty AS (SELECT id, {_PROMPT} AS s FROM tx) SELECT id, CASE WHEN {sql_any('s', gates.FORCE)} THEN false WHEN {sql_len16('s')} < 5 THEN true WHEN {sql_any('s', gates.SKIP)} THEN true ELSE {sql_len16('s')} < CASE WHEN {_CJK} THEN 6 ELSE 15 END AND NOT (contains(s, '?') OR contains(s, '？')) END AS skip FROM ty")
def should_skip(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", gates.should_skip(F.col("text")).alias("skip"))


@query(f"WITH {TX} SELECT id, CASE " + " ".join(f"WHEN {sql_any('lower(text)', p)} THEN {_s(k)}" for k, p in gates.CATEGORY.items()) + " ELSE 'other' END AS detected FROM tx")
def category_detect(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", gates.category(F.col("text")).alias("detected"))


@query(f"WITH {TX}, i AS (SELECT id, CASE WHEN s = '' THEN 'empty' " + " ".join(f"WHEN {sql_any('s', p)} THEN {_s(k)}" for k, (p, _, _) in gates.INTENT.items()) + " ELSE 'broad' END AS label FROM tx) SELECT id, label, CASE label " + " ".join(f"WHEN {_s(k)} THEN {_s(dp)}" for k, (_, _, dp) in gates.INTENT.items()) + " ELSE 'l0' END AS depth FROM i")
def intent(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", gates.intent(F.col("text")).alias("i")).select("id", "i.label", "i.depth")


_LONG = f"{sql_len16('s')} > CASE WHEN {_CJK} THEN 30 ELSE 80 END"
_VALUE = f"CASE WHEN s = '' THEN 'empty' WHEN {sql_any('s', gates.TOOL)} THEN 'tool_call' WHEN {sql_any('s', gates.CORRECTION)} THEN 'correction' WHEN {sql_any('s', gates.DECISION)} THEN 'decision' WHEN {sql_any('s', gates.ACKNOWLEDGED)} THEN 'acknowledgment' WHEN {_LONG} AND regexp_matches(s, '^<[a-z-]+>') AND regexp_matches(s, '</[a-z-]+>\\s*\\z') THEN 'system_xml' WHEN {_LONG} THEN 'substantive' WHEN contains(s, '?') OR contains(s, '？') THEN 'short_question' ELSE 'short_statement' END"


@query(f"WITH {TX} SELECT id, {_VALUE} AS reason FROM tx")
def text_value(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", gates.text_value(F.col("text"))["reason"].alias("reason"))


@query(f"WITH dx AS (SELECT session_key, doc_id, coalesce(text, '') AS t, {sql_trim(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS s FROM documents WHERE session_key IS NOT NULL), g AS (SELECT session_key, max(CASE WHEN regexp_matches(t, '(?i)\\b(remember|recall|don''?t forget|note that|keep in mind)\\b') OR regexp_matches(t, '(记住|記住|别忘|不要忘|记一下|記一下)') THEN 0.5 ELSE 0 END) + max(CASE WHEN {sql_any('t', gates.TOOL)} THEN 0.4 ELSE 0 END) + max(CASE WHEN {sql_any('t', [*gates.CORRECTION[1:], *gates.DECISION])} THEN 0.3 ELSE 0 END) + CASE WHEN sum(CASE WHEN length(s) > 20 THEN length(t) ELSE 0 END) > 200 THEN 0.2 ELSE 0 END + CASE WHEN count(*) > 6 THEN 0.1 ELSE 0 END AS v FROM dx GROUP BY session_key) SELECT session_key, round(least(1.0, v), 6) AS value FROM g")
def conversation_value(spark, d):
    t = F.coalesce("text", F.lit(""))
    x = table(spark, d, "documents").where("session_key is not null").select("session_key", t.alias("t"), T.trim(t).alias("s"))
    meant = T.any_of(F.col("t"), [r"(?i)\b(remember|recall|don'?t forget|note that|keep in mind)\b", "(记住|記住|别忘|不要忘|记一下|記一下)"])
    flag = lambda c, v: F.max(F.when(c, v).otherwise(0.0))
    long = F.when(F.sum(F.when(F.length("s") > 20, F.length("t")).otherwise(0)) > 200, 0.2).otherwise(0.0)
    many = F.when(F.count("*") > 6, 0.1).otherwise(0.0)
    v = flag(meant, 0.5) + flag(T.any_of(F.col("t"), gates.TOOL), 0.4) + flag(T.any_of(F.col("t"), [*gates.CORRECTION[1:], *gates.DECISION]), 0.3) + long + many
    return x.groupBy("session_key").agg(F.round(F.least(F.lit(1.0), v), 6).alias("value"))


@query()
def redacted_texts(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", gates.redacted(F.col("text")).alias("text"))


@query(f"WITH {TX} SELECT DISTINCT {sql_line(chr(114) + 'egexp_replace(lower(text), ' + chr(39) + '[0-9]+(\\.[0-9]+)?' + chr(39) + ', ' + chr(39) + '#' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS reason FROM tx")
def reason_keys(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select(gates.reason_key(F.col("text")).alias("reason")).distinct()


@query(r"WITH f AS (SELECT doc_id, CASE WHEN len(tk) > 0 THEN list_distinct(list_concat(tk, flatten([[substring(t, i, 3) FOR i IN range(1, length(t) - 1)] FOR t IN tk IF length(t) > 3]))) WHEN low <> '' THEN [substring(low, 1, 64)] ELSE [] END AS fs FROM (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}|[㐀-鿿]+') AS tk FROM documents)), h AS (SELECT doc_id, sha1(unnest(fs)) AS h FROM f), w AS (SELECT doc_id, (('0x' || substring(h, 1, 8))::BIGINT % 256)::INT AS idx, sum(CASE WHEN ('0x' || substring(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS w FROM h GROUP BY 1, 2) SELECT doc_id, count(*) AS n, sum(w * w)::BIGINT AS norm2, sum(w * idx)::BIGINT AS checksum FROM w WHERE w <> 0 GROUP BY doc_id")
def local_hash_embedding(spark, d):
    x = embed.hashed(table(spark, d, "documents"), "doc_id", "text")
    return x.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("w")).alias("norm2"), F.sum(F.col("w") * F.col("idx")).alias("checksum"))


# --- governance, admission, reflection, groups, streams ---------------------------------------------------------


@query(f"""WITH {NORM}, r AS (SELECT id, confidence, list_filter([CASE WHEN state = 'rejected' THEN 'inactive_lifecycle:rejected' END, CASE WHEN lifecycle IN ('superseded', 'obsolete', 'rejected') THEN 'inactive_lifecycle:' || lifecycle END, CASE WHEN state = 'archived' OR layer = 'archive' OR lifecycle = 'archived' THEN 'archive_review' END, CASE WHEN layer = 'working' OR coalesce(category, '') = 'other' THEN 'local_or_working_scratch' END, CASE WHEN source = 'auto-capture' AND confidence < 0.72 THEN 'raw_or_low_confidence_auto_capture' END, CASE WHEN source = 'legacy' THEN 'legacy_metadata_review' END, CASE WHEN confidence < 0.55 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS rs FROM norm) SELECT id, array_to_string(rs, ',') AS reasons, CASE WHEN len(list_filter(rs, lambda x: starts_with(x, 'inactive_lifecycle') OR x = 'archive_review')) > 0 THEN 'archive' WHEN list_contains(rs, 'low_confidence') THEN 'promote' ELSE 'review' END AS action FROM r WHERE len(rs) > 0""")
def governance_candidates(spark, d):
    return governance.review_candidates(memory.normalised(memory.entries(spark, d))).select("id", F.array_join("reasons", ",").alias("reasons"), "action")


@query()
def conflict_pairs(spark, d):
    return governance.conflicts(memory.entries(spark, d))


@query(f"WITH {NORM}, ad AS (SELECT memory_category AS category, json_extract_string(j, '$.admission.decision') AS decision, TRY_CAST(json_extract_string(j, '$.admission.score') AS DOUBLE) AS score FROM norm) SELECT category, count(*) FILTER (score >= 0.45) AS admitted, count(*) FILTER (score < 0.45) AS rejected, round(count(*) FILTER (score < 0.45) / count(*), 6) AS reject_rate FROM ad WHERE score IS NOT NULL GROUP BY category")
def admission_breakdown(spark, d):
    x = memory.normalised(memory.entries(spark, d)).select(F.col("memory_category").alias("category"), F.try_variant_get("extra", "$.admission.score", "double").alias("score")).where("score is not null")
    return admission.breakdown(x.select("category", admission.decision(F.col("score")).alias("decision")))


@query(f"WITH {NORM} SELECT CAST(coalesce(sum((timestamp_ms >= {AS_OF_MS} - 86400000)::INT), 0) AS BIGINT) AS last_24h, CAST(coalesce(sum((timestamp_ms >= {AS_OF_MS} - 604800000)::INT), 0) AS BIGINT) AS last_7d, count(*) AS total FROM norm")
def admission_windows(spark, d):
    return admission.windows(memory.entries(spark, d), "timestamp_ms", AS_OF_MS)


@query("WITH e AS (SELECT event_type AS line, epoch_us(ts) // 1000 AS t_ms FROM events), r AS (SELECT lower(line) AS key, round(sum(0.95 / (1 + exp(0.65 * (greatest(0.0, (1712000000000 - t_ms) / 86400000.0) - 7)))), 9) AS score, max(t_ms) AS last_ms FROM e GROUP BY 1) SELECT key, round(score, 6) AS score, last_ms FROM r")
def reflection_rank(spark, d):
    lines = table(spark, d, "events").select(F.col("event_type").alias("line"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return reflection.ranked(lines, AS_OF_MS, limit=None).select("key", F.round("score", 6).alias("score"), F.col("at").alias("last_ms"))


@query()
def batch_dedup(spark, d):
    return groups.batch_dedup(table(spark, d, "dedup_candidates"))


@query()
def compaction(spark, d):
    return groups.compaction(table(spark, d, "compaction_entries")).drop("members")


@query()
def compressed_sessions(spark, d):
    return groups.compressed(table(spark, d, "documents"), "session_key", "doc_id", "text")


@query()
def chunked_documents(spark, d):
    return chunking.chunked(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT count(*) AS n, count(*) FILTER (value IS NULL) AS no_value, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events")
def retrieval_stats(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("no_value"), F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id AS key, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def access_sessions(spark, d):
    x = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.access_sessions(x, idle="1 hour").select("key", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH e AS (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) SELECT user_id AS key, start, count(*) AS n, count(*) > 30 AS limited FROM e GROUP BY 1, 2")
def rate_windows(spark, d):
    x = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.rate_windows(x).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(r"WITH d AS (SELECT doc_id, unnest(list_distinct([regexp_replace(u, '[.,;:!?。！？、，；：)\]}）]+\z', '') FOR u IN regexp_extract_all(coalesce(text, ''), '(?i)https?://[^\s<>''\"\])}，。；、]+')])) AS url FROM documents) SELECT doc_id, url FROM d")
def document_urls(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(extract.urls(F.col("text"))).alias("url"))


@query()
def document_artifacts(spark, d):
    return extract.artifacts(table(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT doc_id, list_sort(list_distinct([lower(t) FOR t IN regexp_extract_all(coalesce(text, ''), '(?i)(?:proj|env|team|scope):[A-Za-z0-9_-]+')]))::VARCHAR AS tags FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)(?:proj|env|team|scope):[A-Za-z0-9_-]+')")
def tag_tokens(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.array_sort(extract.tags(F.col("text"))).alias("t")).where(F.size("t") > 0)
    return x.select("doc_id", F.concat(F.lit("["), F.array_join("t", ", "), F.lit("]")).alias("tags"))


@query()
def sanitized_texts(spark, d):
    return memory.entries(spark, d, ["id", "text"]).select("id", extract.sanitized(F.col("text")).alias("text"))


@query(rf"""WITH {TX}, l AS (SELECT id, {sql_trim("unnest(string_split(text, chr(10)))")} AS line FROM tx), b AS (SELECT DISTINCT id, {sql_trim("regexp_replace(regexp_replace(substring(line, 2), '[*][*]', '', 'g'), '(?i)^(invariants?|reflections?|derived)[:：]\\s*', '')")} AS line FROM l WHERE regexp_matches(line, '^[-*]\s')), s AS (SELECT id, line, CASE WHEN regexp_matches(line, {_s(extract.DELTA)}) THEN 'derived' WHEN regexp_matches(line, {_s(extract.RULE)}) THEN 'invariant' END AS kind FROM b WHERE line <> '' AND NOT regexp_matches(line, {_s(extract.PLACEHOLDER)}) AND NOT {sql_any("line", extract.UNSAFE)}) SELECT id, kind, count(*) AS n FROM s WHERE kind IS NOT NULL GROUP BY id, kind""")
def reflection_slices(spark, d):
    lines = memory.entries(spark, d, ["id", "text"]).select("id", F.explode(reflection.bullets(F.regexp_replace("text", "\r", ""))).alias("line"))
    return extract.slices(lines.distinct()).distinct().groupBy("id", "kind").agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT doc_id AS path, lower(coalesce(text, '')) AS h FROM documents), s AS (SELECT path, round(least(0.99, 0.1 + CASE WHEN contains(h, 'search panel') THEN 0.35 ELSE 0.0 END + least(0.55, (contains(h, 'search')::INT + contains(h, 'panel')::INT) / 2.0)), 6) AS score, contains(h, 'search') OR contains(h, 'panel') AS hit FROM q) SELECT path, score FROM s WHERE hit AND score >= 0.15 ORDER BY score DESC, path LIMIT 20")
def file_search(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return extract.search_files(files, "search panel", 20).select("path", "score")


@query()
def ingest_verdicts(spark, d):
    return writes.ingested(memory.entries(spark, d, ["id", "text"])).groupBy("verdict", "detected").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT DISTINCT id FROM memory_entries), v AS (SELECT DISTINCT id FROM vector_records) SELECT id, 'embed' AS action FROM t WHERE id NOT IN (SELECT id FROM v) UNION ALL SELECT id, 'delete' FROM v WHERE id NOT IN (SELECT id FROM t)")
def repair_plan(spark, d):
    return writes.repair_plan(memory.entries(spark, d, ["id"]), table(spark, d, "vector_records"))


@query(f"WITH {NORM}, h AS (SELECT id, CASE WHEN json_extract_string(j, '$.memory_category') IS NULL AND category = 'other' AND coalesce(importance, 0.7) < 0.5 THEN 'archive' WHEN json_extract_string(j, '$.memory_category') IS NULL THEN 'normalise' ELSE 'keep' END AS action FROM norm) SELECT action, count(*) AS n FROM h GROUP BY action")
def hygiene_counts(spark, d):
    return writes.hygiene(memory.normalised(memory.entries(spark, d))).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {NORM}, k AS (SELECT id, memory_category, {_CLEAN} AS c, coalesce(scope, 'global') AS scope, coalesce(timestamp_ms, 0) AS ts FROM norm WHERE memory_category IN ('preferences', 'entities')), f AS (SELECT id, scope || '|' || memory_category || ':' || c AS fact, ts FROM k WHERE c <> '') SELECT id, lead(id) OVER w AS superseded_by, lead(ts) OVER w AS valid_to FROM f WINDOW w AS (PARTITION BY fact ORDER BY ts, id)")
def version_chains(spark, d):
    """Versions of one fact of a scope: each holds until the next one."""
    x = memory.normalised(memory.entries(spark, d)).withColumn("fact", memory.fact_key(F.col("memory_category"), F.col("l0"))).where("fact is not null")
    x = x.select("id", F.concat_ws("|", F.coalesce("scope", F.lit("global")), "fact").alias("fact"), F.coalesce("timestamp_ms", F.lit(0)).alias("ts"))
    return governance.versions(x, "fact", "ts").select("id", "superseded_by", "valid_to")


@query()
def support_stats(spark, d):
    entries = memory.entries(spark, d)
    rows = nesting.shred(entries, "id", "metadata").where(F.col("table") == "$.support_info.slices").dropDuplicates(["id", "node_path"])
    get = lambda k, t: F.col("values")[k].try_cast(t)
    x = rows.select("id", F.coalesce(F.col("values")["context"], F.lit("general")).alias("context"), get("confirmations", "bigint").alias("confirmations"), get("contradictions", "bigint").alias("contradictions"), get("last_observed_at", "bigint").alias("last_observed_at"))
    return governance.support(x)


@query("WITH a AS (SELECT * FROM (VALUES ('main', 'agent:main'), ('main', 'global'), ('guest', 'global')) AS v(agent, scope)) SELECT agent, count(DISTINCT id) AS n FROM (SELECT DISTINCT id, coalesce(scope, 'global') AS scope FROM memory_entries) m JOIN a ON m.scope = a.scope GROUP BY agent")
def agent_access(spark, d):
    access = scopes.access_table(spark, {"main": ["agent:main", "global"], "guest": ["global"]})
    return scopes.visible(memory.entries(spark, d, ["id", "scope"]), access).groupBy("agent").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
