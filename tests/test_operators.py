"""Core operators against brute force on small tables, and edge cases."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loam.functions import embed
from loam.operators import chunking, groups, memory, nesting, search
from loam.sources import io
from loam.streaming import state

TABLES = "region nation customer supplier part orders lineitem events documents embeddings memory_entries vector_records stored_chunks dedup_candidates compaction_entries eval_items mix_targets toxicity_labels".split()
CHEAP = ["store_stats", "scope_filter", "scope_deny_all", "metadata_normalised", "active_filter", "vector_drift", "lexical_topk", "recall_simple", "bm25_topk", "vector_topk", "recall_hybrid", "recall_scoped", "migration_plan", "retry_reasons", "index_report", "decay_scores", "tier_transition", "noise_filter", "should_skip", "intent", "governance_candidates", "local_hash_embedding", "access_sessions", "reflection_rank"]


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = entry.queries()[name](spark, data).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(str([None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist())
    assert len(got) == len(want) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_reason_keys_of_any_length(spark, tmp_path):
    text = "  Score 0.31 under 12 for " + "a long reason, " * 40 + "END "
    spark.createDataFrame([("a", text), ("b", text.replace("12", "7")), ("c", "Score 3"), ("d", None)], "id string, text string").write.parquet(str(tmp_path / "memory_entries.parquet"))
    got = {r.reason for r in entry.queries()["reason_keys"](spark, str(tmp_path)).collect()}
    assert got == {"", "score #", ("score # under # for " + "a long reason, " * 40 + "end")}


def test_shared_inlining(spark):
    recs = [
        ("a", json.dumps({"x": 1, "one": {"deep": {"z": "q"}}, "kids": [{"n": 1, "kids": [{"n": 2}]}, 7, {"n": 3}], "tags": ["u", "v"]})),
        ("b", json.dumps({"kids": {"n": 9}})), ("c", '{"kids": [{"n": 1}'), ("d", ""), ("e", None), (None, json.dumps({"x": 5})),
        ("f", json.dumps(json.dumps({"kids": json.dumps([{"n": 4}])}))), ("a", json.dumps({"x": 1, "one": {"deep": {"z": "q"}}, "kids": [{"n": 1, "kids": [{"n": 2}]}, 7, {"n": 3}], "tags": ["u", "v"]})),
    ]
    df = spark.createDataFrame(recs, "id string, meta string").withColumn("table", F.lit(1)).withColumn("values", F.lit(2))
    out = nesting.tables(df, "id", "meta")
    assert sorted(out) == ["$", "$.kids"]
    kids = {(r._id, r._row): (r._parent, r._position, r.n) for r in out["$.kids"].collect()}
    assert kids == {("a", "kids[0]"): ("", 0, 1), ("a", "kids[0].kids[0]"): ("kids[0]", 0, 2), ("a", "kids[2]"): ("", 2, 3), ("b", "kids[0]"): ("", 0, 9), ("f", "kids[0]"): ("", 0, 4)}
    root = {r._id: r for r in out["$"].collect()}
    assert root["a"]["one.deep.z"] == "q" and root["a"]["x"] == 1 and root["a"]["tags"] == '["u","v"]' and "c" not in root


def test_many_shapes_and_maps(spark):
    """Every set of optional fields is one schema; keys that are data stay a value; signs of paths in keys are escaped."""
    recs = [(f"s{k}", json.dumps({"o": {f"f{b}": 1 for b in range(12) if k >> b & 1}})) for k in range(1500)]
    recs += [(f"m{k}", json.dumps({"by": {f"key{k}-{x}": {"deep": x} for x in range(5)}})) for k in range(300)]
    recs += [("e", json.dumps({"a.b": [{"c[]": 1}]}))]
    df = spark.createDataFrame(recs, "id string, meta string")
    out = nesting.tables(df, "id", "meta")
    assert sorted(out) == ["$", "$.a%2Eb"] and out["$.a%2Eb"].first()["c%5B%5D"] == 1
    root = out["$"]
    assert {f"o.f{b}" for b in range(11)} <= set(root.columns) and len(root.columns) < 40
    assert json.loads(root.where("_id = 'm7'").first()["by"])["key7-4"] == {"deep": 4}


def test_inlining_empty(spark):
    df = spark.createDataFrame([], "id string, meta string")
    assert nesting.shred(df, "id", "meta").count() == 0


def test_p5_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/memory_entries.parquet").select("id", "metadata").distinct().collect()
    steps = {"relations": {"history": {}}, "support_info": {"slices": {"evidence": {"spans": {}}}}, "artifacts": {"refs": {}}}

    def un(v):
        while isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            if not isinstance(w, (dict, list, str)):
                return v
            v = w
        return v

    want = set()

    def walk(i, o, at, names):
        for k, below in names.items():
            v = un(o.get(k)) if isinstance(o, dict) else None
            p = f"{at}.{k}" if at else k
            if k == "support_info":
                walk(i, v, p, below)
                continue
            for n, x in enumerate(v if isinstance(v, list) else [v]):
                x = un(x)
                if isinstance(x, dict):
                    want.add((i, f"{p}[{n}]"))
                    walk(i, x, f"{p}[{n}]", below)

    for r in rows:
        try:
            o = un(json.loads(r.metadata)) if r.metadata else None
        except ValueError:
            continue
        if isinstance(o, dict):
            walk(r.id, o, "", steps)
    got = {tuple(r) for r in entry.queries()["p5_found"](spark, data).collect()}
    assert got == want and len(want) > 100


def test_scope_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, scope string")
    ids = lambda s: sorted(r.id for r in df.where(memory.in_scopes(s)).collect())
    assert (ids(None), ids([]), ids(["a"]), ids([" "])) == ([1, 2, 3], [], [1, 2], [])


def test_chunks_cover_the_text():
    text = ("A sentence here. Another one follows! " * 300) + "x" * 9000 + "\n" * 120
    got = chunking.chunks(text)
    assert all(0 < e - s <= 4000 for s, e in got)
    assert all(not text[e:s2].strip() for (_, e), (s2, _) in zip(got, got[1:]) if s2 > e)
    assert chunking.chunks(None) == [] and chunking.chunks("  ") == [] and chunking.chunks("abc") == [(0, 3)]


def test_batch_dedup(spark):
    rows = [(1, 0, 10, [1.0, 0.0]), (1, 1, 11, [0.99, 0.01]), (1, 2, 12, [0.0, 1.0]), (1, 3, 13, None), (1, 4, 14, []), (2, 0, 15, [1.0, 0.0]), (1, 0, 10, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "batch_no int, idx int, cand_id long, vector array<double>")
    got = {r.cand_id: r.duplicate_of for r in groups.batch_dedup(df).collect()}
    assert got == {10: None, 11: 10, 12: None, 13: None, 14: None, 15: None}


def test_compaction_merges(spark):
    rows = [("a", "s", "one\ntwo", "fact", 0.5, [1.0, 0.0]), ("b", "s", "Two\nthree", "fact", 0.9, [1.0, 0.01]), ("c", "s", "x", "other", 0.2, [0.0, 1.0]), ("d", "t", "x", None, None, [1.0, 0.0]), ("e", None, "x", "fact", 0.1, [1.0, 0.0])]
    got = groups.compaction(spark.createDataFrame(rows, "id string, scope string, text string, category string, importance double, vector array<double>")).collect()
    assert [(r.seed, r.size, r.text, r.importance, r.category) for r in got] == [("b", 2, "Two\nthree\none", 0.9, "fact")]


def test_compaction_of_large_scopes(spark):
    """Scopes of several blocks, in which like vectors differ in signs, against the seed order by brute force."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 16)), 5, 0) + rng.normal(size=(300, 16)) * 0.35
    x[:60] = x[0] + rng.normal(size=(60, 16)) * 0.1
    rows = [(f"r{i:03}", "st"[i % 7 == 0], f"line {i % 11}", "fact", float(rng.integers(0, 5)) / 5, x[i].tolist()) for i in range(300)]
    units = {r[0]: np.array(r[5]) / np.linalg.norm(r[5]) for r in rows}
    want: dict[str, list[str]] = {}
    scope = {r[0]: r[1] for r in rows}
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        near = next((s for s in want if scope[s] == r[1] and units[s] @ units[r[0]] >= 0.88), r[0])
        want.setdefault(near, []).append(r[0])
    want = {s: m for s, m in want.items() if len(m) > 1}
    df = spark.createDataFrame(rows, "id string, scope string, text string, category string, importance double, vector array<double>")
    for block in (40, 5_000):
        assert {r.seed: r.members for r in groups.compaction(df, block=block).collect()} == want
    assert len({len(m) for m in want.values()}) > 3


def test_kept_texts():
    assert groups.kept_texts(["aa", "bb", "cc"], [0.4] * 3, ["x"] * 3, 100) == [0, 1, 2]
    assert groups.kept_texts(["a" * 10] * 5, [0.4, 1.0, 0.4, 0.9, 0.4], ["", "tool_call", "", "", ""], 40) == [0, 1, 2, 4]


def test_mmr(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, id int, rank int")
    vecs = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0])], "id int, vec array<double>")
    assert [r.id for r in search.diversified(hits, vecs).orderBy("new_rank").collect()] == [10, 12, 11]


def test_embedding_is_a_unit_vector(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "!!")], "id int, t string")
    got = {r.id: r.vec for r in embed.embedded(df, "id", "t").collect()}
    assert set(got) == {1, 4} and sum(x * x for x in got[1]) == pytest.approx(1.0)
    cells = {(r.idx, r.w) for r in embed.hashed(spark.createDataFrame([(1, "hello")], "id int, t string"), "id", "t").collect()}
    assert (29, 1) in cells and (214, -1) in cells


def test_streams_equal_batches(spark, tmp_path, data):
    ev = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    got = state.run_to_table(state.rate_windows(stream), "rates", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.rate_windows(ev).collect()))


def test_export_import(spark, tmp_path):
    rows = [("a", "text one", "fact", "s", 2.0, 1, "{}"), ("b", "x", "odd", None, None, 2, None), ("c", "text three", "odd", None, None, 3, None)]
    df = spark.createDataFrame(rows, "id string, text string, category string, scope string, importance double, timestamp_ms long, metadata string")
    io.export_json(df, str(tmp_path / "out"))
    back = {r.id: (r.category, r.scope, r.importance) for r in io.import_json(spark, str(tmp_path / "out")).collect()}
    assert back == {"a": ("fact", "s", 1.0), "c": ("other", "global", 0.7)}
    assert io.import_json(spark, str(tmp_path / "out"), df.where("id = 'a'")).count() == 1


def test_transcripts(spark, tmp_path):
    lines = [{"type": "message", "message": {"role": "user", "content": "hi"}}, {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}, {"type": "image"}]}}, {"type": "other"}, {"type": "message", "message": {"role": "system", "content": "s"}}]
    (tmp_path / "s.jsonl").write_text("\n".join([*map(json.dumps, lines), "broken {"]))
    assert [(r.role, r.text) for r in io.transcripts(spark, str(tmp_path / "s.jsonl")).orderBy("n").collect()] == [("user", "hi"), ("assistant", "yo")]


def test_predicates_reach_the_scan(spark, data):
    plan = spark.read.parquet(f"{data}/memory_entries.parquet").where(memory.in_scopes(["agent:main"])).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "vector" not in plan.split("ReadSchema")[1]
