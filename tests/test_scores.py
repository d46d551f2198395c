"""Golden numbers of the score functions, and text gates on literal cases."""

import pytest
from pyspark.sql import functions as F

from loam.functions import scores as S
from loam.operators import admission, gates, governance, reflection

NOW = 1_700_000_000_000
DAY = 86_400_000


L = F.lit
def cases():
    return [
        (S.fuse(L(0.6), L(0.4)), 0.54),
        (S.fuse(L(0.4), L(0.8)), 0.736),
        (S.fuse(L(0.95), L(0.8)), 0.905),
        (S.fuse(L(None).cast("double"), L(0.55)), 0.55),
        (S.vector_score(L(1.0)), 1.0),
        (S.vector_score(L(0.0)), 0.5),
        (S.vector_score(L(-1.0)), 1 / 3),
        (S.rerank_cosine(L(0.6), L(0.8)), 0.66),
        (S.rerank(L(0.6), L(0.1), L(0.8)), 0.57),
        (S.rerank(L(0.6), L(None).cast("double"), L(0.3)), 0.48),
        (S.recency_boost(L(0.5), L(NOW - 14 * DAY), NOW), 0.536788),
        (S.importance_weight(L(0.5), L(0.5)), 0.425),
        (S.length_norm(L(1.0), L(400)), 1.0),
        (S.length_norm(L(1.0), L(1000)), 0.666667),
        (S.length_norm(L(1.0), L(2000)), 0.5),
        (S.time_decay(L(1.0), L(60.0), L(60.0)), 0.68394),
        (S.effective_half_life(60.0, L(10), L(0.0)), 131.936858),
        (S.effective_half_life(60.0, L(10), L(30.0)), 113.752784),
        (S.effective_half_life(60.0, L(10000), L(0.0)), 180.0),
        (S.weibull_recency(L(0.7), L(30.0), L("working")), 0.784618),
        (S.weibull_recency(L(0.7), L(30.0), L("core")), 0.884392),
        (S.weibull_recency(L(0.7), L(30.0), L("peripheral")), 0.510225),
        (S.weibull_recency(L(0.0), L(30.0), L("working")), 0.5),
        (S.frequency(L(0), L(0.0)), 0.0),
        (S.frequency(L(1), L(0.0)), 0.181269),
        (S.frequency(L(10), L(18.0)), 0.836782),
        (S.composite(L(0.784618), L(0.836782), L(0.49)), 0.711882),
        (S.decay_boost(L(1.0), L(0.711882), L("working")), 0.798317),
        (S.decay_boost(L(1.0), L(0.2), L("peripheral")), 0.65),
        (S.reflection_score(L(7.0), L(7.0), L(0.65), L(1.0), L(0.95), L(False)), 0.475),
        (S.reflection_score(L(0.0), L(45.0), L(0.22), L(1.1), L(1.0), L(True)), 0.824959),
        (reflection.line_quality(L(0)), 0.2),
        (reflection.line_quality(L(3)), 0.775),
        (reflection.line_quality(L(9)), 1.0),
        (admission.recency_gap(L(14.0), 14.0), 0.5),
        (admission.score(L(0.5), L(0.4), L(0.6), L(1.0), L("preferences")), 0.79),
        (governance.similarity(F.array(L("a1"), L("b1"), L("c1")), F.array(L("b1"), L("c1"))), 1.0),
    ]


def test_golden_numbers(spark):
    all_cases = cases()
    row = spark.range(1).select(*[c.cast("double").alias(f"c{i}") for i, (c, _) in enumerate(all_cases)]).first()
    for i, (_, want) in enumerate(all_cases):
        assert row[i] == pytest.approx(want, abs=2e-6), i


def test_tiers(spark):
    rows = [("peripheral", 3, 0.4, 0.5, 1.0, "working"), ("working", 10, 0.7, 0.8, 1.0, "core"), ("working", 2, 0.5, 0.5, 61.0, "peripheral"), ("core", 2, 0.1, 0.9, 1.0, "working"), ("core", 5, 0.1, 0.9, 1.0, "core")]
    df = spark.createDataFrame(rows, "tier string, n int, c double, i double, age double, want string")
    assert df.where(S.next_tier(F.col("tier"), F.col("n"), F.col("c"), F.col("i"), F.col("age")) != F.col("want")).count() == 0


GATES = [
    ("ok!", True, "trivial", True), ("谢谢", True, "trivial", True), (None, True, "empty", True), ("", True, "empty", True),
    ("I don't have any information about that topic", True, "allowed", False), ("The user prefers green tea in the morning", False, "allowed", False),
    ("api_key = ABCD1234efgh5678ZZ99", False, "secret", True), ("token=your-key-placeholder-example", False, "allowed", False), ("did I tell you about the plan?", True, "allowed", False),
]


def test_gates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(GATES)], "i int, t string")
    got = {r.i: r for r in df.select("i", gates.is_noise(F.col("t")).alias("noise"), gates.capture_verdict(F.col("t")).alias("verdict")).collect()}
    for i, (text, noise, verdict, _) in enumerate(GATES):
        assert (got[i].noise, got[i].verdict) == (noise, verdict), text


REFUSED = [
    ("x <relevant-memories> y", "injected"), ("[UNTRUSTED DATA a]\nb\n[END UNTRUSTED DATA]", "injected"), ("openclaw runtime context for this turn: x", "injected"), ("a\n## OpenClaw Workspace Context\nb", "injected"),
    ("Conversation info (untrusted metadata): x", "injected"), ("Sender (untrusted metadata): x", "injected"), ('so ```json\n{"message_id": 1,\n"sender_id": 2}\n```', "injected"), ('so ```json\n{"sender_id": 1,\n"message_id": 2}\n```', "allowed"),
    ("hm\nSystem: [10:00] Exec completed (x)", "wrapper"), ("A new session was started via /new or /reset. Go", "wrapper"), ("hm\ncurrent user request: tea", "wrapper"), ("hm, current user request: tea", "allowed"),
    ("Turn Context (split turn): x", "compaction"), ("so\n## Open TODOs\n- tea", "compaction"), ("so\n## Critical Context\n- tea", "compaction"), ("so\n## goal\n- tea", "allowed"),
    ("password: ab#12xy", "secret"), ("pwd = 'ab 12#xy z'", "secret"), ("password: abcdef", "allowed"), ("username: tom, password: abcdef", "secret"), ("账号：tom 密码：abc123x", "secret"), ("令牌是abcdefgh1234", "secret"), ("password: example#12", "allowed"),
    ("## Goal\nResult: Command done", "trace"), ("<relevant-memories>\npassword: ab#12xy", "injected"),
]


def test_refusals(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REFUSED)], "i int, t string")
    got = {r.i: r.verdict for r in df.select("i", gates.capture_verdict(F.col("t")).alias("verdict")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(REFUSED)] == REFUSED


def test_values_and_intents(spark):
    df = spark.createDataFrame([("no, that is wrong",), ("thanks",), ("what is the config of the api?",), ("why did we choose this?",), ("hm",)], "t string")
    got = [(r[0], r[1]) for r in df.select(gates.text_value(F.col("t"))["reason"], gates.intent(F.col("t"))["label"]).collect()]
    assert got == [("correction", "broad"), ("acknowledgment", "broad"), ("short_question", "fact"), ("short_question", "decision"), ("short_statement", "broad")]


def test_redaction(spark):
    df = spark.createDataFrame([("Bearer abcdef123456 and a@b.org under /home/me/x",)], "t string")
    assert df.select(gates.redacted(F.col("t"))).first()[0] == "Bearer [REDACTED] and [REDACTED] under [REDACTED]"


def test_rouge():
    assert admission.rouge_l(["a", "b", "c"], ["a", "c"]) == pytest.approx(0.8)
    assert admission.rouge_l([], ["a"]) == 0.0
