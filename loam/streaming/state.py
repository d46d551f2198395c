"""Stateful behaviour over event streams, with watermarks; each works on a stream and on a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LATE = "10 minutes"


def _marked(events: DataFrame, ts: str) -> DataFrame:
    return events.withWatermark(ts, LATE) if events.isStreaming else events


def access_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", idle: str = "5 seconds") -> DataFrame:
    """(key, start, end, n): accesses that follow one another within ``idle`` are flushed together."""
    x = _marked(events, ts).groupBy(F.session_window(ts, idle).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return x.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_windows(events: DataFrame, key: str = "user_id", ts: str = "ts", width: str = "1 hour", slide: str = "30 minutes", most: int = 30) -> DataFrame:
    """(key, start, n, limited): events in sliding windows, and whether they exceed the limit."""
    x = _marked(events, ts).groupBy(F.window(ts, width, slide).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return x.select("key", F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("limited"))


def distinct_errors(events: DataFrame, signature: str, ts: str = "ts") -> DataFrame:
    """The first event of each signature within the watermark; of a table, within all of it."""
    if events.isStreaming:
        return events.withWatermark(ts, LATE).dropDuplicatesWithinWatermark([signature])
    rest = [c for c in events.columns if c != signature]
    return events.groupBy(signature).agg(F.min_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("r")).select(signature, "r.*")


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query over what is there now, into a memory table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def recent_texts(messages: DataFrame, keep: int = 6) -> DataFrame:
    """(conversation, texts): the last ``keep`` texts of each conversation (conversation, n, text), in order.

    A stream keeps them in state and gives a conversation's list again after each batch that adds to it."""
    if not messages.isStreaming:
        x = messages.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("t"))
        return x.select("conversation", F.transform(F.slice(F.reverse("t"), 1, keep), lambda r: r["text"]).alias("r")).select("conversation", F.reverse("r").alias("texts"))

    def step(key, batches, state):
        import pandas as pd

        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("n")
        held = (held + rows["text"].tolist())[-keep:]
        state.update((held,))
        yield pd.DataFrame({"conversation": [key[0]], "texts": [held]})

    return messages.groupBy("conversation").applyInPandasWithState(step, "conversation string, texts array<string>", "texts array<string>", "update", "NoTimeout")


def unrepeated(hits: DataFrame, turns: int = 8) -> DataFrame:
    """(session, id, turn): hits of a stream or table that the session was not given in the last ``turns`` turns, given ones
    counting; turns of a session come in order."""

    def kept(last, rows):
        out = []
        for t in rows:
            if last is None or t - last >= turns:
                out.append(t)
                last = t
        return last, out

    if not hits.isStreaming:
        import pyarrow as pa

        def run(t: pa.Table) -> pa.Table:
            _, out = kept(None, sorted(t.column("turn").to_pylist()))
            return pa.table({"session": pa.array([t.column("session")[0].as_py()] * len(out), pa.string()), "id": pa.array([t.column("id")[0].as_py()] * len(out), pa.string()), "turn": pa.array(out, pa.int64())})

        return hits.select("session", "id", F.col("turn").cast("bigint").alias("turn")).groupBy("session", "id").applyInArrow(run, "session string, id string, turn bigint")

    def step(key, batches, state):
        import pandas as pd

        last, out = kept(state.get[0] if state.exists else None, sorted(pd.concat(list(batches))["turn"].tolist()))
        state.update((last,))
        yield pd.DataFrame({"session": [key[0]] * len(out), "id": [key[1]] * len(out), "turn": out})

    return hits.groupBy("session", "id").applyInPandasWithState(step, "session string, id string, turn bigint", "last bigint", "append", "NoTimeout")


def error_buffer(errors: DataFrame, keep: int = 30, ttl: str = "30 minutes") -> DataFrame:
    """(session, signature, text, ts): of each session's errors (session, signature, text, ts) of the last ``ttl``, the first
    of each signature, the newest ``keep``; those after a cursor are what is new. A stream drops repetitions within ``ttl``."""
    if errors.isStreaming:
        return errors.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["session", "signature"])
    end = errors.groupBy("session").agg(F.max("ts").alias("last"))
    x = errors.join(end, "session").where(F.col("ts") >= F.col("last") - F.expr(f"interval {ttl}"))
    x = x.groupBy("session", "signature").agg(F.min_by(F.struct("text", "ts"), F.struct("ts", "text")).alias("r")).select("session", "signature", "r.*")
    w = W.partitionBy("session").orderBy(F.desc("ts"), "signature")
    return x.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n")


def once_within(events: DataFrame, key: list[str], ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """Events that no equal one came before within ``ttl``: guards of summaries and the like."""
    if events.isStreaming:
        return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key)
    before = F.lag(ts).over(W.partitionBy(*key).orderBy(ts))
    return events.withColumn("before", before).where(F.col("before").isNull() | (F.col(ts) > F.col("before") + F.expr(f"interval {ttl}"))).drop("before")


def due(jobs: DataFrame, as_of_ms: int, hours: int = 24) -> DataFrame:
    """Jobs (job, last_run_ms) whose last run is ``hours`` ago or more, or that never ran."""
    return jobs.where(F.col("last_run_ms").isNull() | (F.lit(as_of_ms) - F.col("last_run_ms") >= hours * 3_600_000))


def ended_sessions(events: DataFrame, key: str = "session", ts: str = "ts", idle: str = "30 minutes") -> DataFrame:
    """(key, start, end, n) of sessions that were idle for so long: what state is cleaned up by, and reflections are made of."""
    return access_sessions(events, key, ts, idle)


def unseen(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Messages (conversation, n, ...) after the number that was handled before (conversation, seen)."""
    return messages.join(seen, "conversation", "left").where(F.col("n") >= F.coalesce("seen", F.lit(0))).drop("seen")


def remembered(messages: DataFrame) -> DataFrame:
    """(conversation, n, text): for each bare command to remember, the user's text before it."""
    from loam.operators import capture

    x = messages.where("role = 'user'").withColumn("before", F.lag("text").over(W.partitionBy("conversation").orderBy("n")))
    return x.where(capture.is_remember_command(F.col("text")) & F.col("before").isNotNull()).select("conversation", "n", F.col("before").alias("text"))


def session_summaries(messages: DataFrame, last: int = 15) -> DataFrame:
    """(conversation, n_user, n_assistant, summary): role counts of each session, and its last messages, one a line."""
    w = W.partitionBy("conversation").orderBy(F.desc("n"))
    few = messages.where("role in ('user', 'assistant')").withColumn("r", F.row_number().over(w))
    line = F.concat(F.col("role"), F.lit(": "), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), 1, 500))
    return few.groupBy("conversation").agg(F.count(F.when(F.col("role") == "user", 1)).alias("n_user"), F.count(F.when(F.col("role") == "assistant", 1)).alias("n_assistant"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= last, F.struct("n", line.alias("line"))))), lambda x: x["line"]), "\n").alias("summary"))
