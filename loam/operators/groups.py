"""Operators that are greedy within a small group: batch deduplication, compaction of clusters, session compression.

The order within a group decides, so each runs per group in one task where groups are batches or conversations; a
scope, whose size nothing bounds, is compacted in rounds of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.operators import gates
from loam.scratch import written

BLOCK = 5_000


def _units(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a usable vector of the most usual length, and these as unit rows."""
    values = column.to_pylist()
    sizes = [len(v) for v in values if v]
    dim = dim or (max(set(sizes), key=sizes.count) if sizes else 0)
    rows, at = [], []
    for i, v in enumerate(values):
        if v and len(v) == dim and None not in v:
            a = np.asarray(v, float)
            n = np.linalg.norm(a)
            if np.isfinite(n) and n > 0:
                rows.append(a / n)
                at.append(i)
    return np.array(at, int), np.array(rows).reshape(len(at), dim)


def batch_dedup(df: DataFrame, batch: str = "batch_no", order: str = "idx", key: str = "cand_id", vec: str = "vector", cosine: float = 0.85) -> DataFrame:
    """(batch, key, duplicate_of): within a batch, a row too close to an earlier surviving one is its duplicate.

    Rows without a usable vector survive. Blocks of rows are compared with the survivors at once."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t.column(key).to_numpy(), t.column(order).to_numpy()))))
        at, x = _units(t.column(vec))
        dup: list = [None] * t.num_rows
        keys = t.column(key).to_pylist()
        kept: list[int] = []
        for s in range(0, len(at), 256):
            block = x[s : s + 256]
            old = block @ x[kept].T > cosine if kept else np.zeros((len(block), 0), bool)
            own = block @ block.T > cosine
            fresh: list[int] = []
            for i in range(len(block)):
                if old[i].any():
                    dup[at[s + i]] = keys[at[kept[int(old[i].argmax())]]]
                elif (hit := [j for j in fresh if own[i, j]]):
                    dup[at[s + i]] = keys[at[s + hit[0]]]
                else:
                    fresh.append(i)
            kept += [s + i for i in fresh]
        return pa.table({batch: t.column(batch), key: t.column(key), "duplicate_of": pa.array(dup, t.column(key).type)})

    names = {c: df.schema[c].dataType.simpleString() for c in (batch, key)}
    rows = df.select(batch, order, key, vec).dropDuplicates([batch, key])
    return rows.groupBy(batch).applyInArrow(run, f"{batch} {names[batch]}, {key} {names[key]}, duplicate_of {names[key]}")


def _unit_rows(batches):
    """(scope, node, id, importance, unit) of the rows whose vector is usable and as long as is usual in their scope."""
    for batch in batches:
        at, units = [], []
        for i, (v, dim) in enumerate(zip(batch.column("vector").to_pylist(), batch.column("dim").to_pylist())):
            if v and len(v) == dim and None not in v:
                a = np.asarray(v, float)
                n = np.linalg.norm(a)
                if np.isfinite(n) and n > 0:
                    at.append(i)
                    units.append((a / n).tobytes())
        names = ["scope", "node", "id", "importance"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in names), pa.array(units, pa.binary())], names=[*names, "unit"])


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 0))


def led(nodes: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(node, seed) of (scope, node, id, importance, unit): by importance, a row joins the first seed of its scope of at
    least that cosine, or is a seed itself.

    In rounds, of any size of a scope: the first ``block`` open rows of a scope find their seeds in one task; then all its
    other open rows meet these seeds, in parts. What joins none is open in the next round, so that every row meets
    every seed before it."""
    least = cosine - 1e-12

    def lead(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        x, node = _matrix(t.column("unit")), t.column("node").to_numpy()
        first = np.full(len(x), -1)
        seeds: list[int] = []
        for s in range(0, len(x), 256):
            part = x[s : s + 256]
            old = part @ x[seeds].T >= least if seeds else np.zeros((len(part), 0), bool)
            own = part @ part.T >= least
            fresh: list[int] = []
            for i in range(len(part)):
                if old[i].any():
                    first[s + i] = seeds[int(old[i].argmax())]
                elif (hit := [j for j in fresh if own[i, j]]):
                    first[s + i] = s + hit[0]
                else:
                    first[s + i] = s + i
                    fresh.append(i)
            seeds += [s + i for i in fresh]
        mask = pa.array(first != np.arange(len(x)))
        unit = pa.compute.if_else(mask, pa.scalar(None, pa.binary()), t.column("unit").combine_chunks())
        return pa.table({"scope": t.column("scope"), "node": t.column("node"), "seed": pa.array(node[first], pa.int64()), "at": t.column("at"), "unit": unit})

    def join(t: pa.Table, seeds: pa.Table) -> pa.Table:
        seeds = seeds.sort_by("at")
        x, y, node = _matrix(t.column("unit")), _matrix(seeds.column("unit")), seeds.column("node").to_pylist()
        first: list = []
        for s in range(0, len(x), 512):
            near = x[s : s + 512] @ y.T >= least
            first += [node[j] if hit else None for hit, j in zip(near.any(1), near.argmax(1))]
        return t.select(["scope", "node", "id", "importance", "unit"]).append_column("seed", pa.array(first, pa.int64()))

    key = [F.desc("importance"), F.asc("id"), F.asc("node")]
    open_rows, found = nodes, None
    while True:
        salted = open_rows.withColumn("salt", F.expr("pmod(xxhash64(node), 64)"))
        for by in (["scope", "salt"], ["scope"]):
            salted = salted.withColumn("at", F.row_number().over(W.partitionBy(*by).orderBy(*key))).where(F.col("at") <= block)
        head = written(salted.select("scope", "node", "unit", "at").groupBy("scope").applyInArrow(lead, "scope string, node bigint, seed bigint, at int, unit binary"), "head")
        found = head.select("node", "seed") if found is None else found.unionByName(head.select("node", "seed"))
        full = head.groupBy("scope").count().where(F.col("count") >= block).select("scope")
        if not full.take(1):
            return found
        rest = open_rows.join(full, "scope", "left_semi").join(head.select("node"), "node", "left_anti")
        parts = written(rest.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "parts")
        left = rest.join(parts, "scope").withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
        right = head.where("unit is not null").join(parts, "scope").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = left.select("scope", "node", "id", "importance", "unit", "part").groupBy("scope", "part").cogroup(right.select("scope", "node", "unit", "at", "part").groupBy("scope", "part"))
        met = written(met.applyInArrow(join, "scope string, node bigint, id string, importance double, unit binary, seed bigint"), "met")
        found = found.unionByName(met.where("seed is not null").select("node", "seed"))
        open_rows = met.where("seed is null").drop("seed")


def _merged(batches):
    """The merged row of each cluster of (scope, seed, rows)."""
    names = ["scope", "seed", "size", "members", "text", "importance", "category"]
    types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.string()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for scope, seed, rows in zip(*(batch.column(c).to_pylist() for c in ("scope", "seed", "rows"))):
            rows.sort(key=lambda r: (r["node"] != seed, -r["importance"], r["id"] is not None, r["id"] or "", r["node"]))
            lines: dict[str, str] = {}
            votes: dict[str, int] = {}
            for r in rows:
                for line in (r["text"] or "").split("\n"):
                    if line.strip():
                        lines.setdefault(line.strip().lower(), line.strip())
                votes[r["category"] or "other"] = votes.get(r["category"] or "other", 0) + 1
            row = (scope, rows[0]["id"], len(rows), [r["id"] for r in rows], "\n".join(lines.values()), min(1.0, max(r["importance"] for r in rows)), max(votes, key=votes.get))
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, types)], names=names)


def compaction(df: DataFrame, cosine: float = 0.88, least: int = 2, block: int = BLOCK) -> DataFrame:
    """(scope, seed, size, members, text, importance, category): clusters around seeds, by importance, within a scope.

    A seed takes every unassigned row of at least that cosine. The merged row has all distinct lines, the largest
    importance and the most frequent category (the first of equals). ``block`` bounds a task, not a cluster."""
    rows = df.select("id", "scope", "text", "category", F.coalesce("importance", F.lit(0.0)).alias("importance"), "vector")
    rows = written(rows.dropDuplicates(["id"]).where("scope is not null").withColumn("node", F.monotonically_increasing_id()), "compaction")
    dims = rows.select("scope", F.size("vector").alias("dim")).where("dim > 0").groupBy("scope", "dim").count()
    dims = dims.groupBy("scope").agg(F.max_by("dim", F.struct("count", -F.col("dim"))).alias("dim"))
    nodes = rows.join(dims, "scope").select("scope", "node", "id", "importance", "vector", "dim")
    nodes = written(nodes.mapInArrow(_unit_rows, "scope string, node bigint, id string, importance double, unit binary"), "nodes")
    found = led(nodes, cosine, block)
    large = found.groupBy("seed").count().where(F.col("count") >= least).select("seed")
    members = rows.drop("vector").join(found.join(large, "seed"), "node")
    clusters = members.groupBy("scope", "seed").agg(F.collect_list(F.struct("node", "id", "text", "importance", "category")).alias("rows"))
    return clusters.mapInArrow(_merged, "scope string, seed string, size int, members array<string>, text string, importance double, category string")


def kept_texts(texts: list[str], values: list[float], reasons: list[str], budget: int, least: int = 3, low: float = 0.3) -> list[int]:
    """Which texts of a conversation are kept within a budget of characters: the first and the last, then the most
    valuable; a tool call brings its result along."""
    n, sizes = len(texts), [len(t) for t in texts]
    if sum(sizes) <= budget:
        return list(range(n))
    kept: set[int] = set()
    left = budget

    def take(i: int) -> bool:
        nonlocal left
        if not 0 <= i < n or i in kept or sizes[i] > left:
            return False
        kept.add(i)
        left -= sizes[i]
        return True

    take(0)
    take(n - 1)
    partner: dict[int, int] = {}
    for i, reason in enumerate(reasons):
        if reason == "tool_call" and i + 1 < n and i not in partner and i + 1 not in partner:
            partner |= {i: i + 1, i + 1: i}
    for i in sorted(range(1, n - 1), key=lambda i: (-values[i], i)):
        if left <= 0:
            break
        if take(i) and i in partner:
            take(partner[i])
    wanted = min(least, n)
    if all(v < low for v in values):
        for i in reversed(range(n)):
            if len(kept) >= wanted:
                break
            take(i)
    return sorted(kept)


def compressed(df: DataFrame, session: str, order: str, text: str, budget: int = 8_000) -> DataFrame:
    """(session, n_texts, n_kept, chars): conversations within a budget. A null session is none."""
    rows = df.where(F.col(session).isNotNull()).select(F.col(session).alias("session"), F.col(order).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("v", gates.text_value(F.col("text"))).select("session", "at", "text", "v.score", "v.reason")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("at", "ascending"), ("text", "ascending")])
        texts = t.column("text").to_pylist()
        keep = kept_texts(texts, t.column("score").to_pylist(), t.column("reason").to_pylist(), budget)
        return pa.table({"session": t.column("session").take(pa.array([0])), "n_texts": pa.array([len(texts)], pa.int32()), "n_kept": pa.array([len(keep)], pa.int32()), "chars": pa.array([sum(len(texts[i]) for i in keep)], pa.int64())})

    return rows.groupBy("session").applyInArrow(run, f"session {rows.schema['session'].dataType.simpleString()}, n_texts int, n_kept int, chars bigint")
