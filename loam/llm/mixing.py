"""Mixing sources to target weights, by Sainte-Lague apportionment of equal-token blocks.

1. Each document's size is its number of tokens under a public tokenizer, whose file is a parameter.
2. The documents of a source are put in a seeded order, in shards, and cut in blocks of about ``block`` tokens; a
   document belongs to the block in which it starts, so blocks are whole documents.
3. The total is divided into blocks; the highest quotients ``share / (2 s + 1)`` win them, one after the other, until
   a source has ``max_repeats`` times what it holds: integer quotas for the sources, and in the same way for each
   source's shards.
4. A shard's quota is of equal-token blocks: every document is taken as often as the quota holds the shard in full; the
   rest goes to the blocks that come first in a seeded order, document by document up to the quota's tokens.

A source that reaches its cap stays below its target and the other sources take its place in the total; the report
has both shares. Sources are compared without case and outer spaces. Documents without a source, or of one without a
target, take no part; nor do null and empty texts, which have no tokens. Targets with null or non-positive shares get
nothing. The numbers that reach the driver are one row for each source and shard.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.scratch import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK, SHARD_DOCS, SEED = 2_048, 100_000, 7
#: Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text_col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``n_tokens``; null texts have none."""
    source = df.select(*keep, F.col(text_col).alias("__text"))

    def rows(batches):
        enc = encoding(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(rows, f"{schema}, n_tokens bigint")


def sainte_lague(weights: dict, seats: int, caps: dict) -> dict:
    """Seats for each key by the highest quotients weight / (2 s + 1), at most ``caps`` each; ties go to the smaller key.

    Most seats are given at once, at a divisor that is surely too large; the last ones by a heap of quotients."""
    out = {k: 0 for k in weights}
    live = {k: w for k, w in weights.items() if w and w > 0 and caps.get(k, 0) > 0}
    seats = min(seats, sum(caps[k] for k in live))
    low, high = 0.0, 1.0
    at = lambda x: {k: min(caps[k], int(w * x + 0.5)) for k, w in live.items()}
    while live and sum(at(high).values()) < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if sum(at(middle).values()) <= seats:
            low = middle
        else:
            high = middle
    out |= at(low)
    while sum(out.values()) > seats:  # ties at the divisor
        k = min((k for k in live if out[k]), key=lambda k: (live[k] / (2 * out[k] - 1), k))
        out[k] -= 1
    heap = [(-w / (2 * out[k] + 1), k) for k, w in live.items() if out[k] < caps[k]]
    heapq.heapify(heap)
    left = seats - sum(out.values())
    while left and heap:
        _, k = heapq.heappop(heap)
        out[k] += 1
        left -= 1
        if out[k] < caps[k]:
            heapq.heappush(heap, (-live[k] / (2 * out[k] + 1), k))
    return out


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, seed: int = SEED, tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(plan, report). plan: (doc_id, source, shard, block, n_tokens, repeats), a row for each document that is taken at
    least once. report: (source, target_share, available_tokens, max_repeats, tokens, actual_share, repeats).

    ``total_tokens``: size of the mix; by default that of all documents of sources with a target.
    """
    spark = documents.sparkSession
    goal = {}
    for r in targets.select("source", "target_share", "max_repeats").collect():  # a row for each source
        if r[0] is not None and r[1] and r[1] > 0:
            goal[r[0].strip().lower()] = (float(r[1]), int(r[2] if r[2] is not None else 1))
    wanted = spark.createDataFrame([(k,) for k in goal], "source string")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text").where("doc_id is not null").join(F.broadcast(wanted), "source")  # as few rows as there are targets
    sized = written(token_counts(docs, "text", ["doc_id", "source"], tokenizer).where("n_tokens > 0"), "sized")
    counts = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.count("*"), F.sum("n_tokens")).collect()}
    shards = F.create_map(*[x for k, (n, _) in counts.items() for x in (F.lit(k), F.lit(max(1, -(-n // shard_docs))))]) if counts else F.lit(None)
    order = F.xxhash64("doc_id", F.lit(seed))
    placed = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), shards[F.col("source")]).cast("int")) if counts else sized.withColumn("shard", F.lit(0))
    running = F.sum("n_tokens").over(W.partitionBy("source", "shard").orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("block", F.floor(F.coalesce(running, F.lit(0)) / F.lit(block)).cast("long"))
    placed = written(placed, "placed")
    held = {(r[0], r[1]): (r[2], r[3]) for r in placed.groupBy("source", "shard").agg(F.countDistinct("block"), F.sum("n_tokens")).collect()}  # a row for each shard
    total = total_tokens if total_tokens is not None else sum(t for _, t in counts.values())
    tokens = {k: sum(t for (s, _), (_, t) in held.items() if s == k) for k in goal}
    quota = sainte_lague({k: s for k, (s, _) in goal.items()}, total // block, {k: tokens[k] * m // block for k, (_, m) in goal.items()})
    rows = []
    for k, (_, most) in goal.items():
        own = {shard: v for (s, shard), v in held.items() if s == k}
        for shard, n in sainte_lague({shard: float(t) for shard, (_, t) in own.items()}, quota[k], {shard: t * most // block for shard, (_, t) in own.items()}).items():
            full, rest = divmod(n * block, own[shard][1])
            rows.append((k, shard, full, rest))
    quotas = F.broadcast(spark.createDataFrame(rows, "source string, shard int, full int, rest bigint"))  # a row for each shard
    # blocks in a seeded order; documents are taken once more until the quota's rest of tokens is reached, so that a
    # shard is off by half a document at most, whatever the sizes of its blocks
    ranked = placed.join(quotas, ["source", "shard"]).withColumn("r", F.xxhash64("block", F.lit(seed + 2)))
    upto = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source", "shard").orderBy("r", "block", order, "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = ranked.withColumn("repeats", F.col("full") + (upto + F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).where("repeats > 0").select("doc_id", "source", "shard", "block", "n_tokens", "repeats")
    aims = spark.createDataFrame([(k, s, m) for k, (s, m) in goal.items()], "source string, target_share double, max_repeats int")
    have = placed.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    got = plan.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("repeats"))
    report = aims.join(have, "source", "left").join(got, "source", "left").na.fill(0, ["available_tokens", "tokens", "repeats"])
    share = F.col("tokens") / F.sum("tokens").over(W.partitionBy(F.lit(0)))  # over one row for each target
    report = report.select("source", "target_share", "available_tokens", "max_repeats", "tokens", share.alias("actual_share"), "repeats")
    return plan, report
