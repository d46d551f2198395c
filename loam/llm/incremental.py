"""Deduplicating new batches against all history: multi-key sorted neighbourhoods in persisted key ranges.

A record has two attributes: its set of distinct words and its vector. Records are duplicates if their word sets share
70 % of all their words or their vectors have cosine 0.9. Both are found by sorting on several keys:

* a word set has a key for each rare word, and each triple of frequent words, of a prefix in a fixed order of words. Two
  sets that are similar enough share such a key (``keys_of``), so this finds all; within the run of one key, sorted by
  size, the window of a set ends where sizes can't be similar enough. Bitmaps of the words rule out most of a window.
* a vector has ``TABLES[depth]`` keys: under as many random rotations, the ``depth`` largest coordinates with their
  signs. At cosine 0.9 a pair shares a run with probability 0.99996; longer keys for larger collections keep runs
  short. The window of a vector is its run; signs of 128 random projections rule out most of it.

``History`` is a folder. It holds the keys of the accepted records in runs, each divided by key range and sorted, their
attributes in runs divided likewise, and a manifest that is replaced as a whole, so that any process can go on with it.
``merge`` takes a batch: its keys are sorted; of the history only the key ranges that they touch are read, and of these
only rows whose key the batch has (a bitmap of fixed size, tested where the rows are read) are moved to meet them.
Windows hold a new record always. The pairs that pass are checked with the exact attributes, which are read from the
ranges that pairs touch. The accepted records' keys become the next run. ``compact`` merges all runs, and takes longer
keys and a new order of words when the history has doubled since they were chosen. Nothing of the history is sorted,
shuffled or compared again by a merge.

Attributes, not records, are compared: copies share them, so a group of copies costs one comparison, however large.
Each attribute value has at most one accepted record (any later one is its duplicate).

Null or empty texts have no words, broken vectors no vector; a record without both is never a duplicate. Rows repeated
with one id count once. An empty batch changes nothing. Ids of a batch are larger than all before.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loam import scratch
from loam.llm import runs, vectors, words
from loam.scratch import written

COSINE, SHARED = 0.9, 0.7
#: keys of a vector by depth, for a chance of 0.00004 that a pair of cosine 0.9 shares none (0.468, 0.223 and 0.105 share one)
TABLES = {1: 16, 2: 40, 3: 92}
#: rows in a run of vectors that a depth may lead to on average
RUN = 200
#: signs of random projections in a vector's sketch; of a pair of cosine 0.9, 18 differ, and more than 38 do with
#: probability 0.000002
BITS, DIFFER = 128, 38
#: words in a set up to which its frequent words make triples
SHORT = 40
#: words in more than 1 / FREQUENT of the word sets are ordered last; there are at most FREQUENT x (words a set) of these
FREQUENT = 10_000
#: undecided records that one task finishes; more are decided in rounds, with the same result
LAST = 200_000
#: bits in the bitmap of a batch's keys: 4 MB, whatever the batch
BITMAP = 1 << 25
#: key rows in a range, and ranges at most
RANGE_ROWS, MOST_RANGES = 50_000, 4_096
#: merges between compactions
COMPACT = 2
KEYS = "kind int, key bigint, attr bigint, size int, low bigint, high bigint"


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def attributes(df: DataFrame, id_col: str, text_col: str, vec_col: str) -> DataFrame:
    """(id, words, unit, ws, vs): distinct words as sorted hashes, the unit vector, and 64-bit names of both values."""
    source = vectors.unit_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(vec_col).alias("vector")).where("id is not null"), "vector", ["id", "text"], drop=False)

    def rows(batches):
        for batch in batches:
            seen: dict[str, int] = {}
            sets = []
            for text in batch.column(1).to_pylist():
                sets.append(sorted({seen.get(w) or seen.setdefault(w, _hash(w)) for w in words.words(text)}))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64())), batch.column(2)], names=["id", "words", "unit"])

    out = source.mapInArrow(rows, "id bigint, words array<bigint>, unit binary")
    return out.select("id", "words", "unit", F.when(F.size("words") > 0, F.xxhash64(F.lit("w"), "words")).alias("ws"), F.when(F.col("unit").isNotNull(), F.xxhash64(F.lit("v"), "unit")).alias("vs"))


def frequent_words(sets: DataFrame, n: int) -> dict[int, int]:
    """Hash -> rank of the words in more than n / FREQUENT (but 50) word sets."""
    least = max(50, n // FREQUENT)
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") > least)
    return {r[0]: i for i, r in enumerate(sorted(counts.collect(), key=lambda r: (r[1], r[0])))}


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of equally long columns."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for x in parts:
            h = (h ^ x.view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


@lru_cache(None)
def _triples(k: int) -> np.ndarray:
    return np.array(list(combinations(range(k), 3)), np.int64).reshape(-1, 3)


def keys_of(ids: list[int], rank: dict[int, int]) -> np.ndarray:
    """The sort keys of a word set.

    Of two sets that share enough, the first shared word in the order (rare words by hash, then the frequent ones by
    rank) is in both prefixes. If it is rare, it is a key. Else all shared words are frequent, and the sets share three
    of the prefix of their frequent words, longer by two: triples of these are keys. In sets of more than ``SHORT``
    words that would be too many, so those, and the sets that may be similar to them, have single words there too.
    """
    n = len(ids)
    least = -(-7 * n // 10)
    rare = sorted(w for w in ids if w not in rank)
    often = sorted((w for w in ids if w in rank), key=rank.__getitem__)
    out = [_mixed([np.array(rare[: n - least + 1], np.int64)])] if rare else []
    if len(often) >= least:
        if 3 <= n <= SHORT:
            t = np.array(often[: len(often) - least + 3], np.int64)[_triples(min(len(often), len(often) - least + 3))]
            out.append(_mixed([t[:, 0], t[:, 1], t[:, 2]]))
        if n < 3 or n >= 0.7 * SHORT:
            out.append(_mixed([np.array(often[: len(often) - least + 1], np.int64)]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def depth_of(n: int) -> int:
    """Coordinates in a key, so that runs of n vectors hold at most RUN on average."""
    return 1 if n <= 128 * RUN else 2 if n <= 8_064 * RUN else 3


@lru_cache(None)
def _rotation(dim: int, table: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(table).normal(size=(dim, dim)))[0].astype(np.float32)


@lru_cache(None)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(12_345).normal(size=(dim, BITS)).astype(np.float32)


def sketches(x: np.ndarray) -> np.ndarray:
    """(n, 2) 64-bit words with the signs of ``BITS`` random projections."""
    return np.packbits(x @ _planes(x.shape[1]) > 0, axis=1, bitorder="little").view(np.int64).reshape(len(x), BITS // 64)


def _word_rows(attr: np.ndarray, sets: list[list[int]], rank: dict[int, int]) -> tuple[np.ndarray, ...]:
    keys = [keys_of(ids, rank) for ids in sets]
    at = np.repeat(np.arange(len(sets)), [len(k) for k in keys]) if sets else np.zeros(0, np.int64)
    bits = np.zeros((len(sets), 2), np.uint64)
    for i, ids in enumerate(sets):
        h = np.array(ids, np.int64).view(np.uint64)
        one = np.uint64(1) << (h & np.uint64(63))
        side = (h & np.uint64(64)) != 0
        bits[i] = np.bitwise_or.reduce(one[side], initial=0), np.bitwise_or.reduce(one[~side], initial=0)
    size = np.array([len(s) for s in sets], np.int32)
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return key, attr[at], size[at], bits.view(np.int64)[at]


def key_rows(attrs: DataFrame, rank: dict[int, int], depth: int) -> DataFrame:
    """(kind, key, attr, size, low, high, *rest): the keys of word sets (kind 0) and vectors (kind 1) of
    (attr, words, unit, *rest)."""
    rest = [c for c in attrs.columns if c not in ("attr", "words", "unit")]
    schema = ", ".join([KEYS, *(f"{c} {attrs.schema[c].dataType.simpleString()}" for c in rest)])

    def made(batch, rows, kind, key, attr, size, bits):
        columns = [np.full(len(key), kind, np.int32), key, attr, size, bits[:, 0], bits[:, 1]]
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), *(batch.column(c).take(take) for c in rest)], names=["kind", "key", "attr", "size", "low", "high", *rest])

    def run(batches):
        for batch in batches:
            attr = batch.column("attr").to_numpy()
            sets = batch.column("words")
            here = np.flatnonzero(sets.is_valid().to_numpy(zero_copy_only=False))
            if len(here):
                key, name, size, bits = _word_rows(here, sets.take(pa.array(here)).to_pylist(), rank)
                yield made(batch, name, 0, key, attr[name], size, bits)
            here = np.flatnonzero(batch.column("unit").is_valid().to_numpy(zero_copy_only=False))
            if len(here):
                x = vectors.matrix(batch.column("unit").take(pa.array(here)))
                bits = sketches(x)
                for t in range(TABLES[depth]):
                    y = x @ _rotation(vectors.DIM, t)
                    top = np.argpartition(-np.abs(y), depth - 1, axis=1)[:, :depth]
                    signed = np.sort(top * 2 + (np.take_along_axis(y, top, 1) > 0), 1).astype(np.int64)
                    key = _mixed([np.full(len(x), t, np.int64), *(np.ascontiguousarray(signed[:, c]) for c in range(depth))])
                    yield made(batch, here, 1, key, attr[here], np.zeros(len(x), np.int32), bits)

    return attrs.select("attr", "words", "unit", *rest).mapInArrow(run, schema)


def range_of(column: str, ranges: int):
    """The range of a 64-bit hash; ranges follow the order of the hash as an unsigned number."""
    return F.shiftrightunsigned(column, 64 - max(1, ranges.bit_length() - 1)).cast("int") if ranges > 1 else F.lit(0)


def window_pairs(kind: np.ndarray, run: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) within runs (equal ``run``, sorted by size) that may be similar and of which one is fresh, offset by offset.

    The words that only one of two sets has set at most as many differing bits, so no similar pair of sets is lost."""
    left, right = [], []
    at = np.arange(len(run))
    d = 1
    while len(at := at[at + d < len(run)]):
        at = at[run[at] == run[at + d]]
        # sizes grow within a run, so the window of a set ends where its size is too small
        at = at[size[at] * 10 >= size[at + d] * 7]
        i, j = at, at + d
        live = fresh[i] | fresh[j]
        i, j = i[live], j[live]
        apart = sum(np.bitwise_count((m[i] ^ m[j]).view(np.uint64)).astype(np.int32) for m in (low, high))  # of signed numbers it would count the absolute value's
        total = size[i] + size[j]
        good = np.where(kind[i] == 0, 17 * (total - apart) >= 14 * total, apart <= DIFFER)
        left.append(i[good])
        right.append(j[good])
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def candidates(rows: DataFrame, most: int = 4_096) -> DataFrame:
    """(kind, a, b, old): pairs of a new attribute a and another b that share a key, and b's accepted record if it is old.

    rows: key rows with ``old``, null for the new ones. Runs of more than ``most`` rows are cut in blocks of which every
    two meet, so that no task holds a longer one."""
    cut = runs.cut(rows, "attr", most)

    def run(batches):
        rest = None
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "k", "pair", "size", "attr", "low", "high")]
            old = batch.column("old")
            part += [old.is_null().to_numpy(zero_copy_only=False), old.fill_null(0).to_numpy(zero_copy_only=False)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            n = len(part[0])
            if not n:
                continue
            same = np.ones(n, bool)
            for c in part[:3]:
                same &= c == c[-1]
            end = n - int(same[::-1].argmin()) if not same.all() else 0  # the last run may go on in the next batch
            rest = [x[end:] for x in part]
            yield found([x[:end] for x in part])
        if rest is not None:
            yield found(rest)

    def found(part):
        kind, key, pair, size, attr, low, high, fresh, old = part
        change = np.ones(len(key), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
        i, j = window_pairs(kind, np.cumsum(change), size, low, high, fresh)
        flip = ~fresh[i]
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        use = (attr[i] != attr[j]) | ~fresh[j]
        i, j = i[use], j[use]
        # of two new ones the smaller name stands first
        flip = fresh[j] & (attr[i] > attr[j])
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        both = np.unique(np.stack([kind[i].astype(np.int64), attr[i], attr[j], old[j], fresh[j].astype(np.int64)], 1), axis=0) if len(i) else np.zeros((0, 5), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].astype(np.int32)), pa.array(both[:, 1]), pa.array(both[:, 2]), pa.array(both[:, 3], mask=both[:, 4] == 1)], names=["kind", "a", "b", "old"])

    cut = cut.select("kind", F.col("key").alias("k"), "pair", "size", "attr", "low", "high", "old")
    near = cut.repartition("k", "pair").sortWithinPartitions("kind", "k", "pair", "size").mapInArrow(run, "kind int, a bigint, b bigint, old bigint")
    return near.groupBy("kind", "a", "b").agg(F.min("old").alias("old"))


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """Bits of the 64-bit hashes in the only column of ``hashes``, as a table of ``BITMAP`` bits."""
    name = hashes.columns[0]
    place = F.shiftrightunsigned(name, 64 - (BITMAP.bit_length() - 1))
    words64 = hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - BITMAP.bit_length() + 1}) & 63L as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    t = words64.toArrow()  # at most BITMAP / 64 rows
    out = np.zeros(BITMAP // 64, np.uint64)
    out[t.column("w").to_numpy()] = t.column("m").to_numpy().view(np.uint64)
    return out


def having(df: DataFrame, column: str, bitmap: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose hash is in the bitmap; a few others pass too."""
    shift = np.uint64(64 - (BITMAP.bit_length() - 1))

    def run(batches):
        for batch in batches:
            p = batch.column(column).to_numpy().view(np.uint64) >> shift
            yield batch.filter(pa.array((bitmap[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0))

    return df.mapInArrow(run, df.schema)


def checked(pairs: DataFrame, new: DataFrame, old: DataFrame | None) -> DataFrame:
    """(a, b, old) of the candidate pairs that are similar by their exact attributes; an old twin needs no check.

    new, old: (attr, words, unit)."""
    open_ = pairs.where("a <> b or old is null")
    known = new.select("attr", "words", "unit") if old is None else new.select("attr", "words", "unit").unionByName(old.select("attr", "words", "unit"))
    both = open_.join(new.select(F.col("attr").alias("a"), F.col("words").alias("wa"), F.col("unit").alias("ua")), "a").join(known.select(F.col("attr").alias("b"), F.col("words").alias("wb"), F.col("unit").alias("ub")), "b")

    def exact(batches):
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            good = np.zeros(len(kind), bool)
            v = np.flatnonzero(kind == 1)
            if len(v):
                ua, ub = (vectors.matrix(batch.column(c).take(pa.array(v))).astype(np.float64) for c in ("ua", "ub"))
                good[v] = np.einsum("ij,ij->i", ua, ub) >= COSINE - 1e-9
            w = np.flatnonzero(kind == 0)
            if len(w):
                for k, x, y in zip(w, batch.column("wa").take(pa.array(w)).to_pylist(), batch.column("wb").take(pa.array(w)).to_pylist()):
                    shared = len(set(x).intersection(y))
                    good[k] = shared * 10 >= (len(x) + len(y) - shared) * 7
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b", "old")], names=["a", "b", "old"])

    found = both.select("kind", "a", "b", "old", "wa", "ua", "wb", "ub").mapInArrow(exact, "a bigint, b bigint, old bigint")
    return found.unionByName(pairs.where("a = b and old is not null").select("a", "b", "old"))


def _finish(nodes: list[tuple[int, int]], links: list[tuple[int, int]], taken: dict[int, int], before: dict[int, int] | None = None) -> dict[int, int | None]:
    """id -> kept id, or None if accepted, in order of id; taken: attribute value -> its accepted record; before:
    attribute value -> the smallest record accepted in earlier batches that it duplicates."""
    near: dict[int, list[int]] = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
    own: dict[int, list[int]] = {}
    for i, a in nodes:
        own.setdefault(i, []).append(a)
    before = before or {}
    out: dict[int, int | None] = {}
    for i in sorted(own):
        kept = min((before[a] for a in own[i] if a in before), default=None)
        if kept is None:
            kept = min((taken[b] for a in own[i] for b in [a, *near.get(a, [])] if b in taken), default=None)
        out[i] = kept
        if kept is None:
            for a in own[i]:
                taken[a] = i
    return out


def counted(df: DataFrame, name: str, *tests: str) -> tuple[DataFrame, list[int]]:
    """``df`` as a written table, and how many of its rows pass each of the tests, counted as they are written."""
    seen = Observation()
    out = written(df.observe(seen, *[F.count(F.when(F.expr(t), 1)).alias(f"n{k}") for k, t in enumerate(tests)]), name)
    return out, [seen.get[f"n{k}"] for k in range(len(tests))]


def _in_one_task(nodes: DataFrame, near: DataFrame, accepted: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """(id, kept_id) by ``_finish``; nodes: (id, attr), near: (a, b), accepted: (attr, id), before: (attr, old)."""
    none = F.lit(None).cast("bigint")
    rows = nodes.select(F.lit("n").alias("what"), F.col("id"), F.col("attr").alias("a"), none.alias("b")).unionByName(near.select(F.lit("l").alias("what"), none.alias("id"), "a", "b"))
    if accepted is not None:
        rows = rows.unionByName(accepted.select(F.lit("t").alias("what"), "id", F.col("attr").alias("a"), none.alias("b")))
    if before is not None:
        rows = rows.unionByName(before.select(F.lit("o").alias("what"), F.col("old").alias("id"), F.col("attr").alias("a"), none.alias("b")))

    def finish(t: pa.Table) -> pa.Table:
        what, ids, a, b = (t.column(c).to_pylist() for c in ("what", "id", "a", "b"))
        least: dict[str, dict[int, int]] = {"t": {}, "o": {}}
        for w, i, x in zip(what, ids, a):
            if w in least:
                least[w][x] = min(i, least[w].get(x, i))
        out = _finish([(i, x) for w, i, x in zip(what, ids, a) if w == "n"], [(x, y) for w, x, y in zip(what, a, b) if w == "l"], least["t"], least["o"])
        return pa.table({"id": pa.array(list(out), pa.int64()), "kept_id": pa.array(list(out.values()), pa.int64())})

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(finish, "id bigint, kept_id bigint")


def resolve(nodes: DataFrame, links: DataFrame, last: int = LAST) -> DataFrame:
    """(id, kept_id): kept_id is the smallest accepted record that the record duplicates, null if it is accepted.

    nodes: (id, attr), a row for each attribute value of a record; links: (a, b), both ways. Rounds: a record is a
    duplicate if a linked value has an accepted record with a smaller id; it is accepted if no linked value has a
    smaller record that is still undecided. When at most ``last`` records with ten times as many links are undecided,
    one task takes them in order.
    """
    # records all of whose values are theirs alone are accepted at once
    shared = nodes.groupBy("attr").agg(F.count("*").alias("n")).where("n > 1").select("attr")
    busy = shared.unionByName(links.select(F.col("a").alias("attr"))).distinct()
    live = nodes.join(busy, "attr", "left_semi").select("id").distinct()
    todo = written(nodes.join(live, "id", "left_semi").select("id", "attr"), "todo")
    parts = [nodes.select("id").distinct().join(todo.select("id"), "id", "left_anti").select("id", F.lit(None).cast("bigint").alias("kept_id"))]
    near = written(links.where("a <> b").join(todo.select(F.col("attr").alias("a")).distinct(), "a", "left_semi"), "near")
    accepted = None
    while (n := todo.select("id").distinct().count()) > last or (n and near.count() > 10 * last):
        loops = todo.select(F.col("attr").alias("a")).distinct().select("a", F.col("a").alias("b"))
        least = todo.groupBy(F.col("attr").alias("b")).agg(F.min("id").alias("open_id"))
        state = near.unionByName(loops).join(least, "b", "left")
        state = state.join(accepted.groupBy(F.col("attr").alias("b")).agg(F.min("id").alias("acc_id")), "b", "left") if accepted is not None else state.withColumn("acc_id", F.lit(None).cast("bigint"))
        state = state.groupBy("a").agg(F.min("open_id").alias("open_id"), F.min("acc_id").alias("acc_id"))
        verdict = todo.join(state.withColumnRenamed("a", "attr"), "attr", "left").groupBy("id").agg(F.min(F.expr("if(acc_id < id, acc_id, null)")).alias("kept_id"), F.min("open_id").alias("open_id"))
        # the kept id is the smallest accepted one, so a duplicate waits only while a smaller record than that is open
        decided = written(verdict.where("open_id >= coalesce(kept_id, id)").select("id", "kept_id"), "verdict")
        parts.append(decided)
        more = todo.join(decided.where("kept_id is null"), "id", "left_semi").select("attr", "id")
        accepted = written(more if accepted is None else accepted.unionByName(more), "accepted")
        todo = written(todo.join(decided, "id", "left_anti"), "todo")
    if n:
        parts.append(_in_one_task(todo, near, accepted))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class History:
    """The accepted records in the folder ``at``; a folder that has a manifest is continued.

    ``keys/run-k/range=r``: key rows with ``id``, sorted; ``attrs/run-k/range=r``: (attr, words, unit, id), sorted. The
    manifest names the runs, the number of ranges, the depth of vector keys, the counts that these were chosen for, and
    the table of frequent words."""

    def __init__(self, spark: SparkSession, at: str, range_rows: int = RANGE_ROWS, last: int = LAST):
        self.spark, self.at, self.range_rows, self.last = spark, at.rstrip("/"), range_rows, last
        saved = [int(n[9:-5]) for n in scratch.names_in(spark, self.at) if n.startswith("manifest-") and n.endswith(".json")]
        self.state = {"version": -1, "runs": [], "ranges": [], "depth": 0, "records": 0, "keyed_for": 0, "words": None, "merges": 0}
        if saved:
            self.state = json.loads(scratch.get_text(spark, f"{self.at}/manifest-{max(saved)}.json"))
        self.rank = self._rank() if self.state["words"] else {}

    def _rank(self) -> dict[int, int]:
        return {r[0]: r[1] for r in self.spark.read.parquet(f"{self.at}/{self.state['words']}").collect()}  # bounded by FREQUENT

    def _save(self, **changes) -> None:
        state = self.state | changes | {"version": self.state["version"] + 1}
        scratch.put_text(self.spark, f"{self.at}/manifest-{state['version']}.json", json.dumps(state))
        self.state = state
        if state["version"] > 0:
            scratch.delete(self.spark, f"{self.at}/manifest-{state['version'] - 1}.json")

    def _set_words(self, sets: DataFrame, n: int) -> str:
        self.rank = frequent_words(sets, n)
        name = f"frequent-{self.state['version'] + 1}"
        rows = pa.table({"word": pa.array(list(self.rank), pa.int64()), "rank": pa.array(list(self.rank.values()), pa.int32())})
        self.spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/{name}")
        return name

    def _read(self, what: str, touched: DataFrame | None = None, column: str = "") -> DataFrame | None:
        """The rows of all runs, of only the ranges that the hashes ``touched`` fall in if they are given."""
        out = None
        for run, ranges in zip(self.state["runs"], self.state["ranges"]):
            df = self.spark.read.parquet(f"{self.at}/{what}/run-{run}")
            if touched is not None and ranges > 1:
                hit = [r[0] for r in touched.select(range_of(touched.columns[0], ranges).alias("r")).distinct().collect()]  # at most MOST_RANGES
                df = df.where(F.col("range").isin(hit)) if len(hit) < ranges else df
            df = df.drop("range")
            out = df if out is None else out.unionByName(df)
        return out

    def _append(self, keys: DataFrame, attrs: DataFrame, ranges: int, run: int) -> None:
        for what, df, by in (("keys", keys, "key"), ("attrs", attrs, "attr")):
            order = ["kind", "key", "size"] if what == "keys" else ["attr"]
            df = df.withColumn("range", range_of(by, ranges))
            df.repartition("range").sortWithinPartitions("range", *order).write.mode("overwrite").partitionBy("range").parquet(f"{self.at}/{what}/run-{run}")

    def merge(self, batch: DataFrame, id_col: str = "cand_id", text_col: str = "abstract", vec_col: str = "vector") -> DataFrame:
        """(id, kept_id) for the batch, whose ids are larger than all before; kept_id is null if it is accepted."""
        records, (n,) = counted(attributes(batch, id_col, text_col, vec_col).dropDuplicates(["id"]), "records", "1=1")
        if not n:
            return records.select("id", F.lit(None).cast("bigint").alias("kept_id"))
        changes, runs_before = {}, self.state["runs"]
        if not runs_before:
            sets = records.where("ws is not null").select("ws", "words").dropDuplicates(["ws"])
            changes = {"words": self._set_words(sets, n), "depth": depth_of(n), "keyed_for": n}
            self.state |= changes
        sets = records.where("ws is not null").groupBy(F.col("ws").alias("attr")).agg(F.first("words").alias("words"), F.lit(None).cast("binary").alias("unit"))
        units = records.where("vs is not null").groupBy(F.col("vs").alias("attr")).agg(F.lit(None).cast("array<bigint>").alias("words"), F.first("unit").alias("unit"))
        attrs = written(sets.unionByName(units), "attrs")
        keys, (n_keys,) = counted(key_rows(attrs, self.rank, self.state["depth"]), "keys", "1=1")
        near = keys.withColumn("old", F.lit(None).cast("bigint"))
        if runs_before:
            # the batch's own key ranges, and in these only rows that share a key with it
            near = near.unionByName(having(self._read("keys", keys.select("key")).withColumnRenamed("id", "old"), "key", bitmap_of(keys.select("key"))))
        pairs, (n_old,) = counted(candidates(near), "pairs", "old is not null and a <> b")
        old_attrs = None
        if n_old:
            wanted = pairs.where("old is not null and a <> b").select("b").distinct()
            old_attrs = having(self._read("attrs", wanted), "attr", bitmap_of(wanted))
        links, (n_links,) = counted(checked(pairs, attrs, old_attrs), "links", "1=1")
        nodes = records.select("id", F.explode(F.array_compact(F.array("ws", "vs"))).alias("attr"))
        # whoever duplicates an old record is decided: old ids are smaller than all of the batch
        before = links.where("old is not null").groupBy(F.col("a").alias("attr")).agg(F.min("old").alias("old"))
        own = links.where("old is null").select("a", "b")
        own = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if n <= self.last and n_links <= 10 * self.last:
            found = _in_one_task(nodes, own, None, before)
        else:
            old = written(nodes.join(before, "attr").groupBy("id").agg(F.min("old").alias("kept_id")), "before")
            found = resolve(nodes.join(old, "id", "left_anti"), own, self.last).unionByName(old)
        bare = records.where("ws is null and vs is null").select("id", F.lit(None).cast("bigint").alias("kept_id"))
        out = written(found.unionByName(bare), "verdicts")
        taken = nodes.join(out.where("kept_id is null"), "id", "left_semi").select("attr", "id")
        ranges = self._ranges(n_keys)
        run = max(runs_before, default=-1) + 1
        self._append(keys.join(taken, "attr").select("kind", "key", "attr", "size", "low", "high", "id"), attrs.join(taken, "attr").select("attr", "words", "unit", "id"), ranges, run)
        self._save(runs=[*runs_before, run], ranges=[*self.state["ranges"], ranges], records=self.state["records"] + n, merges=self.state["merges"] + 1, **changes)
        scratch.drop(records, attrs, keys, pairs, links)
        return out

    def _ranges(self, rows: int) -> int:
        """A power of two."""
        return min(MOST_RANGES, 1 << max(0, (rows // self.range_rows).bit_length() - 1)) if rows >= 2 * self.range_rows else 1

    def compact(self) -> None:
        """One run in place of all; keys are chosen anew when the history has doubled since they were."""
        if len(self.state["runs"]) < 2 and self.state["records"] < 2 * self.state["keyed_for"]:
            return
        keys, attrs = self._read("keys"), self._read("attrs")
        changes, old = {}, self.state
        if self.state["records"] >= 2 * self.state["keyed_for"]:
            n = attrs.where("unit is not null").count()
            changes = {"words": self._set_words(attrs.where("words is not null"), self.state["records"]), "depth": depth_of(n), "keyed_for": self.state["records"]}
            keys = key_rows(attrs, self.rank, changes["depth"])
        run = max(self.state["runs"]) + 1
        keys, (n_keys,) = counted(keys, "all-keys", "1=1")
        ranges = self._ranges(n_keys)
        self._append(keys, attrs, ranges, run)
        self._save(runs=[run], ranges=[ranges], **changes)
        scratch.drop(keys)
        for k in old["runs"]:
            for what in ("keys", "attrs"):
                scratch.delete(self.spark, f"{self.at}/{what}/run-{k}")
        if changes and old["words"]:
            scratch.delete(self.spark, f"{self.at}/{old['words']}")


def deliveries(df: DataFrame, id_col: str, n: int) -> list[tuple[int, int]]:
    """(first, last) ids of ``n`` groups of consecutive ids with about as many rows each."""
    low, high, cuts = df.agg(F.min(id_col), F.max(id_col), F.percentile_approx(F.col(id_col).cast("long"), [k / n for k in range(1, n)] or [0.5], 10_000)).first()
    if low is None:
        return []
    edges = [low, *sorted({c for c in cuts if c > low} if n > 1 else ()), high + 1]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def replay(df: DataFrame, id_col: str = "cand_id", text_col: str = "abstract", vec_col: str = "vector", merges: int = 4, compact_every: int = COMPACT, last: int = LAST, at: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, kept_id) for each record of ``df``, merged in order of id into a history, ``merges`` deliveries of consecutive
    records one after the other; kept_id is null if the record is accepted. The result does not depend on how many."""
    spark = df.sparkSession
    rows = df.select(id_col, text_col, vec_col).where(F.col(id_col).isNotNull())
    history = History(spark, at or scratch.fresh_path(spark, "history"), range_rows, last)
    out = None
    for k, (first, final) in enumerate(deliveries(rows, id_col, merges)):
        found = history.merge(rows.where(F.col(id_col).between(first, final)), id_col, text_col, vec_col)
        out = found if out is None else out.unionByName(found)
        if (k + 1) % compact_every == 0 and k + 1 < merges:
            history.compact()
    return out if out is not None else spark.createDataFrame([], "id bigint, kept_id bigint")
