"""Evaluation texts that leak into a corpus: rare n-gram seeds, then Smith-Waterman alignment.

1. One pass over the corpus counts, for each n-gram of the items, the documents that hold it (``corpus_counts``).
2. ``seeds``: an item's seeds are chosen so that each of its windows of ``RUN`` words holds one: in each window of
   ``RUN - N + 1`` n-grams in a row, the rarest. Items shorter than that have their rarest n-gram, items shorter than
   ``N`` words are seeds as a whole. Passages that lie between seeds cannot be ``RUN`` words long.
3. ``short_seeds`` are the rarest n-grams of three words in each window of eight; two of them in line
   make a hit, so copies that are edited every few words are found too.
4. A second pass over the corpus looks the seeds up and emits (document, item) with the words of the passage around
   the hits; the items, in parts of bounded size, are what is sent to the executors.
5. ``smith_waterman`` aligns passage and item by words, along diagonals as long as the item, so that edited copies get a
   score; for alignments that are good enough to hold one, ``longest_run`` is the exact check of literal copies.

Words are runs of letters and digits; case, accents, markup tags and invisible characters don't matter. Null and empty
texts, and texts without words, leak nothing. Repeated rows and copies under other ids are each looked at. A document
that holds an item many times gives one row, with its best alignment.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import words

N, RUN = 5, 12
#: words in the short seeds that find edited copies, and words of a window that has one
SHORT, WITHIN = 3, 8
#: share of an item's words that a passage found by short seeds holds at least
LEAST = 0.5
#: A part of the suite of so many words is held in each task; a larger suite is taken part by part.
MOST_WORDS = 5_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def items_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> dict[int, list[str]]:
    """item -> words. A suite, or a part of one, of bounded size reaches the driver."""
    return {r[0]: w for r in items.select(id_col, text_col).where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).collect() if (w := words.plain_words(r[1]))}


def grams(ws: list[str], n: int = N) -> list[tuple[str, ...]]:
    """The n-grams of a text; a text of fewer words is one."""
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [tuple(ws)] if ws else []


def _lookup(keys) -> dict[int, dict[str, set]]:
    """length -> first word -> the n-grams that begin with it, so that most places of a text cost one look-up."""
    out: dict[int, dict[str, set]] = defaultdict(dict)
    for k in keys:
        out[len(k)].setdefault(k[0], set()).add(k)
    return out


def hits(ws: list[str], lookup: dict[int, dict[str, set]]) -> list[tuple[int, tuple[str, ...]]]:
    """(place, n-gram) for each n-gram of ``lookup`` in a text."""
    out = []
    for n, by_first in lookup.items():
        last = len(ws) - n
        for i, w in enumerate(ws):
            if w in by_first and i <= last and (key := tuple(ws[i : i + n])) in by_first[w]:
                out.append((i, key))
    return out


def corpus_counts(documents: DataFrame, suite: dict[int, list[str]], text_col: str = "text") -> dict[tuple[str, ...], int]:
    """Documents of the whole corpus that hold each n-gram of the suite; at most as many numbers as the suite has words."""
    lookup = _lookup({g for ws in suite.values() for n in (N, SHORT) for g in grams(ws, n)})

    def rows(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update({k for _, k in hits(words.plain_words(text), lookup)})
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(k) for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    found = documents.select(text_col).mapInArrow(rows, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {tuple(r[0].split(" ")): r[1] for r in found.collect()}


def seeds(suite: dict[int, list[str]], counts: dict[tuple[str, ...], int], run: int = RUN) -> dict[tuple[str, ...], set[int]]:
    """Seed -> the items it comes from."""
    out: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for item, ws in suite.items():
        gs = grams(ws)
        span = max(1, min(run, len(ws)) - N + 1)
        for s in range(max(1, len(gs) - span + 1)):
            out[min(gs[s : s + span], key=lambda g: (counts.get(g, 0), g))].add(item)
    return out


def short_seeds(suite: dict[int, list[str]], counts: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], set[tuple[int, int]]]:
    """Seed of ``SHORT`` words -> the items it comes from and its places in them: the rarest in each window of ``WITHIN``
    words. A copy that is edited every few words still holds some of them, in order."""
    out: dict[tuple[str, ...], set[tuple[int, int]]] = defaultdict(set)
    for item, ws in suite.items():
        if len(ws) > WITHIN:
            gs = grams(ws, SHORT)
            for s in range(len(gs) - (WITHIN - SHORT)):
                # what no document holds is no seed: edits have made it disappear
                there = [k for k in range(s, s + WITHIN - SHORT + 1) if gs[k] in counts]
                if there:
                    best = min(there, key=lambda k: (counts[gs[k]], gs[k]))
                    out[gs[best]].add((item, best))
    return out


def in_line(some: list[tuple[int, tuple[str, ...]]]) -> list[int]:
    """Of hits (place less place in the item, seed) the diagonals that another seed's hit stands in line with: as far apart
    in the document as in the item, but for ``WITHIN`` words. Diagonals nearer to each other than that are one."""
    some = sorted(some)
    out: list[int] = []
    for k, (d, key) in enumerate(some):
        if (not out or d - out[-1] > WITHIN) and any(o[1] != key and o[0] - d <= WITHIN for o in some[k + 1 : k + 4]):
            out.append(d)
    return out


def aligned(ws: list[str], suite: dict[int, list[str]], found: dict, short: dict, lookup: dict, run: int = RUN) -> list[tuple[int, int, int, int, float]]:
    """(item, run_words, item_words, score, share) of the items that a document's words hold a part of.

    Around a literal seed the passage is aligned with ``N`` words more than the item on either side. In line with short
    seeds it is as long as the item, and aligned only if it holds at least ``LEAST`` of the item's words in any order,
    without which no alignment reaches that share."""
    by_item: dict[int, list[int]] = defaultdict(list)
    few: dict[int, list] = defaultdict(list)
    for p, key in hits(ws, lookup):
        for item in found.get(key, ()):
            by_item[item].append(p)
        for item, place in short.get(key, ()):
            few[item].append((p - place, key))
    parts: dict[int, list[list[str]]] = {item: [ws[s:e] for s, e in passages(places, len(ws), len(suite[item]) + N)] for item, places in by_item.items()}
    for item, some in few.items():
        if item not in by_item and len(some) > 1:
            whole = suite[item]
            for d in in_line(some):
                part = ws[max(0, d - WITHIN) : d + len(whole) + 2 * WITHIN]
                if sum((Counter(part) & Counter(whole)).values()) >= LEAST * len(whole):
                    parts.setdefault(item, []).append(part)
    out = []
    for item, some in parts.items():
        whole = suite[item]
        score = max(smith_waterman(p, whole) for p in some)
        literal = max(longest_run(p, whole) for p in some) if score >= MATCH * min(run, len(whole)) else 0
        out.append((item, literal, len(whole), score, score / (MATCH * len(whole))))
    return out


def longest_run(a: list[str], b: list[str]) -> int:
    """Words of the longest passage that both texts hold."""
    best, ends = 0, {}
    places: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(b):
        places[w].append(j)
    for w in a:
        now = {}
        for j in places.get(w, ()):
            now[j] = ends.get(j - 1, 0) + 1
            best = max(best, now[j])
        ends = now
    return best


def smith_waterman(a: list[str], b: list[str]) -> int:
    """Score of the best local alignment by words, by anti-diagonals."""
    if len(a) > len(b):  # diagonals are as long as the shorter text
        a, b = b, a
    code: dict[str, int] = {}
    x, y = (np.array([code.setdefault(w, len(code)) for w in t]) for t in (a, b))
    n, m = len(x), len(y)
    if not n or not m:
        return 0
    before = np.zeros(n + 1, np.int32)
    last = np.zeros(n + 1, np.int32)
    best = 0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        now = np.zeros(n + 1, np.int32)
        score = np.where(x[i - 1] == y[d - i - 1], MATCH, MISMATCH)
        now[i] = np.maximum(np.maximum(before[i - 1] + score, 0), np.maximum(last[i - 1], last[i]) + GAP)
        best = max(best, int(now.max()))
        before, last = last, now
    return best


def passages(places: list[int], n: int, reach: int) -> list[tuple[int, int]]:
    """The stretches of a text of n words around hits, each hit with ``reach`` words on either side, merged."""
    out: list[list[int]] = []
    for p in sorted(places):
        start, end = max(0, p - reach), min(n, p + reach)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, item_id, run_words, item_words, score, share): what documents hold of items.

    ``run_words``: the longest literal passage, 0 where the alignment rules out one of ``run`` words; ``score``: of the best alignment; ``share``: the score by that of the
    whole item. A row is there for each document with a seed of the item.
    """
    slices = _slices(items)
    texts = documents.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(id_col).isNotNull())
    out = None
    for part in slices:
        one = _leaks_of(texts, items_of(part), text_col, run)
        out = one if out is None else out.unionByName(one)
    return out


def _slices(items: DataFrame, most: int = 5 * MOST_WORDS) -> list[DataFrame]:
    """The suite, or parts of it that a task can hold, by a hash of the item."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // most) or 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def _leaks_of(texts: DataFrame, suite: dict[int, list[str]], text_col: str, run: int) -> DataFrame:
    counts = corpus_counts(texts, suite, text_col)
    found, short = seeds(suite, counts, run), short_seeds(suite, counts)
    lookup = _lookup({*found, *short})

    def rows(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in aligned(words.plain_words(text), suite, found, short, lookup, run) if text else ():
                    for column, value in zip(out, (doc, *row)):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "item_id", "run_words", "item_words", "score", "share"])

    return texts.mapInArrow(rows, "doc_id bigint, item_id bigint, run_words int, item_words int, score int, share double")
