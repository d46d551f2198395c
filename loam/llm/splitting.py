"""Cutting oversized texts into overlapping pieces at natural boundaries, by pointer doubling.

For every position ``e`` at which a piece may end, ``successors`` gives the farthest legal end of the next piece, which
starts at ``e - overlap``: one table for the whole text, made without a loop over the pieces. Squaring that table
(``succ[succ]``) doubles the number of pieces a pointer spans; the set of ends reached from the first cut doubles with
it, so all greedy cuts of a text of p pieces are there after log2(p) rounds.

Boundaries, best first: the end of a sentence, the end of a line, white space, a position not inside a word, any
position. A better kind wins if one lies in the second half of the piece. A piece but the last never ends inside a word
while there is white space in its second half.

Positions are 0-based code points; ends are exclusive. A null or empty text, and one within the limit, is no oversized
item. Work and memory for a text are in proportion to its length (some 40 bytes a code point), whatever the number of
pieces; texts are handled one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 4000, 200
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"[^\W_]")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s)|[。！？]")


def _flags(text: str, pattern: re.Pattern) -> np.ndarray:
    out = np.zeros(len(text), bool)
    out[[m.start() for m in pattern.finditer(text)]] = True
    return out


def text_flags(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Which code points are white space, and which are letters or digits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # each distinct character is classified once
    seen, place = np.unique(codes, return_inverse=True)
    chars = [chr(c) for c in seen]
    return np.array([c.isspace() for c in chars], bool)[place], np.array([c.isalnum() for c in chars], bool)[place]


def _last_at(marks: np.ndarray) -> np.ndarray:
    """For each position the largest marked one up to it, or -1."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks), dtype=np.int32), np.int32(-1)))


class Boundaries:
    """The legal cuts of one text."""

    def __init__(self, text: str, limit: int = LIMIT, overlap: int = OVERLAP):
        if not 0 <= overlap < limit // 2:
            raise ValueError("the overlap must be less than half of the limit")
        self.n, self.limit, self.overlap = n, limit, overlap = len(text), limit, overlap
        self.space, word = text_flags(text)
        self.spaces = np.concatenate([[0], np.cumsum(self.space, dtype=np.int32)])
        self.inside = np.zeros(n + 1, bool)  # a cut here is inside a word
        self.inside[1:n] = word[:-1] & word[1:]
        sentence, line, blank = (np.zeros(n + 1, bool) for _ in range(3))
        sentence[[m.end() for m in _SENTENCE.finditer(text)]] = True
        line[1:] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10
        blank[1:] = self.space
        self._last = [_last_at(m) for m in (sentence & ~self.inside, line, blank, ~self.inside)]

    def ends(self, starts: np.ndarray) -> np.ndarray:
        """The farthest legal end of a piece that starts at each of ``starts``."""
        far = np.minimum(starts + self.limit, self.n)
        half = starts + self.limit // 2
        end = far.copy()
        todo = far < self.n
        for last in self._last:
            at = last[far]
            take = todo & (at > half)
            end[take] = at[take]
            todo &= ~take
        return end

    def successors(self) -> np.ndarray:
        """For each end of a piece the end of the next; a text's end leads to itself, as do ends before the overlap."""
        at = np.arange(self.n + 1, dtype=np.int32)
        succ = self.ends(np.maximum(at - self.overlap, 0))
        succ[self.n] = self.n
        return np.where(succ > at, succ, np.minimum(at + 1, self.n)).astype(np.int32)

    def cuts(self) -> np.ndarray:
        """All ends of the greedy pieces, by pointer doubling."""
        succ = self.successors()
        reached = self.ends(np.zeros(1, np.int32))
        while reached.max() < self.n:
            reached = np.union1d(reached, succ[reached])
            succ = succ[succ]
        return reached

    def pieces(self) -> np.ndarray:
        """Rows (start, end)."""
        ends = self.cuts()
        return np.stack([np.concatenate([[0], ends[:-1] - self.overlap]), ends], 1)

    def legal(self, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether stored pieces, in order, are a path in the graph of legal successors from the text's start to its end.

        The place before piece k leads to the place after it if the piece starts where it must and its end is a legal
        successor of the previous end, at most the farthest one; else it leads nowhere. Squaring that table shows where
        the start leads to."""
        s, e, n = np.asarray(starts, np.int64), np.asarray(ends, np.int64), self.n
        k = len(s)
        if not k or ((s < 0) | (e > n) | (e <= s)).any():
            return False
        before = np.concatenate([[self.overlap], e[:-1]])
        farthest = np.minimum(before - self.overlap + self.limit, n)
        half = (s + e) // 2
        cuts_a_word = self.inside[e] & (self.spaces[e] > self.spaces[half]) & (np.arange(k) < k - 1)
        nowhere = k + 1
        succ = np.append(np.where((s == before - self.overlap) & (e <= farthest) & ~cuts_a_word, np.arange(1, k + 1), nowhere), [k, nowhere])
        steps = 1
        while steps < k:
            succ = succ[succ]
            steps *= 2
        return bool(succ[0] == k and e[-1] == n)


PIECES = T.StructType([T.StructField("id", T.StringType()), T.StructField("chunk_no", T.IntegerType()), T.StructField("start_index", T.LongType()), T.StructField("end_index", T.LongType()), T.StructField("text", T.StringType()), T.StructField("stored_valid", T.BooleanType())])


def split_oversized(entries: DataFrame, stored: DataFrame | None = None, id_col: str = "id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, texts: bool = True) -> DataFrame:
    """The pieces (id, chunk_no, start_index, end_index, text, stored_valid) of each text longer than ``limit``.

    ``stored``: pieces (memory_id, chunk_no, start_index, end_index) of an earlier cut; ``stored_valid`` says whether
    the entry's stored pieces, taken by chunk_no, are a path of legal successors (false if there are none). Repeated
    rows of an entry or a piece count once; so does an id with copies of one text. A null position makes a stored cut
    invalid; pieces of other ids are ignored. Columns other than the named ones are not read. ``texts``: whether the
    pieces' texts are wanted, or nulls.
    """
    long = entries.where(F.length(text_col) > limit).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if stored is None:
        joined = long.withColumn("cut", F.lit(None).cast("array<struct<chunk_no:int,start_index:bigint,end_index:bigint>>"))
    else:
        cuts = stored.select(F.col("memory_id").alias("id"), F.struct(F.col("chunk_no").cast("int").alias("chunk_no"), F.col("start_index").cast("long").alias("start_index"), F.col("end_index").cast("long").alias("end_index")).alias("piece")).groupBy("id").agg(F.sort_array(F.collect_set("piece")).alias("cut"))
        joined = long.join(cuts, "id", "left")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, cut in zip(*(batch.column(c) for c in ("id", "text", "cut"))):
                text, cut = text.as_py(), cut.as_py() or []
                bounds = Boundaries(text, limit, overlap)
                pieces = bounds.pieces()
                whole = cut and all(p["start_index"] is not None and p["end_index"] is not None for p in cut)
                valid = bool(whole) and bounds.legal([p["start_index"] for p in cut], [p["end_index"] for p in cut])
                k = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * k, pa.string()), pa.array(range(k), pa.int32()), pa.array(pieces[:, 0], pa.int64()), pa.array(pieces[:, 1], pa.int64()), pa.array([text[s:e] for s, e in pieces.tolist()] if texts else [None] * k, pa.string()), pa.array([valid] * k, pa.bool_())], names=PIECES.names)

    # repeated rows go before the texts are cut; the join has brought them together
    return joined.select("id", "text", "cut").dropDuplicates(["id"]).mapInArrow(rows, PIECES)
