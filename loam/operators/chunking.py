"""Chunks for embedding: up to a size, ending with a sentence, a line or a word, trimmed, with an overlap.

Positions are code points. A chunk also ends after ``lines`` lines. Nulls and blank texts have no chunks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENDING = re.compile(r"[.!?。！？]\s*")
_SPACE = re.compile(r"\s")


@dataclass(frozen=True)
class Config:
    size: int = 4000
    overlap: int = 200
    least: int = 200
    lines: int = 50


def for_model(tokens: int, cjk_ratio: float = 0.0) -> Config:
    """Sizes for a model's limit: 70 %, 5 % and 10 % of it, less by 2.5 for texts of CJK characters."""
    by = 2.5 if cjk_ratio > 0.3 else 1.0
    return Config(max(200, int(tokens * 0.7 / by)), max(0, int(tokens * 0.05 / by)), max(100, int(tokens * 0.1 / by)), 50)


def _end(text: str, start: int, cfg: Config) -> int:
    """Where the chunk from ``start`` ends, for a text that is longer than a chunk from there."""
    far, near = start + cfg.size, start + min(cfg.least, cfg.size)
    piece = text[start:far]
    if cfg.lines and piece.count("\n") >= cfg.lines:
        at = -1
        for _ in range(cfg.lines):
            at = piece.index("\n", at + 1)
        return max(start + at + 1, near)
    last = None
    for m in _ENDING.finditer(text, near, far):
        last = m.end()
    if last:
        return last
    if (at := text.rfind("\n", near, far)) >= 0:
        return at + 1
    for m in _SPACE.finditer(text, near, far):
        last = m.start()
    return last or far


def chunks(text: str | None, cfg: Config = Config()) -> list[tuple[int, int]]:
    """(start, end) of each chunk, without outer white space."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    pos, n = 0, len(text)
    while pos < n:
        end = n if n - pos <= cfg.size else _end(text, pos, cfg)
        if end < n and len(text[pos:end].strip()) < cfg.least:
            end = min(pos + cfg.size, n)
        piece = text[pos:end]
        if body := piece.strip():
            start = pos + len(piece) - len(piece.lstrip())
            out.append((start, start + len(body)))
        if end >= n:
            break
        pos = max(end - cfg.overlap, pos + 1)
    return out


def chunked(df: DataFrame, id_col: str, text_col: str, cfg: Config = Config()) -> DataFrame:
    """(id, chunk_no, start_index, end_index, length)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), [[] for _ in range(5)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (s, e) in enumerate(chunks(text, cfg)):
                    for column, v in zip(out, (i, k, s, e, e - s)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["id", "chunk_no", "start_index", "end_index", "length"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, chunk_no int, start_index bigint, end_index bigint, length bigint")
