"""Text helpers with the semantics of the ECMAScript functions that the scores and gates are defined by."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space that trimming removes; Java's ``\s`` has only the ASCII part.
SPACE = r"[\s 　﻿]"
TOKEN = r"[a-zA-Z0-9]{2,}|[一-鿿]{2,}"
CJK = r"[一-鿿぀-ゟ゠-ヿ가-힯]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 units; Spark's ``length`` counts code points."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def bounded(pattern: str) -> str:
    """``\\b`` next to ASCII word characters only, as in ECMAScript: Java's also takes CJK letters for words."""
    if pattern.isascii():  # before a letter only one side is left to test
        pattern = re.sub(r"^((?:\(\?\w+\))?)\\b(?=[A-Za-z]|\((?:\?:)?[A-Za-z])", r"\1(?<![A-Za-z0-9_])", pattern)
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def any_of(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns occurs; nulls match nothing."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(c.rlike(bounded(p)), F.lit(False))
    return out


def query_tokens(c: Column, most: int = 12) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))), 1, most)


def text_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)))


def one_line(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"{SPACE}+", " "))
