"""Personal information in free text: found by a character tagger, replaced by typed placeholders.

1. Texts are tagged whole, every character of them; equal ones once. Only a text in which no span whatever could pass the
   exact check below (``possible``: conditions that follow from it) is left out, as it would come out empty.
2. Texts are cut in windows of ``WINDOW`` characters that overlap by ``OVERLAP``. Windows of many texts are decoded at once
   (``pii_model``): the bidirectional LSTM scores tags, Viterbi over the CRF transitions picks the best sequence. A window's
   tags don't depend on what it is decoded with.
3. The windows are reconciled globally: each character takes its tag from the window in whose middle it stands, and
   the spans are read off the whole text, so an item that crosses windows is one.
4. An exact check drops spans that cannot be of their kind (an e-mail without a host, a number with too few digits),
   trims them to it, and relabels numbers by their form.

Text within JSON is searched in its strings, and JSON held in strings likewise, whether it is complete or cut off. Every
character of such a string knows the place in the raw text that it comes from, so items are replaced there, whatever
their escapes, and what was JSON stays JSON.

Null and empty texts hold nothing. Placeholders such as [EMAIL] or <NAME> are no items. Texts of any length are
searched whole. Repeated rows are each replaced; ``found`` counts an id once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.pii_examples import HAN_GIVEN, HAN_SURNAMES
from loam.llm.pii_model import TAGS, Tagger, ids_of
from loam.llm.pii_train import WEIGHTS

WINDOW, OVERLAP, BATCH = 480, 96, 512
#: how far decoding leans towards items (``Tagger.decode``)
LEAN = 1.0
KINDS = ("email", "phone", "id_number", "address", "name")

_UPPER = "".join(chr(c) for c in range(0x80, 0x530) if chr(c).isupper())
_CAP = f"[A-Z{_UPPER}]"
#: small words within names
_PARTICLES = frozenset("de del da di von van der den la le y e dos du zu".split())
_CHANGE = re.compile(r"[A-Za-z](?=\d)|\d(?=[A-Za-z])")

#: A house number beside a name or a kind of street.
_HOUSE = re.compile(rf"\d[a-z]?(?: bis| ter)?,? +(?:{_CAP}|rue\b|avenue\b|place\b|calle\b|boulevard\b|chemin\b|quai\b)|{_CAP}[\w.’'-]*,? \d|(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm|steig|street|road) \d", re.UNICODE)
#: Words that stand before a name or a number and are no part of it: prepositions, articles, conjunctions and
#: pronouns; what numbers of parts are called.
_BEFORE = frozenset("In On At To By For From With Between Among Until Since After Before Near Within Under Over About Unlike Both Either Neither And Or But If When While Because Why How Who What That This These The A An My Our Your Ask Tell Call Dear Hi Hello Thanks Der Die Das Den Dem Des Ein Eine Für Von Bei Mit Nach Aus Zu Zum Zur Im Am Und Oder Wenn Weil Dass Le La Les Un Une Des Du De À Au Aux Dans Pour Avec Chez Sur Et Ou Si Selon El Los Las Una En Con Por Para Desde Sin Y O Según Note Nota".split())
_PART = re.compile(r"(?:chapter|section|page|lesson|step|version|article|figure|table|part|volume|kapitel|seite|chapitre|capítulo|página)\W*$", re.I)
_LEFT = re.compile(rf"(?<![\w.])({_CAP}[\w’'-]*)(?:\.|,)? (?:{_CAP}\. )?$")
_RIGHT = re.compile(rf",? (?:{_CAP}\. )?{_CAP}[\w’'-]+")
_DIALLED = re.compile(r"(?:\+|00)\d[\d ()./-]{7,}|0\d(?:[ .]\d\d){4}")
_EMAIL = re.compile(r"[\w+-]+(?:(?:\.| ?[(\[]dot[)\]] ?| dot )[\w+-]+)*\s?(?:@|[(\[{]\s?at\s?[)\]}]|\bat\b)\s?[\w-]+(?:\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|\bdot\b)\s?[\w-]+)+", re.I)


_HAN = re.compile("[一-鿿]{2}")
#: where digits other than 0 to 9 can be
_OTHER_DIGIT = re.compile("[²³¹\u0660-\u200f\u2060-\U0010ffff]")
#: necessary parts of items that pass ``_checked``: what follows the "at" of an e-mail, a house number before and after a
#: word, a first word of a name and, as its group, the beginning of the next one
_AT = re.compile(r"[aA](?<!\w.)[tT]\b\s?[)\]}]?\s?[\w-]+\s?(?:\.|[(\[{]?\s?[dD][oO][tT])")
_HOUSE_FIRST = re.compile(rf"\d[a-z]?(?: bis| ter)?,? +(?:{_CAP}|rue|avenue|place|calle|boulevard|chemin|quai)")
_HOUSE_LAST = re.compile(r" \d")
_NAME = re.compile(rf"{_CAP}(?<![^\W_].)[^\s,]*+([\s,]++(?:(?:{'|'.join(sorted(_PARTICLES))})[\s,]++)*+{_CAP})?")


def possible(text: str) -> bool:
    """Whether some span of the text could pass ``_checked``: an @ or a spelt-out "at" and dot of an e-mail, six digits of
    a number, a house number, two words of a name that only small words part, two Chinese characters."""
    digits = sum(map(text.count, "0123456789"))
    if not text.isascii():
        if _HAN.search(text):
            return True
        if _OTHER_DIGIT.search(text):
            digits = sum(map(str.isdigit, text))
    if "@" in text or digits >= 6 or digits and _HOUSE_FIRST.search(text) or any(m[1] for m in _NAME.finditer(text)) or _AT.search(text):
        return True
    return digits > 0 and any(_HOUSE.search(text[text.rfind(" ", 0, m.start()) + 1 : m.end()]) for m in _HOUSE_LAST.finditer(text))


@lru_cache(1)
def tagger(weights: str = WEIGHTS) -> Tagger:
    return Tagger.load(weights)


def _cut(n: int) -> list[tuple[int, int]]:
    """Windows over n characters that overlap."""
    if n <= WINDOW:
        return [(0, n)]
    return [*((x, x + WINDOW) for x in range(0, n - WINDOW, WINDOW - OVERLAP)), (n - WINDOW, n)]


def _checked(text: str, s: int, e: int, kind: str) -> tuple[int, int, str] | None:
    """The span without outer signs, if it can be of its kind."""
    while s < e and text[s] in " \t\n,;:.|<>\"'=-":
        s += 1
    while e > s and text[e - 1] in " \t\n,;:|<>\"'=-":
        e -= 1
    value = text[s:e]
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        # what the address itself spans
        return next(((max(0, s - 40) + m.start(), max(0, s - 40) + m.end(), kind) for m in _EMAIL.finditer(text[max(0, s - 40) : e + 40]) if max(0, s - 40) + m.start() < e and max(0, s - 40) + m.end() > s), None)
    if kind in ("phone", "id_number"):  # whole tokens
        while s and text[s - 1].isascii() and (text[s - 1].isalnum() or text[s - 1] == "+" or (text[s - 1] in "-./" and s > 1 and text[s - 2].isdigit())):
            s -= 1
        while e < len(text) and text[e].isascii() and (text[e].isalnum() or (text[e] in "-./" and e + 1 < len(text) and text[e + 1].isdigit())):
            e += 1
        value = text[s:e]
        digits = sum(c.isdigit() for c in value)
        if any(len(_CHANGE.findall(x)) >= 4 for x in value.split()):
            return None  # of a hash
    if kind == "id_number" and _DIALLED.fullmatch(value):  # a number that is dialled, by its form
        kind = "phone"
    if kind == "phone":
        good = digits >= 7
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value):  # a social security number by its form
            kind = "id_number"
    elif kind == "id_number":
        good = digits >= 6
    elif kind == "address":
        good = digits >= 1 and sum(c.isalpha() for c in value) >= 5 and _HOUSE.search(value) and not _PART.search(re.split(r"\d", value)[0])
    elif "一" <= value[:1] <= "鿿":
        good = 2 <= len(value) <= 4 and all("一" <= c <= "鿿" for c in value)
    else:
        while s and (text[s - 1].isalnum() or text[s - 1] in "’'-" and s > 1 and text[s - 2].isalpha()):  # whole words
            s -= 1
        while e < len(text) and (text[e].isalnum() or text[e] in "’'-" and e + 1 < len(text) and text[e + 1].isalpha()):
            e += 1
        if " " not in text[s:e]:  # a word tagged alone belongs to a capitalised neighbour
            if (m := _LEFT.search(text, max(0, s - 40), s)) and m[1] not in _BEFORE:
                s = m.start(1)
            elif m := _RIGHT.match(text, e):
                e = m.end()
        value = text[s:e]
        tokens = re.split(r"[\s,]+", value)
        while tokens[0] in _BEFORE and len(tokens) > 1:
            s += len(tokens[0])
            while s < e and text[s] in " \t\n,":
                s += 1
            value = text[s:e]
            tokens = re.split(r"[\s,]+", value)
        whole = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
        good = whole and len(tokens) > 1 and not digits and all(re.match(_CAP, x) or x in _PARTICLES for x in tokens) and tokens[0] not in _PARTICLES and tokens[-1] not in _PARTICLES and not re.search(r"[@\[\]{}<>/]", value)
    return (s, e, kind) if good else None


def find_all(texts: list[str], weights: str = WEIGHTS) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text, in order."""
    model = tagger(weights)
    places, pieces = [], []
    wide = []  # (text, first window) of each distinct text
    first_of: dict[str, int] = {}
    same = [first_of.setdefault(text or "", k) for k, text in enumerate(texts)]
    for text, k in first_of.items():
        if possible(text):
            ids = ids_of(text)
            wide.append((k, len(pieces)))
            for a, b in _cut(len(text)):
                places.append((a, b))
                pieces.append(ids[a:b])
    out: dict[int, list[tuple[int, int, str]]] = {}
    tags: list[np.ndarray | None] = [None] * len(pieces)  # of windows that hold a tag
    order = np.argsort([-len(p) for p in pieces], kind="stable")  # windows of like length together, longer ones first
    for t in range(0, len(order), BATCH):
        some = order[t : t + BATCH]
        ids = np.zeros((len(some), len(pieces[some[0]])), np.int64)
        for row, i in zip(ids, some):
            row[: len(pieces[i])] = pieces[i]
        found = model.decode(np.ascontiguousarray(ids.T), LEAN)
        for c in np.flatnonzero(found.any(0)):
            tags[some[c]] = found[: len(pieces[some[c]]), c].copy()
    ends = [w[1] for w in wide[1:]] + [len(pieces)]
    for (k, first), last in zip(wide, ends):
        if all(x is None for x in tags[first:last]):
            continue
        line = np.zeros(len(texts[k]), np.int64)
        # each window gives the characters up to the middle of its overlap with the next
        for i in range(first, last):
            a, b = places[i]
            left = a if i == first else (a + places[i - 1][1]) // 2
            line[left:b] = 0 if tags[i] is None else tags[i][left - a :]
        spans = out[k] = []
        marked = np.flatnonzero(line)
        at, own, j = marked.tolist(), line[marked].tolist(), 0
        while j < len(at):
            t, kind = at[j], TAGS[own[j]][2:]
            u, j = t + 1, j + 1
            while j < len(at) and at[j] == u and TAGS[own[j]] == f"I-{kind}":
                u, j = u + 1, j + 1
            if (span := _checked(texts[k], t, u, kind)) and (not spans or span[0] >= spans[-1][1]):
                spans.append(span)
    nothing: list[tuple[int, int, str]] = []
    return [out.get(k, nothing) for k in same]


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    for s, e, kind in sorted(spans, reverse=True):
        text = f"{text[:s]}[{kind.upper()}]{text[e:]}"
    return text


_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|["\\/bfnrt])')
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": " ", "f": " "}
_STRING = re.compile(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)("|\\?\Z)', re.DOTALL)


#: JSON held in a string
_HELD = re.compile(r'\s*"?[{\[]')


def _part(at: np.ndarray | int, a: int, b: int) -> np.ndarray | int:
    """The places of the characters from a to b and of the end."""
    return at + a if isinstance(at, int) else at[a : b + 1]


def unescaped(text: str, at: np.ndarray | int) -> tuple[str, np.ndarray | int]:
    """A JSON string's content with its escapes resolved; ``at`` has the raw place of each character and of the end, or
    that of the first if they stand one after the other."""
    if "\\" not in text:
        return text, at
    if isinstance(at, int):
        at = np.arange(at, at + len(text) + 1)
    out, places, last = [], [], 0
    for m in _ESCAPE.finditer(text):
        out += [text[last : m.start()], chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _PLAIN_ESCAPES.get(m[1], m[1])]
        places += [at[last : m.start()], at[m.start() : m.start() + 1]]
        last = m.end()
    return "".join([*out, text[last:]]), np.concatenate([*places, at[last:]])


def strings_of(text: str, at: np.ndarray | int = 0) -> list[tuple[str, np.ndarray | int]]:
    """The strings of a JSON text, complete or cut off, and of JSON held in these, with the raw place of each character
    (as in ``unescaped``); the text itself if it is no JSON."""
    head = text.lstrip()
    if head.startswith(('"{', '"[')):
        skip = len(text) - len(head) + 1
        whole = _STRING.match(text, skip - 1)
        end = whole.end(1) if whole else len(text)
        return strings_of(*unescaped(text[skip:end], _part(at, skip, end)))
    out = []
    for m in _STRING.finditer(text):
        if not (v := m[1]):
            continue
        p = _part(at, *m.span(1))
        if "\\" in v:
            v, p = unescaped(v, p)
        if _HELD.match(v):
            out += strings_of(v, p)
        else:
            out.append((v, p))
    return out if out or head.startswith(("{", "[")) else [(text, at)]


def values_of(text: str) -> list[str]:
    """The strings of ``strings_of`` without their places."""
    if "\\" not in text and text.startswith("{"):
        values = [v for v, _ in _STRING.findall(text) if v]
        if not any(map(_HELD.match, values)):
            return values
    return [v for v, _ in strings_of(text)]


def _search(batch: pa.RecordBatch, first: int, fields: list[str], as_json: set[str], weights: str):
    """(field, row, text, spans in the raw text) of each field that is not empty."""
    parts: list[str] = []
    rows = []
    for n, field in enumerate(fields):
        for r, text in enumerate(batch.column(first + n).to_pylist()):
            if text:
                rows.append((n, r, text, len(parts)))
                parts += values_of(text) if field in as_json else (text,)
    found = find_all(parts, weights)
    for (n, r, text, a), b in zip(rows, [*(row[3] for row in rows[1:]), len(parts)]):
        spans = []
        if any(found[a:b]):
            for (_, at), part in zip(strings_of(text) if fields[n] in as_json else [(text, 0)], found[a:b]):
                spans += [(at + s, at + e, kind) if isinstance(at, int) else (int(at[s]), int(at[e]), kind) for s, e, kind in part]
        yield n, r, text, spans


def items(df: DataFrame, id_col: str, fields: list[str], as_json: set[str] = frozenset(), weights: str = WEIGHTS) -> DataFrame:
    """(id, field, kind, n): how many items of each kind a field of a row holds."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[] for _ in range(4)]
            for n, r, _, spans in _search(batch, 1, fields, as_json, weights):
                counts: dict[str, int] = {}
                for _, _, kind in spans:
                    counts[kind] = counts.get(kind, 0) + 1
                for kind, c in counts.items():
                    for column, v in zip(out, (ids[r], fields[n], kind, c)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int32()))], names=["id", "field", "kind", "n"])

    return df.select(F.col(id_col).cast("string").alias("id"), *fields).where(F.col("id").isNotNull()).mapInArrow(run, "id string, field string, kind string, n int")


def redacted(df: DataFrame, id_col: str, fields: list[str], as_json: set[str] = frozenset(), weights: str = WEIGHTS) -> DataFrame:
    """(id, *fields) with a typed placeholder in the place of each item; nulls stay null."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(1 + n).to_pylist() for n in range(len(fields))]
            for n, r, text, spans in _search(batch, 1, fields, as_json, weights):
                if spans:
                    columns[n][r] = replaced(text, spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["id", *fields])

    return df.select(F.col(id_col).cast("string").alias("id"), *fields).mapInArrow(run, ", ".join(f"`{c}` string" for c in ("id", *fields)))
