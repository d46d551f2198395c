"""JSON in the answers of language models: finding the object, and repairing the usual mistakes."""

from __future__ import annotations

import json
import re

_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.DOTALL)
_BRACE = re.compile(r"[{}]")
_QUOTE_ENDS = re.compile(r'"(?=\s*(?:[,}\]:]|\Z))')
_CONTROL = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def extracted(text: str | None) -> str | None:
    """The content of a fence, or the first balanced object; None without one."""
    if not text:
        return None
    if m := _FENCE.search(text):
        return m[1].strip()
    start, depth = text.find("{"), 0
    for m in _BRACE.finditer(text, max(start, 0)) if start >= 0 else ():
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[start : m.end()]
    return None


def repaired(text: str) -> str:
    """Quotes within strings escaped, control characters escaped, trailing commas dropped.

    A string ends at the first unescaped quote that is followed by a sign that may follow a string."""
    out, at = [], 0
    while (q := text.find('"', at)) >= 0:
        out.append(re.sub(r",(?=\s*[}\]])", "", text[at:q]))
        end = q + 1
        body = []
        while end < len(text):
            c = text[end]
            if c == "\\":
                body.append(text[end : end + 2])
                end += 2
                continue
            if c == '"':
                if _QUOTE_ENDS.match(text, end):
                    break
                c = '\\"'
            body.append(_CONTROL.get(c, c))
            end += 1
        out.append('"' + "".join(body) + '"')
        at = end + 1
    out.append(re.sub(r",(?=\s*[}\]])", "", text[at:]))
    return "".join(out)


def loaded(text: str | None):
    """The object in a text, repaired if it must be; None if there is none."""
    found = extracted(text)
    for candidate in (found, repaired(found) if found else None):
        if candidate:
            try:
                return json.loads(candidate)
            except ValueError:
                continue
    return None
