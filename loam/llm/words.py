"""Words of a text: runs of letters and digits, ignoring case, accents and compatibility forms."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.DOTALL)


def _unmarked(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Me"))


def folded(text: str) -> str:
    """Lower case without accents and compatibility forms."""
    if text.isascii():
        return text.lower()
    return _unmarked(_unmarked(text).casefold())


def words(text: str | None) -> list[str]:
    return WORD.findall(folded(text)) if text else []


def visible(text: str) -> str:
    """The text without invisible characters (format characters and variation selectors)."""
    if text.isascii():
        return text
    return "".join(c for c in text if unicodedata.category(c) != "Cf" and not "︀" <= c <= "️")


def plain_words(text: str | None) -> list[str]:
    """Words of a text with markup: a tag ends a word, an invisible character doesn't."""
    if not text:
        return []
    text = visible(text)
    return WORD.findall(folded(TAG.sub(" ", text) if "<" in text else text))
