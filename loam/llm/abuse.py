"""Abusive, hateful and sexually explicit language: noisy-channel decoding, then scoring of the restored text.

Restoring. Writers disguise words: digits and signs for letters, stars, dots, invisible characters or spaces between
letters, letters repeated. A token that may be disguised becomes a lattice: each sign has the letters it can stand for,
with the cost of that disguise; a repeated run stands for one or two letters; separators for nothing. ``Decoder`` finds
the most probable word: Viterbi over the lattice under a character trigram model, whose counts come from every word of
the whole corpus (at most 27 ** 3 numbers), against Viterbi in the trie of the known words, which have a prior of
their own. Lattices are of any length and no state is dropped. Undisguised tokens are their own restoration. Chinese is
matched without spaces.

Scoring. ``cues`` finds in each sentence of the restored text what makes it abusive, hateful or explicit, by how words
stand to each other: an insult beside a word that speaks to a person, a verb that hurts before that person or a part of
the body, a group beside what dehumanises or expels it, explicit words and their company. Words that talk about such
language weaken cues that nobody is addressed by. Each cue has a probability that a text with it is a case; ``fitted``
takes these from rated documents, with the built-in ones as a prior, and allows for mistaken ratings. The probabilities
of a document's cues are joined (1 - product of the complements). ``THRESHOLD`` is what is reported as found.

Null and empty texts score 0. Copies are each scored. Every sentence is looked at once in a batch of documents, whatever
the number of its copies. Null ratings and those of unknown documents are ignored; raters of one document are averaged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import abuse_words as A
from loam.llm import words

THRESHOLD = 0.5
#: What signs can stand for.
SIGNS = {"0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "2": "z", "€": "e", "6": "g", "(": "c"}
STARS = "*#"
SEPARATORS = ".-_·~'’"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGN_COST, STAR_COST, REPEAT_COST, GAP_COST = 1.0, 2.0, 0.7, 0.7
#: log of the prior of each known word, and of any other word
KNOWN_PRIOR, OTHER_PRIOR = math.log(1e-4), math.log(0.05)

_SENTENCE = re.compile(r"(?<=[!?。！？])\s+|(?<=[.])\s+(?=\S)|\n+")
_TOKEN = re.compile(r"[^\s,;:?\"“”«»()\[\]<>{}]+")
_PLAIN = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W_])(?=[\d@$*]{0,2} ?[^\W\d_])(?:[^\W_] |[@$*] ){2,}(?:[^\W_]|[@$*])(?![^\W_])")
_CJK = re.compile(r"[㐀-鿿]")
_TRIPLE = re.compile(r"(.)\1\1")
_GROUP = re.compile(r"[^\W\d_]{4,}s|[^\W\d_]{4,}(?:er|en|i|es)")


def corpus_trigrams(documents: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Counts of the character trigrams of every plain word of every document; ``_`` is a word's edge."""

    def rows(batches):
        counts: Counter = Counter()
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(_PLAIN.findall(text))
            for word, n in seen.items():
                w = words.folded(word)
                if w.isascii() and w.isalpha():
                    w = f"__{w}_"
                    for i in range(len(w) - 2):
                        counts[w[i : i + 3]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    found = documents.select(text_col).mapInArrow(rows, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in found.collect()}


def known_words() -> set[str]:
    lists = [A.INSULTS, A.MILD, A.DEMEANING, A.YOU, A.YOUR, A.VIOLENCE, A.HURT, A.BODY, A.DIE, A.DEHUMAN, A.EXPEL, A.STRONG_SEX, A.WEAK_SEX, {w for p in A.SILENCE for w in p}]
    return {w for ws in lists for w in ws if len(w) > 1}


class Decoder:
    """Restores disguised tokens; ``trigrams`` are the counts of the language model."""

    def __init__(self, trigrams: dict[str, int]):
        self.known = known = known_words()
        self.trie: dict = {}
        own: Counter = Counter(trigrams)
        for w in known:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
            e = f"__{w}_"
            for i in range(len(e) - 2):
                own[e[i : i + 3]] += 5
        pairs: Counter = Counter()
        for g, n in own.items():
            pairs[g[:2]] += n
        size = len(LETTERS) + 1
        self.log = {g: math.log((n + 0.1) / (pairs[g[:2]] + 0.1 * size)) for g, n in own.items()}
        self.least = {p: math.log(0.1 / (n + 0.1 * size)) for p, n in pairs.items()}
        self.decode = lru_cache(100_000)(self._decode)

    def step(self, a: str, b: str, c: str) -> float:
        return self.log.get(a + b + c) or self.least.get(a + b, -math.log(27.0))

    def lattice(self, token: str) -> list[list[tuple[str, float]]] | None:
        """For each place the strings it can stand for, with their costs; None if it is no disguise of a word."""
        out: list[list[tuple[str, float]]] = []
        i, n = 0, len(token)
        while i < n:
            c = token[i]
            j = i
            while j < n and token[j] == c:
                j += 1
            run = j - i
            if c in LETTERS:
                out.append([(c, REPEAT_COST), (c * 2, REPEAT_COST)] if run >= 3 else [(c * 2, 0.0), (c, REPEAT_COST)] if run == 2 else [(c, 0.0)])
            elif c in STARS:
                out += [[(x, STAR_COST) for x in LETTERS]] * run
            elif c in SIGNS:
                out += [[(x, SIGN_COST) for x in SIGNS[c]]] * run
            elif c in SEPARATORS:  # a run of them is one gap
                if not out or out[-1] != [("", GAP_COST)]:
                    out.append([("", GAP_COST)])
            else:
                return None
            i = j
        return out

    def _decode(self, token: str) -> str:
        """The most probable word behind a folded token."""
        if token.isalpha() and token.isascii() and not _TRIPLE.search(token):
            return token
        tail = token.rstrip("!.'’*" if token.strip("*") and not token.rstrip("!.").endswith("*") else "!.'’")
        lattice = self.lattice(tail.lstrip("'’"))
        if not lattice:
            return token
        letters = sum(c in LETTERS for c in tail)
        if not letters or letters < sum(c.isdigit() for c in tail) - 1:
            return token
        # known words: Viterbi in the trie
        paths = [(0.0, self.trie)]
        for options in lattice:
            grown: dict[int, tuple[float, dict]] = {}
            for cost, node in paths:
                for text, extra in options:
                    at = node
                    for c in text:
                        at = at.get(c)
                        if at is None:
                            break
                    if at is not None and (id(at) not in grown or grown[id(at)][0] > cost + extra):
                        grown[id(at)] = (cost + extra, at)
            paths = list(grown.values())
        best = min(((cost, node[""]) for cost, node in paths if "" in node), default=None)
        if best and any(c in STARS for c in tail) and letters < 2:
            best = None
        # any word: Viterbi over the last two letters under the character model
        states: dict[tuple[str, str], tuple[float, str]] = {("_", "_"): (OTHER_PRIOR, "")}
        for options in lattice:
            grown2: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (p, done) in states.items():
                for text, cost in options:
                    x, y, q = a, b, p - cost
                    for c in text:
                        q += self.step(x, y, c)
                        x, y = y, c
                    if (x, y) not in grown2 or grown2[x, y][0] < q:
                        grown2[x, y] = (q, done + text)
            states = grown2  # at most one for each two letters
        free = max((p + self.step(a, b, "_"), done) for (a, b), (p, done) in states.items())
        if best and KNOWN_PRIOR - best[0] >= free[0]:
            return best[1]
        return free[1] or token


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(words.visible(text)) if s and not s.isspace()]


_DISGUISE = re.compile(r"[^\W\d_][\d@$*!|+#._~·-]+[^\W\d_]|[\d@$!|+*][^\W\d_]|[^\W\d_]\*|[^\W\d_][013457@$](?!\w)|(.)\1\1")


def restored(sentence: str, decoder: Decoder) -> tuple[list[str], list[str]]:
    """Folded restored words, and those that may name a group, as they are restored."""

    def joined(m: re.Match) -> str:
        """Spaced letters as a token; the first may be a word of its own, as in "a l o s e r"."""
        s = m.group().replace(" ", "")
        low = words.folded(s)
        if decoder.decode(low) not in decoder.known and decoder.decode(low[1:]) in decoder.known:
            return f"{s[0]} {s[1:]}"
        return s

    sentence = _SPACED.sub(joined, sentence)
    out, groups = [], []
    for token in _TOKEN.findall(sentence):
        low = words.folded(token)
        if _DISGUISE.search(low):
            bare = low.strip(".!'’")
            w = decoder.decode(bare if bare else low)
            parts = [w] if w.isalpha() else _PLAIN.findall(w)
        else:
            parts = _PLAIN.findall(low)
        if token[:1].isupper() and parts and len(parts[0]) >= 5:
            groups.append(parts[0])
        out += parts
    return out, groups


#: cue -> (kind, probability that a text with it is a case)
CUES = {
    "insult_you": ("abusive", 0.95), "insult_your": ("abusive", 0.8), "insult_said": ("abusive", 0.9), "insult_other": ("abusive", 0.6), "insult_named": ("abusive", 0.3),
    "demeaned": ("abusive", 0.85), "threat": ("abusive", 0.95), "wish": ("abusive", 0.9), "order": ("abusive", 0.9), "silence": ("abusive", 0.75), "rejected": ("abusive", 0.75),
    "group_called": ("hateful", 0.9), "group_denied": ("hateful", 0.9), "group_expelled": ("hateful", 0.9), "group_named": ("hateful", 0.1),
    "explicit": ("explicit", 0.9), "explicit_named": ("explicit", 0.3),
}
NAMES = list(CUES)
#: documents that the prior of a cue counts for; rated documents used at most; how often ratings are mistaken at least
PRIOR_WEIGHT, MOST_RATED, LEAST_MISTAKEN = 40.0, 20_000, 0.02
_STOPS = frozenset("before after when while because if once until so that which where als bevor wenn weil avant quand si antes cuando porque and und et y but or the a".split())


def _near(ws: list[str], at: int, wanted, before: int, after: int) -> bool:
    return any(w in wanted for w in ws[max(0, at - before) : at]) or any(w in wanted for w in ws[at + 1 : at + 1 + after])


def cues(ws: list[str], groups: list[str]) -> dict[str, float]:
    """The cues of a sentence of restored words; ``groups``: the words in it that may name a group of people."""
    have = set(ws)
    out: dict[str, float] = {}

    def add(name: str, weight: float = 1.0) -> None:
        out[name] = max(weight, out.get(name, 0.0))

    n = len(ws)
    talks = [k for k, w in enumerate(ws) if w in A.ABOUT]
    about_at = lambda i: 0.3 if any(abs(k - i) <= 5 for k in talks) else 1.0
    speaks = bool(have & A.YOU)
    for i, w in enumerate(ws):
        if w in A.INSULTS or w in A.MILD:
            clear, about = w in A.INSULTS or ws[max(0, i - 2) : i] == ["piece", "of"], about_at(i)
            addressed = _near(ws, i, A.YOU, 7, 4)
            stated = _near(ws, i, A.IS, 7, 0) or (i and ws[i - 1] in A.YOU) or (i > 1 and ws[i - 2] in A.YOU and ws[i - 1] in A.DEMEANING)
            if addressed and (clear or (stated and (ws[max(0, i - 2) : i] or [""])[-1] not in ("the", "my", "our"))):
                add("insult_you", 1.0 if clear else 0.9)
            elif clear and have & A.YOUR:
                add("insult_your")
            elif clear and speaks:
                add("insult_you", 0.9)
            elif clear and n <= 5 or (clear or have & A.DEMEANING) and i and ws[i - 1] in A.DEMEANING:
                add("insult_said", about)
            elif clear and _near(ws, i, A.OTHERS, 5, 2):
                add("insult_other", about)
            elif clear:
                add("insult_named", about)
        if w in A.DEMEANING and i and (ws[i - 1] in A.YOU or (i > 1 and ws[i - 1] in A.IS | {"so", "such", "a", "un", "une", "ein", "ganz"} and ws[i - 2] in A.YOU)) and (i + 1 == n or n - i <= 4 or ws[i + 1] in A.INSULTS | A.MILD):
            add("demeaned", 0.8)
        if w in A.VIOLENCE:
            for k in range(i + 1, min(n, i + 5)):
                if ws[k] in A.BODY and _near(ws, k, A.YOUR | A.YOU | {"die", "la", "les", "dir", "te"}, 3, 0) and (have & (A.YOU | A.YOUR)):
                    add("threat")
                if ws[k] in A.YOU and not any(x in _STOPS for x in ws[i + 1 : k]) and k - i <= 3 and (k + 1 == n or ws[k + 1] not in A.YOUR) and (w not in ("hit", "break", "kick", "crack", "hang") or k + 1 == n):
                    add("threat")
            if w in ("umbringen", "matar", "partir", "tuer", "crever", "toten", "verprugeln", "casser", "defoncer") and speaks:
                add("threat")
            if w in ("bring", "bringe") and "um" in ws[i : i + 5] and speaks:
                add("threat")
        if w in A.HURT and _near(ws, i, A.YOU, 6, 0) and _near(ws, i, {"be", "get", "deserve", "deserves"}, 3, 0):
            add("threat")
        if w in A.BODY and have & A.VIOLENCE and _near(ws, i, A.YOUR | A.YOU | {"dir", "te"}, 4, 0) and any(x in A.VIOLENCE for x in ws[max(0, i - 5) : i + 3]):
            add("threat")
        if w in A.WISH:
            after = ws[i + 1 : i + 9]
            for k, x in enumerate(after):
                if x in A.DIE and any(y in A.YOU for y in after[:k]) and k <= 3:
                    add("wish")
                if x in A.VIOLENCE | A.HURT and any(y in A.YOU for y in after[max(0, k - 3) : k + 3]) and "someone" in after[:k] + ["someone"][: x in A.HURT]:
                    add("wish")
        if w in A.DIE and w not in ("die", "burn", "suffer", "dies", "choke", "bleed", "mourir", "crever", "rot") and (speaks or n <= 4):
            add("order")
        if w in ("die", "rot") and i and (ws[i - 1] in A.GO or (ws[i - 1] in ("you", "just") and n <= 4)):
            add("order")
        if w in ("verrecke", "krepiere", "verreck", "krepier", "muerete", "pudrete") and (i == 0 or have & (A.INSULTS | A.MILD)):
            add("order")
        if w in A.GO:
            rest = ws[i + 1 : i + 8]
            if any(x in A.HOLE for x in rest) and (w != "get" and ("back" in rest or any(x in A.DIE for x in rest) or have & (A.YOUR | A.INSULTS))):
                add("order", 0.95)
            if w in ("jump", "spring", "saute", "tirate") and any(x in A.PLUNGE for x in rest):
                add("order", 0.95)
        if w == "yourself" and i and ws[i - 1] in ("kill", "hang", "shoot", "drown"):
            add("threat")
        if w in A.NOBODY:
            rest = ws[i + 1 : i + 5]
            for k, x in enumerate(rest):
                if x in A.LOVE and (set(rest[: k + 2]) | set(ws[i + k + 2 : i + k + 4])) & (A.YOU - {"es", "tu", "t"}):
                    add("rejected", 1.0 if n <= 12 else 0.8)
    for parts in A.SILENCE:
        if parts[0] in have and all(p in ws[ws.index(parts[0]) : ws.index(parts[0]) + 4] for p in parts):
            add("silence", 1.0 if have & (A.INSULTS | A.MILD | A.DEMEANING) or n <= 6 else 0.7)
    named = [i for i, w in enumerate(ws) if w in A.GROUPS or w in groups]
    for i in named:
        after = ws[i + 1 : i + 9]
        known, about = 1.0, about_at(i)
        is_at = next((k for k, x in enumerate(after[:4]) if x in A.IS), None)
        if is_at is not None:
            for k, x in enumerate(after[is_at + 1 : is_at + 5]):
                if x in A.DEHUMAN and not set(after[is_at + 1 : is_at + 1 + k]) & A.DENIED:
                    add("group_called", known * about)
            if set(after[is_at + 1 : is_at + 3]) & A.DENIED and set(after[is_at + 1 : is_at + 5]) & A.HUMAN:
                add("group_denied", known * about)
        if set(after[:5]) & A.DESERVE and set(after[:7]) & A.DENIED and set(after) & A.RIGHTS:
            add("group_denied", known * about)
        if set(after[:5]) & A.BREED and "like" in after[:6] and set(after) & A.DEHUMAN:
            add("group_called", known * about)
        around = ws[max(0, i - 6) : i + 10]
        if set(around) & A.MUST and set(after + ws[max(0, i - 3) : i]) & A.EXPEL:
            add("group_expelled", known * about)
        if "out" in after[:3] and set(after) & A.PLACES and set(ws[max(0, i - 4) : i]) & {"keep", "throw", "kick", "get", "drive", "chase"}:
            add("group_expelled", known * about)
        if set(around) & A.DEHUMAN and set(around) & (A.BLOOD | A.ALL) and (set(around) & (A.MUST | A.BLOOD) or is_at is not None):
            add("group_called", known * about)
        if "good" in ws[max(0, i - 2) : i] and "only" in ws[max(0, i - 4) : i] and set(after) & {"gone", "dead", "one", "ones"}:
            add("group_expelled", known * about)
        if "kind" in after[:2] and set(after) & {"ruin", "ruins", "destroys", "poisons", "spoils"}:
            add("group_called", known * about)
        if set(around) & A.DEHUMAN:
            add("group_named", about)
    points = 0.0
    strong = [w for w in ws if w in A.STRONG_SEX]
    weak = {w for w in ws if w in A.WEAK_SEX}
    about = max((about_at(k) for k, w in enumerate(ws) if w in A.STRONG_SEX or w in A.WEAK_SEX), default=1.0)
    points = 2.0 * len(set(strong)) + len(weak)
    if weak and have & A.PICTURES:
        points += 1
    if weak and have & A.TOUCH:
        points += 0.5
    if points >= 2:
        add("explicit", about if points < 5 else max(about, 0.6))
    elif points:
        add("explicit_named", about)
    return out


def chinese_cues(sentence: str) -> dict[str, float]:
    s = re.sub(r"[\s*._-]", "", sentence)
    about = 0.3 if any(w in s for w in A.CHINESE_ABOUT) else 1.0
    out = {}
    if any(w in s for w in A.CHINESE_INSULTS):
        out["insult_you" if any(w in s for w in A.CHINESE_PERSON) else "insult_named"] = about
    if any(w in s for w in A.CHINESE_ORDERS):
        out["order"] = about
    if any(w in s for w in A.CHINESE_HATE):
        out["group_called"] = about
    if any(w in s for w in A.CHINESE_SEXUAL):
        out["explicit"] = about
    return out


def finder(trigrams: dict[str, int]):
    """sentence -> its cues"""
    decoder = Decoder(trigrams)

    @lru_cache(200_000)
    def of(sentence: str) -> tuple[tuple[int, float], ...]:
        found = cues(*restored(sentence, decoder))
        if _CJK.search(sentence):
            for k, v in chinese_cues(sentence).items():
                found[k] = max(v, found.get(k, 0.0))
        return tuple((NAMES.index(k), v) for k, v in found.items())

    return of


def document_cues(documents: DataFrame, trigrams: dict[str, int], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, one column for each cue: its largest weight in a sentence) for every document."""
    kept = documents.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("__text"))

    def rows(batches):
        of = finder(trigrams)
        for batch in batches:
            out = np.zeros((batch.num_rows, len(NAMES)))
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if text:
                    for s in sentences(text):
                        for k, v in of(s):
                            out[i, k] = max(out[i, k], v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(out[:, k]) for k in range(len(NAMES)))], names=["doc_id", *keep, *(f"cue_{k}" for k in NAMES)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(rows, f"{schema}, {', '.join(f'cue_{k} double' for k in NAMES)}")


def fitted(documents: DataFrame, ratings: DataFrame, trigrams: dict[str, int], most: int = MOST_RATED) -> dict[str, float]:
    """Each cue's probability, from at most ``most`` rated documents (doc_id, toxic), chosen by a hash.

    A document stands for its strongest cue. Mistaken ratings are as frequent as ratings of 1 for documents without any
    cue; what is left of a cue's rate after these is joined with its built-in probability."""
    rated = ratings.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(most)
    found = document_cues(documents.join(rated.select("doc_id"), "doc_id", "left_semi"), trigrams).join(rated, "doc_id").toArrow()
    prior = np.array([CUES[k][1] for k in NAMES])
    if not found.num_rows:
        return dict(zip(NAMES, prior))
    x = np.stack([found.column(f"cue_{k}").to_numpy() for k in NAMES], 1) * prior
    toxic = found.column("toxic").to_numpy()
    best, any_cue = x.argmax(1), x.max(1) > 0
    mistaken = min(0.3, max(LEAST_MISTAKEN, toxic[~any_cue].mean() if (~any_cue).any() else 0.0))
    out = {}
    for k, name in enumerate(NAMES):
        own = any_cue & (best == k) & (x[:, k] >= 0.6 * prior[k])
        rate = np.clip((toxic[own].sum() - mistaken * own.sum()) / (1 - 2 * mistaken), 0, own.sum())
        out[name] = float((rate + PRIOR_WEIGHT * prior[k]) / (own.sum() + PRIOR_WEIGHT))
    return out


def scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ratings: DataFrame | None = None) -> DataFrame:
    """(doc_id, *keep, abusive, hateful, explicit, score) for every document; ``ratings``: (doc_id, toxic) to fit by."""
    trigrams = corpus_trigrams(documents, text_col)
    p = fitted(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ratings, trigrams) if ratings is not None else {k: v[1] for k, v in CUES.items()}
    found = document_cues(documents, trigrams, id_col, text_col, keep)
    join = lambda names: 1 - math.prod((1 - F.col(f"cue_{k}") * p[k] for k in names), start=F.lit(1.0))
    kinds = [join([k for k in NAMES if CUES[k][0] == kind]).alias(kind) for kind in ("abusive", "hateful", "explicit")]
    return found.select("doc_id", *keep, *kinds, join(NAMES).alias("score"))


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rates per source, whose names differ in case and spaces only by mistake."""
    source = F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source")
    return scored.groupBy(source).agg(F.count("*").alias("n"), F.sum((F.col("score") >= threshold).cast("long")).alias("n_found"), *[F.avg((F.col(c) >= threshold).cast("double")).alias(f"rate_{c}") for c in ("score", "abusive", "hateful", "explicit")])
