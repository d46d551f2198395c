"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and batched decoding.

A character is an id (letters without accents, with a flag for upper case; digits are one; signs are their own), so the
input side of the gates is a table look-up. Windows are decoded many at a time.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from loam.llm.pii_examples import HAN_GIVEN, HAN_SURNAMES

KINDS = ["email", "phone", "id_number", "address", "name"]
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
SIGNS = " \n\t.,;:!?'\"-_/\\()[]{}<>@+=#&*|%$"
#: pad, other, other letter, letter outside the Latin alphabet, digit, characters of Chinese surnames and of given names,
#: signs, a-z, A-Z
OTHER, LETTER, FOREIGN, DIGIT, SURNAME, GIVEN_NAME, FIRST_SIGN = 1, 2, 3, 4, 5, 6, 7
FIRST_LETTER = FIRST_SIGN + len(SIGNS)
N_IDS = FIRST_LETTER + 52


#: Letters that are no base letter with a mark.
_BASE = {"ß": "s", "ẞ": "S", "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "æ": "a", "Æ": "A", "œ": "o", "Œ": "O", "ı": "i"}


@lru_cache(None)
def char_id(c: str) -> int:
    if c.isascii():
        if c.isdigit():
            return DIGIT
        if c.isalpha():
            return FIRST_LETTER + ord(c.lower()) - 97 + 26 * c.isupper()
        return FIRST_SIGN + SIGNS.index(c) if c in SIGNS else OTHER
    if c.isspace():
        return FIRST_SIGN
    if c in HAN_SURNAMES:
        return SURNAME
    if c in HAN_GIVEN:
        return GIVEN_NAME
    base = unicodedata.normalize("NFKD", c)[:1]
    if base.isascii() and base:
        return char_id(base)
    if c in _BASE:
        return char_id(_BASE[c])
    if c.isdigit():
        return DIGIT
    if c in "’‘‐‑–—":
        return FIRST_SIGN + SIGNS.index("'" if c in "’‘" else "-")
    return FOREIGN if c >= "⺀" else LETTER if c.isalpha() else OTHER


#: ids by code point; 0 if not classified yet
_IDS = np.zeros(0x110000, np.uint8)


def ids_of(text: str) -> np.ndarray:
    """The character ids of a text; each distinct character is classified once."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = _IDS[codes]
    if not ids.all():
        for c in np.unique(codes[ids == 0]).tolist():
            _IDS[c] = char_id(chr(c))
        ids = _IDS[codes]
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    """Parameters: per direction a look-up table (ids, 4h), recurrent weights (h, 4h) with gates i, f, o, g; emissions
    (2h, tags) and bias; transitions (tags, tags) with start and end rows."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, hidden: int = 32, seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.3, (N_IDS, 4 * hidden))
            p["x" + d][:, hidden : 2 * hidden] += 1.0  # remember at first
            p["h" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        p["e"] = rng.normal(0, 0.2, (2 * hidden, len(TAGS)))
        p["eb"] = np.zeros(len(TAGS))
        p["t"] = np.zeros((len(TAGS), len(TAGS)))
        p["s"] = np.zeros(len(TAGS))
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    @classmethod
    def load(cls, path: str) -> Tagger:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def _run(self, ids: np.ndarray, d: str, keep: bool):
        """Hidden states (t, b, h) of one direction over ids (t, b); the padding id 0 leaves the state empty."""
        table, rec = self.p["x" + d], self.p["h" + d]
        n = rec.shape[0]
        steps, batch = ids.shape
        h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        out = np.zeros((steps, batch, n), np.float32)
        saved = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[ids[t]] + h @ rec
            gates = _sigmoid(z[:, : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            before_c, before_h = c, h
            c = gates[:, n : 2 * n] * c + gates[:, :n] * g
            tc = np.tanh(c)
            h = gates[:, 2 * n :] * tc
            if (pad := ids[t] == 0).any():
                c, h = np.where(pad[:, None], 0, c), np.where(pad[:, None], 0, h)
            out[t] = h
            if keep:
                saved.append((t, gates, g, tc, before_c, before_h, pad))
        return out, saved

    def _steps(self, ids: np.ndarray, d: str):
        """As ``_run``, for decoding: (t, twice the hidden states of the first columns) step by step; columns beyond these are
        padding. One tanh gives all gates, each gate is a block of its own, and arrays are used again; cells and states are
        kept doubled, as sigmoids are (1 + tanh) / 2. Padding stands at the end of columns; nothing is computed for it
        where longer columns come first."""
        n = self.p["h" + d].shape[0]
        half = np.repeat(np.array([0.5, 1], np.float32), [3 * n, n])
        by_gate = lambda x: np.ascontiguousarray((x * half).reshape(-1, 4, n).transpose(1, 0, 2))
        table, rec = by_gate(self.p["x" + d]).reshape(-1, n), by_gate(self.p["h" + d] / 2)
        first = np.arange(4)[:, None] * (len(table) // 4)
        steps, batch = ids.shape
        pads = ids == 0
        live = (batch - pads[:, ::-1].argmin(1)) * ~pads.all(1)
        mixed = (pads.sum(1) > batch - live).tolist()
        h, new, c = (np.zeros((batch, n), np.float32) for _ in range(3))
        zs, ys, cs = (np.empty(k * batch * n, np.float32) for k in (4, 4, 1))
        m = -1
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            if live[t] != m:
                m = int(live[t])
                z, y, tc, cm = zs[: 4 * m * n].reshape(4, m, n), ys[: 4 * m * n].reshape(4, m, n), cs[: m * n].reshape(m, n), c[:m]
                gates, (i, f, o, g) = z[:3], z
            hm = new[:m]
            np.take(table, first + ids[t, :m], 0, out=z, mode="clip")
            np.matmul(h[:m], rec, out=y)
            z += y
            np.tanh(z, out=z)
            gates += 1
            g *= i
            cm *= f
            cm *= 0.5
            cm += g
            np.multiply(cm, 0.5, out=tc)
            np.multiply(o, np.tanh(tc, out=tc), out=hm)
            if mixed[t]:
                cm[pads[t, :m]] = 0
                hm[pads[t, :m]] = 0
            yield t, hm
            h, new = new, h

    def _states(self, ids: np.ndarray, d: str) -> np.ndarray:
        """Hidden states (t, b, h) of ``_steps``."""
        out = np.zeros((*ids.shape, self.p["h" + d].shape[0]), np.float32)
        for t, h in self._steps(ids, d):
            out[t, : len(h)] = h / 2
        return out

    def emissions(self, ids: np.ndarray, lean: float = 0.0) -> np.ndarray:
        """(t, tags, b) for ids (t, b); ``lean`` is added to B tags."""
        n = self.p["hf"].shape[0]
        bias = self.p["eb"].copy()
        bias[1::2] += lean
        e = np.empty((len(ids), len(TAGS), ids.shape[1]), np.float32)
        e[:] = bias[:, None]
        own = np.empty((ids.shape[1], len(TAGS)), np.float32)
        for d, weights in (("f", self.p["e"][:n] / 2), ("b", self.p["e"][n:] / 2)):
            for t, h in self._steps(ids, d):
                e[t, :, : len(h)] += np.matmul(h, weights, out=own[: len(h)]).T
        return e

    def decode(self, ids: np.ndarray, lean: float = 0.0) -> np.ndarray:
        """The best tags (t, b) by Viterbi over emissions and transitions; padding and the end count as O. ``lean`` is added
        where an item begins: a missed item costs more than a checked and dropped one."""
        e = self.emissions(ids, lean)
        t, b = np.nonzero(ids == 0)
        e[t, :, b] = -1e4
        e[t, 0, b] = 0
        trans, start = self.p["t"] + FORBIDDEN, self.p["s"] + FORBIDDEN_START
        tags = np.zeros(ids.shape, np.int64)
        if len(some := np.flatnonzero(_marked(e, trans, start))):
            tags[:, some] = _best(np.ascontiguousarray(e[:, :, some]), trans, start)
        return tags

    def loss_and_grads(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the gold tags (t, b) per window, and its gradients. Windows start at step 0."""
        p = self.p
        f, kept_f = self._run(ids, "f", True)
        b, kept_b = self._run(ids, "b", True)
        n = f.shape[2]
        both = np.concatenate([f, b], 2)
        e = both @ p["e"] + p["eb"]
        steps, batch, k = e.shape
        live = ids != 0
        trans = p["t"] + FORBIDDEN
        start = p["s"] + FORBIDDEN_START
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0] + start
        for t in range(1, steps):
            x = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
            alpha[t] = np.where(live[t][:, None], x, alpha[t - 1])
        z = _logsumexp(alpha[-1], 1)
        for t in range(steps - 2, -1, -1):
            x = _logsumexp(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(live[t + 1][:, None], x, 0)
        de = np.exp(alpha + beta - z[None, :, None])
        de[~live] = 0
        rows = np.arange(batch)
        gold_score = (start[gold[0]] + e[0, rows, gold[0]]).astype(np.float64)
        dt = np.zeros_like(p["t"])
        for t in range(1, steps):
            m = live[t]
            pair = alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]
            dt += np.exp(pair[m]).sum(0)
            np.add.at(dt, (gold[t - 1][m], gold[t][m]), -1)
            gold_score += np.where(m, p["t"][gold[t - 1], gold[t]] + e[t, rows, gold[t]], 0)
        ds = de[0].sum(0)
        np.add.at(ds, gold[0], -1)
        tt, bb = np.nonzero(live)
        de[tt, bb, gold[tt, bb]] -= 1
        flat = de.reshape(-1, k)
        grads = {"t": dt, "s": ds, "eb": flat.sum(0), "e": both.reshape(-1, 2 * n).T @ flat}
        dboth = de @ p["e"].T
        for d, kept, dout in (("f", kept_f, dboth[:, :, :n]), ("b", kept_b, dboth[:, :, n:])):
            dr = np.zeros_like(p["h" + d])
            all_dz = np.zeros((steps, batch, 4 * n), p["h" + d].dtype)
            dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
            for t, gates, g, tc, before_c, before_h, pad in reversed(kept):
                dh = dh + dout[t]
                dh[pad] = 0
                dc[pad] = 0
                i, fg, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                all_dz[t] = dz
                dr += before_h.T @ dz
                dh = dz @ p["h" + d].T
                dc = dc * fg
            which = (ids.reshape(-1)[None, :] == np.arange(N_IDS)[:, None]).astype(all_dz.dtype)
            grads["x" + d], grads["h" + d] = which @ all_dz.reshape(-1, 4 * n), dr
        return float((z - gold_score).mean()), {name: g / batch for name, g in grads.items()}


def _marked(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Columns of emissions (t, tags, b) whose best path may have another tag than O. ``score`` (t, kinds, b) bounds what a
    path that is within an item gains over O throughout: a change of kind costs no more than the cheapest does."""
    stay = trans[0, 0]
    starts, goes = trans[0, 1::2] - stay, np.maximum(np.diag(trans[1::2, 2::2]), np.diag(trans[2::2, 2::2])) - stay
    turn, back = (trans[1:, 1::2] - trans[0, 1::2]).max(), (trans[1:, 0] - stay).max()
    begin = e[:, 1::2] + starts[:, None]
    begin -= e[:, :1]
    go = e[:, 2::2] + goes[:, None]
    go -= e[:, :1]
    score = begin  # of step after step
    first = e[0, 1:] + start[1:, None]
    np.maximum(first[::2], first[1::2], out=score[0])
    score[0] -= e[0, 0] + start[0]
    top = np.empty_like(score[0, 0])
    for last, now, g in zip(score, score[1:], go[1:]):
        last.max(0, out=top)
        np.add(top, turn, out=top)
        now += np.maximum(top, 0, out=top)
        g += last
        np.maximum(now, g, out=now)
    return score.max((0, 1)) + back > -0.05  # long sums are rounded


def _best(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best paths (t, b) over emissions (t, tags, b). After the last step comes O, as where padding follows: a path doesn't
    depend on the other columns."""
    steps, k, batch = e.shape
    free = [0, *range(1, k, 2)]  # O and B tags follow any tag, an I tag its own kind
    into, begun, inside = trans[:, free, None], trans[range(1, k, 2), range(2, k, 2), None], trans[range(2, k, 2), range(2, k, 2), None]
    score, ways, top = np.empty_like(e), np.empty((k, len(free), batch), e.dtype), np.empty((len(free), batch), e.dtype)
    score[0] = e[0] + start[:, None]
    for t in range(1, steps):
        last, now = score[t - 1], score[t]
        np.max(np.add(last[:, None], into, out=ways), 0, out=top)
        now[0], now[1::2] = top[0], top[1:]
        np.maximum(last[1::2] + begun, last[2::2] + inside, out=now[2::2])
        now += e[t]
    # what a tag came from is looked up along the best path alone
    tags = np.zeros((steps, batch), np.int64)
    tags[-1] = (score[-1] + trans[:, :1]).argmax(0)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = (score[t - 1] + trans[:, tags[t]]).argmax(0)
    return tags


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = np.maximum(x.max(axis, keepdims=True), -1e3)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _forbidden() -> tuple[np.ndarray, np.ndarray]:
    bad = np.zeros((len(TAGS), len(TAGS)), np.float32)
    for a, x in enumerate(TAGS):
        for b, y in enumerate(TAGS):
            if y[0] == "I" and x[2:] != y[2:]:
                bad[a, b] = -1e4
    return bad, np.array([-1.0 if t[0] == "I" else 0.0 for t in TAGS], np.float32)


#: An inside tag follows its own kind only. A window may begin inside a span.
FORBIDDEN, FORBIDDEN_START = _forbidden()


class Adam:
    def __init__(self, rate: float = 3e-3):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            up = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            params[k] -= (self.rate * scale * up).astype(np.float32)
