"""Trains the tagger: ``python -m loam.llm.pii_train [seconds] [processes] [--on]`` writes pii_weights.npz beside this
file; ``--on`` goes on from the weights that are there.

Texts come from ``pii_examples``; windows of ``STEPS`` characters begin anywhere in them. Several processes take
``LOCAL`` steps each from the same weights, whose mean is the next start. The held-out figures are of texts made of
openings, endings and fillers that training never saw.
"""

from __future__ import annotations

import multiprocessing
import os
import sys
import time
from pathlib import Path

import numpy as np

from loam.llm.pii_examples import Maker
from loam.llm.pii_model import KINDS, TAGS, Adam, Tagger, ids_of

WEIGHTS = str(Path(__file__).with_name("pii_weights.npz"))
STEPS, BATCH, LOCAL = 80, 128, 10


def labelled(maker: Maker) -> tuple[np.ndarray, np.ndarray]:
    text, spans = maker.example()
    tags = np.zeros(len(text), np.int64)
    for s, e, k in spans:
        tags[s] = TAGS.index(f"B-{k}")
        tags[s + 1 : e] = TAGS.index(f"I-{k}")
    return ids_of(text), tags


def windows(maker: Maker, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tags), each (STEPS, n)."""
    ids, tags = np.zeros((STEPS, n), np.int64), np.zeros((STEPS, n), np.int64)
    k = 0
    while k < n:
        i, t = labelled(maker)
        for s in range(int(maker.rng.integers(0, 20)), max(1, len(i) - 20), STEPS - 20):
            if k < n:
                m = len(i[s : s + STEPS])
                ids[:m, k], tags[:m, k] = i[s : s + STEPS], t[s : s + STEPS]
                k += 1
    return ids, tags


_OWN: dict = {}


def _local(args) -> tuple[dict, float]:
    """LOCAL steps of this process from the given weights."""
    p, rate = args
    if not _OWN:
        _OWN.update(maker=Maker(os.getpid() * 7919 + 1), adam=Adam(), pool=[])
    t, loss = Tagger({k: v.copy() for k, v in p.items()}), 0.0
    pool, maker = _OWN["pool"], _OWN["maker"]
    for k in range(LOCAL):
        if k % 3 == 0 or len(pool) < 10:
            pool.append(windows(maker, BATCH))
            batch = pool[-1]
            del pool[:-200]
        else:
            batch = pool[maker.rng.integers(len(pool))]
        value, grads = t.loss_and_grads(*batch)
        _OWN["adam"].step(t.p, grads, rate)
        loss += value / LOCAL
    return t.p, loss


def train(seconds: float, hidden: int = 32, seed: int = 1, processes: int = 7, say=print, tagger: Tagger | None = None) -> Tagger:
    tagger, began, k = tagger or Tagger.new(hidden, seed), time.time(), 0
    with multiprocessing.get_context("fork").Pool(processes) as pool:
        while (done := (time.time() - began) / seconds) < 1:
            rate = 3.0 * (1 - done) ** 1.2 + 0.05
            found = pool.map(_local, [(tagger.p, rate)] * processes, chunksize=1)
            tagger = Tagger({n: np.mean([p[n] for p, _ in found], axis=0).astype(np.float32) for n in tagger.p})
            k += 1
            if k % 10 == 0:
                say(f"{k} rounds, {time.time() - began:.0f} s, loss {np.mean([x for _, x in found]):.3f}", flush=True)
    return tagger


def accuracy(tagger: Tagger, n: int = 2000, seed: int = 99, held: bool = True) -> dict[str, tuple[float, float]]:
    """Precision and recall by kind over whole spans inside windows of held-out texts."""
    ids, gold = windows(Maker(seed, held), n)
    found = tagger.decode(ids)

    def spans(tags):
        out = set()
        for b in range(tags.shape[1]):
            t = 0
            while t < STEPS:
                if TAGS[tags[t, b]][0] == "B":
                    e = t + 1
                    while e < STEPS and TAGS[tags[e, b]] == "I" + TAGS[tags[t, b]][1:]:
                        e += 1
                    if e < STEPS:
                        out.add((b, t, e, TAGS[tags[t, b]][2:]))
                    t = e
                else:
                    t += 1
        return out

    a, b = spans(gold), spans(found)
    count = lambda s, k: max(1, sum(x[3] == k for x in s))
    return {k: (round(sum(x[3] == k for x in a & b) / count(b, k), 3), round(sum(x[3] == k for x in a & b) / count(a, k), 3)) for k in KINDS}


if __name__ == "__main__":
    model = train(float(sys.argv[1]) if len(sys.argv) > 1 else 1_200, processes=int(sys.argv[2]) if len(sys.argv) > 2 else 7, tagger=Tagger.load(WEIGHTS) if "--on" in sys.argv else None)
    print(accuracy(model))
    model.save(WEIGHTS)
