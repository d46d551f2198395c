"""The training-data operators against brute force, round trips, held-out accuracy, and on awkward inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import abuse, clustering, incremental, leaks, mixing, neighbours, pii, pii_train, splitting, vectors, words
from loam.llm.pii_model import Tagger

RNG = np.random.default_rng(5)


def near(v, cosine):
    n = RNG.normal(size=len(v))
    n -= n @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * n / np.linalg.norm(n)


def vec_frame(spark, rows, cols="id string, grp string, vector array<double>"):
    return spark.createDataFrame([(a, b, [float(x) for x in v] if v is not None else None) for a, b, v in rows], cols)


AWKWARD = [("n1", "g", None), ("n2", "g", []), ("n3", "g", [0.0] * 64), ("n4", "g", [float("nan")] * 64), ("n5", "g", [1.0] * 63), ("n6", None, [1.0] * 64), (None, "g", [1.0] * 64), ("n7", "g", [1e300] * 64)]


# --- 1: splitting ---


def test_pieces_are_valid_and_greedy():
    for text in ["word " * 3000, "x" * 9001, "Ein Satz. Noch einer! " * 700 + "y" * 5000 + " z " * 10, "中文句子。" * 2500, "a" * 3999 + " " + "b" * 5000, "\n".join(["line of text"] * 900), "🙂 " * 4100]:
        b = splitting.Boundaries(text)
        p = b.pieces()
        assert b.legal(p[:, 0], p[:, 1])
        # one after the other, without tables
        ends, at = [], 0
        while not ends or ends[-1] < len(text):
            end = int(b.ends(np.array([at]))[0])
            ends.append(end)
            at = end - splitting.OVERLAP
        assert ends == p[:, 1].tolist()
        assert text == text[: p[0, 1]] + "".join(text[e0:e] for e0, e in zip(p[:-1, 1], p[1:, 1]))


def test_stored_cuts(spark):
    text = "word " * 1000
    entries = spark.createDataFrame([(i, text) for i in "abcdefg"] + [("a", text), ("short", "x"), ("null", None), ("empty", ""), (None, text)], "id string, text string").withColumn("cut", F.lit(1)).withColumn("chunk_no", F.lit("z"))
    good = [("a", 0, 0, 4000), ("a", 1, 3800, 5000)]
    rows = [*good, *good, ("b", 0, 0, 4001), ("b", 1, 3801, 5000), ("c", 0, 0, 3998), ("c", 1, 3798, 5000), ("d", 0, 0, 4000), ("d", 1, 3800, None), ("e", 1, 3800, 5000), ("f", 0, 0, 3000), ("f", 1, 2801, 5000), ("zz", 0, 0, 1)]
    stored = spark.createDataFrame([(*r, None) for r in rows], "memory_id string, chunk_no int, start_index long, end_index long, length long")
    out = splitting.split_oversized(entries, stored)
    valid = {r.id: r.stored_valid for r in out.where("chunk_no = 0").collect()}
    assert valid == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False, "g": False, None: False}
    assert splitting.split_oversized(entries.limit(0), stored.limit(0)).count() == 0


# --- 2: personal information ---


def test_tagger_held_out():
    tagger = Tagger.load(pii_train.WEIGHTS)
    got = pii_train.accuracy(tagger, 600, seed=4242, held=False)
    assert all(p > 0.85 and r > 0.85 for p, r in got.values()), got
    # openings, endings and look-alikes that training never saw, before the exact check
    got = pii_train.accuracy(tagger, 600, seed=4242, held=True)
    assert all(p > 0.6 and r > 0.6 for p, r in got.values()), got


def test_ordinary_sentences():
    want = {"Write to John Miller now.": "John Miller", "The patient is Maria Gonzalez.": "Maria Gonzalez", "Remember Anna Schmidt when you plan.": "Anna Schmidt", "Ich habe Petra Neumann gesehen.": "Petra Neumann", "J'ai vu Claire Dubois hier.": "Claire Dubois", "SSN 123-45-6789 was leaked.": "SSN 123-45-6789", "请联系张伟。": "张伟", "Email bob@example.com": "bob@example.com"}
    got = {t: [t[s:e] for s, e, _ in f] for t, f in zip(want, pii.find_all(list(want)))}
    assert got == {t: [w] for t, w in want.items()}


def test_nothing_found_is_left(spark):
    """Items are replaced in the raw text, whatever its escapes."""
    cut = '{"a": "Kontakt: Jürgen Müller\\nMail: j.mueller@example.org", "b": "Tel +49 30 1234567 or \\u004daria Gonzalez", "c": "cut'
    held = json.dumps({"x": json.dumps({"y": "Write to John Miller now.\n\"jo@example.org\""})})
    out = pii.redacted(spark.createDataFrame([("1", cut), ("2", held)], "id string, m string"), "id", ["m"], {"m"}).collect()
    for r in out:
        assert not any(x in r.m for x in ("Müller", "j.mueller", "1234567", "Gonzalez", "Miller", "jo@"))
    assert json.loads(json.loads(out[1].m)["x"])["y"] == 'Write to [NAME] now.\n"[EMAIL]"'


def test_tagger_gradients():
    t = Tagger.new(4, 0)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    ids, tags = pii_train.windows(pii_train.Maker(3), 3)
    ids, tags = ids[:10], tags[:10]
    _, g = t.loss_and_grads(ids, tags)
    for k in ("hf", "hb", "e", "t"):
        at = tuple(0 for _ in t.p[k].shape)
        old = t.p[k][at]
        t.p[k][at] = old + 1e-3
        a, _ = t.loss_and_grads(ids, tags)
        t.p[k][at] = old - 1e-3
        b, _ = t.loss_and_grads(ids, tags)
        t.p[k][at] = old
        assert g[k][at] == pytest.approx((a - b) / 2e-3, abs=1e-3)


def test_items_and_placeholders(spark):
    meta = json.dumps({"a": {"note": "Ring +44 20 7946 0123 or leave a note."}, "n": 1700000000000, "raw": json.dumps({"m": "Use jo.smith@example.org; the other account is closed."})})
    rows = [("1", "My manager Nora Kelibark reads these notes. Parcels go to 12 Orchard Lane, Welton.", meta), ("2", None, None), ("3", "", ""), ("4", "Contact [EMAIL] was redacted. Project Lantern Harvest ships soon.", '{"cut": "My number is 020 7946 0999, call tonight. And th'), ("5", "word " * 4000 + "The scan shows SSN 912-34-5678 at the top.", "not json"), ("1", "My manager Nora Kelibark reads these notes. Parcels go to 12 Orchard Lane, Welton.", meta), (None, "x", "y")]
    df = spark.createDataFrame(rows, "id string, text string, metadata string").withColumn("kind", F.lit(1))
    got = {(r.id, r.field, r.kind) for r in pii.items(df, "id", ["text", "metadata"], {"metadata"}).collect()}
    assert got == {("1", "text", "name"), ("1", "text", "address"), ("1", "metadata", "phone"), ("1", "metadata", "email"), ("4", "metadata", "phone"), ("5", "text", "id_number")}
    out = {r.id: r for r in pii.redacted(df, "id", ["text", "metadata"], {"metadata"}).collect()}
    assert out["1"].text == "My manager [NAME] reads these notes. Parcels go to [ADDRESS]."
    assert json.loads(out["1"].metadata)["a"]["note"] == "Ring [PHONE] or leave a note." and "[EMAIL]" in out["1"].metadata
    assert out["2"].text is None and out["3"].text == "" and "[PHONE]" in out["4"].metadata and out["5"].text.endswith("[ID_NUMBER] at the top.")
    assert pii.items(df.limit(0), "id", ["text"]).count() == 0


def test_windows_are_reconciled():
    item = "Calendar invites from someone.long.name@mail.example.org are fine. "
    text = "".join(f"New line +44 20 7946 0{i} since May. " for i in range(100, 140)) + item * 3
    found = pii.find_all([text])[0]
    assert sum(k == "phone" for *_, k in found) == 40 and sum(k == "email" for *_, k in found) == 3


# --- 3: most similar vectors ---


def brute(rows, k):
    best = {}
    for i, g, v in rows:
        s = sorted((-float(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), j) for j, h, w in rows if h == g and j != i)
        best[i] = s[:k]
    return best


def test_neighbours_are_shuffled_once(spark):
    """What is shuffled grows with the vectors, not with the cells that these visit."""
    x = RNG.normal(size=(2_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    units = spark.createDataFrame([(f"{i:04d}", "g", bytearray(v.astype(np.float32).tobytes())) for i, v in enumerate(x)], "id string, grp string, unit binary").repartition(4)
    moved = lambda: sum(e.totalShuffleWrite() for e in [spark._jsc.sc().statusStore().executorList(False).apply(0)])
    before = moved()
    got = neighbours.nearest(units, 5, cell=100).collect()
    assert len(got) == 10_000 and moved() - before < 10_000_000


def test_neighbours(spark):
    rows = [(f"{i:04d}", "big" if i < 900 else f"s{i % 7}", RNG.normal(size=64)) for i in range(1100)]
    for i in range(100):
        rows.append((f"d{i:04d}", "big", near(rows[i][2], 0.93)))
    for i in range(300):
        rows.append((f"c{i:04d}", "big", rows[500][2]))  # a hot group of copies
    df = vec_frame(spark, rows + AWKWARD + rows[:5])
    units = vectors.unit_rows(df, "vector", ["id", "grp"])
    got = {}
    for r in neighbours.nearest(units, 5, cell=200).collect():
        got.setdefault(r.id, []).append((-r.cosine, r.neighbour))
    names = {i for i, *_ in rows}
    want = brute(rows[:700] + rows[700:], 5)
    assert {n for ns in got.values() for _, n in ns} <= names | {"n7"}
    single = [i for i in names if not i.startswith("c") and i != "0500"]  # copies tie with one another
    hits = sum(len({n for _, n in got[i]} & {n for _, n in want[i]}) for i in single)
    assert hits / sum(len(want[i]) for i in single) > 0.9
    close = [(i, n) for i in names for c, n in want[i] if -c >= 0.9 and not i.startswith("c") and not n.startswith("c") and i != "0500"]
    assert all(n in {m for _, m in got[i]} for i, n in close) and len(close) > 150
    assert all(len(got[f"c{i:04d}"]) == 5 and all(c < -0.999 for c, _ in got[f"c{i:04d}"]) for i in range(300))
    assert neighbours.nearest(units.limit(0), 5).count() == 0


def test_quantiser_prefers_parallel_accuracy():
    x = RNG.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]

    def along(eta):
        q = neighbours.Quantiser.train(x, eta=eta, rounds=4)
        codes = q.encode(x)
        r = x - np.concatenate([q.tables[m][codes[:, m]] for m in range(codes.shape[1])], 1)
        assert np.allclose(q.scores(x[:5], q.pack(codes)), x[:5] @ (x - r).T, atol=1e-4)  # looked up in packed bytes
        return float(np.abs((r * x).sum(1)).mean())

    assert along(4.0) < along(1.0)


# --- 4: deduplicating batches ---


def sequential(rows):
    acc, out = [], {}
    for i, t, v in sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0]):
        w = set(words.words(t))
        v = None if v is None or len(v) != 64 or not np.isfinite(v).all() or not np.any(v) else np.asarray(v) / np.linalg.norm(v)
        hit = [j for j, x, u in acc if (v is not None and u is not None and v @ u >= 0.9) or (w and x and 10 * len(w & x) >= 7 * len(w | x))]
        out[i] = min(hit) if hit else None
        if not hit:
            acc.append((i, w, v))
    return out


def candidates(n):
    pool = [f"wort{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if i > 20 and RNG.random() < 0.5:
            j = RNG.integers(len(rows))
            _, t, v = rows[j]
            ws = (t or "leer").split()
            if RNG.random() < 0.6:
                ws[RNG.integers(len(ws))] = pool[RNG.integers(60)]
            t = " ".join(ws).upper() if RNG.random() < 0.3 else " ".join(ws)
            v = near(np.array(v), [0.8, 0.91, 0.95, 0.99][RNG.integers(4)]).tolist() if v is not None and RNG.random() < 0.6 else RNG.normal(size=64).tolist()
        else:
            t, v = " ".join(RNG.choice(pool, RNG.integers(1, 14))), RNG.normal(size=64).tolist()
        rows.append((i * 3 + 1, t, v))
    rows += [(n * 3 + 10, None, None), (n * 3 + 11, "", []), (n * 3 + 12, None, None), (n * 3 + 13, "wort1 " * 50, [0.0] * 64)]
    rows += [(n * 3 + 100 + k, rows[0][1], rows[0][2]) for k in range(80)]
    return rows


def test_replay_and_history(spark, tmp_path):
    rows = candidates(250)
    want = sequential(rows)
    frame = lambda rs: spark.createDataFrame(rs, "cand_id long, abstract string, vector array<double>").withColumn("words", F.lit(1)).withColumn("key", F.lit(2))
    df = frame(rows + rows[:7])
    assert {r.id: r.kept_id for r in incremental.replay(df, merges=2, compact_every=1).collect()} == want
    assert {r.id: r.kept_id for r in incremental.replay(df, merges=1, last=0).collect()} == want  # all in rounds
    got = {}
    for k, part in enumerate([rows[:100], rows[:0], rows[100:180], rows[180:]]):
        history = incremental.History(spark, str(tmp_path / "h"), range_rows=500)  # each time as another process would
        got |= {r.id: r.kept_id for r in history.merge(frame(part)).collect()}
        if k == 2:
            history.compact()
            assert len(history.state["runs"]) == 1 and history.state["ranges"][0] > 1
    assert got == want
    assert incremental.History(spark, str(tmp_path / "h")).state["merges"] == 3
    assert incremental.replay(df.limit(0)).count() == 0


def test_a_batch_reads_its_own_key_ranges(spark, tmp_path):
    rows = [(i, f"alpha{i} beta{i} gamma{i}", None) for i in range(600)]
    frame = lambda rs: spark.createDataFrame(rs, "cand_id long, abstract string, vector array<double>")
    history = incremental.History(spark, str(tmp_path / "h"), range_rows=10)
    history.merge(frame(rows))
    touched = incremental.key_rows(spark.createDataFrame([(1, [5, 6, 7], None)], "attr long, words array<bigint>, unit binary"), history.rank, 1)
    files = lambda df: {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files(history._read("keys", touched.select("key")))) <= 2 < len(files(history._read("keys")))


def test_keys_of_similar_sets_meet():
    for _ in range(300):
        n = int(RNG.integers(3, 70))
        a = RNG.choice(400, n, replace=False)
        b = a.copy()
        swap = int(RNG.integers(0, max(1, int(0.17 * n)) + 1))
        b[:swap] = RNG.choice(np.arange(400, 800), swap, replace=False)
        if 10 * (n - swap) < 7 * (n + swap):
            continue
        rank = {int(w): int(w) for w in range(0, 800, int(RNG.integers(1, 4)))}
        assert set(incremental.keys_of(sorted(map(int, a)), rank)) & set(incremental.keys_of(sorted(map(int, b)), rank))


# --- 6: clusters ---


def test_clusters(spark):
    rows = []
    for c in range(12):
        centre = RNG.normal(size=64)
        rows += [(f"k{c:02d}-{m:02d}", "g" if c % 3 else "h", near(centre, 0.97)) for m in range(2 + 3 * (c % 5))]
    chain = [RNG.normal(size=64)]
    for _ in range(8):
        chain.append(near(chain[-1], 0.91))
    rows += [(f"z{m:02d}", "g", v) for m, v in enumerate(chain)]
    rows += [(f"same{m:03d}", "g", chain[0]) for m in range(120)] + [(f"lone{m}", "g", RNG.normal(size=64)) for m in range(60)] + [("pair1", "q", [1.0] * 64), ("pair2", "q", [2.0] * 64)]
    df = vectors.unit_rows(vec_frame(spark, rows + AWKWARD + rows[:4]), "vector", ["id", "grp"])
    ids = sorted({i for i, *_ in rows} | {"n7"})
    by = {i: (g, np.asarray(v, float) / np.linalg.norm(v)) for i, g, v in rows} | {"n7": ("g", np.ones(64) / 8)}
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and by[a][0] == by[b][0] and by[a][1] @ by[b][1] >= 0.88:
                ra, rb = root[a], root[b]
                if ra != rb:
                    root = {k: (min(ra, rb) if r in (ra, rb) else r) for k, r in root.items()}
    want = {(root[i], i) for i in ids if root[i] != i}
    for run in (2000, 40):  # one run a group, and several keys
        found = clustering.clusters(df, run=run)
        assert {(r.cluster, r.id) for r in found.collect() if r.cluster != r.id} == want
    info = {r.cluster: r for r in clustering.described(found).collect()}
    assert info["pair1"].size == 2 and set(info["pair1"].typical) == {"pair1", "pair2"}
    assert clustering.clusters(df.limit(0)).count() == 0


def test_components_in_rounds(spark):
    pairs = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(100, 5), (7, 7), (200, 201)]
    want = clustering._unite(p for p in pairs if p[0] != p[1])
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.root for r in clustering.components(df, last=0).collect()} == want == {r.node: r.root for r in clustering.components(df).collect()}


# --- 7: leaks ---


def test_leaks(spark):
    item = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "Tiny item here"), (3, ""), (4, None), (1, " ".join(item)), (5, " ".join(item[20:]) + " tail end of it")], "item_id long, text string").withColumn("gram", F.lit(1))
    texts = {
        1: "pre " + " ".join(item[5:17]) + " post", 2: "pre " + " ".join(item[5:16]) + " post", 3: "so TÍNY <b>it​em</b> héré ok", 4: None, 5: "", 6: "tiny item there", 7: " ".join(item[:11] + ["gap"] + item[11:22]),
        8: "x " * 20000 + " ".join(item[28:]).upper(), 9: " ".join(item[:6] + ["no"] + item[6:18] + ["no"] + item[18:]),
    }
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(1, texts[1]), (None, texts[1])], "doc_id long, text string").withColumn("score", F.lit(1))
    found = leaks.leaks(docs, items)
    got = {(r.doc_id, r.item_id) for r in found.collect() if r.run_words >= min(12, r.item_words)}
    assert got == {(1, 1), (3, 2), (8, 1), (8, 5), (9, 1), (9, 5)}
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_edited_copies(spark):
    """Copies with every fourth, fifth or sixth word changed are found by their alignment."""
    vocabulary = [f"w{i}" for i in range(900)]
    items = [(k, " ".join(RNG.choice(vocabulary, 40))) for k in range(20)]
    docs, want = [], {}
    for k, t in items:
        for every in (4, 5, 6):
            ws = [f"edit{RNG.integers(99)}" if i % every == every - 1 else w for i, w in enumerate(t.split())]
            want[len(docs)] = k
            docs.append((len(docs), " ".join([*RNG.choice(vocabulary, 30), *ws, *RNG.choice(vocabulary, 30)])))
    docs += [(1_000 + k, " ".join(RNG.choice(vocabulary, 200))) for k in range(50)]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("share >= 0.5").collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & set(want.items())) >= 0.9 * len(want) and not any(d >= 1_000 for d, _ in found)


def test_alignment():
    a = "the quick brown fox jumps over the lazy dog".split()
    assert leaks.smith_waterman(a, a) == 18 and leaks.smith_waterman(a, []) == 0
    assert leaks.smith_waterman(a, "the quick red fox jumps over a lazy dog".split()) == 12  # 7 matches, 2 mismatches
    assert leaks.longest_run(a, "x fox jumps over the y".split()) == 4


# --- 8: mixing ---


def test_sainte_lague():
    assert mixing.sainte_lague({"a": 53.0, "b": 24.0, "c": 23.0}, 7, {"a": 9, "b": 9, "c": 9}) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": 0.9, "b": 0.1}, 10, {"a": 4, "b": 99}) == {"a": 4, "b": 6}
    assert mixing.sainte_lague({"a": 1.0}, 10, {"a": 0}) == {"a": 0}
    for _ in range(30):
        w = {k: float(RNG.random()) for k in range(6)}
        caps = {k: int(RNG.integers(0, 40)) for k in range(6)}
        want = dict.fromkeys(w, 0)
        for _ in range(50):
            live = [k for k in w if want[k] < caps[k]]
            if live:
                want[max(live, key=lambda k: (w[k] / (2 * want[k] + 1), -k))] += 1
        assert mixing.sainte_lague(w, 50, caps) == want


def test_mix(spark):
    rows = [(i, "some words of text " * (1 + i % 5), ["a", "B ", "c", None][i % 4]) for i in range(400)] + [(900, None, "a"), (901, "", "a"), (None, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit(1)).withColumn("repeats", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("none", 0.1, 2), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    plan, report = mixing.mix(docs, targets, block=64, shard_docs=30)
    rep = {r.source: r for r in report.collect()}
    rows = plan.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and max(r.repeats for r in rows if r.source == "a") <= 3 and max(r.repeats for r in rows if r.source != "a") == 1
    assert sum(r.actual_share for r in rep.values()) == pytest.approx(1) and rep["none"].tokens == 0 and rep["c"].actual_share == pytest.approx(0.1, abs=0.03)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7), targets, block=64, shard_docs=30)[0].collect())) == sorted(map(tuple, rows))
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0 and mixing.mix(docs, targets.limit(0))[0].count() == 0


# --- 9: abuse ---


def test_decoder():
    d = abuse.Decoder({})
    for token, want in {"1d10t": "idiot", "sl*ts": "sluts", "c0ck": "cock", "par.asite": "parasite", "baaaastard": "bastard", "b@$t@rd": "bastard", "i******e": "imbecile", "h0me": "home", "plain": "plain"}.items():
        assert d.decode(token) == want, token


def test_scores(spark):
    bad = ["You are a worthless par​asite!!!", "what a l 0 s e r, g0 r0t 1n a d1tch", "Foobarians are vermin and must be thrown out of the country", "du bist ein i d i o t", "eres un i d i o t a miserable", "你这个无耻的白痴，给我闭嘴!", "schick mir Nacktbilder, du geile Schlampe"]
    fine = ["A parasite process ate the memory.", "The moderator removed an insult and closed the thread.", "Our cat is a lovely little pig when food is near.", "Reminder: book the breast screening and the sexual health talk.", "What a stupid bug in the parser, my own fault.", "The Foobarians choir visited and everyone enjoyed the concert.", "Kill the zombie process before the parent dies.", "助手归档了旧的查询模板。", None, "", "n/a", "a" * 100_000]
    rows = [(i, t, "s" if i % 2 else None) for i, t in enumerate(bad + fine)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r.score for r in abuse.scores(df, keep=("source",)).collect()}
    assert [i for i, s in sorted(got.items()) if s >= abuse.THRESHOLD] == list(range(len(bad)))
    rates = {r.source: r for r in abuse.source_rates(abuse.scores(df, keep=("source",))).collect()}
    assert set(rates) == {"s", "unknown"} and sum(r.n_found for r in rates.values()) == len(bad)
    assert abuse.scores(df.limit(0)).count() == 0


def test_words_must_stand_together():
    of = abuse.finder({})
    p = lambda t: 1 - np.prod([1 - abuse.CUES[abuse.NAMES[k]][1] * v for s in abuse.sentences(t) for k, v in of(s)])
    for t in ["Kill the worker process before you restart the queue.", "Could you back up the disk before you shut it down?", "If you hunt the bug down, tell me.", "I hope you read this before batteries die."]:
        assert p(t) < abuse.THRESHOLD, t
    for t in ["You are an idiot and I will report you to the whole class.", "You are a disgusting piece of trash.", "talk again and I will kill you", "she stripped naked and begged for dirty sex on camera Open question: weekly retry policy"]:
        assert p(t) >= abuse.THRESHOLD, t


def test_ratings_move_the_cues(spark):
    docs = spark.createDataFrame([(i, "You are an idiot." if i < 300 else "The meeting was moved.") for i in range(600)], "doc_id long, text string")
    rate = lambda f: abuse.fitted(docs, spark.createDataFrame([(i, f(i)) for i in range(600)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int"), {})["insult_you"]
    assert rate(lambda i: int(i < 300)) > 0.95 > 0.4 > rate(lambda i: int(i < 20))
    assert abuse.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"), {})["insult_you"] == abuse.CUES["insult_you"][1]


def test_whole_texts_are_tagged(monkeypatch):
    """Every character reaches the tagger, also where no rule expects an item: numbers with unusual dashes, words with two spaces between."""
    seen = []

    class Spy:
        def decode(self, ids, lean):
            seen.append(ids)
            return np.zeros(ids.shape, np.int64)

    monkeypatch.setattr(pii, "tagger", lambda weights: Spy())
    texts = ["please ring 555‑123‑4567 tonight, the old line is gone and nobody answers it any longer, so do not try that one", "it was Maria  Lopez who asked for it again, long after everything else had been settled by the others in the room", "a b c" * 900 + " Maria Lopez"]
    assert pii.find_all([*texts, "", None, "no item can be here", texts[0]]) == [[]] * 7
    assert sum(int((x != 0).sum()) for x in seen) >= sum(map(len, texts))


def test_fast_decoding_is_exact():
    """The states and the best paths are those of the plain recurrences."""
    model = pii.tagger()
    ids = np.zeros((60, 9), np.int64)
    for c in range(9):
        ids[: 60 - 5 * c, c] = RNG.integers(1, 80, 60 - 5 * c)
    for d in "fb":
        assert np.allclose(model._states(ids, d), model._run(ids, d, False)[0], atol=1e-4)


def test_texts_without_items_are_not_tagged(monkeypatch):
    """Capitals, an "at" and numbers that cannot be parts of an item don't send a text to the tagger."""

    class Spy:
        def decode(self, ids, lean):
            raise AssertionError

    monkeypatch.setattr(pii, "tagger", lambda weights: Spy())
    texts = ["The worker was restarted at noon and it took 29 days. It is done.", "Für die Prüfung reichen uns 400, wie Anna weiß.", "agent:Main at (once), see Chapter"]
    assert pii.find_all(texts) == [[]] * 3


def test_left_out_texts_hold_nothing():
    """No span whatever of a text that is left out passes the exact check."""
    parts = ["Maria", "Lopez", "de", "Dr.", "O’Neil", "x", "at", "@", "[at]", "dot", ".", "com", "12", "345", "²", "٣", "Street", "rue", "weg", "bis", "张", "伟", "-", "(", ",", "\n", "+", "/", "The", "_", "a1"]
    out = 0
    for _ in range(3_000):
        text = "".join(str(RNG.choice(parts)) + str(RNG.choice(["", " ", " ", ", ", "  "])) for _ in range(RNG.integers(1, 6)))
        if not pii.possible(text):
            out += 1
            assert not [x for s in range(len(text)) for e in range(s + 1, len(text) + 1) for k in pii.KINDS if (x := pii._checked(text, s, e, k))], text
    assert 500 < out < 2_900


def test_paths_of_unmarked_windows_are_empty():
    """Windows are left out of the search for best paths only if theirs has no item; most that hold none are."""
    from loam.llm import pii_model

    model, maker = pii.tagger(), pii_train.Maker(77)
    trans, start = model.p["t"] + pii_model.FORBIDDEN, model.p["s"] + pii_model.FORBIDDEN_START
    for ids in (pii_train.windows(maker, 300)[0], RNG.integers(1, 80, (50, 200))):
        e = model.emissions(ids, 1.0)
        e.transpose(0, 2, 1)[ids == 0] = [0, *[-1e4] * 10]
        score, back = e[0].T + start, []  # the plain recurrence
        for x in e[1:]:
            total = score[:, :, None] + trans
            back.append(total.argmax(1))
            score = total.max(1) + x.T
        best = [(score + trans[:, 0]).argmax(1)]
        for b in reversed(back):
            best.append(b[np.arange(len(b)), best[-1]])
        best = np.array(best[::-1])
        assert (best == model.decode(ids, 1.0)).all()
        marked = pii_model._marked(e, trans, start)
        assert marked[best.any(0)].all() and best.any()
    plain = ["the worker was restarted after the long build and nobody noticed it", "we keep the old cache until the new one is warm enough for all"]
    ids = np.stack([pii_model.ids_of(t[:60]) for t in plain], 1)
    assert not pii_model._marked(model.emissions(ids, 1.0), trans, start).any()


def test_padding_costs_nothing():
    """Of windows in falling length only characters are computed."""
    ids = np.zeros((60, 9), np.int64)
    for c in range(9):
        ids[: 60 - 5 * c, c] = RNG.integers(1, 80, 60 - 5 * c)
    for d in "fb":
        assert sum(len(h) for _, h in pii.tagger()._steps(ids, d)) == (ids != 0).sum()


def test_other_texts_do_not_matter():
    """What is found in a text doesn't depend on those that are tagged with it."""
    text = "- Meleth and Buzun share one test harness, which the session recorder refilled late in the evening.\n- Parcels go to 121 Heron Ave., Taemoford."
    alone = pii.find_all([text])[0]
    assert alone and pii.find_all([text, "Parcels go to 12 Orchard Lane, Welton. " * 8])[0] == alone


def test_strings_cut_off_in_an_escape():
    assert [v for v, _ in pii.strings_of('{"a": "Email bob@example.com' + "\\")] == ["a", "Email bob@example.com"]
