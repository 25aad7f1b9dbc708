"""The network's gradients and scores against plain versions of them, and its verdicts on held-out documents."""

import random
import zlib

import numpy as np
import pytest

from pricetrail.llm import toxicity
from pricetrail.llm.gated import pool, sigmoid, tanh
from pricetrail.llm.toxicity import Constant, Network, keep_civil, pieces, scored, train, windows

SHORT = ((60, 0.01), (40, 0.006))


def one_by_one(net, ws):
    """Output of a window, a step at a time."""
    p = net.p

    def layer(name, xs):
        out = {}
        for d, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            U, H = p[f"{name}.U{d}"], p[f"{name}.U{d}"].shape[0]
            h = np.zeros(H)
            for t in order:
                g, hu = xs[t] @ p[f"{name}.W{d}"] + p[f"{name}.b{d}"], h @ U
                z, r = sigmoid(g[:H] + hu[:H]), sigmoid(g[H : 2 * H] + hu[H : 2 * H])
                h = z * h + (1 - z) * tanh(g[2 * H :] + r * hu[2 * H :])
                out[d, t] = h
        hs = np.array([np.concatenate([out["f", t], out["b", t]]) for t in range(len(xs))])
        e = hs @ p[f"{name}.v"]
        a = np.exp(e - e.max())
        return (a / a.sum()) @ hs

    xs = [np.concatenate([layer("char", [p["chars"][ord(c) % toxicity.CHARS] for c in w.decode("utf-8", "replace")]),
                          p["words"][zlib.crc32(w) % toxicity.BUCKETS],
                          [net.evidence.get(w, 0) / 2, net.evidence.get(w[:4] + b"*", 0) / 2]]) for w in ws]
    return float(layer("word", xs) @ p["w"] + p["b"][0])


TEXTS = [None, "", "?! ...", "one", "Ünïcode wörds in a row 😀", "x" * 3000, "a b c " * 300, " ".join("w%d" % (i * i % 90) for i in range(100))]


def test_windows_cover_and_overlap():
    for n in (1, 31, 32, 33, 56, 57, 200):
        starts = windows(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a == toxicity.STRIDE < toxicity.WINDOW for a, b in zip(starts, starts[1:]))
    assert windows(0) == []
    assert b"".join(pieces(b"x" * 3000)) == b"x" * 3000 and max(map(len, pieces(b"x" * 3000))) <= toxicity.PIECE


def test_scores_follow_the_definition(monkeypatch):
    net = Network(3, {b"one": 2.0, b"w1*": 1.0, b"w49": 3.0})
    texts = [t.encode() if t is not None else None for t in TEXTS]
    want = [sorted((one_by_one(net, ws[s : s + toxicity.WINDOW]) for s in windows(len(ws))), reverse=True) for ws in map(pieces, texts)]
    for memo, block in ((250_000, 2048), (40, 7)):
        monkeypatch.setattr(toxicity, "MEMO", memo)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        for _ in range(2):
            got = net.worst(texts, 99)
            assert [len(g) for g in got] == [len(w) for w in want]
            assert all(np.allclose([o for o, _ in g], w, atol=1e-5) for g, w in zip(got, want))
    assert list(net.scores(texts)[:3]) == [0, 0, 0]


def test_gradients_against_differences():
    net, rng = Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    batch, y = [[b"ab", b"cde", b"f"], [b"x"], [b"ab", b"zz", b"q", b"cde", b"hello"]], np.array([0, 1, 1])
    grads = net.gradient(batch, y)
    for k, v in net.p.items():
        for _ in range(3):
            i = tuple(rng.integers(0, n) for n in v.shape)
            i = (ord("ab"[i[1] % 2]), i[1]) if k == "chars" else (zlib.crc32(b"cde") % toxicity.BUCKETS, i[1]) if k == "words" else i
            old, losses = v[i], []
            for step in (1e-5, -1e-5):
                v[i] = old + step
                net.gradient(batch, y)
                losses.append(net.loss)
            v[i] = old
            assert grads[k][i] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=2e-3, abs=2e-6)


def test_pooling_ignores_what_is_masked():
    net, rng = Network(2), np.random.default_rng(1)
    x, mask = rng.standard_normal((6, 5, toxicity.CHAR_WIDTH)), np.arange(6)[:, None] < np.array([1, 6, 3, 4, 2])[None]
    both = [pool(net.p, "char", np.where(mask[:, :, None], x, fill), mask.astype(np.float32))[0] for fill in (0, 99)]
    assert np.allclose(*both)


def made(spark, n=600, bad=("vile", "awful")):
    pick = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        ws = ["".join(pick.choice("aeioulnrst") for _ in range(pick.randint(2, 7))) for _ in range(pick.randint(5, 120))]
        toxic = i % 3 == 0
        for _ in range(2 * toxic):
            ws.insert(pick.randrange(len(ws)), pick.choice(bad))
        rows.append((i, " ".join(ws), "en"))
        marks.append((i, int(toxic), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int, text string"), rows


def test_learns_and_filters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", SHORT)
    monkeypatch.setattr(train, "__defaults__", (toxicity.SAMPLE, SHORT))
    docs, labels, rows = made(spark)
    more = [(1000 + i, t, None) for i, t in enumerate(TEXTS)] + [(None, "some words", "x"), (7, rows[7][1], "again")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, "x"), (5000, None, "x"), (1, 0, "again")], labels.schema))
    got = scored(docs, labels).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert [by_id[1000 + i].score for i in range(3)] == [0, 0, 0]
    assert np.mean([by_id[i].predicted == (i % 3 == 0) for i in range(600) if by_id[i].held_out]) > 0.95
    kept = keep_civil(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted(
        (r.doc_id or -1, r.text or "") for r in docs.collect() if not by_id[r.doc_id].predicted)


def test_without_both_classes(spark):
    docs, labels, _ = made(spark, 30)
    for part, share in ((labels.limit(0), 0), (labels.filter("toxic = 0"), 0), (labels.filter("toxic = 1"), 1)):
        assert isinstance(train(docs, part), Constant)
        assert {r.score for r in scored(docs, part).collect()} == {share}
    assert scored(docs.limit(0), labels).collect() == []


def test_held_out_documents(spark):
    """Figures on documents that the network has not learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = train(docs, labels)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter("crc32(cast(doc_id AS string)) % 5 = 0").select("text", "toxic").collect()
    found = net.scores([r.text.encode() for r in rows]) >= 0.5
    y = np.array([r.toxic for r in rows])
    assert found[y == 1].mean() >= 0.85 and found[y == 0].mean() <= 0.02
