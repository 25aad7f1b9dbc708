"""Repeated passages against all windows of all documents, and the hashes they rest on by definition."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pricetrail.llm import wordgrams
from pricetrail.llm.queries import QUERIES
from pricetrail.llm.substring_dedup import Anchors, Sieve, repeated_windows, without_repeats
from pricetrail.llm.wordgrams import Words, least, runs

SPACE = re.compile("[\x20\x09-\x0d]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def by_definition(rows, window):
    """(doc_id, n_words, spans, kept) of every row."""
    first = {}
    for i, text in rows:
        ws = split(text)
        for k in range(len(ws) - window + 1):
            if i is not None:
                at = tuple(ws[k : k + window])
                first[at] = min(i, first.get(at, i))
    out = []
    for i, text in rows:
        ws = split(text)
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        edges = [k for k in range(len(ws) + 1) if (k > 0 and gone[k - 1]) != (k < len(ws) and gone[k])]
        spans = [(a, b - 1) for a, b in zip(edges[::2], edges[1::2])]
        out.append((i, len(ws), spans, " ".join(w for w, g in zip(ws, gone) if not g)))
    return sorted(out, key=repr)


def found(frame, rows, **settings):
    docs = frame("doc_id long, text string, tag string, found int, start int", [(i, t, "x", 1, 2) for i, t in rows])
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.kept) for r in without_repeats(docs, **settings).collect()), key=repr)


def passages(seed, documents, vocabulary, shared):
    """Texts over few words, with passages of all lengths copied among them."""
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(vocabulary)}"
    common = [[word() for _ in range(pick.randint(3, 40))] for _ in range(shared)]
    rows = []
    for i in range(documents):
        ws = [word() for _ in range(pick.randint(0, 60))]
        for _ in range(pick.randint(0, 3)):
            at, passage = pick.randint(0, len(ws)), pick.choice(common)
            a = pick.randint(0, len(passage) - 1)
            ws[at:at] = passage[a:]
        rows.append((i * 3, pick.choice([" ", "\n", " \t "]).join(ws)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, window, anchor", [(1, 13, 5), (2, 5, 2), (3, 4, 4), (4, 3, 1)])
def test_equals_the_definition(frame, seed, window, anchor):
    rows = passages(seed, 120, 300, 6)
    assert found(frame, rows, window=window, seed=anchor) == by_definition(rows, window)


def test_full_sieves_let_everything_through(frame):
    rows = passages(5, 60, 40, 4)
    assert found(frame, rows, window=5, seed=2, bits=15) == by_definition(rows, 5)


def test_defined_cases(frame):
    long = " ".join(f"a{i}" for i in range(20))
    twice = f"{long} {long}"
    rows = [(5, long), (5, long), (7, f"x {long} y"), (None, long), (9, None), (None, None), (11, ""), (12, " \n\t"), (13, "short text"),
            (14, "short text"), (3, twice), (20, twice + " " + twice), (-4, f"{long} z"), (21, long), (21, "entirely other words"),
            (22, "É" + long), (23, " ".join(long.split())), (24, " ".join(long.split()))]
    got = found(frame, rows, window=13)
    assert got == by_definition(rows, 13)
    assert (21, 3, [], "entirely other words") in got and (5, 20, [(0, 19)], "") in got
    assert (-4, 21, [], f"{long} z") in got and (None, 20, [], long) in got
    assert found(frame, []) == []


def test_one_row_repeats_within_itself_only(frame):
    text = " ".join(["same few words"] * 200)
    assert found(frame, [(1, text)]) == [(1, 600, [], text)]
    assert found(frame, [(1, text), (2, text)])[1] == (2, 600, [(0, 599)], "")


def test_very_long_texts_and_words(frame, monkeypatch):
    pick = random.Random(3)
    words = [f"{pick.getrandbits(40):x}" for _ in range(60_000)]
    other = words[:30_000] + ["y" * 300_000] + words[30_000:]
    monkeypatch.setattr(wordgrams, "PIECE", 1 << 14)
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "z" * 500_000)]
    got = found(frame, rows)
    assert got[1] == (2, 60_001, [(0, 29_999), (30_001, 60_000)], "y" * 300_000)
    assert got[0][2] == [] and got[2] == (3, 1, [], "z" * 500_000)


def test_word_hashes_do_not_depend_on_the_piece(monkeypatch):
    texts = ["one two  three", None, "", "two", "three two one " * 50, "\tÄ ö\n", "x" * 999]
    whole = [(n.tolist(), h.tolist()) for _, h, n in Words().of(pa.array(texts))]
    assert sum((n for n, _ in whole), []) == [len(split(t)) for t in texts]
    monkeypatch.setattr(wordgrams, "PIECE", 7)
    parts = list(Words().of(pa.array(texts)))
    assert np.concatenate([h for _, h, _ in parts]).tolist() == sum((h for _, h in whole), [])
    hashes = dict(zip(sum((split(t) for t in texts), []), sum((h for _, h in whole), [])))
    assert len(set(hashes.values())) == len(hashes)
    sliced = pa.array(["skip", *texts]).slice(1)
    assert np.concatenate([h for _, h, _ in Words().of(sliced)]).tolist() == sum((h for _, h in whole), [])


def test_runs_and_least_by_definition():
    pick = np.random.default_rng(1)
    values = pick.integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 3, 5, 8, 9, 13):
        place = least(values, width)
        for i in range(200 - width + 1):
            assert place[i] == i + int(np.argmin(values[i : i + width]))
    assert least(values[:3], 9)[0] == int(np.argmin(values[:3])) and len(least(values[:0], 4)) == 0
    same = runs(np.array([7, 8, 9, 1, 7, 8, 9], np.uint64), 3)
    assert same[0] == same[4] and len({*same[:4].tolist()}) == 4


def test_equal_windows_name_equal_anchors():
    pick = np.random.default_rng(2)
    shared = pick.integers(0, 1 << 60, 13).astype(np.uint64)
    keys = set()
    for _ in range(50):
        words = np.concatenate([pick.integers(0, 1 << 60, 20).astype(np.uint64), shared, pick.integers(0, 1 << 60, 20).astype(np.uint64)])
        a = Anchors(words, np.array([len(words)]), 13, 5)
        at = int(np.searchsorted(np.cumsum(a.n), 20, "right"))  # the anchor that window 20 names
        keys.add(int(a.key[at]))
        assert a.start[at] <= 20 < a.start[at] + a.n[at]
    assert len(keys) == 1


def test_sieve_holds_what_was_put_in(spark):
    values = [0, 1, -1, (1 << 62) + 5, 77_777, -(1 << 63)]
    sieve = Sieve(spark.createDataFrame([(v,) for v in values] + [(None,)], "v long"), __import__("pyspark").sql.functions.col("v"), 20)
    assert sieve.has(np.array(values)).all()
    assert sieve.has(np.arange(5000, 6000)).sum() == 0


def test_plan_needs_no_pairs(spark, frame):
    plan = repeated_windows(frame("doc_id long, text string", [(1, "a b c")]))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_registered_query(spark):
    rows = QUERIES["op11_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    wanted = {i: (n, sum(b - a + 1 for a, b in spans)) for i, n, spans, _ in by_definition([tuple(d) for d in docs], 13)}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in rows} == wanted
