"""Contamination against looking every window up in every document."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pricetrail.llm.decontamination import Automaton, contamination, cut, decontaminate, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_definition(text, items):
    ws, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        of = words_of(item_text)
        n = min(13, len(of))
        windows = {tuple(of[i : i + n]) for i in range(len(of) - n + 1)} if of else set()
        for i in range(len(ws) - n + 1 if of else 0):
            if tuple(ws[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    listed = ",".join(sorted(str(i) for i in found if i is not None))
    digest = hashlib.sha256(listed.encode()).hexdigest()
    return len(ws), len(hit), len([i for i in found if i is not None]), digest, bool(hit) and 20 * len(hit) >= len(ws)


def made(seed, items=12, docs=40, letters=4):
    """Texts over few words, so that matches of every length occur."""
    pick = random.Random(seed)
    text = lambda n: " ".join(pick.choice("abcdefgh"[:letters]) for _ in range(n))
    bench = [(i, text(pick.choice([0, 1, 2, 3, 12, 13, 14, 30]) if i % 3 == 0 else pick.choice([13, 20, 40]))) for i in range(items)]
    rows = []
    for d in range(docs):
        parts = [text(pick.randint(0, 30))]
        for _ in range(pick.randint(0, 3)):
            ws = pick.choice(bench)[1].split()
            a = pick.randint(0, len(ws))
            parts += [" ".join(ws[a : a + pick.randint(0, 20)]), text(pick.randint(0, 9)) + " zz"]
        rows.append((d, ", ".join(parts)))
    return rows, bench


ODD = [(900, None), (901, ""), (902, "... -- !"), (903, "é" * 3000), (904, "x " * 20_000), (905, "A b"), (None, "a b c")]


def run(spark, rows, bench, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "n_hit": F.lit("x"), "n_chars": F.length("text").cast("long")})
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(0))
    return docs, items, contamination(docs, items, **more)


@pytest.mark.parametrize("seed, letters, shard", [(1, 2, 250_000), (2, 4, 250_000), (3, 8, 250_000), (4, 3, 20), (5, 6, 20)])
def test_every_window_is_found(spark, seed, letters, shard):
    rows, bench = made(seed, letters=letters)
    rows, bench = rows + ODD + rows[:2], bench + [(50, None), (51, ""), (52, "!!"), (None, "q r s"), bench[0]]
    _, _, got = run(spark, rows, bench, shard_words=shard)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()), key=repr)
    assert got == sorted(((d, *by_definition(t, bench)) for d, t in rows), key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_automaton_alone(seed):
    rows, bench = made(seed, items=6, docs=15, letters=seed % 6 + 1)
    found = Automaton([(i, words(t.encode())) for i, t in bench])
    for _, text in rows:
        spans, items = found.hits(words(text.encode()))
        n, hit, n_items, *_ = by_definition(text, bench)
        assert (sum(b - a for a, b in spans), len(items)) == (hit, n_items)
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_spans_are_cut_and_contaminated_documents_go(spark):
    item = " ".join(f"w{i}" for i in range(20))
    clean, long = "nothing of that kind here", " ".join(f"x{i}" for i in range(500))
    rows = [(1, clean), (2, item), (3, f"{long} ... {item.upper()}! {long}"), (4, None), (5, "")]
    docs, items, _ = run(spark, rows, [(1, item)])
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {
        1: (clean, len(clean)), 3: (f"{long} ... ! {long}", 2 * len(long) + 7), 4: (None, None), 5: ("", 0)}


def unhit(text, items):
    """The words of a text that no window of any item covers."""
    ws, hit = words_of(text), set()
    for _, item_text in items:
        of = words_of(item_text)
        n = min(13, len(of))
        windows = {tuple(of[i : i + n]) for i in range(len(of) - n + 1)} if of else set()
        for i in range(len(ws) - n + 1 if of else 0):
            if tuple(ws[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return [w for i, w in enumerate(ws) if i not in hit]


@pytest.mark.parametrize("shard", [250_000, 200])
def test_items_of_all_shards_judge_and_cut_together(spark, shard):
    """Hits in several automata count as one, and the windows of one are not cut before another has looked."""
    run_of = lambda name, n: [f"{name}{i}" for i in range(n)]
    bench = [(i, " ".join(run_of(f"a{i}x", 30))) for i in range(8)]
    bench += [(100 + i, " ".join([*run_of(f"p{i}x", 8), *run_of(f"m{i}x", 10), *run_of(f"q{i}x", 3)])) for i in range(8)]
    bench += [(200 + i, " ".join([*run_of(f"m{i}x", 10), *run_of(f"q{i}x", 8)])) for i in range(8)]
    filler = run_of("x", 940)
    rows = [(10 * i + j, " ".join([*filler[:400], bench[i][1], *filler[400:], bench[j][1]])) for i in range(8) for j in range(i)]
    over = [[*run_of(f"p{i}x", 8), *run_of(f"m{i}x", 10), *run_of(f"q{i}x", 8)] for i in range(8)]
    rows += [(1000 + i, ", ".join([*filler[:300], *ws, *filler[300:]])) for i, ws in enumerate(over)]
    pick = random.Random(7)
    more, items = made(6, items=8, docs=60, letters=5)
    rows += [(2000 + d, text + " " + " ".join(filler[: pick.choice([0, 300, 600, 900])])) for d, text in more]
    bench += [(300 + i, text) for i, text in items if len(text.split()) >= 12]
    docs, table, _ = run(spark, rows, bench)
    got = {r.doc_id: (words_of(r.text), r.n_chars - len(r.text)) for r in decontaminate(docs, table, shard_words=shard).collect()}
    want = {d: (unhit(t, bench), 0) for d, t in rows if not by_definition(t, bench)[4]}
    assert not set(want) & {d for d, _ in rows if d < 1000} and {1000 + i for i in range(8)} <= set(want)
    assert got == want


def test_cut():
    assert cut("Äb, cd! ef gh.".encode(), [(1, 3)]).decode() == "Äb,  gh."


def test_empty_tables(spark):
    docs, items, got = run(spark, [], [(1, "a b")])
    assert got.collect() == [] and decontaminate(docs, items).collect() == []
    docs, items, got = run(spark, [(1, "a b")], [])
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got.collect()] == [(2, 0, False)]
    assert decontaminate(docs, items).count() == 1
