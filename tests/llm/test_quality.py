"""Quality features and scores against a plain recomputation."""

import math
import random
import re
from collections import Counter

import pytest

from pricetrail.llm import quality
from pricetrail.llm.queries import QUERIES

SPACE = "[\x20\x09-\x0d]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def counted(text):
    text, ws = text or "", words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def made(seed):
    pick = random.Random(seed)
    out = []
    for _ in range(60):
        n = pick.choice([0, 1, 2, 3, 4, 10, 60, 200])
        vocabulary = ["w%d" % i for i in range(pick.choice([2, 10, 1000]))] + ["é#", "|", "<b>&", "A!!"]
        out.append("".join(pick.choice(vocabulary) + pick.choice([" ", " ", "\n", "\t ", "\x0b", "\xa0", "\r\n"]) for _ in range(n)))
    return out


ODD = [None, "", " \n ", "a", "a a a a", "a b c a b c", "a b c d\na b c d\n\na b c d", "x" * 5000, "\x1cq\x85 z", "the same words here " * 500, "𝒳𝒴 $$$"]


@pytest.fixture(scope="module")
def labelled(spark):
    texts = ODD + made(1) + ["plain words of text number %d go on and on " % i + " ".join("w%d" % (i * k % 97) for k in range(60)) for i in range(40)]
    rows = list(enumerate(texts)) + [(None, "no id " * 40), (3, "a")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ws string, bucket int")
    labels = spark.createDataFrame([(i, 1, 0, "y") for i in range(len(ODD) + 60, len(texts))] + [(5, 0, 0, "y"), (None, 1, 0, "y"), (71, 1, 0, "y")],
                                   "doc_id long, quality int, toxic int, text string")
    return rows, docs, labels


def test_counted_features(labelled):
    rows, docs, labels = labelled
    got = quality.judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *counted(t)) for i, t in rows), key=repr)


def test_scores_and_verdicts(spark, labelled):
    rows, docs, labels = labelled
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    grams = {r.g: r.b for r in spark.createDataFrame([(w,) for w in {w for _, t in rows for w in words_of(t)}], "g string").selectExpr(
        "g", f"struct(int(pmod(xxhash64(g), {quality.BUCKETS})) AS w, int(pmod(xxhash64(right(g, 2), 2), {quality.BUCKETS})) AS e) AS b").collect()}
    buckets = lambda t: [b for w in words_of(t) for b in grams[w]]
    raw, trusted = Counter({b: 1 for b in range(quality.BUCKETS)}), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        trusted.update(buckets(t) if i in good else [])
    n_raw, n_good = raw.total(), trusted.total() + quality.BUCKETS
    weight = {b: math.log((trusted[b] + quality.BUCKETS * c / n_raw) / n_good) - math.log(c / n_raw) for b, c in raw.items()}
    want = {(i, t): sum(weight[b] for b in buckets(t)) / max(1, len(buckets(t))) for i, t in rows}
    ids = {i: t for i, t in reversed(rows)}
    for r in quality.judged(docs, labels, -0.2).collect():
        assert r.score == pytest.approx(want[r.doc_id, ids[r.doc_id]], abs=2e-6)
        assert r.kept == (not r.base_failed and r.score >= -0.2)


def test_pairs_of_words(spark, labelled):
    """Scores with neighbouring words by definition, and the same words in another order score differently."""
    rows, docs, labels = labelled
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    joint = {p for _, t in rows for ws in [words_of(t)] for p in [*((w, None) for w in ws), *zip(ws, ws[1:])]}
    n = quality.BUCKETS
    grams = {(r.a, r.b): (r.w, r.e, r.p) for r in spark.createDataFrame(sorted(joint, key=repr), "a string, b string").selectExpr(
        "a", "b", f"int(pmod(xxhash64(a), {n})) AS w", f"int(pmod(xxhash64(right(a, 2), 2), {n})) AS e", f"int(pmod(xxhash64(a, b, 3), {n})) AS p").collect()}

    def buckets(t):
        ws = words_of(t)
        return [b for w in ws for b in grams[w, None][:2]] + [grams[p][2] for p in zip(ws, ws[1:])]

    raw, trusted = Counter({b: 1 for b in range(n)}), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        trusted.update(buckets(t) if i in good else [])
    n_raw, n_good = raw.total(), trusted.total() + n
    weight = {b: math.log((trusted[b] + n * c / n_raw) / n_good) - math.log(c / n_raw) for b, c in raw.items()}
    ids = {i: t for i, t in reversed(rows)}
    got = quality.judged(docs, labels, -0.2, pairs=True).collect()
    for r in got:
        of = buckets(ids[r.doc_id])
        assert r.score == pytest.approx(sum(weight[b] for b in of) / max(1, len(of)), abs=2e-6)
        assert r.kept == (not r.base_failed and r.score >= -0.2)
    pick = random.Random(4)
    mixed = [(1000 + i, " ".join(pick.sample(words_of(t), len(words_of(t)))), "x", 1) for i, t in rows if i in good]
    both = {r.doc_id: r.score for r in quality.judged(docs.unionByName(spark.createDataFrame(mixed, docs.schema)), labels, pairs=True).collect()}
    assert sum(abs(both[1000 + i] - both[i]) > 1e-3 for i in good if 1000 + i in both) > len(mixed) / 2


def test_kept_rows_keep_their_columns(labelled):
    _, docs, labels = labelled
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = quality.judged(docs, labels).filter("kept").select("doc_id").collect()
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in want) and want


def test_a_long_text(spark):
    pick = random.Random(2)
    text = "\n".join(" ".join(str(pick.randrange(300)) for _ in range(20)) for _ in range(4000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    row = quality.judged(docs, labels).first()
    assert tuple(row)[1:6] == counted(text)[:5] and row.score == 0


def test_empty_tables(spark, labelled):
    _, docs, labels = labelled
    assert quality.judged(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.judged(docs, labels.limit(0)).collect()} == {0.0}


def test_no_python_in_the_plan(labelled):
    _, docs, labels = labelled
    plan = quality.judged(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op7_quality_rules"](spark, folder)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted((i, *counted(t)) for i, t in rows)
    assert got.filter("kept AND base_failed").count() == 0
