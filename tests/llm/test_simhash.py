"""Near-duplicates against comparing every fingerprint with every other."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricetrail.llm.queries import QUERIES
from pricetrail.llm.simhash import bucket_links, fingerprint, fingerprint_links, first_of_group, links_of_sorted, near_duplicates


def by_definition(text):
    """The fingerprint, a bit at a time."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, links):
    """value -> smallest value it is connected to."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in values}


def all_links(values, radius=3):
    values = sorted(values)
    return [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= radius]


def clustered(n, seed, spread=4):
    pick = random.Random(seed)
    centres = [pick.getrandbits(64) for _ in range(5)]
    out = set()
    while len(out) < n:
        v = pick.choice(centres)
        for _ in range(pick.randint(0, spread)):
            v ^= 1 << pick.randrange(64)
        out.add(v)
    return sorted(out)


TEXTS = [None, "", " \t\n", "one", "One two", "a b c", "A B C", "a b c d", "é ü x y", "x" * 5000, "the same words " * 400, "the same words"]


def test_fingerprint_follows_the_definition():
    for text in TEXTS + ["word%d other Word%d %d" % (i, i % 3, i) * 3 for i in range(30)]:
        assert fingerprint(text.encode() if text is not None else None) == by_definition(text)


def test_long_texts_are_read_whole():
    pick = random.Random(1)
    text = " ".join(str(pick.randrange(50)) for _ in range(40_000))
    assert fingerprint(text.encode()) == by_definition(text)


@pytest.mark.parametrize("n, spread", [(2, 2), (40, 3), (300, 3), (700, 5)])
def test_bucket_links_connect_what_all_pairs_connect(n, spread):
    values = clustered(n, n, spread)
    links = bucket_links(np.array(values, np.uint64), 3)
    assert all((a ^ b).bit_count() <= 3 for a, b in links) and len(links) < n
    assert groups(values, links) == groups(values, all_links(values))


def test_many_small_buckets_at_once():
    pick = random.Random(5)
    bucket, values, want = [], [], []
    for b in range(200):
        near = clustered(pick.randint(1, 30), b, 3)
        bucket += [b] * len(near)
        values += near
        want += all_links(near)
    links = links_of_sorted(np.array(bucket), np.array(values, np.uint64), 3)
    assert groups(values, links) == groups(values, want)


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_of_a_table(spark, tile):
    values = clustered(600, 9, 5)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    unique = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in fingerprint_links(unique, tile=tile).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    assert groups(values, links) == groups(values, all_links(values))


def expected(rows):
    prints = {by_definition(t) for _, t in rows}
    root = groups(prints, all_links(prints))
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[by_definition(t)]
            least[r] = min(i, least.get(r, i))
    return sorted(((i, by_definition(t), least.get(root[by_definition(t)])) for i, t in rows), key=repr)


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "a b c"), (None, "quite another text here"), (7, "moved elsewhere now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "first": F.lit(1), "component_id": F.lit(2)})
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs).collect()), key=repr)
    assert got == expected(rows)
    kept = first_of_group(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(one_of_each(rows), key=repr)


def one_of_each(rows):
    """The first row of every group: by doc_id, those without last, then by the SHA-256 of the text."""
    prints = {by_definition(t) for _, t in rows}
    root = groups(prints, all_links(prints))
    first = {}
    for i, t in rows:
        at = (i is None, i or 0, hashlib.sha256((t or "").encode()).digest(), i, t)
        r = root[by_definition(t)]
        first[r] = min(at, first.get(r, at), key=lambda x: x[:3])
    return [(i, t) for *_, i, t in first.values()]


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    a, b, c = "one long text about nothing much " * 9, "another text, of its own kind entirely " * 9, "third words that none has seen before " * 9
    rows = [(1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (5, c + "x"), (2, b), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id int, text string, digest string")
    got = [(r.doc_id, r.text or None) for r in first_of_group(docs).collect()]
    assert sorted(got, key=repr) == sorted(((i, t or None) for i, t in one_of_each(rows)), key=repr)
    assert (1, a) in got and (2, b) in got and (2, a) not in got and (7, None) in got and len(got) == 4


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == [] and first_of_group(docs).collect() == []


def test_registered_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op5_simhash_near_dedup"](spark, folder).collect()
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got), key=repr) == expected(rows)
    assert all(len(r.fingerprint) == 16 for r in got)
