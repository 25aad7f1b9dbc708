"""Hard negatives against scoring all pairs; the tree's ranges and eliminations against the vectors themselves."""

import random

import numpy as np
from pyspark.sql import functions as F

from pricetrail.llm.hard_negatives import Index, Ranges, Tree, distances, first_of_each, hard_negatives, products, spread, surviving
from pricetrail.llm.queries import QUERIES


def by_definition(rows, anchors, positives=5, negatives=5, shares=(80, 100)):
    """rows: (id, label, vector of whole numbers)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda own: sorted(((dot(own, v), -i, label) for i, label, v in rows), reverse=True)
    out = []
    for i, label, v in rows:
        if not anchors(i):
            continue
        scored = [(s, -j, other) for s, j, other in order(v)]
        for p, pid, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fit = [x for x in scored if x[2] != label and shares[0] * p <= 100 * x[0] <= shares[1] * p][:negatives]
            out += [(i, pid, rank, nid, p, s) for rank, (s, nid, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(frame, rows, anchors, ddl="vec_id long, label int, embedding array<float>, a int, v int, items string", **settings):
    df = frame(ddl, [(i, y, v and [x if x is None else float(x) for x in v], 1, 2, "x") for i, y, v in rows])
    found = hard_negatives(df, anchors, F.col("label"), scale=1, **settings)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(seed, n, dim=8, labels=4):
    pick = random.Random(seed)
    centres = [[pick.randint(-30, 30) for _ in range(dim)] for _ in range(9)]
    return [(i, pick.randrange(labels), [c + pick.randint(-6, 6) for c in pick.choice(centres)]) for i in range(n)]


def test_equals_all_pairs(frame):
    rows = clustered(1, 400)
    small = {"sample": 60, "ways": 4, "block": 16}
    assert mined(frame, rows, F.col("id") % 10 == 0, **small) == by_definition(rows, lambda i: i % 10 == 0)
    one_leaf = mined(frame, rows, F.col("id") % 10 == 0, levels=0, shares=(50, 90), positives=2, negatives=3)
    assert one_leaf == by_definition(rows, lambda i: i % 10 == 0, 2, 3, (50, 90))


def test_ties_and_repeated_rows(frame):
    rows = [(i, i % 2, [1.0, 0.0]) for i in range(30)] + [(7, 1, [1.0, 0.0]), (10, 0, [1.0, 0.0]), (10, 0, [2.0, 0.0])]
    got = mined(frame, rows, F.col("id") % 10 == 0, sample=8, ways=3, block=4)
    assert got == by_definition(rows, lambda i: i % 10 == 0)


def test_defined_cases(frame):
    bad = [(1, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan"), 1.0]),
           (5, 1, [float("inf"), 1.0]), (6, 1, [9.0, 9.0, 9.0]), (8, 1, [])]
    good = [(0, 1, [3.0, 4.0]), (10, 1, [3.0, 3.0]), (11, 2, [3.0, 3.0]), (20, 3, [0.0, 0.0]), (21, 3, [-1.0, 5.0]), (30, 4, [-3.0, -3.0]), (31, 4, [3.0, 3.0])]
    assert mined(frame, bad + good, F.col("id") % 10 == 0) == by_definition(good, lambda i: i % 10 == 0)
    assert mined(frame, bad, F.col("id") % 10 == 0) == [] and mined(frame, [], F.col("id") % 10 == 0) == []
    assert mined(frame, good, F.col("id") == 77) == []
    huge = [(0, 1, [3e8, 0.0]), (1, 1, [3e8 + 64, 1.0]), (2, 2, [3e8, 5.0])]
    exact = [(i, label, [int(np.float32(x)) for x in v]) for i, label, v in huge]
    assert mined(frame, huge, F.col("id") == 0) == by_definition(exact, lambda i: i == 0)


def test_a_third_of_the_rows_in_one_place(frame):
    rows = clustered(2, 200) + [(1000 + i, i % 4, [5.0] * 8) for i in range(100)]
    assert mined(frame, rows, F.col("id") % 20 == 0, sample=50, ways=4, block=8) == by_definition(rows, lambda i: i % 20 == 0)


def test_leaves_hold_all_rows_in_bounded_blocks(frame):
    rows = clustered(3, 300) + [(500, 1, [5.0] * 8)] * 200
    df = frame("id long, label long, v array<long>", [(i, label, [int(x) for x in v]) for i, label, v in rows])
    index = Index(df, sample=40, ways=4, block=20)
    sizes = [len(r["items"]) for r in index.blocks.collect()]
    assert sum(sizes) == 500 and max(sizes) <= 3 * 20 and index.tree.leaves <= 16


def test_elimination_keeps_every_match():
    pick = np.random.default_rng(1)
    vectors = np.concatenate([pick.integers(-40, 40, (6, 5))[pick.integers(0, 6, 400)] + pick.integers(-4, 5, (400, 5)), pick.integers(-5, 5, (20, 5))])
    tree = Tree(vectors[:120], ways=4, levels=2)
    leaf, met = tree.route(vectors)
    ranges = Ranges(tree)
    for node, far, chosen, rows in met:
        length = np.sqrt((vectors[rows] ** 2).sum(1))
        for j in np.unique(chosen):
            for i, x in enumerate(np.column_stack([length, far])[chosen == j].T, -1):
                ranges.add(node, int(j), i, x.min(), x.max())
    anchors = vectors[::7]
    score = products(anchors, vectors)
    low = np.quantile(score, 0.9, axis=1)
    high = np.quantile(score, 0.95, axis=1)
    live = surviving(tree, ranges, anchors, low, high)
    inside = (score >= low[:, None]) & (score <= high[:, None])
    assert live[np.arange(len(anchors))[:, None], leaf[None, :]][inside].all()
    assert live.mean() < 0.9  # siblings are eliminated


def test_helpers():
    assert len(spread(np.zeros((5, 3), np.int64), 4)) == 1 and len(spread(np.zeros((0, 3), np.int64), 4)) == 0
    assert distances(np.array([[0, 0]]), np.array([[3, 4]])).tolist() == [[5.0]]
    assert products(np.array([[1 << 31, 3]]), np.array([[1 << 31, 1]])).tolist() == [[(1 << 62) + 3]]
    kept = first_of_each(np.array([1, 0, 1, 1]), np.array([5, 5, 7, 5]), np.array([9, 9, 9, 2]), 2)
    assert kept.tolist() == [1, 2, 3]


def test_registered_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    scaled = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, np.floor(256 * np.array(r.embedding, float)).astype(int).tolist()) for r in rows]
    found = QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.001").collect()
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)
    assert got == by_definition(scaled, lambda i: i % 100 == 0)
