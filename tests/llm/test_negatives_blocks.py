"""Blocks of vectors stay with the executors, also where their files are small."""

from pyspark.sql import functions as F

from pricetrail.llm import hard_negatives as H


def test_blocks_are_not_broadcast(frame, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 8)
    rows = [(i, i % 3, [i % 7, (i * i) % 11, i % 5]) for i in range(240)]
    index = H.Index(frame("id long, label long, v array<long>", rows), sample=40, ways=4, levels=0, block=10)
    none = F.lit(None).cast("array<long>")
    anchors = index.rows.filter("id % 20 = 0").withColumns({"a": F.col("id"), "peaks": none, "floors": none})
    found = index.search(anchors, True, 2, own_leaf=False)
    plan = found._jdf.queryExecution()
    assert index.blocks.count() == 24 and "Broadcast" not in plan.executedPlan().toString()
    score = lambda x, y: sum(p * q for p, q in zip(x, y))
    best = lambda i: sorted((-score(rows[i][2], v), j) for j, label, v in rows if label == rows[i][1] and j != i)[:2]
    got = sorted((r["a"], -r["score"], r["id"]) for r in found.collect())
    assert got == sorted((i, s, j) for i in range(0, 240, 20) for s, j in best(i))
