"""Every order of the filters applied to every document, against the counts by intervals of orders."""

import random
from collections import Counter
from itertools import permutations
from math import factorial

from pricetrail.llm.filter_audit import audit, filter_orders, intervals, lehmer_rank, masks


def test_ranks_follow_the_orders():
    for size in (1, 3, 5):
        for rank, order in enumerate(permutations(range(size))):
            assert lehmer_rank(order, size) == rank
    assert lehmer_rank((4, 2), 5) == 4 * 24 + 2 * 6 and lehmer_rank((), 5) == 0


def test_intervals_cover_each_order_of_a_mask_once():
    size = 4
    seen = {}
    for mask, step, low, high in intervals(size):
        for rank in range(low, high):
            assert seen.setdefault((mask, rank), step) == step
    orders = list(permutations(range(size)))
    wanted = {(m, r): next(k for k, f in enumerate(o, 1) if m >> f & 1) for m in range(1, 1 << size) for r, o in enumerate(orders)}
    assert seen == wanted
    assert len(intervals(size)) < sum(factorial(size) for _ in range(1 << size))


def applied(rows, names):
    """rows: (part, mask, good). Every order, one filter after the other."""
    out = {}
    for part in {p or "" for p, _, _ in rows}:
        own = [(m, g or 0) for p, m, g in rows if (p or "") == part]
        total = Counter()
        for order in permutations(range(len(names))):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0] >> f & 1]
                left = [x for x in left if not x[0] >> f & 1]
                fails = sum(m >> f & 1 for m, _ in own)
                out[part, "".join(names[i] for i in order), step] = [
                    len(left), len(gone), fails - len(gone), sum(m == 1 << f for m, _ in own), sum(g for _, g in gone)]
                total[f] += len(gone)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[names.index(order[step - 1])])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_equals_applying_every_order(frame):
    pick = random.Random(4)
    rows = [(pick.choice(["a", "b", "", None]), pick.choice([0, 0, *range(16)]), pick.choice([0, 1, None])) for _ in range(400)]
    rows += [("sound", 0, 1)] * 3
    for names in ("WXYZ", "ZYXW"):
        got = audited(audit(frame("part string, mask int, good_lost int", rows), names, ["good_lost"]))
        assert got == applied(rows, names)
    assert audited(audit(frame("part string, mask int, good_lost int", []), "WXYZ", ["good_lost"])) == {}
    one = audited(audit(frame("part string, mask int, good_lost int", [("p", 1, 1)]), "Q", ["good_lost"]))
    assert one == {("p", "Q", 1): (0, 1, 0, 1, 1, 1)}


def test_masks(frame):
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, plain, "s"), (2, plain, "s"), (3, None, None), (4, "", "s"), (5, "\t \n", "s"), (None, plain, "s"), (6, plain + " |", "s"),
        (7, "W" + plain[1:], "s"), (8, "ABCDEFG " * 60, "s"), (9, "same Same " * 30, "s"), (9, plain, "s"), (10, "É" * 400, "s"), (0, "x#y", "s"),
    ]
    docs = frame("doc_id int, text string, source string, mask int, digest string, least int, part int", [(*r, 1, "d", 2, 3) for r in rows])
    labels = frame("doc_id int, quality int, toxic int, mask int", [(1, 1, 0, 9), (1, 0, 1, 9), (2, None, None, 9), (None, 1, 1, 9), (99, 1, 1, 9), (9, 1, 0, 9)])
    got = sorted(((r.doc_id, r.mask, r.good_lost, r.toxic_lost) for r in masks(docs, labels).collect()), key=repr)
    wanted = [(1, 0, 1, 1), (2, 16, 0, 0), (3, 1, 0, 0), (4, 17, 0, 0), (5, 1, 0, 0), (None, 0, 0, 0), (6, 8, 0, 0), (7, 0, 0, 0),
              (8, 6, 0, 0), (9, 6, 1, 0), (9, 16, 1, 0), (10, 1, 0, 0), (0, 9, 0, 0)]
    assert got == sorted(wanted, key=repr)
    parts = {r.part for r in filter_orders(docs, labels).collect()}
    assert parts == {"s", ""}


def test_a_long_text_and_empty_tables(frame, spark):
    labels = frame("doc_id long, quality int, toxic int", [])
    long = frame("doc_id long, text string, source string", [(1, "Word " * 300_000, "s"), (2, "Word " * 300_000, "s")])
    assert sorted(r["mask"] for r in masks(long, labels).collect()) == [6, 22]
    assert filter_orders(frame("doc_id long, text string, source string", []), labels).count() == 0
