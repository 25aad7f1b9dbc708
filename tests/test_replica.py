"""Rows of one batch that mean one product, and the plan that finds them."""

import random

import pytest

from pricetrail.operators import replica as P
from pricetrail.operators.identity import shared_groups
from pricetrail.plans.catalog import QUERIES

PRODUCT = "id string, source_product_id string, sku string, barcode string, name string, price decimal(12,2)"
NONE = "barcode string, product_id string"


def upserted(frame, rows, state=(), online=False, aliases=()):
    stored = frame(PRODUCT + ", needs_review boolean", [(*s, False) for s in state])
    out = P.replica_upsert(stored, frame(NONE, list(aliases)), frame(PRODUCT, rows), online)
    products = {r.id: r for r in out["products"].collect()}
    return products, {r.incoming_id: (r.product_id, r.outcome) for r in out["outcomes"].collect()}, sorted(map(tuple, out["aliases"].collect())), out


def test_two_new_rows_with_one_barcode_are_one_product(frame):
    rows = [("n2", None, "s1", "b1", None, 2), ("n1", None, "s1", "b1", "first", 1), ("n3", "x", None, "b3", "alone", 3)]
    products, outcomes, aliases, _ = upserted(frame, rows)
    assert outcomes == {"n1": ("n1", "added"), "n2": ("n1", "updated"), "n3": ("n3", "added")}
    assert set(products) == {"n1", "n3"} and products["n1"].name == "first" and products["n1"].price == 2 and not products["n1"].needs_review
    assert aliases == [("b1", "n1"), ("b3", "n3")]


def test_links_over_other_rows_and_further_codes(frame):
    rows = [("a", None, "s1", "b1", None, 1), ("b", None, "s1", "b2", "B", 2), ("c", None, None, "b2", "C", None), ("d", "7", "s9", None, "D", 4)]
    products, outcomes, aliases, _ = upserted(frame, rows)
    assert outcomes == {"a": ("a", "added"), "b": ("a", "updated"), "c": ("a", "updated"), "d": ("d", "added")}
    assert products["a"].barcode == "b1" and products["a"].name == "C" and products["a"].price is None and products["a"].needs_review
    assert aliases == [("b1", "a"), ("b2", "a")]


def test_online_a_different_identifier_is_a_conflict(frame):
    rows = [("a", None, "s1", "b1", "A", 1), ("b", None, "s2", "b1", "B", 2), ("c", None, "s1", "b1", "C", 3)]
    products, outcomes, _, out = upserted(frame, rows, online=True)
    assert outcomes == {"a": ("a", "added"), "b": ("a", "conflict"), "c": ("a", "updated")}
    assert products["a"].name == "C" and [tuple(r) for r in out["reviews"].collect()] == [("b", "existing identifiers differ")]


def test_a_group_that_reaches_a_stored_product_is_a_conflict(frame):
    state = [("p", "1", "s1", None, "P", 1)]
    rows = [("q", "1", None, "b9", "Q", 2), ("n", None, None, "b9", "N", 3), ("m", None, "other", None, "M", 4)]
    products, outcomes, aliases, _ = upserted(frame, rows, state)
    assert outcomes == {"q": ("p", "updated"), "n": ("n", "conflict"), "m": ("m", "added")}
    assert set(products) == {"p", "m"} and products["p"].barcode == "b9" and aliases == [("b9", "p")]


def test_order_does_not_matter(frame):
    pick = random.Random(8)
    code = lambda kind, n: pick.choice([None, f"{kind}{pick.randrange(n)}"])
    state = [(f"p{i}", f"src{i}", f"s{i}", f"b{i}", "P", 1) for i in range(6)]
    rows = [(f"n{i:02}", code("src", 40), code("s", 40), code("b", 40), pick.choice([None, f"name {i}"]), i) for i in range(50)]
    seen = []
    for _ in range(2):
        pick.shuffle(rows)
        products, outcomes, aliases, out = upserted(frame, rows, state)
        seen.append((sorted(map(tuple, products.values()), key=repr), outcomes, aliases, sorted(map(tuple, out["reviews"].collect()))))
        assert len(outcomes) == 50
        holders = {}
        for r in products.values():
            for kind in ("source_product_id", "sku", "barcode"):
                if r[kind] is not None:
                    assert holders.setdefault((kind, r[kind]), r.id) == r.id  # one owner each
    assert seen[0] == seen[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_by_definition(frame, seed):
    pick = random.Random(seed)
    rows = [(f"r{i:03}", pick.choice([None, f"s{pick.randrange(60)}"]), pick.choice([None, f"b{pick.randrange(60)}"])) for i in range(90)]
    rows += [(f"z{i:03}", f"c{i}", f"c{i + 1}" if i % 2 else None) for i in range(5)] + [(f"y{i:03}", f"k{i // 2}", f"j{(i + 1) // 2}") for i in range(40)]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if (a[1] and a[1] == b[1]) or (a[2] and a[2] == b[2]):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r[0])
    wanted = {m: g for g, members in groups.items() if len(members) > 1 for m in members}
    found = shared_groups(frame("id string, sku string, barcode string", rows), "id", ("sku", "barcode"))
    assert {r.id: r.root for r in found.collect()} == wanted
    assert shared_groups(frame("id string, sku string, barcode string", []), "id", ("sku",)).count() == 0


def test_scans_and_exchanges(spark):
    plan = QUERIES["ups3_replica_state"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= 8
    executed = QUERIES["ups3_replica_state"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") <= 12
