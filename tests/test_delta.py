"""A slice of the log applied to a replica: replays, order, and any cut of the log give the same replica."""

import json
import random

import pytest

from pricetrail.operators.delta import apply_changes

CHANGES = "version long, kind string, entity_id string, payload string"
SHAPES = {
    "categories": "id string, parent_id string, name string, level int, sort_order int, source_url string",
    "products": "id string, source_product_id string, sku string, barcode string, name string, price decimal(12,2), needs_review boolean",
    "aliases": "barcode string, product_id string", "promotions": "id string, data string", "collections": "id string, data string",
    "links": "promotion_id string, product_id string", "members": "collection_id string, product_id string",
    "pending": "id string, sku string, barcode string, status string, product_id string",
}


def empty(frame):
    return {name: frame(ddl, []) for name, ddl in SHAPES.items()}


def held(tables):
    out = {name: sorted((tuple(r[c] for c in sorted(r.asDict()) if c != "id" or name != "pending") for r in tables[name].collect()), key=repr) for name in SHAPES}
    return out


def log_of_all_kinds(seed):
    pick, rows = random.Random(seed), []
    for v in range(1, 61):
        kind = pick.choice(["category", "product", "product", "promotion", "collection", "identifier"])
        n = pick.randrange(6)
        payload = {
            "category": {"name": f"name {v}", "level": 0, "sort_order": v, "source_url": f"u{n}", "parent_id": None},
            "product": {"source_product_id": f"s{n}", "sku": f"k{n}", "barcode": f"b{n}", "name": f"n{v}", "price": v},
            "promotion": {"product_ids": [f"p{pick.randrange(6)}" for _ in range(pick.randrange(3))]},
            "collection": {"product_ids": [f"p{pick.randrange(6)}"]},
            "identifier": {"sku": f"k{n}", "barcode": f"b{n}", "status": "matched", "product_id": f"p{n}"},
        }[kind]
        rows.append((v, kind, f"p{n}" if kind == "product" else f"{kind}{n}", json.dumps(payload)))
    return rows


@pytest.mark.parametrize("seed, cut", [(1, 20), (2, 45)])
def test_two_slices_are_one(frame, seed, cut):
    rows = log_of_all_kinds(seed)
    whole = apply_changes(empty(frame), frame(CHANGES, rows))
    first = apply_changes(empty(frame), frame(CHANGES, rows[:cut]))
    both = apply_changes({n: first[n].select(*[c.split()[0] for c in ddl.split(", ")]) if n != "pending" else first[n].selectExpr("'' AS id", "sku", "barcode", "status", "product_id")
                          for n, ddl in SHAPES.items()}, frame(CHANGES, rows), since=cut)
    assert held(both) == held(whole)
    assert {r["name"] for r in whole["products"].collect()} == {json.loads(p)["name"] for p in {e: p for _, k, e, p in rows if k == "product"}.values()}


def test_unknown_kinds_stop_the_job(frame):
    with pytest.raises(Exception, match="unknown kind of change: voucher"):
        apply_changes(empty(frame), frame(CHANGES, [(1, "voucher", "x", "{}")]))


def test_a_category_keeps_what_the_change_does_not_name(frame):
    tables = empty(frame) | {"categories": frame(SHAPES["categories"], [("/a/", None, "A", 0, 3, "u")])}
    out = apply_changes(tables, frame(CHANGES, [(1, "category", "/a/", '{"name": "B"}')]))
    assert tuple(out["categories"].first()) == ("/a/", None, "B", 0, 3, "u")


def test_conflicting_products_are_reviewed(frame):
    tables = empty(frame) | {"products": frame(SHAPES["products"], [("a", "s1", "k1", None, "A", 1, False)])}
    out = apply_changes(tables, frame(CHANGES, [(1, "product", "a", '{"source_product_id": "s1", "sku": "other", "name": "B"}')]))
    assert out["products"].first()["name"] == "A" and [tuple(r) for r in out["reviews"].collect()] == [("a", "existing identifiers differ")]
