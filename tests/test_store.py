"""Manifests, and the catalog writer on top of them: what a dead or a second writer leaves behind changes nothing."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricetrail.operators.changes import snapshot
from pricetrail.operators.upsert import refuse_shared
from pricetrail.schemas import PRODUCTS
from pricetrail.sources.catalog_store import Catalog
from pricetrail.sources.manifest import Manifest, Part, Store, Taken
from pricetrail.sources.sinks import found_log, publish
from pricetrail.sources.tables import read_changes

AT, LATER = "2024-05-01 00:00:00", "2024-06-01 00:00:00"
EVENT = "kind string, entity_id string, payload string"
BATCH = "id string, source_product_id string, sku string, barcode string, name string, price decimal(12,2)"


def moment(text):
    return F.lit(text).cast("timestamp")


def events(frame, *ids):
    return frame(EVENT, [("product", i, '{"v": 1}') for i in ids])


def test_manifests_follow_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read() == Manifest() and store.numbers() == []
    first = store.publish(Manifest(), generation="g", head=3, parts=(Part("log/a", 1, 3, 3),), tables={"t": "t/x"})
    assert store.read() == first and first.number == 1
    with pytest.raises(Taken):
        store.publish(Manifest(), generation="other")
    assert store.read() == first and store.numbers() == [1]
    second = store.update(lambda m: {"head": m.head + 1})
    assert store.read() == second and store.read(1) == first and second.parts == first.parts
    assert store.update(lambda m: None) == second
    assert [n for n in os.listdir(tmp_path / "manifest") if "draft" in n] == []


def test_update_starts_again_when_another_writer_was_faster(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path)), []

    def change(m):
        if not seen:
            store.publish(m, head=10)
        seen.append(m.head)
        return {"head": m.head + 1}

    assert store.update(change).head == 11 and seen == [0, 10]


def test_a_dead_writer_leaves_nothing_that_counts(spark, frame, tmp_path):
    log = str(tmp_path / "log")
    publish(events(frame, "a", "b"), 0, log)
    rows = events(frame, "c", "d").withColumn("version", F.lit(3))
    Store(spark, log).write(rows.select("version", "kind", "entity_id", "payload").limit(1), "log")  # half a batch, no manifest
    assert read_changes(spark, log).count() == 2
    publish(events(frame, "c", "d"), 2, log)
    publish(events(frame, "d", "c"), 2, log)  # again: the same rows
    assert sorted((r.version, r.entity_id) for r in read_changes(spark, log).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_a_new_log_begins_at_its_founding_version(spark, frame, tmp_path):
    with pytest.raises(ValueError):
        publish(events(frame, "a"), 10, str(tmp_path / "new"))
    found_log(spark, str(tmp_path / "old"), 10)
    with pytest.raises(Taken):
        found_log(spark, str(tmp_path / "old"), 12)
    publish(events(frame, "a"), 10, str(tmp_path / "old"))
    assert read_changes(spark, str(tmp_path / "old")).first()["version"] == 11


def test_a_delta_lists_the_folders_of_its_versions_only(spark, frame, tmp_path):
    log = str(tmp_path)
    for base, ids in ((0, "ab"), (2, "cd"), (4, "ef")):
        publish(events(frame, *ids), base, log)
    parts = Store(spark, log).read().parts
    rows = read_changes(spark, log, since=2, until=3)
    assert {f.split("/")[-2] for f in rows.inputFiles()} == {parts[1].folder.split("/")[-1]}
    assert [r["version"] for r in rows.collect()] == [3]
    assert read_changes(spark, log, since=6).count() == 0


def product(i, sku=None, barcode=None, name="n", price=1, source=None):
    return (i, source or f"s{i}", sku, barcode, name, price)


def test_state_and_log_move_together(spark, frame, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.write("product", frame(BATCH, []), moment(AT)).count() == 0 and catalog.manifest().number == 0
    catalog.write("product", frame(BATCH, [product("b", "1"), product("a", "2"), product("c")]), moment(AT))
    first = catalog.manifest()
    out = catalog.write("product", frame(BATCH, [product("a", "2", price=2), product("c"), product("d", "9")]), moment(LATER))
    assert {r.id: r.outcome for r in out.collect()} == {"a": "updated", "b": "untouched", "c": "unchanged", "d": "added"}
    state = {r.id: r for r in catalog.table("products").collect()}
    assert {i: r.version for i, r in state.items()} == {"a": 4, "b": 2, "c": 3, "d": 5}
    assert state["a"].created_at == datetime(2024, 5, 1) and state["a"].updated_at == datetime(2024, 6, 1) and state["b"].updated_at == datetime(2024, 5, 1)
    assert catalog.manifest().head == 5 and catalog.manifest().generation == first.generation
    for at in (first, catalog.manifest()):  # the newest images at a version are the state at that version
        image = snapshot(catalog.changes(0, at.head)).select(F.from_json("payload", PRODUCTS).alias("p")).select("p.*")
        assert sorted(image.collect(), key=repr) == sorted(catalog.table("products", at).select(image.columns).collect(), key=repr)
    catalog.write("product", frame(BATCH, [product("c")]), moment(LATER))  # nothing new
    assert catalog.manifest().number == 2


def test_identifiers_have_one_owner(spark, frame, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.write("product", frame(BATCH, [product("a", "1", "11"), product("e", " ")]), moment(AT))
    rows = [product("b", "1", "11"), product("c", "7"), product("d", "7"), product("a", "1", "11", price=3), product("e", "8"),
            product("f", " "), product("g", ""), product("h", source="sa"), product("i", "9", source="si")]
    out = {r.id: r.outcome for r in catalog.write("product", frame(BATCH, rows), moment(LATER)).collect()}
    assert out == {"a": "updated", "b": "conflict", "c": "conflict", "d": "conflict", "e": "updated", "f": "added", "g": "added", "h": "conflict", "i": "added"}
    state = {r.id: r for r in catalog.table("products").collect()}
    assert set(state) == {"a", "e", "f", "g", "i"} and state["e"].sku == "8"
    assert sorted(r.version for r in state.values()) == [3, 4, 5, 6, 7]


def test_refusal_is_the_same_in_any_order_and_reads_what_is_supplied(frame):
    state = frame("id string, sku string, barcode string", [("x", "1", None)])
    ddl = "id string, sku string, barcode string, supplied array<string>"
    rows = [("a", "1", None, ["barcode"]), ("b", None, "5", ["sku", "barcode"]), ("c", None, "5", ["barcode"]), ("x", "1", None, ["sku"])]
    for order in (rows, rows[::-1]):
        assert {r.id: r.refused for r in refuse_shared(state, frame(ddl, order)).collect()} == {"a": False, "b": True, "c": True, "x": False}
    assert refuse_shared(state, frame("id string, name string", [("q", "n")])).first()["refused"] is False


def test_other_kinds_append_and_compaction(spark, frame, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    tree = "id string, parent_id string, name string, level int, sort_order int, source_url string"
    catalog.write("category", frame(tree, [("/a/", None, "A", 0, 0, "u"), ("/a/b/", "/a/", "B", 1, 0, "u")]), moment(AT))
    catalog.write("category", frame(tree, [("/a/", None, "A2", 0, 0, "u")]), moment(AT))
    members = frame("product_id string, promotion_id string", [("a", "p")])
    catalog.append(frame(EVENT, [("promotion", "p", "{}")]), {"product_promotions": members})
    assert catalog.manifest().head == 4 and len(catalog.manifest().parts) == 3
    assert catalog.table("product_promotions").count() == 1 and catalog.table("categories").filter("name = 'A2' AND version = 3").count() == 1
    before, held = sorted(map(tuple, catalog.changes().collect())), catalog.manifest()
    catalog.compact(until=3)
    assert [(p.first, p.last, p.rows) for p in catalog.manifest().parts] == [(1, 3, 3), (4, 4, 1)]
    assert sorted(map(tuple, catalog.changes().collect())) == before == sorted(map(tuple, catalog.changes(at=held).collect()))
    gone = catalog.store.clean(keep=1)
    assert len([g for g in gone if g.startswith("log/")]) == 2 and sorted(map(tuple, catalog.changes().collect())) == before
    assert catalog.table("categories").count() == 2
