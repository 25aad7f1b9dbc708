import random

from pricetrail.operators import changes as C
from pricetrail.operators import upsert as U
from pricetrail.sources.sinks import found_log, publish
from pricetrail.sources.tables import read_changes

LOG = "version long, kind string, entity_id string, payload string"


def log_rows(n, seed=1):
    rng = random.Random(seed)
    kinds = ["category", "product", "promotion", "collection", "identifier"]
    # one entity owns a third of the log
    return [(v, "product" if v % 3 == 0 else rng.choice(kinds), "hot" if v % 3 == 0 else str(rng.randrange(9)), f'{{"n":{v}}}') for v in range(1, n + 1)]


def image(df):
    return sorted((r["kind"], r["entity_id"], r["version"], r["payload"]) for r in df.collect())


def brute(rows, until):
    newest = {}
    for v, k, e, p in rows:
        if v <= until:
            newest[k, e] = (k, e, v, p)
    return sorted(newest.values())


def test_snapshot_and_delta_compose(frame):
    rows = log_rows(300)
    log = frame(LOG, rows)
    assert image(C.snapshot(log, 120)) == brute(rows, 120)
    later = U.apply_delta(C.snapshot(log, 120), C.delta(log, 120, 260))
    assert image(later) == brute(rows, 260)
    again = U.apply_delta(later.drop("outcome"), C.delta(log, 50, 260))
    assert image(again) == brute(rows, 260)
    assert {r["outcome"] for r in again.collect()} <= {"replayed", "untouched"}


def test_versions_are_gapless_and_ordered(frame):
    rows = [(k, e, p) for _, k, e, p in log_rows(500)]
    got = C.assign_versions(frame("kind string, entity_id string, payload string", rows), 40, ["kind", "entity_id", "payload"]).collect()
    assert sorted(r["version"] for r in got) == list(range(41, 541))
    in_order = sorted(got, key=lambda r: r["version"])
    assert [(r["kind"], r["entity_id"], r["payload"]) for r in in_order] == sorted(rows)


def test_pages_cover_the_snapshot_once(frame):
    log = frame(LOG, log_rows(300))
    whole = sorted(r["key"] for r in C.with_snapshot_key(C.snapshot(log, 200)).collect())
    seen, after = [], ""
    while after is not None:
        page = C.snapshot_page(log, 200, after, 7).orderBy("key").collect()
        seen += [r["key"] for r in page]
        after = page[-1]["next_cursor"]
    assert seen == whole
    every = C.snapshot_pages(log, 200, 7).orderBy("place").collect()
    assert [r["key"] for r in every] == whole and [r["page"] for r in every] == [i // 7 + 1 for i in range(len(whole))]


def test_publish_carries_versions_and_can_be_repeated(frame, tmp_path):
    batch = frame("kind string, entity_id string, payload string", [("product", "b", '{"x":1}'), ("product", "a", "{}")])
    found_log(batch.sparkSession, str(tmp_path), 10)
    for _ in range(2):
        publish(batch, 10, str(tmp_path))
    log = read_changes(batch.sparkSession, str(tmp_path)).orderBy("version").collect()
    assert [(r["version"], r["entity_id"], r["payload"]) for r in log] == [(11, "a", '{"version":11}'), (12, "b", '{"x":1,"version":12}')]


def test_watermark(frame):
    state = frame("generation string, version long", [("g", 5)])
    page = "server_version long, generation string, last boolean"
    decide = lambda rows, **k: tuple(C.advance(state, frame(page, rows), **k).first())
    assert decide([(9, "g", False), (9, "g", True)]) == ("advance", "g", 9)
    assert decide([(9, "g", False)]) == ("incomplete", "g", 5)
    assert decide([(9, "g", False), (8, "g", True)]) == ("inconsistent", "g", 5)
    assert decide([(9, "h", True)]) == ("bootstrap_required", "g", 5)
    assert decide([(9, "h", True)], bootstrap=True) == ("advance", "h", 9)
    assert decide([(3, "g", True)]) == ("inconsistent", "g", 5)
    assert decide([]) == ("incomplete", "g", 5)


PRODUCT = "id string, source_product_id string, sku string, barcode string, name string, price decimal(12,2), promotion_state string, version long"


def test_upsert_rules(frame, dicts):
    state = frame(PRODUCT, [("1", "s1", "k1", None, "one", 1, "none", 1), ("2", "s2", " ", "b2", "two", 2, "none", 2),
                            ("3", "s3", "k3", "b3", "three", 3, "none", 3), ("4", "s4", "k4", None, "four", 4, "none", 4)])
    batch = frame("id string, sku string, barcode string, name string, price decimal(12,2)",
                  [("1", None, "b1", "one", 1), ("2", "k2", None, "two", None), ("3", "other", None, "x", 9), ("5", None, None, "five", 5)])
    got = dicts(U.upsert(state, batch), "id")
    assert {k: v["outcome"] for k, v in got.items()} == {"1": "updated", "2": "updated", "3": "conflict", "4": "untouched", "5": "added"}
    assert (got["1"]["sku"], got["1"]["barcode"]) == ("k1", "b1")
    assert (got["2"]["sku"], got["2"]["barcode"], got["2"]["price"]) == ("k2", "b2", None)
    assert got["3"]["name"] == "three" and got["5"]["promotion_state"] == "none"
    same = U.upsert(state, state.select("id", "name", "price"))
    assert {r["outcome"] for r in same.collect()} == {"unchanged"}
    assert U.upsert_events(same, "product").isEmpty()


def test_absent_key_is_not_null(frame, dicts):
    state = frame(PRODUCT, [("1", "s1", "k1", None, "one", 1, "none", 1)])
    batch = frame("id string, name string, price decimal(12,2), supplied array<string>", [("1", "uno", None, ["name"])])
    got = dicts(U.upsert(state, batch), "id")["1"]
    assert got["outcome"] == "updated" and got["name"] == "uno" and got["price"] == 1
    batch = batch.withColumn("supplied", batch.supplied.cast("array<string>")).replace("uno", "one")
    assert dicts(U.upsert(state, batch), "id")["1"]["outcome"] == "unchanged"


def test_unknown_kind_is_reported(frame, dicts):
    replica = frame(LOG, [(1, "product", "a", "{}")])
    got = dicts(U.apply_delta(replica, frame(LOG, [(2, "voucher", "z", "{}"), (3, "product", "a", '{"x":1}')])), "entity_id")
    assert got["z"]["outcome"] == "unknown_kind" and got["z"]["payload"] is None and got["a"]["outcome"] == "updated"


def test_full_snapshot_keeps_local_rows(frame, dicts):
    ddl = "id string, name string, inactive boolean, possibly_inactive boolean, version long"
    state = frame(ddl, [("a", "A", False, False, 1), ("b", "B", False, False, 2), ("local", "L", False, False, 0)])
    got = dicts(U.apply_snapshot(state, frame("id string, name string", [("a", "A2"), ("c", "C")])), "id")
    assert {k: v["outcome"] for k, v in got.items()} == {"a": "updated", "b": "inactive", "local": "untouched", "c": "added"}
    assert got["b"]["inactive"] and not got["local"]["inactive"]
