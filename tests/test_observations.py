import random

from pyspark.sql import functions as F

from pricetrail.operators import membership as M
from pricetrail.operators import observations as O
from pricetrail.operators import promotions as R
from pricetrail.operators import quality as Q
from pricetrail.operators import runs as N


def test_absence_streak_equals_replay(frame):
    rng = random.Random(3)
    runs, ids = 12, [f"p{i}" for i in range(9)]
    seen = [(rng.choice(ids[:8]), rng.randrange(1, runs + 1)) for _ in range(30)]
    got = {(r["id"], r["run"]): (r["missing_count"], r["possibly_inactive"], r["inactive"]) for r in O.absence_streak(
        frame("id string, run int", seen), frame("id string", [(i,) for i in ids]), runs).collect()}
    want = {}
    for i in ids:
        count = 0
        for run in range(1, runs + 1):
            count = 0 if (i, run) in seen else count + 1
            want[i, run] = (count, count >= 1, count >= 3)
    assert got == want


def test_strict_dedupe(frame, dicts):
    cards = frame("id string, name string, price int", [("a", "x", 1), ("a", "x", 1), ("b", "x", 1), ("b", "x", None), ("c", None, None)])
    got = dicts(O.dedupe_strict(cards, "id"), "id")
    assert {k: v["conflicting"] for k, v in got.items()} == {"a": False, "b": True, "c": False}
    assert got["a"]["name"] == "x" and got["b"]["name"] is None


def test_repeated_pages(frame):
    cards = frame("scope string, page int, id string", [("s", 1, "a"), ("s", 1, "b"), ("s", 2, "b"), ("s", 2, "a"), ("s", 2, "a"), ("s", 3, "a"), ("t", 1, "a")])
    got = {(r["scope"], r["page"]): r["repeated"] for r in O.repeated_pages(cards, "scope", "page", "id").collect()}
    assert got == {("s", 1): False, ("s", 2): True, ("s", 3): False, ("t", 1): False}


SEEN = "id string, source_product_id string, name string, product_url string, brand string, category_id string, img string, price decimal(12,2), list_price decimal(12,2)"
KNOWN = "id string, source_product_id string, price decimal(12,2), old_price decimal(12,2), promotion_state string, promotion_start string, promotion_end string"


def test_search_patch_respects_campaigns(frame, dicts):
    known = frame(KNOWN, [("a", "1", 10, None, "none", None, None), ("b", "2", 10, 12, "dated", "x", "y"), ("c", "3", 10, 12, "observed", None, None),
                          ("d", "4", 10, 12, "dated", "x", "y")])
    seen = frame(SEEN, [(None, "1", "n", "u", None, None, None, 8, 10), (None, "2", "n", "u", "B", None, "i", 9, None), (None, "3", "n", "u", None, "/c/", None, 9, None),
                        (None, "4", "n", "u", None, None, None, 10, 12), (None, "9", "n", "u", None, None, None, 1, None)])
    got = dicts(O.search_patch(seen, known), "id")
    assert set(got) == set("abcd") and {k: v["promotion_conflict"] for k, v in got.items()} == {"a": False, "b": True, "c": True, "d": False}
    assert got["a"]["supplied"] == ["name", "product_url", "price", "old_price", "promo_price", "discount_percent", "promotion_state"]
    assert got["b"]["supplied"] == ["name", "product_url", "brand", "source_image_url", "full_image_url"]
    assert got["d"]["supplied"] == ["name", "product_url", "price", "old_price", "promo_price", "discount_percent"]


def test_membership_positions_and_lists(frame):
    rows = [("hot", f"p{n:03}") for n in range(40)] * 2 + [("cold", "z"), ("cold", "a")]
    placed = M.members(frame("c string, p string", rows), "c", "p")
    got = {(r["owner_id"], r["product_id"]): r["position"] for r in placed.collect()}
    assert got == {**{("hot", f"p{n:03}"): n + 1 for n in range(40)}, ("cold", "a"): 1, ("cold", "z"): 2}
    parts = M.member_lists(placed, 15).filter("owner_id = 'hot'").orderBy("part").collect()
    assert [len(r["product_ids"]) for r in parts] == [15, 15, 10] and sum((r["product_ids"] for r in parts), []) == [f"p{n:03}" for n in range(40)]


def test_incomplete_scopes_never_remove(frame):
    pair = "collection_id string, product_id string"
    scopes = frame("collection_id string, kind string, complete boolean, selective boolean, root boolean",
                   [("best", "open", False, False, True), ("dated", "dated", False, False, True), ("full", "open", True, False, True), ("sel", "open", False, True, True)])
    seen = frame(pair, [(c, "new") for c in ("best", "dated", "full", "sel")])
    linked = frame(pair, [(c, "old") for c in ("best", "dated", "full", "sel")])
    published = frame(pair + ", same_period boolean", [("best", "doc", True), ("dated", "doc", True), ("dated", "last", False), ("full", "doc", True)])
    got = {}
    for r in M.publish_collection(scopes, seen, linked, published).collect():
        got.setdefault(r["collection_id"], set()).add(r["product_id"])
    assert got == {"best": {"new", "old", "doc"}, "dated": {"new", "doc"}, "full": {"new"}, "sel": {"old"}}
    assert {r["collection_id"] for r in M.collection_modes(scopes, seen).filter("absences").collect()} == {"full"}


def test_campaign_decisions(frame):
    at = lambda d: frame("starts_at string", [(d,)] if d else [])
    some, none = frame("id string", [("a",)]), frame("id string", [])
    decide = lambda *a: M.campaign_decision(*a).first()["decision"]
    assert decide(at("2026-02"), at("2026-01"), some) == "publish" and decide(at("2026-02"), at(None), some) == "publish"
    assert decide(at("2026-01"), at("2026-02"), some) == "older campaign" and decide(at("2026-02"), at(None), none) == "empty campaign"


def test_promotion_bounds_are_inclusive(frame):
    ddl = "id string, promotion_state string, promotion_start timestamp_ntz, promotion_end timestamp_ntz, inactive boolean, price int, old_price int, promo_price int, discount_percent int"
    from datetime import datetime as T

    s, e = T(2026, 10, 1), T(2026, 10, 14, 23, 59, 59)
    products = frame(ddl, [("dated", "dated", s, e, False, 1, 2, 1, 5), ("gone", "dated", s, e, True, 1, 2, 1, 5), ("seen", "observed", None, None, False, 1, 2, 1, 5),
                           ("none", "none", None, None, False, 1, None, None, None), ("legacy", None, None, None, True, 20, None, None, None)])
    promos = frame("id string, starts_at timestamp_ntz, ends_at timestamp_ntz, last_updated timestamp_ntz", [("m1", s, e, s), ("m2", s, e, e), ("m3", T(2020, 1, 1), T(2020, 1, 2), e)])
    links = frame("product_id string, promotion_id string, old_price int, promotional_price int, discount_percent int", [("legacy", m, 20, n, 10) for n, m in enumerate(("m1", "m2", "m3"))])
    active = lambda t: {r["id"] for r in R.active_promotions(products, links, promos, F.lit(t)).collect()}
    assert active(s) == active(e) == {"dated", "seen", "legacy"}
    assert active(T(2026, 9, 30, 23, 59, 59)) == active(T(2026, 10, 15)) == {"seen"}
    shown = R.with_effective_price(R.overlay_promotion(products, links, promos, F.lit(s))).filter("id = 'legacy'").first()
    assert shown["promo_price"] == 1 and shown["effective_price"] == 1 and shown["active"]


def test_freshness_ladder(frame, dicts):
    from datetime import datetime as T
    from datetime import timedelta as D

    now = T(2026, 10, 10, 12)
    ago = lambda h: now - D(hours=h)
    ddl = "id long, source string, started_at timestamp_ntz, status string, scope string, price_refresh_complete boolean, source_error string"
    rows = [(1, "fresh", ago(25), "complete", "full", True, None), (2, "stale", ago(27), "complete", "full", True, None), (3, "future", ago(-2), "complete", "full", True, None),
            (4, "running", ago(20), "complete", "full", True, None), (5, "running", ago(3), "running", "full", False, None), (6, "dead", ago(13), "running", "full", False, None),
            (7, "failed", ago(20), "complete", "full", True, None), (8, "failed", ago(1), "partial", "full", True, "access_denied"), (9, "chosen", ago(1), "complete", "selected", True, None),
            (10, "never", ago(2), "complete", "full", False, None)]
    at = F.lit(now)
    fresh = N.freshness(frame(ddl, rows), at)
    got = dicts(fresh.withColumns({"due": N.is_due(at), "warning": N.warning(at)}), "source")
    assert {k: v["status"] for k, v in got.items()} == {"fresh": "fresh", "stale": "stale", "future": "unknown", "running": "running", "dead": "error", "failed": "error", "never": "unknown"}
    assert {k for k, v in got.items() if not v["due"]} == {"running"} and got["fresh"]["due"]
    assert {k: v["warning"] for k, v in got.items()} == {"fresh": "none", "stale": "stale", "future": "stale", "running": "running", "dead": "error", "failed": "access_denied", "never": "unconfirmed"}


def test_sku_diagnostics(frame):
    rows = [(str(90000 + i), s) for i, s in enumerate([None, "", " \t ", "00123", "bad sku"])]
    d = Q.diagnose_skus(frame("id string, sku string", rows)).first()
    assert (d["total_products"], d["products_with_sku"], d["products_without_sku"], d["products_with_null_sku"], d["products_with_empty_sku"],
            d["products_with_whitespace_sku"], d["products_with_valid_sku"], d["reason"]) == (5, 2, 3, 1, 1, 1, 1, "ready")
    reason = lambda rows, after="": Q.diagnose_skus(frame("id string, sku string", rows), after).first()["reason"]
    assert reason([]) == "empty_catalog" and reason([("1", "k")]) == "all_products_have_sku"
    assert reason(rows, "wrong") == "invalid_after" and reason(rows, "90004") == "missing_products_before_cursor"


def test_absence_spans_hold_what_the_streak_writes_out(frame):
    sightings = frame("id string, run long", [("a", 2), ("a", 2), ("a", 5), ("b", 1), ("gone", 3)])
    scope = frame("id string", [("a",), ("b",), ("c",)])
    spans = O.absence_spans(sightings, scope, 6)
    assert sorted(map(tuple, spans.collect())) == [("a", 1, 1, 1), ("a", 2, 4, 0), ("a", 5, 6, 0), ("b", 1, 6, 0), ("c", 1, 6, 1)]
    streak = O.absence_streak(sightings, scope, 6).collect()
    for run in range(1, 7):
        wanted = sorted((r.id, r.missing_count, r.possibly_inactive, r.inactive) for r in streak if r.run == run)
        assert sorted(map(tuple, O.absences_at(spans, run).collect())) == wanted
