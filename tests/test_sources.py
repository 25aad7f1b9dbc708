import json

import pytest
from pyspark.sql import functions as F

from pricetrail.operators import extraction as E
from pricetrail.operators.changes import snapshot
from pricetrail.profile import ShopProfile
from pricetrail.schemas import CHANGES
from pricetrail.sources import identifier_files as D
from pricetrail.sources import search_json as J
from pricetrail.sources import sinks as S
from pricetrail.sources.tables import read_catalog, read_changes
from pricetrail.streaming import feeds as W

SHOP = ShopProfile()


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("sep", [";", ",", "\t"])
def test_delimited_file(spark, tmp_path, sep, end):
    lines = [["Cod SKU", "EAN", "Denumire", "Preț", "Altceva"], ["0001", "0012345678905", "Apă", "12", "x"], ["", "", "", "", ""], ["0002.0", "77", '"a ""b"""', "abc", "x"]]
    path = tmp_path / "file.csv"
    path.write_bytes(b"\xef\xbb\xbf" + end.join(sep.join(row) for row in lines).encode())
    typed = D.type_import_lines(D.map_headers(D.read_identifier_csv(spark, str(path))))
    rows = {r["row_number"]: r for r in typed.collect()}
    assert set(rows) == {2, 4} and rows[2]["sku"] == "0001" and rows[2]["barcode"] == "0012345678905" and rows[2]["name"] == "Apă" and rows[2]["price"] == 12.0
    assert rows[4]["sku"] == "0002" and rows[4]["name"] == 'a "b"' and rows[4]["error"] == "invalid value for price" and rows[4]["raw"]["price"] == "abc"


def test_header_rules(frame):
    with pytest.raises(ValueError):
        D.map_headers(frame("Denumire string", []))
    with pytest.raises(ValueError):
        D.map_headers(frame("SKU string, `cod produs` string", []))
    assert D.map_headers(frame("` COD  de   Bare ` string, `Preț` string, x string", [])).columns == ["barcode", "price"]


def test_file_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sku;ean\n")
    with pytest.raises(ValueError):
        D.read_identifier_csv(spark, str(tmp_path / "a.csv"))


def test_export_has_mark_and_alias_rows(frame, tmp_path):
    products = frame("id string, sku string, barcode string, name string, category_id string, price decimal(12,2)", [("a", "001", "b1", "Apă", "/r/n/", 2.5)])
    categories = frame("id string, parent_id string, name string", [("/r/", None, "Root"), ("/r/n/", "/r/", "Node")])
    S.export_catalog(products, categories, frame("barcode string, product_id string", [("b1", "a"), ("b2", "a")]), str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("*.csv"))).decode()
    assert text.startswith("﻿SKU,Cod de bare,Denumire,Categorie,Subcategorie,Brand")
    assert "001,b1,Apă,Root,Node,,,2.5" in text and "001,b2,Apă,Root,Node,,,2.5" in text and text.count("001,") == 2


def test_history_and_tables(spark, frame, tmp_path):
    for n in (1, 2):
        S.append_history(frame("file_name string, rows_read long", [("f", n)]), str(tmp_path / "import_history"))
    table = read_catalog(spark, str(tmp_path), ["import_history"])["import_history"]
    assert sorted(r["rows_read"] for r in table.collect()) == [1, 2] and "rows_conflict" in table.columns


def response(**changes):
    products = [{"product_id": "1", "name": " A ", "url": "/p/1", "price": "15,99 lei", "brand": None, "category": "c", "img": "", "cart_available": True}]
    meta = {"query": "q", "offset": 0, "limit": 16, "returned": 1, "total": 1, "has_more": False, "next_offset": None}
    body = {"products": products, "brands": [], "categories": [], "settings": {"need_auth": False, "show_prices": True}, "meta": meta}
    for key, value in changes.items():
        owner = meta if key in meta else products[0] if key in products[0] or key == "list_price" else body
        owner[key] = value
    return json.dumps({"success": body, "notifications": changes.get("notes", {})})


@pytest.mark.parametrize(
    "changes,error",
    [({}, None), ({"query": "z"}, "echo_differs"), ({"offset": 1.0}, "number_malformed"), ({"total": -1}, "number_malformed"), ({"returned": 2}, "count_differs"),
     ({"has_more": True}, "more_flag_differs"), ({"next_offset": 5}, "offset_after_last"), ({"brands": None}, "brands_absent"),
     ({"settings": {"need_auth": True}}, "login_asked"), ({"products": {}}, "products_or_meta_absent"), ({"price": ""}, "price_absent"),
     ({"notes": {"n": {"type": "E"}}}, "notice_of_error")],
)
def test_envelope(frame, changes, error):
    got = J.envelope(frame("response string, query string, offset int, limit int", [(response(**changes), "q", 0, 16)])).first()["errors"]
    assert (error in got) if error else got == []


def test_bad_envelopes(frame):
    rows = [("not json", "q", 0, 16), ('{"failure":1}', "q", 0, 16), (None, "q", 0, 16)]
    assert all("envelope_absent" in r["errors"] for r in J.envelope(frame("response string, query string, offset int, limit int", rows)).collect())


@pytest.mark.parametrize(
    "changes,error",
    [({}, None), ({"product_id": 1}, "missing product id"), ({"product_id": "1a"}, "missing product id"), ({"name": "  "}, "missing product name"), ({"url": ""}, "missing product url"),
     ({"brand": 5}, "invalid product field brand"), ({"cart_available": "yes"}, "invalid cart availability"), ({"url": "https://other.example/"}, "invalid source url"),
     ({"img": "http://x/"}, "invalid image url"), ({"price": 15.99}, "invalid monetary type"), ({"list_price": "abc"}, "invalid list_price")],
)
def test_product_errors(frame, changes, error):
    row = J.search_products(frame("response string, query string, offset int, limit int", [(response(**changes), "q", 0, 16)]), "shop.example").first()
    assert (error in row["errors"]) if error else (row["errors"] == [] and row["name"] == "A" and row["product_url"] == "https://shop.example/p/1")


def card(inside, sid="7", title="Prune 500 g"):
    return f'<div class="ut2-gl__item"><a class="product-title" href="/p/{sid}">{title}</a><input name="product_data[{sid}][product_id]" value="{sid}">{inside}</div>'


def price(whole, cents, sid="7", kind="discounted"):
    return f'<span id="sec_{kind}_price_{sid}">{whole}<sup>{cents}</sup> lei</span>'


def parse(frame, html):
    read = E.read_listing(frame("page_id int, url string, html string", [(1, "https://shop.example/l/", html)]), SHOP)
    cards = E.extract_cards(read, SHOP)
    return cards.collect(), E.page_states(read, cards).first()


def test_listing_cards(frame):
    loose = '<div class="wp-product-pricing" data-wp-price-kg="3.99" data-wp-price-step="3.99" data-wp-step-g="1000"></div><b class="wp-old-price-unit">per kg</b>'
    cards, state = parse(frame, card(price(12, 49) + price(15, "00", kind="list")) + card(loose + price(3, 99, 8) + price(4, 99, 8, "list"), "8", "Vrac")
                         + card("<p class='ty-age-verification__block'></p>", "9"))
    assert [float(c["price"]) for c in cards] == [12.49, 3.99] and [float(c["discount_percent"]) for c in cards] == [16.73, 20.04]
    assert [c["quantity"] for c in cards] == ["500 g", "1 kg"] and [c["promotion_state"] for c in cards] == ["observed"] * 2
    assert (state["cards"], state["restricted_cards"], state["refused"]) == (3, 1, None)


@pytest.mark.parametrize(
    "html,why",
    [("<p>maintenance</p>", "product list not recognized"), (card(price("abc", "")), "invalid price markup"), ('<div class="ut2-gl__item"></div>', "unrecognized product card"),
     (card("<i class='wp-step-label'></i>" + price(1, 99)), "weighted price metadata missing"), ("<p class='ty-no-items'></p>", None), ("<p class='ty-age-verification__txt'></p>", None)],
)
def test_refused_pages(frame, html, why):
    assert parse(frame, html)[1]["refused"] == why


def test_page_chain_states(frame):
    pages = frame("url string, next_url string", [(f"a{n}", f"a{n + 1}" if n < 150 else None) for n in range(151)] + [("b0", "b1"), ("b1", "b2"), ("b2", "b1"), ("c0", "c1")])
    got = {}
    for r in E.page_chain(pages, frame("scope string, url string", [("a", "a0"), ("b", "b0"), ("c", "c0")])).collect():
        got.setdefault((r["scope"], r["state"]), {})[r["position"]] = r["url"]
    assert got["a", "complete"] == {n + 1: f"a{n}" for n in range(151)}
    assert got["b", "loop"] == {1: "b0", 2: "b1", 3: "b2"} and got["c", "missing page"] == {1: "c0"}


def test_two_next_links_of_one_page_are_reported(frame):
    pages = frame("url string, next_url string", [("u1", "u2"), ("u1", "u3"), ("u2", None), ("u3", None), ("v1", "v2"), ("v1", "v2"), ("v2", None), ("w1", None), ("w1", "v2")])
    chain = E.page_chain(pages, frame("scope string, url string", [("u", "u1"), ("v", "v1"), ("w", "w1")])).collect()
    assert {r.scope: r.state for r in chain} == {"u": "contradiction", "v": "complete", "w": "contradiction"}
    assert sorted(r.url for r in chain if r.scope == "v") == ["v1", "v2"]


def test_category_tree(frame):
    html = ('<div class="ab-lc-group"><div class="head"><a href="/r/">R</a></div><ul><li><a href="/r/a/">A</a><ul><li><a href="/r/a/b/">B</a></li>'
            '<li><a href="/x/">X</a></li></ul></li><li><a href="/x/">X</a></li></ul></div>')
    got = {r["id"]: (r["parent_id"], r["level"], r["sort_order"], r["error"]) for r in E.extract_categories(frame("page_id int, html string", [(1, html)]), SHOP).collect()}
    assert got == {"/r/": (None, 0, 0, None), "/r/a/": ("/r/", 1, 1, None), "/r/a/b/": ("/r/a/", 2, 2, None), "/x/": ("/r/a/", 2, 3, "conflicting parents")}


def change_rows():
    return [(v, ["product", "category"][v % 2], str(v % 7), f'{{"n":{v}}}') for v in range(1, 61)]


def image(df):
    return sorted((r["kind"], r["entity_id"], r["version"]) for r in df.collect())


def test_streamed_replica_survives_replay(spark, frame, tmp_path):
    rows, log = change_rows(), str(tmp_path / "log")
    want = image(snapshot(frame(CHANGES, rows)))
    run = lambda: W.stream_replica(read_changes(spark, log, True, 1), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    for part in (rows[:20], rows[20:40], rows[10:30], rows[40:], rows[:60]):
        frame(CHANGES, part).coalesce(1).write.mode("append").parquet(log)
        run()
    assert image(W.read_replica(spark, str(tmp_path / "out"))) == want
    W.compact_replica(spark, str(tmp_path / "out"))
    assert image(W.read_replica(spark, str(tmp_path / "out"))) == want


def test_streamed_absences_equal_batch(spark, frame, tmp_path):
    from pricetrail.operators.observations import absence_streak

    seen = [("a", 1), ("a", 4), ("b", 2), ("c", 5)]
    scope = frame("id string", [("a",), ("b",), ("c",), ("d",)])
    for n, row in enumerate(seen):
        frame("id string, run int", [row]).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("id string, run int").parquet(str(tmp_path / "in"))
    W.stream_last_seen(live, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = sorted(tuple(r) for r in W.absence_counters(spark, str(tmp_path / "out"), scope, 5).collect())
    batch = absence_streak(frame("id string, run int", seen), scope, 5).filter("run = 5").drop("run")
    assert got == sorted(tuple(r) for r in batch.collect())


def test_hot_keys_are_split(spark, frame):
    """Adaptive execution splits a hot key, and the rows are the plain join's."""
    from pricetrail.operators import joins

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), F.col("id").alias("n"))
    table = rows.filter("k IS NOT NULL").groupBy("k").agg(F.max(F.length("k")).alias("v"))
    want = rows.join(table, "k", "left").agg(F.count("*"), F.sum("v"), F.count("v")).first()
    assert joins.spread_lookup(rows, table, ["k"], "n").agg(F.count("*"), F.sum("v"), F.count("v")).first() == want
    assert joins.spread_lookup(rows, table, ["k"], "n", "left_semi").count() == 20_000
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        joined = joins.spread_lookup(rows.repartition(8), table, ["k"], "n")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
