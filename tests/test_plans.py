"""What plans read, and the one-pass forms against the plain ones."""

import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pricetrail.operators import extraction as E
from pricetrail.operators import identifiers as D
from pricetrail.plans.markup import SHOP, _listing
from pricetrail.plans.registry import Source
from pricetrail.sources import search_json as J

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


def nodes(df, pattern):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(pattern, plan.split("== Initial Plan ==")[0]))


@given
@pytest.mark.parametrize("name", ["idr1_identifier_import", "agg3_import_report", "lim8_page_sets", "ext1_page_states"])
def test_scans(spark, name):
    df = queries()[name](spark, FOLDER)
    assert nodes(df, r"FileScan|Scan ExistingRDD") <= 8 and nodes(df, "MapInArrow|ArrowEvalPython|MapInPandas") <= 1


@given
def test_page_states_agree(spark):
    read = _listing(Source(spark, FOLDER))
    want = E.page_states(read, E.extract_cards(read, SHOP)).collect()
    assert sorted(map(tuple, E.listing_states(read, SHOP).collect())) == sorted(map(tuple, want)) and any(r["refused"] for r in want)


def response(query, offset, ids, total, more, returned=None):
    meta = {"query": query, "offset": offset, "limit": 2, "returned": len(ids) if returned is None else returned, "total": total, "has_more": more}
    products = [{"product_id": i, "name": "n", "url": "/p/1.html", "price": "1 lei"} for i in ids]
    return query, offset, 2, json.dumps({"success": {"products": products, "brands": [], "categories": [], "settings": {}, "meta": meta}, "notifications": {}})


def test_page_sets_agree(spark):
    rows = [
        response("whole", 0, ["1", "2"], 3, True), response("whole", 2, ["3"], 3, False),
        response("twice", 0, ["1", "2"], 4, True), response("twice", 2, ["2", "4"], 4, False),
        response("again", 0, ["1", "2"], 4, True), response("again", 0, ["3", "4"], 4, False),
        response("totals", 0, ["1", "2"], 3, True), response("totals", 2, ["3"], 4, False),
        response("huge", 0, ["1", "2"], 30_000, True), response("none", 0, [], 0, False), response("short", 0, ["1"], 2, False),
        ("broken", 0, 2, "{"), ("null", 0, 2, None),
    ]
    responses = spark.createDataFrame(rows, "query string, offset bigint, limit bigint, response string")
    pages = J.envelope(responses)
    want = J.validate_pages(pages, J.search_products(responses, "shop.example")).collect()
    got = J.page_sets(pages).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    errors = {r["query"]: r["errors"] for r in got}
    assert errors["whole"] == [] and errors["twice"] == ["repeated page or duplicate product id"] and "offset_not_advanced" in errors["again"]
    assert J.page_sets(pages.limit(0)).collect() == []


def test_pair_keys_are_those_of_ascii_json(spark):
    pairs = [("A-1", "594"), ("măr", "ș\"\\/"), ("日本", "𝒳é"), ("\x7f", "~")]
    rows = spark.createDataFrame(pairs, "sku string, barcode string").select("*", D.pair_key(F.col("sku"), F.col("barcode")).alias("id")).collect()
    assert [r["id"] for r in rows] == [hashlib.sha256(json.dumps(list(p)).encode()).hexdigest() for p in pairs]


def test_invalid_rows_count_one_by_one(spark, frame):
    ddl = "file string, row_number long, sku string, barcode string, error string"
    bad = ("f", 3, "x", None, "empty identifier")
    rows = frame(ddl, [("f", 1, "s", "b", None), ("f", 2, "s", "b", None), bad, bad, ("g", *bad[1:])])
    pending = frame("id string, sku string, barcode string, status string, product_id string", [])
    products = frame("id string, sku string, barcode string, source_product_id string", [])
    got = D.import_identifiers(rows, pending, products).collect()
    invalid = [r for r in got if r["status"] == "invalid"]
    assert [r["copies"] for r in invalid] == [1, 1, 1] and len({r["id"] for r in invalid}) == 2 and all(r["sku"] is None for r in invalid)
    assert [(r["status"], r["copies"], r["row_number"]) for r in got if r["status"] != "invalid"] == [("pending", 2, 1)]
    assert D.import_report(D.import_identifiers(rows, pending, products)).first()["read"] == 5
