"""The steps of a product import leave no shuffle files, and of what they store only what is still read."""

import os
import re

import pytest
from pyspark.sql import functions as F

from pricetrail.operators import replica as P
from pricetrail.session import shared_dir

PRODUCTS = [("p1", None, "s1", "b1", "one", False), ("p2", None, None, "b2", "two", False), ("p3", None, "s3", None, "three", False)]
LINES = [
    (1, "s1", "b1", "one", None, None, None), (2, "s1", "b1", "new name", None, None, None), (3, "n1", "c1", "fresh", "Food", None, None),
    (4, "n1", "c1", "fresh", "Food", None, None), (5, "n2", "c2", None, None, None, None), (6, None, None, None, None, None, "no code"),
    (7, "s3", None, "three", "Food", None, None), (7, "n3", "c3", "other", "Odd", None, None), (None, "n4", "c4", "nameless", None, None, None),
    (9, "n5", "c5", "a", None, None, None), (10, "n5", "c6", "b", None, None, None)]


def _left(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shared = shared_dir(spark).removeprefix("file://")
    return set(re.findall(r"shuffle_(\d+)_", manager.getAllFiles().mkString(" "))), {x for x in os.listdir(shared) if x.startswith("stored-")}


@pytest.fixture
def given(frame):
    return (
        frame("row_number long, sku string, barcode string, name string, category_name string, subcategory_name string, error string", LINES),
        frame("sku string, barcode string, status string, product_id string", [("n2", "c2", "pending", None), ("s9", "b9", "pending", None)]),
        frame("id string, source_product_id string, sku string, barcode string, name string, needs_review boolean", PRODUCTS),
        frame("barcode string, product_id string", [("b7", "p1"), ("b7", "p1")]),
        frame("id string, parent_id string, name string", [("f", None, "Food")]))


def test_decisions(spark, given):
    shuffles, folders = _left(spark)
    found = P.import_products(*given)
    left = _left(spark)
    assert left[0] <= shuffles
    assert len(left[1] - folders) == 2  # facts of pairs, and names of categories
    got = sorted((r["row_number"] or 0, r["outcome"], r["product_id"], r["category_id"], r["needs_review"]) for r in found.collect())
    assert got == [
        (0, "duplicate", None, None, False), (1, "duplicate", "p1", None, False), (2, "updated", "p1", None, False), (3, "added", None, "f", False),
        (4, "duplicate", None, "f", False), (5, "duplicate", None, None, False), (6, "invalid", None, None, False), (7, "added", None, None, True),
        (7, "updated", "p3", "f", False), (9, "conflict", None, None, False), (10, "conflict", None, None, False)]


def test_lines(spark, given):
    shuffles, _ = _left(spark)
    done = P.import_catalog(*given, "file", F.lit("2001-01-01").cast("timestamp"))
    assert _left(spark)[0] <= shuffles
    rows = sorted((r["row_number"] or 0, r["outcome"], r["product_id"] or "") for r in done["lines"].collect() if r["row_number"] != 7)
    assert rows == [(0, "duplicate", ""), (1, "duplicate", "p1"), (2, "updated", "p1"), (3, "added", "import:3"), (4, "duplicate", ""), (5, "duplicate", ""),
                    (6, "invalid", ""), (9, "conflict", ""), (10, "conflict", "")]
    assert done["lines"].filter("row_number = 7").count() > 2  # a repeated number meets every text of its number


def test_identifiers(spark, given):
    lines = given[0].filter("row_number IS NOT NULL AND row_number <> 7")
    shuffles, _ = _left(spark)
    done = P.import_catalog(lines, *given[1:], "file", F.lit("2001-01-01").cast("timestamp"))
    assert _left(spark)[0] <= shuffles
    got = sorted((r["sku"], r["barcode"], r["status"], r["product_id"]) for r in done["identifiers"].collect())
    assert got == [("n1", "c1", "matched", "import:3"), ("n2", "c2", "pending", None), ("n5", "c5", "needsReview", None), ("n5", "c6", "needsReview", None),
                   ("s1", "b1", "matched", "p1")]


def test_history(spark, given):
    lines = given[0].filter("row_number IS NOT NULL AND row_number <> 7")
    shuffles, _ = _left(spark)
    done = P.import_catalog(lines, *given[1:], "file", F.lit("2001-01-01").cast("timestamp"))
    assert _left(spark)[0] <= shuffles
    row = done["history"].drop("imported_at").first().asDict()
    assert row.pop("errors") == '{"contradictory identifiers":2,"no code":1}'
    assert row == {"rows_read": 8, "rows_valid": 7, "rows_added": 1, "rows_updated": 1, "rows_failed": 3, "rows_matched": 3, "rows_pending": 2,
                   "rows_duplicate": 3, "rows_conflict": 2, "file_name": "file"}
