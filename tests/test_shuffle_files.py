"""What is stored leaves no shuffle files, and a lookup of several identifiers shuffles rows and matches once at the end."""

import re

from pyspark.sql import functions as F

from pricetrail.operators import identity as I
from pricetrail.session import CLEANUP, stored


def _shuffled(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in re.findall(r"shuffle_(\d+)_", manager.getAllFiles().mkString(" "))}


def test_stored_rows_leave_no_shuffle_files(spark):
    before, setting = _shuffled(spark), spark.conf.get(CLEANUP, None)
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("id").alias("n")))
    assert _shuffled(spark) <= before and spark.conf.get(CLEANUP, None) == setting
    assert sorted(r["n"] for r in rows.collect()) == [142] + [143] * 6


def test_matches_of_each_identifier_are_stored(frame, dicts):
    ddl = "n long, sku string, barcode string, id string"
    rows = frame(ddl, [(1, "s1", None, "x"), (2, "s1", "b2", "x"), (3, None, "b9", "p1"), (None, "s1", None, "x"), (4, "zz", None, None), (5, "s1", "b1", "p1")])
    products = frame("id string, sku string, barcode string", [("p1", "s1", "b1"), ("p2", None, "b2"), (None, "zz", None)])
    aliases = frame("barcode string, product_id string", [("b9", "p1"), ("b9", "p1")])
    found = I.resolve_identity(rows, "n", products, aliases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= 2  # the lookups are done
    got = {r["n"]: (r["match"], r["product_id"]) for r in found.collect()}
    assert got == {1: ("update", "p1"), 2: ("conflict", None), 3: ("update", "p1"), None: ("new", None), 4: ("new", None), 5: ("update", "p1")}
    assert dicts(I.contested_products(found.filter("match = 'conflict'"), "n", products, aliases)) == [{"id": "p1"}, {"id": "p2"}]
