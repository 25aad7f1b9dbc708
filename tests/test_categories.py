"""Categories by URL and by names: every folder and every pair of names is looked up once."""

import re

from pyspark.sql import functions as F

from pricetrail.operators import categories as K

TREE = [("r", None, "Food", "https://s/a/"), ("n", "r", "Milk", "https://s/a/b/"), ("x", None, "Odd", "https://s/a/odd"), ("y", None, "Odd", "https://s/q/")]
NODE = "id string, parent_id string, name string, source_url string"


def exploded_once(df, key):
    return re.search(rf"Generate explode.*\n[^\n]*(Project[^\n]*\n[^\n]*)?Aggregate \[[^\]]*{key}", df._jdf.queryExecution().optimizedPlan().toString())


def test_longest_prefix(frame):
    urls = ["https://s/a/b/1.html", "https://s/a/b/2.html", "https://s/a/odd", "https://s/a/odder", "https://s/a/b/", "https://t/", "none", None]
    rows = K.category_for(frame("id long, url string", list(enumerate(urls))), frame(NODE, TREE), "id", "url", F.lit("-"))
    assert [r.category_id for r in rows.orderBy("id").collect()] == ["n", "n", "x", "r", "n", "-", "-", "-"] and rows.columns == ["id", "url", "category_id"]
    assert exploded_once(rows, "_folder")


def test_names(frame):
    names = [("Food", "Milk"), ("Food", "Milk"), ("Food", None), ("Food", "Bread"), ("Food", ""), ("Odd", None), (None, "Milk"), (None, None)]
    rows = K.resolve_category_path(frame("id long, c string, s string", [(i, *n) for i, n in enumerate(names)]), frame(NODE, TREE), "id", "c", "s")
    want = [("n", False), ("n", False), ("r", False), ("r", True), ("r", True), (None, True), (None, False), (None, False)]
    assert [(r.category_id, r.needs_review) for r in rows.orderBy("id").collect()] == want
    assert exploded_once(rows, "_names")
