"""Reviewed links: every outcome, and how often their tables are read."""

from pricetrail.operators.identifiers import associate

PAIR, PRODUCT, LINK = "id string, sku string, barcode string", "id string, sku string, barcode string", "identifier_id string, product_id string"
PAIRS = [("k1", "S1", "1"), ("k2", "S2", "2"), ("k3", "S3", "3"), ("k4", "S4", "4"), ("k5", "S5", "5"), ("k6", "", "6"), ("k7", "S7", "7"), ("k8", "S8", "8"), ("k9", "S9", "9")]
PRODUCTS = [("p1", None, None), ("p2", "S2", None), ("p3", "X", None), ("p4", None, None), ("holder", "S4", None), ("p5", None, None), ("p6", None, None),
            ("p7", None, None), ("p8", None, None), ("unasked", "Z", "9")]
LINKS = {("k1", "p1"): "matched", ("k2", "p2"): "matched", ("k3", "p3"): "conflict", ("k4", "p4"): "conflict", ("k5", "gone"): "unknown", ("none", "p5"): "unknown",
         ("k6", "p6"): "invalid", ("k7", "p7"): "conflict", ("k8", "p7"): "conflict", ("k9", "p8"): "conflict"}


def test_every_outcome(frame):
    got = associate(frame(LINK, list(LINKS)), frame(PAIR, PAIRS), frame(PRODUCT, PRODUCTS)).collect()
    assert {(r["identifier_id"], r["product_id"]): r["outcome"] for r in got} == LINKS and len(got) == len(LINKS)


def test_one_pair_for_two_products(frame):
    asked = [("k1", "p1"), ("k1", "p5"), ("k2", "p6")]
    got = associate(frame(LINK, asked), frame(PAIR, PAIRS), frame(PRODUCT, PRODUCTS[:1] + PRODUCTS[5:])).collect()
    assert sorted((r["product_id"], r["outcome"]) for r in got) == [("p1", "conflict"), ("p5", "conflict"), ("p6", "matched")]


def test_links_and_pairs_are_put_together_once(spark, frame, tmp_path):
    for name, ddl, rows in (("links", LINK, list(LINKS)), ("pairs", PAIR, PAIRS)):
        frame(ddl, rows).write.parquet(str(tmp_path / name))
    out = associate(spark.read.parquet(str(tmp_path / "links")), spark.read.parquet(str(tmp_path / "pairs")), frame(PRODUCT, PRODUCTS))
    assert not [f for f in out.inputFiles() if f.startswith(tmp_path.as_uri())]  # what is left to do reads the stored rows
