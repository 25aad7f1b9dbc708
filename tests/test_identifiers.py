import random

from pyspark.sql import functions as F

from pricetrail.operators import identifiers as D
from pricetrail.operators import identity as I
from pricetrail.operators import replica as P

PRODUCT = "id string, source_product_id string, sku string, barcode string"
PENDING = "id string, sku string, barcode string, status string, product_id string"


def key(sku, barcode):
    return f"{sku}|{barcode}"


def stored(frame, rows):
    df = frame("sku string, barcode string, status string, product_id string", rows)
    return df.withColumn("id", D.pair_key(F.col("sku"), F.col("barcode"))).select("id", "sku", "barcode", "status", "product_id")


def random_pairs(rng):
    """Distinct and repeated pairs over few codes, so that some SKUs have several barcodes and the other way round."""
    pairs = [(f"s{rng.randrange(25)}", f"b{rng.randrange(25)}") for _ in range(20)] + [(f"t{n}", f"d{n}") for n in range(8)]
    return pairs + rng.choices(pairs, k=6)


def file_rows(frame, pairs):
    return frame("row_number long, sku string, barcode string, error string", [(n, s, b, None) for n, (s, b) in enumerate(pairs)])


def test_new_pairs_follow_the_definition(frame):
    """Into an empty store: ambiguous pairs need review; a pair whose SKU's only product has no other barcode, and whose barcode no other
    product has, is matched; a pair of which a product has either value is otherwise for review; the rest is pending."""
    rng = random.Random(7)
    for _ in range(4):
        pairs = random_pairs(rng)
        products = [(f"p{n}", str(n), f"t{n}" if n != 5 else "t4", f"d{n}" if n % 3 == 0 else f"x{n}" if n % 3 == 1 else None) for n in range(7)]
        partners = {v: {q for q in set(pairs) if v in q} for p in pairs for v in p}
        held = {v: {p[0] for p in products if v in p[2:]} for pair in pairs for v in pair}
        codes = {p[0]: p[3] for p in products}

        def status(pair):
            sku, barcode = pair
            if len(partners[sku]) > 1 or len(partners[barcode]) > 1:
                return "needsReview"
            if not held[sku] | held[barcode]:
                return "pending"
            one = len(held[sku]) == 1 and held[barcode] <= held[sku] and codes[min(held[sku])] in (None, barcode)
            return "matched" if one else "needsReview"

        result = D.import_identifiers(file_rows(frame, pairs), frame(PENDING, []), frame(PRODUCT, products))
        assert {(r["sku"], r["barcode"]): r["status"] for r in result.collect()} == {p: status(p) for p in set(pairs)}


def test_import_does_not_depend_on_row_order(frame):
    rng = random.Random(3)
    pairs, products = random_pairs(rng), frame(PRODUCT, [(f"p{n}", str(n), f"s{n}", None) for n in range(12)])
    pending = stored(frame, [("s1", "b1", "pending", None), ("s2", "b9", "needsReview", None), ("s3", "b3", "matched", "p3")])
    seen = []
    for _ in range(3):
        rng.shuffle(pairs)
        result = D.import_identifiers(file_rows(frame, pairs), pending, products)
        report = {k: v for k, v in D.import_report(result).first().asDict().items()}
        seen.append((sorted((r["sku"], r["barcode"], r["status"], r["product_id"] or "") for r in result.collect()), report))
        assert report["read"] == len(pairs) and report["valid"] == len(pairs)
    assert seen[0] == seen[1] == seen[2]


def test_second_import_changes_nothing(frame):
    pairs, products = random_pairs(random.Random(5)), frame(PRODUCT, [])
    first = D.import_identifiers(file_rows(frame, pairs), frame(PENDING, []), products)
    kept = first.select("id", "sku", "barcode", "status", "product_id")
    again = D.import_identifiers(file_rows(frame, pairs), kept, products)
    assert sorted(map(tuple, again.select(*kept.columns).collect()), key=repr) == sorted(map(tuple, kept.collect()), key=repr)
    assert D.import_report(again).first()["duplicate"] == len(pairs)


def test_invalid_rows_of_two_files_are_two_rows(frame):
    ddl = "file string, row_number long, sku string, barcode string, error string"
    rows = frame(ddl, [("a.csv", 5, None, None, "empty"), ("b.csv", 5, None, None, "empty")])
    result = D.import_identifiers(rows, frame(PENDING, []), frame(PRODUCT, []))
    assert len({r["id"] for r in result.collect()}) == 2 and D.import_report(result).first()["duplicate"] == 0


def test_repeated_file_is_all_duplicates(spark, frame):
    """Anchor: a file of 1559 rows with 175 ambiguous ones; the second import finds only duplicates."""
    pairs = [(f"k{n}", f"c{n}") for n in range(1384)] + [("same", f"d{n}") for n in range(100)] + [(f"e{n}", "one") for n in range(75)]
    rows = frame("row_number long, sku string, barcode string, error string", [(n, s, b, None) for n, (s, b) in enumerate(pairs)])
    nothing = frame(PRODUCT, [])
    first = D.import_identifiers(rows, frame(PENDING, []), nothing)
    report = D.import_report(first).first()
    assert (report["read"], report["pending"], report["conflicts"], report["duplicate"]) == (1559, 1384, 175, 0)
    again = D.import_identifiers(rows, first.select("id", "sku", "barcode", "status", "product_id"), nothing)
    assert D.import_report(again).first()["duplicate"] == 1559


def test_source_id_equal_to_sku_does_not_match(frame):
    rows = frame("row_number long, sku string, barcode string, error string", [(1, "777", "b", None)])
    got = D.import_identifiers(rows, frame(PENDING, []), frame(PRODUCT, [("p", "777", None, None)])).first()
    assert got["status"] == "pending"


def test_reconcile_either_order(frame, dicts):
    products = frame(PRODUCT, [("p1", "1", "s1", None), ("p2", "2", "s2", "b9"), ("p3", "3", "s3", "b3"), ("p4", "", "s4", None), ("p5", "5", "s5", None), ("p6", "6", "s5", None)])
    pending = stored(frame, [("s1", "b1", "pending", None), ("s2", "b2", "pending", None), ("s3", "b3", "pending", None), ("s9", "b7", "pending", None),
                             ("s4", "b4", "pending", None), ("s5", "b5", "pending", None)])
    got = {r["sku"]: (r["status"], r["product_id"], r["attaches_barcode"]) for r in D.reconcile(pending, products).collect()}
    assert got["s1"] == ("matched", "p1", True) and got["s2"] == ("needsReview", None, False)
    assert got["s3"] == ("matched", "p3", False) and got["s9"] == ("pending", None, False) and got["s4"][0] == "matched"
    local = {r["sku"]: r["status"] for r in D.replica_reconcile(pending, products, frame("barcode string, product_id string", [("b1", "p2")])).collect()}
    assert local == {"s1": "needsReview", "s2": "needsReview", "s3": "matched", "s9": "pending", "s4": "pending", "s5": "needsReview"}


def test_identity_conflict_flags_every_product(frame, dicts):
    ddl = PRODUCT + ", product_url string"
    products = frame(ddl, [("a", "1", "s1", "b1", "u1"), ("b", "2", "s2", "b2", "u2"), ("c", "3", None, None, None)])
    aliases = frame("barcode string, product_id string", [("x", "c")])
    rows = frame("line string, " + ddl, [("r1", "n", "1", "s1", None, None), ("r2", "n", "1", "s2", None, None), ("r3", "n", None, "s9", "zz", None), ("r4", "n", None, None, "x", None)])
    got = dicts(I.resolve_identity(rows, "line", products, aliases), "line")
    assert {k: (v["match"], v["product_id"]) for k, v in got.items()} == {
        "r1": ("update", "a"), "r2": ("conflict", None), "r3": ("new", None), "r4": ("update", "c")}
    bad = I.contested_products(rows.filter("line = 'r2'"), "line", products, aliases)
    assert sorted(r["id"] for r in bad.collect()) == ["a", "b"]


def test_replica_upsert(frame, dicts):
    state = frame(PRODUCT + ", name string, needs_review boolean", [("a", "1", "s1", "b1", "A", False), ("b", "2", "s2", None, "B", False), ("c", "3", "s3", None, "C", False)])
    aliases = frame("barcode string, product_id string", [("b1", "a")])
    batch = frame(PRODUCT + ", name string", [("x1", "1", None, "b9", "A+"), ("x2", "2", "s3", None, "?"), ("x3", "9", None, "n1", None), ("c", None, None, None, "C")])
    out = P.replica_upsert(state, aliases, batch, online=False)
    got = dicts(out["products"], "id")
    assert {k: v["outcome"] for k, v in got.items()} == {"a": "updated", "b": "conflict", "c": "updated", "x3": "added"}
    assert got["c"]["needs_review"] and not got["a"]["needs_review"]
    assert got["a"]["barcode"] == "b1" and got["a"]["name"] == "A+" and got["b"]["needs_review"] and got["x3"]["needs_review"]
    assert sorted(tuple(r) for r in out["aliases"].collect()) == [("b9", "a"), ("n1", "x3")]
    online = dicts(P.replica_upsert(state, aliases, frame(PRODUCT + ", name string", [("a", "1", "s1", "b9", "A"), ("b", "2", None, None, "B")]), True)["products"], "id")
    assert online["a"]["outcome"] == "untouched" and online["b"]["outcome"] == "unchanged"


def test_general_product_import(frame, dicts):
    products = frame(PRODUCT + ", name string", [("a", "1", "s1", "b1", "A"), ("b", "2", "s2", None, "B")])
    categories = frame("id string, parent_id string, name string", [("/f/", None, "Food"), ("/f/x/", "/f/", "Fish"), ("/f/y/", "/f/", "Twin"), ("/f/z/", "/f/", "Twin")])
    ddl = "row_number long, sku string, barcode string, name string, category_name string, subcategory_name string, error string"
    lines = frame(ddl, [(2, "s1", "b1", "A", None, None, None), (3, "s1", None, "A2", "Food", "Fish", None), (4, "s7", "b7", None, None, None, None),
                        (5, "s8", "b8", "New", "Food", "Twin", None), (6, "s2", "b1", "B", None, None, None), (7, "s9", "b9", "x", "Nowhere", None, None),
                        (8, "s9", "c9", "x", None, None, None), (9, None, None, None, None, None, "bad"), (10, "s7", "b7", None, None, None, None)])
    got = dicts(P.import_products(lines, frame(PENDING, []), products, frame("barcode string, product_id string", []), categories), "row_number")
    assert {k: v["outcome"] for k, v in got.items()} == {2: "conflict", 3: "updated", 4: "pending", 5: "added", 6: "conflict", 7: "conflict",
                                                        8: "conflict", 9: "invalid", 10: "duplicate"}
    assert got[3]["category_id"] == "/f/x/" and got[5]["category_id"] == "/f/" and got[5]["needs_review"] and not got[3]["needs_review"]


def test_merge(frame, dicts):
    ddl = PRODUCT + ", name string, brand string, quantity string, category_id string, product_url string, thumbnail_url string, needs_review boolean"
    products = frame(ddl, [("src", None, "s", "b", "S", "Br", None, None, None, None, True), ("dst", "1", None, None, "D", None, "1 l", "/c/", "u", None, True),
                           ("oth", "2", "other", None, "O", None, None, None, None, None, False)])
    asked = frame("source_id string, target_id string", [("src", "dst"), ("src", "oth"), ("dst", "dst"), ("src", "gone")])
    checked = {r["target_id"]: r["refused"] for r in D.checked_merges(asked.filter("source_id = 'src'"), products).collect()}
    assert checked == {"dst": None, "oth": "different skus", "gone": "unknown product"}
    merged = dicts(D.merge_products(frame("source_id string, target_id string", [("src", "dst")]), products), "id")
    assert set(merged) == {"dst", "oth"} and merged["dst"]["sku"] == "s" and merged["dst"]["name"] == "D" and not merged["dst"]["needs_review"]


def test_identifier_events(frame, dicts):
    pending = frame(PENDING, [("1", "s1", "b1", "pending", None), ("2", None, None, "invalid", None), ("3", "s3", "b3", "needsReview", None)])
    events = frame("sku string, barcode string, status string, product_id string",
                   [("s1", "b1", "matched", "p"), (None, None, "invalid", None), ("s3", "b3", "needsReview", None), ("s4", None, "pending", None)])
    got = {(r["sku"], r["barcode"]): (r["status"], r["outcome"]) for r in D.apply_identifier_events(pending, events).collect()}
    assert got == {("s1", "b1"): ("matched", "updated"), (None, None): ("invalid", "kept"), ("s3", "b3"): ("needsReview", "kept"), ("s4", None): ("pending", "added")}


def test_whole_product_import(frame, dicts):
    state = frame(PRODUCT + ", name string, price decimal(12,2), category_id string, needs_review boolean",
                  [("a", "1", "s1", "b1", "A", 2, None, False), ("b", "2", "s2", None, "B", None, None, False), ("c", "3", "s3", "b3", "C", 1, None, False)])
    categories = frame("id string, parent_id string, name string", [("/f/", None, "Food")])
    ddl = "row_number long, sku string, barcode string, name string, price decimal(12,2), category_name string, subcategory_name string, error string"
    lines = frame(ddl, [
        (2, "s1", "b1", "A", "2.00", None, None, None),  # known, the same
        (3, "s2", "b2", "B2", 5, "Food", None, None),  # updates b and gives it a code
        (4, "n1", "m1", "New", 7, None, None, None), (5, "n1", "m1", "New", 7, None, None, None),  # added, and once more
        (6, "p1", "q1", None, None, None, None, None), (7, None, None, None, None, None, None, "bad"),
        (8, "s3", "b9", "C", 1, None, None, None),  # another code than the stored one
        (9, "s1", "b1", "A", "2.00", "Food", None, None)])
    out = P.import_catalog(lines, frame(PENDING, []), state, frame("barcode string, product_id string", []), categories, "f.csv", F.lit("2024-01-01").cast("timestamp"))
    got = {r.row_number: (r.outcome, r.product_id) for r in out["lines"].collect()}
    assert got == {2: ("duplicate", "a"), 3: ("updated", "b"), 4: ("added", "import:4"), 5: ("duplicate", None), 6: ("pending", None),
                   7: ("invalid", None), 8: ("conflict", "c"), 9: ("updated", "a")}
    products = dicts(out["products"], "id")
    assert products["b"]["name"] == "B2" and products["b"]["barcode"] == "b2" and products["b"]["category_id"] == "/f/"
    assert products["import:4"]["name"] == "New" and products["a"]["category_id"] == "/f/" and set(products) == {"a", "b", "c", "import:4"}
    stored = {(r.sku, r.barcode): (r.status, r.product_id) for r in out["identifiers"].collect()}
    assert stored == {("s1", "b1"): ("matched", "a"), ("s2", "b2"): ("matched", "b"), ("n1", "m1"): ("matched", "import:4"),
                      ("p1", "q1"): ("pending", None), ("s3", "b9"): ("needsReview", "c")}
    assert sorted(map(tuple, out["reviews"].collect())) == [(7, "bad"), (8, "contradictory identifiers")]
    history = out["history"].first().asDict()
    assert history["errors"] == '{"bad":1,"contradictory identifiers":1}' and history["file_name"] == "f.csv"
    counters = ("rows_read", "rows_valid", "rows_added", "rows_updated", "rows_failed", "rows_matched", "rows_pending", "rows_duplicate", "rows_conflict")
    assert [history[c] for c in counters] == [8, 7, 2, 2, 2, 4, 2, 2, 1]


def test_stored_pairs_and_the_file_are_asked_apart(frame, dicts):
    products, none = frame(PRODUCT + ", name string", []), frame("barcode string, product_id string", [])
    ddl = "row_number long, sku string, barcode string, name string, error string"
    stored = frame(PENDING, [("1", "s", "b", "pending", None), ("2", "s", "c", "pending", None), ("3", "t", "d", "invalid", None)])
    lines = frame(ddl, [(2, "s", None, "x", None), (3, "s", "b", "x", None), (4, "t", "e", "x", None)])
    got = dicts(P.import_products(lines, stored, products, none, frame("id string, parent_id string, name string", [])), "row_number")
    assert {k: v["outcome"] for k, v in got.items()} == {2: "added", 3: "conflict", 4: "added"}
