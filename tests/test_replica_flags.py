"""What a replica upsert does only when it is asked for, and aliases that repeat."""

from pyspark.sql import functions as F

from pricetrail.operators import replica

STATE = "id string, source_product_id string, sku string, barcode string, name string, needs_review boolean"
BATCH = "id string, source_product_id string, sku string, barcode string, name string"


def test_flags_are_not_looked_for_when_only_codes_are_asked(frame, monkeypatch):
    state = frame(STATE, [("p1", "1", "S1", "10", "a", False), ("p2", "2", "S2", "20", "b", False)])
    batch = frame(BATCH, [("x1", "1", "S1", "11", "a"), ("x2", "1", "S2", None, "b"), ("x3", "3", None, "30", "c")])
    aliases = frame("barcode string, product_id string", [("30", "p9"), ("30", "p9"), ("12", "p1")])
    monkeypatch.setattr(replica, "contested_products", lambda *_: state.select(F.raise_error(F.lit("looked for flags")).cast("string").alias("id")))
    out = replica.replica_upsert(state, aliases, batch, online=False)
    assert {(r["incoming_id"], r["outcome"]) for r in out["outcomes"].collect()} >= {("x2", "conflict")}
    assert "30" not in {r["barcode"] for r in out["aliases"].collect()}
