"""A slice of the change log applied to a whole replica, kind by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricetrail.operators.changes import KINDS, snapshot
from pricetrail.operators.identifiers import apply_identifier_events
from pricetrail.operators.replica import replica_upsert
from pricetrail.operators.upsert import put_documents, replace_memberships, upsert
from pricetrail.session import cut_lineage

IDENTIFIER = "sku string, barcode string, status string, product_id string"


def apply_changes(tables: dict[str, DataFrame], changes: DataFrame, since: int = 0) -> dict[str, DataFrame]:
    """The replica's tables after changes (version, kind, entity_id, payload) newer than ``since``.

    The newest change of every entity counts, so replays and late ones have no effect. Kinds are applied in the order in which they depend
    on each other: categories by upsert; products by ``replica_upsert`` (online), with what it says about conflicts; promotions
    and collections as documents, their membership (payload product_ids) replaced as a whole; identifiers by ``apply_identifier_events``.
    A payload holds the columns of its table; columns that it doesn't name are null for products and left alone for categories. A change of a
    kind that replicas do not know stops the job.

    ``tables``: categories, products, aliases, promotions and collections (id, data), links (promotion_id, product_id), members
    (collection_id, product_id), pending. The result has the same names, and reviews.
    """
    refused = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("none"))))
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(refused.cast("string")).alias("kind")
    newest = snapshot(changes.filter(F.col("version") > since).select(kind, "entity_id", "version", "payload"))
    newest = cut_lineage(newest)

    def of(name: str) -> DataFrame:
        return newest.filter(F.col("kind") == name)

    def parsed(name: str, table: DataFrame) -> DataFrame:
        schema = StructType([f for f in table.schema.fields if f.name not in ("id", "needs_review")])
        rows = of(name).select(F.col("entity_id").alias("id"), F.from_json("payload", schema).alias("p"), F.json_object_keys("payload").alias("supplied"))
        return rows.select("id", "p.*", "supplied")

    state = tables["categories"]
    categories = upsert(state, parsed("category", state), keep=(), identity=(), new_row={}).select(*state.columns)
    state = tables["products"]
    merged = replica_upsert(state, tables["aliases"], parsed("product", state).drop("supplied"), online=True)
    documents = {}
    for name, table, bridge, owner in (("promotion", "promotions", "links", "promotion_id"), ("collection", "collections", "members", "collection_id")):
        rows = of(name).select(F.col("entity_id").alias("id"), F.col("payload").alias("data"))
        documents[table] = put_documents(tables[table], rows).select("id", "data")
        lists = rows.select(F.col("id").alias(owner), F.coalesce(F.from_json("data", "product_ids array<string>")["product_ids"], F.array().cast("array<string>")).alias("product_ids"))
        documents[bridge] = replace_memberships(tables[bridge], lists, owner)
    events = of("identifier").select(F.from_json("payload", IDENTIFIER).alias("p")).select("p.*")
    pending = apply_identifier_events(tables["pending"], events).drop("outcome")
    return documents | {
        "categories": categories, "products": merged["products"].select(*state.columns), "pending": pending, "reviews": merged["reviews"],
        "aliases": tables["aliases"].select("barcode", "product_id").unionByName(merged["aliases"]).distinct()}
