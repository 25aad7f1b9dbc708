"""Which promotions are active at a moment, and what that does to a product's price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.money import effective_price
from pricetrail.operators.joins import spread_lookup

LINK_VALUES = ("old_price", "promotional_price", "discount_percent")


def running(promotions: DataFrame, at: Column) -> DataFrame:
    """Promotions whose period holds the moment; both ends count."""
    return promotions.filter((F.col("starts_at") <= at) & (F.col("ends_at") >= at))


def _links(links: DataFrame, promotions: DataFrame, at: Column) -> DataFrame:
    live = running(promotions, at).select(F.col("id").alias("promotion_id"), "last_updated")
    return spread_lookup(links, live, ["promotion_id"], "product_id", "inner")


def own_flag(at: Column) -> Column:
    """Activity of a product that has its own promotion state; null for legacy rows."""
    dated = (F.col("promotion_state") == "dated") & (F.col("promotion_start") <= at) & (F.col("promotion_end") >= at)
    live = ~F.col("inactive") & ((F.col("promotion_state") == "observed") | F.coalesce(dated, F.lit(False)))
    return F.when(F.col("promotion_state").isNotNull(), F.coalesce(live, F.lit(False)))


def with_active_flag(products: DataFrame, links: DataFrame, promotions: DataFrame, at: Column) -> DataFrame:
    """Add ``active``: the product's own state, or for legacy rows any running linked promotion."""
    linked = _links(links, promotions, at).select(F.col("product_id").alias("id")).distinct()
    flagged = products.join(linked.withColumn("_linked", F.lit(True)), "id", "left")
    return flagged.withColumn("active", F.coalesce(own_flag(at), F.col("_linked"), F.lit(False))).drop("_linked")


def active_promotions(products: DataFrame, links: DataFrame, promotions: DataFrame, at: Column) -> DataFrame:
    return with_active_flag(products, links, promotions, at).filter("active")


def overlay_promotion(products: DataFrame, links: DataFrame, promotions: DataFrame, at: Column) -> DataFrame:
    """Like with_active_flag, and legacy rows take their prices from the running promotion that was
    updated last (equal times: the greater promotion id)."""
    newest = F.max_by(F.struct(*LINK_VALUES), F.struct("last_updated", "promotion_id"))
    live = _links(links, promotions, at)
    best = live.groupBy(F.col("product_id").alias("id")).agg(newest.alias("_promo"))
    joined = products.join(best, "id", "left")
    legacy = F.col("promotion_state").isNull() & F.col("_promo").isNotNull()
    active = F.coalesce(own_flag(at), F.col("_promo").isNotNull())
    targets = {"old_price": "old_price", "promo_price": "promotional_price", "discount_percent": "discount_percent"}
    values = {
        column: F.when(legacy, F.col("_promo")[source]).otherwise(F.col(column)) for column, source in targets.items()
    }
    return joined.withColumns({**values, "active": active}).drop("_promo")


def with_effective_price(df: DataFrame) -> DataFrame:
    price = effective_price(*[F.col(c) for c in ("active", "promotion_state", "price", "promo_price", "old_price")])
    return df.withColumn("effective_price", price)


def next_boundary(products: DataFrame, promotions: DataFrame, at: Column) -> DataFrame:
    """The next moment at which any promotion starts or ends, as one row ``boundary``."""

    def soonest(df: DataFrame, start: str, end: str) -> DataFrame:
        later = [F.min(F.when(F.col(c) > at, F.col(c))) for c in (start, end)]
        return df.agg(F.least(*later).alias("boundary"))

    own = soonest(products.filter("promotion_state = 'dated'"), "promotion_start", "promotion_end")
    return own.unionByName(soonest(promotions, "starts_at", "ends_at")).agg(F.min("boundary").alias("boundary"))


def current_campaign(promotions: DataFrame, kind: str) -> DataFrame:
    """The campaign that ends last, or no row when its period is missing or reversed.

    There is no falling back to an earlier campaign.
    """
    newest = promotions.filter(F.col("type") == kind).orderBy(F.desc_nulls_last("ends_at"), F.desc("id")).limit(1)
    return newest.filter("starts_at IS NOT NULL AND ends_at IS NOT NULL AND ends_at >= starts_at")
