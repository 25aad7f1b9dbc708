"""Catalog diagnostics and resumable work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.text import missing_sku, valid_sku
from pricetrail.operators.changes import keyset_page


def diagnose_skus(products: DataFrame, after: str = "") -> DataFrame:
    """SKU counts of the whole catalog in one pass, and why an enrichment run would or would not work."""
    sku, missing, count = F.col("sku"), missing_sku(F.col("sku")), F.count_if
    empty = F.coalesce(sku == "", F.lit(False))
    facts = products.agg(
        F.count(F.lit(1)).alias("total_products"), count(~missing).alias("products_with_sku"),
        count(missing).alias("products_without_sku"), count(sku.isNull()).alias("products_with_null_sku"),
        count(empty).alias("products_with_empty_sku"),
        count(sku.isNotNull() & ~empty & missing).alias("products_with_whitespace_sku"),
        count(valid_sku(sku)).alias("products_with_valid_sku"),
        count(missing & (F.col("id") > after)).alias("eligible_after"),
        count(missing & (F.col("id") <= after)).alias("excluded_by_after"),
        (F.lit(after == "") | (count(F.col("id") == after) > 0)).alias("after_exists"))
    reason = (
        F.when(F.col("total_products") == 0, "empty_catalog")
        .when(F.col("products_without_sku") == 0, "all_products_have_sku")
        .when(~F.col("after_exists"), "invalid_after")
        .when(F.col("eligible_after") == 0, "missing_products_before_cursor")
        .otherwise("ready"))
    return facts.withColumn("reason", reason)


def enrichment_batch(products: DataFrame, after: str, limit: int) -> DataFrame:
    """The next products without an SKU after an id."""
    if not 1 <= limit <= 1000:
        raise ValueError("the batch limit must be between 1 and 1000")
    return keyset_page(products.filter(missing_sku(F.col("sku"))), "id", after or None, limit)


def sample_first(rows: DataFrame, key: str, limit: int = 1000) -> DataFrame:
    """Bounded observation sample: the first rows by key."""
    return rows.orderBy(key).limit(limit)
