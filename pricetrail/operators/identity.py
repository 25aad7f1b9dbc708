"""Which product a row means, by any of its identifiers.

Matches are never listed pair by pair. Every identifier value of the catalog is reduced to its lowest
and highest owner; a row that sees two different owners among its identifiers is in conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.text import is_blank
from pricetrail.operators.joins import several, sole, spread_lookup
from pricetrail.session import forget, shuffles_removed, stored

IDENTITY_KEYS = ("source_product_id", "sku", "barcode", "product_url", "id")


def _exploded(df: DataFrame, row_id: str, keys: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys if k in df.columns])
    rows = df.select(F.col(row_id).alias("_row"), F.explode(pairs).alias("_pair"))
    return rows.select("_row", "_pair.kind", "_pair.value").filter("value IS NOT NULL")


def _holdings(products: DataFrame, aliases: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """Every (kind, value) a product holds; alias codes count as barcodes."""
    own = _exploded(products, "id", keys)
    if aliases is None or "barcode" not in keys:
        return own
    more = aliases.select(F.col("product_id").alias("_row"), F.lit("barcode").alias("kind"), F.col("barcode").alias("value"))
    return own.unionByName(more)


def match_keys(
    rows: DataFrame, row_id: str, products: DataFrame, aliases: DataFrame | None, keys: tuple[str, ...] = IDENTITY_KEYS
) -> DataFrame:
    """Rows that match something, with the lowest and highest product matched (_low, _high).

    Several kinds of identifiers are looked up one after the other: each leaves its matches, stored, and what it shuffled is gone
    before the next. Rows are read once for each kind, so they should be stored, with a short ``row_id``. A row has few matches, so
    they are dealt out as they are: put together before that, they would be no fewer.
    """
    kinds = [k for k in keys if k in rows.columns]
    low, high = F.min("_row"), F.max("_row")
    owners = _holdings(products, aliases, keys).groupBy("kind", "value").agg(low.alias("_low"), F.when(low != high, high).alias("_other"))
    keep = stored if len(kinds) > 1 else lambda df: df
    owners, hits = keep(owners), None
    for kind in kinds:
        asked = rows.select(F.col(row_id).alias("_row"), F.col(kind).cast("string").alias("value")).filter("value IS NOT NULL AND _row IS NOT NULL")
        found = spread_lookup(asked, owners.filter(F.col("kind") == kind).drop("kind"), ["value"], "_row", "inner")
        found = keep(found.select("_row", "_low", "_other"))
        hits = found if hits is None else hits.unionByName(found)
    if len(kinds) > 1:
        forget(owners)
    last = F.max(F.coalesce("_other", "_low"))
    return hits.repartition("_row").groupBy(F.col("_row").alias(row_id)).agg(F.min("_low").alias("_low"), last.alias("_high"))


def resolve_identity(rows: DataFrame, row_id: str, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """new, update (with product_id) or conflict for every incoming row."""
    found = rows.join(match_keys(rows, row_id, products, aliases), row_id, "left")
    match = F.when(F.col("_low").isNull(), "new").when(several(F.col("_low"), F.col("_high")), "conflict").otherwise("update")
    return found.withColumns({"match": match, "product_id": sole(F.col("_low"), F.col("_high"))}).drop("_low", "_high")


def shared_groups(rows: DataFrame, row_id: str, keys: tuple[str, ...] = IDENTITY_KEYS) -> DataFrame:
    """Rows that share an identifier with another row, directly or over others, with ``root``: the smallest row id of their group.

    The graph has rows on one side and identifier values on the other. Every value takes the smallest label of its rows and every row
    the smallest label of its values; then a row takes the label of its label, so that chains shrink by more than half a round. Only
    values with several rows are looked at, minima combine before the shuffle, and each round is stored.
    """
    values = _exploded(rows, row_id, keys)
    several_rows = values.groupBy("kind", "value").agg(F.min("_row").alias("_low"), F.max("_row").alias("_high")).filter("_low <> _high")
    edges = stored(spread_lookup(values, several_rows.select("kind", "value"), ["kind", "value"], "_row", "inner").distinct())
    labels, before = stored(edges.select("_row", F.col("_row").alias("root")).distinct()), None
    while True:
        old = labels
        here = spread_lookup(edges, labels, ["_row"], "value", "inner")
        lowest = here.groupBy("kind", "value").agg(F.min("root").alias("root"))
        near = spread_lookup(edges, lowest, ["kind", "value"], "_row", "inner").groupBy("_row").agg(F.min("root").alias("root"))
        far = near.select(F.col("_row").alias("root"), F.col("root").alias("_next"))
        labels = spread_lookup(near, far, ["root"], "_row").select("_row", F.least("root", F.coalesce("_next", "root")).alias("root"))
        labels = stored(labels)
        forget(old)
        with shuffles_removed(labels.sparkSession):
            now = labels.agg(F.sum(F.xxhash64("_row", "root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            forget(edges)
            return labels.select(F.col("_row").alias(row_id), "root")
        before = now


def contested_products(conflicts: DataFrame, row_id: str, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ids of all products touched by conflicting rows, to be flagged for review."""
    values = stored(_exploded(conflicts, row_id, IDENTITY_KEYS).select("kind", "value").distinct())
    held = _holdings(products, aliases, IDENTITY_KEYS)
    return spread_lookup(held, values, ["kind", "value"], "_row", "left_semi").select(F.col("_row").alias("id")).distinct()


def _owner_status(low: Column, high: Column, none: str, one: str, many: str) -> Column:
    return F.when(low.isNull(), none).when(several(low, high), many).otherwise(one)


def lookup_barcodes(codes: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """Scanned codes against primary and alias barcodes: found, none or ambiguous, never a pick."""
    asked = codes.select("barcode").distinct()
    owners = match_keys(asked.withColumn("code", F.col("barcode")), "code", products, aliases, ("barcode",))
    rows = asked.join(owners.withColumnRenamed("code", "barcode"), "barcode", "left")
    low, high = F.col("_low"), F.col("_high")
    return rows.select("barcode", _owner_status(low, high, "none", "found", "ambiguous").alias("status"),
                       sole(low, high).alias("product_id"))


def owners(pairs: DataFrame, row_id: str, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """Who owns a pair's SKU or barcode (aliases too): none, one (owner_id) or several."""
    rows = pairs.join(match_keys(pairs, row_id, products, aliases, ("sku", "barcode")), row_id, "left")
    low, high = F.col("_low"), F.col("_high")
    return rows.withColumns(
        {"owners": _owner_status(low, high, "none", "one", "several"), "owner_id": sole(low, high)}
    ).drop("_low", "_high")


def bind_existing(observed: DataFrame, products: DataFrame) -> DataFrame:
    """Observed rows under the stored id of their source id; ``known`` tells whether there was one."""
    stored = products.select("source_product_id", F.col("id").alias("_id"))
    rows = observed.join(stored, "source_product_id", "left")
    return rows.withColumns({"id": F.coalesce("_id", "id"), "known": F.col("_id").isNotNull()}).drop("_id")


def lookup_ids(ids: DataFrame, products: DataFrame) -> DataFrame:
    """Requested ids with their product; a missing one is reported with found = false."""
    stored = products.withColumn("found", F.lit(True))
    return ids.select("id").distinct().join(stored, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def detail_backlog(observed: DataFrame, products: DataFrame, attempted: DataFrame) -> DataFrame:
    """Source ids, once each, with neither an observed nor a stored SKU and not tried in this run."""
    lacking = F.col("sku").isNull() | (F.col("sku") == "")
    wanted = observed.filter(lacking).select("source_product_id").distinct()
    stored = products.filter(~lacking).select("source_product_id")
    tried = attempted.select("source_product_id")
    return wanted.join(stored, "source_product_id", "left_anti").join(tried, "source_product_id", "left_anti")


def resolve_members(members: DataFrame, products: DataFrame, prefix: str) -> DataFrame:
    """Members (owner_id, reference) as local product ids; an unknown reference carries an error.

    A reference is a product id, or the shop's prefix followed by a source id.
    """
    named = products.select(F.col("id").alias("reference"), F.col("id").alias("product_id"))
    sourced = products.filter("source_product_id IS NOT NULL").select(
        F.concat(F.lit(prefix), F.col("source_product_id")).alias("reference"), F.col("id").alias("product_id"))
    bare = products.filter("source_product_id IS NOT NULL").select(
        F.col("source_product_id").alias("reference"), F.col("id").alias("product_id"))
    bare = bare.filter(~F.col("reference").startswith(prefix))
    index = named.unionByName(sourced).unionByName(bare).groupBy("reference").agg(F.min("product_id").alias("product_id"))
    rows = spread_lookup(members, index, ["reference"], "owner_id")
    return rows.withColumn("error", F.when(F.col("product_id").isNull(), "product missing from the snapshot"))


def owned_elsewhere(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Rows (id, sku) with ``elsewhere``: another product owns the SKU."""
    held = products.filter("sku IS NOT NULL").groupBy("sku").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    found = spread_lookup(rows, held, ["sku"], "id")
    other = F.coalesce((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id")), F.lit(False))
    return found.withColumn("elsewhere", other & (F.col("sku") != "")).drop("_low", "_high")


def protect_sku(observed: DataFrame, products: DataFrame) -> DataFrame:
    """Drop an observed SKU that another product owns or that differs from the stored one."""
    stored = products.select("id", F.col("sku").alias("_stored"))
    rows = owned_elsewhere(observed, products).join(stored, "id", "left")
    differs = F.coalesce(F.col("_stored") != F.col("sku"), F.lit(False))
    conflict = F.coalesce(F.col("sku") != "", F.lit(False)) & (F.col("elsewhere") | differs)
    return rows.withColumns({"sku_conflict": conflict, "sku": F.when(~conflict, F.col("sku"))}).drop("elsewhere", "_stored")


def enrich_skus(products: DataFrame, details: DataFrame) -> DataFrame:
    """Outcome per detail row (source_product_id, sku, error) of a known product.

    error, unavailable (no SKU on the page), conflict (owned elsewhere, or another SKU is stored),
    unchanged or added. Of several products offered one new SKU, the lowest id gets it.
    """
    stored = products.select("id", "source_product_id", F.col("sku").alias("stored_sku"))
    rows = details.join(stored, "source_product_id", "inner")
    rows = owned_elsewhere(rows, products)
    differs = ~is_blank(F.col("stored_sku")) & (F.col("stored_sku") != F.col("sku"))
    first = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("sku").isNull(), "unavailable")
        .when(F.col("elsewhere") | differs, "conflict")
        .when(F.col("stored_sku") == F.col("sku"), "unchanged")
        .otherwise("added")
    )
    rows = rows.withColumn("outcome", first).drop("elsewhere")
    claims = rows.filter("outcome = 'added'").groupBy("sku").agg(F.min("id").alias("_winner"))
    rows = spread_lookup(rows, claims, ["sku"], "id")
    late = (F.col("outcome") == "added") & (F.col("_winner") != F.col("id"))
    return rows.withColumn("outcome", F.when(late, "conflict").otherwise(F.col("outcome"))).drop("_winner")
