"""What an observed row may write, and how a set of observations is checked and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetrail.functions.money import discount_percent
from pricetrail.functions.text import is_blank
from pricetrail.operators.identity import owned_elsewhere
from pricetrail.operators.joins import spread_lookup

MONEY_FIELDS = ("price", "old_price", "promo_price", "discount_percent", "promotion_state", "promotion_start",
                "promotion_end")
PRICED_FIELDS = (*MONEY_FIELDS, "quantity")
IMAGE_FIELDS = ("thumbnail_url", "source_image_url", "full_image_url")


def _supplied(groups: list[tuple[Column | None, tuple[str, ...]]]) -> Column:
    """Array of the column names written, each group under its condition (None = always)."""
    parts = []
    for condition, names in groups:
        given = F.array(*[F.lit(n) for n in names])
        parts.append(given if condition is None else F.when(condition, given).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def search_patch(observed: DataFrame, products: DataFrame) -> DataFrame:
    """Patch rows for known products from search results (source_product_id, name, product_url, brand,
    category_id, img, price, list_price).

    Name and URL are always written; brand, category and images when present. Prices are written unless
    they would contradict a campaign, which is counted in ``promotion_conflict`` instead.
    """
    stored = products.select(
        "source_product_id", F.col("id").alias("id"), F.col("price").alias("_price"), F.col("old_price").alias("_old"),
        F.col("promotion_state").alias("_state"), (F.col("promotion_start").isNotNull() | F.col("promotion_end").isNotNull())
        .alias("_bounds"))
    rows = observed.drop("id").join(stored, "source_product_id", "inner")
    price, list_price = F.col("price"), F.col("list_price")
    discounted = F.coalesce(list_price > price, F.lit(False))
    campaign = F.coalesce(F.col("_state") == "dated", F.lit(False)) | F.col("_bounds")
    doubtful = F.coalesce(F.col("_state") == "observed", F.lit(False)) & ~discounted
    changed = ~F.col("_price").eqNullSafe(price) | (list_price.isNotNull() & ~F.col("_old").eqNullSafe(list_price))
    conflict = price.isNotNull() & (campaign | doubtful) & changed
    priced = price.isNotNull() & ~conflict
    supplied = _supplied([
        (None, ("name", "product_url")),
        (F.coalesce("brand", F.lit("")) != "", ("brand",)),
        (F.coalesce("category_id", F.lit("")) != "", ("category_id",)),
        (F.coalesce("img", F.lit("")) != "", ("source_image_url", "full_image_url")),
        (priced, ("price",)),
        (priced & discounted, ("old_price", "promo_price", "discount_percent")),
        (priced & discounted & ~campaign, ("promotion_state",)),
    ])
    return rows.select(
        "id", "name", "product_url", "brand", "category_id", F.col("img").alias("source_image_url"),
        F.col("img").alias("full_image_url"), "price", list_price.alias("old_price"), price.alias("promo_price"),
        discount_percent(price, list_price).alias("discount_percent"), F.lit("observed").alias("promotion_state"),
        supplied.alias("supplied"), conflict.alias("promotion_conflict"))


def listing_patch(observed: DataFrame, products: DataFrame, period: tuple[Column, Column] | None = None,
                  selective: bool = False) -> DataFrame:
    """Patch rows from listing cards.

    A selective refresh leaves the money of a product with campaign dates alone; a campaign's period is
    stamped on observed promotions; a price-less '1 kg' card keeps what is stored.
    """
    stored = products.select("source_product_id", F.col("id").alias("_id"), F.lit(True).alias("_known"),
                             (F.col("promotion_start").isNotNull() | F.col("promotion_end").isNotNull()).alias("_bounds"))
    rows = observed.join(stored, "source_product_id", "left").withColumn("id", F.coalesce("_id", "id"))
    known = F.col("_known").isNotNull()
    dated_elsewhere = F.lit(selective) & known & F.coalesce("_bounds", F.lit(False))
    keeps = known & F.col("price").isNull() & F.coalesce(F.col("quantity") == "1 kg", F.lit(False))
    money, quantity = ~dated_elsewhere & ~keeps, ~keeps
    fixed = tuple(c for c in observed.columns if c not in (*PRICED_FIELDS, "id"))
    rows = _stamp(rows, period).withColumn(
        "supplied", _supplied([(None, fixed), (money, MONEY_FIELDS), (quantity, ("quantity",))]))
    return rows.drop("_id", "_known", "_bounds")


def _stamp(rows: DataFrame, period: tuple[Column, Column] | None) -> DataFrame:
    """Observed promotions become dated with the campaign's period."""
    if period is None:
        return rows
    seen = F.col("promotion_state") == "observed"
    return rows.withColumns({
        "promotion_start": F.when(seen, period[0]).otherwise(F.col("promotion_start")),
        "promotion_end": F.when(seen, period[1]).otherwise(F.col("promotion_end")),
        "promotion_state": F.when(seen, "dated").otherwise(F.col("promotion_state")),
    })


def campaign_patch(observed: DataFrame, products: DataFrame, period: tuple[Column, Column]) -> DataFrame:
    """Patch rows from campaign cards.

    Known products keep category, stock and absence state, a stored SKU and images the card lacks; a
    price-less card keeps what is stored; an SKU owned by another product is dropped (sku_conflict).
    """
    stored = products.select("source_product_id", F.col("id").alias("_id"), F.col("sku").alias("_sku"), F.lit(True).alias("_known"))
    rows = observed.join(stored, "source_product_id", "left")
    known = F.col("_known").isNotNull()
    rows = rows.withColumns({
        "id": F.coalesce("_id", "id"),
        "sku": F.when(known & ~is_blank(F.col("_sku")), F.col("_sku")).otherwise(F.col("sku")),
    })
    rows = owned_elsewhere(rows, products)
    conflict = F.coalesce("elsewhere", F.lit(False))
    keeps = known & F.col("price").isNull()
    catalog_only = tuple(c for c in ("category_id", "in_stock", "possibly_inactive", "inactive", "missing_count") if c in observed.columns)
    special = (*PRICED_FIELDS, *IMAGE_FIELDS, *catalog_only, "sku", "id")
    fixed = tuple(c for c in observed.columns if c not in special)
    groups = [(None, fixed), (~keeps, PRICED_FIELDS), (~conflict, ("sku",))]
    groups += [(~known | F.col(c).isNotNull(), (c,)) for c in IMAGE_FIELDS if c in observed.columns]
    groups += [(~known, catalog_only)] if catalog_only else []
    rows = rows.withColumns({"sku_conflict": conflict, "supplied": _supplied(groups)})
    return _stamp(rows, period).drop("_id", "_sku", "_known", "elsewhere")


def absent(products: DataFrame, seen: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Products of the scope's categories (id) that were not seen (id)."""
    inside = products
    if scope is not None:
        inside = spread_lookup(products, scope.select(F.col("id").alias("category_id")).distinct(), ["category_id"], "id", "left_semi")
    return inside.join(seen.select("id"), "id", "left_anti")


def absence_patch(missing: DataFrame) -> DataFrame:
    """Patch rows for absent products: one more absence, inactive from the third on."""
    count = F.col("missing_count") + 1
    return missing.select("id", count.alias("missing_count"), F.lit(True).alias("possibly_inactive"), (count >= 3).alias("inactive"))


def absence_spans(sightings: DataFrame, scope: DataFrame, runs: int) -> DataFrame:
    """Absences of every scope product (id) over the complete runs 1..runs, coded by spans: first_run, last_run, absences (after first_run).

    Within a span the counter grows by one a run, so a product has a row per sighting (and one for the time before the first), however
    many runs there are. Sightings (id, run) are made distinct before the window, which holds one row per run at most.
    """
    run = F.col("run").cast("long").alias("run")
    seen = sightings.select("id", run).distinct().join(scope.select("id"), "id", "left_semi")
    marks = scope.select("id", F.lit(0).cast("long").alias("run")).unionByName(seen)
    following = F.lead("run").over(Window.partitionBy("id").orderBy("run"))
    spans = marks.withColumn("_next", F.coalesce(following, F.lit(runs + 1)))
    first = F.greatest(F.col("run"), F.lit(1))
    return spans.filter(F.col("_next") > first).select(
        "id", first.alias("first_run"), (F.col("_next") - 1).alias("last_run"), (first - F.col("run")).alias("absences"))


def _counters(count: Column) -> list[Column]:
    return [count.alias("missing_count"), (count >= 1).alias("possibly_inactive"), (count >= 3).alias("inactive")]


def absences_at(spans: DataFrame, run: int | Column) -> DataFrame:
    """Counters of every product after one run: the span that holds it, and the distance from its start."""
    run = F.lit(run) if isinstance(run, int) else run
    here = spans.filter((F.col("first_run") <= run) & (F.col("last_run") >= run))
    return here.select("id", *_counters(F.col("absences") + run - F.col("first_run")))


def absence_streak(sightings: DataFrame, scope: DataFrame, runs: int) -> DataFrame:
    """Absence counters of every scope product (id) after each of the complete runs 1..runs: ``absence_spans`` written out, scope x runs rows."""
    spans = absence_spans(sightings, scope, runs)
    cells = spans.select("*", F.explode(F.sequence("first_run", "last_run")).alias("run"))
    return cells.select("id", "run", *_counters(F.col("absences") + F.col("run") - F.col("first_run")))


def dedupe_strict(cards: DataFrame, key: str) -> DataFrame:
    """Identical duplicates collapse; an id with different contents is marked ``conflicting`` once.

    Cards are compared by minimum and maximum of their contents, so equal copies vanish before the
    shuffle and a hot id costs no more than any other.
    """
    rest = [c for c in cards.columns if c != key]
    content = F.struct(*rest)
    ranges = cards.groupBy(key).agg(F.min(content).alias("_low"), F.max(content).alias("_high"))
    same = F.col("_low") == F.col("_high")
    return ranges.select(key, *[F.when(same, F.col("_low")[c]).alias(c) for c in rest], (~same).alias("conflicting"))


def signature(key: str, ids: str) -> list[Column]:
    """Order-free digest of a set of ids, as aggregates over distinct (key, id) rows.

    The parts add up hash halves, so they combine before the shuffle and no set is ever collected.
    """
    digest = F.md5(F.col(ids).cast("string").cast("binary"))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]
    return [F.count(F.lit(1)).alias("_n"), *[F.sum(h).alias(f"_h{i}") for i, h in enumerate(halves)]]


def repeated_pages(cards: DataFrame, scope: str, page: str, ids: str) -> DataFrame:
    """Non-empty pages with whether an earlier page of their scope holds the same set of ids."""
    distinct = cards.select(scope, page, ids).distinct()
    pages = distinct.groupBy(scope, page).agg(*signature(page, ids))
    marks = ["_n", "_h0", "_h1"]
    first = pages.groupBy(scope, *marks).agg(F.min(page).alias("_first"))
    rows = spread_lookup(pages, first, [scope, *marks], page)
    return rows.select(scope, page, (F.col("_first") < F.col(page)).alias("repeated"))


def compare_sources(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Common ids of two sources and how many agree on price and on old price (null equals null)."""
    other = b.select(key, F.col("price").alias("_price"), F.col("old_price").alias("_old"))
    common = a.select(key, "price", "old_price").join(other, key)
    return common.agg(
        F.count(F.lit(1)).alias("common_ids"),
        F.count_if(F.col("price") == F.col("_price")).alias("price_matches"),
        F.count_if(F.col("old_price").eqNullSafe(F.col("_old"))).alias("old_price_matches"))


def apply_search(observed: DataFrame, products: DataFrame, scope: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Observed rows with how they are used: patched, outside_targets, or unknown in the scope."""
    inside = spread_lookup(products.select("source_product_id", "category_id", "id"),
                           scope.select(F.col("id").alias("category_id")).distinct(), ["category_id"], "id", "left_semi")
    rows = observed.drop("id").join(inside.select("source_product_id", "id"), "source_product_id", "left")
    use = F.when(F.col("id").isNull(), "unknown")
    if targets is not None:
        wanted = targets.select("source_product_id", F.lit(True).alias("_target")).distinct()
        rows = rows.join(wanted, "source_product_id", "left")
        use = use.when(F.col("_target").isNull(), "outside_targets")
    rows = rows.withColumn("use", use.otherwise("patched"))
    return rows.drop("_target") if targets is not None else rows


def covered(targets: DataFrame, returned: DataFrame) -> DataFrame:
    """Whether a search answered for every target: returned rows, missing targets, fallback decision."""
    got = returned.select("source_product_id").distinct().withColumn("_got", F.lit(1))
    asked = targets.select("source_product_id").distinct().withColumn("_asked", F.lit(1))
    both = asked.join(got, "source_product_id", "full_outer")
    facts = both.agg(F.count("_got").alias("returned"), F.count_if(F.col("_asked").isNotNull() & F.col("_got").isNull()).alias("missing"),
                     F.count_if(F.col("_asked").isNotNull() & F.col("_got").isNotNull()).alias("answered"))
    return facts.withColumn("fallback", (F.col("returned") == 0) | (F.col("missing") > 0) | (F.col("answered") == 0))


def page_stats(cards: DataFrame, page: str) -> DataFrame:
    """Per page: products found, with price, with old price, discounted, promotional, restricted."""
    card = ~F.coalesce("restricted", F.lit(False))
    count = lambda test: F.count_if(card & F.coalesce(test, F.lit(False)))
    return cards.groupBy(page).agg(
        F.count_if(card).alias("found"), count(F.col("price").isNotNull()).alias("with_price"),
        count(F.col("old_price").isNotNull()).alias("with_old_price"), count(F.col("discount_percent") > 0).alias("with_discount"),
        count(F.col("promotion_state") == "observed").alias("promotional"), F.count_if(~card).alias("restricted"))


def campaign_metrics(rows: DataFrame, products: DataFrame, linked: DataFrame) -> DataFrame:
    """One row of campaign counters: rows are deduplicated cards (id, source_product_id, sku, detail_sku,
    detail_error, prices, thumbnail_url), linked the products linked before (id)."""
    stored = products.select("source_product_id", F.col("sku").alias("_stored"), F.lit(True).alias("_known"))
    cards = rows.join(stored, "source_product_id", "left")
    known, has = F.col("_known").isNotNull(), ~is_blank(F.col("_stored"))
    chosen = F.when(has, F.col("_stored")).when(~is_blank(F.col("sku")), F.col("sku")).otherwise(F.col("detail_sku"))
    safe = owned_elsewhere(cards.select("id", chosen.alias("sku")), products).select("id", F.col("elsewhere").alias("_conflict"))
    cards = cards.join(safe, "id").join(linked.select("id", F.lit(True).alias("_linked")), "id", "full_outer")
    card = F.col("source_product_id").isNotNull()
    needs = card & ~has & is_blank(F.col("sku"))
    fetched = (card & ~has & ~is_blank(F.col("sku"))) | (needs & (F.coalesce("detail_sku", F.lit("")) != ""))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return cards.agg(
        count(card).alias("unique_products"), count(card & known).alias("existing_products"), count(card & ~known).alias("new_products"),
        count(card & has).alias("sku_existing"), count(fetched).alias("sku_fetched"),
        count(needs & (F.coalesce("detail_sku", F.lit("")) == "")).alias("sku_missing"), count(F.col("_conflict")).alias("sku_conflicts"),
        count(card & F.col("old_price").isNotNull()).alias("price_normal_found"),
        count(card & F.col("promo_price").isNotNull()).alias("promo_price_found"),
        count(card & (F.col("discount_percent") > 0)).alias("discount_found"),
        count(card & F.col("thumbnail_url").isNotNull()).alias("images_found"), count(card).alias("products_linked"),
        count(~card & F.col("_linked")).alias("products_unlinked"))
