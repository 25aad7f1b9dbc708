"""Stored search responses: envelope checks, page-set checks and typed products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.money import discount_percent, parse_price
from pricetrail.functions.text import strip
from pricetrail.functions.urls import public_url

# Largest page, page budget and result window of a search.
PAGE_LIMIT, MAX_PAGES, WINDOW = 100, 10, 20_000


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column, path: str) -> Column:
    """JSON type at a path ('VOID' for null), null when it is absent."""
    return F.schema_of_variant(_at(v, path))


def _absent(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path), F.lit("VOID")) == "VOID"


def _is(v: Column, path: str, prefix: str) -> Column:
    return F.coalesce(_kind(v, path).startswith(prefix), F.lit(False))


def _errors(tests: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in tests]))


def envelope(responses: DataFrame) -> DataFrame:
    """Responses (response, query, offset, limit) with meta fields, ``products`` (variants) and ``errors``."""
    v = F.try_parse_json("response")
    rows = responses.withColumn("_v", v)
    v = F.col("_v")
    numbers = ("offset", "limit", "returned", "total")
    meta = {n: F.try_variant_get(v, f"$.success.meta.{n}", "bigint") for n in numbers}
    items = F.try_variant_get(v, "$.success.products", "array<variant>")
    notices = F.map_values(F.try_variant_get(v, "$.notifications", "map<string,variant>"))
    rows = rows.withColumns({
        "products": items,
        "returned": meta["returned"],
        "total": meta["total"],
        "has_more": F.try_variant_get(v, "$.success.meta.has_more", "boolean"),
        "next_offset": F.try_variant_get(v, "$.success.meta.next_offset", "bigint"),
        "_echo_offset": meta["offset"],
        "_echo_limit": meta["limit"],
        "_echo_query": F.when(_is(v, "$.success.meta.query", "STRING"), F.try_variant_get(v, "$.success.meta.query", "string")),
    })
    count = F.coalesce(F.size("products"), F.lit(0))
    end, more, following = F.col("offset") + count, F.col("has_more"), F.col("next_offset")
    ids = F.transform("products", lambda p: F.try_variant_get(p, "$.product_id", "string"))
    prices = F.transform("products", lambda p: F.try_variant_get(p, "$.price", "string"))
    bad_number = F.lit(False)
    for n in numbers:
        bad_number = bad_number | ~_is(v, f"$.success.meta.{n}", "BIGINT") | (meta[n] < 0)
    is_error = lambda n: F.coalesce(F.try_variant_get(n, "$.type", "string") == "E", F.lit(False))
    tests = [
        (~_is(v, "$.success", "OBJECT"), "envelope_absent"),
        (F.exists(notices, is_error), "notice_of_error"),
        (~_is(v, "$.success.products", "ARRAY") | ~_is(v, "$.success.meta", "OBJECT"), "products_or_meta_absent"),
        (bad_number, "number_malformed"),
        (~F.col("_echo_query").eqNullSafe(F.col("query")) | (F.col("_echo_offset") != F.col("offset"))
         | (F.col("_echo_limit") != F.col("limit")), "echo_differs"),
        ((F.col("returned") != count) | (count > F.col("limit")) | ((count > 0) & (end > F.col("total"))), "count_differs"),
        (~_is(v, "$.success.meta.has_more", "BOOLEAN") | (more != (end < F.col("total"))), "more_flag_differs"),
        (more & ((count == 0) | ~_is(v, "$.success.meta.next_offset", "BIGINT") | (following != end)), "offset_not_advanced"),
        (~more & ~_absent(v, "$.success.meta.next_offset"), "offset_after_last"),
        (~_is(v, "$.success.brands", "ARRAY"), "brands_absent"),
        (~_is(v, "$.success.categories", "ARRAY"), "categories_absent"),
        (~_is(v, "$.success.settings", "OBJECT"), "settings_absent"),
        (F.try_variant_get(v, "$.success.settings.need_auth", "boolean"), "login_asked"),
        (F.size(F.array_distinct(ids)) < count, "id_repeated"),
        (_is(v, "$.success.settings.show_prices", "BOOLEAN") & F.try_variant_get(v, "$.success.settings.show_prices", "boolean")
         & F.exists(prices, lambda p: F.coalesce(p == "", F.lit(True))), "price_absent"),
    ]
    return rows.withColumn("errors", _errors(tests)).drop("_v", "_echo_offset", "_echo_limit", "_echo_query", "response")


def product_errors(p: Column, host: str) -> Column:
    """Array of the faults of one product object."""
    text = lambda name: F.try_variant_get(p, f"$.{name}", "string")
    tests = [
        (~_is(p, "$.product_id", "STRING") | ~text("product_id").rlike("^[0-9]+$"), "missing product id"),
        (~_is(p, "$.name", "STRING") | (strip(text("name")) == ""), "missing product name"),
        (~_is(p, "$.url", "STRING") | (text("url") == ""), "missing product url"),
        *[(~_absent(p, f"$.{n}") & ~_is(p, f"$.{n}", "STRING"), f"invalid product field {n}")
          for n in ("brand", "category", "img", "original_product_id")],
        (~_absent(p, "$.cart_available") & ~_is(p, "$.cart_available", "BOOLEAN"), "invalid cart availability"),
        (public_url(text("url"), host).isNull(), "invalid source url"),
        ((F.coalesce(text("img"), F.lit("")) != "") & public_url(text("img"), host).isNull(), "invalid image url"),
        *[(~_absent(p, f"$.{n}") & ~_is(p, f"$.{n}", "STRING"), "invalid monetary type") for n in ("price", "list_price")],
        *[(parse_price(text(n))["error"].isNotNull(), f"invalid {n}") for n in ("price", "list_price")],
    ]
    return _errors(tests)


def search_products(responses: DataFrame, host: str) -> DataFrame:
    """One typed row per product of every response, with its own ``errors`` and the page's."""
    pages = envelope(responses)
    rows = pages.select("query", "offset", F.col("errors").alias("page_errors"), F.explode("products").alias("p"))
    p = F.col("p")
    text = lambda name: F.try_variant_get(p, f"$.{name}", "string")
    filled = lambda c: F.when(c != "", c)
    typed = rows.select(
        "query", "offset", "page_errors", product_errors(p, host).alias("errors"), text("product_id").alias("source_product_id"),
        strip(text("name")).alias("name"), public_url(text("url"), host).alias("product_url"),
        parse_price(text("price"))["value"].alias("price"), parse_price(text("list_price"))["value"].alias("list_price"),
        filled(text("brand")).alias("brand"), filled(text("category")).alias("category"),
        public_url(filled(text("img")), host).alias("img"), F.try_variant_get(p, "$.cart_available", "boolean").alias("cart_available"),
        text("original_product_id").alias("original_product_id"))
    return typed.withColumn("discount_percent", discount_percent(F.col("price"), F.col("list_price")))


def validate_pages(pages: DataFrame, products: DataFrame, limit: int = PAGE_LIMIT, max_pages: int = MAX_PAGES) -> DataFrame:
    """Consistency of every search's page set: pages (query, offset, returned, total, has_more), products
    (query, source_product_id). Counts are combined per query before the shuffle."""
    sets = pages.groupBy("query").agg(
        F.count(F.lit(1)).alias("pages"), F.min("total").alias("_low"), F.max("total").alias("total"),
        F.sum("returned").alias("returned"), F.min("offset").alias("_first"), F.max(F.col("offset") + F.col("returned")).alias("_end"),
        F.count_if(~F.col("has_more")).alias("_last"))
    offsets = pages.groupBy("query", "offset").agg(F.count(F.lit(1)).alias("n")).groupBy("query").agg(F.max("n").alias("_offset"))
    repeats = products.groupBy("query", "source_product_id").agg(F.count(F.lit(1)).alias("n"))
    repeats = repeats.groupBy("query").agg(F.max("n").alias("_copies"))
    rows = sets.join(offsets, "query").join(repeats, "query", "left")
    return rows.select("query", "pages", "total", "returned", _set_errors(limit, max_pages).alias("errors"))


def _set_errors(limit: int, max_pages: int) -> Column:
    return _errors([
        (F.col("_offset") > 1, "offset_not_advanced"),
        (F.col("_low") != F.col("total"), "inconsistent total"),
        ((F.col("total") > WINDOW) | (F.col("total") > limit * max_pages), "result budget exceeded"),
        (F.col("_copies") > 1, "repeated page or duplicate product id"),
        ((F.col("_last") != 1) | (F.col("_first") != 0) | (F.col("returned") != F.col("total")), "page set is not complete"),
    ])


def page_sets(pages: DataFrame, limit: int = PAGE_LIMIT, max_pages: int = MAX_PAGES) -> DataFrame:
    """``validate_pages`` over envelopes: pages and product ids are taken from one parse, and both kinds of repetition are counted together.

    Offsets and ids are counted per query and value, then per query; a search of very many products is spread over its ids.
    """
    ids = F.transform("products", lambda p: F.struct(F.lit(False).alias("page"), F.try_variant_get(p, "$.product_id", "string").alias("key")))
    itself = F.array(F.struct(F.lit(True).alias("page"), F.col("offset").cast("string").alias("key")))
    entries = pages.select("query", "offset", "returned", "total", "has_more",
                           F.explode(F.concat(itself, F.coalesce(ids, F.array().cast("array<struct<page:boolean,key:string>>")))).alias("e"))
    own = F.col("e.page")
    of_page = lambda c: F.when(own, c)
    values = entries.groupBy("query", F.col("e.page").alias("page"), F.col("e.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min(of_page(F.col("total"))).alias("low"), F.max(of_page(F.col("total"))).alias("high"),
        F.sum(of_page(F.col("returned"))).alias("returned"), F.min(of_page(F.col("offset"))).alias("first"),
        F.count_if(own & ~F.col("has_more")).alias("last"))
    copies = F.max(F.when(~F.col("page"), F.col("n")))
    sets = values.groupBy("query").agg(
        F.sum(F.when(F.col("page"), F.col("n"))).alias("pages"), F.max("high").alias("total"), F.sum("returned").alias("returned"),
        F.min("low").alias("_low"), F.min("first").alias("_first"), F.sum("last").alias("_last"),
        F.max(F.when(F.col("page"), F.col("n"))).alias("_offset"), copies.alias("_copies"))
    return sets.select("query", "pages", "total", "returned", _set_errors(limit, max_pages).alias("errors"))
