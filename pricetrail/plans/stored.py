"""The catalog writer over given tables: two batches of products, written to a store and read back."""

from pyspark.sql import functions as F

from pricetrail.operators.delta import apply_changes
from pricetrail.plans import bindings as B
from pricetrail.plans.ingest import scratch
from pricetrail.plans.observed import BATCH_SQL, _batch, doubled
from pricetrail.plans.registry import query, with_views
from pricetrail.sources.catalog_store import Catalog
from pricetrail.sources.tables import read_changes

STAMP = "2001-01-01 00:00:00"

# What the first batch leaves: of products that share a SKU, none is stored. Versions follow the ids.
FIRST = """products AS (SELECT *, row_number() OVER (ORDER BY id) AS stamped FROM offered WHERE sku IS NULL OR trim(sku) = '' OR sku NOT IN (
    SELECT sku FROM offered WHERE trim(sku) <> '' GROUP BY sku HAVING count(*) > 1))"""
# Who may not claim what in the second batch, and what comes of its rows.
SECOND = """cl AS (SELECT id, 'sku' AS k, sku AS v FROM batch WHERE trim(sku) <> '' UNION ALL
      SELECT id, 'barcode', barcode FROM batch WHERE trim(barcode) <> ''),
  st AS (SELECT id, 'sku' AS k, sku AS v FROM products WHERE trim(sku) <> '' UNION ALL
      SELECT id, 'barcode', barcode FROM products WHERE trim(barcode) <> ''),
  owned AS (SELECT k, v, min(id) AS low, max(id) AS high FROM st GROUP BY k, v),
  asked AS (SELECT k, v, count(DISTINCT id) AS n FROM cl GROUP BY k, v),
  ref AS (SELECT DISTINCT cl.id FROM cl JOIN asked USING (k, v) LEFT JOIN owned USING (k, v)
    WHERE CASE WHEN low IS NULL THEN n > 1 ELSE low <> cl.id OR high <> cl.id END),
  j AS (SELECT coalesce(p.id, b.id) AS id, p.id IS NULL AS is_new, b.id IS NULL AS quiet, r.id IS NOT NULL AS refused, p.sku AS ps, b.sku AS bs,
      p.barcode AS pb, b.barcode AS bb, p.name AS pn, b.name AS bn, p.brand AS pr, b.brand AS br, p.price AS pp, b.price AS bp, p.stamped
    FROM products p FULL JOIN batch b ON b.id = p.id LEFT JOIN ref r ON r.id = b.id),
  o AS (SELECT *, CASE WHEN quiet THEN 'untouched' WHEN refused OR (NOT is_new AND ((bs <> ps AND trim(ps) <> '') OR bb <> pb)) THEN 'conflict'
      WHEN is_new THEN 'added'
      WHEN bn IS NOT DISTINCT FROM pn AND bp IS NOT DISTINCT FROM pp AND (bs IS NULL OR bs IS NOT DISTINCT FROM ps)
        AND (bb IS NULL OR bb IS NOT DISTINCT FROM pb) AND (br IS NULL OR br IS NOT DISTINCT FROM pr) THEN 'unchanged'
      ELSE 'updated' END AS outcome FROM j),
  w AS (SELECT *, outcome IN ('added', 'updated') AS written, row_number() OVER (PARTITION BY outcome IN ('added', 'updated') ORDER BY id)
      + (SELECT count(*) FROM products) AS next FROM o)"""
TWO = with_views(("offered", B.PRODUCTS), ("observed", B.OBSERVATIONS)).rstrip() + f", {BATCH_SQL}, {FIRST}, {SECOND} "


def _written(s):
    """A store after both batches, and the outcomes of the second."""
    catalog, at = Catalog(s.spark, scratch(s, "catalog")), F.lit(STAMP).cast("timestamp")
    catalog.write("product", s.sql(B.PRODUCTS), at)
    return catalog, catalog.write("product", _batch(s), at)


@query("ups1_unique_identifiers", TWO + "SELECT id, outcome FROM w")
def unique_identifiers(s):
    return _written(s)[1]


@query("ups1_catalog_state", TWO + f"""SELECT id, CASE WHEN written THEN coalesce(bs, ps) ELSE ps END AS sku, CASE WHEN written THEN coalesce(bb, pb) ELSE pb END AS barcode,
    CASE WHEN written THEN bn ELSE pn END AS name, CASE WHEN written THEN coalesce(br, pr) ELSE pr END AS brand,
    CAST(CASE WHEN written THEN bp ELSE pp END AS DOUBLE) AS price, CASE WHEN written THEN next ELSE stamped END AS version, '{STAMP}' AS updated
    FROM w WHERE written OR stamped IS NOT NULL""")
def catalog_state(s):
    rows = _written(s)[0].table("products")
    return doubled(rows.select("id", "sku", "barcode", "name", "brand", "price", "version", F.col("updated_at").cast("string").alias("updated")))


@query("snk1_two_batches", TWO + """SELECT stamped AS version, 'product' AS kind, id AS entity_id, stamped AS payload_version, name FROM products
    UNION ALL SELECT next, 'product', id, next, bn FROM w WHERE written""")
def two_batches(s):
    catalog, _ = _written(s)
    own = F.get_json_object("payload", "$.version").cast("long")
    return read_changes(s.spark, catalog.store.folder).select(
        "version", "kind", "entity_id", own.alias("payload_version"), F.get_json_object("payload", "$.name").alias("name"))


@query("lim3_pruned_delta", TWO + """SELECT next AS version, id AS entity_id FROM w WHERE written AND next <= (SELECT count(*) FROM products) + 100""")
def pruned_delta(s):
    """The first hundred changes of the second batch: one folder is read."""
    catalog, _ = _written(s)
    since = catalog.manifest().parts[0].last
    return catalog.changes(since, since + 100).select("version", "entity_id")


# A replica that knows every second product, and a slice of the log with changes of all kinds; products change twice.
KNOWN = """SELECT id, source_product_id, sku, barcode, name, price, FALSE AS needs_review FROM offered WHERE CAST(source_product_id AS BIGINT) % 2 = 0"""
NEWS = """SELECT CAST(source_product_id AS BIGINT) + 1 AS version, 'product' AS kind, id AS entity_id,
    '{"source_product_id":"' || source_product_id || '","name":"old","price":1}' AS payload FROM offered
  UNION ALL SELECT CAST(source_product_id AS BIGINT) + 100000000, 'product', id, '{"source_product_id":"' || source_product_id || '","name":"new ' || source_product_id || '","price":2.5}' FROM offered
  UNION ALL SELECT 200000000 + sort_order, 'category', id, '{"name":"' || name || '!"}' FROM categories WHERE level = 1
  UNION ALL SELECT 300000000 + l_orderkey, 'promotion', 'promo:' || l_orderkey, '{"product_ids":["shop:' || min(l_partkey) || '","shop:' || max(l_partkey) || '"]}' FROM lineitem GROUP BY l_orderkey HAVING l_orderkey % 7 = 0
  UNION ALL SELECT 400000000 + l_suppkey, 'collection', 'collection:' || l_suppkey, '{"product_ids":["shop:' || max(l_partkey) || '"]}' FROM lineitem GROUP BY l_suppkey HAVING l_suppkey % 2 = 0
  UNION ALL SELECT 500000000 + o_orderkey, 'identifier', 'pair:' || o_orderkey, '{"sku":"X-' || o_orderkey || '","barcode":"' || o_custkey || '","status":"matched","product_id":"shop:1"}' FROM orders WHERE o_orderkey % 5 = 0"""


@query("ups4_composed_delta", with_views(("offered", B.PRODUCTS), ("categories", B.CATEGORIES), ("links", B.PRODUCT_PROMOTIONS), ("members", B.MEMBERS), ("stored", B.PENDING_ROWS),
       ("known", KNOWN)).rstrip() + """, ev AS (SELECT DISTINCT 'X-' || o_orderkey AS sku, CAST(o_custkey AS VARCHAR) AS barcode FROM orders WHERE o_orderkey % 5 = 0)
    SELECT 'category' AS part, id, CASE WHEN level = 1 THEN name || '!' ELSE name END AS value FROM categories
    UNION ALL SELECT 'product', p.id, 'new ' || p.source_product_id || ' ' || coalesce(k.sku, '-') FROM offered p LEFT JOIN known k USING (id)
    UNION ALL SELECT 'link', promotion_id, product_id FROM links WHERE CAST(split_part(promotion_id, ':', 2) AS BIGINT) % 7 <> 0
    UNION ALL SELECT DISTINCT 'link', 'promo:' || l_orderkey, 'shop:' || unnest([min(l_partkey), max(l_partkey)]) FROM lineitem GROUP BY l_orderkey HAVING l_orderkey % 7 = 0
    UNION ALL SELECT 'member', collection_id, product_id FROM members WHERE CAST(split_part(collection_id, ':', 2) AS BIGINT) % 2 <> 0
    UNION ALL SELECT 'member', 'collection:' || l_suppkey, 'shop:' || max(l_partkey) FROM lineitem GROUP BY l_suppkey HAVING l_suppkey % 2 = 0
    UNION ALL SELECT 'identifier', sku || '|' || barcode, CASE WHEN (sku, barcode) IN (SELECT (sku, barcode) FROM ev) THEN 'matched' ELSE status END FROM stored
    UNION ALL SELECT 'identifier', sku || '|' || barcode, 'matched' FROM ev WHERE (sku, barcode) NOT IN (SELECT (sku, barcode) FROM stored)""")
def composed_delta(s):
    """One slice with changes of all kinds, applied to a replica."""
    bound = {"offered": s.sql(B.PRODUCTS), "categories": s.sql(B.CATEGORIES), "lineitem": s.table("lineitem"), "orders": s.table("orders")}
    text = NEWS.replace("{", "{{").replace("}", "}}")
    for name in bound:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    news = s.spark.sql(text, **bound)
    known = s.spark.sql(KNOWN.replace("FROM offered", "FROM {offered}"), offered=bound["offered"])
    empty = s.spark.createDataFrame([], "id string, data string")
    pending = s.sql(B.PENDING_ROWS).withColumn("id", F.concat_ws("|", "sku", "barcode"))
    tables = {"categories": bound["categories"], "products": known, "aliases": s.sql(B.ALIAS_ROWS), "promotions": empty, "collections": empty,
              "links": s.sql(B.PRODUCT_PROMOTIONS).select("promotion_id", "product_id"), "members": s.sql(B.MEMBER_ROWS), "pending": pending}
    out = apply_changes(tables, news)
    rows = lambda part, table, key, value: out[table].select(F.lit(part).alias("part"), key.alias("id"), value.alias("value"))
    c = F.col
    return (
        rows("category", "categories", c("id"), c("name")).unionByName(rows("product", "products", c("id"), F.concat_ws(" ", "name", F.coalesce("sku", F.lit("-")))))
        .unionByName(rows("link", "links", c("promotion_id"), c("product_id"))).unionByName(rows("member", "members", c("collection_id"), c("product_id")))
        .unionByName(rows("identifier", "pending", F.concat_ws("|", "sku", "barcode"), c("status"))))
