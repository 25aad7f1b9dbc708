"""Replica reading: projections, filters, promotions, categories, listings."""

import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricetrail.operators import categories as K
from pricetrail.operators import products as P
from pricetrail.operators import promotions as R
from pricetrail.operators.paging import offset_page
from pricetrail.operators.search import WordIndex, search_many
from pricetrail.plans import bindings as B
from pricetrail.plans.registry import query, with_views
from pricetrail.schemas import PRODUCTS
from pricetrail.session import shared_dir
from pricetrail.sources.tables import read_catalog

AT_TEXT = "1998-06-15 00:00:00"


def moment():
    return F.lit(AT_TEXT).cast("timestamp_ntz")


VIEWS = (("products", B.PRODUCTS), ("aliases", B.ALIASES), ("promotions", B.PROMOTIONS),
         ("links", B.PRODUCT_PROMOTIONS), ("members", B.MEMBERS), ("categories", B.CATEGORIES))


def views(*names, more=""):
    chosen = [v for v in VIEWS if v[0] in names]
    return with_views(*chosen).rstrip() + (f", {more} " if more else " ")


def products(s):
    return s.sql(B.PRODUCTS)


def doubled(df):
    """Decimals as doubles, so that both engines print them alike."""
    casts = [F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes]
    return df.select(casts)


MONEY = ("price", "old_price", "promo_price", "discount_percent")
NAMED_COLUMNS = [part.split()[0] for part in re.split(r",\s+", PRODUCTS)]
NOT_BOUND = ("source_image_url", "full_image_url", "created_at", "updated_at")
ALL_COLUMNS = ", ".join(
    f"CAST(NULL AS VARCHAR) AS {c}" if c in NOT_BOUND else f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY
    else f"CAST({c} AS VARCHAR) AS {c}" if c.startswith("promotion_") and c != "promotion_state" else c for c in NAMED_COLUMNS)


@query("src1_catalog_tables", views("products") + f"SELECT {ALL_COLUMNS} FROM products")
def catalog_tables(s):
    """Written with the table's fixed schema and read back by the reader, all columns."""
    folder = f"{shared_dir(s.spark)}/catalog-{uuid.uuid4().hex}"
    rows, schema = products(s), StructType.fromDDL(PRODUCTS)
    typed = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    rows.select(typed).write.parquet(f"{folder}/products")
    read = read_catalog(s.spark, folder, ["products"])["products"]
    text = {c: F.col(c).cast("string") for c in ("promotion_start", "promotion_end", "created_at", "updated_at")}
    return doubled(read).withColumns(text)


ISO_SQL = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@query("prj1_public_payload", views("products") + f"""SELECT id, source_product_id AS "sourceProductId", sku, barcode, name,
    CAST(price AS DOUBLE) AS price, CAST(discount_percent AS DOUBLE) AS "discountPercent",
    {ISO_SQL.format('promotion_start')} AS "promotionStart", in_stock AS "inStock", version FROM products""")
def public_payload(s):
    return P.payload(products(s).select("id", "source_product_id", "sku", "barcode", "name", "price", "discount_percent",
                                        "promotion_start", "in_stock", "version"))


@query("prj2_flatten_documents", """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(event_id AS VARCHAR) AS id, event_id + 1 AS version FROM events""")
def flatten_documents(s):
    documents = s.table("events").select(
        F.col("event_id").cast("string").alias("id"), F.col("props").alias("data"), (F.col("event_id") + 1).alias("version"))
    return P.flatten_documents(documents, "k long")


TEXT_SQL = """trim(regexp_replace(lower(coalesce(name, '') || ' ' || coalesce(sku, '') || ' ' || coalesce(barcode, '')
    || ' ' || coalesce(brand, '')), '\\s+', ' ', 'g'))"""


@query("prj3_search_text", views("products") + f"SELECT id, {TEXT_SQL} AS search_text FROM products")
def with_search_text(s):
    return P.with_search_text(products(s)).select("id", "search_text")


@query("prj4_replica_columns", views("products") + f"""SELECT id, CAST(promo_price AS DOUBLE) AS "promotionalPrice",
    category_id AS "categoryNodeId", thumbnail_url AS "imageUrl", CAST(in_stock AS INT) AS "inStock",
    CAST(inactive AS INT) AS "isInactive", CAST(possibly_inactive AS INT) AS "possibleInactive",
    {ISO_SQL.format('promotion_end')} AS "promotionEnd", version AS "serverVersion" FROM products""")
def to_replica(s):
    return P.to_replica(products(s).select("id", "promo_price", "category_id", "thumbnail_url", "in_stock", "inactive",
                                           "possibly_inactive", "promotion_end", "missing_count", "version"))


def search_sql(raw, folded, tokens):
    words = "' ' || regexp_replace(search_text, '[^\\p{L}\\p{N}]+', ' ', 'g')"
    prefixed = " AND ".join(f"contains({words}, ' {t}')" for t in tokens) or "FALSE"
    return views("products", "aliases", more=f"t AS (SELECT *, {TEXT_SQL} AS search_text FROM products)") + f"""
    SELECT id, name FROM t WHERE sku = '{raw}' OR barcode = '{raw}'
      OR id IN (SELECT product_id FROM aliases WHERE barcode = '{raw}')
      OR ({prefixed}) OR contains(search_text, '{folded}')"""


def _searched(s, text):
    return P.search(products(s), s.sql(B.ALIASES), text).select("id", "name")


@query("flt1_search_words", search_sql("Bra sma", "bra sma", ["bra", "sma"]))
def search_words(s):
    return _searched(s, "  Bra sma ")


@query("flt1_search_code", search_sql("7-3", "7-3", []))
def search_code(s):
    return _searched(s, "7-3")


@query("flt1_search_literal", search_sql("nd#1", "nd#1", []))
def search_literal(s):
    return _searched(s, "nd#1")


ASKED = """SELECT DISTINCT q AS query_id, q AS query FROM (
    SELECT concat(substr(name, 1, 3), ' ', substr(brand, 1, 2)) AS q FROM products UNION ALL SELECT substr(name, 2, 5) FROM products
    UNION ALL SELECT substr(name, 1, 1) FROM products UNION ALL SELECT concat(substr(brand, 4, 2), substr(sku, 6, 2)) FROM products
    UNION ALL SELECT sku FROM products UNION ALL SELECT barcode FROM aliases) AS wanted WHERE q IS NOT NULL AND trim(q) <> ''"""
FOLDED_SQL = "trim(regexp_replace(lower(query), '\\s+', ' ', 'g'))"


@query("flt1_many_searches", views("products", "aliases", more=f"""t AS (SELECT id, sku, barcode, {TEXT_SQL} AS x FROM products),
    w AS (SELECT *, ' ' || regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') AS words FROM t),
    asked AS (SELECT *, trim(query) AS raw, {FOLDED_SQL} AS folded FROM ({ASKED})),
    parts AS (SELECT *, CASE WHEN regexp_full_match(folded, '[a-z0-9 ]+') THEN string_split(folded, ' ') END AS tokens FROM asked)""") + """
    SELECT query_id, id FROM parts, w WHERE contains(x, folded) OR coalesce(len(list_filter(tokens, lambda k: NOT contains(words, ' ' || k))) = 0, FALSE)
    UNION SELECT query_id, id FROM parts JOIN t ON t.sku = raw UNION SELECT query_id, id FROM parts JOIN t ON t.barcode = raw
    UNION SELECT query_id, t.id FROM parts JOIN aliases a ON a.barcode = raw JOIN t ON t.id = a.product_id""")
def many_searches(s):
    """Parts of all names, brands and codes, searched at once in a stored index of all products."""
    folder = f"{shared_dir(s.spark)}/words-{uuid.uuid4().hex}"
    WordIndex.build(products(s)).write(folder)
    named = re.sub(r"FROM (products|aliases)", r"FROM {\1}", ASKED)
    queries = s.spark.sql(named, products=products(s), aliases=s.sql(B.ALIAS_CODES))
    return search_many(WordIndex.read(s.spark, folder), s.sql(B.ALIAS_ROWS), queries)


@query("flt2_collection_members", views("products", "members") + """SELECT id, name FROM products
    WHERE id IN (SELECT product_id FROM members WHERE collection_id = 'collection:7')""")
def collection_members(s):
    return P.in_collection(products(s), s.sql(B.MEMBERS), "collection:7").select("id", "name")


ACTIVE_SQL = f"""CASE WHEN promotion_state IS NOT NULL THEN (NOT inactive AND (promotion_state = 'observed' OR
    (promotion_state = 'dated' AND promotion_start <= TIMESTAMP '{AT_TEXT}' AND promotion_end >= TIMESTAMP '{AT_TEXT}')))
    ELSE EXISTS (SELECT 1 FROM links l JOIN promotions r ON r.id = l.promotion_id WHERE l.product_id = p.id
      AND r.starts_at <= TIMESTAMP '{AT_TEXT}' AND r.ends_at >= TIMESTAMP '{AT_TEXT}') END"""
PROMO_VIEWS = ("products", "promotions", "links")


def _promo(s):
    return products(s), s.sql(B.PRODUCT_PROMOTIONS), s.sql(B.PROMOTIONS), moment()


@query("flt3_active_promotions", views(*PROMO_VIEWS) + f"SELECT id, promotion_state FROM products p WHERE {ACTIVE_SQL}")
def active_promotions(s):
    return R.active_promotions(*_promo(s)).select("id", "promotion_state")


@query("jn1_active_flag", views(*PROMO_VIEWS) + f"SELECT id, {ACTIVE_SQL} AS active FROM products p")
def active_flag(s):
    return R.with_active_flag(*_promo(s)).select("id", "active")


OVERLAY = f"""best AS (SELECT product_id, l.old_price, l.promotional_price, l.discount_percent,
      row_number() OVER (PARTITION BY product_id ORDER BY last_updated DESC, promotion_id DESC) AS rn
    FROM links l JOIN promotions r ON r.id = l.promotion_id
    WHERE starts_at <= TIMESTAMP '{AT_TEXT}' AND ends_at >= TIMESTAMP '{AT_TEXT}'),
  shown AS (SELECT p.id, p.promotion_state, p.price, {ACTIVE_SQL} AS active,
      CASE WHEN p.promotion_state IS NULL AND b.product_id IS NOT NULL THEN b.old_price ELSE p.old_price END AS old_price,
      CASE WHEN p.promotion_state IS NULL AND b.product_id IS NOT NULL THEN b.promotional_price ELSE p.promo_price END AS promo_price,
      CASE WHEN p.promotion_state IS NULL AND b.product_id IS NOT NULL THEN b.discount_percent ELSE p.discount_percent END
        AS discount_percent
    FROM products p LEFT JOIN best b ON b.product_id = p.id AND b.rn = 1)"""


@query("jn2_promotion_overlay", views(*PROMO_VIEWS, more=OVERLAY) + """SELECT id, active, CAST(old_price AS DOUBLE) AS old_price,
    CAST(promo_price AS DOUBLE) AS promo_price, CAST(discount_percent AS DOUBLE) AS discount_percent FROM shown""")
def promotion_overlay(s):
    return doubled(R.overlay_promotion(*_promo(s)).select("id", "active", "old_price", "promo_price", "discount_percent"))


EFFECTIVE_SQL = """CAST(CASE WHEN active THEN coalesce(promo_price, price)
    WHEN promotion_state = 'dated' AND price = promo_price THEN old_price ELSE price END AS DOUBLE) AS effective_price"""


@query("sc15_effective_price", views(*PROMO_VIEWS, more=OVERLAY) + f"SELECT id, {EFFECTIVE_SQL} FROM shown")
def shown_price(s):
    return doubled(R.with_effective_price(R.overlay_promotion(*_promo(s))).select("id", "effective_price"))


@query("flt4_needs_review", views("products") + "SELECT id FROM products WHERE trim(coalesce(sku, '')) = ''")
def needs_review(s):
    blank = F.trim(F.coalesce("sku", F.lit(""))) == ""
    return P.needs_review(products(s).withColumn("needs_review", blank)).select("id")


SUBTREE_SQL = """tree(id) AS (SELECT id FROM categories WHERE id = '/r1/' UNION ALL
    SELECT c.id FROM categories c JOIN tree t ON c.parent_id = t.id)"""


@query("flt5_filtered_products", views(*PROMO_VIEWS, "aliases", "members", "categories", more=SUBTREE_SQL) + f"""
    SELECT id, name FROM products p WHERE contains(lower(name || ' ' || coalesce(sku, '') || ' ' || coalesce(barcode, '')
      || ' ' || brand), 'small') AND category_id IN (SELECT id FROM tree)
      AND id IN (SELECT product_id FROM members WHERE collection_id = 'collection:7') AND {ACTIVE_SQL}""")
def filtered_products(s):
    tables = {"aliases": s.sql(B.ALIASES), "categories": s.sql(B.CATEGORIES), "members": s.sql(B.MEMBERS),
              "links": s.sql(B.PRODUCT_PROMOTIONS), "promotions": s.sql(B.PROMOTIONS)}
    rows = P.products(products(s), tables, moment(), "small", "/r1/", "collection:7", promotions=True)
    return rows.select("id", "name")


@query("lim4_listing_page", views("products") + """SELECT id, name FROM products
    ORDER BY lower(name), id LIMIT 60 OFFSET 120""")
def listing_page(s):
    return offset_page(products(s).select("id", "name"), P.name_order(), 120, 60)


@query("lim4_deep_page", """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity FROM lineitem
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 60 OFFSET (SELECT count(*) // 2 FROM lineitem)""")
def deep_page(s):
    """The page in the middle of all order lines by date; no task may skip more than 2 000 rows."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    lines = s.table("lineitem").select(order)
    return offset_page(lines, [F.col(c) for c in order], lines.count() // 2, 60, gathered=2_000).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")


@query("agg6_listing_counts", views(*PROMO_VIEWS) + f"""SELECT count(*) AS total,
    count(*) FILTER (WHERE {ACTIVE_SQL}) AS discounted FROM products p WHERE contains(lower(name), 'small')""")
def listing_counts(s):
    rows, links, promotions, at = _promo(s)
    return P.counts(rows.filter(F.lower("name").contains("small")), links, promotions, at)


@query("agg7_next_boundary", views("products", "promotions") + f"""SELECT CAST(min(m) AS VARCHAR) AS boundary FROM (
    SELECT ends_at AS m FROM promotions UNION ALL SELECT starts_at FROM promotions UNION ALL
    SELECT promotion_end FROM products WHERE promotion_state = 'dated' UNION ALL
    SELECT promotion_start FROM products WHERE promotion_state = 'dated') WHERE m > TIMESTAMP '{AT_TEXT}'""")
def next_boundary(s):
    return R.next_boundary(products(s), s.sql(B.PROMOTIONS), moment()).select(F.col("boundary").cast("string").alias("boundary"))


@query("win4_current_campaign", views("promotions") + """SELECT id, CAST(starts_at AS VARCHAR) AS starts_at FROM promotions
    WHERE type = '2-HIGH' ORDER BY ends_at DESC, id DESC LIMIT 1""")
def current_campaign(s):
    return R.current_campaign(s.sql(B.PROMOTIONS), "2-HIGH").select("id", F.col("starts_at").cast("string").alias("starts_at"))


@query("tree1_subtree", views("categories", more=SUBTREE_SQL) + "SELECT id FROM tree")
def subtree(s):
    return K.subtree(s.sql(B.CATEGORIES), "/r1/")


# Five nations name each other as parents in a ring; customers hang below all nations.
CYCLIC_TREE = """SELECT 'n' || CAST(n_nationkey AS STRING) AS id, n_name AS name, 'u' || CAST(n_nationkey AS STRING) AS source_url,
    CASE WHEN n_nationkey < 5 THEN 'n' || CAST((n_nationkey + 1) % 5 AS STRING) END AS parent_id FROM nation
  UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), c_name, 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING) FROM customer"""


@query("tree1_subtree_in_a_cycle", with_views(("nodes", CYCLIC_TREE)) + "SELECT id FROM nodes WHERE id IN ('n0', 'n1', 'n2', 'n3', 'n4') OR parent_id IN ('n0', 'n1', 'n2', 'n3', 'n4')")
def subtree_in_a_cycle(s):
    return K.subtree(s.sql(CYCLIC_TREE), "n0")


@query("tree3_unreached_nodes", with_views(("nodes", CYCLIC_TREE)) + "SELECT id FROM nodes WHERE parent_id IN ('n0', 'n1', 'n2', 'n3', 'n4')")
def unreached_nodes(s):
    return K.unreached(s.sql(CYCLIC_TREE)).select("id")


# Customers hang three nations further on, so some parents do not exist; region 4 has wrong levels.
FAULTY_TREE = """SELECT 'n' || CAST(n_nationkey AS STRING) AS id, CAST(NULL AS STRING) AS parent_id,
    CASE WHEN n_regionkey = 4 THEN 1 ELSE 0 END AS level FROM nation
  UNION ALL SELECT CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey + 3 AS STRING), 1 FROM customer"""


@query("tree2_integrity", with_views(("nodes", FAULTY_TREE)) + """SELECT c.id, CASE
      WHEN c.parent_id IS NOT NULL AND p.id IS NULL THEN 'unknown parent' ELSE 'level is not the depth' END AS error
    FROM nodes c LEFT JOIN nodes p ON p.id = c.parent_id
    WHERE (c.parent_id IS NOT NULL AND p.id IS NULL) OR c.level <> coalesce(p.level + 1, 0)""")
def tree_integrity(s):
    return K.check_tree(s.sql(FAULTY_TREE))


PATHS = """tree AS (SELECT id, id AS root_id, name AS root_name, '' AS sub_path, 0 AS depth FROM categories
    WHERE parent_id IS NULL UNION ALL SELECT c.id, t.root_id, t.root_name,
    CASE WHEN t.sub_path = '' THEN c.name ELSE t.sub_path || ' › ' || c.name END, t.depth + 1
    FROM categories c JOIN tree t ON c.parent_id = t.id)"""


@query("tree3_category_paths", views("categories", more=PATHS) + "SELECT * FROM tree")
def category_paths(s):
    return K.category_paths(s.sql(B.CATEGORIES))


@query("jn5_longest_prefix_category", views("categories") + """SELECT o.l_orderkey * 10 + o.l_linenumber AS id,
    coalesce((SELECT c.id FROM categories c WHERE starts_with('https://shop.example/r' || (o.l_suppkey % 7) || '/n'
      || o.l_suppkey % 30 || '/p' || o.l_partkey || '.html', c.source_url) ORDER BY length(c.source_url) DESC LIMIT 1), '/other/')
    AS category_id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem) AS o""")
def longest_prefix_category(s):
    seen = s.sql("""SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS id,
        l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || l_partkey AS line,
        'https://shop.example/r' || (l_suppkey % 7) || '/n' || (l_suppkey % 30) || '/p' || l_partkey || '.html' AS url
        FROM lineitem""")
    return K.category_for(seen, s.sql(B.CATEGORIES), "line", "url", F.lit("/other/")).select("id", "category_id")


@query("jn6_descendants_by_prefix", views("categories") + """SELECT id, level FROM categories
    WHERE starts_with(source_url, 'https://shop.example/r2/')""")
def descendants_by_prefix(s):
    return K.descendants_by_prefix(s.sql(B.CATEGORIES), "https://shop.example/r2/").select("id", "level")


@query("flt7_excluded_prefixes", """SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'http://')
    AND NOT starts_with(url, 'https://blog.')""")
def excluded_prefixes(s):
    return K.exclude_prefixes(s.table("pages").select("page_id", "url"), "url", ["http://", "https://blog."])


NAMED = """named AS (SELECT id, name AS path, 1 AS depth FROM categories WHERE parent_id IS NULL UNION ALL
    SELECT c.id, n.path || ' › ' || c.name, n.depth + 1 FROM categories c JOIN named n ON c.parent_id = n.id),
  asked AS (SELECT c_custkey, coalesce(r_name, 'NOWHERE') AS cat, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name || ' › lost'
      WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE n_name || ' › ' || c_name END AS sub
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_nationkey % 6)"""


@query("jn16_category_names", views("categories", more=NAMED) + """SELECT c_custkey,
    coalesce(d.id, m.id, t.id) AS category_id, CASE WHEN sub IS NULL THEN t.id IS NULL ELSE d.id IS NULL END AS needs_review
    FROM asked LEFT JOIN named t ON t.path = cat
    LEFT JOIN named m ON m.path = cat || ' › ' || split_part(sub, ' › ', 1)
    LEFT JOIN named d ON d.path = cat || ' › ' || sub""")
def category_names(s):
    asked = s.sql("""SELECT c_custkey, coalesce(r_name, 'NOWHERE') AS cat, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name || ' › lost'
        WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE n_name || ' › ' || c_name END AS sub
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_nationkey % 6""")
    found = K.resolve_category_path(asked, s.sql(B.CATEGORIES), "c_custkey", "cat", "sub")
    return found.select("c_custkey", "category_id", "needs_review")


