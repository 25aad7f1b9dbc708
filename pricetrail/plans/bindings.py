"""How the given tables stand in for catalog tables.

These texts only rename and derive input columns; both Spark and the SQL twin start from them.
"""

# part -> catalog products, with missing, blank and valid SKUs and every promotion state
PRODUCTS = """
SELECT 'shop:' || p_partkey AS id, CAST(p_partkey AS STRING) AS source_product_id,
  CASE WHEN p_size <= 5 THEN NULL WHEN p_size <= 7 THEN '' WHEN p_size <= 9 THEN '  '
       WHEN p_size = 10 THEN p_brand ELSE replace(p_brand, '#', '-') || '-' || p_partkey END AS sku,
  CASE WHEN p_size > 20 THEN lpad(CAST(p_partkey AS STRING), 13, '0') END AS barcode,
  p_name AS name, p_brand AS brand,
  CASE WHEN p_type = 'MEDIUM' THEN '1 kg' END AS quantity,
  CASE WHEN p_size <> 50 THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS price,
  CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN CAST(p_retailprice + p_size AS DECIMAL(12,2)) END AS old_price,
  CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS promo_price,
  CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN CAST(p_size AS DECIMAL(6,2)) END AS discount_percent,
  CASE p_type WHEN 'PROMO' THEN 'dated' WHEN 'ECONOMY' THEN 'observed' WHEN 'STANDARD' THEN NULL
       ELSE 'none' END AS promotion_state,
  CASE WHEN p_type = 'PROMO' THEN TIMESTAMP '1998-01-01 00:00:00' + INTERVAL '7' DAY * p_size END AS promotion_start,
  CASE WHEN p_type = 'PROMO' THEN TIMESTAMP '1998-01-15 00:00:00' + INTERVAL '7' DAY * p_size END AS promotion_end,
  '/r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/' AS category_id,
  'https://shop.example/r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/p'
    || p_partkey || '.html' AS product_url,
  CASE WHEN p_size > 40 THEN 'https://shop.example/images/thumbnails/400/400/' || p_partkey || '.jpg'
       WHEN p_size > 3 THEN 'https://shop.example/images/thumbnails/200/' || (p_size * 10) || '/' || p_partkey || '.jpg'
       END AS thumbnail_url,
  CASE WHEN p_size > 30 THEN TRUE WHEN p_size > 15 THEN FALSE END AS in_stock,
  p_size >= 46 AS possibly_inactive, p_size >= 48 AS inactive,
  CASE WHEN p_size >= 48 THEN 3 WHEN p_size >= 46 THEN 1 ELSE 0 END AS missing_count,
  p_partkey + 1 AS version
FROM part JOIN nation ON n_nationkey = p_size % 25
"""

# lineitem -> one observation per product: its newest line
OBSERVATIONS = """
SELECT 'shop:' || l_partkey AS id, CAST(l_partkey AS STRING) AS source_product_id,
  CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN 'S-' || l_suppkey ELSE 'Brand-1-' || l_partkey END AS sku,
  CASE WHEN l_linestatus = 'F' THEN lpad(CAST(l_partkey AS STRING), 13, '0') END AS barcode,
  'line ' || l_linenumber AS name,
  CASE WHEN l_linenumber > 2 THEN 'Brand#' || l_linenumber END AS brand,
  CASE WHEN l_quantity <= 40 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS price,
  CASE WHEN l_quantity <= 20 THEN CAST(l_extendedprice + l_quantity AS DECIMAL(12,2)) END AS list_price,
  CASE WHEN l_linenumber = 1 THEN '1 kg' END AS quantity,
  'https://shop.example/r1/n1/p' || l_partkey || '.html' AS product_url,
  CASE WHEN l_linenumber < 6 THEN 'https://shop.example/images/detailed/'
       || (l_partkey + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END) || '.jpg' END AS img,
  l_shipdate AS observed_at
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC,
        l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS place FROM lineitem) AS newest
WHERE place = 1
"""

# supplier codes as further barcodes of a product
ALIASES = """
SELECT DISTINCT CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS barcode,
  'shop:' || l_partkey AS product_id FROM lineitem
"""

# The same rows, repeated as the lines repeat them, and their codes alone, whose copies vanish while they are numbers
ALIAS_ROWS = """
SELECT CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS barcode, 'shop:' || l_partkey AS product_id
FROM lineitem
"""
ALIAS_CODES = """
SELECT CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS barcode
FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem) AS lines
"""

# events -> change log
CHANGES = """
SELECT event_id + 1 AS version,
  CASE event_type WHEN 'view' THEN 'product' WHEN 'click' THEN 'category' WHEN 'purchase' THEN 'promotion'
       WHEN 'signup' THEN 'collection' ELSE 'identifier' END AS kind,
  CAST(user_id AS STRING) AS entity_id, props AS payload
FROM events
"""

# events -> sync runs of a source
RUNS = """
SELECT event_id AS id, CAST(user_id AS STRING) AS source, ts AS started_at, ts + INTERVAL '1' HOUR AS finished_at,
  CASE event_type WHEN 'view' THEN 'complete' WHEN 'click' THEN 'partial' WHEN 'purchase' THEN 'complete'
       WHEN 'signup' THEN 'running' ELSE 'interrupted' END AS status,
  CASE WHEN value < 20 THEN 'full' ELSE 'selected' END AS scope,
  event_type = 'view' AND value < 20 AS price_refresh_complete,
  CASE WHEN event_type = 'error' AND value > 10 THEN 'access_denied' END AS source_error
FROM events
"""

# region -> nation -> customer as a category tree; ids are URL paths
CATEGORIES = """
SELECT '/r' || CAST(r_regionkey AS STRING) || '/' AS id, CAST(NULL AS STRING) AS parent_id, r_name AS name, 0 AS level,
  CAST(r_regionkey AS BIGINT) AS sort_order,
  'https://shop.example/r' || CAST(r_regionkey AS STRING) || '/' AS source_url
FROM region
UNION ALL
SELECT '/r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/',
  '/r' || CAST(n_regionkey AS STRING) || '/', n_name, 1, CAST(n_nationkey AS BIGINT),
  'https://shop.example/r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/'
FROM nation
UNION ALL
SELECT '/r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/c' || CAST(c_custkey AS STRING) || '/',
  '/r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/', c_name, 2, c_custkey,
  'https://shop.example/r' || CAST(n_regionkey AS STRING) || '/n' || CAST(n_nationkey AS STRING) || '/c'
    || CAST(c_custkey AS STRING) || '/'
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

# orders -> promotions, lineitem -> which products they cover
PROMOTIONS = """
SELECT 'promo:' || o_orderkey AS id, o_orderpriority AS type, o_orderdate AS starts_at,
  o_orderdate + INTERVAL '7' DAY AS ends_at, o_orderdate + INTERVAL '1' DAY * (o_custkey % 5) AS last_updated
FROM orders
"""
PRODUCT_PROMOTIONS = """
SELECT 'shop:' || l_partkey AS product_id, 'promo:' || l_orderkey AS promotion_id,
  max(CAST(l_extendedprice AS DECIMAL(12,2))) AS old_price, max(CAST(l_quantity AS DECIMAL(12,2))) AS promotional_price,
  max(CAST(l_discount AS DECIMAL(6,2))) AS discount_percent
FROM lineitem GROUP BY l_partkey, l_orderkey
"""

# lineitem -> rows of an identifier file: pairs repeat, some are contradictory (every 16th order writes its
# neighbour's SKU), some lack the SKU; many belong to products
PAIRS = """
SELECT l_orderkey * 10 + l_linenumber AS row_number,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL
       ELSE coalesce(replace(p_brand, '#', '-') || '-' || p_partkey, 'X-' || o_orderkey) END AS sku,
  CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_orderkey AS STRING), 13, '0')
       ELSE CAST(o_custkey AS STRING) || '-' || CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) END AS barcode,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'empty identifier' END AS error
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
LEFT JOIN part ON p_partkey = o_orderkey + CASE WHEN o_orderkey % 16 = 0 THEN 1 ELSE 0 END
"""

# orders -> pairs stored by earlier files, in every status
PENDING_ROWS = """
SELECT sku, barcode, status, CASE WHEN status = 'matched' THEN owner END AS product_id
FROM (SELECT DISTINCT coalesce(replace(p_brand, '#', '-') || '-' || p_partkey, 'X-' || o_orderkey) AS sku,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'old-' || o_custkey
         WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_orderkey AS STRING), 13, '0')
         ELSE CAST(o_custkey AS STRING) || '-' || CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) END AS barcode,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'needsReview'
         WHEN o_orderstatus = 'P' AND p_partkey IS NOT NULL THEN 'matched' ELSE 'pending' END AS status,
    'shop:' || p_partkey AS owner
  FROM orders LEFT JOIN part ON p_partkey = o_orderkey) AS stored
"""
# The SQL twin's form, with the pair's key
PENDING = f"""SELECT sha256('["' || sku || '", "' || barcode || '"]') AS id, * FROM ({PENDING_ROWS}) AS keyed"""

# lineitem -> collections (one per supplier) and their members
MEMBERS = """
SELECT DISTINCT 'collection:' || l_suppkey AS collection_id, 'shop:' || l_partkey AS product_id FROM lineitem
"""
# The same rows; copies vanish while they are numbers
MEMBER_ROWS = """
SELECT 'collection:' || l_suppkey AS collection_id, 'shop:' || l_partkey AS product_id
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) AS lines
"""
