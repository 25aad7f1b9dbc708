"""Page extraction: the given pages, and shop-like markup that Spark derives from the given tables."""

from pyspark.sql import functions as F

from pricetrail.operators import extraction as E
from pricetrail.plans.observed import doubled, percent_sql
from pricetrail.plans.ingest import to_utc_sql
from pricetrail.plans.registry import query
from pricetrail.profile import ShopProfile

SHOP = ShopProfile()

# part -> a listing page of two cards: the product, and a loose good of the same number; larger sizes are restricted
LISTING = """SELECT p_partkey AS page_id, 'https://shop.example/list/' || p_partkey || '/' AS url, '<html><body>'
    || '<div class="ut2-gl__item x"><div class="ut2-gl__image"><img class="ty-pict" src="/images/thumbnails/200/200/' || p_partkey || '.jpg" srcset="/big/'
    || p_partkey || '.jpg 2x"></div><a class="product-title" href="/p/' || p_partkey || '.html?a=1&amp;b=2#t"> ' || p_name || ' <b>' || p_size || ' ml</b></a>'
    || CASE WHEN p_size > 45 THEN '<div class="ty-age-verification__block">18+</div>' ELSE '' END
    || '<input type="hidden" name="product_data[' || p_partkey || '][product_id]" value="' || CASE WHEN p_size = 1 THEN 'x' ELSE '' END || p_partkey || '">'
    || '<span id="sec_{P}discounted_price_' || p_partkey || '">' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || '<sup>'
    || lpad(CAST(p_size AS STRING), 2, '0') || '</sup> lei</span>'
    || CASE WHEN p_type = 'PROMO' THEN '<span id="sec_{P}list_price_' || p_partkey || '">' || CAST(CAST(floor(p_retailprice) AS BIGINT) + 10 AS STRING) || ',50 lei</span>' ELSE '' END
    || CASE WHEN p_type = 'ECONOMY' THEN '<span id="{D}' || p_partkey || '">-' || p_size || ',5%</span>' ELSE '' END
    || '<div id="product_code_' || p_partkey || '"><span class="ty-control-group__item">' || p_brand || '</span></div>'
    || CASE WHEN p_size > 30 THEN '<span class="ty-qty-in-stock">da</span>' WHEN p_size > 15 THEN '<span class="ty-qty-out-of-stock">nu</span>' ELSE '' END || '</div>'
    || '<div class="ut2-gl__item"><a class="product-title" href="/w/' || p_partkey || '">vrac</a><input name="a[product_id]" value="9' || p_partkey || '">'
    || '<div class="wp-product-pricing" data-wp-price-kg="' || p_size || '.00" data-wp-price-step="' || p_size || '.00" data-wp-step-g="1000"></div>'
    || '<span id="sec_{P}discounted_price_9">' || p_size || '</span></div>'
    || CASE WHEN p_size > 20 THEN '<a rel="next" href="?page=2">mai departe</a>' WHEN p_size > 10 THEN '<div data-ut2-load-more-url="http://other.example/x"></div>' ELSE '' END
    || '</body></html>' AS html FROM part"""
PLAIN = LISTING.replace("sec_{P}", "sec_").replace("{D}", "line_discount_value_")
CAMPAIGN = LISTING.replace("sec_{P}", "line_").replace("{D}", "line_discount_update_").replace(
    "'<html><body>'", """'<html><body><div class="ut2-gl__item">elsewhere</div><div id="promotions_view_pagination_contents"><form><input name="redirect_url"
      value="index.php?dispatch=promotions.view&amp;promotion_id=' || p_size || '"></form><script>var a = {current_promotion_id: ' ||
      CASE WHEN p_size = 7 THEN 8 ELSE p_size END || '};</script>'""").replace("'</body></html>'", "'</div></body></html>'")
CARDS_SQL = f"""SELECT p_partkey AS page_id, CASE WHEN p_size = 1 THEN 'x' ELSE '' END || p_partkey AS source_product_id, p_name || ' ' || p_size || ' ml' AS name,
      p_brand AS sku, p_size || ' ml' AS quantity, floor(p_retailprice) + p_size / 100 AS price, CASE WHEN p_type = 'PROMO' THEN floor(p_retailprice) + 10.5 END AS old_price,
      CASE WHEN p_type = 'ECONOMY' THEN p_size + 0.5 WHEN p_type = 'PROMO' THEN {percent_sql('CAST(floor(p_retailprice) + p_size / 100 AS DECIMAL(12,2))',
        'CAST(floor(p_retailprice) + 10.5 AS DECIMAL(12,2))')} END AS discount_percent,
      CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'observed' ELSE 'none' END AS promotion_state, 'https://shop.example/p/' || p_partkey || '.html?a=1&b=2' AS product_url,
      'https://shop.example/images/thumbnails/200/200/' || p_partkey || '.jpg' AS thumbnail_url, CASE WHEN p_size > 30 THEN TRUE WHEN p_size > 15 THEN FALSE END AS in_stock,
      CASE WHEN p_size = 1 THEN 'missing source product id' END AS error FROM part WHERE p_size <= 45
    UNION ALL SELECT p_partkey, '9' || p_partkey, 'vrac', NULL, '1 kg', p_size, NULL, NULL, 'none', 'https://shop.example/w/' || p_partkey, NULL, NULL, NULL FROM part"""
CARD_COLUMNS = ("page_id", "source_product_id", "name", "sku", "quantity", "price", "old_price", "discount_percent", "promotion_state",
                "product_url", "thumbnail_url", "in_stock", "error")


def spread(s, table, key):
    """The given tables are one small file each; parsing is bound by CPU, so their rows go to every core, before pages are made of them."""
    return s.table(table).repartition(s.spark.sparkContext.defaultParallelism, key)


def pages_of(s, text, table="part", key="p_partkey"):
    """Markup derived from the rows of one table."""
    return s.spark.sql(text.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", "FROM {rows}"), rows=spread(s, table, key))


def _listing(s, text=PLAIN, campaign=False):
    return E.read_listing(pages_of(s, text), SHOP, campaign)


@query("ext1_listing_cards", CARDS_SQL)
def listing_cards(s):
    return doubled(E.extract_cards(_listing(s), SHOP).select(*CARD_COLUMNS))


@query("ext1_page_states", """SELECT p_partkey AS page_id, 2 AS cards, CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS restricted_cards, FALSE AS page_restricted,
    CASE WHEN p_size = 1 THEN 'missing source product id' END AS refused FROM part""")
def page_states(s):
    return E.listing_states(_listing(s), SHOP)


@query("ext1_given_pages", "SELECT page_id, 0 AS cards, 0 AS restricted_cards, FALSE AS page_restricted, 'product list not recognized' AS refused FROM pages")
def given_pages(s):
    return E.listing_states(E.read_listing(spread(s, "pages", "page_id"), SHOP), SHOP)


@query("ext2_next_links", """SELECT p_partkey AS page_id, 'https://shop.example/list/' || p_partkey || '/' AS url,
    CASE WHEN p_size > 20 THEN 'https://shop.example/list/' || p_partkey || '/?page=2' END AS next_url,
    CASE WHEN p_size > 10 AND p_size <= 20 THEN 'unexpected source url' END AS error FROM part""")
def next_links(s):
    return E.next_links(_listing(s), SHOP)


# pages of one host form a chain in id order; hosts of http pages end where they began
EDGES = """SELECT url, host AS scope, first_url, CASE WHEN following IS NOT NULL THEN following WHEN starts_with(url, 'http:') THEN first_url END AS next_url FROM (
    SELECT page_id || '|' || url AS url, host, page_id, min_by(page_id || '|' || url, page_id) OVER (PARTITION BY host) AS first_url,
      lead(page_id || '|' || url) OVER (PARTITION BY host ORDER BY page_id) AS following
    FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) AS p) AS linked"""


@query("ext3_page_chains", f"""WITH e AS ({EDGES.replace("CASE WHEN following IS NOT NULL THEN following WHEN starts_with(url, 'http:') THEN first_url END", "following").replace('min_by(', 'arg_min(')}),
    l AS (SELECT scope, max(CASE WHEN next_url IS NULL AND contains(url, '|http:') THEN 1 ELSE 0 END) AS looped FROM e GROUP BY scope)
    SELECT e.scope, url, row_number() OVER (PARTITION BY e.scope ORDER BY CAST(split_part(url, '|', 1) AS BIGINT)) AS position,
      CASE WHEN looped = 1 THEN 'loop' ELSE 'complete' END AS state FROM e JOIN l USING (scope)""")
def page_chains(s):
    edges = s.sql(EDGES.replace("starts_with(url, 'http:')", "contains(url, '|http:')").replace("starts_with", "startswith"))
    return E.page_chain(edges, edges.select("scope", F.col("first_url").alias("url")).distinct())


@query("ext4_navigation", """WITH n AS (SELECT page_id, regexp_extract_all(split_part(html, '</nav>', 1), '<li><a href="([^"]*)">', 1) AS l FROM pages),
    u AS (SELECT page_id, unnest(l) AS id, generate_subscripts(l, 1) AS pos FROM n), d AS (SELECT page_id, id, min(pos) AS pos FROM u GROUP BY page_id, id)
    SELECT page_id, id, CASE WHEN pos > 1 THEN first_value(id) OVER (PARTITION BY page_id ORDER BY pos) END AS parent_id, CASE WHEN pos = 1 THEN 0 ELSE 1 END AS level,
      row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS sort_order FROM d""")
def navigation(s):
    shop = ShopProfile(category_group="nav", category_head="ul li a", category_link="ul a")
    nodes = E.extract_categories(spread(s, "pages", "page_id"), shop)
    return nodes.select("page_id", "id", "parent_id", "level", "sort_order")


NAVIGATION = """SELECT r_regionkey AS page_id, '<html><div class="ab-lc-group"><div class="head"><a href="/r' || r_regionkey || '/">' || r_name || '</a></div><ul>'
    || array_join(transform(array_sort(items), x -> x.li), '') || '</ul></div><div class="ab-lc-group"><ul><li><a href="/none/">none</a></li></ul></div></html>' AS html
  FROM region JOIN (SELECT n_regionkey, collect_list(named_struct('k', n_nationkey, 'li', '<li><a href="/r' || n_regionkey || '/n' || n_nationkey || '/">' || n_name
      || '</a><ul><li><a href="/r' || n_regionkey || '/n' || n_nationkey || '/new/">New</a></li><li><a href="/shared/' || floor(n_nationkey / 10) || '/">S</a></li></ul></li>')) AS items
    FROM nation GROUP BY n_regionkey) AS n ON n_regionkey = r_regionkey"""


@query("ext4_category_tree", """WITH n AS (SELECT *, '/r' || n_regionkey || '/n' || n_nationkey || '/' AS nid, n_nationkey // 10 AS g FROM nation),
    rows AS (SELECT r_regionkey AS page_id, '/r' || r_regionkey || '/' AS id, NULL AS parent_id, r_name AS name, 0 AS level, FALSE AS bad FROM region
      UNION ALL SELECT n_regionkey, nid, '/r' || n_regionkey || '/', n_name, 1, FALSE FROM n
      UNION ALL SELECT n_regionkey, nid || 'new/', nid, 'New', 2, FALSE FROM n
      UNION ALL SELECT n_regionkey, '/shared/' || g || '/', arg_min(nid, n_nationkey), 'S', 2, count(*) > 1 FROM n GROUP BY n_regionkey, g)
    SELECT page_id, id, parent_id, name, level, CASE WHEN bad THEN 'conflicting parents' END AS error FROM rows""")
def category_tree(s):
    return E.extract_categories(s.sql(NAVIGATION), SHOP).drop("sort_order", "source_url")


# orders -> shop front pages that advertise one or two campaign periods
FRONT = """SELECT o_orderkey AS page_id, '<div class="under__title">Noutăți</div><div class="under__title">Oferta valabilă în perioada 01.' || month(o_orderdate) || '.'
    || year(o_orderdate) || ' - 14.' || month(o_orderdate) || '.' || year(o_orderdate) || CASE WHEN o_orderpriority = '2-HIGH' THEN '' ELSE
    ' <a class="title__goto" href="/oferta/' || o_custkey || '/">vezi</a>' END || '</div>' || CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN
    '<div class="under__title">OFERTA VALABILĂ ÎN PERIOADA 1/' || month(o_orderdate) || '/' || year(o_orderdate) || ', ' || CASE WHEN o_orderpriority = '5-LOW' THEN 15 ELSE 14 END
    || '/' || month(o_orderdate) || '/' || year(o_orderdate) || '<a class="title__goto" href="/oferta/' || o_custkey || '/">vezi</a></div>' ELSE '' END AS html FROM orders"""


@query("ext5_campaign_discovery", f"""WITH d AS (SELECT *, make_date(year(o_orderdate), month(o_orderdate), 1) AS a, CAST(make_date(year(o_orderdate), month(o_orderdate), 1) AS TIMESTAMP) AS s,
      make_date(year(o_orderdate), month(o_orderdate), 14) + INTERVAL '86399999 milliseconds' AS e, CASE o_orderpriority WHEN '2-HIGH' THEN 'period has no product listing'
      WHEN '5-LOW' THEN 'campaigns differ' END AS error FROM orders)
    SELECT o_orderkey AS page_id, CASE WHEN error IS NULL THEN CAST(a AS VARCHAR) END AS start_date, CASE WHEN error IS NULL THEN CAST({to_utc_sql('s')} AS VARCHAR) END AS starts_at,
      CASE WHEN error IS NULL THEN CAST({to_utc_sql('e')} AS VARCHAR) END AS ends_at,
      CASE WHEN error IS NULL THEN 'https://shop.example/oferta/' || o_custkey || '/' END AS source_url, error FROM d""")
def campaign_discovery(s):
    found = E.discover_campaign(pages_of(s, FRONT, "orders", "o_orderkey"), SHOP)
    return found.select("page_id", *[F.col(c).cast("string").alias(c) for c in ("start_date", "starts_at", "ends_at")], "source_url", "error")


@query("ext5_promotion_ids", """SELECT p_partkey AS page_id, CASE WHEN p_size <> 7 THEN CAST(p_size AS VARCHAR) END AS promotion_id,
    CASE WHEN p_size = 7 THEN 'missing or conflicting promotion id' END AS error FROM part""")
def promotion_ids(s):
    return E.promotion_ids(_listing(s, CAMPAIGN, True), SHOP)


DETAIL = """SELECT CAST(p_partkey AS STRING) AS source_product_id, '<form><input name="product_data[' || p_partkey || '][product_id]" value="' || (p_partkey + CASE WHEN p_size = 1 THEN 1 ELSE 0 END)
    || '"><input name="product_data[77777777][product_id]" value="1"></form>' || CASE WHEN p_size > 48 THEN '<p class="ty-age-verification__txt">18+</p>' ELSE '' END
    || '<div id="product_code_' || p_partkey || '"><b class="ut2--sku-text">' || CASE WHEN p_size = 2 THEN 'no space' WHEN p_size = 3 THEN '' ELSE '00' || p_partkey END || '</b>'
    || CASE WHEN p_size = 4 THEN '<b class="ut2--sku-text">other</b>' ELSE '' END || '</div><div id="product_code_1234567"><b class="ut2--sku-text">wrong</b></div>' AS html FROM part"""


@query("ext6_detail_skus", """SELECT CAST(p_partkey AS VARCHAR) AS source_product_id, CASE WHEN p_size BETWEEN 5 AND 48 THEN '00' || p_partkey END AS sku,
    CASE WHEN p_size > 48 THEN NULL WHEN p_size = 1 THEN 'product identity not confirmed' WHEN p_size = 2 THEN 'invalid sku' WHEN p_size = 4 THEN 'conflicting sku values' END AS error FROM part""")
def detail_skus(s):
    return E.extract_skus(pages_of(s, DETAIL), SHOP)


FRAGMENTS = """SELECT CAST(p_partkey AS STRING) AS source_product_id, to_json(named_struct('html', map('warehouses_stock_availability_' || p_partkey,
    CASE WHEN p_size = 1 THEN '<p>gone</p>' ELSE '<div class="ty-warehouses-shipping__wrapper"><span class="ty-warehouses__geolocation__location">Oraș ' || p_size
    || '</span></div><div class="ty-warehouses-shipping__item"><span class="ty-warehouses-shipping__label">' || p_brand || '</span><span class="ty-warehouses-shipping__value">'
    || p_type || '</span></div><div class="ty-warehouses-shipping__item"><span class="ty-warehouses-shipping__label">alone</span></div>' END))) AS response FROM part"""


@query("ext7_stock_rows", """SELECT CAST(p_partkey AS VARCHAR) AS source_product_id, CASE WHEN p_size > 1 THEN 'Oraș ' || p_size END AS context,
    CASE WHEN p_size > 1 THEN p_brand END AS label, CASE WHEN p_size > 1 THEN p_type END AS value,
    CASE WHEN p_size = 1 THEN 'stock fragment unavailable' END AS error FROM part""")
def stock_rows(s):
    return E.extract_stock(pages_of(s, FRAGMENTS), SHOP).drop("position")


@query("ext8_campaign_cards", CARDS_SQL)
def campaign_cards(s):
    return doubled(E.extract_cards(_listing(s, CAMPAIGN, True), SHOP, campaign=True).select(*CARD_COLUMNS))


# lines of an order are the listing pages of a campaign, events of a customer its advertised periods
CAMPAIGN_PAGES = """SELECT l_orderkey AS campaign, l_linenumber AS page_id, CASE WHEN l_returnflag = 'A' AND l_discount > 0.05 THEN '2' ELSE '1' END AS promotion_id,
    CAST(l_quantity AS BIGINT) - 1 AS products, CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS restricted_cards, FALSE AS page_restricted,
    l_linenumber = 7 AND l_returnflag = 'R' AS escaped, CASE WHEN l_extendedprice < 2000 THEN 'unreadable' END AS error FROM lineitem"""
CAMPAIGN_PERIODS = """SELECT o_orderkey AS campaign, 'before' AS moment, o_orderdate AS starts_at, o_orderdate + INTERVAL '7' DAY AS ends_at, 'u' AS source_url FROM orders
    UNION ALL SELECT o_orderkey, 'after', o_orderdate, o_orderdate + INTERVAL '7' DAY, CASE WHEN o_orderstatus = 'P' THEN 'v' ELSE 'u' END FROM orders WHERE o_orderpriority <> '5-LOW'"""


@query("val2_campaign_errors", """SELECT l_orderkey AS campaign, concat_ws(',', CASE WHEN min(l_extendedprice) < 2000 THEN 'unreadable page' END,
      CASE WHEN count(DISTINCT CASE WHEN l_returnflag = 'A' AND l_discount > 0.05 THEN 2 ELSE 1 END) > 1 THEN 'promotion id changed' END,
      CASE WHEN any_value(o_orderpriority) = '5-LOW' THEN 'period not confirmed' END,
      CASE WHEN any_value(o_orderpriority) <> '5-LOW' AND any_value(o_orderstatus) = 'P' THEN 'advertised period changed' END,
      CASE WHEN max(l_tax) > 0.07 THEN 'restricted products' END, CASE WHEN sum(CAST(l_quantity AS BIGINT) - 1) = 0 THEN 'empty campaign' END,
      CASE WHEN bool_or(l_linenumber = 7 AND l_returnflag = 'R') THEN 'pagination left the listing' END) AS errors
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def campaign_errors(s):
    found = E.campaign_errors(s.sql(CAMPAIGN_PAGES), s.sql(CAMPAIGN_PERIODS))
    return found.withColumn("errors", F.array_join("errors", ","))


@query("val2_listing_route", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber > 3 AS leaves FROM lineitem""")
def listing_route(s):
    rows = s.sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'https://shop.example/o/' || l_orderkey || '/' AS listing,
        'https://shop.example/o/' || l_orderkey || CASE l_linenumber WHEN 1 THEN '?page=2' WHEN 2 THEN '/page-2/' WHEN 3 THEN '/page-' || l_partkey
          WHEN 4 THEN '/x/page-2/' WHEN 5 THEN '9/' ELSE '/page-x' END AS following FROM lineitem""")
    leaves = E.leaves_listing(F.col("following"), F.col("listing"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", leaves.alias("leaves"))
