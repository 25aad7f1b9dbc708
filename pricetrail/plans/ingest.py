"""Sources, sinks, replica writes and scalar functions over the given tables."""

import uuid

from pyspark.sql import functions as F

from pricetrail.functions import money as V
from pricetrail.functions import periods as T
from pricetrail.functions import text as X
from pricetrail.functions import urls as L
from pricetrail.operators import categories as K
from pricetrail.operators import replica as P
from pricetrail.operators import upsert as U
from pricetrail.plans import bindings as B
from pricetrail.plans.identity import MATCH_SQL, _pending
from pricetrail.plans.observed import BATCH_SQL, UPSERT_SQL, _upserted, doubled, percent_sql
from pricetrail.plans.registry import query, with_views
from pricetrail.session import shared_dir, stored
from pricetrail.sources import identifier_files as D
from pricetrail.sources import search_json as J
from pricetrail.sources import sinks as S

HOST = "shop.example"
VIEWS = (("products", B.PRODUCTS), ("observed", B.OBSERVATIONS), ("aliases", B.ALIASES), ("pairs", B.PAIRS),
         ("categories", B.CATEGORIES), ("runs", B.RUNS))


def views(*names, more=""):
    chosen = [v for v in VIEWS if v[0] in names]
    return with_views(*chosen).rstrip() + (f", {more} " if more else " ")


def scratch(s, name):
    """A new folder under the shared one."""
    return f"{shared_dir(s.spark)}/{name}-{uuid.uuid4().hex}"


@query("src2_src3_identifier_file", views("pairs") + """SELECT CASE WHEN sku IS NULL THEN NULL ELSE trim(sku) END AS sku, barcode,
    'part ' || barcode AS name FROM pairs""")
def identifier_file(s):
    folder = scratch(s, "identifiers")
    rows = s.sql(B.PAIRS).select(F.concat(F.lit(" "), "sku").alias("Cod SKU"), F.col("barcode").alias("EAN"),
                                 F.concat(F.lit("part "), "barcode").alias("Denumire"), F.lit("x").alias("Altele"))
    rows.write.option("header", True).option("sep", ";").csv(folder)
    typed = D.type_import_lines(D.map_headers(D.read_identifier_csv(s.spark, folder)))
    return typed.select("sku", "barcode", "name")


@query("src2_quoted_records", views("pairs") + """SELECT sku, barcode, CASE WHEN row_number % 10 = 3 THEN 'two' || chr(10) || 'lines; "' || barcode || '"' ELSE 'part ' || barcode END AS name
    FROM pairs WHERE sku IS NOT NULL""")
def quoted_records(s):
    """Files whose records partly go on over lines, each written by one task, with its own header."""
    folder = scratch(s, "quoted")
    name = F.when(F.col("row_number") % 10 == 3, F.concat(F.lit('two\nlines; "'), "barcode", F.lit('"'))).otherwise(F.concat(F.lit("part "), "barcode"))
    rows = s.sql(B.PAIRS).filter("sku IS NOT NULL").select(F.col("sku").alias("Cod SKU"), F.col("barcode").alias("EAN"), name.alias("Denumire"))
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(folder)
    return D.map_headers(D.read_identifier_csv(s.spark, folder)).select("sku", "barcode", "name")


LINES = """SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_linenumber = 1 THEN '#UNSAFE_NUMBER:1.5' WHEN l_linenumber = 2 THEN l_partkey || 'E4' WHEN l_linenumber = 3 THEN ' '
      ELSE ' 00' || l_partkey || '.0' END AS sku,
    CASE WHEN l_linenumber = 4 AND l_returnflag = 'A' THEN NULL WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN NULL ELSE 'B' || l_suppkey END AS barcode,
    CASE l_returnflag WHEN 'N' THEN 'n/a' WHEN 'A' THEN replace(CAST(l_extendedprice AS STRING), '.', ',') ELSE CAST(-l_quantity AS STRING) END AS price,
    CAST(CAST(l_quantity * 3 AS INT) AS STRING) || ' %' AS discount_percent, CASE WHEN l_linenumber = 6 THEN '#FORMULA' ELSE ' x ' END AS name
  FROM lineitem"""


@query("src4_typed_lines", f"""WITH t AS ({LINES}), e AS (SELECT *, CASE WHEN l_linenumber = 1 THEN 'unsafe numeric identifier'
      WHEN l_linenumber = 2 THEN 'invalid identifier text' WHEN price = 'n/a' OR starts_with(price, '-') THEN 'invalid value for price'
      WHEN CAST(replace(discount_percent, ' %', '') AS INT) > 100 THEN 'invalid value for discount_percent'
      WHEN name = '#FORMULA' THEN 'replace formulas by values' WHEN trim(sku) = '' AND barcode IS NULL THEN 'sku and barcode are missing' END AS error FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 3 THEN '00' || l_partkey END AS sku, barcode,
      CASE WHEN price <> 'n/a' AND NOT starts_with(price, '-') THEN CAST(replace(price, ',', '.') AS DOUBLE) END AS price, error,
      CASE WHEN error IS NOT NULL THEN price END AS raw_price FROM e""")
def typed_lines(s):
    typed = D.type_import_lines(s.sql(LINES))
    return typed.select("l_orderkey", "l_linenumber", "l_partkey", "sku", "barcode", F.col("price").cast("double").alias("price"), "error",
                        F.col("raw.price").alias("raw_price"))


# part -> stored search responses of 16 products, ten pages to a query; some sizes carry faults
PAGE_OF = "CAST(floor(p_partkey / 16) AS BIGINT)"
PRODUCT_JSON = """to_json(named_struct(
    'product_id', CASE WHEN p_size = 4 THEN 'x' ELSE '' END || p_partkey, 'name', CASE WHEN p_size = 1 THEN '  ' ELSE ' ' || p_name || ' ' END,
    'url', CASE WHEN p_size = 3 THEN 'http://elsewhere.example/' ELSE '/p/' END || p_partkey || '.html#top',
    'price', CASE WHEN p_size = 2 THEN 'gratis' ELSE replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING), '.', ',') || ' lei' END,
    'list_price', CASE WHEN p_type = 'PROMO' THEN CAST(CAST(p_retailprice + p_size AS DECIMAL(12,2)) AS STRING) || 'lei' END,
    'brand', CASE WHEN p_size = 9 THEN '' ELSE p_brand END, 'category', p_type, 'img', CASE WHEN p_size > 10 THEN '/images/' || p_partkey || '.jpg' END,
    'cart_available', p_size > 25))"""
RESPONSES = f"""SELECT 'q' || CAST(floor(page / 10) AS BIGINT) AS query, (page % 10) * 16 AS offset, 16 AS limit,
    '{{"success":{{"products":[' || array_join(transform(array_sort(items), x -> x.j), ',') || '],"brands":[],"categories":[],'
      || '"settings":{{"need_auth":false,"show_prices":true}},"meta":{{"query":"q' || CAST(floor(page / 10) AS BIGINT) || '","offset":' || (page % 10) * 16
      || ',"limit":16,"returned":' || (n + CASE WHEN biggest = 50 THEN 1 ELSE 0 END) || ',"total":' || total || ',"has_more":'
      || CASE WHEN (page % 10) * 16 + n < total THEN 'true,"next_offset":' || ((page % 10) * 16 + n) ELSE 'false,"next_offset":null' END
      || '}}}},"notifications":{{}}}}' AS response
  FROM (SELECT {PAGE_OF} AS page, count(*) AS n, max(p_size) AS biggest, collect_list(named_struct('k', p_partkey, 'j', {PRODUCT_JSON})) AS items
        FROM part GROUP BY 1) AS pages
  JOIN (SELECT CAST(floor({PAGE_OF} / 10) AS BIGINT) AS q, count(*) AS total FROM part GROUP BY 1) AS totals ON q = CAST(floor(page / 10) AS BIGINT)"""
PAGES_SQL = f"""WITH pages AS (SELECT {PAGE_OF} AS page, count(*) AS n, max(p_size) AS biggest FROM part GROUP BY 1),
    totals AS (SELECT CAST(floor({PAGE_OF} / 10) AS BIGINT) AS q, count(*) AS total FROM part GROUP BY 1),
    j AS (SELECT *, 'q' || q AS query, (page % 10) * 16 AS "offset" FROM pages JOIN totals ON q = CAST(floor(page / 10) AS BIGINT)) """


def _responses(s):
    return s.sql(RESPONSES)


@query("src5_search_products", f"""SELECT 'q' || CAST(floor({PAGE_OF} / 10) AS BIGINT) AS query, CASE WHEN p_size = 4 THEN 'x' ELSE '' END || p_partkey AS source_product_id,
    CASE WHEN p_size = 1 THEN '' ELSE p_name END AS name, CASE WHEN p_size <> 3 THEN 'https://shop.example/p/' || p_partkey || '.html' END AS product_url,
    CASE WHEN p_size <> 2 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) END AS price,
    CASE WHEN p_type = 'PROMO' THEN CAST(CAST(p_retailprice + p_size AS DECIMAL(12,2)) AS DOUBLE) END AS list_price,
    CASE WHEN p_size <> 9 THEN p_brand END AS brand, CASE WHEN p_size > 10 THEN 'https://shop.example/images/' || p_partkey || '.jpg' END AS img,
    p_size > 25 AS cart_available, CASE WHEN p_type = 'PROMO' AND p_size <> 2 THEN
      {percent_sql('CAST(p_retailprice AS DECIMAL(12,2))', 'CAST(p_retailprice + p_size AS DECIMAL(12,2))')} END AS discount_percent FROM part""")
def search_products(s):
    rows = J.search_products(_responses(s), HOST)
    return doubled(rows.select("query", "source_product_id", "name", "product_url", "price", "list_price", "brand", "img",
                               "cart_available", "discount_percent"))


@query("val1_product_errors", """SELECT p_partkey, CASE p_size WHEN 1 THEN 'missing product name' WHEN 2 THEN 'invalid price' WHEN 3 THEN 'invalid source url'
    WHEN 4 THEN 'missing product id' ELSE '' END AS errors FROM part""")
def product_errors(s):
    rows = J.search_products(_responses(s), HOST)
    key = F.regexp_replace("source_product_id", "x", "").cast("long")
    return rows.select(key.alias("p_partkey"), F.array_join("errors", ",").alias("errors"))


@query("val3_envelope_errors", PAGES_SQL + """SELECT query, "offset", total, CASE WHEN biggest = 50 THEN 'count_differs' ELSE '' END AS errors FROM j""")
def envelope_errors(s):
    return J.envelope(_responses(s)).select("query", F.col("offset").cast("long").alias("offset"), "total", F.array_join("errors", ",").alias("errors"))


@query("lim8_page_sets", PAGES_SQL + """SELECT query, count(*) AS pages, max(total) AS total,
    CAST(sum(n + CASE WHEN biggest = 50 THEN 1 ELSE 0 END) AS BIGINT) AS returned,
    CASE WHEN sum(n + CASE WHEN biggest = 50 THEN 1 ELSE 0 END) <> max(total) THEN 'page set is not complete' ELSE '' END AS errors FROM j GROUP BY query""")
def page_sets(s):
    return J.page_sets(J.envelope(_responses(s))).withColumn("errors", F.array_join("errors", ","))


@query("snk1_published_log", views("products", "observed", more=BATCH_SQL + ", " + UPSERT_SQL) + """SELECT 100 + row_number() OVER (ORDER BY id) AS version,
    'product' AS kind, id AS entity_id, 100 + row_number() OVER (ORDER BY id) AS payload_version, name FROM m WHERE outcome IN ('added', 'updated')""")
def published_log(s):
    folder = scratch(s, "log")
    S.found_log(s.spark, folder, 100)
    log = S.publish(U.upsert_events(_upserted(s), "product"), 100, folder)
    own = F.get_json_object("payload", "$.version").cast("long")
    return log.select("version", "kind", "entity_id", own.alias("payload_version"), F.get_json_object("payload", "$.name").alias("name"))


EXPORT_SQL = """tree AS (SELECT id, name AS root, '' AS sub FROM categories WHERE parent_id IS NULL UNION ALL
      SELECT c.id, t.root, CASE WHEN t.sub = '' THEN c.name ELSE t.sub || ' › ' || c.name END FROM categories c JOIN tree t ON c.parent_id = t.id),
    rows AS (SELECT id, barcode FROM products UNION ALL SELECT p.id, a.barcode FROM products p JOIN aliases a ON a.product_id = p.id
      WHERE a.barcode IS DISTINCT FROM p.barcode)"""


@query("snk2_export_rows", views("products", "aliases", "categories", more=EXPORT_SQL) + """SELECT coalesce(p.sku, '') AS sku, coalesce(r.barcode, '') AS barcode,
    p.name, coalesce(t.root, '') AS category, coalesce(t.sub, '') AS subcategory, p.brand, CAST(p.price AS DOUBLE) AS price
    FROM rows r JOIN products p ON p.id = r.id LEFT JOIN tree t ON t.id = p.category_id""")
def export_rows(s):
    rows = S.export_rows(s.sql(B.PRODUCTS), s.sql(B.CATEGORIES), s.sql(B.ALIASES))
    price = F.when(F.col("Preț") != "", F.col("Preț")).cast("double")
    return rows.select(F.col("SKU").alias("sku"), F.col("Cod de bare").alias("barcode"), F.col("Denumire").alias("name"),
                       F.col("Categorie").alias("category"), F.col("Subcategorie").alias("subcategory"), F.col("Brand").alias("brand"),
                       price.alias("price"))


@query("snk3_run_history", views("runs") + """SELECT source AS sync_type, status, CAST(finished_at AS VARCHAR) AS finished_at FROM runs""")
def run_history(s):
    folder = scratch(s, "history")
    S.append_history(s.sql(B.RUNS).withColumnRenamed("source", "sync_type"), folder, "sync")
    return s.spark.read.parquet(folder).select("sync_type", "status", F.col("finished_at").cast("string").alias("finished_at"))


# observations as incoming replica rows; some lost their source id, some are new
REPLICA_BATCH = """SELECT CASE WHEN quantity = '1 kg' THEN 'new:' || source_product_id ELSE id END AS id,
    CASE WHEN quantity = '1 kg' THEN NULL ELSE source_product_id END AS source_product_id, sku, barcode, name, brand, price FROM observed"""
REPLICA_STATE = """SELECT id, source_product_id, sku, barcode, name, brand, price, product_url, trim(coalesce(sku, '')) = '' AS needs_review FROM products"""
REPLICA_SQL = f"""incoming AS (SELECT id AS line, *, CAST(NULL AS VARCHAR) AS product_url FROM ({REPLICA_BATCH})), {MATCH_SQL},
  crowd AS (SELECT product_id FROM matched WHERE n = 1 GROUP BY product_id HAVING count(*) > 1),
  loose AS (SELECT a.line, a.kind, a.value, m.n IS NULL AS fresh FROM asked a LEFT JOIN matched m USING (line) WHERE a.value IS NOT NULL AND coalesce(m.n, 1) = 1),
  edge AS (SELECT DISTINCT a.line AS x, b.line AS y FROM loose a JOIN loose b USING (kind, value)),
  reach(x, y) AS (SELECT line, line FROM incoming UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y),
  grp AS (SELECT r.x AS line, min(r.y) FILTER (m.n IS NULL) AS root, bool_or(m.n IS NOT NULL) AS claimed FROM reach r LEFT JOIN matched m ON m.line = r.y GROUP BY r.x),
  fresh AS (SELECT i.*, g.root, g.claimed FROM incoming i JOIN grp g USING (line) LEFT JOIN matched m USING (line) WHERE m.n IS NULL),
  firsts AS (SELECT root, arg_min(sku, line) FILTER (sku IS NOT NULL) AS fsku, arg_min(barcode, line) FILTER (barcode IS NOT NULL) AS fbar,
      arg_min(source_product_id, line) FILTER (source_product_id IS NOT NULL) AS fsrc FROM fresh GROUP BY root),
  grown AS (SELECT f.line, f.root, f.claimed, f.line <> f.root AS later, coalesce(f.sku <> fsku, FALSE) OR coalesce(f.barcode <> fbar, FALSE)
      OR coalesce(f.source_product_id <> fsrc, FALSE) AS differs FROM fresh f JOIN firsts USING (root)),
  j AS (SELECT i.line, m.n, p.id AS pid, p.sku AS ps, i.sku AS bs, p.barcode AS pb, i.barcode AS bb, p.source_product_id AS psrc, i.source_product_id AS bsrc,
      p.name AS pn, i.name AS bn, p.brand AS pr, i.brand AS br, p.price AS pp, i.price AS bp, g.root, g.later, g.differs, coalesce(m.n > 1, FALSE) OR
      coalesce(m.n = 1 AND m.product_id IN (SELECT product_id FROM crowd), FALSE) OR coalesce(g.claimed, FALSE) AS contra
    FROM incoming i LEFT JOIN matched m ON m.line = i.line LEFT JOIN products p ON m.n = 1 AND p.id = m.product_id LEFT JOIN grown g ON g.line = i.line)"""


def _replica(s, online):
    state = s.spark.sql(REPLICA_STATE.replace("FROM products", "FROM {p}"), p=s.sql(B.PRODUCTS))
    batch = s.spark.sql(REPLICA_BATCH.replace("FROM observed", "FROM {o}"), o=s.sql(B.OBSERVATIONS))
    return P.replica_upsert(state, s.sql(B.ALIAS_ROWS), batch, online)


@query("ups3_replica_import", views("products", "observed", "aliases", more=REPLICA_SQL) + """SELECT line AS incoming_id, coalesce(pid, root, line) AS product_id,
    CASE WHEN contra THEN 'conflict' WHEN n IS NULL AND NOT later THEN 'added' ELSE 'updated' END AS outcome FROM j""")
def replica_import(s):
    return _replica(s, False)["outcomes"]


@query("ups3_replica_online", views("products", "observed", "aliases", more=REPLICA_SQL) + """SELECT line AS incoming_id, coalesce(pid, root, line) AS product_id,
    CASE WHEN contra OR (n IS NULL AND later AND differs) OR (pid IS NOT NULL AND (coalesce(ps <> bs, FALSE) OR coalesce(pb <> bb, FALSE) OR coalesce(psrc <> bsrc, FALSE))) THEN 'conflict'
      WHEN n IS NULL THEN CASE WHEN later THEN 'updated' ELSE 'added' END WHEN coalesce(bn, pn) IS NOT DISTINCT FROM pn AND coalesce(br, pr) IS NOT DISTINCT FROM pr
        AND coalesce(bs, ps) IS NOT DISTINCT FROM ps AND coalesce(bb, pb) IS NOT DISTINCT FROM pb AND bp IS NOT DISTINCT FROM pp THEN 'unchanged'
      ELSE 'updated' END AS outcome FROM j""")
def replica_online(s):
    return _replica(s, True)["outcomes"]


@query("ups3_replica_state", views("products", "observed", "aliases", more=REPLICA_SQL) + """, w AS (SELECT pid AS id, coalesce(bs, ps) AS sku,
      coalesce(pb, bb) AS barcode, coalesce(bn, pn) AS name, CAST(bp AS DOUBLE) AS price FROM j WHERE NOT contra AND n IS NOT NULL
    UNION ALL SELECT root, arg_max(bs, line) FILTER (bs IS NOT NULL), arg_min(bb, line) FILTER (bb IS NOT NULL), arg_max(bn, line) FILTER (bn IS NOT NULL),
      CAST(arg_max(struct_pack(p := bp), line).p AS DOUBLE) FROM j WHERE NOT contra AND n IS NULL GROUP BY root)
    SELECT * FROM w UNION ALL SELECT id, sku, barcode, name, CAST(price AS DOUBLE) FROM products WHERE id NOT IN (SELECT id FROM w)""")
def replica_state(s):
    return doubled(_replica(s, False)["products"].select("id", "sku", "barcode", "name", "price"))


@query("ups3_new_aliases", views("products", "observed", "aliases", more=REPLICA_SQL) + """SELECT DISTINCT bb AS barcode, coalesce(pid, root, line) AS product_id
    FROM j WHERE NOT contra AND bb IS NOT NULL AND bb NOT IN (SELECT barcode FROM aliases)""")
def new_aliases(s):
    return _replica(s, False)["aliases"]


PRODUCT_LINES = """SELECT row_number, sku, barcode, error, CASE WHEN row_number % 4 <> 0 THEN 'item ' || barcode END AS name,
    CASE WHEN length(barcode) > 11 THEN 'ASIA' END AS category_name, CAST(NULL AS STRING) AS subcategory_name FROM pairs"""
IMPORT_SQL = f"""lines AS (SELECT *, coalesce(sku, '') AS s, coalesce(barcode, '') AS b FROM ({PRODUCT_LINES})),
  good AS (SELECT * FROM lines WHERE error IS NULL), pair AS (SELECT s, b, min(row_number) AS first FROM good GROUP BY s, b),
  fs AS (SELECT s FROM pair WHERE s <> '' AND b <> '' GROUP BY s HAVING count(DISTINCT b) > 1),
  fb AS (SELECT b FROM pair WHERE s <> '' AND b <> '' GROUP BY b HAVING count(DISTINCT s) > 1),
  cand AS (SELECT s, b, id FROM pair JOIN products ON sku = s AND s <> '' UNION SELECT s, b, id FROM pair JOIN products ON barcode = b AND b <> ''
    UNION SELECT s, b, product_id FROM pair JOIN aliases ON barcode = b AND b <> ''),
  found AS (SELECT s, b, count(*) AS n, min(c.id) AS pid, bool_or(coalesce(s <> '' AND p.sku <> s, FALSE) OR coalesce(b <> '' AND p.barcode <> b, FALSE)) AS other
    FROM cand c LEFT JOIN products p ON p.id = c.id GROUP BY s, b),
  prior AS (SELECT DISTINCT q.s, q.b FROM pair q JOIN stored t ON (t.sku = q.s AND t.barcode <> q.b) OR (t.barcode = q.b AND t.sku <> q.s)
    WHERE q.s <> '' AND q.b <> '' AND t.sku <> '' AND t.barcode <> ''),
  facts AS (SELECT q.*, f.n, CASE WHEN f.n = 1 THEN f.pid END AS pid, q.s IN (SELECT s FROM fs) OR q.b IN (SELECT b FROM fb) OR r.s IS NOT NULL OR coalesce(f.n > 1 OR f.other, FALSE) AS bad,
      EXISTS (SELECT 1 FROM stored t WHERE t.sku = q.s AND t.barcode = q.b) AS known
    FROM pair q LEFT JOIN found f USING (s, b) LEFT JOIN prior r ON r.s = q.s AND r.b = q.b),
  o AS (SELECT g.row_number, g.sku, g.barcode, g.category_name, f.pid, CASE WHEN f.bad THEN 'conflict'
      WHEN pid IS NULL AND g.name IS NULL THEN CASE WHEN g.row_number = f.first AND NOT known THEN 'pending' ELSE 'duplicate' END
      WHEN pid IS NOT NULL AND g.category_name IS NULL AND (g.sku IS NULL OR g.sku IS NOT DISTINCT FROM p.sku)
        AND (g.barcode IS NULL OR g.barcode IS NOT DISTINCT FROM p.barcode) AND (g.name IS NULL OR g.name IS NOT DISTINCT FROM p.name) THEN 'duplicate'
      WHEN pid IS NOT NULL THEN 'updated' WHEN g.row_number = f.first THEN 'added' ELSE 'duplicate' END AS outcome
    FROM good g JOIN facts f USING (s, b) LEFT JOIN products p ON p.id = f.pid)"""
IMPORT_VIEWS = with_views(("products", B.PRODUCTS), ("aliases", B.ALIASES), ("pairs", B.PAIRS), ("categories", B.CATEGORIES), ("stored", B.PENDING_ROWS)).rstrip() + f", {IMPORT_SQL} "


# The whole import needs lines with numbers of their own; the given lines repeat some, with the same content.
ONCE = ("SELECT row_number, sku, barcode, error, CASE", "SELECT DISTINCT row_number, sku, barcode, error, CASE")
WHOLE_VIEWS = IMPORT_VIEWS.replace(*ONCE)


def _product_lines(s, once=False):
    """The lines, stored without the texts that are made of others; ``once``: the same as the SQL's distinct lines."""
    pairs = s.sql(B.PAIRS)
    return s.spark.sql(PRODUCT_LINES.replace("FROM pairs", "FROM {pairs}"), pairs=stored(pairs.distinct() if once else pairs))


@query("idr5_product_import", IMPORT_VIEWS + """SELECT row_number, outcome, pid AS product_id,
    CASE WHEN category_name = 'ASIA' THEN (SELECT id FROM categories WHERE name = 'ASIA' AND parent_id IS NULL) END AS category_id FROM o
    UNION ALL SELECT row_number, 'invalid', NULL, NULL FROM lines WHERE error IS NOT NULL""")
def product_import(s):
    decided = P.import_products(_product_lines(s), _pending(s), s.sql(B.PRODUCTS), s.sql(B.ALIAS_ROWS), s.sql(B.CATEGORIES))
    return decided.select("row_number", "outcome", "product_id", "category_id")


# Of the lines that are written, those that meet one product together are conflicts; no other line changes its outcome.
IMPORT_DONE = """w AS (SELECT * FROM o WHERE outcome IN ('added', 'updated')),
  crowd AS (SELECT pid FROM w WHERE pid IS NOT NULL GROUP BY pid HAVING count(*) > 1),
  done AS (SELECT row_number, sku, barcode, CASE WHEN outcome = 'updated' AND pid IN (SELECT pid FROM crowd) THEN 'conflict' ELSE outcome END AS outcome,
      CASE WHEN outcome = 'updated' AND pid IN (SELECT pid FROM crowd) THEN NULL WHEN outcome = 'added' THEN 'import:' || row_number ELSE pid END AS pid, error
    FROM (SELECT *, NULL AS error FROM o UNION ALL SELECT row_number, sku, barcode, category_name, NULL, 'invalid', error FROM lines WHERE error IS NOT NULL))"""


def _whole_import(s):
    return P.import_catalog(_product_lines(s, once=True), _pending(s), _replica_products(s), s.sql(B.ALIAS_ROWS), s.sql(B.CATEGORIES), "lines.csv", F.lit("2001-01-01").cast("timestamp"))


def _replica_products(s):
    columns = "id, source_product_id, sku, barcode, name, brand, quantity, price, category_id, product_url"
    return s.spark.sql(f"SELECT {columns}, FALSE AS needs_review FROM {{p}}", p=s.sql(B.PRODUCTS))


@query("idr5_import_lines", WHOLE_VIEWS.rstrip() + f", {IMPORT_DONE} SELECT row_number, outcome, pid AS product_id FROM done")
def import_lines(s):
    return _whole_import(s)["lines"]


@query("idr5_import_history", WHOLE_VIEWS.rstrip() + f""", {IMPORT_DONE} SELECT count(*) AS rows_read, count(*) FILTER (outcome <> 'invalid') AS rows_valid,
    count(*) FILTER (outcome IN ('added', 'pending')) AS rows_added, count(*) FILTER (outcome = 'updated') AS rows_updated,
    count(*) FILTER (outcome IN ('invalid', 'conflict')) AS rows_failed, count(*) FILTER (outcome <> 'conflict' AND pid IS NOT NULL) AS rows_matched,
    count(*) FILTER (outcome = 'pending' OR (outcome = 'duplicate' AND pid IS NULL)) AS rows_pending, count(*) FILTER (outcome = 'duplicate') AS rows_duplicate,
    count(*) FILTER (outcome = 'conflict') AS rows_conflict, 'lines.csv' AS file_name FROM done""")
def import_history(s):
    return _whole_import(s)["history"].drop("errors", "imported_at")


@query("idr5_import_identifiers", WHOLE_VIEWS.rstrip() + f""", {IMPORT_DONE}, t AS (SELECT *, CASE outcome WHEN 'conflict' THEN 'needsReview' WHEN 'pending' THEN 'pending'
      WHEN 'duplicate' THEN CASE WHEN pid IS NULL THEN 'pending' ELSE 'matched' END ELSE 'matched' END AS status FROM done WHERE outcome <> 'invalid')
    SELECT sku, barcode, status, pid AS product_id FROM (SELECT *, row_number() OVER (PARTITION BY sku, barcode
      ORDER BY CASE status WHEN 'needsReview' THEN 0 WHEN 'matched' THEN 1 ELSE 2 END, row_number) AS place FROM t) WHERE place = 1""")
def import_identifiers(s):
    return _whole_import(s)["identifiers"]


SPACE_SQL = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


@query("sc1_folded_text", f"""SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'ăâîșşțţ', 'aaisstt'), '{SPACE_SQL}', ' ', 'g'))) AS folded FROM documents""")
def folded_text(s):
    return s.table("documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query("sc2_accents_stripped", "SELECT doc_id, md5(strip_accents(lower(text))) AS plain FROM documents")
def accents_stripped(s):
    return s.table("documents").select("doc_id", F.md5(X.strip_accents(F.col("text")).cast("binary")).alias("plain"))


KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
PRICE_TEXT = """CASE l_returnflag WHEN 'A' THEN ' ' || replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '.', ',') || ' LEI'
    WHEN 'R' THEN CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) + 1 AS STRING) || ' ' || lpad(CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING), 3, '0') || '.5lei'
    ELSE CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN '1000000000' || l_linenumber || 'lei' ELSE 'lei' END END"""


@query("sc5_price_texts", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN l_extendedprice
    WHEN 'R' THEN (floor(l_extendedprice / 1000) + 1) * 1000 + floor(l_quantity) + 0.5 END AS value,
    CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linenumber <= 2 THEN NULL WHEN l_linenumber = 3 THEN 'monetary overflow' ELSE 'invalid monetary format' END END AS error FROM lineitem""")
def price_texts(s):
    rows = s.sql(f"SELECT {', '.join(KEYS)}, {PRICE_TEXT} AS t FROM lineitem")
    return doubled(rows.select(*KEYS, V.parse_price(F.col("t")).alias("r")).select(*KEYS, "r.value", "r.error"))


@query("sc6_markup_prices", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN NULL
    WHEN 3 THEN l_extendedprice ELSE floor(l_extendedprice) + floor(l_quantity) / 100 END AS value,
    CASE WHEN l_linenumber = 2 THEN 'invalid price markup' END AS error FROM lineitem""")
def markup_prices(s):
    rows = s.sql(f"""SELECT {', '.join(KEYS)}, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'pret: --'
          WHEN 3 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '.', ',') || ' lei'
          ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || ' lei' END AS t,
        CASE WHEN l_linenumber > 3 THEN lpad(CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING), 2, '0') END AS c FROM lineitem""")
    return doubled(rows.select(*KEYS, V.markup_money(F.col("t"), F.col("c")).alias("r")).select(*KEYS, "r.value", "r.error"))


OFFERS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
    CASE WHEN l_linenumber <> 1 THEN CAST(l_extendedprice + l_quantity - 10 AS DECIMAL(12,2)) END AS old_price,
    CASE WHEN l_linenumber = 7 THEN CAST(l_quantity AS DECIMAL(6,2)) WHEN l_linenumber = 6 THEN CAST(0 AS DECIMAL(6,2)) END AS advertised FROM lineitem"""


@query("sc7_sc8_sc9_discounts", f"""WITH o AS ({OFFERS}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN old_price > price THEN {percent_sql('price', 'old_price')} END AS search_percent,
    CASE WHEN advertised IS NOT NULL THEN CAST(advertised AS DOUBLE) WHEN old_price > price THEN {percent_sql('price', 'old_price')} END AS listing_percent,
    coalesce(old_price > price, FALSE) OR coalesce(advertised > 0, FALSE) AS observed FROM o""")
def discounts(s):
    price, old, adv = F.col("price"), F.col("old_price"), F.col("advertised")
    return doubled(s.sql(OFFERS).select(*KEYS, V.discount_percent(price, old).alias("search_percent"),
                                        V.listing_percent(adv, old, price).alias("listing_percent"), V.is_observed(price, old, adv).alias("observed")))


WEIGHED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) AS kg,
    CASE WHEN l_linenumber = 1 THEN 'NaN' ELSE CAST(CAST(l_extendedprice * 2 AS DECIMAL(12,2)) AS STRING) END AS step,
    CASE WHEN l_linenumber = 2 THEN '0' WHEN l_linenumber = 3 THEN '2100' ELSE '2000' END AS grams,
    CASE WHEN l_linenumber <> 4 THEN CAST(l_extendedprice * 2 AS DECIMAL(12,2)) END AS price,
    CASE WHEN l_linenumber >= 5 THEN CAST(l_extendedprice + CASE WHEN l_linenumber = 5 THEN -1 ELSE 1 END AS DECIMAL(12,2)) END AS old_price,
    CASE WHEN l_linenumber = 6 THEN 'per buc' ELSE 'Per KG' END AS unit FROM lineitem"""


@query("sc10_weighted_prices", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE l_linenumber WHEN 1 THEN 'weight_facts_malformed' WHEN 2 THEN 'weight_step_differs_from_price' WHEN 3 THEN 'weight_units_disagree'
      WHEN 4 THEN 'weight_step_differs_from_price' WHEN 5 THEN 'weight_old_below_new' WHEN 6 THEN 'weight_old_unit_unknown' END AS error,
    CASE WHEN l_linenumber > 6 THEN l_extendedprice END AS price FROM lineitem""")
def weighted_prices(s):
    c = {n: F.col(n) for n in ("kg", "step", "grams", "price", "old_price", "unit")}
    w = V.weight_price(c["kg"], c["step"], c["grams"], c["price"], c["old_price"], c["unit"], F.lit(False))
    return doubled(s.sql(WEIGHED).select(*KEYS, w.alias("w")).select(*KEYS, "w.error", "w.price"))


@query("sc11_quantities", """SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size || CASE WHEN p_size > 20 THEN ',5 KG' ELSE 'ml' END END AS quantity FROM part""")
def quantities(s):
    named = s.sql("""SELECT p_partkey, p_name || ' ' || CASE WHEN p_size > 40 THEN p_size || ' kgs' ELSE p_size ||
        CASE WHEN p_size > 20 THEN ',5 KG' ELSE 'ml' END || ' 7 g' END AS n FROM part""")
    clean = named.withColumn("n", F.regexp_replace("n", " 7 g$", ""))
    return clean.select("p_partkey", X.quantity_of(F.col("n")).alias("quantity"))


MONTH_CASE = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(T.MONTHS, 1))
PERIOD_TEXT = f"""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Ofertă valabilă ' || day(o_orderdate) || ' ' || CASE month(o_orderdate) {MONTH_CASE} END || ' '
      || year(o_orderdate) || ' - ' || day(o_orderdate) || ' ' || CASE month(o_orderdate) {MONTH_CASE} END || ' ' || (year(o_orderdate) + 1)
    WHEN o_orderpriority = '2-HIGH' THEN day(o_orderdate) || '.' || month(o_orderdate) || '.' || (year(o_orderdate) + 1) || ' / 1/1/' || year(o_orderdate)
    WHEN o_orderpriority = '5-LOW' THEN 'fără dată' ELSE '1.' || month(o_orderdate) || '.' || year(o_orderdate) || '-28.' || month(o_orderdate) || '.' || year(o_orderdate) END AS t
  FROM orders WHERE o_orderdate IS NOT NULL"""


def to_utc_sql(local):
    """UTC of a wall time: the earlier of the two possible instants whose wall time it is."""
    summer = f"{local} - INTERVAL '3 hours'"
    return f"""CASE WHEN timezone('Europe/Chisinau', timezone('UTC', {summer})) = {local} THEN {summer} ELSE {local} - INTERVAL '2 hours' END"""


@query("sc12_promotion_periods", """WITH d AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS DATE)
      ELSE make_date(year(o_orderdate), month(o_orderdate), 1) END AS a, CASE WHEN o_orderpriority = '1-URGENT'
      THEN make_date(year(o_orderdate) + 1, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 THEN least(day(o_orderdate), 28) ELSE day(o_orderdate) END)
      ELSE make_date(year(o_orderdate), month(o_orderdate), 28) END AS b,
      o_orderpriority IN ('2-HIGH', '5-LOW') OR (o_orderpriority = '1-URGENT' AND month(o_orderdate) = 2 AND day(o_orderdate) = 29) AS bad FROM orders)
    u AS (SELECT *, CAST(a AS TIMESTAMP) AS s, b + INTERVAL '86399999 milliseconds' AS e FROM d)
    SELECT o_orderkey, CASE WHEN NOT bad THEN CAST({s} AS VARCHAR) END AS starts_at, CASE WHEN NOT bad THEN CAST({e} AS VARCHAR) END AS ends_at,
      CASE WHEN bad THEN 'period_not_two_ordered_days' END AS error FROM u""".replace("AS bad FROM orders)", "AS bad FROM orders),").format(
        s=to_utc_sql("s"), e=to_utc_sql("e")))
def promotion_periods(s):
    rows = s.sql(PERIOD_TEXT).select("o_orderkey", T.promotion_period(F.col("t"), "Europe/Chisinau").alias("p"))
    return rows.select("o_orderkey", F.col("p.starts_at").cast("string").alias("starts_at"), F.col("p.ends_at").cast("string").alias("ends_at"), "p.error")


@query("sc14_remaining_time", """WITH r AS (SELECT o_orderkey, greatest(epoch(o_orderdate + INTERVAL '90 minutes') - epoch(TIMESTAMP '1998-06-15 07:08:09'), 0)::BIGINT AS x FROM orders)
    SELECT o_orderkey, x AS seconds, x // 86400 AS days, x % 86400 // 3600 AS hours, x % 3600 // 60 AS minutes, x % 60 AS rest FROM r""")
def remaining_time(s):
    end = F.col("o_orderdate") + F.expr("INTERVAL '90' MINUTE")
    at = F.lit("1998-06-15 07:08:09").cast("timestamp_ntz")
    return s.table("orders").select("o_orderkey", T.remaining(end, at).alias("r")).select("o_orderkey", "r.*")


@query("sc17_url_parts", """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query,
    regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS file FROM pages""")
def url_parts(s):
    return s.table("pages").select("page_id", *[L.url_part(F.col("url"), p).alias(p) for p in ("scheme", "host", "path", "query", "file")])


@query("sc18_picked_images", """SELECT p_partkey, CASE WHEN p_size <= 22 THEN 'https://shop.example/images/thumbnails/' || p_size * 10 || '/200/' || p_partkey || '.jpg' END AS thumb,
    CASE WHEN p_size > 45 THEN 'https://shop.example/a.jpg' ELSE 'https://shop.example/big/' || p_partkey || '.jpg' END AS "full",
    CASE WHEN p_size > 45 THEN 'unexpected source url' END AS error FROM part""")
def picked_images(s):
    rows = s.sql("""SELECT p_partkey, array(NULL, 'data:image/gif;base64,x', CASE WHEN p_size > 45 THEN 'http://other.example/x.jpg, /a.jpg 2x'
        ELSE '/images/thumbnails/' || p_size * 10 || '/200/' || p_partkey || '.jpg 1x, /big/' || p_partkey || '.jpg 2x' END) AS a FROM part""")
    return rows.select("p_partkey", L.pick_images(F.col("a"), HOST).alias("i")).select("p_partkey", "i.*")


@query("flt6_sku_predicates", """SELECT p_partkey, trim(coalesce(CASE WHEN p_size < 9 THEN '  ' WHEN p_size < 20 THEN NULL ELSE p_brand END, '')) = '' AS missing,
    FALSE AS valid_raw, TRUE AS valid_clean FROM part""")
def sku_predicates(s):
    rows = s.sql("SELECT p_partkey, p_brand, CASE WHEN p_size < 9 THEN '  ' WHEN p_size < 20 THEN NULL ELSE p_brand END AS b FROM part")
    return rows.select("p_partkey", X.missing_sku(F.col("b")).alias("missing"), X.valid_sku(F.col("p_brand")).alias("valid_raw"),
                       X.valid_sku(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("valid_clean"))


TRUST = "regexp_matches(url, '^https://m\\.therou\\.example\\.com(:443)?(/|$|\\?|#)')"


@query("flt9_trusted_urls", f"""SELECT page_id, CASE WHEN {TRUST} THEN regexp_replace(url, '#.*$', '') END AS public_url,
    CASE WHEN {TRUST} AND regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) NOT IN ('', '/') THEN url END AS openable_url FROM pages""")
def trusted_urls(s):
    url, host = F.col("url"), "m.therou.example.com"
    return s.table("pages").select("page_id", L.public_url(url, host).alias("public_url"), L.openable_url(url, host).alias("openable_url"))


@query("flt10_suitable_thumbnails", views("products") + """SELECT id, coalesce(contains(thumbnail_url, '/thumbnails/200/') AND
    CAST(regexp_extract(thumbnail_url, '/200/(\\d+)/', 1) AS INT) <= 225, FALSE) AS suitable FROM products""".replace("CAST(regexp", "TRY_CAST(regexp"))
def suitable_thumbnails(s):
    return s.sql(B.PRODUCTS).select("id", F.coalesce(L.suitable_thumbnail(F.col("thumbnail_url")), F.lit(False)).alias("suitable"))


@query("flt11_needed_images", views("products", "observed") + """SELECT p.id, o.img IS NOT NULL AND (p.thumbnail_url IS NULL OR NOT contains(p.thumbnail_url, '/200/')
    OR TRY_CAST(regexp_extract(p.thumbnail_url, '/200/(\\d+)/', 1) AS INT) > 225
    OR regexp_extract(o.img, '([^/]*)$', 1) <> regexp_extract(p.thumbnail_url, '([^/]*)$', 1)) AS needed
    FROM products p JOIN observed o ON o.id = p.id""")
def needed_images(s):
    seen = s.sql(B.OBSERVATIONS).select("id", "img")
    return s.sql(B.PRODUCTS).join(seen, "id").select("id", L.needs_image(F.col("img"), F.col("thumbnail_url")).alias("needed"))


@query("jn5_category_of_products", views("products", "categories") + """SELECT p.id, (SELECT c.id FROM categories c WHERE starts_with(p.product_url, c.source_url)
    ORDER BY length(c.source_url) DESC LIMIT 1) AS category_id FROM products p""")
def category_of_products(s):
    rows = s.sql(B.PRODUCTS).select("id", "product_url")
    return K.category_for(rows, s.sql(B.CATEGORIES), "id", "product_url").select("id", "category_id")
