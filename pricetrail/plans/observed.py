"""Upserts, write policies, scope checks, memberships and run queries."""

from pyspark.sql import functions as F

from pricetrail.operators import membership as M
from pricetrail.operators import observations as O
from pricetrail.operators import quality as Q
from pricetrail.operators import runs as N
from pricetrail.operators import upsert as U
from pricetrail.operators.changes import snapshot
from pricetrail.plans import bindings as B
from pricetrail.plans.registry import query, with_views

VIEWS = (("products", B.PRODUCTS), ("observed", B.OBSERVATIONS), ("aliases", B.ALIASES), ("changes", B.CHANGES),
         ("promotions", B.PROMOTIONS), ("members", B.MEMBERS), ("runs", B.RUNS), ("categories", B.CATEGORIES))


def views(*names, more=""):
    chosen = [v for v in VIEWS if v[0] in names]
    return with_views(*chosen).rstrip() + (f", {more} " if more else " ")


def products(s):
    return s.sql(B.PRODUCTS)


def observed(s):
    return s.sql(B.OBSERVATIONS)


def moment(text):
    return F.lit(text).cast("timestamp_ntz")


def doubled(df):
    return df.select([F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes])


BATCH_SQL = """batch AS (SELECT CASE WHEN quantity = '1 kg' THEN 'new:' || source_product_id ELSE id END AS id, sku, barcode, name,
    brand, price FROM observed)"""
UPSERT_SQL = """j AS (SELECT coalesce(p.id, b.id) AS id, p.id IS NULL AS is_new, b.id IS NULL AS quiet, p.sku AS ps, b.sku AS bs,
      p.barcode AS pb, b.barcode AS bb, p.name AS pn, b.name AS bn, p.brand AS pr, b.brand AS br, p.price AS pp, b.price AS bp,
      p.promotion_state AS state FROM products p FULL JOIN batch b ON b.id = p.id),
  o AS (SELECT *, CASE WHEN quiet THEN 'untouched' WHEN is_new THEN 'added'
      WHEN (bs <> ps AND trim(ps) <> '') OR bb <> pb THEN 'conflict'
      WHEN bn IS NOT DISTINCT FROM pn AND bp IS NOT DISTINCT FROM pp AND (bs IS NULL OR bs IS NOT DISTINCT FROM ps)
        AND (bb IS NULL OR bb IS NOT DISTINCT FROM pb) AND (br IS NULL OR br IS NOT DISTINCT FROM pr) THEN 'unchanged'
      ELSE 'updated' END AS outcome FROM j),
  m AS (SELECT id, outcome, CASE WHEN outcome IN ('added', 'updated') THEN coalesce(bs, ps) ELSE ps END AS sku,
      CASE WHEN outcome IN ('added', 'updated') THEN coalesce(bb, pb) ELSE pb END AS barcode,
      CASE WHEN outcome IN ('added', 'updated') THEN bn ELSE pn END AS name,
      CASE WHEN outcome IN ('added', 'updated') THEN coalesce(br, pr) ELSE pr END AS brand,
      CAST(CASE WHEN outcome IN ('added', 'updated') THEN bp ELSE pp END AS DOUBLE) AS price,
      CASE WHEN outcome = 'added' THEN 'none' ELSE state END AS promotion_state FROM o)"""


def _batch(s):
    new = F.concat(F.lit("new:"), F.col("source_product_id"))
    return observed(s).select(F.when(F.col("quantity") == "1 kg", new).otherwise(F.col("id")).alias("id"), "sku", "barcode",
                              "name", "brand", "price")


def _upserted(s):
    return U.upsert(products(s), _batch(s))


@query("ups1_upsert", views("products", "observed", more=BATCH_SQL + ", " + UPSERT_SQL) + "SELECT * FROM m")
def upserted(s):
    return doubled(_upserted(s).select("id", "outcome", "sku", "barcode", "name", "brand", "price", "promotion_state"))


@query("agg14_outcome_counts", views("products", "observed", more=BATCH_SQL + ", " + UPSERT_SQL) +
       "SELECT outcome, count(*) AS rows FROM m GROUP BY outcome")
def outcome_counts(s):
    return U.sync_report(_upserted(s))


@query("ups1_published_events", views("products", "observed", more=BATCH_SQL + ", " + UPSERT_SQL) + """SELECT 'product' AS kind,
    id AS entity_id, sku, name, price FROM m WHERE outcome IN ('added', 'updated')""")
def published_events(s):
    events = U.upsert_events(_upserted(s), "product")
    return doubled(events.select("kind", "entity_id", "payload.sku", "payload.name", "payload.price"))


DOCS = """SELECT 'doc:' || CAST(user_id AS STRING) AS id, '{"k": ' || CAST(count(*) AS STRING) || '}' AS data FROM events
    WHERE event_type <> 'error' GROUP BY user_id"""
OLD_DOCS = """SELECT 'doc:' || CAST(user_id * 2 AS STRING) AS id, '{"k": ' || CAST(count(DISTINCT event_type) + 8 AS STRING) || '}' AS data
    FROM events GROUP BY user_id"""


@query("ups2_documents", f"""WITH n AS ({DOCS}), o AS ({OLD_DOCS}) SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 'untouched'
    WHEN o.id IS NULL THEN 'added' WHEN n.data = o.data THEN 'unchanged' ELSE 'updated' END AS outcome, coalesce(n.data, o.data) AS data
    FROM n FULL JOIN o ON o.id = n.id""")
def documents(s):
    parsed = lambda df: df.withColumn("data", F.from_json("data", "k long"))
    merged = U.put_documents(parsed(s.sql(OLD_DOCS)), parsed(s.sql(DOCS)))
    return merged.withColumn("data", F.concat(F.lit('{"k": '), F.col("data.k"), F.lit("}")))


@query("ups4_delta_applied", views("changes") + """, h AS (SELECT max(version) // 2 AS mid FROM changes),
    s AS (SELECT kind, entity_id, max(version) AS version, arg_max(payload, version) AS payload FROM changes, h
      WHERE version <= mid GROUP BY ALL),
    d AS (SELECT CASE WHEN kind = 'identifier' AND payload = '{"k": 7}' THEN 'voucher' ELSE kind END AS kind, entity_id, version, payload
      FROM changes, h WHERE version > mid - 500),
    n AS (SELECT kind, entity_id, max(version) AS version, arg_max(payload, version) AS payload FROM d GROUP BY kind, entity_id)
    SELECT coalesce(n.kind, s.kind) AS kind, coalesce(n.entity_id, s.entity_id) AS entity_id,
      CASE WHEN n.kind IS NULL THEN 'untouched' WHEN n.kind = 'voucher' THEN 'unknown_kind' WHEN s.kind IS NULL THEN 'added'
        WHEN n.version <= s.version THEN 'replayed' ELSE 'updated' END AS outcome,
      CASE WHEN n.kind = 'voucher' THEN NULL ELSE greatest(n.version, s.version) END AS version,
      CASE WHEN n.kind = 'voucher' THEN NULL WHEN n.version > s.version OR s.version IS NULL THEN n.payload ELSE s.payload END AS payload
    FROM n FULL JOIN s ON n.kind = s.kind AND n.entity_id = s.entity_id""".replace("GROUP BY ALL", "GROUP BY kind, entity_id"))
def delta_applied(s):
    log = s.sql(B.CHANGES)
    middle = log.agg(F.max("version")).first()[0] // 2
    odd = (F.col("kind") == "identifier") & (F.col("payload") == '{"k": 7}')
    late = log.filter(F.col("version") > middle - 500).withColumn("kind", F.when(odd, "voucher").otherwise(F.col("kind")))
    return U.apply_delta(snapshot(log, middle), late)


@query("str2_replay_dropped", views("changes") + """, h AS (SELECT max(version) // 2 AS mid FROM changes),
    s AS (SELECT kind, entity_id, max(version) AS top FROM changes, h WHERE version <= mid GROUP BY kind, entity_id)
    SELECT c.kind, c.entity_id, c.version, c.payload FROM changes c LEFT JOIN s USING (kind, entity_id)
    WHERE top IS NULL OR c.version > top""")
def replay_dropped(s):
    log = s.sql(B.CHANGES)
    middle = log.agg(F.max("version")).first()[0] // 2
    return U.drop_replayed(log, snapshot(log, middle))


@query("ups4_replaced_memberships", views("members") + """, d AS (SELECT DISTINCT 'collection:' || l_suppkey AS collection_id,
      'shop:' || l_orderkey AS product_id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))
    SELECT * FROM members WHERE collection_id NOT IN (SELECT collection_id FROM d) UNION SELECT * FROM d""")
def replaced_memberships(s):
    rows = s.sql("""SELECT 'collection:' || l_suppkey AS owner_id, 'shop:' || l_orderkey AS product_id FROM lineitem
        WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
    lists = M.member_lists(M.members(rows, "owner_id", "product_id")).withColumnRenamed("owner_id", "collection_id")
    return U.replace_memberships(s.sql(B.MEMBERS), lists, "collection_id")


@query("ups5_snapshot_applied", views("products", "observed") + """SELECT p.id, CASE WHEN o.id IS NULL THEN 'inactive'
      WHEN o.name = p.name THEN 'unchanged' ELSE 'updated' END AS outcome, coalesce(o.name, p.name) AS name, o.id IS NULL OR p.inactive AS inactive
    FROM products p LEFT JOIN (SELECT id, name FROM observed WHERE img IS NOT NULL) o ON o.id = p.id""")
def snapshot_applied(s):
    image = observed(s).filter("img IS NOT NULL").select("id", "name")
    return U.apply_snapshot(products(s), image).select("id", "outcome", "name", "inactive")


@query("ups12_stale_runs", views("runs") + """SELECT id, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status,
    CAST(CASE WHEN status = 'running' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE finished_at END AS VARCHAR) AS finished_at FROM runs""")
def stale_runs(s):
    closed = N.close_stale_runs(s.sql(B.RUNS), moment("2024-02-01 00:00:00"))
    return closed.select("id", "status", F.col("finished_at").cast("string").alias("finished_at"))


def percent_sql(price, old):
    """HALF_UP percent at two decimals, in whole cents."""
    p, o = f"CAST({price} * 100 AS HUGEINT)", f"CAST({old} * 100 AS HUGEINT)"
    return f"CAST((20000 * ({o} - {p}) + {o}) // (2 * {o}) AS DOUBLE) / 100"


SEARCH_PATCH = f"""x AS (SELECT p.id, o.name, o.brand, o.img, o.price, o.list_price, coalesce(o.list_price > o.price, FALSE) AS off,
      coalesce(p.promotion_state = 'dated', FALSE) OR p.promotion_start IS NOT NULL AS campaign, coalesce(p.promotion_state = 'observed', FALSE) AS seen,
      p.price IS DISTINCT FROM o.price OR (o.list_price IS NOT NULL AND p.old_price IS DISTINCT FROM o.list_price) AS changed
    FROM observed o JOIN products p USING (source_product_id)),
  y AS (SELECT *, price IS NOT NULL AND (campaign OR (seen AND NOT off)) AND changed AS bad FROM x)
  SELECT id, bad AS promotion_conflict, 'name,product_url' || CASE WHEN brand IS NOT NULL THEN ',brand' ELSE '' END
    || ',category_id' || CASE WHEN img IS NOT NULL THEN ',source_image_url,full_image_url' ELSE '' END
    || CASE WHEN price IS NOT NULL AND NOT bad THEN ',price' ELSE '' END
    || CASE WHEN price IS NOT NULL AND NOT bad AND off THEN ',old_price,promo_price,discount_percent' ELSE '' END
    || CASE WHEN price IS NOT NULL AND NOT bad AND off AND NOT campaign THEN ',promotion_state' ELSE '' END AS supplied,
    CASE WHEN off THEN {percent_sql('price', 'list_price')} END AS discount_percent FROM y"""


@query("ups7_search_patch", views("products", "observed", more=SEARCH_PATCH.split("\n  SELECT id, bad")[0]) +
       "SELECT id, bad" + SEARCH_PATCH.split("\n  SELECT id, bad")[1])
def search_patch(s):
    patch = O.search_patch(observed(s).withColumn("category_id", F.lit("/r1/")), products(s))
    return patch.select("id", "promotion_conflict", F.array_join("supplied", ",").alias("supplied"),
                        F.col("discount_percent").cast("double").alias("discount_percent"))


CARDS = """SELECT id, source_product_id, sku, name, quantity, price, list_price AS old_price,
    CASE WHEN list_price > price THEN price END AS promo_price, CAST(NULL AS DECIMAL(6,2)) AS discount_percent,
    CASE WHEN list_price > price THEN 'observed' ELSE 'none' END AS promotion_state,
    CAST(NULL AS TIMESTAMP) AS promotion_start, CAST(NULL AS TIMESTAMP) AS promotion_end,
    CASE WHEN img IS NOT NULL THEN img END AS thumbnail_url, '/r1/' AS category_id FROM observed"""


def _cards(s):
    cards = s.spark.sql(CARDS.replace("FROM observed", "FROM {o}"), o=observed(s))
    return cards.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("promotion_start", "promotion_end")})


PERIOD_TEXT = ("2001-01-01 00:00:00", "2001-01-14 23:59:59")


def _period():
    return moment(PERIOD_TEXT[0]), moment(PERIOD_TEXT[1])


@query("ups8_listing_patch", views("products", "observed", more=f"cards AS ({CARDS})") + f"""SELECT c.id,
    CASE WHEN c.promotion_state = 'observed' THEN 'dated' ELSE c.promotion_state END AS promotion_state,
    CASE WHEN c.promotion_state = 'observed' THEN '{PERIOD_TEXT[1]}' END AS promotion_end,
    'source_product_id,sku,name,thumbnail_url,category_id'
      || CASE WHEN p.promotion_start IS NULL AND NOT (c.price IS NULL AND coalesce(c.quantity = '1 kg', FALSE)) THEN
      ',price,old_price,promo_price,discount_percent,promotion_state,promotion_start,promotion_end' ELSE '' END
      || CASE WHEN c.price IS NULL AND c.quantity = '1 kg' THEN '' ELSE ',quantity' END AS supplied
    FROM cards c JOIN products p ON p.source_product_id = c.source_product_id""")
def listing_patch(s):
    patch = O.listing_patch(_cards(s), products(s), _period(), selective=True)
    return patch.select("id", "promotion_state", F.col("promotion_end").cast("string").alias("promotion_end"),
                        F.array_join("supplied", ",").alias("supplied"))


CAMPAIGN_SQL = """x AS (SELECT c.*, CASE WHEN trim(coalesce(p.sku, '')) <> '' THEN p.sku ELSE c.sku END AS code
      FROM cards c JOIN products p ON p.source_product_id = c.source_product_id),
    y AS (SELECT x.*, coalesce(code <> '', FALSE) AND EXISTS (SELECT 1 FROM products o WHERE o.sku = x.code AND o.id <> x.id) AS taken FROM x)"""


@query("ups9_campaign_patch", views("products", "observed", more=f"cards AS ({CARDS}), {CAMPAIGN_SQL}") + """SELECT id, code AS sku, taken AS sku_conflict,
    'source_product_id,name' || CASE WHEN price IS NOT NULL THEN
      ',price,old_price,promo_price,discount_percent,promotion_state,promotion_start,promotion_end,quantity' ELSE '' END
      || CASE WHEN taken THEN '' ELSE ',sku' END || CASE WHEN thumbnail_url IS NULL THEN '' ELSE ',thumbnail_url' END AS supplied FROM y""")
def campaign_patch(s):
    patch = O.campaign_patch(_cards(s), products(s), _period())
    return patch.select("id", "sku", "sku_conflict", F.array_join("supplied", ",").alias("supplied"))


@query("agg9_campaign_metrics", views("products", "observed", more=f"cards AS ({CARDS}), {CAMPAIGN_SQL}") + """,
    z AS (SELECT c.id, p.sku AS stored, c.sku, CASE WHEN c.quantity = '1 kg' THEN 'D-' || c.source_product_id END AS detail_sku,
        c.old_price, c.promo_price, c.thumbnail_url FROM cards c JOIN products p USING (source_product_id)),
    k AS (SELECT *, CASE WHEN trim(coalesce(stored, '')) <> '' THEN stored WHEN trim(coalesce(sku, '')) <> '' THEN sku ELSE detail_sku END AS code FROM z)
    SELECT count(*) AS unique_products, count(*) AS existing_products, 0 AS new_products, count(*) FILTER (WHERE trim(coalesce(stored, '')) <> '') AS sku_existing,
      count(*) FILTER (WHERE trim(coalesce(stored, '')) = '' AND coalesce(sku, detail_sku) IS NOT NULL) AS sku_fetched,
      count(*) FILTER (WHERE trim(coalesce(stored, '')) = '' AND coalesce(sku, detail_sku) IS NULL) AS sku_missing,
      count(*) FILTER (WHERE EXISTS (SELECT 1 FROM products o WHERE o.sku = k.code AND o.id <> k.id)) AS sku_conflicts,
      count(old_price) AS price_normal_found, count(promo_price) AS promo_price_found, 0 AS discount_found, count(thumbnail_url) AS images_found,
      count(*) AS products_linked, (SELECT count(*) FROM (SELECT DISTINCT 'shop:' || o_orderkey AS id FROM orders) WHERE id NOT IN (SELECT id FROM z))
        AS products_unlinked FROM k""")
def campaign_metrics(s):
    cards = _cards(s).withColumn("detail_sku", F.when(F.col("quantity") == "1 kg", F.concat(F.lit("D-"), "source_product_id")))
    linked = s.sql("SELECT 'shop:' || o_orderkey AS id FROM orders").distinct()
    return O.campaign_metrics(cards, products(s), linked)


@query("jn10_absent_products", views("products", "categories") + """SELECT id, missing_count + 1 AS missing_count, missing_count + 1 >= 3 AS inactive
    FROM products WHERE category_id IN (SELECT id FROM categories WHERE starts_with(source_url, 'https://shop.example/r2/'))
    AND id NOT IN (SELECT 'shop:' || l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01 00:00:00')""")
def absent_products(s):
    seen = s.sql("SELECT DISTINCT 'shop:' || l_partkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00'")
    scope = s.sql(B.CATEGORIES).filter(F.col("source_url").startswith("https://shop.example/r2/")).select("id")
    return O.absence_patch(O.absent(products(s), seen, scope)).select("id", "missing_count", "inactive")


MONTHS = "(year(l_shipdate) - 1995) * 12 + month(l_shipdate)"


@query("win3_absence_streaks", f"""WITH cell AS (SELECT p_partkey, run FROM part, (SELECT unnest(generate_series(1, (SELECT max({MONTHS}) FROM lineitem))) AS run)),
    hit AS (SELECT DISTINCT l_partkey, {MONTHS} AS run FROM lineitem),
    z AS (SELECT c.p_partkey, c.run, c.run - coalesce(max(h.run) OVER (PARTITION BY c.p_partkey ORDER BY c.run), 0) AS n
      FROM cell c LEFT JOIN hit h ON h.l_partkey = c.p_partkey AND h.run = c.run)
    SELECT 'shop:' || p_partkey AS id, run, n AS missing_count, n >= 1 AS possibly_inactive, n >= 3 AS inactive FROM z""")
def absence_streaks(s):
    sightings = s.sql(f"SELECT 'shop:' || l_partkey AS id, {MONTHS} AS run FROM lineitem")
    runs = sightings.agg(F.max("run")).first()[0]
    return O.absence_streak(sightings, s.sql("SELECT 'shop:' || p_partkey AS id FROM part"), runs)


SPANS_SQL = f"""h AS (SELECT max({MONTHS}) AS last FROM lineitem), hit AS (SELECT DISTINCT 'shop:' || l_partkey AS id, {MONTHS} AS run FROM lineitem),
    mark AS (SELECT 'shop:' || p_partkey AS id, 0 AS run FROM part UNION ALL SELECT id, run FROM hit WHERE id IN (SELECT 'shop:' || p_partkey FROM part)),
    step AS (SELECT id, run, coalesce(lead(run) OVER (PARTITION BY id ORDER BY run), (SELECT last FROM h) + 1) AS next FROM mark),
    span AS (SELECT id, greatest(run, 1) AS first_run, next - 1 AS last_run, greatest(run, 1) - run AS absences FROM step WHERE next > greatest(run, 1))"""


def _spans(s):
    sightings = s.sql(f"SELECT 'shop:' || l_partkey AS id, {MONTHS} AS run FROM lineitem")
    runs = sightings.agg(F.max("run")).first()[0]
    return O.absence_spans(sightings, s.sql("SELECT 'shop:' || p_partkey AS id FROM part"), runs), runs


@query("win3_absence_spans", f"WITH {SPANS_SQL} SELECT id, first_run, last_run, absences FROM span")
def absence_spans(s):
    return _spans(s)[0]


@query("win3_absences_at_run", f"""WITH {SPANS_SQL}, r AS (SELECT last // 2 AS run FROM h)
    SELECT id, absences + run - first_run AS missing_count, absences + run - first_run >= 1 AS possibly_inactive, absences + run - first_run >= 3 AS inactive
    FROM span, r WHERE run BETWEEN first_run AND last_run""")
def absences_at_run(s):
    spans, runs = _spans(s)
    return O.absences_at(spans, runs // 2)


@query("win5_strict_dedupe", """SELECT l_partkey || '-' || l_suppkey AS id, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END
    AS flag, count(DISTINCT l_returnflag) > 1 AS conflicting FROM lineitem GROUP BY l_partkey, l_suppkey""")
def strict_dedupe(s):
    return O.dedupe_strict(s.sql("SELECT l_partkey || '-' || l_suppkey AS id, l_returnflag AS flag FROM lineitem"), "id")


@query("win6_repeated_pages", """WITH p AS (SELECT l_returnflag AS scope, l_orderkey AS page, list_sort(list(DISTINCT l_partkey % 5)) AS sig
      FROM lineitem GROUP BY 1, 2)
    SELECT scope, page, page > min(page) OVER (PARTITION BY scope, sig) AS repeated FROM p""")
def repeated_pages(s):
    cards = s.sql("SELECT l_returnflag AS scope, l_orderkey AS page, l_partkey % 5 AS id FROM lineitem")
    return O.repeated_pages(cards, "scope", "page", "id")


PERIODS = """SELECT 'shop:' || l_partkey AS id, CAST(max(l_quantity) AS DECIMAL(12,2)) AS price,
    CAST(max(CASE WHEN l_discount > 0.05 THEN l_tax END) AS DECIMAL(12,2)) AS old_price FROM lineitem WHERE l_linestatus = '{0}' GROUP BY l_partkey"""


@query("jn11_source_comparison", f"""SELECT count(*) AS common_ids, count(*) FILTER (WHERE a.price = b.price) AS price_matches,
    count(*) FILTER (WHERE a.old_price IS NOT DISTINCT FROM b.old_price) AS old_price_matches
    FROM ({PERIODS.format('O')}) a JOIN ({PERIODS.format('F')}) b USING (id)""")
def source_comparison(s):
    return O.compare_sources(s.sql(PERIODS.format("O")), s.sql(PERIODS.format("F")))


@query("jn12_search_use", views("products", "observed") + """SELECT o.source_product_id, CASE WHEN p.id IS NULL THEN 'unknown'
      WHEN o.source_product_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) THEN 'outside_targets' ELSE 'patched' END AS use
    FROM observed o LEFT JOIN products p ON p.source_product_id = o.source_product_id AND starts_with(p.category_id, '/r1/')""")
def search_use(s):
    scope = s.sql(B.CATEGORIES).filter(F.col("source_url").startswith("https://shop.example/r1/"))
    targets = s.sql("SELECT CAST(c_custkey AS STRING) AS source_product_id FROM customer")
    return O.apply_search(observed(s), products(s), scope, targets).select("source_product_id", "use")


@query("jn13_coverage", views("observed") + """SELECT (SELECT count(*) FROM observed) AS returned,
    count(*) FILTER (WHERE o.id IS NULL) AS missing, count(o.id) AS answered, count(*) FILTER (WHERE o.id IS NULL) > 0 AS fallback
    FROM (SELECT DISTINCT CAST(o_custkey * 2 AS VARCHAR) AS sid FROM orders) t LEFT JOIN observed o ON o.source_product_id = t.sid""")
def coverage(s):
    targets = s.sql("SELECT CAST(o_custkey * 2 AS STRING) AS source_product_id FROM orders")
    return O.covered(targets, observed(s))


@query("agg4_page_stats", """SELECT l_orderkey AS page, count(*) FILTER (WHERE l_linenumber <> 7) AS found,
    count(*) FILTER (WHERE l_linenumber <> 7 AND l_quantity > 5) AS with_price, count(*) FILTER (WHERE l_linenumber <> 7 AND l_discount > 0.04)
    AS with_old_price, count(*) FILTER (WHERE l_linenumber <> 7 AND l_discount > 0) AS with_discount,
    count(*) FILTER (WHERE l_linenumber <> 7 AND l_returnflag = 'R') AS promotional, count(*) FILTER (WHERE l_linenumber = 7) AS restricted
    FROM lineitem GROUP BY l_orderkey""")
def page_stats(s):
    cards = s.sql("""SELECT l_orderkey AS page, CASE WHEN l_quantity > 5 THEN l_extendedprice END AS price,
        CASE WHEN l_discount > 0.04 THEN l_extendedprice END AS old_price, l_discount AS discount_percent,
        CASE WHEN l_returnflag = 'R' THEN 'observed' ELSE 'none' END AS promotion_state, l_linenumber = 7 AS restricted FROM lineitem""")
    return O.page_stats(cards, "page")


@query("agg5_last_complete", views("runs") + """SELECT source, CAST(max(finished_at) AS VARCHAR) AS finished_at FROM runs
    WHERE status = 'complete' GROUP BY source""")
def last_complete(s):
    return N.last_complete(s.sql(B.RUNS), "source").withColumn("finished_at", F.col("finished_at").cast("string"))


@query("agg8_run_status", """WITH c AS (SELECT user_id, CASE WHEN min(value) < 0.5 THEN 'full' ELSE 'selected' END AS scope,
      count(*) FILTER (WHERE event_type = 'error' AND value > 40) AS e, count(*) FILTER (WHERE event_type = 'click' AND value > 50) AS r,
      count(*) FILTER (WHERE event_type = 'view') AS v FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN e > 0 THEN 'partial' ELSE 'complete' END AS status,
      scope = 'full' AND v > 0 AND e = 0 AND r = 0 AS price_refresh_complete FROM c""")
def run_status(s):
    stats = s.table("events").groupBy("user_id").agg(
        F.when(F.min("value") < 0.5, "full").otherwise("selected").alias("scope"),
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 40)).alias("errors"),
        F.count_if((F.col("event_type") == "click") & (F.col("value") > 50)).alias("ageRestrictedCards"),
        F.count_if(F.col("event_type") == "view").alias("categoriesProcessed"))
    return N.run_status(stats).select("user_id", "status", "price_refresh_complete")


NOW = "2024-01-30 12:00:00"
FRESH_SQL = f"""f AS (SELECT source, max(started_at) AS a, arg_max(status, started_at) AS st, arg_max(coalesce(source_error, ''), started_at) AS er,
      max(CASE WHEN price_refresh_complete THEN started_at END) AS c FROM runs WHERE scope = 'full' GROUP BY source),
  g AS (SELECT *, CASE WHEN st IN ('partial', 'failed', 'interrupted') THEN 'error'
      WHEN st = 'running' THEN CASE WHEN TIMESTAMP '{NOW}' - a <= INTERVAL 12 HOUR THEN 'running' ELSE 'error' END
      WHEN c IS NULL OR c > TIMESTAMP '{NOW}' THEN 'unknown' WHEN TIMESTAMP '{NOW}' - c <= INTERVAL 26 HOUR THEN 'fresh' ELSE 'stale' END AS status FROM f)"""


def _fresh(s):
    return N.freshness(s.sql(B.RUNS), moment(NOW))


@query("agg11_freshness", views("runs", more=FRESH_SQL) + """SELECT source, status, CAST(c AS VARCHAR) AS last_successful_check_at,
    CAST(a AS VARCHAR) AS last_attempt_at, st AS last_attempt_status, nullif(er, '') AS error_code FROM g""")
def freshness(s):
    texts = {c: F.col(c).cast("string") for c in ("last_successful_check_at", "last_attempt_at")}
    return _fresh(s).withColumns(texts)


@query("agg12_refresh_due", views("runs", more=FRESH_SQL) + f"""SELECT source, c IS NULL OR status IN ('error', 'stale', 'unknown')
    OR c > TIMESTAMP '{NOW}' OR TIMESTAMP '{NOW}' - c >= INTERVAL 24 HOUR AS due FROM g""")
def refresh_due(s):
    return _fresh(s).select("source", N.is_due(moment(NOW)).alias("due"))


@query("agg13_freshness_warning", views("runs", more=FRESH_SQL) + f"""SELECT source, CASE WHEN er = 'access_denied' THEN 'access_denied'
    WHEN status = 'error' THEN 'error' WHEN c IS NULL THEN 'unconfirmed' WHEN c > TIMESTAMP '{NOW}' OR TIMESTAMP '{NOW}' - c > INTERVAL 26 HOUR
    THEN 'stale' WHEN status = 'running' THEN 'running' ELSE 'none' END AS warning FROM g""")
def freshness_warning(s):
    return _fresh(s).select("source", N.warning(moment(NOW)).alias("warning"))


@query("lim6_recent_history", views("runs") + "SELECT id, status FROM runs ORDER BY id DESC LIMIT 40")
def recent_history(s):
    return N.recent(s.sql(B.RUNS)).select("id", "status")


LINKS_BY = "SELECT DISTINCT 'collection:' || l_suppkey AS collection_id, 'shop:' || l_partkey AS product_id FROM lineitem WHERE {0}"
KEYS = ["collection_id", "product_id"]


@query("set1_membership_diff", f"""WITH n AS ({LINKS_BY.format('year(l_shipdate) >= 1999')}), o AS ({LINKS_BY.format('year(l_shipdate) < 1999')})
    SELECT *, 'link' AS action FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL
    SELECT *, 'unlink' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def membership_diff(s):
    return M.membership_diff(s.sql(LINKS_BY.format("year(l_shipdate) >= 1999")), s.sql(LINKS_BY.format("year(l_shipdate) < 1999")), KEYS)


@query("set2_merged_members", """SELECT DISTINCT 'collection:' || l_suppkey AS collection_id, 'shop:' || l_partkey AS product_id FROM lineitem""")
def merged_members(s):
    return M.merge_members(*[s.sql(LINKS_BY.format(f"l_returnflag = '{f}'")) for f in "ARN"], KEYS)


@query("set3_restricted_scope", views("products") + """SELECT id FROM products WHERE source_product_id IN
    (SELECT CAST(l_suppkey * 10 AS VARCHAR) FROM lineitem)""")
def restricted_scope(s):
    targets = s.sql("SELECT DISTINCT CAST(l_suppkey * 10 AS STRING) AS source_product_id FROM lineitem")
    return M.restrict(products(s), targets, "source_product_id").select("id")


@query("set4_all_barcodes", views("products", "aliases") + """SELECT barcode, id AS product_id FROM products WHERE barcode IS NOT NULL
    UNION SELECT barcode, product_id FROM aliases""")
def all_barcodes(s):
    return M.all_barcodes(products(s), s.sql(B.ALIASES))


@query("agg10_member_positions", views("members") + """SELECT collection_id AS owner_id, product_id,
    row_number() OVER (PARTITION BY collection_id ORDER BY product_id) AS position FROM members""")
def member_positions(s):
    rows = s.sql("SELECT 'collection:' || l_suppkey AS collection_id, 'shop:' || l_partkey AS product_id FROM lineitem")
    return M.members(rows, "collection_id", "product_id")


@query("agg10_member_lists", views("members") + """SELECT owner_id, part, string_agg(product_id, ',' ORDER BY product_id) AS product_ids FROM
    (SELECT collection_id AS owner_id, product_id, (row_number() OVER (PARTITION BY collection_id ORDER BY product_id) - 1) // 200 + 1 AS part
     FROM members) GROUP BY owner_id, part""")
def member_lists(s):
    return M.member_lists(member_positions(s), 200).withColumn("product_ids", F.array_join("product_ids", ","))


@query("sc13_ups10_campaign_statuses", views("promotions") + """SELECT id, CASE WHEN starts_at > TIMESTAMP '1998-06-15 00:00:00' THEN 'upcoming'
    WHEN ends_at < TIMESTAMP '1998-06-15 00:00:00' THEN 'expired' WHEN id = 'promo:10' THEN 'active' ELSE 'historical' END AS status
    FROM promotions WHERE type = '1-URGENT'""")
def campaign_statuses(s):
    return M.campaign_statuses(s.sql(B.PROMOTIONS), "promo:10", "1-URGENT", moment("1998-06-15 00:00:00")).select("id", "status")


@query("ups10_published_campaign", """WITH n AS (SELECT DISTINCT 'shop:' || l_partkey AS product_id FROM lineitem WHERE year(l_shipdate) = 2000),
    o AS (SELECT DISTINCT 'shop:' || l_partkey AS product_id FROM lineitem WHERE year(l_shipdate) = 1999),
    d AS (SELECT max(CASE WHEN year(l_shipdate) = 1999 THEN l_shipdate END) > max(CASE WHEN year(l_shipdate) = 2000 THEN l_shipdate END) AS older FROM lineitem)
    SELECT product_id, 'link' AS action, CASE WHEN older THEN 'older campaign' ELSE 'publish' END AS decision FROM
      (SELECT * FROM n EXCEPT SELECT * FROM o), d UNION ALL
    SELECT product_id, 'unlink', CASE WHEN older THEN 'older campaign' ELSE 'publish' END FROM (SELECT * FROM o EXCEPT SELECT * FROM n), d""")
def published_campaign(s):
    decision, changes = _campaign(s, 2000, 1999)
    return changes["collection"].withColumn("decision", F.lit(decision.first()["decision"]))


def _campaign(s, new, old):
    """The products shipped in one year as a campaign that replaces another year's."""
    lines = s.table("lineitem").select(F.concat(F.lit("shop:"), F.col("l_partkey")).alias("id"), F.year("l_shipdate").alias("y"),
                                       "l_shipdate")
    found, shown = (lines.filter(F.col("y") == y).select("id").distinct() for y in (new, old))
    start = lambda y: lines.filter(F.col("y") == y).agg(F.max("l_shipdate").alias("starts_at"))
    decision = M.campaign_decision(start(new), start(old), found)
    shown = shown.withColumnRenamed("id", "product_id")
    return decision, M.publish_campaign("campaign", found, shown.withColumn("promotion_id", F.lit("campaign")), shown, decision)


@query("ups10_refused_campaign", """SELECT CASE WHEN count(*) FILTER (year(l_shipdate) = 1997) = 0 THEN 'empty campaign' ELSE 'older campaign' END AS decision,
    0::BIGINT AS links, 0::BIGINT AS members FROM lineitem""")
def refused_campaign(s):
    """A campaign older than the published one changes nothing."""
    decision, changes = _campaign(s, 1997, 1999)
    count = lambda name: changes[name].agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return decision.select("decision", F.lit(count("links")).cast("long").alias("links"), F.lit(count("collection")).cast("long").alias("members"))


DOCUMENTS_SQL = views("promotions") + """, f AS (SELECT count(DISTINCT l_partkey) AS members FROM lineitem WHERE year(l_shipdate) = 2000),
    t AS (SELECT id, CASE WHEN starts_at > TIMESTAMP '1998-06-15 00:00:00' THEN 'upcoming' WHEN ends_at < TIMESTAMP '1998-06-15 00:00:00' THEN 'expired'
      WHEN id = 'promo:10' THEN 'active' ELSE 'historical' END AS status FROM promotions WHERE type = '1-URGENT'),
    o AS (SELECT id, 'kept' AS status FROM promotions WHERE type = '2-HIGH')"""


def _documents(s, new, old):
    """The outcome of every promotion document when one year's products are published after another's."""
    decision, _ = _campaign(s, new, old)
    found = s.table("lineitem").filter(F.year("l_shipdate") == new).select(F.concat(F.lit("shop:"), F.col("l_partkey")).alias("id"))
    promotions = s.sql(B.PROMOTIONS)
    statuses = M.campaign_statuses(promotions, "promo:10", "1-URGENT", moment("1998-06-15 00:00:00"))
    stored = promotions.filter("type = '2-HIGH'").select("id", F.lit('{"status":"kept"}').alias("data"))
    rows = M.campaign_documents(statuses, "promo:10", found, stored, decision)
    told = F.from_json("data", "status string, members long")
    return rows.select("id", "outcome", told["status"].alias("status"), told["members"].alias("members"))


@query("ups10_campaign_documents", DOCUMENTS_SQL + """ SELECT id, 'added' AS outcome, status, CASE WHEN id = 'promo:10' THEN members END AS members FROM t, f
    UNION ALL SELECT id, 'untouched', status, NULL FROM o""")
def campaign_documents(s):
    return _documents(s, 2000, 1999)


@query("ups10_refused_documents", DOCUMENTS_SQL + " SELECT id, 'untouched' AS outcome, status, CAST(NULL AS BIGINT) AS members FROM o")
def refused_documents(s):
    """An older campaign writes no document."""
    return _documents(s, 1997, 1999)


SCOPES = """SELECT 'collection:' || s_suppkey AS collection_id, CASE WHEN s_nationkey < 10 THEN 'open' WHEN s_nationkey < 20 THEN 'dated' ELSE 'other' END
    AS kind, s_acctbal > 5000 AS complete, s_acctbal < 0 AS selective, s_nationkey < 12 AS root FROM supplier"""
PUBLISHED = """SELECT 'collection:' || l_suppkey AS collection_id, 'shop:' || l_partkey AS product_id, bool_or(l_linestatus = 'F') AS same_period
    FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_suppkey, l_partkey"""


@query("ups11_published_collections", f"""WITH sc AS ({SCOPES}), seen AS ({LINKS_BY.format("l_returnflag = 'R'")}),
    linked AS ({LINKS_BY.format("l_returnflag = 'A'")}), published AS ({PUBLISHED})
    SELECT collection_id, product_id FROM seen JOIN sc USING (collection_id) WHERE NOT selective AND (complete OR kind IN ('open', 'dated'))
    UNION SELECT collection_id, product_id FROM linked JOIN sc USING (collection_id) WHERE selective OR (NOT complete AND kind IN ('open', 'other'))
    UNION SELECT collection_id, product_id FROM published JOIN sc USING (collection_id)
      WHERE NOT selective AND NOT complete AND (kind = 'open' OR (kind = 'dated' AND same_period))""")
def published_collections(s):
    seen, linked = (s.sql(LINKS_BY.format(f"l_returnflag = '{f}'")) for f in "RA")
    return M.publish_collection(s.sql(SCOPES), seen, linked, s.sql(PUBLISHED))


@query("ups11_absence_scopes", f"""SELECT collection_id, root AND complete AND NOT selective AND collection_id IN
    ({LINKS_BY.format("l_returnflag = 'R'").replace(", 'shop:' || l_partkey AS product_id", "")}) AS absences FROM ({SCOPES}) AS sc""")
def absence_scopes(s):
    return M.collection_modes(s.sql(SCOPES), s.sql(LINKS_BY.format("l_returnflag = 'R'"))).select("collection_id", "absences")


@query("agg1_sku_diagnostics", views("products") + """SELECT count(*) AS total_products, count(*) FILTER (WHERE trim(coalesce(sku, '')) <> '') AS products_with_sku,
    count(*) FILTER (WHERE trim(coalesce(sku, '')) = '') AS products_without_sku, count(*) FILTER (WHERE sku IS NULL) AS products_with_null_sku,
    count(*) FILTER (WHERE sku = '') AS products_with_empty_sku, count(*) FILTER (WHERE sku <> '' AND trim(sku) = '') AS products_with_whitespace_sku,
    count(*) FILTER (WHERE regexp_matches(sku, '^[A-Za-z0-9][A-Za-z0-9._/-]{0,127}$')) AS products_with_valid_sku,
    count(*) FILTER (WHERE trim(coalesce(sku, '')) = '' AND id > 'shop:150') AS eligible_after,
    count(*) FILTER (WHERE trim(coalesce(sku, '')) = '' AND id <= 'shop:150') AS excluded_by_after, TRUE AS after_exists, 'ready' AS reason FROM products""")
def sku_diagnostics(s):
    return Q.diagnose_skus(products(s), "shop:150")


@query("lim5_enrichment_batch", views("products") + """, r AS (SELECT id, row_number() OVER (ORDER BY id) AS place, count(*) OVER () AS n FROM products
      WHERE trim(coalesce(sku, '')) = '' AND id > 'shop:15')
    SELECT id, CASE WHEN n > 100 THEN (SELECT max(id) FROM r WHERE place <= 100) END AS next_cursor FROM r WHERE place <= 100""")
def enrichment_batch(s):
    return Q.enrichment_batch(products(s).select("id", "sku"), "shop:15", 100).select("id", "next_cursor")


@query("lim7_observation_sample", views("observed") + "SELECT source_product_id, name FROM observed ORDER BY source_product_id LIMIT 1000")
def observation_sample(s):
    return Q.sample_first(observed(s).select("source_product_id", "name"), "source_product_id")
