"""Change log: source, snapshot, versions, pages, watermark."""

import uuid

from pyspark.sql import functions as F

from pricetrail.operators import changes as C
from pricetrail.plans import bindings as B
from pricetrail.plans.registry import Source, query, with_views
from pricetrail.session import shared_dir
from pricetrail.sources.tables import read_changes

LOG = with_views(("changes", B.CHANGES))


def changes(s: Source):
    return s.sql(B.CHANGES)


def head_of(log) -> int:
    return log.agg(F.max("version")).first()[0]


def before_head(log) -> int:
    """A version nine tenths up the log."""
    head = head_of(log)
    return head - head // 10


@query("src6_change_log", LOG + "SELECT version, kind, entity_id, payload FROM changes")
def change_log(s):
    """Written as plain log files and read back by the reader."""
    folder = f"{shared_dir(s.spark)}/log-{uuid.uuid4().hex}"
    changes(s).write.parquet(folder)
    return read_changes(s.spark, folder)


SNAPSHOT_SQL = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, entity_id ORDER BY version DESC) AS rn
                 FROM changes WHERE version <= (SELECT max(version) - max(version) // 10 FROM changes)) WHERE rn = 1)"""


@query(
    "win1_snapshot_at_version",
    LOG.rstrip() + ", " + SNAPSHOT_SQL + " SELECT kind, entity_id, version, payload FROM latest",
)
def snapshot_at_version(s):
    log = changes(s)
    return C.snapshot(log, before_head(log))


LINES = """SELECT l_partkey, l_suppkey, struct(l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS version,
    CAST(l_shipdate AS STRING) AS shipped, l_extendedprice AS price FROM lineitem"""


@query(
    "win1_snapshot_of_lines",
    """SELECT l_partkey, l_suppkey, CAST(l_shipdate AS VARCHAR) AS shipped, l_extendedprice AS price FROM (SELECT *, row_number() OVER (
      PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS rn
      FROM lineitem) WHERE rn = 1""",
)
def snapshot_of_lines(s):
    """Many entities: the newest line of every product and supplier."""
    return C.snapshot(s.sql(LINES), keys=("l_partkey", "l_suppkey")).drop("version")


@query(
    "win2_gapless_versions",
    LOG + """SELECT kind, entity_id, payload, version AS old_version,
        5000 + row_number() OVER (ORDER BY kind, entity_id, version) AS version FROM changes""",
)
def gapless_versions(s):
    batch = changes(s).withColumnRenamed("version", "old_version")
    return C.assign_versions(batch, 5000, ["kind", "entity_id", "old_version"])


KEY_SQL = """CASE kind WHEN 'category' THEN '0' WHEN 'product' THEN '1' WHEN 'promotion' THEN '2'
    WHEN 'collection' THEN '3' ELSE '4' END || ':' || CASE WHEN kind = 'category'
    THEN lpad(json_extract_string(payload, '$.k'), 5, '0') ELSE '00000' END || ':' || entity_id"""


def _leveled(s):
    """The test log names a category's level k."""
    return changes(s).withColumn("payload", F.replace(F.col("payload"), F.lit('"k"'), F.lit('"level"')))


@query(
    "lim2_snapshot_page",
    LOG.rstrip() + ", " + SNAPSHOT_SQL + f""", keyed AS (SELECT *, {KEY_SQL} AS key FROM latest),
    page AS (SELECT *, row_number() OVER (ORDER BY key) AS place, count(*) OVER () AS n
             FROM (SELECT * FROM keyed WHERE key > '0:00050:' ORDER BY key LIMIT 251))
    SELECT kind, entity_id, version, replace(payload, '"k"', '"level"') AS payload, key,
      CASE WHEN n > 250 THEN (SELECT max(key) FROM page WHERE place <= 250) END AS next_cursor
    FROM page WHERE place <= 250""",
)
def snapshot_page(s):
    log = _leveled(s)
    return C.snapshot_page(log, before_head(log), "0:00050:", 250)


@query(
    "lim2_all_snapshot_pages",
    LOG.rstrip() + ", " + SNAPSHOT_SQL + f"""
    SELECT kind, entity_id, version, replace(payload, '"k"', '"level"') AS payload, {KEY_SQL} AS key,
      row_number() OVER (ORDER BY {KEY_SQL}) AS place,
      (row_number() OVER (ORDER BY {KEY_SQL}) - 1) // 50 + 1 AS page FROM latest""",
)
def snapshot_pages(s):
    log = _leveled(s)
    return C.snapshot_pages(log, before_head(log), 50)


SLICE = "version > (SELECT max(version) // 2 FROM changes) AND version <= (SELECT max(version) - max(version) // 10 FROM changes)"


@query(
    "lim3_delta_page",
    LOG + f"""SELECT version, kind, entity_id, payload, (SELECT max(version) // 2 + max(version) // 20 + 250 FROM changes) AS next_cursor
    FROM changes WHERE {SLICE} AND version > (SELECT max(version) // 2 + max(version) // 20 FROM changes) ORDER BY version LIMIT 250""",
)
def delta_page(s):
    log = changes(s)
    head = head_of(log)
    return C.delta_page(log, head // 2, before_head(log), head // 2 + head // 20, 250)


@query("lim3_delta", LOG + f"SELECT version, kind, entity_id, payload FROM changes WHERE {SLICE}")
def delta(s):
    log = changes(s)
    head = head_of(log)
    return C.delta(log, head // 2, before_head(log))


@query(
    "lim1_keyset_page",
    with_views(("products", B.PRODUCTS)).rstrip() + """, r AS (SELECT id, name, row_number() OVER (ORDER BY id) AS place, count(*) OVER () AS n
      FROM products WHERE id > 'shop:15')
    SELECT id, name, CASE WHEN n > 100 THEN (SELECT max(id) FROM r WHERE place <= 100) END AS next_cursor FROM r WHERE place <= 100""",
)
def keyset_page(s):
    return C.keyset_page(s.sql(B.PRODUCTS).select("id", "name"), "id", "shop:15", 100)


@query(
    "ups6_missing_page",
    LOG + "SELECT 'incomplete' AS decision, 'g1' AS generation, 0::BIGINT AS version FROM changes LIMIT 1",
)
def missing_page(s):
    """The pages of the log with the one in the middle lost: the watermark stays."""
    log = changes(s)
    head = head_of(log)
    pages = log.groupBy(F.expr("(version - 1) div 250").alias("page_no")).agg(F.max("version").alias("top"))
    last = F.col("top") == F.lit(head)
    pages = pages.select(
        "page_no", F.lit(head).cast("long").alias("server_version"), F.lit("g1").alias("generation"), last.alias("last"),
        F.when(F.col("page_no") > 0, F.col("page_no") * 250).alias("cursor"), F.when(~last, F.col("top")).alias("next_cursor"))
    state = s.spark.range(1).select(F.lit("g1").alias("generation"), F.lit(0).cast("long").alias("version"))
    return C.advance(state, pages.filter(F.col("page_no") != F.lit((head - 1) // 250 // 2)))


@query(
    "ups6_watermark",
    LOG + "SELECT 'advance' AS decision, 'g1' AS generation, max(version) AS version FROM changes",
)
def watermark(s):
    log = changes(s)
    head = F.lit(head_of(log)).cast("long")
    pages = log.groupBy(F.expr("(version - 1) div 250").alias("page_no")).agg(F.max("version").alias("top"))
    pages = pages.select(head.alias("server_version"), F.lit("g1").alias("generation"), (F.col("top") == head).alias("last"))
    state = s.spark.range(1).select(F.lit("g1").alias("generation"), F.lit(0).cast("long").alias("version"))
    return C.advance(state, pages)
