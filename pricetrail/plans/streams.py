"""Streams over the given tables, run to the end of their input and read back."""

from pyspark.sql import functions as F

from pricetrail.plans import bindings as B
from pricetrail.plans.changelog import LOG
from pricetrail.plans.ingest import scratch
from pricetrail.plans.observed import FRESH_SQL, MONTHS, NOW, moment, views
from pricetrail.plans.registry import query
from pricetrail.session import cut_lineage
from pricetrail.streaming import feeds as W


def _stream(s, table, text):
    """A binding over a table read as a file stream."""
    static = s.table(table)
    live = s.spark.readStream.schema(static.schema).option("pathGlobFilter", f"{table}.parquet").parquet(s.folder)
    escaped = text.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", f"FROM {{{table}}}")
    return s.spark.sql(escaped, **{table: live})


def _run(s, start, rows):
    folder = scratch(s, "stream")
    query = start(rows, f"{folder}/rows", f"{folder}/checkpoint", once=True)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return f"{folder}/rows"


@query("str1_replica_stream", LOG + """SELECT kind, entity_id, max(version) AS version, arg_max(payload, version) AS payload FROM changes GROUP BY kind, entity_id""")
def replica_stream(s):
    return W.read_replica(s.spark, _run(s, W.stream_replica, _stream(s, "events", B.CHANGES)))


@query("str3_absence_stream", f"""WITH h AS (SELECT max({MONTHS}) AS last FROM lineitem), z AS (SELECT p_partkey, last - coalesce(max({MONTHS.replace('l_shipdate', 'l.l_shipdate')}), 0) AS n
    FROM part CROSS JOIN h LEFT JOIN lineitem l ON l.l_partkey = p_partkey GROUP BY p_partkey, last)
    SELECT 'shop:' || p_partkey AS id, n AS missing_count, n >= 1 AS possibly_inactive, n >= 3 AS inactive FROM z""")
def absence_stream(s):
    sightings = f"SELECT 'shop:' || l_partkey AS id, {MONTHS} AS run FROM lineitem"
    last = s.sql(sightings).agg(F.max("run")).first()[0]
    folder = _run(s, W.stream_last_seen, _stream(s, "lineitem", sightings))
    return W.absence_counters(s.spark, folder, s.sql("SELECT 'shop:' || p_partkey AS id FROM part"), last)


def _batches(s, rows, keys, count=4):
    """Rows in files of a folder, dealt into ``count`` micro-batches by a column's share of its range; the third comes twice.

    Gives the stream again after the files of every batch were written, each by the tasks that hold its rows. A run takes what is new
    as one micro-batch.
    """
    folder, rows = scratch(s, "events"), cut_lineage(rows)
    low, high = rows.agg(F.min(keys), F.max(keys)).first()
    for k in [*range(count), min(2, count - 1)]:
        share = F.least(F.lit(count - 1), F.floor((F.col(keys) - low) * count / (high - low + 1)))
        rows.filter(share == k).write.mode("append").parquet(folder)
        yield s.spark.readStream.schema(rows.schema).parquet(folder)


@query("str1_replica_in_batches", LOG + """SELECT kind, entity_id, max(version) AS version, arg_max(payload, version) AS payload FROM changes GROUP BY kind, entity_id""")
def replica_in_batches(s):
    """Several micro-batches, one of them replayed, folded on the way, and a second run that finds nothing new."""
    folder = scratch(s, "replica")
    start = lambda live: W.stream_replica(live, f"{folder}/rows", f"{folder}/checkpoint", once=True).awaitTermination()
    for k, live in enumerate(_batches(s, s.sql(B.CHANGES), "version")):
        start(live)
        if k % 2:
            W.compact_replica(s.spark, f"{folder}/rows")
    start(live)
    W.compact_replica(s.spark, f"{folder}/rows")
    return W.read_replica(s.spark, f"{folder}/rows")


@query("str3_absence_states", f"""WITH h AS (SELECT max({MONTHS}) AS last FROM lineitem), z AS (SELECT p_partkey, last AS run, last - coalesce(max({MONTHS.replace('l_shipdate', 'l.l_shipdate')}), 0) AS n
    FROM part CROSS JOIN h LEFT JOIN lineitem l ON l.l_partkey = p_partkey GROUP BY p_partkey, last)
    SELECT 'shop:' || p_partkey AS id, run, n AS missing_count, n >= 1 AS possibly_inactive, n >= 3 AS inactive FROM z""")
def absence_states(s):
    """The stateful counter over all months, in several micro-batches, one of them replayed."""
    sightings = s.sql(f"SELECT DISTINCT 'shop:' || l_partkey AS id, CAST({MONTHS} AS BIGINT) AS run, FALSE AS closing FROM lineitem")
    last = sightings.agg(F.max("run")).first()[0]
    closings = s.sql("SELECT 'shop:' || p_partkey AS id FROM part").select("id", F.explode(F.expr(f"sequence(1L, {last}L)")).alias("run"), F.lit(True).alias("closing"))
    folder = scratch(s, "absences")
    for live in _batches(s, sightings.unionByName(closings), "run"):
        W.stream_absences(live, f"{folder}/rows", f"{folder}/checkpoint", once=True, every=2).awaitTermination()
    return W.read_absences(s.spark, f"{folder}/rows")


@query("str4_freshness_in_batches", views("runs", more=FRESH_SQL) + """SELECT source, status, CAST(c AS VARCHAR) AS last_successful_check_at,
    CAST(a AS VARCHAR) AS last_attempt_at, st AS last_attempt_status, nullif(er, '') AS error_code FROM g""")
def freshness_in_batches(s):
    """Several micro-batches; running attempts arrive before the image of the same attempt that says how it ended."""
    runs, folder = s.sql(B.RUNS), scratch(s, "freshness")
    begun = runs.withColumns({"status": F.lit("running"), "source_error": F.lit(None).cast("string"), "price_refresh_complete": F.lit(False)})
    events = begun.filter("status <> 'none' AND id % 3 = 0").join(runs.filter("status <> 'running'").select("id"), "id", "left_semi").select(*runs.columns).unionByName(runs)
    for live in _batches(s, events, "id"):
        W.stream_freshness(live, f"{folder}/rows", f"{folder}/checkpoint", once=True, every=2).awaitTermination()
    texts = {c: F.col(c).cast("string") for c in ("last_successful_check_at", "last_attempt_at")}
    return W.read_freshness(s.spark, f"{folder}/rows", moment(NOW)).withColumns(texts)


@query("str4_freshness_stream", views("runs", more=FRESH_SQL) + """SELECT source, status, CAST(c AS VARCHAR) AS last_successful_check_at,
    CAST(a AS VARCHAR) AS last_attempt_at, st AS last_attempt_status, nullif(er, '') AS error_code FROM g""")
def freshness_stream(s):
    folder = _run(s, W.stream_freshness, _stream(s, "events", B.RUNS))
    texts = {c: F.col(c).cast("string") for c in ("last_successful_check_at", "last_attempt_at")}
    return W.read_freshness(s.spark, folder, moment(NOW)).withColumns(texts)
