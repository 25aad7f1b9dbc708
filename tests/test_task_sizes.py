"""What one task of the catalog's queries reads is bounded, whatever the session's defaults."""

from pricetrail import session
from pricetrail.plans.registry import Source

PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_tasks_are_bounded(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in (*session.TASK_MB, PARTITIONS)}
    first, *rest = session.TASK_MB
    try:
        for key in rest:
            spark.conf.set(key, "512MB")
        spark.conf.set(first, "1m")
        spark.conf.unset(PARTITIONS)
        Source(spark, str(tmp_path))
        assert spark.conf.get(first) == "1m"  # a smaller setting stays
        assert [spark.conf.get(k) for k in rest] == [f"{session.TASK_MB[k]}m" for k in rest]
        assert int(spark.conf.get(PARTITIONS)) == session.PARTITIONS
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_shuffle_is_read_in_small_parts(spark, tmp_path):
    """About 30 MB that do not compress: without the bounds, the few shuffle partitions of this session would hold them."""
    Source(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        rows = spark.range(2_000_000).selectExpr("xxhash64(id) AS a", "xxhash64(id, 1) AS b").groupBy("a").count()
        assert rows.rdd.getNumPartitions() > 12
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        Source(spark, str(tmp_path))
