"""Deep pages against a whole sort."""

import random

import pytest
from pyspark.sql import functions as F

from pricetrail.operators import paging
from pricetrail.operators.identifiers import pending_list
from pricetrail.operators.paging import offset_page


def pages(df, order, total, limit, gathered):
    for offset in range(0, total + limit, limit):
        yield offset, [tuple(r) for r in offset_page(df, order, offset, limit, gathered).collect()]


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(paging, "RANGES", 8)
    monkeypatch.setattr(paging, "SAMPLED", 10)


def test_pages_chain_over_nulls_ties_and_a_hot_key(spark, small_ranges):
    pick = random.Random(1)
    rows = [(pick.choice([None, "a", "B", "ș", "z" * 40]) if k % 3 else "hot", pick.choice([None, k]), "x") for k in range(600)]
    df = spark.createDataFrame(rows, "name string, id long, other string")
    order = [F.col("name"), F.col("id")]
    got = [r for _, page in pages(df, order, 600, 150, 20) for r in page]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert [g[:2] for g in got] == [tuple(r) for r in df.orderBy(*order).select("name", "id").collect()]


def test_rows_alike_in_every_column(spark, small_ranges):
    rows = [(1, "a")] * 400 + [(k, "b") for k in range(2, 60)] + [(0, "c")] * 30
    df = spark.createDataFrame(rows, "id int, t string")
    want = sorted(rows)
    for offset in (0, 29, 200, 425, 429, 431, 470, 487, 488, 1000):
        assert [tuple(r) for r in offset_page(df, [F.col("id")], offset, 20, 10).collect()] == want[offset : offset + 20]


def test_shallow_deep_and_beyond(spark):
    df = spark.range(50_000).withColumn("t", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 7).cast("int")))
    for offset, gathered in ((10, 1000), (30_000, 1000), (49_995, 500), (50_000, 100), (10**12, 100)):
        got = [r["id"] for r in offset_page(df, [F.col("id")], offset, 10, gathered).collect()]
        assert got == list(range(offset, min(offset + 10, 50_000))) if offset < 50_000 else got == []
    assert offset_page(df.limit(0), [F.col("id")], 5000, 10, 100).collect() == []
    with pytest.raises(ValueError):
        offset_page(df, [F.col("id")], -1, 10)


def test_a_deep_page_reads_a_narrow_range(spark, tmp_path):
    spark.range(0, 200_000, 1, 8).write.parquet(f"{tmp_path}/ids")
    page = offset_page(spark.read.parquet(f"{tmp_path}/ids"), [F.col("id")], 150_000, 10, 5_000)
    assert [r["id"] for r in page.collect()] == list(range(150_000, 150_010))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id," in plan and "LessThanOrEqual(id," in plan  # the bounds reach the file scan


def test_pending_list(frame):
    rows = [(f"{k:04}", "s", "b", "pending" if k % 2 else "matched") for k in range(100)]
    got = pending_list(frame("id string, sku string, barcode string, status string", rows), None, 30, 5).collect()
    assert [r["id"] for r in got] == [f"{2 * k + 1:04}" for k in range(30, 35)]
