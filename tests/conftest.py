import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession
from pyspark.sql.types import DecimalType, StructType

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pricetrail.session import configure

    session = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(ddl, rows): a small DataFrame."""

    def make(ddl, rows):
        schema = StructType.fromDDL(ddl)
        money = [isinstance(f.dataType, DecimalType) for f in schema.fields]
        exact = lambda row: tuple(Decimal(str(v)) if m and v is not None else v for v, m in zip(row, money))
        return spark.createDataFrame([exact(r) for r in rows], schema)

    return make


@pytest.fixture
def dicts():
    """Rows as dicts, by a key column or as a sorted list."""

    def collect(df, key=None):
        rows = [r.asDict(recursive=True) for r in df.collect()]
        return {r[key]: r for r in rows} if key else sorted(rows, key=repr)

    return collect
