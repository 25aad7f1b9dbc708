"""Catalog tables and the change log as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricetrail.schemas import CHANGES, TABLES
from pricetrail.sources.manifest import Store


def read_catalog(spark: SparkSession, folder: str, names=None) -> dict[str, DataFrame]:
    """Catalog tables by name, each read with its fixed schema."""
    return {name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}") for name in names or TABLES}


def read_changes(
    spark: SparkSession, folder: str, stream: bool = False, files_per_batch: int | None = None, since: int = 0, until: int | None = None
) -> DataFrame:
    """The change log: changes in (since, until], or a stream of plain log files that arrive as micro-batches.

    If the folder has manifests, exactly the parts that the newest one names and that may hold such versions are listed and read.
    """
    columns = StructType.fromDDL(CHANGES).fieldNames()
    if stream:
        reader = spark.readStream.schema(CHANGES)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(folder).select(*columns)
    store = Store(spark, folder)
    current = store.read()
    if current.number:
        rows = store.rows([p.folder for p in current.between(since, until)], CHANGES)
    else:
        rows = spark.read.schema(CHANGES).parquet(folder)
    rows = rows.select(*columns)
    rows = rows.filter(F.col("version") > since) if since else rows
    return rows if until is None else rows.filter(F.col("version") <= until)
