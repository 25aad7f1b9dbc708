"""Arrow batches in and out of Python, and deterministic bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.session import configure, shared_dir

#: Rows of one Arrow batch. Texts can be long, so batches are kept short; the session's byte limit holds as well.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """The package's settings, and short Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def held(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: later steps and lost executors start from there."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Run ``make()`` once per task; the function it returns turns a batch into a dict of output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(step(batch))

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.Array]]) -> DataFrame:
    """Keep the rows for which the batch function says true. All columns pass unread and unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(step(batch))

    return df.mapInArrow(run, df.schema)


def fold(key: Column) -> Column:
    """crc32 of the key as text, mod 5: the fold that separates learning rows from held-out ones."""
    return F.crc32(key.cast("string").cast("binary")) % 5
