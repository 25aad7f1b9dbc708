"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every job of this package relies on. AQE re-plans joins from measured sizes, so a side
#: is broadcast only when its real size is under the threshold, and oversized join partitions are split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
    "spark.sql.cteRecursionRowLimit": "-1",
}

#: What one task of the catalog's queries reads at most, of files and of shuffles, in MB; with the number of partitions that allows it.
#: The defaults (128, 64, 256 MB) are compressed sizes: narrow rows of text unfold to several GB in the sorts of one task.
TASK_MB = {
    "spark.sql.files.maxPartitionBytes": 8,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 32,
}
PARTITIONS = 1000


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bound_tasks(spark: SparkSession) -> SparkSession:
    """Lower what one task reads to TASK_MB; smaller settings stay. Adaptive execution puts small partitions together again."""
    sizes = spark._jvm.org.apache.spark.network.util.JavaUtils
    for key, size in TASK_MB.items():
        if sizes.byteStringAsBytes(spark.conf.get(key)) > size << 20:
            spark.conf.set(key, f"{size}m")
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    most = max(int(spark.conf.get(key, None) or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set(key, str(max(most, PARTITIONS)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A machine-local one is made only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="pricetrail-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: a lost executor re-reads files instead of recomputing the plan."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Whether Spark removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed within leaves no shuffle files. Otherwise they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read back: as cut_lineage, but columns are packed, joins are planned by their real size,
    and what was shuffled for the rows is removed."""
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    untyped = [c for c, kind in df.dtypes if kind == "void"]  # files hold no such columns; all their values are null
    rows = df.withColumns({c: F.lit(None).cast("boolean") for c in untyped})
    with shuffles_removed(df.sparkSession):
        rows.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(rows.schema).parquet(folder).withColumns({c: F.lit(None) for c in untyped})


def forget(*frames: DataFrame) -> None:
    """Removes the folders of stored frames that nothing reads any more. Files that ``stored`` has not written stay."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("stored-"):
                path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
                path.getFileSystem(conf).delete(path, True)
