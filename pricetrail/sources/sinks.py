"""Change-log append, catalog export and audit rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.operators.categories import category_paths
from pricetrail.operators.changes import assign_versions
from pricetrail.operators.joins import spread_lookup
from pricetrail.schemas import CHANGES, IMPORT_HISTORY, SYNC_HISTORY
from pricetrail.sources.manifest import Manifest, Part, Store

# The columns of an exported catalog, in order, and what each holds.
EXPORT_COLUMNS = {
    "SKU": "sku",
    "Cod de bare": "barcode",
    "Denumire": "name",
    "Categorie": "category",
    "Subcategorie": "subcategory",
    "Brand": "brand",
    "Cantitate": "quantity",
    "Preț": "price",
    "Promoție": "promo_price",
    "Preț vechi": "old_price",
    "Reducere %": "discount_percent",
    "Data actualizării": "updated_at",
}
UNNAMED = "Denumire indisponibilă"


def versioned(changes: DataFrame, base_version: int) -> DataFrame:
    """Changes (kind, entity_id, payload struct or JSON) with gapless versions; each payload carries its own."""
    numbered = assign_versions(changes, base_version, ["kind", "entity_id"])
    if isinstance(numbered.schema["payload"].dataType, T.StructType):
        fields = [c for c in numbered.schema["payload"].dataType.names if c != "version"]
        whole = F.struct(*[F.col("payload")[c].alias(c) for c in fields], F.col("version"))
        text = F.to_json(whole, {"ignoreNullFields": "false"})
    else:
        body = F.regexp_replace(F.col("payload"), r"\}\s*$", "")
        comma = F.when(F.trim(body) == "{", "").otherwise(",")
        text = F.concat(body, comma, F.lit('"version":'), F.col("version"), F.lit("}"))
    return numbered.withColumn("payload", text).select("version", "kind", "entity_id", "payload")


def found_log(spark: SparkSession, folder: str, head: int) -> None:
    """Begin a log after a version, whose earlier changes lie elsewhere. Fails if the log has begun."""
    Store(spark, folder).publish(Manifest(), generation=uuid.uuid4().hex, head=head)


def publish(changes: DataFrame, base_version: int, folder: str) -> DataFrame:
    """Append a batch of changes, at most one per entity, to the log and give it back.

    A batch must follow the log's head (0 for a new log); anything else would lose events or leave a gap and is refused. A batch
    counts once the manifest names it, so after a failure it is simply published again. The last batch may be published
    again with the same rows, which changes nothing. Of two writers, one fails with Taken.
    """
    store = Store(changes.sparkSession, folder)
    current, rows = store.read(), versioned(changes, base_version)
    if base_version != current.head:
        last = current.parts[-1] if current.parts else None
        if last is None or base_version != last.first - 1 or _content(rows) != _content(store.rows([last.folder], CHANGES)):
            raise ValueError(f"a batch after version {base_version} does not follow the log's head {current.head}")
        return store.rows([last.folder], CHANGES)
    name = store.write(rows, "log")
    written = store.rows([name], CHANGES)
    count = written.count()
    if count:
        part = Part(name, base_version + 1, base_version + count, count)
        store.publish(current, generation=current.generation or uuid.uuid4().hex, head=part.last, parts=(*current.parts, part))
    return written


def _content(rows: DataFrame) -> tuple:
    """Count and digest sum of a batch: equal for the same rows in any order."""
    digest = F.xxhash64("version", "kind", "entity_id", "payload").cast("decimal(38,0)")
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(digest)).first())


def export_rows(products: DataFrame, categories: DataFrame, aliases: DataFrame) -> DataFrame:
    """The exported table: all texts, one extra row per alias barcode other than the product's own."""
    paths = category_paths(categories).select(
        F.col("id").alias("category_id"), F.col("root_name").alias("category"), F.col("sub_path").alias("subcategory"))
    rows = spread_lookup(products, paths, ["category_id"], "id")
    codes = aliases.select(F.col("product_id").alias("id"), F.col("barcode").alias("_code"))
    more = spread_lookup(codes, rows, ["id"], "_code", "inner").filter(~F.col("barcode").eqNullSafe(F.col("_code")))
    more = more.withColumn("barcode", F.col("_code")).select(*rows.columns)
    return rows.unionByName(more).select(*[_text(rows, source).alias(head) for head, source in EXPORT_COLUMNS.items()])


def _text(rows: DataFrame, column: str) -> Column:
    if column not in rows.columns:
        return F.lit("")
    c = F.col(column)
    if isinstance(rows.schema[column].dataType, T.DecimalType):
        c = c.cast("double")
    return F.coalesce(c.cast("string"), F.lit(UNNAMED if column == "name" else ""))


def export_catalog(products: DataFrame, categories: DataFrame, aliases: DataFrame, folder: str) -> None:
    """Write export_rows as UTF-8 CSV files that start with a byte-order mark."""
    rows = export_rows(products, categories, aliases)
    marked = rows.withColumnRenamed("SKU", "\ufeffSKU")
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("emptyValue", "").csv(folder)


def append_history(rows: DataFrame, folder: str, kind: str = "import") -> None:
    """Append audit rows of imports or sync runs with their fixed schema."""
    schema = T.StructType.fromDDL(IMPORT_HISTORY if kind == "import" else SYNC_HISTORY)
    columns = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
               for f in schema.fields]
    rows.select(columns).write.mode("append").parquet(folder)
