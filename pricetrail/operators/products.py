"""Product projections, search and listing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail.functions.text import FOLD_FROM, FOLD_TO, ascii_lower, contains_literal, search_text
from pricetrail.operators.categories import subtree
from pricetrail.operators.joins import spread_lookup
from pricetrail.operators.promotions import active_promotions, with_active_flag

# Replica column names that are not the camel form of the catalog's.
REPLICA_NAMES = {
    "promo_price": "promotionalPrice",
    "category_id": "categoryNodeId",
    "thumbnail_url": "imageUrl",
    "inactive": "isInactive",
    "possibly_inactive": "possibleInactive",
    "version": "serverVersion",
    "updated_at": "lastUpdated",
}
REPLICA_DROPPED = ("source_image_url", "missing_count", "created_at")


def camel(name: str) -> str:
    """A column name without underscores, what follows each of them in upper case."""
    return re.sub("_+(.)", lambda found: found[1].upper(), name)


def iso(c: Column) -> Column:
    """ISO text in UTC; microseconds only when there are any."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))


def payload(df: DataFrame) -> DataFrame:
    """Public form: camel-case names, decimals as doubles, timestamps as ISO text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso(c)
        columns.append(c.alias(camel(f.name)))
    return df.select(columns)


def flatten_documents(df: DataFrame, schema: str) -> DataFrame:
    """Document rows (id, data JSON, version) with the document's keys as columns."""
    parsed = df.select(F.from_json("data", schema).alias("data"), "id", "version")
    fields = [f for f in parsed.schema["data"].dataType.names if f not in ("id", "version")]
    return parsed.select(*[F.col("data")[f].alias(f) for f in fields], "id", "version")


def with_search_text(df: DataFrame) -> DataFrame:
    return df.withColumn("search_text", search_text(*[F.col(c) for c in ("name", "sku", "barcode", "brand")]))


def to_replica(df: DataFrame) -> DataFrame:
    """Replica columns: renamed, flags as 0/1, unknown stock as null."""
    columns = []
    for f in df.schema.fields:
        if f.name in REPLICA_DROPPED:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso(c)
        columns.append(c.alias(REPLICA_NAMES.get(f.name, camel(f.name))))
    return df.select(columns)


def fold_literal(text: str) -> str:
    """The folded form of a search argument."""
    return re.sub(r"\s+", " ", text.lower().strip().translate(str.maketrans(FOLD_FROM, FOLD_TO)))


def search(df: DataFrame, aliases: DataFrame, query: str) -> DataFrame:
    """Products whose SKU, barcode or alias is the query, or whose search text matches it.

    A plain query also matches when each of its words begins some word of the text; any query matches
    as a literal substring. All text tests are built-in string predicates on one scan.
    """
    if not query.strip():
        return df
    raw, folded = query.strip(), fold_literal(query)
    text = search_text(*[F.col(c) for c in ("name", "sku", "barcode", "brand")])
    match = contains_literal(text, folded)
    if re.fullmatch("[a-z0-9 ]+", folded):
        words = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
        prefixed = F.lit(True)
        for token in folded.split():
            prefixed = prefixed & contains_literal(words, f" {token}")
        match = match | prefixed
    for column in ("sku", "barcode"):
        match = match | F.coalesce(F.col(column) == raw, F.lit(False))
    owners = aliases.filter(F.col("barcode") == raw).select(F.col("product_id").alias("id")).distinct()
    flagged = df.join(owners.withColumn("_alias", F.lit(True)), "id", "left")
    return flagged.filter(match | F.col("_alias").isNotNull()).drop("_alias")


def in_collection(df: DataFrame, members: DataFrame, collection_id: str) -> DataFrame:
    inside = members.filter(F.col("collection_id") == collection_id).select(F.col("product_id").alias("id"))
    return df.join(inside, "id", "left_semi")


def in_subtree(df: DataFrame, categories: DataFrame, root: str) -> DataFrame:
    inside = subtree(categories, root).select(F.col("id").alias("category_id"))
    return spread_lookup(df, inside, ["category_id"], "id", "left_semi")


def needs_review(df: DataFrame) -> DataFrame:
    return df.filter("needs_review")


def products(
    df: DataFrame,
    tables: dict[str, DataFrame],
    at: Column,
    query: str = "",
    category_id: str | None = None,
    collection: str | None = None,
    promotions: bool = False,
    review: bool = False,
) -> DataFrame:
    """Conjunction of the optional filters; tables holds aliases, categories, members, links, promotions."""
    rows = search(df, tables["aliases"], query) if query.strip() else df
    if review:
        rows = needs_review(rows)
    if category_id is not None:
        rows = in_subtree(rows, tables["categories"], category_id)
    if collection is not None:
        rows = in_collection(rows, tables["members"], collection)
    if promotions:
        rows = active_promotions(rows, tables["links"], tables["promotions"], at).drop("active")
    return rows


def name_order() -> list[Column]:
    """Names without regard to ASCII case, then ids."""
    return [ascii_lower(F.col("name")), F.col("id")]


def counts(df: DataFrame, links: DataFrame, promotions: DataFrame, at: Column) -> DataFrame:
    """Total and discounted total of a filtered listing, in one pass."""
    flagged = with_active_flag(df, links, promotions, at)
    return flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if("active").alias("discounted"))
