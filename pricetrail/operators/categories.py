"""The category tree: subtrees, paths, prefixes and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.urls import url_part
from pricetrail.operators.joins import several, spread_lookup

SEPARATOR = " › "


def subtree(categories: DataFrame, root: str) -> DataFrame:
    """Ids of a node, of nodes sharing its source URL, and of everything below them. A node met before on the way down is not entered again."""
    return categories.sparkSession.sql(
        """
        WITH RECURSIVE tree(id, above) AS (
          SELECT id, array(id) FROM {c} WHERE id = :root OR source_url = (SELECT max(source_url) FROM {c} WHERE id = :root)
          UNION ALL
          SELECT c.id, array_append(t.above, c.id) FROM {c} c JOIN tree t ON c.parent_id = t.id WHERE NOT array_contains(t.above, c.id))
        SELECT DISTINCT id FROM tree
        """,
        args={"root": root},
        c=categories,
    )


def category_paths(categories: DataFrame) -> DataFrame:
    """Per node that a root leads to: the root's name, the names below it joined by ' › ', and the depth. See unreached() for the others."""
    return categories.sparkSession.sql(
        """
        WITH RECURSIVE tree(id, root_id, root_name, sub_path, depth) AS (
          SELECT id, id, name, CAST('' AS STRING), 0 FROM {c} WHERE parent_id IS NULL
          UNION ALL
          SELECT c.id, t.root_id, t.root_name,
            CASE WHEN t.sub_path = '' THEN c.name ELSE t.sub_path || ' › ' || c.name END, t.depth + 1
          FROM {c} c JOIN tree t ON c.parent_id = t.id)
        SELECT * FROM tree
        """,
        c=categories,
    )


def unreached(categories: DataFrame) -> DataFrame:
    """Nodes that category_paths cannot place because no root leads to them: below an unknown parent, in a cycle, or below one."""
    return categories.join(category_paths(categories).select("id"), "id", "left_anti")


def check_tree(categories: DataFrame) -> DataFrame:
    """Faulty nodes: unknown parent, conflicting parents, or a level that is not the depth."""
    nodes = categories.groupBy("id").agg(
        F.min(F.coalesce("parent_id", F.lit(""))).alias("parent_id"),
        F.max(F.coalesce("parent_id", F.lit(""))).alias("other_parent"),
        F.min("level").alias("level"),
    )
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("level").alias("parent_level"))
    joined = spread_lookup(nodes, parents, ["parent_id"], "id")
    root = F.col("parent_id") == ""
    error = (
        F.when(several(F.col("parent_id"), F.col("other_parent")), "conflicting parents")
        .when(~root & F.col("parent_level").isNull(), "unknown parent")
        .when(F.col("level") != F.when(root, 0).otherwise(F.col("parent_level") + 1), "level is not the depth")
    )
    return joined.select("id", error.alias("error")).filter("error IS NOT NULL")


def url_prefixes(url: Column) -> Column:
    """Every prefix of a URL that ends with '/', shortest first, and the URL itself."""
    parts = F.split(url, "/")
    ends = F.sequence(F.lit(1), F.size(parts))
    cut = F.transform(ends, lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    return F.array_distinct(F.concat(F.slice(cut, 1, F.size(parts) - 1), F.array(url)))


def category_for(df: DataFrame, categories: DataFrame, row_id: str, url: str, fallback: Column | None = None) -> DataFrame:
    """Category with the longest source URL that starts a product's URL, as category_id.

    Prefixes are matched by equality, so the join is a hash join whatever the number of categories. Every folder of URLs is looked up
    once, not once a product: prefixes that nearly all URLs share would bring all products together. Category URLs end with '/', as
    listing routes do; one that does not is met by the same URL only.
    """
    roots = categories.groupBy(F.col("source_url").alias("_prefix")).agg(F.min("id").alias("_category"))
    folder = F.when(F.contains(F.col(url), F.lit("/")), F.regexp_extract(F.col(url), "(?s)^.*/", 0))
    rows = df.withColumn("_folder", folder)
    folders = rows.select("_folder").filter("_folder IS NOT NULL").distinct()
    tries = folders.select("_folder", F.explode(url_prefixes(F.col("_folder"))).alias("_prefix"))
    hits = spread_lookup(tries, roots, ["_prefix"], "_folder", "inner")
    best = hits.groupBy("_folder").agg(F.max_by("_category", F.length("_prefix")).alias("_found"))
    rows, found = spread_lookup(rows, best, ["_folder"], row_id), F.col("_found")
    exact = roots.filter("NOT endswith(_prefix, '/')")
    if not exact.isEmpty():
        exact = exact.select(F.col("_prefix").alias("_url"), F.col("_category").alias("_same"))
        rows = spread_lookup(rows.withColumn("_url", F.col(url)), exact, ["_url"], row_id)
        found = F.coalesce("_same", found)
    found = found if fallback is None else F.coalesce(found, fallback)
    return rows.withColumn("category_id", found).drop("_found", "_folder", "_url", "_same")


def descendants_by_prefix(categories: DataFrame, root_url: str) -> DataFrame:
    """Categories whose URL starts with the root's URL (the root too)."""
    return categories.filter(F.col("source_url").startswith(root_url))


def exclude_prefixes(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    kept = df
    for prefix in prefixes:
        kept = kept.filter(~F.col(column).startswith(prefix))
    return kept


def resolve_category_path(df: DataFrame, categories: DataFrame, row_id: str, category: str, sub: str) -> DataFrame:
    """Resolve category names: a root that is unique by name, then a unique child per step.

    Gives category_id (the deepest node reached) and needs_review. Paths whose every step is unique
    are indexed once; names look up all their own path prefixes and keep the longest. Every pair of names is looked up once, not once
    a row: a name that many rows have would bring them together.
    """
    spark = categories.sparkSession
    siblings = categories.groupBy(F.coalesce("parent_id", F.lit("")).alias("parent"), "name").agg(
        F.min("id").alias("id"), F.max("id").alias("other")
    )
    unique = siblings.filter("id = other").select("parent", "name", "id")
    index = spark.sql(
        """
        WITH RECURSIVE named(id, path, depth) AS (
          SELECT id, name, 1 FROM {u} WHERE parent = ''
          UNION ALL
          SELECT u.id, n.path || ' › ' || u.name, n.depth + 1 FROM {u} u JOIN named n ON u.parent = n.id)
        SELECT id AS _node, path AS _path, depth AS _depth FROM named
        """,
        u=unique,
    )
    whole = F.concat(F.array(F.col(category)), F.when(F.col(sub).isNull(), F.array().cast("array<string>")).otherwise(
        F.split(F.col(sub), SEPARATOR)))
    rows = df.withColumn("_names", F.when(F.col(category).isNotNull(), F.to_json(F.array(F.col(category), F.col(sub)))))
    steps = rows.filter("_names IS NOT NULL").select("_names", category, sub).distinct().select("_names", whole.alias("_steps"))
    tries = steps.select(
        "_names",
        F.size("_steps").alias("_wanted"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("_steps")),
                              lambda n: F.array_join(F.slice("_steps", 1, n), SEPARATOR))).alias("_path"),
    )
    hits = spread_lookup(tries, index, ["_path"], "_names")
    best = hits.groupBy("_names").agg(
        F.max_by("_node", "_depth").alias("category_id"),
        (F.coalesce(F.max("_depth"), F.lit(0)) < F.max("_wanted")).alias("_short"),
    )
    return (
        spread_lookup(rows, best, ["_names"], row_id)
        .withColumn("needs_review", F.coalesce("_short", F.lit(False)))
        .drop("_short", "_names")
    )
