"""Connected components of a large list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.operators.joins import spread_lookup
from pricetrail.session import cut_lineage


def _starred(links: DataFrame, both: bool) -> DataFrame:
    """One star step over links (high, low): neighbours are tied to the smallest one of them.

    ``both`` ties the larger neighbours of a node, whatever the node's own rank (the large star); without it the
    smaller neighbours of a node and the node itself are tied (the small star). A node's neighbours are never gathered:
    their minimum is aggregated, and the links look it up.
    """
    near = links.select(F.col("high").alias("node"), F.col("low").alias("near"))
    if both:
        near = near.unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("near")))
    least = near.groupBy("node").agg(F.min("near").alias("least"))
    met = spread_lookup(near, least, ["node"], "near", "inner").withColumn("least", F.least("least", "node"))
    if both:
        tied = met.filter(F.col("near") > F.col("node")).select(F.col("near").alias("high"), F.col("least").alias("low"))
    else:
        tied = met.select(F.explode(F.array("near", "node")).alias("high"), F.col("least").alias("low"))
    return tied.filter(F.col("high") != F.col("low")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node of ``links`` (a, b: long).

    Large and small star steps alternate until the links no longer change; the number of rounds grows with the logarithm
    of the longest path. Each round is checkpointed, so a lost executor never replays earlier rounds. Self links, repeated
    links and links in both directions are the same as one; null ends are ignored; no links give no rows.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = cut_lineage(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    before, now = None, _mark(links)
    while now[0] and now != before:
        links = cut_lineage(_starred(_starred(links, True), False))
        before, now = now, _mark(links)
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
