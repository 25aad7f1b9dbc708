"""Which products belong to a collection or campaign, and how that changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.periods import campaign_status
from pricetrail.operators.changes import number_rows
from pricetrail.operators.joins import spread_lookup
from pricetrail.operators.upsert import put_documents


def members(rows: DataFrame, owner: str, product: str) -> DataFrame:
    """Sorted distinct product ids per owner, as rows with their position.

    Positions come from one range sort over (owner, product): a collection that holds a third of all
    rows is spread over as many tasks as it needs, and no list is built.
    """
    distinct = rows.select(F.col(owner).alias("owner_id"), F.col(product).alias("product_id")).distinct()
    placed = number_rows(distinct, ["owner_id", "product_id"], "_place")
    starts = placed.groupBy("owner_id").agg(F.min("_place").alias("_first"))
    joined = spread_lookup(placed, starts, ["owner_id"], "product_id")
    return joined.select("owner_id", "product_id", (F.col("_place") - F.col("_first") + 1).alias("position"))


def member_lists(positions: DataFrame, size: int = 1000) -> DataFrame:
    """Membership documents in parts of at most ``size`` ids, each sorted, parts in order."""
    part = F.expr(f"(position - 1) div {int(size)} + 1")
    lists = positions.groupBy("owner_id", part.alias("part")).agg(F.sort_array(F.collect_list("product_id")).alias("product_ids"))
    return lists


def membership_diff(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to link (new only) and to unlink (old only)."""
    a, b = new.select(*keys).distinct(), old.select(*keys).distinct()
    link = a.join(b, keys, "left_anti").withColumn("action", F.lit("link"))
    return link.unionByName(b.join(a, keys, "left_anti").withColumn("action", F.lit("unlink")))


def merge_members(seen: DataFrame, linked: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Additive membership: what was seen, linked or published."""
    parts = [df.select(*keys) for df in (seen, linked, published)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def restrict(known: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return known.join(targets.select(key), key, "left_semi")


def all_barcodes(products: DataFrame, aliases: DataFrame) -> DataFrame:
    """Primary and alias barcodes of every product, each once."""
    own = products.filter("barcode IS NOT NULL").select("barcode", F.col("id").alias("product_id"))
    return own.unionByName(aliases.select("barcode", "product_id")).distinct()


def campaign_decision(campaign: DataFrame, stored: DataFrame, found: DataFrame) -> DataFrame:
    """One row: publish, or refuse an older or empty campaign.

    campaign and stored hold (starts_at), at most one row each; found the campaign's products.
    """
    new = campaign.select(F.col("starts_at").alias("_new"))
    old = stored.select(F.col("starts_at").alias("_old"))
    any_found = found.limit(1).select(F.lit(1).alias("_found"))
    facts = new.unionByName(old, allowMissingColumns=True).unionByName(any_found, allowMissingColumns=True)
    facts = facts.agg(F.max("_new").alias("_new"), F.max("_old").alias("_old"), F.count("_found").alias("_found"))
    older = F.coalesce(F.col("_old") > F.col("_new"), F.lit(False))
    decision = F.when(F.col("_found") == 0, "empty campaign").when(older, "older campaign").otherwise("publish")
    return facts.select(decision.alias("decision"))


def campaign_statuses(promotions: DataFrame, current_id: str, kind: str, at: Column) -> DataFrame:
    """Status of every promotion of a kind once a campaign is published: an earlier one that is still
    running becomes historical."""
    status = campaign_status(F.col("starts_at"), F.col("ends_at"), at)
    other = F.col("id") != current_id
    named = F.when(other & (status == "active"), "historical").otherwise(status)
    return promotions.filter(F.col("type") == kind).withColumn("status", named)


def publish_campaign(
    campaign_id: str, found: DataFrame, links: DataFrame, collection: DataFrame, decision: DataFrame
) -> dict[str, DataFrame]:
    """Changes of the campaign's promotion links and of its collection: whole replacement.

    ``decision`` is campaign_decision's row. Unless it says publish, there are no changes at all.
    """
    allowed = F.broadcast(decision.filter("decision = 'publish'"))  # one row or none
    found, links, collection = (
        df.withColumn("decision", F.lit("publish")).join(allowed, "decision", "left_semi").drop("decision") for df in (found, links, collection))
    want = found.select(F.lit(campaign_id).alias("promotion_id"), F.col("id").alias("product_id"))
    had = links.filter(F.col("promotion_id") == campaign_id)
    shown = found.select(F.col("id").alias("product_id"))
    return {
        "links": membership_diff(want, had, ["promotion_id", "product_id"]),
        "collection": membership_diff(shown, collection, ["product_id"]),
    }


def campaign_documents(statuses: DataFrame, campaign_id: str, found: DataFrame, stored: DataFrame, decision: DataFrame) -> DataFrame:
    """Promotion documents after a campaign (id, outcome, data), written only where they differ (``put_documents``).

    ``statuses`` is campaign_statuses's: every promotion of the kind gets a document with its period and status, and the campaign's also
    tells how many members it has and a digest of them that does not depend on their order; the members themselves are rows of the
    bridge. ``stored`` (id, data) are the documents there are. Unless ``decision`` says publish, they stay as they are.
    """
    members = found.select("id").distinct().agg(
        F.count(F.lit(1)).alias("members"), F.coalesce(F.sum(F.crc32(F.col("id").cast("binary"))), F.lit(0)).alias("digest"))
    members = members.select(F.lit(campaign_id).alias("id"), "members", "digest")  # one row
    rows = statuses.join(F.broadcast(members), "id", "left").withColumn("decision", F.lit("publish"))
    rows = rows.join(F.broadcast(decision.filter("decision = 'publish'")), "decision", "left_semi")
    period = [F.col(c).cast("string").alias(c) for c in ("starts_at", "ends_at")]
    return put_documents(stored, rows.select("id", F.to_json(F.struct("status", *period, "members", "digest")).alias("data")))


def collection_modes(scopes: DataFrame, seen: DataFrame) -> DataFrame:
    """How each scope (collection_id, kind, complete, selective, root) may change its collection.

    replace after a complete scope; add (kind 'open') or add_period (kind 'dated') after an incomplete
    one that saw something; keep otherwise. absences says whether missing products may be counted.
    """
    counts = seen.groupBy("collection_id").agg(F.count(F.lit(1)).alias("_seen"))
    rows = scopes.join(counts, "collection_id", "left")
    some = F.coalesce("_seen", F.lit(0)) > 0
    mode = (
        F.when(F.col("selective"), "keep")
        .when(F.col("complete"), "replace")
        .when(some & (F.col("kind") == "open"), "add")
        .when(some & (F.col("kind") == "dated"), "add_period")
        .otherwise("keep")
    )
    absences = F.col("complete") & ~F.col("selective") & F.col("root") & some
    return rows.select("collection_id", mode.alias("mode"), absences.alias("absences"))


def publish_collection(scopes: DataFrame, seen: DataFrame, linked: DataFrame, published: DataFrame) -> DataFrame:
    """Members of every collection after its scope was read.

    seen, linked and published are (collection_id, product_id); published also tells ``same_period``,
    because a dated campaign never inherits the members of the one before it.
    """
    keys = ["collection_id", "product_id"]
    parts = (
        seen.select(*keys, F.lit("seen").alias("_from"), F.lit(True).alias("same_period"))
        .unionByName(linked.select(*keys, F.lit("linked").alias("_from"), F.lit(True).alias("same_period")))
        .unionByName(published.select(*keys, F.lit("published").alias("_from"), "same_period"))
    )
    rows = spread_lookup(parts, collection_modes(scopes, seen), ["collection_id"], "product_id", "inner")
    source, mode = F.col("_from"), F.col("mode")
    taken = (
        ((mode == "replace") & (source == "seen"))
        | (mode == "add")
        | ((mode == "add_period") & ((source == "seen") | ((source == "published") & F.col("same_period"))))
        | ((mode == "keep") & (source == "linked"))
    )
    return rows.filter(taken).select(*keys).distinct()
