"""SKU/barcode pairs: import, reconciliation, association and merging.

A row's relatives (pairs that share its SKU or its barcode) are never joined to it one by one. They
are reduced per SKU and per barcode to minimum, maximum and flags, and a row is compared with those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.operators.joins import several, sole, spread_lookup
from pricetrail.operators.paging import offset_page
from pricetrail.session import cut_lineage, stored

# Fixed value: what a merged product takes from the source row when the target lacks it.
FILLED_BY_MERGE = ("sku", "barcode", "name", "brand", "quantity", "category_id", "product_url", "thumbnail_url")


def pair_key(sku: Column, barcode: Column) -> Column:
    """Identity of a pair: SHA-256 of the JSON list [sku, barcode] in ASCII."""
    text = F.regexp_replace(F.to_json(F.array(sku, barcode)), r'^\[("(?:[^"\\]|\\.)*"),', r"[$1, ")
    return F.sha2(ascii_json(text), 256)


def ascii_json(text: Column) -> Column:
    """JSON text with the UTF-16 units of every character beyond the tilde as escapes."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"^[\x00-~]$"), c).otherwise(units(c)))
    return F.when(text.rlike(r"[^\x00-~]"), F.array_join(escaped, "")).otherwise(text)


def invalid_key(*parts: Column) -> Column:
    """Identity of an invalid row: SHA-256 of its whole content."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def ambiguous_pairs(rows: DataFrame, row_id: str) -> DataFrame:
    """Rows with ``ambiguous``: their SKU has several barcodes, or their barcode several SKUs.

    Every member of such a group is flagged, the first one included.
    """
    pairs = rows.filter("sku IS NOT NULL AND barcode IS NOT NULL")
    flagged = rows
    for key, other in (("sku", "barcode"), ("barcode", "sku")):
        bad = pairs.groupBy(key).agg(F.min(other).alias("_l"), F.max(other).alias("_h")).filter("_l <> _h")
        bad = bad.select(key, F.lit(True).alias(f"_bad_{key}"))
        flagged = spread_lookup(flagged, bad, [key], row_id)
    whole = F.col("sku").isNotNull() & F.col("barcode").isNotNull()
    bad = F.coalesce("_bad_sku", "_bad_barcode", F.lit(False))
    return flagged.withColumn("ambiguous", whole & bad).drop("_bad_sku", "_bad_barcode")


def _facts(file: DataFrame | None, pending: DataFrame, products: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Everything known about each value of either identifier: one pass over each input, one aggregation, stored once.

    kind ('sku' or 'barcode') and value; f_* other identifiers in the file, r_* and rp_* partners and products of stored related rows,
    p_* the products that hold the value.
    """
    sides = F.explode(F.array(*[
        F.struct(F.lit(key).alias("kind"), F.col(key).alias("value"), F.col(other).alias("other"))
        for key, other in (("sku", "barcode"), ("barcode", "sku"))])).alias("_s")
    known = pending.filter(F.col("status") != "invalid").select(
        sides, (F.col("status") == "needsReview").alias("_review"), F.col("product_id").alias("_rp"))
    everything = known.select("_s.kind", "_s.value", F.col("_s.other").alias("_r"), "_review", "_rp")
    held = products.select(sides, F.col("id").alias("_p"), F.col("barcode").alias("_pb"), F.col("source_product_id").alias("_ps"))
    everything = everything.unionByName(held.select("_s.kind", "_s.value", "_p", "_pb", "_ps"), allowMissingColumns=True)
    if aliases is not None:
        more = aliases.select(F.lit("barcode").alias("kind"), F.col("barcode").alias("value"), F.col("product_id").alias("_p"))
        everything = everything.unionByName(more, allowMissingColumns=True)
    if file is not None:
        given = file.select(sides).select("_s.kind", "_s.value", F.col("_s.other").alias("_f"))
        everything = everything.unionByName(given, allowMissingColumns=True)
    ranges = []
    for column, name in (("_f", "f"), ("_r", "r"), ("_rp", "rp"), ("_p", "p")):
        if column in everything.columns:
            ranges += [F.min(column).alias(f"{name}_low"), F.max(column).alias(f"{name}_high")]
    return cut_lineage(everything.filter(F.col("value").isNotNull()).groupBy("kind", "value").agg(
        *ranges, F.coalesce(F.bool_or("_review"), F.lit(False)).alias("review"),
        F.max("_pb").alias("p_barcode"), F.max("_ps").alias("p_source")))


def _with_facts(pairs: DataFrame, file: DataFrame | None, pending: DataFrame, products: DataFrame,
                aliases: DataFrame | None) -> DataFrame:
    facts, rows = _facts(file, pending, products, aliases), pairs
    for key, other in (("sku", "barcode"), ("barcode", "sku")):
        named = [F.col(c).alias(f"{key}_{c}") for c in facts.columns if c not in ("kind", "value")]
        rows = spread_lookup(rows, facts.filter(F.col("kind") == key).select(F.col("value").alias(key), *named), [key], other)
    return rows


def _differs(low: Column, high: Column, value: Column) -> Column:
    """Some member of a min/max range is not the value."""
    return F.coalesce((low != value) | (high != value), F.lit(False))


def _related_conflict() -> Column:
    """A stored row that shares one identifier has another partner, or waits for review."""
    sku, barcode = F.col("sku"), F.col("barcode")
    return (
        _differs(F.col("sku_r_low"), F.col("sku_r_high"), barcode)
        | _differs(F.col("barcode_r_low"), F.col("barcode_r_high"), sku)
        | F.coalesce("sku_review", F.lit(False))
        | F.coalesce("barcode_review", F.lit(False))
    )


def _file_conflict() -> Column:
    return several(F.col("sku_f_low"), F.col("sku_f_high")) | several(F.col("barcode_f_low"), F.col("barcode_f_high"))


def _claimed_elsewhere(product: Column) -> Column:
    """A related stored row is matched to another product."""
    ranges = [(F.col(f"{k}_rp_low"), F.col(f"{k}_rp_high")) for k in ("sku", "barcode")]
    tests = [F.when(product.isNull(), low.isNotNull()).otherwise(_differs(low, high, product)) for low, high in ranges]
    return tests[0] | tests[1]


def _owner_elsewhere(product: Column) -> Column:
    """Some holder of the barcode is not the product."""
    low, high = F.col("barcode_p_low"), F.col("barcode_p_high")
    return F.when(product.isNull(), low.isNotNull()).otherwise(_differs(low, high, product))


def _product() -> Column:
    return sole(F.col("sku_p_low"), F.col("sku_p_high"))


def _other_barcode() -> Column:
    """The product found by SKU already has a different barcode."""
    return F.coalesce(F.col("sku_p_barcode") != F.col("barcode"), F.lit(False))


def import_identifiers(rows: DataFrame, pending: DataFrame, products: DataFrame) -> DataFrame:
    """Import a file of pairs (row_number, sku, barcode, error) into the central store.

    One result row per distinct pair and per invalid row: id, sku, barcode, status, product_id,
    copies, prior (the pair was stored before) and counter (what its first row counts as). The rows of
    a file do not influence each other beyond the ambiguity flag, so order does not matter. An invalid row is known by all that is
    given of it: with the columns file, sheet and raw, equal row numbers of different files are different rows.
    """
    named = [c for c in ("file", "sheet", "row_number", "sku", "barcode", "error", "raw") if c in rows.columns]
    given = F.col("error").isNotNull().alias("_invalid")
    unread = F.when(F.col("error").isNotNull(), invalid_key(*[F.col(c).cast("string") for c in named])).alias("_unread")
    pair = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("sku", "barcode")]
    distinct = cut_lineage(rows.select(given, unread, *pair, "row_number").groupBy("_invalid", "_unread", "sku", "barcode").agg(
        F.count(F.lit(1)).alias("copies"), F.min("row_number").alias("row_number")))
    valid = distinct.filter("NOT _invalid").drop("_invalid", "_unread")
    keyed = distinct.withColumn("id", F.coalesce("_unread", pair_key(F.col("sku"), F.col("barcode"))))
    stored = pending.select("id", F.col("status").alias("_status"), F.col("product_id").alias("_product"))
    facts = _with_facts(keyed.join(stored, "id", "left"), valid, pending, products, None)
    product, prior = _product(), F.col("_status").isNotNull()
    held = F.col("sku_p_low").isNotNull()
    attachable = product.isNotNull() & ~_other_barcode() & ~_owner_elsewhere(product)
    reconciled = F.when(
        (F.col("_status") == "pending") & product.isNotNull(),
        F.when(_related_conflict() | _claimed_elsewhere(product) | ~attachable, "needsReview").otherwise("matched"),
    ).otherwise(F.col("_status"))
    fresh = (
        F.when(_file_conflict() | _related_conflict(), "needsReview")
        .when(held & attachable, "matched")
        .when(held | F.col("barcode_p_low").isNotNull(), "needsReview")
        .otherwise("pending")
    )
    status = F.when(prior, reconciled).otherwise(fresh)
    had_it = F.col("sku_p_barcode") == F.col("barcode")
    counter = (
        F.when(status == "needsReview", "conflicts")
        .when((status == "matched") & (prior | F.coalesce(had_it, F.lit(False))), "alreadyMatched")
        .otherwise(status)
    )
    owner = F.when(prior & (F.col("_status") != "pending"), F.col("_product")).when(status == "matched", product)
    # rows that cannot be read count one by one, also where a file repeats them
    bad = F.col("_invalid")
    fresh_match = ~prior & (counter == "matched")
    decided = facts.select(
        "id", "sku", "barcode", F.when(bad, "invalid").otherwise(status).alias("status"), F.when(~bad, owner).alias("product_id"),
        F.when(bad, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"), "row_number", prior.alias("prior"),
        F.when(bad, "invalid").otherwise(counter).alias("counter"), (~bad & fresh_match).alias("attaches_barcode"),
        F.explode(F.when(bad, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array(F.lit(1).cast("long")))).alias("_each"))
    return decided.drop("_each")


def import_report(result: DataFrame) -> DataFrame:
    """Counters of an import: a stored pair counts all its copies as duplicates, a new one all but the first."""
    copies, prior, status = F.col("copies"), F.col("prior"), F.col("status")
    repeats = F.when(prior, copies).otherwise(copies - 1)
    repeat_counter = F.when(status == "matched", "alreadyMatched").when(status == "needsReview", "conflicts").otherwise(status)

    def total(name: str) -> Column:
        first = F.when(~prior & (F.col("counter") == name), 1).otherwise(0)
        rest = F.when(repeat_counter == name, repeats).otherwise(0)
        return F.coalesce(F.sum(first + rest), F.lit(0)).alias(name)

    return result.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("read"),
        F.coalesce(F.sum(F.when(status != "invalid", copies)), F.lit(0)).alias("valid"),
        *[total(n) for n in ("matched", "alreadyMatched", "pending", "conflicts", "invalid")],
        F.coalesce(F.sum(repeats), F.lit(0)).alias("duplicate"),
        F.lit(0).cast("long").alias("errors"),
    )


def reconcile(pending: DataFrame, products: DataFrame) -> DataFrame:
    """Pending pairs whose SKU a product now has: matched, or needsReview on any contradiction.

    attaches_barcode marks the products that receive the pair's barcode.
    """
    open_rows = pending.filter("status = 'pending' AND sku <> '' AND barcode <> ''")
    rows = _with_facts(open_rows, None, pending, products, None)
    product = _product()
    conflict = _related_conflict() | _claimed_elsewhere(product) | _owner_elsewhere(product) | _other_barcode()
    return _reconciled(rows, product, product.isNotNull(), conflict)


def replica_reconcile(pending: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """The replica's form: aliases count, the product must come from the shop, and an SKU that several
    products share goes to review."""
    open_rows = pending.filter("status = 'pending' AND sku <> '' AND barcode <> ''")
    rows = _with_facts(open_rows, None, pending, products, aliases)
    product = _product()
    shared = several(F.col("sku_p_low"), F.col("sku_p_high"))
    sourced = product.isNotNull() & (F.coalesce("sku_p_source", F.lit("")) != "")
    conflict = _related_conflict() | _claimed_elsewhere(product) | _owner_elsewhere(product) | _other_barcode()
    return _reconciled(rows, product, sourced | shared, conflict | shared)


def _reconciled(rows: DataFrame, product: Column, decided: Column, conflict: Column) -> DataFrame:
    status = F.when(~decided, "pending").when(conflict, "needsReview").otherwise("matched")
    matched = status == "matched"
    return rows.select(
        "id", "sku", "barcode", status.alias("status"), F.when(matched, product).alias("product_id"),
        (matched & F.col("sku_p_barcode").isNull()).alias("attaches_barcode"))


def strict_import(rows: DataFrame, pending: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """The replica's import: both identifiers, a product with a source id, and no contradiction at all.

    One result row per distinct pair: status, counter of its first row, copies. Rows that lack an
    identifier are invalid.
    """
    whole = "coalesce(sku, '') <> '' AND coalesce(barcode, '') <> ''"
    valid = rows.filter(whole).groupBy("sku", "barcode").agg(F.count(F.lit(1)).alias("copies"))
    facts = _with_facts(valid, valid, pending, products, aliases)
    only = _product()
    product = F.when(F.coalesce("sku_p_source", F.lit("")) != "", only)
    conflict = (
        several(F.col("sku_p_low"), F.col("sku_p_high")) | _file_conflict() | _related_conflict()
        | _owner_elsewhere(product) | (product.isNotNull() & _other_barcode()) | _claimed_elsewhere(product))
    status = F.when(conflict, "needsReview").when(product.isNull(), "pending").otherwise("matched")
    had_it = F.coalesce(F.col("sku_p_barcode") == F.col("barcode"), F.lit(False))
    counter = (
        F.when(status == "needsReview", "conflicts").when(status == "pending", "pending")
        .when(had_it, "alreadyMatched").otherwise("matched"))
    good = facts.select("sku", "barcode", status.alias("status"), F.when(status == "matched", product).alias("product_id"),
                        "copies", counter.alias("counter"))
    bad = rows.filter(f"NOT ({whole})").groupBy("sku", "barcode").agg(F.count(F.lit(1)).alias("copies"))
    return good.unionByName(bad.select("sku", "barcode", F.lit("invalid").alias("status"),
                                       F.lit(None).cast("string").alias("product_id"), "copies", F.lit("invalid").alias("counter")))


def pending_list(pending: DataFrame, query: str | None = None, offset: int = 0, limit: int = 60) -> DataFrame:
    """Unmatched pairs, optionally by exact SKU or barcode, in id order."""
    rows = pending.filter(F.col("status") != "matched")
    if query:
        rows = rows.filter((F.col("sku") == query) | (F.col("barcode") == query))
    return offset_page(rows, [F.col("id")], offset, limit)


def associate(links: DataFrame, pending: DataFrame, products: DataFrame) -> DataFrame:
    """Reviewed links (identifier_id, product_id): matched, or why the link is refused.

    Links that claim one product for different pairs, or one pair for different products, are all
    refused. Links and pairs meet once and are stored; of the products only those that links name meet them, and only links that
    their own pair and product do not settle are looked up among the holders and put beside each other.
    """
    chosen = pending.select(F.col("id").alias("identifier_id"), "sku", "barcode", F.lit(True).alias("_row"))
    rows = stored(spread_lookup(links, chosen, ["identifier_id"], "product_id"))
    target = products.select(
        F.col("id").alias("product_id"), F.col("sku").alias("_sku"), F.col("barcode").alias("_barcode"), F.lit(True).alias("_known"))
    target = stored(target.join(rows.select("product_id").distinct(), "product_id", "left_semi"))
    rows = spread_lookup(rows, target, ["product_id"], "identifier_id")
    product = F.col("product_id")
    other = F.coalesce(F.col("_sku") != F.col("sku"), F.lit(False)) | F.coalesce(
        F.col("_barcode") != F.col("barcode"), F.lit(False))
    whole = (F.coalesce("sku", F.lit("")) != "") & (F.coalesce("barcode", F.lit("")) != "")
    outcome = (
        F.when(F.col("_row").isNull() | F.col("_known").isNull(), "unknown")
        .when(~whole, "invalid").when(other, "conflict"))
    rows = rows.select("identifier_id", "product_id", "sku", "barcode", outcome.alias("outcome"))
    settled, left = rows.filter("outcome IS NOT NULL"), rows.filter("outcome IS NULL").drop("outcome")
    for key in ("sku", "barcode"):
        held = products.filter(F.col(key).isNotNull()).groupBy(key).agg(
            F.min("id").alias(f"_{key}_low"), F.max("id").alias(f"_{key}_high"))
        left = spread_lookup(left, held, [key], "identifier_id")
    elsewhere = _differs(F.col("_sku_low"), F.col("_sku_high"), product) | _differs(
        F.col("_barcode_low"), F.col("_barcode_high"), product)
    left = stored(left.select("identifier_id", "product_id", "sku", "barcode", F.when(elsewhere, "conflict").otherwise("matched").alias("outcome")))
    free = left.filter("outcome = 'matched'").drop("outcome")
    claims = free.withColumn("_clash", F.lit(False))
    for key, value in (("product_id", "identifier_id"), ("sku", "product_id"), ("barcode", "product_id")):
        clash = free.groupBy(key).agg(F.min(value).alias("_l"), F.max(value).alias("_h")).filter("_l <> _h")
        claims = spread_lookup(claims, stored(clash.select(key, F.lit(True).alias("_one"))), [key], "identifier_id")
        claims = claims.withColumn("_clash", F.col("_clash") | F.col("_one").isNotNull()).drop("_one")
    claims = claims.select("identifier_id", "product_id", "sku", "barcode", F.when(F.col("_clash"), "conflict").otherwise("matched").alias("outcome"))
    return settled.unionByName(left.filter("outcome <> 'matched'")).unionByName(claims)


def checked_merges(merges: DataFrame, products: DataFrame) -> DataFrame:
    """Merges (source_id, target_id) with ``refused``: same product, unknown product, or different SKUs."""
    known = products.select("id", "sku")
    rows = merges
    for side in ("source", "target"):
        rows = rows.join(known.select(F.col("id").alias(f"{side}_id"), F.col("sku").alias(f"_{side}"),
                                      F.lit(True).alias(f"_{side}_known")), f"{side}_id", "left")
    refused = (
        F.when(F.col("source_id") == F.col("target_id"), "same product")
        .when(F.col("_source_known").isNull() | F.col("_target_known").isNull(), "unknown product")
        .when(F.col("_source") != F.col("_target"), "different skus"))
    return rows.select("source_id", "target_id", refused.alias("refused"))


def merge_products(merges: DataFrame, products: DataFrame) -> DataFrame:
    """Catalog after merging accepted (source_id, target_id) pairs; a product is in at most one pair.

    The target keeps its own data, takes what it lacks from the source and leaves review.
    """
    good = checked_merges(merges, products).filter("refused IS NULL")
    source = products.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"_{c}") for c in FILLED_BY_MERGE])
    offers = good.join(source, "source_id").drop("refused").withColumnRenamed("target_id", "id")
    kept = products.join(good.select(F.col("source_id").alias("id")), "id", "left_anti").join(offers, "id", "left")
    values = {c: F.coalesce(c, f"_{c}") for c in FILLED_BY_MERGE}
    if "needs_review" in products.columns:
        values["needs_review"] = F.col("needs_review") & F.col("source_id").isNull()
    return kept.withColumns(values).select(*products.columns)


def repoint(bridge: DataFrame, merges: DataFrame, column: str = "product_id") -> DataFrame:
    """Bridge or pending rows after accepted merges: source ids become target ids, repeats fall away."""
    moved = merges.select(F.col("source_id").alias(column), "target_id")
    spread = next((c for c in bridge.columns if c != column), column)
    rows = spread_lookup(bridge, moved, [column], spread)
    return rows.withColumn(column, F.coalesce("target_id", column)).select(*bridge.columns).distinct()


def detail_merges(details: DataFrame, products: DataFrame) -> DataFrame:
    """Merges implied by detail pages (id, sku): the one import row without a URL that has the SKU."""
    imported = products.filter("product_url IS NULL AND sku IS NOT NULL").groupBy("sku").agg(
        F.min("id").alias("_low"), F.max("id").alias("_high"))
    online = products.filter("product_url IS NOT NULL").select("id", F.col("sku").alias("_own"))
    rows = spread_lookup(details.filter("sku IS NOT NULL").select("id", "sku"), imported, ["sku"], "id", "inner")
    rows = rows.filter("_low = _high AND _low <> id").join(online, "id")
    return rows.filter("_own IS NULL OR _own = sku").select(F.col("_low").alias("source_id"), F.col("id").alias("target_id"))


def apply_identifier_events(pending: DataFrame, events: DataFrame) -> DataFrame:
    """Central identifier events (sku, barcode, status, product_id) on the replica's pairs.

    Pairs are matched null-safe; an unknown pair is added, an unmatched one becomes matched, and
    anything else stays as it is. Events hold one row per pair.
    """
    marks = {"_sku": F.to_json(F.array("sku")), "_barcode": F.to_json(F.array("barcode"))}
    keys = list(marks)
    news = events.withColumns(marks).select(*keys, F.struct("sku", "barcode", "status", "product_id").alias("_b"))
    rows = spread_lookup(pending.withColumns(marks), news, keys, "id")
    b = F.col("_b")
    upgrade = F.coalesce((b["status"] == "matched") & (F.col("status") != "matched"), F.lit(False))
    outcome = F.when(b.isNull(), "untouched").when(upgrade, "updated").otherwise("kept")
    held = rows.select("sku", "barcode", F.when(upgrade, b["status"]).otherwise(F.col("status")).alias("status"),
                       F.when(upgrade, b["product_id"]).otherwise(F.col("product_id")).alias("product_id"),
                       outcome.alias("outcome"))
    known = pending.withColumns(marks).select(*keys).distinct()
    added = news.join(known, keys, "left_anti").select("_b.*", F.lit("added").alias("outcome"))
    return held.unionByName(added)
