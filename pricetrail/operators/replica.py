"""Replica writes: product upsert by any identifier, and the general product import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.operators.categories import resolve_category_path
from pricetrail.operators.identity import IDENTITY_KEYS, contested_products, match_keys, resolve_identity, shared_groups
from pricetrail.operators.joins import several, sole, spread_lookup
from pricetrail.session import forget, stored

# A null in these keeps the stored value; these do not decide whether a row changed.
KEPT = ("source_product_id", "sku", "barcode", "name", "brand", "quantity", "category_id", "product_url")
UNCOMPARED = ("id", "source_hash", "last_updated")
ONLINE_IDENTITY = ("source_product_id", "sku", "barcode")


def replica_upsert(state: DataFrame, aliases: DataFrame, batch: DataFrame, online: bool) -> dict[str, DataFrame]:
    """Merge incoming products into the replica by any of their identifiers.

    state rows have the batch's columns plus ``needs_review``; the batch has one row per id. Gives
    'products' (the new state with its outcome: added, updated, unchanged, conflict or untouched),
    'aliases' (new alias codes), 'reviews' (incoming id and reason) and 'outcomes' (one per incoming row).

    Rows that meet two stored products, or two rows that meet one stored product, are conflicts. Rows that meet none are one new
    product if they share identifiers, directly or over others: the row with the smallest id is added and gives the product its id,
    the others update it in the order of their ids. Online, such a row is a conflict if one of its identifiers differs from the
    group's first. A group that also shares an identifier with a row that updates a stored product would give the identifier two
    owners and is a conflict. Groups are folded by minima and maxima, so their size does not matter, nor does the batch's order.
    """
    types = dict(state.dtypes)
    columns = [c for c in batch.columns if c != "id" and c in state.columns and c != "needs_review"]
    rows = batch
    for key in IDENTITY_KEYS:
        if key not in rows.columns:
            rows = rows.withColumn(key, F.lit(None).cast("string"))
    found = stored(resolve_identity(rows, "id", state, aliases))
    crowded = found.filter("product_id IS NOT NULL").groupBy("product_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = spread_lookup(found.filter("match <> 'new'"), crowded, ["product_id"], "id")
    met = met.withColumn("_bad", (F.col("match") == "conflict") | F.col("_n").isNotNull())
    struct = F.struct(*[F.col(c).cast(types[c]).alias(c) for c in columns]).alias("_b")
    old = state.select(F.col("id").alias("product_id"), F.struct(*state.columns).alias("_s"))
    met = met.select(F.col("id").alias("incoming_id"), "product_id", "_bad", F.lit(False).alias("_later"), struct)
    met = spread_lookup(met, old, ["product_id"], "incoming_id").select("incoming_id", "product_id", "_bad", "_later", "_b", "_s")
    fresh = _folded(found, columns, struct, online).withColumn("_s", F.lit(None).cast(old.schema["_s"].dataType))
    joined = met.unionByName(fresh.select(*met.columns))
    s, b = F.col("_s"), F.col("_b")
    differs, same = F.lit(False), F.lit(True)
    for c in columns:
        if online and c in ONLINE_IDENTITY:
            differs = differs | F.coalesce(b[c] != s[c], F.lit(False))
        if c not in UNCOMPARED:
            equal = b[c].eqNullSafe(s[c])
            same = same & ((equal | b[c].isNull()) if c in KEPT else equal)
    hashed = F.coalesce(b["source_hash"] == s["source_hash"], F.lit(False)) if "source_hash" in columns else F.lit(False)
    reason = F.when(F.col("_bad"), "contradictory identifiers").when(s.isNotNull() & differs, "existing identifiers differ")
    reason = F.when(s.isNull() & F.col("_bad") & F.col("_later"), "existing identifiers differ").otherwise(reason)
    quiet = F.lit(online) & s.isNotNull() & (same | hashed)
    outcome = (
        F.when(reason.isNotNull(), "conflict").when(s.isNull() & F.col("_later"), "updated").when(s.isNull(), "added")
        .when(quiet, "unchanged").otherwise("updated"))
    decided = stored(joined.withColumns({"outcome": outcome, "reason": reason}))

    other_code = F.lit(False)
    if "barcode" in columns:
        other_code = F.coalesce(b["barcode"] != s["barcode"], F.lit(False))
    written = F.col("outcome").isin("added", "updated")
    merged = []
    for c in state.columns:
        value = s[c]
        if c == "id":
            value = F.coalesce("product_id", "incoming_id")
        elif c == "needs_review":
            nameless = b["name"].isNull() if "name" in columns else F.lit(True)
            value = F.coalesce(s[c], F.lit(False)) | (s.isNull() & nameless)
        elif c == "barcode" and c in columns:
            value = F.when(s.isNotNull(), F.when(other_code, s[c]).otherwise(F.coalesce(b[c], s[c]))).otherwise(b[c])
        elif c in columns:
            value = F.coalesce(b[c], s[c]) if c in KEPT else b[c]
        merged.append(F.when(written, value).otherwise(s[c] if c != "id" else value).alias(c))
    ours = decided.filter((written | (F.col("outcome") == "unchanged")) & s.isNotNull()).select(*merged, "outcome")
    ours = ours.unionByName(_new_products(decided.filter(written & s.isNull()), state, columns))
    bad = decided.filter("reason = 'contradictory identifiers'").select(F.col("incoming_id").alias("id"))
    flagged = contested_products(spread_lookup(found, bad, ["id"], "sku", "inner"), "id", state, aliases).withColumn("_flag", F.lit(True))
    mine = ours.select("id", F.struct(*ours.columns).alias("_m"))
    whole = state.select("id", F.struct(*state.columns).alias("_s")).join(mine, "id", "full_outer").join(flagged, "id", "left")
    m, touched = F.col("_m"), F.col("_flag").isNotNull()
    values = {c: F.when(m.isNotNull(), m[c]).otherwise(s[c]) for c in state.columns}
    values["needs_review"] = F.coalesce(values["needs_review"], F.lit(False)) | touched
    outcome = F.when(m.isNotNull(), m["outcome"]).when(touched, "conflict").otherwise("untouched")
    held = aliases.select("barcode", "product_id")
    codes = held.limit(0)
    if "barcode" in columns:
        codes = decided.filter(written & b["barcode"].isNotNull()).select(
            b["barcode"].alias("barcode"), F.coalesce("product_id", "incoming_id").alias("product_id"))
    return {
        "products": whole.select(*[v.alias(c) for c, v in values.items()], outcome.alias("outcome")),
        "aliases": codes.join(held.select("barcode").distinct(), "barcode", "left_anti").distinct(),
        "reviews": decided.filter("reason IS NOT NULL").select("incoming_id", "reason"),
        "outcomes": decided.select("incoming_id", F.coalesce("product_id", "incoming_id").alias("product_id"), "outcome"),
    }


def _folded(found: DataFrame, columns: list[str], struct: Column, online: bool) -> DataFrame:
    """Rows that meet no stored product: incoming_id, product_id (their group's smallest row), _bad, _later (not the first), _b."""
    groups = shared_groups(found.filter("match <> 'conflict'"), "id")
    new = spread_lookup(found.filter("match = 'new'"), groups, ["id"], "id").withColumn("_group", F.coalesce("root", "id"))
    # groups that reach a row with a stored product
    stored = spread_lookup(found.filter("match = 'update'").select("id"), groups, ["id"], "id", "inner").select("root").distinct()
    new = spread_lookup(new, stored.select(F.col("root").alias("_group"), F.lit(True).alias("_claimed")), ["_group"], "id")
    facts = [F.min("id").alias("product_id")]
    own = [c for c in ONLINE_IDENTITY if c in columns]
    for c in own:
        facts.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"_first_{c}"))
    new = spread_lookup(new.drop("product_id"), new.groupBy("_group").agg(*facts), ["_group"], "id")
    differs = F.lit(False)
    for c in own:
        differs = differs | F.coalesce(F.col(c) != F.col(f"_first_{c}"), F.lit(False))
    later = F.col("id") != F.col("product_id")
    bad = F.coalesce("_claimed", F.lit(False)) | (F.lit(online) & later & differs)
    return new.select(F.col("id").alias("incoming_id"), "product_id", bad.alias("_bad"), (later & F.col("_claimed").isNull()).alias("_later"), struct)


def _new_products(fresh: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """One product for each group of new rows: the last value of every column (the last known one where unknown keeps), the first barcode."""
    types, b, order = dict(state.dtypes), F.col("_b"), F.col("incoming_id")
    folded = []
    for c in state.columns:
        if c == "id":
            continue
        if c == "needs_review":
            folded.append(F.min_by(b["name"].isNull() if "name" in columns else F.lit(True), order))
        elif c == "barcode" and c in columns:
            folded.append(F.min_by(b[c], F.when(b[c].isNotNull(), order)))
        elif c in columns:
            folded.append(F.max_by(b[c], F.when(b[c].isNotNull(), order) if c in KEPT else order))
        else:
            folded.append(F.max(F.lit(None).cast(types[c])))
        folded[-1] = folded[-1].alias(c)
    rows = fresh.groupBy(F.col("product_id").alias("id")).agg(*folded)
    return rows.select(*state.columns).withColumn("outcome", F.lit("added"))


def import_products(lines: DataFrame, pending: DataFrame, products: DataFrame, aliases: DataFrame,
                    categories: DataFrame) -> DataFrame:
    """Outcome per line of a general product import (row_number, sku, barcode, name, category_name,
    subcategory_name, error, and any product columns).

    invalid; conflict (the pair contradicts the file, a stored pair or a product); pending (no product
    and no name); duplicate (a known product already has all this, or a repeat of an earlier line);
    updated or added otherwise, with the category resolved by names.
    """
    return _decided(lines, pending, products, aliases, categories).select("row_number", "outcome", "product_id", "category_id", "needs_review")


#: Columns of a decision, and columns that only lead to the category.
DECIDED = ("outcome", "product_id", "category_id", "needs_review")
NAMED = ("category_name", "subcategory_name")


def _decided(lines: DataFrame, pending: DataFrame, products: DataFrame, aliases: DataFrame, categories: DataFrame) -> DataFrame:
    """Lines without the names of their category, with outcome, product_id, category_id and needs_review.

    What is known of each pair is put together step by step, each stored, before the lines meet it; categories are looked up first.
    """
    good = lines.filter("error IS NULL")
    data = [c for c in lines.columns if c not in ("row_number", "error", "category_name", "subcategory_name", "last_updated")]
    compared = [c for c in data if c in products.columns]
    keyed = good.withColumns({"_s": F.coalesce("sku", F.lit("")), "_b": F.coalesce("barcode", F.lit(""))})
    groups = keyed.groupBy("_s", "_b").agg(F.min("row_number").alias("_first"))
    pairs = stored(groups.withColumn("pair", F.monotonically_increasing_id()))
    pairs = pairs.withColumns({"sku": F.when(F.col("_s") != "", F.col("_s")), "barcode": F.when(F.col("_b") != "", F.col("_b"))})
    matches = match_keys(pairs, "pair", products, aliases, ("sku", "barcode"))
    facts = stored(pairs.join(matches, "pair", "left"))
    forget(matches)
    earlier_pairs = pending.filter("status <> 'invalid'").select(F.coalesce("sku", F.lit("")).alias("_s"), F.coalesce("barcode", F.lit("")).alias("_b"))
    earlier_pairs = stored(earlier_pairs.distinct())
    for key, other in (("_s", "_b"), ("_b", "_s")):
        both = (F.col(key) != "") & (F.col(other) != "")
        in_file = pairs.filter(both).groupBy(key).agg((F.min(other) != F.max(other)).alias(f"_many{key}"))
        earlier = earlier_pairs.filter(both).groupBy(key).agg(F.min(other).alias(f"_low{key}"), F.max(other).alias(f"_high{key}"))
        before = facts
        facts = stored(spread_lookup(spread_lookup(facts, in_file, [key], "pair"), earlier, [key], "pair"))
        forget(before)
    steps = facts, earlier_pairs, pairs
    differs = lambda key, other: both_known & ((F.col(f"_low{key}") != F.col(other)) | (F.col(f"_high{key}") != F.col(other)))
    both_known = (F.col("_s") != "") & (F.col("_b") != "")
    facts = facts.withColumn("_prior", F.coalesce(differs("_s", "_b"), F.lit(False)) | F.coalesce(differs("_b", "_s"), F.lit(False)))
    known = earlier_pairs.withColumn("_stored", F.lit(True))
    facts = facts.join(known, ["_s", "_b"], "left")
    target = products.select(F.col("id").alias("product_id"), F.col("sku").alias("_sku"), F.col("barcode").alias("_barcode"),
                             F.struct(*compared).alias("_p"))
    facts = facts.withColumn("product_id", sole(F.col("_low"), F.col("_high"))).join(target, "product_id", "left")
    contradictory = (
        F.coalesce("_many_s", F.lit(False)) | F.coalesce("_many_b", F.lit(False)) | F.col("_prior") | several(F.col("_low"), F.col("_high"))
        | F.coalesce(F.col("_sku") != F.col("sku"), F.lit(False)) | F.coalesce(F.col("_barcode") != F.col("barcode"), F.lit(False)))
    facts = facts.select("_s", "_b", "_first", "product_id", "_p", contradictory.alias("_bad"), F.coalesce("_stored", F.lit(False)).alias("_stored"))
    facts = stored(facts)
    forget(*steps)
    told = F.lit(False)
    for c in NAMED:  # a product holds a category, not its names: a line that tells them is never the same
        told = told | F.col(c).isNotNull() if c in lines.columns else told
    rows = keyed.withColumn("_told", told)
    if set(NAMED) <= set(lines.columns):
        names = F.when(F.col(NAMED[0]).isNotNull(), F.to_json(F.array(*NAMED))).alias("_path")
        named = resolve_category_path(good.select(names, *NAMED).filter("_path IS NOT NULL").distinct(), categories, "_path", *NAMED)
        rows = spread_lookup(rows.withColumn("_path", names), stored(named.drop(*NAMED)), ["_path"], "row_number")
        rows = rows.withColumn("needs_review", F.coalesce("needs_review", F.lit(False))).drop("_path")
    else:
        rows = rows.withColumns({"category_id": F.lit(None).cast("string"), "needs_review": F.lit(False)})
    own = [c for c in lines.columns if c not in (*DECIDED, *NAMED)]
    rows = spread_lookup(rows.drop(*NAMED), facts, ["_s", "_b"], "row_number")
    identical, types = F.lit(True), dict(products.dtypes)
    for c in compared:
        identical = identical & (F.col(c).isNull() | F.col(c).try_cast(types[c]).eqNullSafe(F.col("_p")[c]))
    identical = identical & ~F.col("_told")
    first = F.col("row_number") == F.col("_first")
    single = F.col("product_id").isNotNull()
    outcome = (
        F.when(F.col("_bad"), "conflict")
        .when(~single & F.col("name").isNull(), F.when(first & ~F.col("_stored"), "pending").otherwise("duplicate"))
        .when(single & identical, "duplicate")
        .when(single, "updated")
        .otherwise(F.when(first, "added").otherwise("duplicate")))
    done = rows.withColumn("outcome", outcome).select(*own, *DECIDED)
    bad = lines.filter("error IS NOT NULL").select(
        *own, F.lit("invalid").alias("outcome"), F.lit(None).cast("string").alias("product_id"),
        F.lit(None).cast("string").alias("category_id"), F.lit(False).alias("needs_review"))
    return done.unionByName(bad)


#: Status of a pair after each outcome of its lines.
STATUS = {"invalid": "invalid", "conflict": "needsReview", "pending": "pending", "added": "matched", "updated": "matched"}


def import_catalog(
    lines: DataFrame, pending: DataFrame, products: DataFrame, aliases: DataFrame, categories: DataFrame, file_name: str, at: Column
) -> dict[str, DataFrame]:
    """A whole product import of lines that ``row_number`` identifies. Every line is decided once (``import_products``); what follows
    reads the decisions.

    Gives 'lines' (row_number, outcome, product_id, after the upsert), 'products' and 'aliases' as ``replica_upsert`` leaves
    them, 'identifiers' (sku, barcode, status, product_id: one row per pair of the file, to be stored), 'reviews' (row_number, reason),
    and 'history', one row with the counters and, in ``errors``, how many lines had each reason. Lines that are added or updated go
    through the upsert under ``import:<row_number>``; the first line of a pair speaks for it, and two lines that meet one product are
    conflicts.
    """
    decided = _decided(lines, pending, products, aliases, categories)
    texts = [c for c in lines.columns if c not in (*NAMED, "last_updated", "category_id", "needs_review")]
    if stored(lines.filter("row_number IS NOT NULL").groupBy("row_number").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1)).isEmpty():
        own = [F.when(F.col("row_number").isNotNull(), F.col(c)).alias(c) for c in texts if c != "row_number"]
        decided = decided.select("row_number", "outcome", "product_id", "category_id", "needs_review", *own)
    else:  # lines that a number doesn't tell apart meet all texts of their number
        decided = decided.select("row_number", "outcome", "product_id", "category_id", "needs_review")
        decided = spread_lookup(decided, lines.select(*texts), ["row_number"], "outcome")
    decided = stored(decided)
    incoming = F.concat(F.lit("import:"), F.col("row_number").cast("string"))
    written = decided.filter(F.col("outcome").isin("added", "updated"))
    batch = written.drop("outcome", "product_id", "needs_review", "error").withColumn("id", incoming).drop("row_number")
    done = replica_upsert(products, aliases, batch, online=False)
    known = done["outcomes"].select(F.col("incoming_id").alias("_in"), F.col("product_id").alias("_product"), F.col("outcome").alias("_done"))
    rows = written.withColumn("_in", incoming).join(known, "_in", "left").drop("_in")
    rows = rows.withColumns({
        "outcome": F.coalesce("_done", "outcome"),
        "product_id": F.when(F.col("_done") == "conflict", F.lit(None)).otherwise(F.coalesce("_product", "product_id"))})
    rows = rows.drop("_done", "_product").unionByName(decided.filter(~F.col("outcome").isin("added", "updated")))
    reason = F.when(F.col("outcome") == "invalid", F.col("error")).when(F.col("outcome") == "conflict", F.lit("contradictory identifiers"))
    counted = lambda *names: F.count_if(F.col("outcome").isin(*names)).alias
    pended = (F.col("outcome") == "pending") | ((F.col("outcome") == "duplicate") & F.col("product_id").isNull())
    counters = rows.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("outcome") != "invalid").alias("rows_valid"), counted("added", "pending")("rows_added"),
        counted("updated")("rows_updated"), counted("invalid", "conflict")("rows_failed"),
        F.count_if((F.col("outcome") != "conflict") & F.col("product_id").isNotNull()).alias("rows_matched"), F.count_if(pended).alias("rows_pending"),
        counted("duplicate")("rows_duplicate"), counted("conflict")("rows_conflict"))
    faults = rows.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    faults = faults.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("errors"))  # a row per reason
    status = F.lit("matched")
    for outcome, after in STATUS.items():
        status = F.when(F.col("outcome") == outcome, after).otherwise(status)
    status = F.when((F.col("outcome") == "duplicate") & F.col("product_id").isNull(), "pending").otherwise(status)
    worst = F.when(status == "needsReview", 0).when(status == "matched", 1).otherwise(2)
    pairs = rows.filter("outcome <> 'invalid'").groupBy("sku", "barcode").agg(
        F.min_by(F.struct(status.alias("status"), "product_id"), F.struct(worst, "row_number")).alias("_of"))
    return {
        "lines": rows.select("row_number", "outcome", "product_id"),
        "products": done["products"], "aliases": done["aliases"],
        "identifiers": pairs.select("sku", "barcode", "_of.status", "_of.product_id"),
        "reviews": rows.select("row_number", reason.alias("reason")).filter("reason IS NOT NULL"),
        "history": counters.crossJoin(faults).withColumns({"file_name": F.lit(file_name), "imported_at": at}),  # one row each
    }
