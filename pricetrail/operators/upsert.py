"""State plus batch: merged state, outcome per row, and the events to publish."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.text import is_blank
from pricetrail.operators.changes import KINDS, snapshot
from pricetrail.operators.joins import spread_lookup

# What an unknown incoming value may not erase, what identifies a product, what a new row starts with.
KEEP_IF_NULL = ("source_product_id", "sku", "barcode", "category_id", "brand")
IDENTITY = ("source_product_id", "sku", "barcode")
UNIQUE = (*IDENTITY, "product_url")
NEW_PRODUCT = {"promotion_state": "none", "possibly_inactive": False, "inactive": False, "missing_count": 0}
MANAGED = ("version", "created_at", "updated_at")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def upsert(
    state: DataFrame,
    batch: DataFrame,
    key: str = "id",
    keep: tuple[str, ...] = KEEP_IF_NULL,
    identity: tuple[str, ...] = IDENTITY,
    new_row: dict | None = None,
) -> DataFrame:
    """Merge a batch (one row per key) into the state by a full outer join on the key.

    outcome is added, updated, unchanged, conflict (a stored identifier differs, or the batch's optional ``refused
    boolean`` is set; the state is kept, and a refused new row has no version) or untouched. A column missing from the batch, or not named in the batch's optional
    ``supplied array<string>``, is left alone; a supplied null overwrites unless it is in ``keep``.
    """
    types = dict(state.dtypes)
    columns = [c for c in state.columns if c != key and c not in MANAGED]
    patched = [c for c in columns if c in batch.columns]
    partial = "supplied" in batch.columns
    marks = [c for c in ("supplied", "refused") if c in batch.columns]
    old = state.select(F.col(key).alias("_old_key"), F.struct(*state.columns).alias("_s"))
    new = batch.select(
        F.col(key).alias("_new_key"),
        F.struct(*[F.col(c).cast(types[c]).alias(c) for c in patched], *marks).alias("_b"),
    )
    rows = old.join(new, F.col("_old_key") == F.col("_new_key"), "full_outer")
    s, b = F.col("_s"), F.col("_b")
    is_new, quiet = F.col("_old_key").isNull(), F.col("_new_key").isNull()

    def given(c: str) -> Column:
        return F.array_contains(b["supplied"], c) if partial else F.lit(True)

    def writes(c: str) -> Column:
        return given(c) & (b[c].isNotNull() | is_new) if c in keep else given(c)

    clashes = []
    for c in identity:
        if c in patched:
            clash = given(c) & F.coalesce(b[c] != s[c], F.lit(False))
            clashes.append(clash & ~is_blank(s[c]) if c == "sku" else clash)
    conflict = ~is_new & _any(clashes)
    if "refused" in marks:
        conflict = conflict | F.coalesce(b["refused"], F.lit(False))
    same = _all([~writes(c) | b[c].eqNullSafe(s[c]) for c in patched])
    outcome = (
        F.when(quiet, "untouched").when(conflict, "conflict").when(is_new, "added").when(same, "unchanged").otherwise("updated")
    )
    defaults = NEW_PRODUCT if new_row is None else new_row
    merged = []
    for c in columns:
        stored = F.when(is_new, F.lit(defaults.get(c)).cast(types[c])).otherwise(s[c])
        value = F.when(~quiet & ~conflict & writes(c), b[c]).otherwise(stored) if c in patched else stored
        if c in patched and c in defaults:
            value = F.when(is_new, F.coalesce(value, F.lit(defaults[c]).cast(types[c]))).otherwise(value)
        merged.append(value.alias(c))
    kept = [s[c].alias(c) for c in state.columns if c in MANAGED]
    return rows.select(F.coalesce("_old_key", "_new_key").alias(key), outcome.alias("outcome"), *merged, *kept)


def refuse_shared(state: DataFrame, batch: DataFrame, key: str = "id", identity: tuple[str, ...] = UNIQUE) -> DataFrame:
    """The batch with ``refused``: whether a row claims an identifier that isn't its own to claim.

    A stored value belongs to the row that holds it; one that is stored nowhere and claimed by several rows of the batch belongs to
    none of them. Blank values and, with ``supplied``, columns that a row doesn't name claim nothing. Every value is reduced to its
    lowest and highest claimant, so rows that share one never meet.
    """
    kinds = tuple(c for c in identity if c in batch.columns)
    if "supplied" in batch.columns:
        batch = batch.withColumns({f"_{c}": F.when(F.array_contains("supplied", c), F.col(c)) for c in kinds})
    else:
        batch = batch.withColumns({f"_{c}": F.col(c) for c in kinds})

    def claims(rows: DataFrame, prefix: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(prefix + c).cast("string").alias("value")) for c in kinds])
        rows = rows.select(F.col(key).alias("row"), F.explode(pairs).alias("pair")).select("row", "pair.kind", "pair.value")
        return rows.filter(F.col("value").isNotNull() & ~is_blank(F.col("value")))

    if not kinds:
        return batch.withColumn("refused", F.lit(False))
    asked = claims(batch, "_")
    known = asked.withColumn("stored", F.lit(False)).unionByName(claims(state, "").withColumn("stored", F.lit(True)))
    owner = F.when(F.col("stored"), F.col("row"))
    found = known.groupBy("kind", "value").agg(
        F.min("row").alias("low"), F.max("row").alias("high"), F.min(owner).alias("owner"), F.max(owner).alias("last"))
    found = found.filter("low <> high")
    met = spread_lookup(asked, found, ["kind", "value"], "row", "inner")
    foreign = F.col("owner").isNull() | (F.col("owner") != F.col("row")) | (F.col("last") != F.col("row"))
    refused = met.filter(foreign).select(F.col("row").alias(key)).distinct().withColumn("refused", F.lit(True))
    rows = batch.drop(*[f"_{c}" for c in kinds]).join(refused, key, "left")
    return rows.withColumn("refused", F.coalesce("refused", F.lit(False)))


def upsert_events(result: DataFrame, kind: str, key: str = "id") -> DataFrame:
    """One event per effective change; number them with assign_versions and append with publish."""
    fields = [c for c in result.columns if c not in ("outcome", "version")]
    changed = result.filter(F.col("outcome").isin("added", "updated"))
    return changed.select(F.lit(kind).alias("kind"), F.col(key).alias("entity_id"), F.struct(*fields).alias("payload"))


def put_documents(state: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (id, data) are written only where they differ; data may be text or a struct."""
    old = state.select("id", F.col("data").alias("_old"), F.lit(True).alias("_stored"))
    new = documents.select("id", F.col("data").alias("_new"), F.lit(True).alias("_given"))
    rows = old.join(new, "id", "full_outer")
    outcome = (
        F.when(F.col("_given").isNull(), "untouched")
        .when(F.col("_stored").isNull(), "added")
        .when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged")
        .otherwise("updated")
    )
    data = F.when(F.col("_given").isNull(), F.col("_old")).otherwise(F.col("_new"))
    return rows.select("id", outcome.alias("outcome"), data.alias("data"))


def drop_replayed(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Events newer than the stored image of their entity; replays and late ones fall out."""
    stored = state.select("kind", "entity_id", F.col("version").alias("_stored"))
    rows = spread_lookup(batch, stored, ["kind", "entity_id"], "version")
    return rows.filter(F.col("_stored").isNull() | (F.col("version") > F.col("_stored"))).drop("_stored")


def apply_delta(replica: DataFrame, changes: DataFrame) -> DataFrame:
    """Replica images (kind, entity_id, version, payload) after a slice of the log.

    The newest event of each entity wins; replays change nothing; an unknown kind is reported and
    not applied.
    """
    newest = snapshot(changes.select("kind", "entity_id", "version", "payload"))
    old = replica.select("kind", "entity_id", F.struct("version", "payload").alias("_s"))
    new = newest.select("kind", "entity_id", F.struct("version", "payload").alias("_b"))
    rows = old.join(new, ["kind", "entity_id"], "full_outer")
    s, b = F.col("_s"), F.col("_b")
    outcome = (
        F.when(b.isNull(), "untouched")
        .when(~F.col("kind").isin(*KINDS), "unknown_kind")
        .when(s.isNull(), "added")
        .when(b["version"] <= s["version"], "replayed")
        .otherwise("updated")
    )
    image = F.when(outcome.isin("added", "updated"), b).otherwise(s)
    return rows.select("kind", "entity_id", outcome.alias("outcome"), image["version"].alias("version"),
                       image["payload"].alias("payload"))


def replace_memberships(bridge: DataFrame, documents: DataFrame, owner: str, members: str = "product_ids") -> DataFrame:
    """Bridge rows after documents (owner, members array) replaced their whole membership."""
    untouched = spread_lookup(bridge, documents.select(owner), [owner], "product_id", "left_anti").select(owner, "product_id")
    fresh = documents.select(owner, F.explode(members).alias("product_id"))
    return untouched.unionByName(fresh).distinct()


def apply_snapshot(replica: DataFrame, image: DataFrame) -> DataFrame:
    """Replica products after a full snapshot: server rows it lacks become inactive, local rows stay."""
    result = upsert(replica, image, new_row={})
    listed = image.select("id", F.lit(True).alias("_listed"))
    rows = result.join(listed, "id", "left")
    gone = F.col("_listed").isNull() & (F.coalesce("version", F.lit(0)) > 0)
    return rows.withColumns(
        {
            "outcome": F.when(gone, "inactive").otherwise(F.col("outcome")),
            "inactive": F.when(gone, True).otherwise(F.col("inactive")),
            "possibly_inactive": F.when(gone, True).otherwise(F.col("possibly_inactive")),
        }
    ).drop("_listed")


def sync_report(outcomes: DataFrame) -> DataFrame:
    """How many rows had each outcome."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))
