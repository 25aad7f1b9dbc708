"""The change log: snapshot, delta, gapless versions and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetrail.session import cut_lineage

KINDS = ("category", "product", "promotion", "collection", "identifier")
ENTITY = ("kind", "entity_id")


def snapshot(changes: DataFrame, until: int | None = None, keys=ENTITY, version: str = "version") -> DataFrame:
    """Newest image of every entity at a version.

    max_by keeps one row per entity and task before the shuffle, so an entity that owns a large
    share of the log sends no more rows than any other.
    """
    rows = changes if until is None else changes.filter(F.col(version) <= until)
    rest = [c for c in changes.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_newest"))
    return newest.select(*keys, *[F.col("_newest")[c].alias(c) for c in rest])


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a total order, without bringing the rows together.

    Rows are range-partitioned and sorted once and checkpointed; only one count per partition goes
    through the driver. ``order`` must identify a row, so that a retry numbers rows the same way.
    """
    fixed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()
    part, index = F.shiftright(place, 33), place.bitwiseAND((1 << 33) - 1)
    counts = fixed.select(part.alias("part")).groupBy("part").count().orderBy("part").collect()
    if not counts:
        return fixed.withColumn(name, F.lit(None).cast("long"))
    before_part, total, size = [], start, {row["part"]: row["count"] for row in counts}
    for k in range(counts[-1]["part"] + 1):
        before_part.append(total)
        total += size.get(k, 0)
    # a constant array, indexed by partition: one step a row however many partitions there are
    before = F.get(F.split(F.lit(",".join(map(str, before_part))), ",").cast("array<bigint>"), part.cast("int"))
    return fixed.withColumn(name, (before + index + 1).cast("long"))


def assign_versions(df: DataFrame, base_version: int, order: list[str]) -> DataFrame:
    """Give a batch of changes the versions base+1, base+2, ... with no gap."""
    return number_rows(df, order, "version", base_version)


def delta(changes: DataFrame, since: int, until: int) -> DataFrame:
    """Changes in (since, until]; both bounds reach the file scan."""
    if since > until:
        raise ValueError("since lies after until")
    return changes.filter((F.col("version") > since) & (F.col("version") <= until))


def snapshot_key(kind: Column, level: Column, entity_id: Column) -> Column:
    """rank:depth:id, the order in which a replica can be filled without dangling references."""
    rank = F.lit(str(len(KINDS) - 1))
    for i, name in reversed(list(enumerate(KINDS[:-1]))):
        rank = F.when(kind == name, str(i)).otherwise(rank)
    # five digits as replicas expect; deeper levels keep all their digits and sort after
    deep = F.concat(F.lit("~"), F.lpad(level, 19, "0"))
    padded = F.when(F.length(level) > 5, deep).otherwise(F.lpad(level, 5, "0"))
    depth = F.when(kind == "category", padded).otherwise("00000")
    return F.concat_ws(":", rank, F.coalesce(depth, F.lit("")), entity_id)


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next ``limit`` rows after a key; next_cursor is null on the last page.

    One row more than the page is taken (a top-k, not a sort), so the window below sees at most
    limit + 1 rows.
    """
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    taken = rows.orderBy(key).limit(limit + 1)
    everything = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(key))
    last = F.max(F.when(F.col("_place") <= limit, F.col(key))).over(everything)
    more = F.count(F.lit(1)).over(everything) > limit
    paged = taken.withColumn("_place", place).withColumn("next_cursor", F.when(more, last))
    return paged.filter(F.col("_place") <= limit).drop("_place")


def with_snapshot_key(images: DataFrame) -> DataFrame:
    level = F.get_json_object("payload", "$.level")
    return images.withColumn("key", snapshot_key(F.col("kind"), level, F.col("entity_id")))


def snapshot_page(changes: DataFrame, until: int, after: str, limit: int) -> DataFrame:
    """One page of the snapshot frozen at ``until``."""
    return keyset_page(with_snapshot_key(snapshot(changes, until)), "key", after, limit)


def snapshot_pages(changes: DataFrame, until: int, limit: int) -> DataFrame:
    """Every page of the snapshot in one job: rows carry their page number."""
    rows = number_rows(with_snapshot_key(snapshot(changes, until)), ["key"], "place")
    return rows.withColumn("page", F.expr(f"(place - 1) div {int(limit)} + 1"))


def delta_page(changes: DataFrame, since: int, until: int, after: int | None, limit: int) -> DataFrame:
    """One page of the changes in (since, until]."""
    return keyset_page(delta(changes, since, until), "version", after if after is not None else since, limit)


def _chained(pages: DataFrame) -> Column:
    """Whether pages chain by cursor: one start, one end that is marked as last, every next cursor larger and met exactly once.

    Cursors are compared through sums of their hashes, so pages are never brought together.
    """
    code = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.xxhash64(c).cast("decimal(38,0)")))
    facts = pages.agg(
        (F.count_if(F.col("cursor").isNull()) == 1).alias("start"),
        (F.count_if(F.col("next_cursor").isNull() & F.col("last")) == 1).alias("end"),
        F.coalesce(F.bool_and(F.col("last") == F.col("next_cursor").isNull()), F.lit(False)).alias("marked"),
        F.coalesce(F.bool_and(F.col("cursor").isNull() | F.col("next_cursor").isNull() | (F.col("next_cursor") > F.col("cursor"))), F.lit(False)).alias("onward"),
        (F.count_distinct("cursor") == F.count("cursor")).alias("once"),
        F.coalesce(code("cursor"), F.lit(0)).eqNullSafe(F.coalesce(code("next_cursor"), F.lit(0))).alias("met"))
    return F.lit(all(facts.first()))


def advance(state: DataFrame, pages: DataFrame, bootstrap: bool = False) -> DataFrame:
    """Next watermark row: it moves only when all pages agree and the last one has arrived.

    state is the one stored row (generation, version); pages are (server_version, generation, last) and, where the pages tell them,
    cursor and next_cursor: then the pages must chain from the one without cursor to the last one, each cursor following its
    predecessor and met once. A missing or repeated page leaves the watermark where it is.
    decision is 'advance', 'incomplete', 'inconsistent' or 'bootstrap_required' (generation changed).
    """
    stored = state.select(F.col("generation").alias("old_generation"), F.col("version").alias("old_version"))
    chained = _chained(pages) if "cursor" in pages.columns else F.lit(True)
    facts = pages.select("server_version", "generation", "last").unionByName(stored, allowMissingColumns=True)
    low, high = F.min("server_version"), F.max("server_version")
    same = (low == high) & (F.min("generation") == F.max("generation"))
    facts = facts.agg(
        high.alias("version"),
        F.max("generation").alias("generation"),
        same.alias("consistent"),
        (F.coalesce(F.bool_or("last"), F.lit(False)) & chained).alias("finished"),
        F.max("old_generation").alias("old_generation"),
        F.max("old_version").alias("old_version"),
    )
    changed = F.lit(not bootstrap) & (F.col("old_generation") != F.col("generation"))
    backwards = F.lit(not bootstrap) & (F.col("old_version") > F.col("version"))
    decision = (
        F.when(F.col("version").isNull(), "incomplete")
        .when(~F.col("consistent"), "inconsistent")
        .when(changed, "bootstrap_required")
        .when(backwards, "inconsistent")
        .when(~F.col("finished"), "incomplete")
        .otherwise("advance")
    )
    moved = decision == "advance"
    return facts.select(
        decision.alias("decision"),
        F.when(moved, F.col("generation")).otherwise(F.col("old_generation")).alias("generation"),
        F.when(moved, F.col("version")).otherwise(F.col("old_version")).alias("version"),
    )
