"""The catalog writer: state tables and change log of one folder, moved forward together by one manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricetrail.operators.changes import delta, number_rows, snapshot
from pricetrail.operators.upsert import refuse_shared, upsert
from pricetrail.schemas import CHANGES, TABLES
from pricetrail.session import cut_lineage
from pricetrail.sources.manifest import Manifest, Part, Store

#: The state table of each kind of change.
STATE = {"product": "products", "category": "categories", "promotion": "promotions", "collection": "special_collections"}


class Catalog:
    """Tables of schemas.TABLES and the log behind them.

    There is one writer at a time; if there are two, one of them fails with Taken and has changed nothing. A writer that dies leaves
    folders that no manifest names, and its work can be done again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def manifest(self, number: int | None = None) -> Manifest:
        return self.store.read(number)

    def table(self, name: str, at: Manifest | None = None) -> DataFrame:
        """A state table as the manifest names it; without rows if it has never been written."""
        at = at or self.manifest()
        return self.store.rows([at.tables[name]] if name in at.tables else [], TABLES[name])

    def changes(self, since: int = 0, until: int | None = None, at: Manifest | None = None) -> DataFrame:
        """Changes in (since, until]. The zone map chooses the folders, so no other one is listed and no footer of it opened."""
        at = at or self.manifest()
        until = at.head if until is None else min(until, at.head)
        rows = self.store.rows([p.folder for p in at.between(since, until)], CHANGES)
        return delta(rows.select(*StructType.fromDDL(CHANGES).fieldNames()), since, max(since, until))

    def image(self, until: int | None = None) -> DataFrame:
        """Newest image of every entity at a version."""
        return snapshot(self.changes(0, until))

    def write(self, kind: str, batch: DataFrame, at: Column, key: str = "id", **rules) -> DataFrame:
        """Merge a batch (one row per key) into the state table of its kind, and give the outcome of every row of either.

        Products that claim an identifier of another product, stored or in the batch, are conflicts (``refuse_shared``). What is
        added or updated gets the next versions, ``updated_at`` (and, when new, ``created_at``) from ``at``, and one event that
        carries the whole row. State and events become visible together. A batch that changes nothing publishes nothing.
        """
        name, current = STATE[kind], self.manifest()
        state = self.table(name, current)
        columns = state.columns
        if kind == "product":
            batch = refuse_shared(state, batch, key)
        else:
            rules = {"keep": (), "identity": (), "new_row": {}} | rules
        result = cut_lineage(upsert(state, batch, key, **rules))
        changed = result.filter(F.col("outcome").isin("added", "updated"))
        stamped = number_rows(changed, [key], "version", current.head)
        if "updated_at" in columns:
            stamped = stamped.withColumns({"updated_at": at, "created_at": F.coalesce("created_at", at)})
        payload = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        events = stamped.select("version", F.lit(kind).alias("kind"), F.col(key).alias("entity_id"), payload.alias("payload"))
        part = self._part(events, current.head)
        if part is not None:
            # a conflict without a version is a new row that was refused: it isn't stored
            stored = F.col("version").isNotNull() & ~F.col("outcome").isin("added", "updated")
            whole = stamped.select(*columns).unionByName(result.filter(stored).select(*columns))
            folder = self.store.write(whole, name)
            self._publish(current, part, {name: folder})
        return result.select(key, "outcome")

    def append(self, events: DataFrame, tables: dict[str, DataFrame] | None = None) -> Manifest:
        """Number events (kind, entity_id, payload), at most one per entity, append them, and replace whole tables at the same time."""
        current = self.manifest()
        numbered = number_rows(events.select("kind", "entity_id", "payload"), ["kind", "entity_id"], "version", current.head)
        part = self._part(numbered.select("version", "kind", "entity_id", "payload"), current.head)
        folders = {name: self.store.write(rows, name) for name, rows in (tables or {}).items()}
        return self._publish(current, part, folders) if part or folders else current

    def compact(self, until: int | None = None) -> Manifest:
        """Put all whole parts up to a version into one. Versions, rows and results stay; later parts may arrive meanwhile."""
        start = self.manifest()
        old = [p for p in start.parts if until is None or p.last <= until]
        if len(old) < 2:
            return start
        rows = self.store.rows([p.folder for p in old], CHANGES).repartitionByRange("version").sortWithinPartitions("version")
        whole = Part(self.store.write(rows, "log"), old[0].first, old[-1].last, sum(p.rows for p in old))

        def swap(current: Manifest) -> dict | None:
            return {"parts": (whole, *current.parts[len(old):])} if current.parts[: len(old)] == tuple(old) else None

        return self.store.update(swap)

    def _part(self, events: DataFrame, head: int) -> Part | None:
        folder = self.store.write(events, "log")
        count = self.store.rows([folder], CHANGES).count()
        return Part(folder, head + 1, head + count, count) if count else None

    def _publish(self, current: Manifest, part: Part | None, folders: dict[str, str]) -> Manifest:
        head = part.last if part else current.head
        return self.store.publish(
            current, generation=current.generation or uuid.uuid4().hex, head=head, tables=current.tables | folders,
            parts=(*current.parts, *([part] if part else [])))
