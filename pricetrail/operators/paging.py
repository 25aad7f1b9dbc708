"""Pages by offset, at any depth, without a full sort and without one task that holds what lies before the page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

#: Rows a page may skip in one task; what lies deeper is found by counts.
GATHERED = 100_000
#: Ranges that one round tells apart, and sampled keys for each of them.
RANGES, SAMPLED = 64, 50
#: Rounds before the plain way is taken; each one divides the rows to skip by about RANGES.
ROUNDS = 12


def _literal(bound: Row, schema: StructType) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(bound, schema.fields)])


def _place(key: Column, bounds: list[Column], first: int = 0) -> Column:
    """How many of the ascending bounds are not above the key, by halving."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    above = _place(key, bounds[half + 1 :], first + half + 1)
    return F.when(key >= bounds[half], above).otherwise(_place(key, bounds[:half], first))


def _tie(df: DataFrame) -> Column:
    """Tells rows apart that the order does not: only rows alike in every column stay tied."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))])


def _bounds(inside: DataFrame, total: int) -> list[Row]:
    """About RANGES distinct ascending keys, evenly spaced in a sample of a size that does not grow with the rows."""
    fraction = min(1.0, RANGES * SAMPLED / total)
    keys = [r["_key"] for r in inside.select("_key").sample(fraction).orderBy("_key").collect()]
    chosen: list[Row] = []
    for k in range(1, RANGES):
        if keys and (not chosen or chosen[-1] != keys[k * len(keys) // RANGES]):
            chosen.append(keys[k * len(keys) // RANGES])
    return chosen


def offset_page(df: DataFrame, order: list[Column], offset: int, limit: int, gathered: int = GATHERED) -> DataFrame:
    """Rows offset+1 .. offset+limit in ascending order (nulls first).

    Up to ``gathered`` rows are found by a top-k. A deeper page is an order statistic: sampled keys bound ranges, one count per range
    (combined before the shuffle) tells in which the page begins and ends, and only rows between these bounds are looked at again, until the
    rows to skip are few. A round scans the columns of the order and moves a count per range and task; the bounds of the first column reach
    the file scan. Sampling decides the bounds and never the result. Rows that tie in the order follow by a hash of all columns, so pages
    neither repeat nor lose rows; of rows alike in every column any are taken. ``df`` must give the same rows whenever it is read: a table, or a checkpointed frame.
    An offset beyond the end gives no rows.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit may not be negative")
    parts = [c.alias(f"k{i}") for i, c in enumerate([*order, _tie(df)])]
    keyed = df.withColumn("_key", F.struct(*parts))
    key, schema = F.col("_key"), keyed.schema["_key"].dataType
    literal = lambda bound: _literal(bound, schema)
    conditions: list[Column] = []
    skip, total, rounds = offset, None, 0

    def within(limits: list[Column]) -> DataFrame:
        return reduce(DataFrame.filter, limits, keyed)

    def plain(limits: list[Column]) -> DataFrame:
        return within(limits).orderBy("_key").offset(skip).limit(limit).drop("_key")

    def from_(bound: Row, strict: bool) -> list[Column]:
        pushed = [] if bound[0] is None else [order[0] >= literal(bound)["k0"]]
        return [*pushed, key > literal(bound) if strict else key >= literal(bound)]

    def up_to(bound: Row, strict: bool) -> list[Column]:
        pushed = [order[0].isNull()] if bound[0] is None else [order[0].isNull() | (order[0] <= literal(bound)["k0"])]
        return [*pushed, key < literal(bound) if strict else key <= literal(bound)]

    while skip + limit > gathered and skip > 0 and rounds < ROUNDS:
        rounds += 1
        inside = within(conditions)
        total = inside.count() if total is None else total
        if skip >= total:
            return df.limit(0)
        bounds = _bounds(inside, total)
        if not bounds:
            continue
        literals = [literal(b) for b in bounds]
        counted = inside.select(key, _place(key, literals).alias("place"))
        # a bound's own rows are a range of their own: a key of very many rows is told apart from its neighbours
        beyond = F.coalesce(key != F.get(F.array(*literals), F.col("place") - 1), F.lit(True))
        cells = {(r["place"], r["beyond"]): r["n"] for r in
                 counted.groupBy("place", beyond.alias("beyond")).agg(F.count(F.lit(1)).alias("n")).collect()}
        before, begin, last = 0, None, None
        for cell in sorted(cells):
            if begin is None and before + cells[cell] > skip:
                begin, skip = cell, skip - before
                before = 0
            before += cells[cell]
            if begin is not None and before >= skip + limit:
                last = cell
                break
        if begin is None:
            return df.limit(0)
        narrowed = list(conditions) if begin[0] == 0 else [*conditions, *from_(bounds[begin[0] - 1], begin[1])]
        if last is not None and not last[1]:
            narrowed += up_to(bounds[last[0] - 1], False)
        elif last is not None and last[0] < len(bounds):
            narrowed += up_to(bounds[last[0]], True)
        if not begin[1]:
            # the page begins among rows alike in every column: any of them will do
            bound = bounds[begin[0] - 1]
            alike = within([*from_(bound, False), *up_to(bound, False)]).limit(min(limit, cells[begin] - skip))
            after = limit - min(limit, cells[begin] - skip)
            if after == 0:
                return alike.drop("_key")
            rest = within([*narrowed, *from_(bound, True)]).orderBy("_key").limit(after)
            return alike.unionByName(rest).orderBy("_key").drop("_key")
        conditions, total = narrowed, before
    return plain(conditions)
