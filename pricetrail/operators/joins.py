"""Equi joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_lookup(rows: DataFrame, table: DataFrame, on: list[str], spread: str, how: str = "left") -> DataFrame:
    """Join rows, whatever their key distribution, with a table that has one row per key.

    A row meets at most one table row, so no pairs are listed and only the row side can be skewed.
    Adaptive execution splits an oversized partition of that side by size (see session.SETTINGS), and
    broadcasts the table when its measured size allows. It can only do so when both sides are shuffled
    for the join itself; a table that was just aggregated by the key would not be. The extra join key, a
    few bits of a hash of the others, makes sure of it at the price of one more shuffle of the narrow table.

    ``spread`` names a column that varies inside a key; adaptive execution needs no such column, so it is not read.
    """
    types = dict(rows.dtypes)
    table = table.select([F.col(c).cast(types[c]).alias(c) if c in on else F.col(c) for c in table.columns])
    apart = F.pmod(F.xxhash64(*[F.col(k) for k in on]), F.lit(16))  # a whole hash would be half of a narrow row
    return rows.withColumn("_apart", apart).join(table.withColumn("_apart", apart), [*on, "_apart"], how).drop("_apart")


def sole(lowest: Column, highest: Column) -> Column:
    """The one value of a group known by its minimum and maximum; null when there are several."""
    return F.when(lowest == highest, lowest)


def several(lowest: Column, highest: Column) -> Column:
    return F.coalesce(lowest != highest, F.lit(False))
