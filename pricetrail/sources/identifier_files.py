"""Delimited identifier files: reading, header meaning and row typing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetrail.functions.binding import let
from pricetrail.functions.text import identifier_fault, is_blank, strip, without_point
from pricetrail.operators.products import fold_literal
from pricetrail.session import cut_lineage

# Folded header texts and the field each one means.
HEADER_ALIASES = {
    "sku": "sku",
    "cod sku": "sku",
    "cod produs": "sku",
    "product code": "sku",
    "productcode": "sku",
    "cod articol": "sku",
    "barcode": "barcode",
    "cod de bare": "barcode",
    "cod bare": "barcode",
    "bar code": "barcode",
    "ean13": "barcode",
    "ean-13": "barcode",
    "upc": "barcode",
    "ean": "barcode",
    "denumire": "name",
    "denumire produs": "name",
    "produs": "name",
    "name": "name",
    "product": "name",
    "product name": "name",
    "brand": "brand",
    "marca": "brand",
    "cantitate": "quantity",
    "gramaj": "quantity",
    "pret": "price",
    "price": "price",
    "pret vechi": "old_price",
    "promotie": "promo_price",
    "pret promotional": "promo_price",
    "reducere": "discount_percent",
    "reducere %": "discount_percent",
    "categorie": "category_name",
    "subcategorie": "subcategory_name",
    "data actualizarii": "last_updated",
}
SEPARATORS = (";", ",", "\t")
IDENTIFIERS = ("sku", "barcode")
AMOUNTS = ("price", "old_price", "promo_price", "discount_percent")
UNSAFE, FORMULA = "#UNSAFE_NUMBER:", "#FORMULA"


def _layout(line: str) -> tuple[str, list[str]]:
    """Separator and column names of a header line; a repeated name gets its place."""
    line = line.lstrip("\ufeff")
    separator = max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))
    names = [n.strip().strip('"') for n in line.split(separator)]
    return separator, [f"{n}#{i}" if names.count(n) > 1 else n for i, n in enumerate(names)]


def read_identifier_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as text columns named by their header, with source_file and row_number.

    Every file is read by its own header. Its separator is the one that splits the header into most columns; a byte-order mark and any
    kind of line ending are accepted; blank rows are counted and dropped. Files of several layouts come together under the fields
    their headers mean. Rows are numbered by record. A quoted cell may go on over lines: such lines are found and put together
    wherever they lie (``_records``), so a file is read in parallel whether it has any or not. A quote that is never closed ends
    with its line. One row per different header comes to the driver. Lines are numbered where they are read: of every piece of a
    file that a task reads, one row tells how many lines lie before it, and these rows are broadcast.
    """
    lines = cut_lineage(spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")))
    spots = _spots(lines)
    headers = [r["_header"] for r in spots.select("_header").distinct().orderBy("_header").collect()]
    if not headers:
        raise ValueError("the file has no rows")
    placed = lines.join(F.broadcast(spots), ["_file", "_block"]).withColumn("_place", F.col("_before") + F.col("_at") - F.col("_from") + 1)
    single = placed.filter("NOT _odd").withColumn("row_number", F.col("_place") - F.col("_first") + 1)
    columns = ["value", "source_file", "row_number", "_header"]
    rows = single.select(*columns)
    if not spots.filter("_odd").isEmpty():
        rows = rows.unionByName(_records(placed.filter("_odd")).select(*columns))
    rows = rows.filter("row_number > 1")
    parts = [_from_lines(rows.filter(F.col("_header") == h), *_layout(h)) for h in headers]
    if len(parts) > 1:
        parts = [map_headers(p) for p in parts]
    data = parts[0]
    for part in parts[1:]:
        data = data.unionByName(part, allowMissingColumns=True)
    if data.isEmpty():
        raise ValueError("the file has no rows after its header")
    return data


def _spots(lines: DataFrame) -> DataFrame:
    """One row per piece of a file (_file, _block): lines before it in all files (_before), its first line's _at (_from), its file's
    first and last place, whether the file has a line with an odd count of quotes (_odd), _header and _sep.

    A piece is what one task reads, so the rows are as many as the tasks that read the files.
    """
    odd = _count(F.col("value"), '"') % 2 == 1
    pieces = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"), F.max(odd).alias("_some"))
    in_order = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    file = Window.partitionBy("_file")
    pieces = cut_lineage(pieces.withColumn("_upto", F.sum("_n").over(in_order)).withColumns({
        "_before": F.col("_upto") - F.col("_n"), "_first": F.min(F.col("_upto") - F.col("_n")).over(file) + 1,
        "_last": F.max("_upto").over(file), "_odd": F.max("_some").over(file)}))
    begins = pieces.filter("_before + 1 = _first").select("_file", F.col("_from").alias("_at"))
    heads = lines.join(F.broadcast(begins), ["_file", "_at"]).select("_file", F.col("value").alias("_header"))
    spots = pieces.join(heads, "_file").withColumn("_sep", _separator(F.col("_header")))
    return cut_lineage(spots.drop("_n", "_some", "_upto"))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _separator(header: Column) -> Column:
    """The separator that ``_layout`` finds."""
    counts = [_count(header, s) for s in SEPARATORS]
    most, chosen = F.greatest(*counts), F.lit(SEPARATORS[-1])
    for s, n in reversed(list(zip(SEPARATORS, counts))[:-1]):
        chosen = F.when(n == most, s).otherwise(chosen)
    return chosen


def _left_open(value: Column, sep: Column) -> tuple[Column, Column]:
    """Whether a quoted cell is open at a line's end, for a line that begins outside one and for a line that begins inside one."""
    outside, inside = F.lit(False), F.lit(True)
    for s in SEPARATORS:
        tail, closed = f"[^{s}]*+", '(?:[^"]++|"")*+"'
        rest = f'(?:{s}(?:"{closed}{tail}|[^"{s}]{tail}|))*+$'
        outside = F.when(sep == s, ~value.rlike(f'^(?:"{closed}{tail}|[^"{s}]{tail}|){rest}')).otherwise(outside)
        inside = F.when(sep == s, ~value.rlike(f"^{closed}{tail}{rest}")).otherwise(inside)
    none = ~F.contains(value, F.lit('"'))  # such a line leaves the state as it is
    return F.when(none, F.lit(False)).otherwise(outside), F.when(none, F.lit(True)).otherwise(inside)


def walk(begins: np.ndarray, outside: np.ndarray, inside: np.ndarray, state: bool) -> tuple[np.ndarray, np.ndarray]:
    """State before and after every line, given the state before the first. A line that begins a file begins outside.

    A line maps the state before it to the state after it: it forces one, swaps them, or leaves them as they are. Lines that swap are
    counted, and the parity since the last line that forces a state gives the state at any place.
    """
    inside = np.where(begins, outside, inside)
    swaps = np.cumsum(outside & ~inside)
    forced = np.maximum.accumulate(np.where(outside == inside, np.arange(len(begins)), -1))
    known = forced >= 0
    after = np.where(known, outside[forced], state) ^ ((swaps - np.where(known, swaps[forced], 0)) % 2 == 1)
    before = np.append(state, after[:-1]) & ~begins
    return before, after


def _records(lines: DataFrame) -> DataFrame:
    """One row per record: value (its lines, joined), source_file, row_number, _header.

    Lines stay where they are, in order. Every partition tells what it makes of either state at its begin and how many records begin
    in it; put together in order, one row per partition, that gives every partition its state and its first record's number, and
    the lines their records. Only lines of records that go on over several are grouped.
    """
    outside, inside = _left_open(F.col("value"), F.col("_sep"))
    files = cut_lineage(lines.filter("_place = _first").select("_first", "source_file", "_header"))  # a row per file
    flags = lines.select("value", "_place", "_first", (F.col("_place") == F.col("_first")).alias("_begins"), (F.col("_place") == F.col("_last")).alias("_ends"),
                         outside.alias("_outside"), inside.alias("_inside"))
    fixed = cut_lineage(flags.repartitionByRange("_place").sortWithinPartitions("_place")).withColumn("_part", F.spark_partition_id())

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(n).to_numpy(zero_copy_only=False) for n in ("_begins", "_outside", "_inside")]

    def summed(batches):
        states, starts, part = [False, True], [0, 0], None
        for batch in batches:
            if batch.num_rows:
                part = batch.column("_part")[0].as_py()
                for k in (0, 1):
                    before, after = walk(*read(batch), states[k])
                    states[k], starts[k] = bool(after[-1]), starts[k] + int((~before).sum())
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "states": [states], "starts": [starts]}, schema=shape)

    shape = pa.schema([("part", pa.int32()), ("states", pa.list_(pa.bool_())), ("starts", pa.list_(pa.int64()))])
    sums = fixed.select("_part", "_begins", "_outside", "_inside").mapInArrow(summed, "part int, states array<boolean>, starts array<long>")
    begin, state, total = {}, False, 0
    for row in sorted(sums.collect()):  # one row per partition
        begin[row["part"]] = (state, total)
        state, total = row["states"][state], total + row["starts"][state]

    def told(batches):
        state, total = None, 0
        for batch in batches:
            if batch.num_rows:
                if state is None:
                    state, total = begin[batch.column("_part")[0].as_py()]
                before, after = walk(*read(batch), state)
                record = total + np.cumsum(~before)
                state, total = bool(after[-1]), int(record[-1])
                for name, values in (("_record", record), ("_before", before), ("_after", after)):
                    batch = batch.append_column(name, pa.array(values))
                yield batch

    ddl = f"{', '.join(f'`{n}` {t}' for n, t in fixed.dtypes)}, _record long, _before boolean, _after boolean"
    found = cut_lineage(fixed.mapInArrow(told, ddl).select("value", "_place", "_first", "_begins", "_ends", "_record", "_before", "_after"))
    ends = found.filter("_ends AND _after").select("_record", F.lit(True).alias("_endless"))
    firsts = found.filter("_begins").select("_first", F.col("_record").alias("_one")).join(files, "_first")
    found = found.join(F.broadcast(firsts), "_first").join(F.broadcast(ends), "_record", "left")  # a row per file
    number = (F.col("_record") - F.col("_one") + 1).alias("row_number")
    alone = found.filter("NOT _before AND NOT _after").select("value", "source_file", number, "_header")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "value"))), lambda x: x["value"]), "\n")
    whole = found.filter("(_before OR _after) AND _endless IS NULL").groupBy("_record", "_one", "source_file", "_header").agg(joined.alias("value"))
    whole = cut_lineage(whole.select("value", "source_file", number, "_header"))
    endless = found.filter("_endless").withColumn("_begin", F.when(~F.col("_before"), F.col("_place")))
    begins = endless.groupBy("_record").agg(F.min("_begin").alias("_opened"))
    endless = endless.join(F.broadcast(begins), "_record")
    endless = endless.select("value", "source_file", (F.col("_record") - F.col("_one") + 1 + F.col("_place") - F.col("_opened")).alias("row_number"), "_header")
    return alone.unionByName(whole).unionByName(endless)


def _blank(cells: Column, names: list[str]) -> Column:
    """Nothing in any of the named cells."""
    blank = F.lit(True)
    for n in names:
        blank = blank & is_blank(cells[n])
    return blank


def _schema(names: list[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def _from_lines(rows: DataFrame, separator: str, names: list[str]) -> DataFrame:
    """Cells of the records that have any. A filter behind the parsing would parse every record again, as it moves before it: a record
    of one line, no more cells than names and a letter or digit has something in a cell, so only others are parsed to be judged."""
    cells = F.from_csv("value", _schema(names), {"sep": separator, "escape": '"'})
    value = F.col("value")
    sure = value.rlike("[0-9A-Za-z]") & (_count(value, separator) < len(names)) & ~F.contains(value, F.lit("\n"))
    rows = rows.filter(~is_blank(value) & (sure | ~_blank(cells, names))).select(cells.alias("_c"), "source_file", "row_number")
    return rows.select(*[F.col("_c")[n].alias(n) for n in names], "source_file", "row_number")


def map_headers(df: DataFrame, passed: tuple[str, ...] = ("source_file", "row_number")) -> DataFrame:
    """Columns renamed to the fields their headers mean; other columns are dropped."""
    chosen = []
    for name in df.columns:
        known = name if name in HEADER_ALIASES.values() else HEADER_ALIASES.get(fold_literal(name.split("#")[0]))
        field = known if name not in passed else None
        if field:
            chosen.append((name, field))
    fields = [f for _, f in chosen]
    if not set(fields) & set(IDENTIFIERS):
        raise ValueError("the header needs an SKU or barcode column")
    if len(set(fields)) != len(fields):
        raise ValueError("several columns have the same meaning")
    kept = [F.col(f"`{n}`") for n in passed if n in df.columns]
    return df.select(*kept, *[F.col(f"`{n}`").alias(f) for n, f in chosen])


def _amount(c: Column, name: str) -> Column:
    """A decimal of the catalog's type, rounded half up; a fault where it isn't one or does not fit."""
    text = F.translate(F.replace(c, F.lit(UNSAFE), F.lit("")), ", %", ".")
    kind = "decimal(6,2)" if name == "discount_percent" else "decimal(12,2)"

    def judged(number: Column) -> Column:
        good = (number >= 0) & (number <= 100) if name == "discount_percent" else number >= 0
        value = F.when(good, F.round(number, 2).try_cast(kind))
        return F.struct(value.alias("value"), F.when(value.isNull(), f"invalid value for {name}").alias("fault"))

    return let(text.try_cast("decimal(38,12)"), judged)


def _moment(c: Column) -> Column:
    moment = F.try_to_timestamp(c)
    return F.struct(moment.alias("value"), F.when(moment.isNull(), "invalid date").alias("fault"))


def _typed(name: str) -> tuple[Column, Column]:
    """Value and fault of one field, from its stripped text and what is made of it; an empty cell has neither."""
    text, made = F.col(f"_text_{name}"), F.col(f"_made_{name}")
    if name in IDENTIFIERS:
        fault = F.when(text.startswith(UNSAFE), "unsafe numeric identifier").otherwise(identifier_fault(made))
        value = F.when(fault.isNull(), made)
    elif name in AMOUNTS or name == "last_updated":
        value, fault = made["value"], made["fault"]
    else:
        value, fault = made, F.lit(None).cast("string")
    there = F.coalesce((text != FORMULA) & (text != ""), F.lit(False))
    return F.when(there, value), F.when(text == FORMULA, "replace formulas by values").when(there, fault)


def _made(name: str) -> Column:
    text = F.col(f"_text_{name}")
    if name in IDENTIFIERS:
        return without_point(text)
    if name in AMOUNTS:
        return _amount(text, name)
    return _moment(text) if name == "last_updated" else text


def type_import_lines(df: DataFrame) -> DataFrame:
    """Typed columns and ``error``, the first fault of a row in column order; a bad row keeps its raw
    texts in ``raw`` and the good ones go on. What is used several times is a column of its own, so it is made once per row."""
    fields = [c for c in df.columns if c in HEADER_ALIASES.values()]
    rows = df.withColumns({f"_text_{name}": strip(F.col(name)) for name in fields})
    rows = rows.withColumns({f"_made_{name}": _made(name) for name in fields})
    typed = {name: _typed(name) for name in fields}
    rows = rows.withColumns({f"_{name}": F.struct(v.alias("value"), f.alias("fault")) for name, (v, f) in typed.items()})
    lacking = F.lit(True)
    for name in IDENTIFIERS:
        if name in fields:
            lacking = lacking & F.col(f"_{name}.value").isNull()
    faults = [F.col(f"_{name}.fault") for name in fields]
    rows = rows.withColumn("error", F.coalesce(*faults, F.when(lacking, "sku and barcode are missing")))
    others = [c for c in df.columns if c not in fields]
    raw = F.when(F.col("error").isNotNull(), F.struct(*fields))
    return rows.select(*others, raw.alias("raw"), *[F.col(f"_{n}.value").alias(n) for n in fields], "error")
