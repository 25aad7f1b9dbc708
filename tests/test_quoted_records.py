"""Records over several lines, put together by prefix states of quotes, against a reader that takes a file whole."""

import csv
import io
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetrail.operators.changes import number_rows
from pricetrail.plans import ingest
from pricetrail.plans.registry import Source
from pricetrail.sources.identifier_files import _left_open, _records, _separator, map_headers, read_identifier_csv, walk


def cells(pick, sep):
    text = "".join(pick.choice(['a', 'bc', ' ', '"', '\n', '\n\n', sep, 'ț']) for _ in range(pick.randint(0, 6)))
    return text if text.strip() else "x"


def written(rows, sep, quote_all=False):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="\n", quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


@pytest.fixture
def many_parts(spark):
    """Enough partitions that records lie across their borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    for k, v in zip(old, ("false", "13", "4096")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, sep, quoted", [(1, ";", False), (2, ",", True), (3, "\t", False)])
def test_equals_a_reader_of_whole_files(spark, tmp_path, many_parts, seed, sep, quoted):
    pick = random.Random(seed)
    wanted = {}
    for name in ("one", "two"):
        rows = [[str(i), cells(pick, sep), cells(pick, sep)] for i in range(300)]
        (tmp_path / f"{name}.csv").write_text(written([["sku", "ean", "name"], *rows], sep, quoted), newline="")
        wanted |= {(f"{name}.csv", k): tuple(r) for k, r in enumerate(rows, 2)}
    (tmp_path / "plain.csv").write_text(sep.join(["sku", "ean", "name"]) + "\n" + sep.join("pqr") + "\n")
    got = {(r.source_file, r.row_number): (r.sku, r.barcode, r.name) for r in map_headers(read_identifier_csv(spark, str(tmp_path))).collect()}
    assert got == wanted | {("plain.csv", 2): ("p", "q", "r")}


def test_one_line_break_does_not_bring_a_file_together(spark, tmp_path, many_parts):
    lines = [f"{i};code {i};name {i}" for i in range(5000)]
    lines[2500] = '2500;"two\nlines";name'
    (tmp_path / "a.csv").write_text("sku;ean;name\n" + "\n".join(lines) + "\n")
    rows = read_identifier_csv(spark, str(tmp_path))
    assert rows.count() == 5000 and "multiLine" not in rows._jdf.queryExecution().toString()
    lines = spark.read.text(str(tmp_path)).select("value", F.monotonically_increasing_id().alias("_at"))
    placed = number_rows(lines, ["_at"], "_place").withColumns({"_file": F.lit("a"), "source_file": F.lit("a"), "_header": F.lit("h"), "_sep": F.lit(";"),
                                                                "_first": F.lit(1), "_last": F.lit(5002)})
    assert placed.rdd.getNumPartitions() > 4  # where the quotes are counted
    assert _records(placed.withColumn("_header", F.lit("h"))).count() == 5001
    got = {r.row_number: r.ean for r in rows.filter("row_number BETWEEN 2501 AND 2503").collect()}
    assert got == {2501: "code 2499", 2502: "two\nlines", 2503: "code 2501"}


def test_stray_and_endless_quotes(spark, tmp_path):
    text = 'sku;ean;name\n1;b1;5" pipe\n2;b2;"a ""b"""\n3;b3;x"y"z\n4;b4;"never closed\n5;b5;plain\n6;b6;last\n'
    (tmp_path / "a.csv").write_text(text)
    got = {r.row_number: (r.sku, r.ean, r.name) for r in read_identifier_csv(spark, str(tmp_path)).collect()}
    assert got[2] == ("1", "b1", '5" pipe') and got[3] == ("2", "b2", 'a "b"') and got[4] == ("3", "b3", 'x"y"z')
    assert got[6] == ("5", "b5", "plain") and got[7] == ("6", "b6", "last") and got[5][0] == "4" and len(got) == 6


def test_walk_by_definition():
    pick = np.random.default_rng(5)
    for _ in range(50):
        n = int(pick.integers(1, 40))
        begins, outside, inside = pick.random(n) < 0.1, pick.random(n) < 0.3, pick.random(n) < 0.6
        for state in (False, True):
            before, after = walk(begins, outside, inside, state)
            now = state
            for i in range(n):
                now = False if begins[i] else now
                assert before[i] == now
                now = inside[i] if now else outside[i]
                assert after[i] == now


@pytest.mark.parametrize("line, outside, inside", [
    ("a;b", False, True), ('"a";b', False, False), ('"a;b', True, False), ('a;"b', True, False), ('a"b;c', False, False),
    ('"a""b";c', False, False), ('"a"";b', True, False), ('x";"y', True, True), ("", False, True), ('";', True, False), ('""', False, True),
])
def test_what_a_line_makes_of_a_state(frame, line, outside, inside):
    found = frame("v string", [(line,)]).select(*_left_open(F.col("v"), F.lit(";"))).first()
    assert tuple(found) == (outside, inside)


def test_separator_of_a_header(frame):
    rows = frame("h string", [("a;b,c;d",), ("a,b;c",), ("a\tb\tc;d",), ("a,b",), ("a",)])
    assert [r[0] for r in rows.select(_separator(F.col("h"))).collect()] == [";", ";", "\t", ",", ";"]


def test_every_file_of_the_query_has_its_header_first(spark, monkeypatch, many_parts):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the given tables are not here")
    seen, read = [], ingest.D.read_identifier_csv
    monkeypatch.setattr(ingest.D, "read_identifier_csv", lambda spark, path: seen.append(path) or read(spark, path))
    assert ingest.quoted_records(Source(spark, folder)).count() > 5000
    parts = [f for f in os.listdir(seen[0]) if f.startswith("part-")]
    firsts = {open(f"{seen[0]}/{f}").readline() for f in parts}
    assert len(parts) > 1 and firsts == {"Cod SKU;EAN;Denumire\n"}


def test_lines_are_numbered_without_being_moved(spark, tmp_path, many_parts):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("sku;ean;name\n" + "".join(f"{i};code {i};n\n" for i in range(2000)))
    rows = read_identifier_csv(spark, str(tmp_path))
    got = rows.groupBy("source_file").agg(F.count_distinct("row_number"), F.min("row_number"), F.max("row_number"), F.bool_and(F.col("sku").cast("long") == F.col("row_number") - 2))
    assert sorted(map(tuple, got.collect())) == [("a.csv", 2000, 2, 2001, True), ("b.csv", 2000, 2, 2001, True)]
    assert not re.search("Exchange (range|hash)partitioning", rows._jdf.queryExecution().executedPlan().toString())
