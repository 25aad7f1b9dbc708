"""What every order of several filters removes, step by step, from the counts of failed filters alone.

A document's mask tells which filters it fails. In a given order, it goes at the first filter that it fails. Orders are ranked
lexicographically (Lehmer code), so the orders that begin with the same filters are an interval of ranks: a mask's removal step k
covers the intervals of the beginnings whose k-th filter is the first one in the mask. Counts per mask are added at the start of an
interval and taken off at its end, and a running sum over the ranks gives every order's removals. Documents are read once; what
follows works on at most 2 ** filters counts a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.operators.joins import spread_lookup


def lehmer_rank(order: tuple[int, ...], size: int) -> int:
    """Rank of the first order, of all orders of ``size`` things, that begins with ``order``."""
    return sum(sum(x < this and x not in order[:i] for x in range(size)) * factorial(size - 1 - i) for i, this in enumerate(order))


def intervals(size: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of all masks; steps count from 1. Neighbouring intervals are joined."""
    found: dict[tuple[int, int], list[list[int]]] = {}
    for step in range(1, size + 1):
        for begin in permutations(range(size), step):  # in order of rank
            low = lehmer_rank(begin, size)
            high = low + factorial(size - step)
            for mask in range(1 << size):
                if mask >> begin[-1] & 1 and not any(mask >> b & 1 for b in begin[:-1]):
                    spans = found.setdefault((mask, step), [])
                    if spans and spans[-1][1] == low:
                        spans[-1][1] = high
                    else:
                        spans.append([low, high])
    return [(mask, step, low, high) for (mask, step), spans in sorted(found.items()) for low, high in spans]


def audit(masked: DataFrame, names: str, weights: list[str]) -> DataFrame:
    """Removals of every order of filters, by part.

    ``masked`` has one row per document: part (string; null is the same as empty), mask (bit i is set if the document fails filter i) and
    whole-number columns ``weights``. ``names`` has a letter per filter. For every part, order and step there is a row: part, filter_order,
    step, kept, removed, redundant (documents that fail the step's filter and went earlier), unique_fails (documents that fail this filter
    only), shapley (what the filter removes, summed over all orders at whatever step), and what the step removes of each of
    ``weights``. A part whose documents all pass has rows of zeros; no documents give no rows.
    """
    size, measures = len(names), ["n", *weights]
    letters = ["".join(o) for o in permutations(names)]
    part = F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part")
    counts = masked.groupBy(part, "mask").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in weights))

    # what a mask adds where an interval of orders begins and takes off where it ends; the frame's size depends on ``size`` alone
    covered = masked.sparkSession.createDataFrame(intervals(size), "mask int, step int, low int, high int")
    ends = F.array(*[F.struct(F.col(at).alias("rank"), F.lit(sign).alias("sign")) for at, sign in (("low", 1), ("high", -1))])
    changes = counts.join(F.broadcast(covered), "mask").withColumn("end", F.explode(ends))
    changes = changes.groupBy("part", "step", F.col("end.rank").alias("rank")).agg(*(F.sum(F.col("end.sign") * F.col(m)).alias(m) for m in measures))

    failing = [F.sum(F.when(F.expr(f"(mask >> {i}) & 1 = 1"), F.col("n")).otherwise(0)) for i in range(size)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(size)]
    whole = counts.groupBy("part").agg(F.sum("n").alias("documents"), F.array(*failing).alias("failing"), F.array(*alone).alias("alone"))
    steps = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    steps = steps.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(letters) - 1))))

    rows = steps.join(changes, ["part", "step", "rank"], "left").repartition("part")  # orders x steps rows a part; one shuffle for all windows
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("part", "step", "rank", "documents", "failing", "alone", *[F.coalesce(F.sum(m).over(so_far), F.lit(0)).alias(m) for m in measures])
    order = F.get(F.split(F.lit(",".join(letters)), ","), F.col("rank"))
    rows = rows.withColumn("filter_order", order).withColumn("i", F.instr(F.lit(names), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        "part", "filter_order", "step", (F.col("documents") - gone).alias("kept"), F.col("n").alias("removed"),
        (F.get("failing", F.col("i")) - F.col("n")).alias("redundant"), F.get("alone", F.col("i")).alias("unique_fails"),
        F.sum("n").over(Window.partitionBy("part", "i")).alias("shapley"), *weights)


def failed(text: Column) -> dict[str, Column]:
    """Conditions on one text: A few words, B few different words, C many capitals, D markup characters. Null is the same as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = lambda ws: F.struct((F.size(ws) < 50).alias("A"), (100 * F.size(F.array_distinct(ws)) < 65 * F.size(ws)).alias("B"))
    by_words = F.transform(F.array(words), tests)[0]  # the list of words is worked out once
    return {"words": by_words, "C": 100 * capitals > 5 * F.length(text), "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text)}


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part (source), mask of filters A to E, good_lost and toxic_lost (1 for documents labelled good or toxic) for every row.

    E holds if the whole text is identical to that of a smaller doc_id, by its SHA-256; rows without doc_id fail it never and cause it
    never, and rows that share a doc_id aren't smaller than each other. If several label rows name a document, one that says good
    (toxic) is enough. A text held by many documents is looked up in a table with one row per text.
    """
    found = failed(F.col("text"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("part"), digest.alias("digest"),
        found["words"].alias("words"), found["C"].alias("C"), found["D"].alias("D"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate((F.col("words.A"), F.col("words.B"), F.col("C"), F.col("D")))]
    rows = rows.select("doc_id", "part", "digest", (bits[0] + bits[1] + bits[2] + bits[3]).alias("mask"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    rows = spread_lookup(rows, firsts, ["digest"], "doc_id", "left")
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("least"), F.lit(16)).otherwise(0))
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("long")).alias("good_lost"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic_lost"))
    rows = spread_lookup(rows, said, ["doc_id"], "digest", "left")
    return rows.select("doc_id", "part", "mask", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("good_lost", "toxic_lost")])


def filter_orders(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters, source by source. Null texts are empty; an empty table gives no rows; other columns are ignored."""
    return audit(masks(docs, labels), "ABCDE", ["good_lost", "toxic_lost"])
