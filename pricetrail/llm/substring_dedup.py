"""Repeated passages: winnowed anchors as seeds, extended both ways to windows, and merged into maximal repeats.

Every window of ``window`` words names one anchor: of its runs of ``seed`` words the one with the smallest hash, the leftmost of
equals. Equal windows name equal anchors, so a passage that two documents share is found wherever it begins. The windows that name
one anchor reach from it to the left and to the right as far as a shared window can reach.

1. Seeds: anchors that occur in two documents or more.
2. Contexts: all windows around a seed at once, as one hash. Where a smaller document has the same context, the whole extension
   matches.
3. Windows: where a seed has several contexts, its first occurrences in each are extended window by window.
4. Matching windows that overlap or touch make maximal repeats, which are cut.

Nothing meets in pairs: each step looks up the smallest doc_id that holds a hash, and such minima combine before the shuffle. Keys of
the last two steps are two 64-bit hashes, the anchor's and the context's or the window's.

What a pass need not look up again is sifted out by bit arrays of 2 ** ``bits`` bits, which hold what the step before found. They
are never larger, and let through too much rather than too little: with more data they save less, and results stay the same.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.rows import held, keep_rows, map_batches, utf8
from pricetrail.llm.wordgrams import Words, least, mixed, runs
from pricetrail.operators.joins import spread_lookup

#: Words of the shortest passage that counts as repeated.
WINDOW = 13
#: Words of an anchor.
SEED = 5
#: Bits of a sieve, as a power of two: 4 MB, whatever the data.
BITS = 25
_PAGE = 4096


class Sieve:
    """A bit array of fixed size, set by Spark from a column of hashes and sent to every task."""

    def __init__(self, df: DataFrame, value: Column, bits: int):
        self.mask = (1 << bits) - 1
        places = df.select((value.cast("long").bitwiseAND(F.lit(self.mask)) + 1).alias("at")).filter("at IS NOT NULL")
        pages = places.groupBy(F.bitmap_bucket_number("at").alias("page"))
        held = np.zeros(max(1, (1 << bits) // 8 // _PAGE) * _PAGE, np.uint8)
        for r in pages.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():  # 2 ** bits bits at most
            held[(r["page"] - 1) * _PAGE : r["page"] * _PAGE] = np.frombuffer(r["bits"], np.uint8)
        self.sent = df.sparkSession.sparkContext.broadcast(held)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = values.view(np.int64) & self.mask
        return self.sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


class Anchors:
    """The anchors of a piece of texts: row, key, context, place of the first window and number of windows; hashes of all windows."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, window: int, seed: int):
        rows = np.repeat(np.arange(len(counts)), counts)
        places = np.arange(len(words)) - (np.cumsum(counts) - counts)[rows]
        whole = np.flatnonzero(counts[rows] - places >= window)
        keys, self.windows = runs(words, seed), runs(words, window)[whole]
        named = least(keys, window - seed + 1)[whole]
        self.first = np.flatnonzero(np.append(True, named[1:] != named[:-1])[: len(whole)])
        self.n = np.diff(np.append(self.first, len(whole)))
        self.key, self.row, self.start = keys[named[self.first]], rows[whole[self.first]], places[whole[self.first]]
        total = np.add.reduceat(mixed(self.windows), self.first) if len(whole) else self.windows
        self.context = mixed(total + self.n.astype(np.uint64))


class _Passages:
    """The rows of ``docs`` with all that the passes over them share."""

    def __init__(self, docs: DataFrame, window: int, seed: int, bits: int):
        if not 0 < seed <= window:
            raise ValueError("an anchor needs a word at least, and at most a window's")
        self.window, self.seed, self.bits = window, seed, bits
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = rows.select("doc_id", F.xxhash64("text").alias("tag"), "text")
        again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        self.again = self.sieve(again, "doc_id")

    def sieve(self, df: DataFrame, value: str) -> Sieve:
        return Sieve(df, F.expr(value), self.bits)

    def emit(self, schema: str, step) -> DataFrame:
        """``step(anchors, doc_ids, tags)`` for the pieces of every batch; it returns a list of arrays."""
        columns = [part.split() for part in schema.split(", ")]
        size, seed, again = self.window, self.seed, self.again

        def make():
            words = Words()

            def run(batch: pa.RecordBatch) -> dict:
                ids, tags, out = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
                tags = np.where(again.has(ids), tags, 0)
                for at, found, counts in words.of(batch.column(2)):
                    out.append(step(Anchors(found, counts, size, seed), ids[at:], tags[at:]))
                kinds = {"long": np.int64, "int": np.int32}
                return {name: pa.array(np.concatenate(x).view(kinds[kind])) for (name, kind), x in zip(columns, zip(*out))}

            return run

        return map_batches(self.rows.filter("doc_id IS NOT NULL"), make, schema)


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, tag, start, n: ``n`` windows from word ``start`` on, each of which also starts in a document with a smaller doc_id.

    All such windows are covered, some more than once. ``tag`` tells rows apart that share a doc_id; it is zero where none do (and may
    be a hash of the text). Rows without doc_id, null and empty texts and texts shorter than a window report nothing and count for no
    other row.
    """
    return _windows(_Passages(docs, window, seed, bits))


def _windows(p: _Passages) -> DataFrame:
    # 1. Seeds. 32 bits of an anchor, once for every row that has it: where different anchors share them, too much passes.
    def halves(a, ids, tags):
        low = a.key & np.uint64(0xFFFFFFFF)
        return [np.unique(a.row.astype(np.uint64) << np.uint64(32) | low).astype(np.uint32)]

    twice = p.emit("half int", halves).groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seeds = p.sieve(twice, "half")

    # 2. Contexts: the smallest document of each.
    def contexts(a, ids, tags):
        at = np.flatnonzero(seeds.has(a.key))
        return [a.key[at], a.context[at], ids[a.row[at]]]

    around = p.emit("anchor long, context long, doc_id long", contexts).groupBy("anchor", "context")
    around = held(around.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "contexts")
    shared = around.filter("least < most").select("anchor", "context", "least")
    in_shared = p.sieve(shared, "context")

    def occurrences(a, ids, tags):
        at = np.flatnonzero(seeds.has(a.key) & in_shared.has(a.context))
        return [a.key[at], a.context[at], ids[a.row[at]], tags[a.row[at]], a.start[at], a.n[at]]

    met = p.emit("anchor long, context long, doc_id long, tag long, start long, n long", occurrences)
    wide = spread_lookup(met, shared, ["anchor", "context"], "doc_id", "inner").filter("doc_id > least")

    # 3. Windows of seeds with several contexts, from the smallest document of each context only: in others, all windows match.
    mixed_seeds = around.groupBy("anchor").agg(F.min("context").alias("a"), F.max("context").alias("b")).filter("a <> b")
    in_mixed, in_first = p.sieve(mixed_seeds, "anchor"), p.sieve(around, "context ^ least")

    def first_of_context(a, ids):
        at = np.flatnonzero(in_mixed.has(a.key))
        at = at[in_first.has(a.context[at].view(np.int64) ^ ids[a.row[at]])]
        step = np.arange(a.n[at].sum()) - np.repeat(np.cumsum(a.n[at]) - a.n[at], a.n[at])
        at = np.repeat(at, a.n[at])
        return at, step, a.windows[a.first[at] + step]

    def extensions(a, ids, tags):
        at, _, window = first_of_context(a, ids)
        return [a.key[at], window, ids[a.row[at]]]

    alike = p.emit("anchor long, window long, doc_id long", extensions).groupBy("anchor", "window")
    alike = alike.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    alike = held(alike.select("anchor", "window", "least"), "windows")
    in_alike = p.sieve(alike, "window")

    def single(a, ids, tags):
        at, step, window = first_of_context(a, ids)
        kept = np.flatnonzero(in_alike.has(window))
        at, step, window = at[kept], step[kept], window[kept]
        return [a.key[at], window, ids[a.row[at]], tags[a.row[at]], a.start[at] + step]

    alone = p.emit("anchor long, window long, doc_id long, tag long, start long", single)
    alone = spread_lookup(alone, alike, ["anchor", "window"], "doc_id", "inner").filter("doc_id > least")
    return wide.select("doc_id", "tag", "start", "n").unionByName(alone.select("doc_id", "tag", "start", F.lit(1).cast("long").alias("n")))


def _cut(text: bytes | None, found: list[int] | None, window: int) -> tuple[int, list[dict], bytes]:
    """Number of words, maximal repeats and the words left. ``found`` are starts and numbers of windows in one number each."""
    words = (text or b"").split()
    if not found:
        return len(words), [], b" ".join(words)
    start, n = np.divmod(np.array(found, np.int64), window + 1)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + n + window - 1, -1)
    gone = np.cumsum(depth)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    spans = [{"first": int(s), "last": int(e) - 1} for s, e in zip(edges[::2], edges[1::2])]
    return len(words), spans, b" ".join(compress(words, ~gone))


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, spans (first and last word of every maximal repeat, counted from 0), kept (words left, joined by a space).

    One row for every row of ``docs``. A word is cut if a window that covers it also starts in a document with a smaller doc_id, so the
    first document keeps a shared passage, and nothing that only repeats inside one document goes. Windows are judged on the input. Rows
    that share a doc_id don't count as smaller than each other. Rows without doc_id are kept whole and count for no other row. Null and
    blank texts have no words. Texts are read whole, other columns are ignored; an empty table gives no rows.
    """
    p = _Passages(docs, window, seed, bits)
    packed = (F.col("start") * (window + 1) + F.col("n")).alias("found")
    found = _windows(p).select("doc_id", "tag", packed).groupBy("doc_id", "tag").agg(F.collect_list("found").alias("found"))
    found = held(found, "repeats")  # a row holds at most one number per word of its document
    touched, again = p.sieve(found, "doc_id"), p.again

    def which(hit: bool):
        """Rows whose doc_id may have repeats, or those whose doc_id has none: the latter need not be shuffled."""

        def make():
            def step(batch: pa.RecordBatch) -> pa.Array:
                ids = batch.column(0)
                there = touched.has(ids.fill_null(0).to_numpy()) & ~ids.is_null().to_numpy(zero_copy_only=False)
                return pa.array(there == hit)

            return step

        return make

    def finish():
        def step(batch: pa.RecordBatch) -> dict:
            lists = batch.column(2).to_pylist()
            cut = [_cut(t, f, window) for t, f in zip(utf8(batch.column(1)), lists)]
            n, spans, kept = zip(*cut)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            return {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, kind),
                    "kept": pa.array(kept, pa.binary()).cast(pa.string())}

        return step

    def tagged():
        def step(batch: pa.RecordBatch) -> dict:
            ids = batch.column(0)
            return {"doc_id": ids, "tag": pa.array(np.where(again.has(ids.to_numpy()), batch.column(1).to_numpy(), 0)), "text": batch.column(2)}

        return step

    schema = "doc_id long, n_words long, spans array<struct<first: long, last: long>>, kept string"
    plain = keep_rows(p.rows, which(False)).select("doc_id", "text", F.lit(None).cast("array<long>").alias("found"))
    marked = map_batches(keep_rows(p.rows, which(True)), tagged, "doc_id long, tag long, text string")
    marked = spread_lookup(marked, found, ["doc_id", "tag"], "text", "left").select("doc_id", "text", "found")
    return map_batches(plain, finish, schema).unionByName(map_batches(marked, finish, schema))
