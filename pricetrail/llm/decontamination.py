"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of all test items recognises every run of words that occurs in any item. A document's words are streamed through
it while the length of the longest match that ends at each word is kept. Where a match is long enough, every window (a run of
``window`` item words, or a whole shorter item) that ends there is reported, and the words it covers are hit. Documents above the
coverage limit are dropped; in others, the spans that are hit are cut out.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from pricetrail.llm.rows import map_batches, unused, utf8
from pricetrail.operators.joins import spread_lookup

#: Words of consecutive item text that make a window.
WINDOW = 13
#: A document is contaminated if it has a hit and at least one word in so many is hit.
COVERAGE = 20
#: Item words in one automaton, about 80 MB in a task. Larger benchmarks are dealt over several automata, one pass each.
SHARD_WORDS = 250_000
#: Every byte that is no word byte becomes a space, A-Z become a-z. All bytes of characters from U+0080 on are word bytes.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
                    for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of items [(id, words)], with the windows marked at the states that hold them."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        items = [(i, ws) for i, ws in items if ws]
        self.window = window
        self.shortest = min([window, *(len(ws) for _, ws in items)])
        self.vocabulary: dict[bytes, int] = {}
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items]
        self.size = max(1, len(self.vocabulary))
        #: next state by state * size + word; suffix link and longest match length by state
        self.go: dict[int, int] = {}
        self.out: list[list[int]] = [[]]
        self.link, self.length = [-1], [0]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        del self.out
        self.marks: dict[int, dict[int, set[int]]] = {}
        for i, ws in coded:
            self._mark(i, ws)
        self.above = [-1] * len(self.link)  # the nearest marked state over suffix links, the state itself included
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.above[state] = state if state in self.marks else self.above[self.link[state]] if state else -1

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.link) - 1

    def _set(self, state: int, w: int, to: int) -> None:
        if state * self.size + w not in self.go:
            self.out[state].append(w)
        self.go[state * self.size + w] = to

    def _split(self, state: int, w: int, target: int) -> int:
        """The state for the matches that are one longer than ``state``'s, taken out of ``target`` if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._new(self.length[state] + 1, self.link[target])
        for x in self.out[target]:
            self._set(twin, x, self.go[target * self.size + x])
        self.link[target] = twin
        while state >= 0 and self.go.get(state * self.size + w) == target:
            self.go[state * self.size + w] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, w: int) -> int:
        known = self.go.get(last * self.size + w)
        if known is not None:
            return self._split(last, w, known)
        new, state = self._new(self.length[last] + 1, 0), last
        while state >= 0 and state * self.size + w not in self.go:
            self._set(state, w, new)
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, w, self.go[state * self.size + w])
        return new

    def _mark(self, item: int, ws: list[int]) -> None:
        size, state, matched = min(self.window, len(ws)), 0, 0
        for w in ws:
            state, matched = self.go[state * self.size + w], matched + 1
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            matched = min(matched, self.length[state])
            if matched >= size:
                self.marks.setdefault(state, {}).setdefault(size, set()).add(item)

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [start, end) that windows cover, merged, and the ids of the items they belong to."""
        coded = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws))
        unknown = np.concatenate([[-1], np.flatnonzero(coded < 0), [len(ws)]])
        spans, items = [], set()
        for r in np.flatnonzero(np.diff(unknown) > self.shortest):
            start = int(unknown[r]) + 1
            self._stream(coded[start : unknown[r + 1]].tolist(), start, spans, items)
        return spans, items

    def _stream(self, coded: list[int], start: int, spans: list, items: set) -> None:
        go, link, length, above, marks, size = self.go, self.link, self.length, self.above, self.marks, self.size
        state = matched = 0
        for end, w in enumerate(coded, start + 1):
            while (to := go.get(state * size + w)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                continue
            state, matched = to, matched + 1
            at, longest = above[state], 0
            while at >= 0:
                for n, found in marks[at].items():
                    if n <= matched:
                        items |= found
                        longest = max(longest, n)
                at = above[link[at]] if at else -1
            if longest:
                first = end - longest
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, end))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS):
    """Automata over all items, each of about ``shard_words`` words. Items are dealt by a hash of their id."""
    items = benchmark.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / 6 / shard_words))
    for s in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s) if shards > 1 else items
        rows = sorted(((r.item_id, words((r.text or "").encode())) for r in part.toLocalIterator()), key=repr)
        yield Automaton(rows, window)


def _one_pass(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """doc_id, digest, n_words, spans (word numbers: start, end, start, ...), items."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def make():
        found = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            n, spans, items, digests = [], [], [], []
            for text in utf8(batch.column(1)):
                ws = words(text)
                hit, of = found.hits(ws)
                n.append(len(ws))
                spans.append([x for span in hit for x in span])
                items.append(sorted(i for i in of if i is not None))
                digests.append(hashlib.sha256(text).digest() if text else b"")
            return {"doc_id": batch.column(0), "digest": pa.array(digests, pa.binary()), "n_words": pa.array(n, pa.int64()),
                    "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.int64()))}

        return step

    return map_batches(docs, make, "doc_id long, digest binary, n_words long, spans array<long>, items array<long>")


def _all_passes(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int) -> DataFrame:
    """_one_pass over every automaton. What several automata find in a text meets by the text's digest; only texts with a hit
    in a further automaton take part."""
    first, *more = [_one_pass(docs, a) for a in automata(benchmark, window=window, shard_words=shard_words)]
    if not more:
        return first
    every = None
    for part in more:
        part = part.filter("size(spans) > 0").select("digest", "spans", "items").dropDuplicates(["digest"])
        every = part if every is None else every.unionByName(part)
    every = every.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("items")).alias("of"))
    both = spread_lookup(first, every, ["digest"], "doc_id").withColumn("items", F.array_distinct(F.concat("items", F.coalesce("of", F.array().cast("array<long>")))))
    return both.withColumn("spans", F.concat("spans", F.coalesce("more", F.array().cast("array<long>")))).drop("more", "of")


def _spans_merged(df: DataFrame) -> DataFrame:
    """n_hit of spans that may overlap, in word numbers."""
    pairs = F.expr("array_sort(transform(sequence(0, greatest(size(spans) div 2 - 1, 0)), i -> struct(get(spans, 2 * i) AS a, get(spans, 2 * i + 1) AS b)))")
    covered = F.expr("""aggregate(_pairs, struct(0L AS n, 0L AS reach),
        (s, p) -> struct(s.n + greatest(0L, coalesce(p.b, 0L) - greatest(coalesce(p.a, 0L), s.reach)) AS n, greatest(s.reach, coalesce(p.b, 0L)) AS reach), s -> s.n)""")
    return df.withColumn("_pairs", pairs).withColumn("n_hit", covered).drop("_pairs")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids for every row of ``docs``.

    Null texts and texts without words have no words and are not contaminated. Items without words are left out; an item
    without id still marks words but is not listed. Repeated rows of either table change nothing but their own number. Columns
    other than doc_id and text (item_id and text) are ignored; an empty benchmark finds nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _spans_merged(_all_passes(rows, benchmark, window, shard_words))
    listed = F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string")))
    found = found.withColumn("item_ids", listed)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))).alias("contaminated"), "item_ids")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_WORD_BYTES))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns; spans that are hit are cut from their texts, and n_chars,
    where it is a column, follows the text. With several automata the documents pass one after the other and carry along the spans
    found so far; the last pass merges them, judges the document by all of them and cuts once."""
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    at, carried = names.index("text"), unused(docs, "spans")
    *others, last = [spark.sparkContext.broadcast(a) for a in automata(benchmark, window=window, shard_words=shard_words)]

    def so_far(batch):
        flat = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else repeat((), batch.num_rows)
        return [list(zip(x[::2], x[1::2])) for x in flat]

    def search(batches, shared):
        found = shared.value
        for batch in batches:
            spans = [old + found.hits(words(text))[0] for text, old in zip(utf8(batch.column(at)), so_far(batch))]
            flat = pa.array([[x for span in of for x in span] for of in spans], pa.list_(pa.int64()))
            of_docs = pa.schema(list(batch.schema)[: len(names)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], flat], schema=of_docs.append(pa.field(carried, flat.type)))

    def finish(batches):
        found = last.value
        for batch in batches:
            keep, texts, sizes = [], [], []
            for text, old in zip(utf8(batch.column(at)), so_far(batch)):
                ws = words(text)
                spans = _merged(old + found.hits(ws)[0])
                hit = sum(b - a for a, b in spans)
                keep.append(not hit or coverage * hit < len(ws))
                texts.append(cut(text, spans) if hit and keep[-1] else text)
                sizes.append(hit)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in names and any(h and k for h, k in zip(sizes, keep)):
                old = batch.column(names.index("n_chars"))
                new = [len(t.decode()) if h else o for t, h, o in zip(texts, sizes, old.to_pylist())]
                columns[names.index("n_chars")] = pa.array(new, old.type)
            of_docs = pa.schema(list(batch.schema)[: len(names)])
            yield pa.RecordBatch.from_arrays(columns, schema=of_docs).filter(pa.array(keep, pa.bool_()))

    wider = StructType([*schema.fields]).add(carried, ArrayType(LongType()))
    for shared in others:
        docs = docs.mapInArrow(lambda batches, shared=shared: search(batches, shared), wider)
    return docs.mapInArrow(finish, schema)
