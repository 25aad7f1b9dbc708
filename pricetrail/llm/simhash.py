"""SimHash near-duplicates: fingerprints compared as vertical bit planes with carry-save counters.

Documents become 64-bit fingerprints. Equal fingerprints are collapsed first. Two fingerprints that differ in at most
``radius`` bits agree on at least ``BLOCKS - radius`` of the ``BLOCKS`` blocks of bits, so each goes once to the bucket of every
choice of that many blocks, and only rows of one bucket are compared. In a bucket, bit b of many fingerprints lies in one row of
words (a plane); a query's distance to 64 fingerprints per word is counted by two carry-save counters and an overflow
plane, and a block of them is given up as soon as all have overflowed. A bucket reports a spanning forest of its links, never
all its pairs. Buckets of more than ``TILE`` fingerprints are cut into tiles, and the pairs of tiles are spread over tasks.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.llm.components import components
from pricetrail.llm.rows import map_batches, unused, utf8
from pricetrail.operators.joins import spread_lookup
from pricetrail.session import cut_lineage

BITS = 64
#: Blocks of bits of which a choice must be equal: five blocks and radius 3 give ten tables with keys of 25 or 26 bits.
BLOCKS = 5
#: Fingerprints of one bucket compared by one task at a time. Larger buckets are split, not cut.
TILE = 4096
#: Shingles whose bits are unpacked at a time, so that a very long text needs no more memory.
STEP = 1 << 14
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """SimHash of the ``size``-word shingles of a UTF-8 text, A-Z lower-cased, repeats included. No words: zero."""
    words = (text or b"").lower().split()  # for bytes these are exactly A-Z and the space characters 09-0D and 20
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for every row. Null and empty texts have fingerprint zero."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64)
            return {"doc_id": batch.column(0), "fp": pa.array(found.view(np.int64))}

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, make, "doc_id long, fp long")


def block_masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Bits that must be equal in each table, as signed longs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << BITS) if m >> 63 else m for m in masks]


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 of them in a word."""
    wide = -(-len(fps) // BITS) * BITS
    bits = np.zeros((wide, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """A bit per query and lane: set where the fingerprints differ in at most ``radius`` bits.

    ``queries`` are fingerprints, ``lanes`` the bit planes of others. The counters are ``ones``, ``twos``, ``fours`` ... as bit
    planes of their own, started so that the counter overflows at radius + 1; the overflow is kept. After every eight planes
    the block is abandoned if every lane has overflowed.
    """
    size = (len(queries), lanes.shape[1])
    width = (radius + 1).bit_length() if radius else 1
    start = (1 << width) - (radius + 1)
    counter = [np.full(size, ALL if start >> i & 1 else 0, np.uint64) for i in range(width)]
    over = np.zeros(size, np.uint64)
    for b in range(BITS):
        flip = np.where((queries >> np.uint64(b)) & np.uint64(1), ALL, np.uint64(0))
        carry = lanes[b][None, :] ^ flip[:, None]
        for plane in counter:
            both = plane & carry
            plane ^= carry
            carry = both
        over |= carry
        if b % 8 == 7 and (over == ALL).all():
            break
    return ~over


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints of one bucket."""
    if len(fps) < 2:
        return []
    lanes, group, links = planes(fps), np.arange(len(fps)), []
    for at in range(0, len(fps), 128):
        near = within(fps[at : at + 128], lanes, radius)
        for i, row in enumerate(near, at):
            lit = np.flatnonzero(row)
            hits = np.flatnonzero(np.unpackbits(row[lit].view(np.uint8), bitorder="little"))
            hits = lit[hits // BITS] * BITS + hits % BITS
            hits = hits[hits < len(fps)]
            others, first = np.unique(group[hits], return_index=True)
            if len(others) > 1:
                links += [(int(fps[i]), int(fps[hits[f]])) for o, f in zip(others, first) if o != group[i]]
                group[np.isin(group, others)] = others[0]
    return links


def _small_links(bucket: np.ndarray, fps: np.ndarray, radius: int, most: int) -> list[tuple[int, int]]:
    """Links inside many buckets of at most ``most`` rows at once: rows are lanes, compared with the k-th row after them."""
    links, lanes = [], planes(fps)
    for k in range(1, most):
        same = np.zeros(lanes.shape[1] * BITS, np.uint8)
        same[: len(fps) - k] = bucket[:-k] == bucket[k:]
        live = np.packbits(same, bitorder="little").view("<u8")
        if not live.any():
            break
        after = np.concatenate([lanes, np.zeros((BITS, 1), np.uint64)], axis=1)
        shifted = (after[:, :-1] >> np.uint64(k)) | (after[:, 1:] << np.uint64(BITS - k))
        width = (radius + 1).bit_length() if radius else 1
        start = (1 << width) - (radius + 1)
        counter = [np.full(len(live), ALL if start >> i & 1 else 0, np.uint64) for i in range(width)]
        over = ~live
        for b in range(BITS):
            carry = lanes[b] ^ shifted[b]
            for plane in counter:
                both = plane & carry
                plane ^= carry
                carry = both
            over |= carry
            if b % 8 == 7 and (over == ALL).all():
                break
        for i in np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")):
            links.append((int(fps[i]), int(fps[i + k])))
    return links


def links_of_sorted(bucket: np.ndarray, fps: np.ndarray, radius: int, small: int = 16) -> list[tuple[int, int]]:
    """Links of whole buckets, given as rows sorted by bucket."""
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(bucket)))
    links = []
    tiny = np.repeat((sizes > 1) & (sizes <= small), sizes)
    if tiny.any():
        links += _small_links(bucket[tiny], fps[tiny], radius, small)
    for s, n in zip(starts[sizes > small], sizes[sizes > small]):
        links += bucket_links(fps[s : s + n], radius)
    return links


def fingerprint_links(unique: DataFrame, radius: int = 3, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """a, b: links that connect whatever fingerprints (``fp``, one row each) within ``radius`` bits connect."""
    masks = block_masks(radius, blocks)
    entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(masks)])
    rows = unique.select("fp", F.inline(entries))
    counts = rows.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = spread_lookup(rows, counts, ["t", "bits"], "fp", "inner")
    k = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), k).cast("int")
    rows = rows.withColumn("k", k).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    bucket = F.xxhash64("t", "bits", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(bucket.alias("bucket"), "fp")  # two buckets that share a hash are compared as one: no link is lost
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        held_b, held_f, held = [], [], 0
        done = lambda ls: pa.RecordBatch.from_arrays(
            [pa.array(np.array(side, np.uint64).view(np.int64)) for side in (zip(*ls) if ls else ([], []))], names=["a", "b"])
        for batch in batches:
            held_b.append(batch.column(0).to_numpy())
            held_f.append(batch.column(1).to_numpy().view(np.uint64))
            held += batch.num_rows
            if held >= 1 << 16:
                b, f = np.concatenate(held_b), np.concatenate(held_f)
                cut = int(np.searchsorted(b, b[-1]))  # the last bucket may go on in the next batch
                if cut:
                    yield done(links_of_sorted(b[:cut], f[:cut], radius))
                held_b, held_f, held = [b[cut:]], [f[cut:]], len(b) - cut
        if held:
            yield done(links_of_sorted(np.concatenate(held_b), np.concatenate(held_f), radius))

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``.

    component_id is the smallest doc_id among the documents reachable over links of at most ``radius`` differing bits, the
    document itself included; rows without doc_id link like any other but give no id (a component of such rows alone has a null
    id). Texts without words have fingerprint zero and link like any other. Repeated rows stay repeated; other columns are
    ignored; an empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs))
    unique = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(fingerprint_links(unique.select("fp"), radius))
    rooted = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = spread_lookup(rooted.select("fp", "root"), least, ["root"], "fp", "left").select("fp", "component_id")
    return spread_lookup(rows, named, ["fp"], "doc_id", "left").select("doc_id", "fp", "component_id")


def first_of_group(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their group: exactly one row of every group of linked fingerprints.

    First is the row with the smallest doc_id, rows without doc_id last; among rows that share it, the one whose text has the smallest
    SHA-256. Rows are judged one by one, so rows that share a doc_id but not their text stay or go each with its own group. Of
    rows equal in doc_id and text, one stays. Null texts are the same as empty ones.
    """
    id_, of, digest, rank = (unused(docs, name) for name in ("first_id", "first_digest", "digest", "rank"))
    sha = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(t) for t in utf8(batch.column(2))], np.uint64)
            return {"doc_id": batch.column(0), "digest": batch.column(1), "fp": pa.array(found.view(np.int64))}

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("digest"), "text")
    rows = cut_lineage(map_batches(rows, make, "doc_id long, digest binary, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first")
    unique = cut_lineage(rows.groupBy("fp").agg(first))
    roots = components(fingerprint_links(unique.select("fp"), radius))
    rooted = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(id_), F.col("first.digest").alias(of))
    own = docs.withColumn(digest, sha)
    kept = own.join(firsts, (own[digest] == firsts[of]) & own["doc_id"].cast("long").eqNullSafe(firsts[id_]), "inner").drop(id_, of)
    placed = F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(F.xxhash64(*[f"`{c}`" for c in docs.columns])))
    return kept.withColumn(rank, placed).filter(f"{rank} = 1").drop(digest, rank)
