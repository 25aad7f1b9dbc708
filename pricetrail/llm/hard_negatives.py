"""Hard negatives by window searches in a multiway hyperplane tree.

Vectors are scaled to whole numbers, so inner products and squared distances are exact. A tree node has up to ``WAYS`` split points
taken from a bounded sample, and a vector belongs to the child of the nearest one. For every split point a node stores the range of
distances to the vectors below each of its siblings (and itself), taken over all vectors, and the range of their lengths. A search for
scores in [low, high] around an anchor is a search for distances in an annulus, since |x - q|^2 = |x|^2 + |q|^2 - 2<x, q>; by the
triangle inequality a child is eliminated if the annulus misses what its stored range allows, seen from any split point.
Leaves that remain are searched exactly, block by block.

Positives are searched in the anchor's own leaf first, which gives a bound, and then among all scores from that bound up. Negatives are
searched in the windows that the positives open, again in the own leaf first.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.llm.rows import held, map_batches

#: Vectors that split points are taken from, at most about so many, chosen by a hash of the id. All vectors are indexed.
SAMPLE = 4096
#: Split points of a node, and levels of nodes.
WAYS, LEVELS = 16, 2
#: Rows of a block of a leaf, and anchors that are compared with it at a time, on average. Larger leaves have more blocks.
BLOCK, GROUP = 4096, 512
#: Blocks that meet their anchors in one place: an anchor is sent there once, however many of them it visits.
CHUNK = 16
_EXACT = float(1 << 53)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers. Floats are used where they are exact; beyond, 64-bit integers, which may wrap."""
    most = float(np.abs(a, dtype=np.float64).max(initial=0)) * float(np.abs(b, dtype=np.float64).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < _EXACT else a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)))


class Tree:
    """Split points by node, and which child is which node or leaf. Leaves and nodes count from 0; the root is node 0."""

    def __init__(self, sample: np.ndarray, ways: int = WAYS, levels: int = LEVELS):
        self.points: list[np.ndarray] = []
        self.below: list[list[tuple[bool, int]]] = []  # (is a leaf, number) of each child
        self.leaves = 0
        self.width = sample.shape[1]
        self.root = self._grow(sample, ways, levels)

    def _grow(self, sample: np.ndarray, ways: int, levels: int) -> tuple[bool, int]:
        points = spread(sample, ways) if levels else sample[:0]
        if len(points) < 2:
            self.leaves += 1
            return True, self.leaves - 1
        node = len(self.points)
        self.points.append(points)
        self.below.append([])
        nearest = distances(sample, points).argmin(1)
        self.below[node] = [self._grow(sample[nearest == j], ways, levels - 1) for j in range(len(points))]
        return False, node

    def route(self, vectors: np.ndarray):
        """Leaf of every vector, and for every node met: (node, distances to its points, child chosen, rows)."""
        leaf, met = np.zeros(len(vectors), np.int64), []
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            (is_leaf, number), rows = todo.pop()
            if is_leaf:
                leaf[rows] = number
            elif len(rows):
                far = distances(vectors[rows], self.points[number])
                chosen = far.argmin(1)
                met.append((number, far, chosen, rows))
                todo += [(self.below[number][j], rows[chosen == j]) for j in range(len(self.points[number]))]
        return leaf, met


def spread(sample: np.ndarray, ways: int) -> np.ndarray:
    """Up to ``ways`` different vectors, each as far as possible from those before it; the first is the first of the sample."""
    if not len(sample):
        return sample
    chosen, far = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < ways and far.max() > 0.5:  # different whole-number vectors are 1 apart at least
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


class Ranges:
    """Of every node and child: lowest and highest distance to each split point, lowest and highest length, over all vectors."""

    def __init__(self, tree: Tree):
        self.low = [np.full((len(p), len(p)), np.inf) for p in tree.points]  # [child, split point]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
        self.length = [np.array([[np.inf, -np.inf]] * len(p)) for p in tree.points]

    def add(self, node: int, child: int, point: int, low: float, high: float) -> None:
        """``point`` -1 stands for the length."""
        if point < 0:
            self.length[node][child] = low, high
        else:
            self.low[node][child, point], self.high[node][child, point] = low, high


def surviving(tree: Tree, ranges: Ranges, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[anchor, leaf]: whether the leaf may hold a vector whose score lies in the anchor's window."""
    out = np.zeros((len(anchors), tree.leaves), bool)
    own = (anchors.astype(np.float64) ** 2).sum(1)
    todo = [(tree.root, np.ones(len(anchors), bool))]
    while todo:
        (is_leaf, number), live = todo.pop()
        if is_leaf:
            out[:, number] = live
            continue
        to = distances(anchors, tree.points[number])  # [anchor, point]
        for j, child in enumerate(tree.below[number]):
            shortest, longest = ranges.length[number][j]
            if shortest > longest:
                continue  # no vector at all
            slack = 1e-6 * (1 + longest + np.sqrt(own))
            inner = np.sqrt(np.maximum(0.0, shortest**2 + own - 2 * high)) - slack
            outer = np.sqrt(np.maximum(0.0, longest**2 + own - 2 * low)) + slack
            nearest = np.maximum(to - ranges.high[number][j], ranges.low[number][j] - to).max(1)
            farthest = (to + ranges.high[number][j]).min(1)
            here = live & (nearest <= outer) & (farthest >= inner) & (longest**2 + own - 2 * low >= -slack)
            if here.any():
                todo.append((child, here))
    return out


def first_of_each(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of every owner: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, owner))
    begin = np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < most]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow column of lists with ``width`` whole numbers each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


class Index:
    """All vectors (id, label, v) in blocks by leaf, and the tree with its ranges.

    The sample is what a hash of the id selects, about 1.2 * ``sample`` rows at any size of the table, and of those the first ``sample``.
    """

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, ways: int = WAYS, levels: int = LEVELS, block: int = BLOCK):
        spark = rows.sparkSession
        widths = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"))
        found = widths.orderBy(F.desc("n"), "width").limit(1).collect()
        self.width, total = (found[0]["width"], found[0]["n"]) if found else (0, 0)
        self.rows = rows = rows.filter(F.size("v") == self.width)
        lot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        few = rows.filter(lot < F.lit(min(1 << 30, math.ceil((1 << 30) * 1.2 * sample / max(1, total)))))
        taken = [r["v"] for r in few.orderBy(lot, "id").limit(sample).select("v").collect()]
        self.tree = tree = Tree(np.array(taken, np.int64).reshape(len(taken), self.width), ways, levels)
        self.sent = sent = spark.sparkContext.broadcast(tree)  # at most ``sample`` vectors

        def measured(batches):
            tree, seen, leaves = sent.value, {}, {}
            for batch in batches:
                vectors = _matrix(batch.column(0), tree.width)
                leaf, met = tree.route(vectors)
                for number, n in zip(*np.unique(leaf, return_counts=True)):
                    leaves[int(number)] = leaves.get(int(number), 0) + int(n)
                length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
                for node, far, chosen, at in met:
                    for j in np.unique(chosen):
                        for i, x in enumerate(np.column_stack([length[at], far])[chosen == j].T, -1):
                            low, high = seen.get((node, int(j), i), (np.inf, -np.inf))
                            seen[node, int(j), i] = min(low, float(x.min())), max(high, float(x.max()))
            out = [(*key, *value, 0) for key, value in seen.items()] + [(-1, leaf, 0, 0.0, 0.0, n) for leaf, n in leaves.items()]
            if out:
                kinds = {"node": pa.int32(), "child": pa.int32(), "point": pa.int32(), "low": pa.float64(), "high": pa.float64(), "n": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], names=list(kinds))

        seen = rows.select("v").mapInArrow(measured, "node int, child int, point int, low double, high double, n long")
        seen = seen.groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        ranges, counts = Ranges(tree), np.zeros(tree.leaves, np.int64)
        for r in seen.collect():  # at most nodes * ways * (ways + 1) ranges, and the leaves
            if r["node"] < 0:
                counts[r["child"]] = r["n"]
            else:
                ranges.add(r["node"], r["child"], r["point"], r["low"], r["high"])
        parts = -(-counts // block)
        self.places = spark.sparkContext.broadcast((ranges, np.cumsum(parts) - parts, parts))
        places = self.places

        def make():
            mine = count(7919 * TaskContext.get().partitionId())

            def step(batch: pa.RecordBatch) -> dict:
                leaf, _ = sent.value.route(_matrix(batch.column(2), sent.value.width))
                _, base, parts = places.value
                turn = np.fromiter(mine, np.int64, len(leaf))  # rows of a leaf take turns, so equal rows are dealt over its blocks as well
                return {"block": pa.array(base[leaf] + turn % parts[leaf]), "id": batch.column(0), "label": batch.column(1), "v": batch.column(2)}

            return step

        routed = map_batches(rows.select("id", "label", "v"), make, "block long, id long, label long, v array<long>")
        items = F.collect_list(F.struct("id", "label", "v")).alias("items")  # about ``block`` rows
        self.blocks = held(routed.groupBy("block").agg(items), "blocks")

    def search(self, anchors: DataFrame, same: bool, most: int, own_leaf: bool, shares: tuple[int, int] = (0, 0), group: int = GROUP) -> DataFrame:
        """a, w, id, score, rank: the first ``most`` rows of every window ``w`` of every anchor.

        ``anchors``: a (a key of the row), id, label, v, peaks and floors (array<long>). Window w holds scores from shares[0] to shares[1]
        hundredths of peaks[w], or all if ``same``, and none below floors[w] where there is one. ``same`` takes rows of the anchor's label
        with another id, otherwise those of other labels. ``own_leaf`` searches the anchor's own leaf alone.
        """
        sent, places, width = self.sent, self.places, self.width

        def visits():
            def step(batch: pa.RecordBatch) -> dict:
                tree, (ranges, base, parts) = sent.value, places.value
                v = _matrix(batch.column(3), width)
                windows = [_windows(p, f, same, shares) for p, f in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
                if own_leaf:
                    live = np.zeros((len(v), tree.leaves), bool)
                    live[np.arange(len(v)), tree.route(v)[0]] = True
                else:
                    lowest = np.array([min((lo for lo, _ in w), default=0) for w in windows], np.float64)
                    highest = np.array([max((hi for _, hi in w), default=0) for w in windows], np.float64)
                    live = surviving(tree, ranges, v, lowest, highest)
                live[[not any(lo <= hi for lo, hi in w) for w in windows]] = False
                who, leaf = np.nonzero(live)
                n = parts[leaf]
                block = np.repeat(base[leaf], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who, chunk = np.repeat(who, n), block // CHUNK  # blocks of an anchor ascend
                begin = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (chunk[1:] != chunk[:-1]))) if len(who) else who
                blocks = pa.ListArray.from_arrays(pa.array(np.append(begin, len(who)).astype(np.int32)), pa.array(block.astype(np.int64)))
                who = pa.array(who[begin])
                spans = pa.array([[x for span in w for x in span] for w in windows], pa.list_(pa.int64()))
                taken = {c: batch.column(i).take(who) for i, c in enumerate(("a", "id", "label", "v"))}
                return {"chunk": pa.array(chunk[begin].astype(np.int64)), **taken, "spans": spans.take(who), "blocks": blocks}

            return step

        total = anchors.count()
        met = map_batches(anchors.select("a", "id", "label", "v", "peaks", "floors"), visits,
                          "chunk long, a long, id long, label long, v array<long>, spans array<long>, blocks array<long>")
        lot = F.pmod(F.xxhash64("a"), F.lit(max(1, -(-total // group))))
        who = F.collect_list(F.struct("a", "id", "label", "v", "spans", "blocks")).alias("who")  # about ``group``
        met = met.groupBy("chunk", lot.alias("lot")).agg(who)
        visited = met.withColumn("visited", F.array_distinct(F.flatten("who.blocks")))
        blocks = self.blocks.withColumn("chunk", F.floor(F.col("block") / CHUNK))
        # Files of blocks are far smaller than the blocks: by their size, the driver would be given all of them to broadcast.
        work = visited.hint("merge").join(blocks, "chunk").filter(F.array_contains("visited", F.col("block"))).select("block", "who", "items")

        def scores():
            def step(batch: pa.RecordBatch) -> dict:
                out = []
                for i in range(batch.num_rows):
                    who = batch.column(1)[i].values
                    met = who.field(5)
                    owner = np.repeat(np.arange(len(met)), met.value_lengths().to_numpy())
                    who = who.take(pa.array(owner[met.flatten().to_numpy() == batch.column(0)[i].as_py()]))
                    out += _block_best(who, batch.column(2)[i].values, width, same, most)
                a, w, ids, score = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
                return {"a": pa.array(a), "w": pa.array(w.astype(np.int32)), "id": pa.array(ids), "score": pa.array(score)}

            return step

        found = map_batches(work, scores, "a long, w int, id long, score long")
        rank = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id"))  # each task sends ``most`` rows a window at most
        return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def _windows(peaks: list[int] | None, floors: list[int | None] | None, same: bool, shares: tuple[int, int]) -> list[tuple[int, int]]:
    """Lowest and highest score of each window, in whole numbers."""
    widest = (-(1 << 62), 1 << 62)
    spans = [widest] if same else [(-(-shares[0] * p // 100), shares[1] * p // 100) for p in peaks or []]
    floors = floors or [None] * len(spans)
    return [(lo if f is None else max(lo, f), hi) for (lo, hi), f in zip(spans, floors)]


def _block_best(who: pa.StructArray, items: pa.StructArray, width: int, same: bool, most: int) -> list[tuple]:
    """(a, w, id, score) of the first candidates that a block has for each window of some anchors."""
    a, own, label, spans = (who.field(k) for k in (0, 1, 2, 4))
    a, own, label = (x.to_numpy() for x in (a, own, label))
    ids, labels = items.field(0).to_numpy(), items.field(1).to_numpy()
    score = products(_matrix(who.field(3), width), _matrix(items.field(2), width))
    fits = label[:, None] == labels[None, :]
    fits = fits & (own[:, None] != ids[None, :]) if same else ~fits
    bounds, out = spans.to_pylist(), []
    for w in range(max((len(b) // 2 for b in bounds), default=0)):
        low, high = (np.array([b[2 * w + k] if len(b) > 2 * w else 1 - k for b in bounds], np.int64) for k in (0, 1))
        i, j = np.nonzero(fits & (score >= low[:, None]) & (score <= high[:, None]))
        kept = first_of_each(i, score[i, j], ids[j], most)
        i, j = i[kept], j[kept]
        out.append((a[i], np.full(len(i), w), ids[j], score[i, j]))
    return out


def scaled(vectors: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """id, label, v (floor of ``scale`` times each component). Rows with a null among them or a component that is no finite number go."""
    v = F.col(vector)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & label.isNotNull() & F.coalesce(sound, F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 5, shares: tuple[int, int] = (80, 100), **index) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``id``. Scores are inner products of the scaled vectors; higher ones come first, then smaller ids. An
    anchor's positives are the first rows of its label with another id; for each, the negatives are the first rows of other labels whose
    score lies between shares[0] and shares[1] hundredths of the positive's, and ``rank`` counts them from 1. A positive without such rows
    gives none. Rows without key, label or vector or with a component that is null or not finite take no part, and neither do vectors
    whose length isn't the most frequent one (the shorter of equals). Repeated rows count as often as they stand, as anchors and as
    candidates. Scores have to fit into 64 bits. An empty table gives no rows; other columns are ignored.
    """
    tree = Index(scaled(vectors, key, label, vector, scale), **index)
    none = F.lit(None).cast("array<long>")
    anchors = tree.rows.filter(is_anchor).withColumn("a", F.monotonically_increasing_id())
    anchors = held(anchors.select("a", "id", "label", "v"), "anchors")

    def floored(rows: DataFrame, found: DataFrame, most: int, windows: Column) -> DataFrame:
        """With floors: by window, the score of the last of ``most`` rows found; null where there are fewer."""
        last = found.filter(F.col("rank") == most).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))
        places = F.sequence(F.lit(0), windows - 1)
        floors = F.when(F.col("last").isNotNull(), F.transform(places, lambda w: F.try_element_at("last", w)))
        return rows.drop("floors").join(last, "a", "left").withColumn("floors", floors).drop("last")

    start = anchors.withColumns({"peaks": none, "floors": none})
    near = tree.search(start, True, positives, own_leaf=True)
    close = held(tree.search(floored(start, near, positives, F.lit(1)), True, positives, own_leaf=False), "positives")
    peaks = close.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("peaks"))
    opened = anchors.hint("merge").join(peaks, "a").withColumn("floors", none)  # at most ``positives`` peaks
    near = tree.search(opened, False, negatives, own_leaf=True, shares=shares)
    found = tree.search(floored(opened, near, negatives, F.size("peaks")), False, negatives, own_leaf=False, shares=shares)
    pairs = close.select("a", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = found.select("a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("a", F.col("id").alias("anchor_id"))
    rows = found.join(pairs.hint("merge"), ["a", "w"]).join(named.hint("merge"), "a")
    return rows.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
