"""Toxicity: a bidirectional gated recurrent network with attention pooling over characters and words, trained in numpy.

A word's characters pass one such layer; its pooled output stands beside an embedding of the whole word (by hash) and beside what the
word and its beginning are known to say for the label, and passes a second layer over the words of a window. A document is scored by its most toxic window; all windows of all texts are scored, and they
overlap. What the first layer and the input gates of the second make of a word depends on the word alone, so each
task remembers it for the words it has met.

Labels say that a document is toxic, not where. The first training windows of toxic documents are those with words, or beginnings of words,
that speak for the label; then the network picks the worst window of every sampled document itself, and is trained again with
these. One sampled document in VALIDATE is never trained on: on these, a logistic curve is fitted that maps the worst window's output to a
probability.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetrail.llm.decontamination import words
from pricetrail.llm.gated import Adam, new_layer, pool, pool_back, scatter, sigmoid, states
from pricetrail.llm.rows import fold, keep_rows, map_batches, utf8
from pricetrail.session import cut_lineage

#: Words of a window, and words from one window's start to the next one's.
WINDOW, STRIDE = 32, 24
#: Bytes of a word that are read as one; longer words are read as several.
PIECE = 24
#: Labelled documents that the network learns from, at most, without and with the toxic label, chosen by a hash of their id.
SAMPLE = (4000, 1500)
#: Windows of a sampled document that reach the driver in each round, at most.
PER_DOCUMENT = 2
#: Words whose gates a task remembers.
MEMO = 150_000
#: Windows, or words, that pass a layer together.
BLOCK = 2048
CHARS, CHAR_WIDTH, CHAR_HIDDEN = 512, 8, 8
BUCKETS, WORD_WIDTH, HIDDEN = 1 << 14, 8, 12
SEED, BATCH, VALIDATE = 9, 64, 5
#: Batches and learning rate of each round; after a round the network picks more windows.
ROUNDS = ((160, 0.01), (100, 0.006), (80, 0.004))


def pieces(text: bytes | None) -> list[bytes]:
    """Words of a text (A-Z lower-cased), those of more than PIECE bytes cut."""
    ws = words(text)
    if ws and max(map(len, ws)) > PIECE:
        ws = [w[i : i + PIECE] for w in ws for i in range(0, len(w), PIECE)]
    return ws


def windows(n: int) -> list[int]:
    """Starts of the windows over n words; the last one ends with the text."""
    return [*range(0, max(1, n - WINDOW + STRIDE), STRIDE)] if n else []


class Network:
    def __init__(self, seed: int = SEED, evidence: dict[bytes, float] | None = None):
        rng = np.random.default_rng(seed)
        self.evidence = evidence or {}
        wide = 2 * CHAR_HIDDEN + WORD_WIDTH + 2
        self.p = new_layer(rng, CHAR_WIDTH, CHAR_HIDDEN, "char") | new_layer(rng, wide, HIDDEN, "word")
        self.p |= {"chars": 0.3 * rng.standard_normal((CHARS, CHAR_WIDTH)).astype(np.float32),
                   "words": np.zeros((BUCKETS, WORD_WIDTH), np.float32),  # a word never met says nothing of itself
                   "w": (rng.standard_normal(2 * HIDDEN) / 5).astype(np.float32), "b": np.zeros(1, np.float32)}
        self.curve = (1.0, 0.0)  # slope and offset of the final logistic curve
        self._fresh()

    def _fresh(self) -> None:
        self.place: dict[bytes, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def __getstate__(self):
        return {"p": self.p, "curve": self.curve, "evidence": self.evidence}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fresh()

    # inputs

    def spell(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Characters (steps, words) as numbers below CHARS, and their mask."""
        texts = [w.decode("utf-8", "replace") for w in ws]  # a cut may go through a character
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4") % CHARS
        mask = np.arange(sizes.max())[:, None] < sizes[None, :]
        out = np.zeros(mask.shape, np.int64)
        out.T[mask.T] = flat
        return out, mask.astype(np.float32)

    def buckets(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, ws), np.int64, len(ws)) % BUCKETS

    def known(self, ws: list[bytes]) -> np.ndarray:
        """What each word, and its beginning, says for the label."""
        found = [(self.evidence.get(w, 0.0), self.evidence.get(w[:4] + b"*", 0.0)) for w in ws]
        return np.array(found, np.float32) / 2

    # training

    def learn(self, samples: list[list[bytes]], labels: np.ndarray, steps: int, rng: np.random.Generator, rate: float = 0.01) -> None:
        """A third of each batch is toxic windows."""
        both, adam = [np.flatnonzero(labels == y) for y in (0, 1)], Adam(self.p, rate)
        for k in range(steps):
            adam.rate = rate * (1 - 0.9 * k / steps)
            chosen = np.concatenate([rng.choice(c, n) for c, n in zip(both, (BATCH - BATCH // 3, BATCH // 3))])
            adam.update(self.gradient([samples[i] for i in chosen], labels[chosen], rng))

    def gradient(self, batch: list[list[bytes]], y: np.ndarray, rng: np.random.Generator | None = None) -> dict:
        """Gradients of the mean logistic loss. With ``rng``, a third of the whole-word embeddings are blanked."""
        p = self.p
        unique = {w: i for i, w in enumerate(dict.fromkeys(w for ws in batch for w in ws))}
        steps = max(map(len, batch))
        mask = np.array([[t < len(ws) for ws in batch] for t in range(steps)], np.float32)
        at = np.array([[unique[ws[t]] if t < len(ws) else 0 for ws in batch] for t in range(steps)])
        spelled, char_mask = self.spell(list(unique))
        bucket = self.buckets(list(unique))
        chars, char_cache = pool(p, "char", p["chars"][spelled], char_mask)
        shown = np.ones((len(unique), 1), np.float32) if rng is None else (rng.random((len(unique), 1)) > 1 / 3).astype(np.float32)
        inputs = np.concatenate([chars, p["words"][bucket] * shown, self.known(list(unique))], axis=1)
        pooled, cache = pool(p, "word", inputs[at], mask)
        out = pooled @ p["w"] + p["b"]
        self.loss = float(np.mean(np.logaddexp(0, out) - y * out))
        d = ((sigmoid(out) - y) / len(batch)).astype(np.float32)
        grads = {"w": pooled.T @ d, "b": d.sum(keepdims=True)}
        dx, more = pool_back(p, "word", d[:, None] * p["w"], cache)
        real = mask > 0
        dinputs = scatter(at[real], dx[real], len(unique))
        wide = 2 * CHAR_HIDDEN
        dchars, rest = pool_back(p, "char", dinputs[:, :wide], char_cache)
        real = char_mask > 0
        return grads | more | rest | {"chars": scatter(spelled[real], dchars[real], CHARS), "words": scatter(bucket, dinputs[:, wide : wide + WORD_WIDTH] * shown, BUCKETS)}

    # scoring

    def _meet(self, ws: list[bytes]) -> None:
        """Work out the gate inputs of unseen words, of like length together."""
        p, start = self.p, len(self.place)
        if start + len(ws) + 1 > len(self.gates):
            grown = np.zeros((max(2 * len(self.gates), start + len(ws) + 1), 6 * HIDDEN), np.float32)
            grown[: len(self.gates)] = self.gates
            self.gates = grown
        ws = sorted(ws, key=len)
        W, b = np.concatenate([p["word.Wf"], p["word.Wb"]], axis=1), np.concatenate([p["word.bf"], p["word.bb"]])
        tables = [np.concatenate([np.zeros((1, 3 * CHAR_HIDDEN)), p["chars"] @ p[f"char.W{d}"] + p[f"char.b{d}"]]).astype(np.float32) for d in "fb"]
        for k in range(0, len(ws), BLOCK):
            part = ws[k : k + BLOCK]
            spelled, mask = self.spell(part)
            spelled = np.where(mask > 0, spelled + 1, 0)
            h = np.concatenate([states(t, p[f"char.U{d}"], spelled, d == "b") for t, d in zip(tables, "fb")], axis=2)
            e = np.where(mask > 0, h @ p["char.v"], np.float32(-1e9))
            a = np.exp(e - e.max(axis=0))
            chars = np.einsum("tn,tnh->nh", a / a.sum(axis=0), h)
            at = 1 + start + k  # row 0 stands for no word
            self.gates[at : at + len(part)] = np.concatenate([chars, p["words"][self.buckets(part)], self.known(part)], axis=1) @ W + b
        self.place.update(zip(ws, range(1 + start, 1 + start + len(ws))))

    def _outputs(self, at: np.ndarray) -> np.ndarray:
        """Outputs of windows given as columns of gate numbers, 0 after the end."""
        p, looks = self.p, 0
        for d, first in (("f", 0), ("b", 1)):
            part = slice(first * HIDDEN, (first + 1) * HIDDEN)
            look = np.stack([p["word.v"][part], p["w"][part]], axis=1)
            looks = looks + states(self.gates[:, 3 * first * HIDDEN : 3 * (first + 1) * HIDDEN], p[f"word.U{d}"], at, d == "b", look)
        e = np.where(at > 0, looks[:, :, 0], np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        return (a * looks[:, :, 1]).sum(axis=0) / a.sum(axis=0) + p["b"][0]

    def worst(self, texts: list[bytes | None], many: int = 1) -> list[list[tuple[float, list[bytes]]]]:
        """The ``many`` highest outputs of each text's windows with the windows' words; nothing for a text without words."""
        split = list(map(pieces, texts))
        met = set(chain.from_iterable(split))
        unseen = [w for w in met if w not in self.place]
        if len(self.place) + len(unseen) > MEMO:
            self._fresh()
            unseen = list(met)
        if unseen:
            with np.errstate(over="ignore"):
                self._meet(unseen)
        starts = list(map(windows, map(len, split)))
        flat = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
        base = np.cumsum([0, *map(len, split)])
        first = np.concatenate([np.array(s, np.int64) + b for s, b in zip(starts, base)] or [np.zeros(0, np.int64)])
        end = np.repeat(base[1:], list(map(len, starts)))
        out = np.empty(len(first), np.float32)
        for k in range(0, len(first), BLOCK):
            at = first[None, k : k + BLOCK] + np.arange(WINDOW)[:, None]
            inside = at < end[None, k : k + BLOCK]
            with np.errstate(over="ignore"):
                out[k : k + BLOCK] = self._outputs(np.where(inside, flat[np.minimum(at, len(flat) - 1)], 0))
        found, k = [], 0
        for ws, s in zip(split, starts):
            part = out[k : k + len(s)]
            k += len(s)
            best = [int(part.argmax())] if many == 1 and len(s) else np.argsort(-part, kind="stable")[:many].tolist()
            found.append([(float(part[i]), ws[s[i] : s[i] + WINDOW]) for i in best])
        return found

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability by text; 0 for a text without words."""
        slope, offset = self.curve
        return np.array([float(sigmoid(np.float64(slope * f[0][0] + offset))) if f else 0.0 for f in self.worst(texts)])


class Constant:
    """Stands in for the network where the labels name fewer than two classes: the share of toxic documents, 0 without labels."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list) -> np.ndarray:
        return np.full(len(texts), self.share)


def odds(bad: float, good: float, all_bad: int, all_good: int) -> float:
    """Log-odds of a mark that ``bad`` toxic and ``good`` other documents have, less two standard errors, and 0 below that: what can be
    relied on even if the documents counted are those that are learned from."""
    bad, good = bad + 0.5, good + 0.5
    return max(0.0, math.log(bad / all_bad) - math.log(good / all_good) - 2 * math.sqrt(1 / bad + 1 / good))


def _evidence(sample: DataFrame) -> dict[bytes, float]:
    """odds() of words and of their first four bytes, counted by document over the sample; the 20 000 that say most."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [{*ws, *(w[:4] + b"*" for w in ws)} for ws in map(pieces, utf8(batch.column(1)))]
            marks = batch.column(2).to_pylist()
            return {"mark": pa.array([m for f in found for m in f], pa.binary()),
                    "toxic": pa.array([y for f, y in zip(found, marks) for _ in f], pa.int32())}

        return step

    total = sample.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        return {}
    counts = map_batches(sample, make, "mark binary, toxic int").groupBy("mark").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    rows = counts.filter("bad > 2").withColumn("rate", (F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5))
    rows = rows.orderBy(F.desc("rate"), F.desc("bad"), "mark").limit(20_000).collect()
    found = {bytes(r.mark): odds(r.bad, r.n - r.bad, total.bad + 1, total.n - total.bad + 1) for r in rows}
    return {m: o for m, o in found.items() if o}


def _first_windows(sample: DataFrame, evidence: dict[bytes, float]) -> list[tuple[int, list[bytes]]]:
    """Windows to begin with: of toxic documents those with most evidence, of others any two, chosen by hash."""
    shared = sample.sparkSession.sparkContext.broadcast(evidence)

    def make():
        known = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            labels, out = [], []
            for text, y in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                ws = pieces(text)
                weight = [max(known.get(w, 0), known.get(w[:4] + b"*", 0)) for w in ws]
                ranked = []
                for s in windows(len(ws)):
                    part = ws[s : s + WINDOW]
                    ranked.append((sum(weight[s : s + WINDOW]) if y else zlib.crc32(b" ".join(part)), s))
                for value, s in sorted(ranked, reverse=True)[:PER_DOCUMENT]:
                    if not y or value > 0 or len(ranked) == 1:
                        labels.append(y)
                        out.append(ws[s : s + WINDOW])
            return {"y": pa.array(labels, pa.int32()), "ws": pa.array(out, pa.list_(pa.binary()))}

        return step

    return sorted((r.y, list(map(bytes, r.ws))) for r in map_batches(sample, make, "y int, ws array<binary>").collect())


def _worst_windows(sample: DataFrame, network: Network) -> list[tuple[int, float, int, list[bytes]]]:
    """(toxic, output, place, words) of the worst windows of every sampled document, place 0 the worst."""
    shared = sample.sparkSession.sparkContext.broadcast(network)

    def make():
        net = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            found = net.worst(utf8(batch.column(1)), PER_DOCUMENT)
            rows = [(y, o, k, ws) for f, y in zip(found, batch.column(2).to_pylist()) for k, (o, ws) in enumerate(f)]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.binary()))
            return {n: pa.array(c, t) for n, c, t in zip(("y", "output", "place", "ws"), columns, kinds)}

        return step

    rows = map_batches(sample, make, "y int, output double, place int, ws array<binary>").collect()
    return sorted((r.y, r.output, r.place, list(map(bytes, r.ws))) for r in rows)


def _curve(outputs: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of least loss, by ever finer search; a slight pull keeps the slope near 1."""
    best, size = (1.0, 0.0), 4.0
    loss = lambda at: (weight * (np.logaddexp(0, at[0] * outputs + at[1]) - y * (at[0] * outputs + at[1]))).sum() + 0.01 * math.log(at[0]) ** 2
    for _ in range(60):
        tries = [best] + [(best[0] * math.exp(i * size / 4), best[1] + j * size) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        found = min(tries, key=loss)
        if found == best:
            size /= 2
        best = found
    return best


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, rounds: tuple = ROUNDS) -> Network | Constant:
    """A network from labelled documents outside the held-out fold. At most ``sample`` documents of the classes take part, whole;
    windows of them reach the driver, PER_DOCUMENT of each in a round. A document with several labels is toxic if one says so."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int"))
    known = known.filter(fold(F.col("id")) != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    classes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return Constant(float(max(classes, default=0)))
    share = classes[1] / sum(classes.values())
    ids = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in enumerate(sample)]
    ids = ids[0].unionByName(ids[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = cut_lineage(rows.join(F.broadcast(ids), "id").select("id", "text", "toxic"))  # at most sum(sample) ids
    kept, rows = (rows.filter(f"pmod(xxhash64(id, 1), {VALIDATE}) {sign} 0") for sign in ("=", "<>"))
    network, rng = Network(evidence=_evidence(rows)), np.random.default_rng(SEED)
    chosen, worst = _first_windows(rows, network.evidence), []
    for steps, rate in rounds:
        chosen += [(label, ws) for label, _, place, ws in worst if not label or place == 0]
        y = np.array([c[0] for c in chosen])
        if len(set(y.tolist())) < 2:
            return Constant(share)
        network.learn([c[1] for c in chosen], y, steps, rng, rate)
        worst = _worst_windows(rows, network)
    tops = [(label, out) for label, out, place, _ in _worst_windows(kept, network) or worst if place == 0]
    y, outputs = np.array([t[0] for t in tops]), np.array([t[1] for t in tops])
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    network.curve = _curve(outputs, y, weight)
    return network


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Texts without words, null ones included, score 0. A row without doc_id is scored like any other and counts as not held out.
    Repeated rows score alike; other columns are never read. Without labels of both classes the score is the share of toxic ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def make():
        network = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column(0), "score": pa.array(network.scores(utf8(batch.column(1))))}

        return step

    rows = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(train(docs, labels)), docs.columns.index("text")
    return keep_rows(docs, lambda: lambda batch: pa.array(shared.value.scores(utf8(batch.column(at))) < 0.5))

