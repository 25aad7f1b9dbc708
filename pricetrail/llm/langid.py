"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit, one logistic classifier over hashed character n-grams tells the languages whose
bit is set from the others. A text gets the language whose codeword has the smallest loss, summed over the bits with a weight for
how well each bit's classifier can be trusted; a text whose best two codewords are nearly as close is flagged as ambiguous.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.llm.gated import sigmoid
from pricetrail.llm.rows import fold, map_batches
from pricetrail.session import cut_lineage

#: Hashed counts of n-grams of one to ORDERS characters.
WIDTH, ORDERS = 4096, 3
#: Labelled documents that the classifiers learn from, at most: in all, and of one language. Chosen by a hash of their id.
SAMPLE, PER_LANGUAGE = 2000, 500
#: Up to so many languages the code holds every split of them; beyond, CODE_BITS splits are drawn, the best of TRIALS draws.
EXHAUSTIVE, CODE_BITS, TRIALS = 5, 31, 200
#: A text is ambiguous if its language is less likely than this.
SURE = 0.75
#: Characters counted at a time.
STEP = 1 << 20
#: Odd multipliers of the rolling n-gram hash, one per order.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


@functools.cache
def letters() -> np.ndarray:
    """1 for every code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, lower-cased; runs of other characters than letters count as one space. None without a letter."""
    out, before = np.zeros(WIDTH, np.int64), np.full(ORDERS, 32, np.uint64)
    some = False
    for at in range(0, len(text or ""), STEP):
        codes = np.frombuffer(text[at : at + STEP].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters()[codes]
        some = some or bool(is_letter.any())
        codes = np.where(is_letter, codes, 32).astype(np.uint64)
        space = codes == 32
        after = np.concatenate([[before[-1] == 32], space[:-1]])
        codes = np.concatenate([before, codes[~(space & after)]])
        hashed = np.zeros(len(codes) - ORDERS, np.uint64)
        for k in range(ORDERS):
            hashed = (hashed + codes[ORDERS - k : len(codes) - k] * np.uint64(_MULTIPLIERS[k])) & np.uint64(0xFFFFFFFF)
            mixed = (hashed ^ (hashed >> np.uint64(15))) * np.uint64(0x2C1B3C6D)
            out += np.bincount(((mixed >> np.uint64(9)) & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH)
        before = codes[-ORDERS:]
    return out if some else None


def features(text: str | None) -> np.ndarray | None:
    found = counts(text)
    if found is None:
        return None
    found = np.sqrt(found, dtype=np.float32)
    return found / np.linalg.norm(found)


def codewords(languages: int, seed: int = 10) -> np.ndarray:
    """Rows of +1 and -1, one per language; no column is constant."""
    if languages <= EXHAUSTIVE:
        others = range(1, languages)
        splits = [s for n in range(1, languages) for s in combinations(others, n)]
        return np.array([[1 if i in s else -1 for s in splits] for i in range(languages)], np.float32).reshape(languages, len(splits))
    rng, best, apart = np.random.default_rng(seed), None, -1.0
    for _ in range(TRIALS):
        code = rng.choice([-1, 1], (languages, CODE_BITS)).astype(np.float32)
        while (flat := np.abs(code.sum(axis=0)) == languages).any():
            code[:, flat] = rng.choice([-1, 1], (languages, int(flat.sum())))
        near = (CODE_BITS - (code @ code.T - 2 * CODE_BITS * np.eye(languages)).max()) / 2
        if near > apart:
            best, apart = code, near
    return best


class Codes:
    """Classifiers of all bits, and the codewords they are compared with."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.3):
        self.languages, self.code = languages, codewords(len(languages))
        bits = self.code[y]
        self.w, self.b = np.zeros((WIDTH, bits.shape[1]), np.float32), np.zeros(bits.shape[1], np.float32)
        self.trust = np.ones(bits.shape[1], np.float32)
        if not bits.shape[1]:
            return
        even = 1 / np.bincount(y, minlength=len(languages))[y]
        even = (even / even.sum()).astype(np.float32)[:, None]  # every language weighs the same
        m, s = [np.zeros_like(v) for v in (self.w, self.b)], [np.zeros_like(v) for v in (self.w, self.b)]
        for t in range(1, rounds + 1):
            slope = -bits * sigmoid(-bits * (x @ self.w + self.b)) * even
            for k, (v, g) in enumerate(((self.w, x.T @ slope + 1e-6 * self.w), (self.b, slope.sum(axis=0)))):
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                v -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
        right = ((x @ self.w + self.b) * bits > 0).T @ even[:, 0]
        self.trust = np.clip(2 * right - 1, 0.01, 1).astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likelihood of every language (rows of x, languages)."""
        f = x @ self.w + self.b
        loss = np.stack([(np.logaddexp(0, -f * row) * self.trust).sum(axis=1) for row in self.code], axis=1)
        like = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return like / like.sum(axis=1, keepdims=True)


def _first_ids(known: DataFrame, sizes: dict[str, int], each: int) -> DataFrame:
    """(doc_id, lang) of the first ``each`` rows of every language, by a hash of the id.

    Only ids whose hash lies in about twice the share that is wanted are ranked, so a language of any size sends few rows to the task that
    ranks it. Where too few lie there, the share grows until they do, or is the whole.
    """
    spark, share, done = known.sparkSession, {lang: 2 * each / n for lang, n in sizes.items()}, None
    rank = F.xxhash64("doc_id")
    while share:
        edges = [(lang, min(2**63 - 1, int(-(2**63) + s * 2**64))) for lang, s in share.items()]
        limits = spark.createDataFrame(edges, "lang string, edge long")
        near = known.join(F.broadcast(limits), "lang").filter(rank <= F.col("edge")).groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        near = cut_lineage(near)
        held = {r.lang: r.n for r in near.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        short = [lang for lang, s in share.items() if s < 1 and held.get(lang, 0) < min(each, sizes[lang])]
        near = near.filter(~F.col("lang").isin(short)) if short else near
        done, share = near if done is None else done.unionByName(near), {lang: 8 * share[lang] for lang in short}
    before = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("_before") < each).select("doc_id", "lang")


def train(docs: DataFrame) -> Codes | None:
    """Codes from documents with a language and an id outside the held-out fold; None if no such text has a letter."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").filter(fold(F.col("doc_id")) != 0)
    found = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()
    if not found:
        return None
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(found)))
    ids = _first_ids(known.select("doc_id", "lang"), {r.lang: r.n for r in found}, each)
    rows = known.join(F.broadcast(ids), ["doc_id", "lang"])  # at most SAMPLE ids

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            kept = [(lang, x.tobytes()) for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (x := features(t)) is not None]
            return {"lang": pa.array([k[0] for k in kept], pa.string()), "x": pa.array([k[1] for k in kept], pa.binary())}

        return step

    sample = sorted((r.lang, bytes(r.x)) for r in map_batches(rows.select("text", "lang"), make, "lang string, x binary").collect())
    if not sample:
        return None
    languages = sorted({s[0] for s in sample})
    y = np.array([languages.index(s[0]) for s in sample])
    return Codes(languages, np.stack([np.frombuffer(s[1], np.float32) for s in sample]), y)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of ``docs``.

    score is the likelihood of the predicted language among the learned ones; ambiguous says that it is below SURE. Null texts and texts
    without a letter are ``und`` with score 0 and not ambiguous; so is every text where no language could be learned. With a single
    learned language, every text with a letter is of that language. A row without doc_id counts as not held out; repeated rows are
    predicted alike; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def make():
        codes = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            found = [features(t) if codes else None for t in batch.column(1).to_pylist()]
            lang, score, unsure = ["und"] * len(found), np.zeros(len(found)), np.zeros(len(found), bool)
            at = [i for i, x in enumerate(found) if x is not None]
            if at:
                like = codes.predict(np.stack([found[i] for i in at]))
                for i, row in zip(at, like):
                    lang[i], score[i] = codes.languages[int(row.argmax())], row.max()
                    unsure[i] = row.max() < SURE
            return {"doc_id": batch.column(0), "lang_pred": lang, "score": score, "ambiguous": unsure}

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = map_batches(rows, make, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
