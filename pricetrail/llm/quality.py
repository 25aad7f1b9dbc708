"""Quality rules: counted features of a text, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Two multinomials over hashed n-grams are estimated: one from trusted documents, one from all documents. A document's score is the
mean over its n-grams of log p(trusted) - log p(raw); documents below a fixed threshold are dropped. The n-grams are whole words,
the last two characters of words and, where asked for, neighbouring words. Weights are whole numbers (millionths), so sums do not depend on their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that n-grams are hashed into. The weights of all buckets travel with the plan, some 100 KB whatever the data.
BUCKETS = 1 << 14
#: Trusted documents (labels.quality = 1) that the target multinomial is fitted on, at most, chosen by a hash of their id.
TRUSTED = 20_000
#: A document stays if its mean log-likelihood ratio is at least this: -1 says that an n-gram of the document is, on average,
#: e times as likely in the raw corpus as in trusted text.
THRESHOLD = -1.0
UNIT = 1_000_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than space and 09-0D. Null has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _SPACE), "")


def ngrams(ws: Column, pairs: bool = False) -> Column:
    """Bucket numbers of the n-grams of a word list: every word, the last two characters of every word and, with ``pairs``, every two neighbouring words."""
    whole = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    ends = F.transform(ws, lambda w: F.pmod(F.xxhash64(F.right(w, F.lit(2)), F.lit(2)), F.lit(BUCKETS)).cast("int"))
    if not pairs:
        return F.concat(whole, ends)
    first = F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0)))
    beside = F.transform(first, lambda w, i: F.pmod(F.xxhash64(w, F.get(ws, i + 1), F.lit(3)), F.lit(BUCKETS)).cast("int"))
    return F.concat(whole, ends, beside)


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(ws: Column) -> Column:
    """Words that lie in 3-word windows which the list holds twice or more.

    Windows are compared by a 64-bit hash. Where all differ, nothing more is done. Otherwise windows are sorted by hash and place,
    and the places that share a hash with a neighbour are walked in order to count the words they cover.
    """
    places = F.sequence(F.lit(0), F.size(ws) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def shared(s: Column) -> Column:
        beside = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))  # noqa: E731  get() is null outside the list
        kept = F.filter(s, lambda e, k: beside(e, k - 1) | beside(e, k + 1))
        return F.array_sort(F.transform(kept, lambda e: e["i"]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        count = F.aggregate(
            _let(pairs, shared), F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
            lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["reach"])).alias("n"), (i + 3).alias("reach")),
            lambda s: s["n"])
        return F.when(F.size(F.array_distinct(h)) < F.size(h), count).otherwise(0)

    return F.when(F.size(ws) > 3, _let(hashes, covered)).otherwise(0).cast("long")


def weights(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, pairs: bool = False) -> list[int]:
    """Millionths of log p(trusted) - log p(raw) by bucket.

    Counts are taken over every n-gram of every document; each task adds up its own rows first, so at most BUCKETS rows per task are
    shuffled and BUCKETS rows reach the driver. Both multinomials are smoothed: raw counts by one per bucket, trusted counts by
    BUCKETS n-grams dealt out as in the raw corpus. Without trusted documents all weights are zero.
    """
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(trusted).withColumn("good", F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.explode(_let(words(F.col("text")), lambda ws: ngrams(ws, pairs))).alias("bucket"))
    rows = rows.join(F.broadcast(ids), "id", "left")  # at most ``trusted`` ids
    counted = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")).collect()
    raw, good = [1] * BUCKETS, [0] * BUCKETS
    for r in counted:
        raw[r.bucket] += r.raw
        good[r.bucket] += r.good
    all_raw, all_good = sum(raw), sum(good) + BUCKETS
    share = [r / all_raw for r in raw]
    return [round(UNIT * (math.log((g + BUCKETS * s) / all_good) - math.log(s))) for g, s in zip(good, share)]


def features(text: Column, ws: Column) -> dict[str, Column]:
    """The counted features. Lines are cut at \\n; a line counts as repeated if it has a word and equals an earlier line."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(ws),
    }


def _score(ws: Column, weight: list[int], pairs: bool) -> Column:
    table = F.split(F.lit(",".join(map(str, weight))), ",").cast("array<int>")
    total = F.aggregate(ngrams(ws, pairs), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    many = 3 * F.size(ws) - 1 if pairs else 2 * F.size(ws)
    return F.when(F.size(ws) > 0, total / F.lit(float(UNIT)) / many).otherwise(0.0)


def _judged(text: Column, weight: list[int], threshold: float, pairs: bool) -> Column:
    """Features, score and verdicts as a struct. The word list is bound inside the expression: were it a column of its own, a filter on the
    verdict would be pushed below it and work it out anew for every word."""

    def measured(ws: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in features(text, ws).items()], _score(ws, weight, pairs).alias("score"))

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(*[m[n].alias(n) for n in (*FEATURES, "score")], failed.alias("base_failed"), (~failed & (m["score"] >= threshold)).alias("kept"))

    return _let(_let(words(text), measured), verdict)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, pairs: bool = False) -> DataFrame:
    """doc_id, the counted features, base_failed, score and kept for every row of ``docs``.

    A document fails the base rules with fewer than 50 words, or with over half of its words in repeated windows; null and
    blank texts have no words and fail. It is kept if it passes them and its score is at least ``threshold``. Repeated rows count as
    often as they stand; other columns are ignored; empty tables give no rows, and empty labels keep all that passes the base rules.
    With ``pairs`` the n-grams include neighbouring words, so that the order of words counts.
    """
    verdict = _judged(F.col("text"), weights(docs, labels, pairs=pairs), threshold, pairs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), verdict.alias("found")).select("doc_id", "found.*")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, pairs: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, all columns."""
    return docs.filter(_judged(F.col("text"), weights(docs, labels, pairs=pairs), threshold, pairs)["kept"])
