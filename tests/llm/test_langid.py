"""Codewords, counts and predictions of language identification."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pricetrail.llm import langid
from pricetrail.llm.langid import codewords, counts, features, identified
from pricetrail.llm.queries import QUERIES


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 60])
def test_codewords(n):
    code = codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    assert all(abs(c.sum()) < n for c in code.T)
    assert len({tuple(r) for r in code}) == n
    if n in (3, 4, 5):
        assert code.shape[1] == 2 ** (n - 1) - 1 and min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) == 2 ** (n - 2)


def plain_counts(text):
    """Grams written out, then hashed one by one."""
    out, before = Counter(), [32] * 3
    squeezed = []
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or (squeezed[-1:] or [" "])[-1] != " ":
            squeezed.append(c)
    codes = before + list(map(ord, squeezed))
    for i in range(3, len(codes)):
        h = 0
        for k, m in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
            h = (h + codes[i - k] * m) % 2**32
            out[(((h ^ h >> 15) * 0x2C1B3C6D) >> 9) % langid.WIDTH] += 1
    return out


ODD = [None, "", " \n", "123 !? 456", "a", "É", "Ünï cödé, 1 2 three!", "日本語テキスト", "x" * 5000, "😀 smile", "İI ß"]


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_counts(monkeypatch, step):
    monkeypatch.setattr(langid, "STEP", step)
    for text in ODD + ["some words, and MORE of them; " * 9]:
        found = counts(text)
        if not any(c.isalpha() for c in text or ""):
            assert found is None and features(text) is None
        else:
            assert {i: n for i, n in enumerate(found.tolist()) if n} == plain_counts(text)


def made(spark, n=300):
    pick = random.Random(7)
    parts = {"aa": "ka lo mi re sun tar".split(), "bb": "zhe vro plyu gda shch".split(), "cc": "nguy oeu ieng thuoc phua".split()}
    rows = []
    for i in range(n):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(pick.choice(parts[lang]) for _ in range(pick.randint(1, 3))) for _ in range(pick.randint(4, 60))), lang, 0.5))
    return rows


def test_predictions(spark):
    rows = made(spark)
    odd = [(1000 + i, t, "aa" if i < 4 else None, 0.1) for i, t in enumerate(ODD)] + [(None, "kalomi resun", "bb", 0.0), (3, rows[3][1], "aa", 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    got = identified(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    for i, text in enumerate(ODD):
        r, letter = by_id[1000 + i], any(c.isalpha() for c in text or "")
        assert (r.lang_pred != "und") == letter and (r.score > 0) == letter and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert np.mean([by_id[r.doc_id].lang_pred == rows[r.doc_id][2] for r in held]) > 0.95


def test_first_ids_are_those_of_a_whole_ranking(spark):
    """The bounded ranking takes the same rows as a window over all of them; repeated rows take places, and small shares grow."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from pricetrail.llm.langid import _first_ids

    rows = [(i, "aa") for i in range(3000)] + [(i % 7, "bb") for i in range(2000)] + [(i, "cc") for i in range(3)] + [(9, "dd")] * 500
    known = spark.createDataFrame(rows, "doc_id long, lang string")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    for each in (1, 20, 500):
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
        want = known.withColumn("place", place).filter(F.col("place") <= each).select("doc_id", "lang").distinct()
        assert sorted(map(tuple, _first_ids(known, sizes, each).collect())) == sorted(map(tuple, want.collect()))


def test_few_languages(spark):
    docs = spark.createDataFrame(made(spark, 40), "doc_id long, text string, lang string, score double")
    assert {(r.lang_pred, r.score) for r in identified(docs.filter("lang = 'aa'")).collect()} == {("aa", 1.0)}
    none = docs.withColumn("lang", docs.lang.substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert {(r.lang_pred, r.score) for r in identified(none).collect()} == {("und", 0.0)}
    assert identified(docs.limit(0)).collect() == []


def test_registered_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = QUERIES["op10_language_id"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.95
