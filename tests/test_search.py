"""A batch of searches against the scan, query by query."""

import random

from pricetrail.operators.products import search
from pricetrail.operators.search import WordIndex, search_many

NAMES = ["Lapte Zuzu 1.5%", "lapte de capră", "Brânză  topită", "Ciocolată cu lapte", "100% suc_de mere", "a", "", None, "Măr", "mere-verzi a\\b",
         "日本茶", "x" * 300 + " lapte", "Zuzu\tIaurt"]
DDL = "id string, name string, sku string, barcode string, brand string"


def catalog(spark):
    rows = [(f"p{k}", n, f"S-{k}" if k % 3 else None, f"00{k}" if k % 2 else "", ("Zuzu", None, "De la noi")[k % 3]) for k, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, DDL), spark.createDataFrame([("777", "p1"), ("777", "p2"), ("S-4", "p9"), ("888", "gone")], "barcode string, product_id string")


def by_scan(df, aliases, texts):
    return {(t, r["id"]) for t in texts if t and t.strip() for r in search(df, aliases, t).select("id").collect()}


def test_equals_the_scan(spark, tmp_path):
    df, aliases = catalog(spark)
    pick = random.Random(3)
    pool = [n for n in NAMES if n]
    texts = ["l", "la", "LAPTE zu", "zu la", "apte", "%", "_", "\\", "a\\b", "brânză", "branza topita", "777", "S-4", "s-4", "001", "  Mere  ", "nothing here", "a a", "888",
             "日", "x" * 200, "zuzu iaurt", " ", "", None, "1.5", "15", "de", "c c"]
    for _ in range(25):
        name = pick.choice(pool)
        at = pick.randrange(len(name))
        texts.append(name[at : at + pick.randint(1, 8)])
    queries = spark.createDataFrame([(t, t) for t in texts], "query_id string, query string")
    WordIndex.build(df).write(f"{tmp_path}/words")
    got = [tuple(r) for r in search_many(WordIndex.read(spark, f"{tmp_path}/words"), aliases, queries).collect()]
    assert len(got) == len(set(got)) and set(got) == by_scan(df, aliases, dict.fromkeys(texts))


def test_empty_tables(spark):
    df, aliases = catalog(spark)
    queries = spark.createDataFrame([("q", "lapte")], "query_id string, query string")
    assert search_many(WordIndex.build(df.limit(0)), aliases, queries).collect() == []
    assert search_many(WordIndex.build(df), aliases.limit(0), queries.limit(0)).collect() == []
    assert {r["id"] for r in search_many(WordIndex.build(df), aliases.limit(0), queries).collect()} == {"p0", "p1", "p3", "p11"}
