"""Grams that lead from pieces of queries to words, and aliases that repeat."""

from pyspark.sql import functions as F

from pricetrail.operators.search import WordIndex, _runs, _size, search_many

DDL = "id string, name string, sku string, barcode string, brand string"


def test_words_behind_a_long_piece_are_few(spark):
    """Codes that share all their short grams: a piece leads to its own words, not to a share of all words."""
    df = spark.range(400).selectExpr("concat('p', id) AS id", "concat('Brand-11-', id + 100000) AS sku").selectExpr(
        "id", "cast(null AS string) AS name", "sku", "cast(null AS string) AS barcode", "cast(null AS string) AS brand")
    index = WordIndex.build(df)
    pieces = index.dictionary.selectExpr("word AS piece", "length(word) AS n")
    size = pieces.select(_size(F.col("piece")).alias("size")).distinct().collect()[0]["size"]
    behind = index.grams([size]).groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    best = pieces.select("piece", F.explode(_runs(F.col("piece"), F.lit(size))).alias("gram")).join(behind, "gram").groupBy("piece").agg(F.min("words").alias("words"))
    assert best.agg(F.max("words")).first()[0] == 1
    queries = df.filter("id < 'p2'").selectExpr("sku AS query_id", "sku AS query")
    got = search_many(index, spark.createDataFrame([], "barcode string, product_id string"), queries).collect()
    assert len(got) == queries.count()


def test_repeated_aliases_and_unknown_products(spark):
    df = spark.createDataFrame([("p1", "Lapte", None, None, None)], DDL)
    aliases = spark.createDataFrame([("777", "p1"), ("777", "p1"), ("777", "gone")], "barcode string, product_id string")
    got = search_many(WordIndex.build(df), aliases, spark.createDataFrame([("q", "777")], "query_id string, query string")).collect()
    assert [tuple(r) for r in got] == [("q", "p1")]
