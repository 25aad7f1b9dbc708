"""Many searches at once over an index of the catalog's words.

``products.search`` answers one query by a scan. A batch of queries meets the catalog by equality instead: every text is cut into words at white
space; a dictionary holds each different word once, with the number of products that have it; the grams of the dictionary's words lead from a piece of a
query to the words that contain it, and postings lead from words to products. Of each query only the piece with the fewest postings is
followed, and the candidates are put to the very test of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetrail.functions.text import contains_literal, fold, search_text, strip
from pricetrail.session import stored

#: Lengths of grams. A piece of a query is looked up by grams of the greatest length that it has itself, so that
#: the words behind a gram grow with those that match, not with all words.
GRAMS = (1, 2, 3, 5, 8, 13, 21, 34)


def _runs(word: Column, n: Column) -> Column:
    """Every different run of n characters of a word; n may not exceed its length."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n)))


def _size(piece: Column) -> Column:
    """The length of the grams that a piece is looked up by."""
    return F.greatest(*[F.when(F.length(piece) >= n, n) for n in GRAMS])


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


@dataclass
class WordIndex:
    """texts (id, sku, barcode, text), postings (word, id), dictionary (word, n)."""

    texts: DataFrame
    postings: DataFrame
    dictionary: DataFrame

    @classmethod
    def build(cls, products: DataFrame) -> WordIndex:
        text = search_text(*[F.col(c) for c in ("name", "sku", "barcode", "brand")])
        texts = products.select("id", "sku", "barcode", text.alias("text"))
        postings = texts.select("id", F.explode(_words(F.col("text"))).alias("word")).select("word", "id")
        dictionary = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        return cls(texts, postings, dictionary)

    def grams(self, sizes: list[int]) -> DataFrame:
        """(word, n, gram) of the dictionary's words, for grams of the given sizes."""
        runs = [F.when(F.length("word") >= n, _runs(F.col("word"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sizes]
        return self.dictionary.select("word", "n", F.explode(F.concat(*runs)).alias("gram"))

    def write(self, folder: str) -> None:
        """Store the index as three tables. The dictionary is derived from the stored postings, so the catalog is read once for each of the first two."""
        spark = self.texts.sparkSession
        self.texts.write.parquet(f"{folder}/texts")
        texts = spark.read.parquet(f"{folder}/texts")
        postings = texts.select("id", F.explode(_words(F.col("text"))).alias("word")).select("word", "id")
        postings.repartitionByRange("word", "id").sortWithinPartitions("word", "id").write.parquet(f"{folder}/postings")
        stored = spark.read.parquet(f"{folder}/postings")
        stored.groupBy("word").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/dictionary")

    @classmethod
    def read(cls, spark, folder: str) -> WordIndex:
        return cls(*[spark.read.parquet(f"{folder}/{name}") for name in ("texts", "postings", "dictionary")])


def asked(queries: DataFrame) -> DataFrame:
    """query_id, raw, folded, tokens: a query's forms as the scan uses them; blank queries are no searches and have no row.

    tokens are the words of a plain query (letters a-z, digits, spaces), else empty.
    """
    folded = fold(strip(F.col("query")))
    rows = queries.select("query_id", strip(F.col("query")).alias("raw"), folded.alias("folded")).filter("raw <> '' AND folded <> ''")
    plain = F.col("folded").rlike("^[a-z0-9 ]+$")
    return rows.withColumn("tokens", F.when(plain, F.split("folded", " ")).otherwise(F.array().cast("array<string>"))).distinct()


def matches(text: Column, folded: Column, tokens: Column) -> Column:
    """The scan's test: the folded query as it stands, or every word of a plain query begins some word of the text."""
    words = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    begun = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(words, F.concat(F.lit(" "), t)))
    return contains_literal(text, folded) | begun


def _followed(index: WordIndex, rows: DataFrame) -> DataFrame:
    """(query_id, word): for every query, the words that contain its rarest piece.

    Whatever matches a query contains each piece of it inside one of its words. A piece is looked up by one of its grams; which one is decided by
    the number of words behind them, so that a frequent gram is never followed while a rarer one is there. A piece with a gram that no word has
    is in no word.
    """
    pieces = rows.select("query_id", F.explode(_words(F.col("folded"))).alias("piece"))
    distinct = pieces.select("piece").distinct().withColumn("size", _size(F.col("piece")))
    wanted = sorted(r["size"] for r in distinct.select("size").distinct().collect())  # at most as many as GRAMS
    if not wanted:
        return rows.select("query_id", F.lit(None).cast("string").alias("word")).limit(0)
    grams = index.grams(wanted)
    sizes = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    pairs = distinct.select("piece", F.explode(_runs(F.col("piece"), F.col("size"))).alias("gram"))
    rarest = pairs.join(sizes, "gram").groupBy("piece").agg(F.min_by("gram", F.struct("words", "gram")).alias("gram"), F.count(F.lit(1)).alias("known"))
    rarest = stored(rarest.filter(F.col("known") == F.size(_runs(F.col("piece"), _size(F.col("piece"))))).drop("known"))
    found = stored(rarest.join(grams, "gram").filter(F.contains("word", "piece")).select("piece", "word", "n"))
    weights = found.groupBy("piece").agg(F.sum("n").alias("postings"))
    best = pieces.join(weights, "piece", "left").groupBy("query_id").agg(
        F.min_by("piece", F.struct(F.coalesce("postings", F.lit(0)), F.col("piece"))).alias("piece"))
    return best.join(found.select("piece", "word"), "piece").select("query_id", "word")


def search_many(index: WordIndex, aliases: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) for every product that ``products.search`` would return for the query, once.

    queries are (query_id, query); a query that is blank, null or folds to nothing asks for no search and has no rows. Products are found by
    words, by exact SKU or barcode, and by alias; aliases may repeat. Of the index only the postings of the rarest piece's words meet a query: the rows that move grow with
    the matches of that piece. A word that very many products have is split by adaptive execution, as both sides are shuffled for the join.
    """
    rows = stored(asked(queries))
    candidates = _followed(index, rows).join(index.postings, "word").select("query_id", "id").distinct()
    judged = candidates.join(rows.select("query_id", "folded", "tokens"), "query_id").join(index.texts.select("id", "text"), "id")
    by_text = judged.filter(matches(F.col("text"), F.col("folded"), F.col("tokens"))).select("query_id", "id")
    exact = [rows.select("query_id", F.col("raw").alias(c)).join(index.texts.select("id", c), c).select("query_id", "id") for c in ("sku", "barcode")]
    alias = rows.select("query_id", F.col("raw").alias("barcode")).join(
        aliases.select("barcode", F.col("product_id").alias("id")), "barcode").select("query_id", "id")
    # rows meet the known ids where their copies vanish: one shuffle, by id
    found = by_text.union(exact[0]).union(exact[1]).union(alias).join(index.texts.select("id"), "id", "left_semi")
    return found.select("query_id", "id").distinct()
