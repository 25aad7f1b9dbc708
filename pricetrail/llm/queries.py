"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.llm import bpe, chat, warc
from pricetrail.llm.decontamination import contamination
from pricetrail.llm.filter_audit import filter_orders
from pricetrail.llm.hard_negatives import hard_negatives
from pricetrail.llm.html_text import extracted
from pricetrail.llm.langid import identified
from pricetrail.llm.quality import judged
from pricetrail.llm.rows import prepare, table
from pricetrail.llm.simhash import near_duplicates
from pricetrail.llm.substring_dedup import without_repeats
from pricetrail.llm.token_counts import section_tokens
from pricetrail.llm.toxicity import scored
from pricetrail.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = lambda spark, folder: function(prepare(spark), folder)
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@query("op1_decontamination", f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}'), []) AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
o AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS s
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n))
  JOIN w USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("item_ids")


@query("op2_bpe")
def bpe_digests(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), ids=False)


@query("op3_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages"))


@query("op4_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return section_tokens(table(spark, folder, "documents"))


@query("op5_simhash_near_dedup")
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


DATED = "2024-05-01T00:00:00Z"


@query("op6_warc", f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, url, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS head FROM p),
r AS (SELECT page_id, url, h, strlen(h)::BIGINT AS payload_bytes,
       translate(to_base(('0x' || x[1:10])::BIGINT, 32, 8) || to_base(('0x' || x[11:20])::BIGINT, 32, 8)
                 || to_base(('0x' || x[21:30])::BIGINT, 32, 8) || to_base(('0x' || x[31:40])::BIGINT, 32, 8),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to, chr(13) || chr(10) AS n FROM m),
f AS (SELECT *, 'WARC/1.1' || n || 'WARC-Type: ' || record_type || n || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n || 'WARC-Date: {DATED}' || n
       || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || n, '')
       || coalesce('WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || n || 'WARC-Refers-To: <urn:page:' || refers_to || '>' || n, '')
       || 'WARC-Payload-Digest: sha1:' || payload_digest || n || 'Content-Type: text/html' || n
       || 'Content-Length: ' || CASE WHEN refers_to IS NULL THEN payload_bytes ELSE 0 END || n || n
       || CASE WHEN refers_to IS NULL THEN h ELSE '' END || n || n AS record FROM r)
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, true AS sound, strlen(record)::BIGINT AS record_bytes, sha1(record) AS record_sha1
FROM f
""")
def archive(spark: SparkSession, folder: str) -> DataFrame:
    """The archive stays in the shared folder: the rows returned are read from it, and so are the records, put together again."""
    at = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, folder, "pages"), at, date=DATED)
    record = F.col("record")
    return warc.read_archive(spark, at).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound",
        F.length(record).cast("long").alias("record_bytes"), F.sha1(record).alias("record_sha1"))


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = judged(table(spark, folder, "documents"), table(spark, folder, "labels"), pairs=True)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


_SAID = "</s>[INST] ok [/INST]"


@query("op8_chat_formatting", f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')),
e AS (SELECT *, length(t) + 4 * (length(t) - length(replace(t, '&', ''))) + 3 * (length(t) - length(replace(t, '<', '')))
               + 4 * (length(t) - length(replace(t, '[', ''))) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(role) + 1 + escaped + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", _SAID), (-7, 1, "assistant", _SAID)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(turns.unionByName(more)))


@query("op9_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identified(table(spark, folder, "documents"))


_SPACED = "[^\\x20\\x09-\\x0D]+"


@query("op11_substring_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{_SPACED}'), []) AS ws FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s
      FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (s) WHERE doc_id > least),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept
      FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN g USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM g GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
""")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = without_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_filter_interaction_audit", f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_SPACED}') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i)
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, p, k, n, good, toxic, f[p[k]] AS fails, len(list_filter(p[1 : k - 1], lambda x: f[x])) > 0 AS earlier,
             len(list_filter(f, lambda x: x)) = 1 AS sole FROM c, o, range(1, 6) k(k)),
r AS (SELECT part, p, k, sum(n) FILTER (NOT earlier AND NOT fails) AS kept, sum(n) FILTER (fails AND NOT earlier) AS removed,
             sum(n) FILTER (fails AND earlier) AS redundant, sum(n) FILTER (fails AND sole) AS unique_fails,
             sum(good) FILTER (fails AND NOT earlier) AS good_lost, sum(toxic) FILTER (fails AND NOT earlier) AS toxic_lost
      FROM s GROUP BY part, p, k)
SELECT part, array_to_string(list_transform(p, lambda x: 'ABCDE'[x]), '') AS filter_order, k::INT AS step, coalesce(kept, 0)::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(sum(removed) OVER (PARTITION BY part, p[k]), 0)::BIGINT AS shapley, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost
FROM r
""")
def filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_orders(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_hard_negatives", """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same AND other_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""")
def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label)
