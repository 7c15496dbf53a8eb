"""The queries of this subpackage, over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, ngram_join, packing, pii, quality_model, quality_rules, secret_scan, url_filter, warc
from .common import table

#: The key of the query alone, where spark.sparkweave.pii.key isn't set; the operator asks its caller for one.
QUERY_KEY = b"no secret: results of the query are to be reproducible"
QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents")))
    return quality_rules.decide(marked).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "failed_rules")


ORACLES["op4_quality_rules"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, [x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x <> ''] AS words,
  [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM h WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
  + 8 * (n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (n_words > 0 AND word_chars < 2 * n_words)::BIGINT
  + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed,
  (failed_rules & 15) = 0 AS kept, failed_rules FROM b
"""


@query
def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does to each version of the policy, from the ledger of op4."""
    return quality_rules.ablations(quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents"))))


_ASKED = ", ".join(f"('{p}', '{r}', {quality_rules.mask(names)}::BIGINT, {quality_rules.mask((r,))}::BIGINT)" for p, names in quality_rules.POLICIES.items() for r in names)
ORACLES["quality_rule_ablations"] = f"""SELECT policy, "rule", count(*) FILTER ((failed_rules & bit) <> 0) AS n_failed, count(*) FILTER ((failed_rules & mask) = bit) AS n_only,
  count(*) FILTER ((failed_rules & mask) = 0) AS n_kept, count(*) FILTER ((failed_rules & mask & ~bit) = 0) AS n_kept_without
FROM ({ORACLES["op4_quality_rules"]}), (VALUES {_ASKED}) asked(policy, "rule", mask, bit) GROUP BY ALL"""


@query
def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality_model.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.expr("pmod(crc32(CAST(doc_id AS STRING)), 3) = 1")
    return quality_model.score(docs, ranker).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLES["op6_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept,
  sha256(text) AS text_sha256 FROM t WINDOW w AS (PARTITION BY text)
"""


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND best IS NOT NULL AND page_id IS DISTINCT FROM best AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN best END AS refers_to FROM r
"""


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


@query
def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.sparkweave.pii.key", None)
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key.encode() if key else QUERY_KEY)
