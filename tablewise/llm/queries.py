"""Driver queries of this subpackage: thin calls with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kernelscore, linededup, packing, quantisation, secrets, simhash, textrules, urltree, warc
from .common import materialise, table

BPE_FILE = "byte_bpe_50k.tiktoken"
WORD_FILE = "word_bpe_49k.json"
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of pages."""
    captures = warc.write_and_read(table(spark, sf_dir, "pages"))
    # rows that repeat a page's id and html are one capture, whose metadata counts them
    captures = captures.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("n_metadata").cast("int"))))
    response = F.col("response.record_type") == "response"
    return captures.select(
        warc.metadata_field("captureId").cast("long").alias("page_id"),
        F.when(response, F.col("response.payload_bytes")).otherwise(warc.metadata_field("payloadLength").cast("long")).alias("payload_bytes"),
        F.when(response, F.col("response.payload_digest")).otherwise(F.col("response.declared_digest")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(~response, warc.metadata_field("firstCapture").cast("long")).alias("refers_to"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each different candidate of a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.findings(docs, secrets.model_of(docs), path_col="source")
    # the outer form, as Spark pushes the plain one's filter below and computes findings twice
    rows = found.select("doc_id", F.explode_outer("findings").alias("c")).filter(F.col("c").isNotNull())
    return rows.select("doc_id", F.col("c.value").alias("candidate"), F.col("c.position").alias("position"), F.col("c.occurrences").alias("occurrences"), F.col("c.score").alias("score"), (F.col("c.score") > secrets.THRESHOLD).alias("is_secret"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = materialise(textrules.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "text-counts")
    # the list is asked only for rows that pass the base rules, and so learns from them
    rules = textrules.learn(counted.filter(~textrules.base_failed()), table(spark, sf_dir, "labels"))
    return counted.withColumn("base_failed", textrules.base_failed()).withColumn("kept", ~F.col("base_failed") & textrules.verdict(rules))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantisation.search(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(20)) == 0, k=20)
    return found.withColumnRenamed("id", "vec_id")


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(kernelscore.describe(table(spark, sf_dir, "documents")), "quality-stats")
    model = kernelscore.fit(stats, table(spark, sf_dir, "labels").filter(~_held_out()))
    scored = kernelscore.score(stats, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def page_labels(pages: DataFrame) -> DataFrame:
    """``pages`` with ``label``. The tables hold no labelled urls, so a page's body
    labels its url: 0 if over two hundredths of it are signs, else 1; its url is never
    looked at. A third of the pages (by a hash) stays without a label."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), "(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " ")
    junk = F.length(body) - F.length(F.regexp_replace(body, r"[#*$%|!]", "")) > 0.02 * F.length(body)
    label = F.when(F.crc32(F.col("page_id").cast("string").cast("binary")) % 3 != 1, F.when(junk, 0).otherwise(1))
    return pages.select("page_id", "url", label.alias("label"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = materialise(page_labels(table(spark, sf_dir, "pages")), "page-labels")
    return urltree.judge(labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "good_share")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.cluster(table(spark, sf_dir, "documents"), size=3, max_bits=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def queries():
    own = (op1_warc, op2_secrets, op3_rules, op4_ann, op5_quality, op6_packing, op7_urls, op8_simhash, op9_bpe, op10_lines)
    return {f.__name__: f for f in own}


_OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes, upper(sha1(h)) AS x FROM p
), b AS (
  SELECT page_id, payload_bytes, x,
    array_to_string(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
        (CAST(('0x' || substr(x, CAST(1 + 10 * (i // 8) AS BIGINT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest
  FROM d
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM b
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

_OP10 = """
WITH t AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM t
), k AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS akey FROM l
), c AS (
  SELECT akey, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM k WHERE length(akey) >= 40 GROUP BY akey
), m AS (
  SELECT k.doc_id, k.line, k.pos, (c.akey IS NOT NULL AND c.n >= 5 AND k.doc_id <> c.keeper) AS gone
  FROM k LEFT JOIN c ON k.akey = c.akey
)
SELECT doc_id, count(*) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def oracle_sql():
    return {"op1_warc": _OP1, "op10_lines": _OP10}
