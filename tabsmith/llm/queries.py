"""One query per corpus operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.llm import (
    decontaminate,
    digest_index,
    histogram_sort,
    html_layout,
    jaccard_join,
    ordinal,
    packing,
    secret_scan,
    slack_packing,
    suffix_dedup,
    turn_repair,
    vector_codes,
    warc,
)
from tabsmith.llm.common import scratch_path, text_or_empty
from tabsmith.queries.base import Catalog, load

CATALOG = Catalog()
query = CATALOG.query


@query("op1_latent_leaks")
def op1_latent_leaks(spark, sf_dir):
    found = decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("common", 4).alias("common"), F.round("answer", 4).alias("answer"))


@query("op2_html_layout")
def op2_html_layout(spark, sf_dir):
    text = html_layout.extract(load(spark, sf_dir, "pages"))
    return text.select("page_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))


@query("op3_histogram_shards")
def op3_histogram_shards(spark, sf_dir):
    dealt = histogram_sort.histogram_shards(load(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return dealt.select(
        "doc_id", histogram_sort.row_size().alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    kept = suffix_dedup.without_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


WARC_SQL = """
WITH sized AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, max(page_id) AS first FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""


@query("op5_capture_index", WARC_SQL)
def op5_capture_index(spark, sf_dir):
    """Each page is looked up by its URL. Digests and sizes of responses are computed anew from the payloads that were read."""
    pages = load(spark, sf_dir, "pages")
    _, index = warc.archived(pages)
    read = warc.read_captures(index.find_urls(pages))
    there = F.col("payload").isNotNull()
    return read.select(
        "page_id",
        F.when(there, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(there, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf_dir):
    groups = jaccard_join.similar_groups(load(spark, sf_dir, "documents"), size=4, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id")


EXACT_SQL = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), groups AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM texts GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM texts JOIN groups USING (text_sha256)
"""


@query("op7_digest_index", EXACT_SQL)
def op7_digest_index(spark, sf_dir):
    """Two batches by id, the smaller ids first, so that the second one meets a filled index."""
    index = digest_index.DigestIndex(spark, scratch_path(spark, "digest-index"))
    batch = digest_index.digests(load(spark, sf_dir, "documents"))
    middle = batch.agg(F.expr("cast(avg(doc_id) as long)")).first()[0] or 0
    index.add(batch.where(F.col("doc_id") <= middle))
    index.add(batch.where(F.col("doc_id").isNull() | (F.col("doc_id") > middle)))
    return index.kept(batch).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(load(spark, sf_dir, "documents"))


@query("op9_ordinal_quality")
def op9_ordinal_quality(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = ordinal.fit(docs, labels.select("doc_id", ordinal.rating(F.col("quality"), F.col("toxic")).alias("grade")))
    scored = docs.select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", F.col("score.expected").alias("expected_grade"), F.col("score.tail").alias("tail_probability"),
                         (F.col("score.tail") >= 0.5).alias("selected"))


@query("op10_structural_secrets")
def op10_structural_secrets(spark, sf_dir):
    return secret_scan.summary(secret_scan.find_secrets(load(spark, sf_dir, "documents")))


@query("op11_sliced_codes")
def op11_sliced_codes(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    model = vector_codes.fit(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = vector_codes.coded(vectors, model)
    return codes.select("vec_id", vector_codes.hex_code().alias("code"), "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))


@query("op12_turn_repair")
def op12_turn_repair(spark, sf_dir):
    return turn_repair.repaired(turn_repair.damaged(load(spark, sf_dir, "conversations")))


@query("op13_slack_packing")
def op13_slack_packing(spark, sf_dir):
    return slack_packing.pack(load(spark, sf_dir, "documents"))
