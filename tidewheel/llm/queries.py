"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edit_embedding, exact_dedup, html_text, mixing, paragraphs, private_data, prob_minhash, sampled_pieces, suffix_dedup, toxicity
from .common import compact, load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(paragraphs.paragraph_classes(load(spark, sf_dir, "documents")))


@query
def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(sampled_pieces.encode_documents(load(spark, sf_dir, "documents")))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(toxicity.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))
    return compact(found).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def exact_dedup_against_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as new data for an index that holds benchmark."""
    new = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    seen = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    found = exact_dedup.dedup_new(new, seen, "id")
    return found.select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL["exact_dedup_against_index"] = """
WITH seen AS (SELECT coalesce(text, '') AS text, max('b' || item_id) AS keep_id, count(*) AS group_size FROM benchmark GROUP BY 1),
new AS (SELECT coalesce(text, '') AS text, max('d' || doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT 'd' || doc_id AS id, coalesce(seen.keep_id, new.keep_id) AS keep_id, coalesce(seen.group_size, new.group_size) AS group_size,
       seen.keep_id IS NULL AND 'd' || doc_id = new.keep_id AND row_number() OVER (PARTITION BY new.text, doc_id) = 1 AS kept,
       sha256(new.text) AS text_sha256
FROM documents d JOIN new ON coalesce(d.text, '') = new.text LEFT JOIN seen ON seen.text = new.text
"""


@query
def op5_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(edit_embedding.fingerprint_documents(load(spark, sf_dir, "documents")))


@query
def op6_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(prob_minhash.class_ids(load(spark, sf_dir, "documents")))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(html_text.extract(load(spark, sf_dir, "pages")))


@query
def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(private_data.digest_columns(private_data.find(load(spark, sf_dir, "documents"))))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removed_spans(load(spark, sf_dir, "documents"))
    return compact(found).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.assign(load(spark, sf_dir, "documents"))
    all_ = F.concat_ws(",", F.transform("positions", lambda x: F.floor(x * 1e6).cast("string")))
    return compact(found).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("long").alias("copies"), all_.alias("positions_ppm"))


ORACLE_SQL["op10_mixing"] = r"""
WITH sized AS (SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS size,
                      md5(coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source),
w AS (SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
r AS (SELECT *, sum(s) OVER () AS total,
             coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(w) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             row_number() OVER (ORDER BY 3 * s / w, source NULLS LAST) AS nth FROM w),
l AS (SELECT *, (total - before)::DOUBLE / rest AS level FROM r),
lv AS (SELECT arg_min(level, nth) AS level FROM l WHERE level <= 3 * s / w),
t AS (SELECT source, s, turn, least((3 * s)::DOUBLE, lv.level * w) AS target FROM l, lv),
c AS (SELECT doc_id, size, s, turn, target, coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (2 * start + size <= 2 * target)::BIGINT + (2 * (s + start) + size <= 2 * target)::BIGINT + (2 * (2 * s + start) + size <= 2 * target)::BIGINT AS copies,
             [CASE WHEN target > 0 THEN (2 * (p * s + start) + size) / (2.0::DOUBLE * target) ELSE 0 END FOR p IN [0, 1, 2]] AS ys,
             CASE turn WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS w0, CASE turn WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS w1 FROM c)
SELECT doc_id, size, s AS source_size, target, copies * size AS taken, copies,
       array_to_string([floor((0.0::DOUBLE + 2.0::DOUBLE * y / (w0 + sqrt(w0 * w0 + 2.0::DOUBLE * (w1 - w0) / 1.0::DOUBLE * y))) * 1e6)::BIGINT::VARCHAR FOR y IN ys[1:copies]], ',') AS positions_ppm
FROM k
"""
