"""From raw documents to sampled pieces: five stages, each over all rows the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import exact_dedup, mixing, prob_minhash, sampled_pieces, toxicity
from tidewheel.llm.common import compact, load, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labelled ones, scores 0.5 or more."""
    return compact(toxicity.drop_toxic(docs, load(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return compact(exact_dedup.drop_exact_copies(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return compact(prob_minhash.drop_near_copies(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for, in training order."""
    return mixing.mix(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document in training order, with the digest of what they decode to and its place in that order.

    docs is what mix_sources returned, read again: the order is that of its files and of the rows in them. Copies of a
    document are segmented by draws of their own.
    """
    order = ["part", "row", "copy"]
    found = sampled_pieces.encode_documents(mixing.with_order(docs), copy_col="copy", carry=order)
    found = written(found, "pieces")  # sorting by range reads its input twice
    return found.repartitionByRange("part", "row").sortWithinPartitions("part", "row")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", sample_pieces),
]

#: A trained classifier, near copies and sampling have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
