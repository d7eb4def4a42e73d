"""Exact dedup with a persistent digest index, in DataFrame operations only.

The index is a Parquet table bucketed and sorted by the SHA-256 of the text. A batch is reduced to one row
per digest (partial aggregation first, so a text that a third of the rows share costs one row per task),
anti-joined to the index by sort-merge (the index side needs no shuffle) and what is new is appended.

Rules: null text counts as empty; texts are equal when identical; of equal texts in a batch the row with the
largest id stays, unless an earlier batch holds the text, whose row then stays. Rows repeated with the same id
count in group_size and one of them is kept. A null id is smaller than any other. An empty batch gives no rows.
A text of any length is one digest. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, discard, fresh_path, keep_winners, sha256_hex, shuffle_partitions, written


class DigestIndex:
    """digest binary, keep_id, group_size long, batch string; bucketed by digest under path.

    The number of buckets is that of the index, whatever the session's settings: it is kept beside the data (a file
    _buckets-N), and so are the names of finished batches (files _batch-H). An index is opened with the same call by which
    it was made; another number of buckets is refused, and so is a path with data that no index has written.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path
        self.table = f"tw_digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        names = self._names()
        known = [int(n.removeprefix("_buckets-")) for n in names if n.startswith("_buckets-")]
        if names and not known:
            raise ValueError(f"{path} has files but is no index")
        if known and buckets not in (None, known[0]):
            raise ValueError(f"the index in {path} has {known[0]} buckets, not {buckets}")
        self.buckets = known[0] if known else buckets or shuffle_partitions(spark)
        if not known:
            self._mark(f"_buckets-{self.buckets}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _at(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + (f"/{name}" if name else ""))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at, files = self._at()
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def _mark(self, name: str) -> None:
        at, files = self._at(name)
        files.create(at, True).close()

    def drop(self) -> None:
        """Delete the index with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        at, files = self._at()
        files.delete(at, True)

    def read(self) -> DataFrame:
        return self.spark.read.table(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> str:
        """Append the digests of docs that the index lacks; returns the name of the batch.

        A batch that has been ingested to the end is not ingested again. One that broke off is: what it has appended
        is known by its digests.
        """
        batch = batch or uuid.uuid4().hex
        done = f"_batch-{uuid.uuid5(uuid.NAMESPACE_URL, batch).hex}"
        if done in self._names():
            return batch
        digests = docs.select(F.unhex(sha256_hex(text_col)).alias("digest"), F.col(id_col).alias("keep_id"))
        # written, since the planner moves an anti-join below an aggregate, where all copies of a text meet in one task
        groups = written(digests.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.count("*").alias("group_size")), "digests")
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        discard(groups)
        self._mark(done)
        return batch

    def decide(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of docs: id, digest, keep_id, group_size, kept. group_size counts the batch that brought the text.

        Rows of hot digests look their group up in a broadcast of at most 1 / HOT_SHARE rows, all others by
        sort-merge join with the bucketed index.
        """
        index = self.read()
        total = index.where(F.col("batch") == batch).agg(F.sum("group_size")).first()[0] or 0
        least = max(2, int(total * HOT_SHARE) + 1)
        groups = index.select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("__tw_own"))
        rows = docs.select(F.col(id_col).alias("__tw_id"), F.unhex(sha256_hex(text_col)).alias("digest"))
        hot = F.broadcast(groups.where(F.col("__tw_own") & (F.col("group_size") >= least)))
        of_hot = rows.join(hot, "digest")
        rest = rows.join(hot.select("digest"), "digest", "left_anti").join(groups.hint("merge"), "digest")
        found = of_hot.unionByName(rest)
        nth = F.row_number().over(Window.partitionBy("digest", "__tw_id").orderBy(F.lit(1)))
        kept = F.col("__tw_own") & F.col("__tw_id").eqNullSafe(F.col("keep_id")) & (nth == 1)
        return found.withColumn("kept", kept).select(F.col("__tw_id").alias(id_col), "digest", "keep_id", "group_size", "kept")


def new_index(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> DigestIndex:
    """An empty index of its own in the shared folder."""
    return DigestIndex(spark, fresh_path(spark, "digest_index"), id_type=docs.schema[id_col].dataType.simpleString())


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Dedup docs as one batch against an index that starts empty; see DigestIndex.decide."""
    index = new_index(docs.sparkSession, docs)
    found = written(index.decide(docs, index.ingest(docs)), "decided")
    index.drop()
    return found


def dedup_new(docs: DataFrame, seen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dedup docs against an index that holds seen (of the same names), reopened as a later session would."""
    index = new_index(docs.sparkSession, docs, id_col)
    index.ingest(seen, id_col, text_col)
    index = DigestIndex(docs.sparkSession, index.path)
    found = written(index.decide(docs, index.ingest(docs, id_col, text_col), id_col, text_col), "decided")
    index.drop()
    return found


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without copies: of equal texts the row with the largest id stays, with all its columns."""
    index = new_index(docs.sparkSession, docs, id_col)
    index.ingest(docs, id_col, text_col)
    winners = written(index.read().select("digest", "keep_id"), "winners")
    index.drop()
    return keep_winners(docs, winners, id_col, text_col)
