"""What the text operators share: the shared folder, written tables and stable row keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of all rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 1024

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tw-{uuid.uuid4().hex}/{name}"


def input_bytes(df: DataFrame) -> int:
    """The size of all tables that df reads, as Spark's statistics have it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def compact(df: DataFrame) -> DataFrame:
    """df in fewer partitions where a scan without a shuffle has many small ones: one for each spark.sql.files.maxPartitionBytes
    of input, at least one for each core.

    So many small files do not end in as many small ones, and a task's share stays that of a scan. Behind a shuffle the
    partitions are those that adaptive execution has sized by bytes, and stay as they are.
    """
    execution = df._jdf.queryExecution()
    if "Exchange " in execution.executedPlan().toString().replace("BroadcastExchange ", ""):
        return df
    each = int(execution.sparkSession().sessionState().conf().filesMaxPartitionBytes())
    return df.coalesce(int(min(max(df.sparkSession.sparkContext.defaultParallelism, input_bytes(df) // each), 1 << 30)))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more; it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again."""
    path = fresh_path(df.sparkSession, name)
    compact(df).write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tw_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._tw_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sha256_hex(column: str = "text") -> Column:
    return F.sha2(text_or_empty(column), 256)


def prepare_session(spark: SparkSession, batch_rows: int = 1000) -> None:
    """What the operators need of a session, once: Arrow batches of texts of at most batch_rows rows (their size is what executors
    hold outside the heap, and Spark bounds it by rows alone), and this package on the executors' import path."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > batch_rows:
        spark.conf.set(key, batch_rows)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        packed = Path(tempfile.mkdtemp(prefix="tidewheel-")) / f"{root.name}.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(packed))
        _shipped.add(context.applicationId)


def trimmed(f: Callable) -> Callable:
    """f, a function for mapInArrow, that gives its memory back to the system when its partition is done: the worker lives
    on, idle or for other tasks, beside an executor that may need it."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return run


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with table (one row per key) on key, inner or left; count, a column of table, says how many rows have its key.

    Rows of hot keys look theirs up in a broadcast of at most 1 / HOT_SHARE rows, all others by sort-merge join, so no key
    sends a large share of all rows to one task.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(count) >= max(2, int(total * HOT_SHARE) + 1)))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.hint("merge"), key, how)
    return rows.join(hot, key).unionByName(rest)


def join_spread(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """As join_hot, in one sort-merge join that returns each of rows once at most: rows of a hot key (rows have a rid, unique) are
    dealt by rid to parts of a share below HOT_SHARE each, and the one row of table is there for each part.

    Only the hot keys, with their parts, are broadcast, and rows are read once.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    least = max(2, int(total * HOT_SHARE) + 1)
    n_parts = F.ceil(F.col(count) / least).cast("int")
    hot = F.broadcast(table.where(F.col(count) >= least).select(key, n_parts.alias("__parts")))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid"), F.col("__parts"))).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("__part", part).drop("__parts")
    parts = F.when(F.col(count) >= least, F.sequence(F.lit(0), n_parts - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn("__part", F.explode(parts)).hint("merge"), [key, "__part"], how).drop("__part")


def keep_winners(docs: DataFrame, winners: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs named by winners (digest, keep_id), each once, with the columns of docs.

    digest is the SHA-256 of the text. One shuffle of docs on (digest, id): a pair is rarely shared, so
    copies of one text do not meet in one task. Rows repeated in full count as one.
    """
    digest, wanted = "__tw_digest", winners.select(F.col("digest").alias("__tw_w"), F.col("keep_id").alias("__tw_k"))
    cols = docs.columns
    found = docs.withColumn(digest, F.unhex(sha256_hex(text_col)))
    found = found.join(wanted.hint("merge"), F.col(digest).eqNullSafe(F.col("__tw_w")) & F.col(id_col).eqNullSafe(F.col("__tw_k")), "left_semi")
    return found.dropDuplicates([digest, id_col]).select(*[F.col(f"`{c}`") for c in cols])
