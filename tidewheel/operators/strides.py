"""Coalescing of packets of one flow within a batch, and the statistics of the runs.

Modes: baseline (each packet alone), straw (a batch is one run), lazy (adjacent packets of a key), greedy (all packets of a
key in the batch, in order of first appearance), sorted (the same runs in descending order of the key). A batch is small
and bounded, so the windows below partition by (lane, batch) and no key can grow a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BATCH_SIZE, flow_key
from ..sources.packets import with_batch

MODES = ("baseline", "straw", "lazy", "greedy", "sorted")


def assign_strides(df: DataFrame, mode: str = "lazy", key: Column | None = None, batch_size: int = BATCH_SIZE, lane: list[str] | None = None) -> DataFrame:
    """df with batch_id, stride_id (from 0 within a batch, in processing order), stride_size, head_seq, position in the run."""
    key = flow_key() if key is None else key
    df = (df if "batch_id" in df.columns else with_batch(df, batch_size)).withColumn("__k", key)
    batch = [*(lane or []), "batch_id"]
    by_seq = Window.partitionBy(*batch).orderBy("seq")
    if mode == "baseline":
        df = df.withColumn("stride_id", F.row_number().over(by_seq) - 1)
    elif mode == "straw":
        df = df.withColumn("stride_id", F.lit(0))
    elif mode == "lazy":
        new = (~F.col("__k").eqNullSafe(F.lag("__k").over(by_seq))).cast("int")
        df = df.withColumn("__new", F.when(F.lag("seq").over(by_seq).isNull(), 0).otherwise(new))
        df = df.withColumn("stride_id", F.sum("__new").over(by_seq.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")
    elif mode == "greedy":
        df = df.repartition(*batch)  # else the window by key would be dealt out by itself
        df = df.withColumn("__first", F.min("seq").over(Window.partitionBy(*batch, "__k")))
        df = df.withColumn("stride_id", F.dense_rank().over(Window.partitionBy(*batch).orderBy("__first")) - 1).drop("__first")
    elif mode == "sorted":
        df = df.withColumn("stride_id", F.dense_rank().over(Window.partitionBy(*batch).orderBy(F.col("__k").desc())) - 1)
    else:
        raise ValueError(f"mode is one of {MODES}")
    run = Window.partitionBy(*batch, "stride_id")
    df = df.withColumn("stride_size", F.count("*").over(run)).withColumn("head_seq", F.min("seq").over(run))
    return df.withColumn("position", F.row_number().over(run.orderBy("seq")) - 1).drop("__k")


def strides(df: DataFrame, mode: str = "lazy", key: Column | None = None, batch_size: int = BATCH_SIZE, lane: list[str] | None = None) -> DataFrame:
    """A row per run: batch_id, stride_id, head_seq, stride_size."""
    runs = assign_strides(df, mode, key, batch_size, lane)
    return runs.where("position = 0").select(*(lane or []), "batch_id", "stride_id", "head_seq", "stride_size")


def grouped_strides(df: DataFrame, key: Column | None = None, batch_size: int = BATCH_SIZE) -> DataFrame:
    """The runs of greedy and sorted without their order: one aggregation."""
    key = flow_key() if key is None else key
    return with_batch(df, batch_size).groupBy("batch_id", key.alias("key")).agg(F.min("seq").alias("head_seq"), F.count("*").alias("stride_size"))


def stride_histogram(runs: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """stride_size 1 to batch_size and n_strides, zeros included."""
    sizes = runs.sparkSession.range(1, batch_size + 1).select(F.col("id").alias("stride_size"))
    counts = runs.groupBy(F.col("stride_size").cast("long").alias("stride_size")).agg(F.count("*").alias("n_strides"))
    return F.broadcast(sizes).join(counts, "stride_size", "left").select("stride_size", F.coalesce("n_strides", F.lit(0)).alias("n_strides"))


def apply_per_stride(runs: DataFrame, action: str = "own_action", out: str = "action", lane: list[str] | None = None) -> DataFrame:
    """Every packet takes the action of its run's first packet; the action column is what each would get alone."""
    run = Window.partitionBy(*(lane or []), "batch_id", "stride_id")
    return runs.withColumn(out, F.min_by(action, "seq").over(run))


def mean_stride(hist: DataFrame) -> DataFrame:
    total = F.sum("n_strides")
    return hist.agg(F.when(total > 0, F.sum(F.col("stride_size") * F.col("n_strides")) / total).otherwise(F.lit(0.0)).alias("mean_stride"))


def relative_frequency(hist: DataFrame) -> DataFrame:
    return hist.select("stride_size", (F.lit(100.0) * F.col("n_strides") / F.sum("n_strides").over(Window.partitionBy())).alias("percent"))


def cumulative_frequency(hist: DataFrame) -> DataFrame:
    """A histogram has as many rows as a batch has packets, so one task sums it."""
    running = F.sum("n_strides").over(Window.orderBy("stride_size").rowsBetween(Window.unboundedPreceding, 0))
    return hist.select("stride_size", (running / F.sum("n_strides").over(Window.partitionBy())).alias("cumulative"))
