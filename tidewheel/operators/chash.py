"""Consistent hashing: a table of backends by preference for every bucket, and routing by the first one that is up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import slot


def build_table(spark: SparkSession, height: int, backends: int) -> DataFrame:
    """bucket, prio, backend. height must be a prime, so that each backend's steps visit all buckets.

    Backend j visits buckets from offset 31 * j in steps of j mod (height - 1) + 1; a bucket prefers who visits it first.
    """
    if height < 2 or any(height % d == 0 for d in range(2, int(height**0.5) + 1)):
        raise ValueError("height must be a prime")
    step, backend = spark.range(height).withColumnRenamed("id", "i"), spark.range(backends).withColumnRenamed("id", "j")
    visits = step.join(F.broadcast(backend), how="cross").select("i", "j", ((F.lit(31) * F.col("j") % height + (F.col("j") % (height - 1) + 1) * F.col("i")) % height).alias("bucket"))
    prio = F.row_number().over(Window.partitionBy("bucket").orderBy("i", "j")) - 1
    return visits.select("bucket", prio.cast("long").alias("prio"), F.col("j").alias("backend"))


def route(df: DataFrame, key: Column, table: DataFrame, active: DataFrame, height: int) -> DataFrame:
    """df with backend: of the key's bucket the first one that is active, null if none is. The table has height * backends rows,
    reduced to height before it is joined."""
    first = table.join(F.broadcast(active.select("backend").distinct()), "backend", "left_semi").groupBy("bucket").agg(F.min_by("backend", "prio").alias("backend"))
    return df.withColumn("bucket", slot(key, height)).join(F.broadcast(first), "bucket", "left")
