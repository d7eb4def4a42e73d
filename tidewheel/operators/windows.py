"""Windows over packets: counted, fixed, idle, and resets anchored at the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_window(df: DataFrame, interval_us: int) -> DataFrame:
    """df with window_id, a multiple of the interval since 1970: the scalable default of periodic resets."""
    return df.withColumn("window_id", F.floor(F.col("now_us") / interval_us).cast("long"))


def reset_points(df: DataFrame, interval_us: int) -> DataFrame:
    """reset_us: the first time (which arms), then each first time at least an interval after the last reset.

    The chain is sequential: one task reads the distinct times in order and leaps from reset to reset by binary search.
    Nothing else of a row reaches it. Where boundaries may stay in place, ``fixed_window`` needs no such task.
    """
    times = df.select("now_us").where("now_us IS NOT NULL").distinct()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            t = batch.column(0).to_numpy()
            out = []
            at = 0
            while at < len(t):
                if last is not None:
                    at = int(np.searchsorted(t, last + interval_us, "left"))
                    if at >= len(t):
                        break
                last = int(t[at])
                out.append(last)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["reset_us"])

    return times.repartition(1).sortWithinPartitions("now_us").mapInArrow(chain, "reset_us bigint")


def with_reset_window(df: DataFrame, interval_us: int) -> DataFrame:
    """df with reset_us, the reset that a packet counts from. Resets lie an interval apart, so a stretch of an interval holds
    one at most: an equi-join on stretches, with what the stretches before left, whatever the number of resets."""
    chained = reset_points(df, interval_us).withColumn("__s", F.floor(F.col("reset_us") / interval_us)).select("__s", "reset_us")
    rows = df.withColumn("__s", F.floor(F.col("now_us") / interval_us))
    first = rows.join(chained, "__s", "left")
    here = F.when(F.col("reset_us") <= F.col("now_us"), F.col("reset_us"))
    first = first.withColumn("__here", here).drop("reset_us")
    # the last reset before a stretch, for every stretch that has rows
    stretches = rows.select("__s").distinct().unionByName(chained.select("__s")).distinct()
    before = F.last("reset_us", ignorenulls=True).over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    carried = stretches.join(chained, "__s", "left").select("__s", before.alias("__before"))
    return first.join(carried, "__s", "left").withColumn("reset_us", F.coalesce("__here", "__before")).drop("__s", "__here", "__before")


def bounded_sample(df: DataFrame, n: int) -> DataFrame:
    """Packets of the sampling phase: the first n by sequence number."""
    return df.where(F.col("seq") < n)
