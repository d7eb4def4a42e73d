"""Statistics of benchmark results and histograms."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import mega

#: fixed order of techniques in reports
TECHNIQUES = ("baseline", "greedy", "lazy", "sorted")


def mean_and_std(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population standard deviation of the rates, in Gbit and Mpackets a second."""
    return df.groupBy(*by).agg(
        F.avg(mega(F.col("pps"))).alias("mpps_mean"), F.stddev_pop(mega(F.col("pps"))).alias("mpps_std"), F.avg(mega(F.col("bps"))).alias("mbps_mean"), F.stddev_pop(mega(F.col("bps"))).alias("mbps_std"), F.count("*").alias("n")
    )


def technique_order(column: str = "technique") -> Column:
    """Sort key: known techniques in report order, others after them."""
    at = F.array_position(F.array(*[F.lit(t) for t in TECHNIQUES]), F.col(column))
    return F.when(at > 0, at).otherwise(len(TECHNIQUES) + 1)


def key_set(df: DataFrame, column: str) -> DataFrame:
    """The values of a column, null first."""
    return df.select(column).distinct().orderBy(F.asc_nulls_first(column))


def filled_grid(df: DataFrame, axes: dict[str, list], values: list[str]) -> DataFrame:
    """Every combination of the axes' values, with 0 where df has no row."""
    schema = ", ".join(f"{name} {df.schema[name].dataType.simpleString()}" for name in axes)
    grid = df.sparkSession.createDataFrame(list(product(*axes.values())), schema)
    on = None
    for name in axes:
        c = grid[name].eqNullSafe(df[name])
        on = c if on is None else on & c
    return grid.join(df, on, "left").select(*[grid[n] for n in axes], *[F.coalesce(df[v], F.lit(0)).alias(v) for v in values])


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Counts in equal bins from the smallest to the largest value, which is in the last bin."""
    bounds = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds))
    at = F.when(F.col("__lo") == F.col("__hi"), F.lit(1)).otherwise(F.least(F.floor((F.col(column) - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins)).cast("int") + 1, F.lit(bins)))
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def of_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in the set."""
    return df.join(keys, on, "left_semi")
