"""Counts of keys: exact, Count-Min, Bloom, heavy hitters. Sketch rows use independent hash functions.

A sketch is a table (row, cell, count): built with a partial aggregation, queried by a join, merged by adding. It has
height * width cells at most, so it may be broadcast. A sketch that is cleared by windows has a column window_id, as many
cells for each window, and is joined without a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import row_hash, string_key

HEIGHT, WIDTH = 7, 65_536


def cells(df: DataFrame, key: Column, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(r).alias("row"), row_hash(key, r, width).alias("cell")) for r in range(height)])
    return df.select("*", F.inline(rows))


def count_min(df: DataFrame, key: Column, height: int = HEIGHT, width: int = WIDTH, weight: Column | None = None, window: Column | None = None) -> DataFrame:
    """Keys are counted before they are hashed, so a frequent key costs height rows a task. With a window the sketch is
    cleared at its end: one for each."""
    by = [] if window is None else [window.alias("window_id")]
    counted = df.groupBy(*by, key.alias("key")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    return cells(counted, F.col("key"), height, width).groupBy(*_windows(counted), "row", "cell").agg(F.sum("n").alias("count"))


def _windows(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "window_id"]


def _looked_up(asked: DataFrame, sketch: DataFrame) -> DataFrame:
    by = _windows(sketch)
    return asked.join(sketch if by else F.broadcast(sketch), [*by, "row", "cell"], "left")


def estimate(sketch: DataFrame, keys: DataFrame, key: Column, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """keys with estimate, an upper bound of the true count (0 where a cell is empty). Keys of a sketch with windows have a
    window_id."""
    asked = cells(keys.withColumn("__id", F.monotonically_increasing_id()), key, height, width)
    found = _looked_up(asked, sketch)
    return found.groupBy(*keys.columns, "__id").agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate")).drop("__id")


def bloom(df: DataFrame, key: Column, height: int = HEIGHT, width: int = WIDTH, window: Column | None = None) -> DataFrame:
    by = [] if window is None else [window.alias("window_id")]
    keys = df.select(*by, key.alias("key")).distinct()
    return cells(keys, F.col("key"), height, width).select(*_windows(keys), "row", "cell").distinct()


def maybe_in(bloom_cells: DataFrame, keys: DataFrame, key: Column, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """keys with member: false is certain."""
    asked = cells(keys.withColumn("__id", F.monotonically_increasing_id()), key, height, width)
    found = _looked_up(asked, bloom_cells.withColumn("__set", F.lit(1)))
    return found.groupBy(*keys.columns, "__id").agg((F.count("__set") == height).alias("member")).drop("__id")


def key_counts(df: DataFrame, keys: dict[str, Column], window: Column | None = None) -> DataFrame:
    """Counts over several keys in one pass: kind, key (as text), n, by window if given."""
    by = [] if window is None else [window.alias("window_id")]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys.items()])
    rows = df.select(*by, F.inline(each))
    return rows.groupBy(*(["window_id"] if by else []), "kind", "key").agg(F.count("*").alias("n"))


def sketched(counts: DataFrame, by: list[str], height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """counts (by, key as text, n) with estimate in place of n, what a Count-Min sketch for each group of by says of the key.
    Cells are summed where they are, so the sketch is not joined back."""
    each = cells(counts, string_key(F.col("key")), height, width)
    each = each.withColumn("__sum", F.sum("n").over(Window.partitionBy(*by, "row", "cell")))
    return each.groupBy(*by, "key").agg(F.min("__sum").alias("estimate"))


def top_k_sketched(df: DataFrame, key: Column, k: int = 256, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """The k keys of the largest estimates, ties by key (as text): the slots that an orchestrator ends with."""
    counts = df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n"))
    return sketched(counts, [], height, width).orderBy(F.desc("estimate"), "key").limit(k)


def top_k(df: DataFrame, key: Column, k: int = 256) -> DataFrame:
    """The k most frequent keys, ties by key: each task keeps k rows."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "key").limit(k)


def approximate_top_k(df: DataFrame, key: Column, k: int = 256) -> DataFrame:
    return df.select(key.alias("__k")).agg(F.expr(f"approx_top_k(__k, {k})").alias("t")).select(F.inline("t"))


def shares(counts: DataFrame, weight: str = "weight") -> DataFrame:
    """counts with total and share, in percent of all."""
    total = counts.agg(F.sum(weight).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.lit(100.0) * F.col(weight) / F.col("total"))


def running_maximum(df: DataFrame, key: Column) -> DataFrame:
    """The one key with the largest count."""
    counts = df.groupBy(key.alias("key")).agg(F.count("*").alias("weight"))
    return counts.agg(F.max_by("key", F.struct("weight", (-F.xxhash64("key")).alias("h"))).alias("key"), F.max("weight").alias("weight"))


def rank_of(counts: DataFrame, weight: str = "weight") -> DataFrame:
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(weight), "key")))
