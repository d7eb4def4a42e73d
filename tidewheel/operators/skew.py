"""Elephants and mice: who is heavy, lanes for either, and the work that runs save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..schema import BATCH_SIZE
from . import sketches, strides

#: Parts into which the flows of one count are cut to be numbered.
BUCKETS = 64


def sampled_keys(df: DataFrame, key: Column, share: float = 1.0) -> DataFrame:
    """seq and key of a share of the packets, chosen by the hash of seq: what workers tell the orchestrator."""
    return df.where(F.pmod(F.xxhash64("seq"), F.lit(1 << 30)) < int(share * (1 << 30))).select("seq", key.alias("key"))


def flow_counts(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def elephants_by_median(counts: DataFrame, times: float = 100.0) -> DataFrame:
    """counts with elephant: at least so many times the median count."""
    median = counts.agg(F.median("n").alias("median"))
    return counts.crossJoin(F.broadcast(median)).withColumn("elephant", F.col("n") >= F.col("median") * times)


def ranked(counts: DataFrame) -> DataFrame:
    """counts with rank, before (packets of heavier flows), total and n_flows; ties by key.

    Flows are first grouped by their count, which has few values. Most flows have the same small counts, so those of a count
    are cut into BUCKETS by quantiles of their key (of its first field, if that is a number) and numbered within these.
    """
    kind = counts.schema["key"].dataType
    first = F.col("key")
    if isinstance(kind, StructType):
        kind, first = kind.fields[0].dataType, F.col("key").getField(kind.fields[0].name)
    if isinstance(kind, NumericType):
        cuts = counts.agg(F.percentile_approx(first, [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("__cuts"))
        counts = counts.crossJoin(F.broadcast(cuts)).withColumn("__b", F.size(F.filter(F.coalesce("__cuts", F.array()), lambda x: x <= first))).drop("__cuts")
    else:
        counts = counts.withColumn("__b", F.lit(0))
    down = Window.orderBy(F.desc("n"), "__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sizes = counts.groupBy("n", "__b").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    sizes = sizes.select("n", "__b", F.coalesce(F.sum("k").over(down), F.lit(0)).alias("ahead"), F.coalesce(F.sum("m").over(down), F.lit(0)).alias("heavier"), F.sum("m").over(whole).alias("total"), F.sum("k").over(whole).alias("n_flows"))
    nth = F.row_number().over(Window.partitionBy("n", "__b").orderBy("key"))
    rows = counts.withColumn("__nth", nth).join(sizes, ["n", "__b"])
    return rows.select("key", "n", (F.col("ahead") + F.col("__nth")).alias("rank"), (F.col("heavier") + (F.col("__nth") - 1) * F.col("n")).alias("before"), "total", "n_flows")


def elephants_by_share(counts: DataFrame, share: float = 0.8) -> DataFrame:
    """The heaviest flows, ties by key, while those before them carry less than this share of all packets."""
    return ranked(counts).where(F.col("before") < F.col("total") * share).select("key", "n")


def flow_cdf(counts: DataFrame) -> DataFrame:
    """Percent of flows, heaviest first, against the share of packets they carry."""
    return ranked(counts).select("key", "n", (F.lit(100.0) * F.col("rank") / F.col("n_flows")).alias("pct_flows"), ((F.col("before") + F.col("n")) / F.col("total")).alias("share"))


def expected_speedup(counts: DataFrame, elephant_gain: float, mice_gain: float, times: float = 100.0) -> DataFrame:
    """Share of the elephants' packets, and the speedup if runs of either kind save that much."""
    marked = elephants_by_median(counts, times)
    share = F.sum(F.when(F.col("elephant"), F.col("n")).otherwise(0)) / F.sum("n")
    return marked.agg(share.alias("share"), F.count(F.when(F.col("elephant"), 1)).alias("n_elephants")).withColumn("speedup", F.col("share") * elephant_gain + (1 - F.col("share")) * mice_gain)


def split_lanes(df: DataFrame, key: Column, k: int, phase: int | None = None, protocols: tuple[int, ...] | None = (17,), sketch: tuple[int, int] | None = None) -> DataFrame:
    """df with lane, elephant or mice: elephants are the k heaviest keys of the packets with seq below phase (all of them if
    none) and, as a rule of the hardware, of these protocols only. k rows are broadcast. With the height and width of a sketch, weights are its estimates."""
    sample = df if phase is None else df.where(F.col("seq") < phase)
    heavy = sketches.top_k_sketched(sample, key, k, *sketch) if sketch else sketches.top_k(sample, key, k)
    heavy = heavy.select(F.col("key").alias("__heavy"))
    found = df.withColumn("__key", key.cast("string") if sketch else key).join(F.broadcast(heavy), F.col("__key").eqNullSafe(F.col("__heavy")), "left")
    rule = F.col("__heavy").isNotNull()
    if protocols is not None:
        rule = rule & F.col("proto").isin(*protocols)
    found = found.withColumn("lane", F.when(rule, "elephant").otherwise("mice")).drop("__key", "__heavy")
    if phase is not None:
        found = found.withColumn("phase", F.when(F.col("seq") < phase, "sampling").otherwise("steady"))
    return found


def run_lanes(df: DataFrame, mode: str = "sorted", key: Column | None = None, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Runs per lane: elephants by the given mode, mice packet by packet. Batches are counted within a lane: a bucketed
    count of seq gives each packet its place without one task seeing all of them."""
    numbered = lane_sequence(df)
    heavy = strides.assign_strides(numbered.where("lane = 'elephant'"), mode, key, batch_size, ["lane"])
    light = strides.assign_strides(numbered.where("lane = 'mice'"), "baseline", key, batch_size, ["lane"])
    return heavy.unionByName(light)


def lane_sequence(df: DataFrame, bucket: int = 1 << 16, batch_size: int = BATCH_SIZE) -> DataFrame:
    """df with lane_seq, the packet's number within its lane in order of seq, and its batch_id."""
    df = df.withColumn("__b", F.floor(F.col("seq") / bucket))
    sums = df.groupBy("lane", "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("lane").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("lane", "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("lane", "__b").orderBy("seq")) - 1
    df = df.join(sums, ["lane", "__b"]).withColumn("lane_seq", F.col("__before") + nth)
    return df.withColumn("batch_id", F.floor(F.col("lane_seq") / batch_size).cast("long")).drop("__b", "__before")
