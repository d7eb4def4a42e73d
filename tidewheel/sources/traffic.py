"""Synthetic keyed traffic, drawn from a hash of the row number, so it is the same in any run and partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import unit_draw

#: Flows whose cumulative weights are tabled; those of later ones follow from the sum formula of Euler and Maclaurin, to the
#: precision of a double.
TABLED = 1 << 20


def uniform_flows(rows: DataFrame, n_flows: int, seq: str = "seq", salt: str = "u") -> DataFrame:
    return rows.withColumn("flow", F.floor(unit_draw(F.col(seq), salt) * n_flows).cast("long"))


class Zipf:
    """The law by which flow k of n has a probability proportional to 1 / (k + 1) ** s, and its inverse; exact for any n."""

    def __init__(self, n_flows: int, s: float):
        self.n, self.s = n_flows, s
        self.table = np.cumsum(np.arange(1, min(n_flows, TABLED) + 1, dtype=float) ** -s)
        self.total = float(self.weight(np.array([n_flows]))[0])

    def weight(self, k: np.ndarray) -> np.ndarray:
        """The sum of the weights of the first k flows (1 or more each)."""
        m, s = len(self.table), self.s
        x = np.maximum(k, m).astype(float)
        area = np.log(x / m) if s == 1 else (x ** (1 - s) - float(m) ** (1 - s)) / (1 - s)
        ends = (x**-s - float(m) ** -s) / 2 - s * (x ** (-s - 1) - float(m) ** (-s - 1)) / 12
        return np.where(k > m, self.table[-1] + area + ends, self.table[np.minimum(k, m) - 1])

    def pick(self, u: np.ndarray) -> np.ndarray:
        """The flow at which the cumulative probability first exceeds u."""
        goal = u * self.total
        found = np.searchsorted(self.table, goal, "right")
        late = np.flatnonzero(found >= len(self.table))
        low, high = np.full(len(late), len(self.table), dtype=np.int64), np.full(len(late), self.n, dtype=np.int64)
        while (low < high).any():
            half = (low + high) // 2
            over = self.weight(half + 1) > goal[late]
            low, high = np.where(over | (low >= high), low, half + 1), np.where(over, half, high)
        found[late] = low
        return np.minimum(found, self.n - 1)


def zipf_flows(rows: DataFrame, n_flows: int, s: float, seq: str = "seq", salt: str = "z") -> DataFrame:
    """Flow k of n with probability proportional to 1 / (k + 1) ** s."""
    return sweep(rows, n_flows, [s], seq, salt).drop("zipf")


def sweep(rows: DataFrame, n_flows: int, exponents: list[float], seq: str = "seq", salt: str = "z") -> DataFrame:
    """rows once for each exponent, as column zipf, with their flows. An exponent of 0 is the uniform law."""
    u = unit_draw(F.col(seq), salt)
    rows = rows.withColumn("zipf", F.explode(F.array(*[F.lit(float(s)) for s in exponents])))
    even = F.floor(u * n_flows).cast("long")
    laws = {float(s): Zipf(n_flows, s) for s in exponents if s}
    if not laws:
        return rows.withColumn("flow", even)
    shared = rows.sparkSession.sparkContext.broadcast(laws)  # of at most TABLED numbers an exponent

    @F.pandas_udf("long")
    def pick(x: pd.Series, s: pd.Series) -> pd.Series:
        out = np.zeros(len(x), dtype=np.int64)
        for exponent, law in shared.value.items():
            own = (s == exponent).to_numpy()
            out[own] = law.pick(x.to_numpy()[own])
        return pd.Series(out)

    return rows.withColumn("flow", F.when(F.col("zipf") == 0, even).otherwise(pick(u, F.col("zipf"))))


def packets(spark: SparkSession, n: int, n_flows: int, s: float = 0.0, packet_size: int = 64, gap_us: int = 1, logical_batch: int = 1, seed: int | None = None, get_ratio: float | None = None) -> DataFrame:
    """n packets of n_flows flows; a logical batch sends that many packets of a flow in a row. Another seed draws others. With
    get_ratio the packets are requests to a key-value store: op is get for that share of them, else put."""
    rows = spark.range(n).withColumnRenamed("id", "seq").withColumn("__run", F.floor(F.col("seq") / logical_batch).cast("long"))
    salt = "" if seed is None else f"{seed}:"
    rows = zipf_flows(rows, n_flows, s, seq="__run", salt=f"{salt}z") if s else uniform_flows(rows, n_flows, seq="__run", salt=f"{salt}u")
    op = [] if get_ratio is None else [F.when(unit_draw(F.col("seq"), f"{salt}k") < get_ratio, "get").otherwise("put").alias("op")]
    return rows.select(
        "seq",
        (F.col("seq") * gap_us).alias("now_us"),
        F.lit("LAN").alias("device"),
        F.lit(17).alias("proto"),
        F.col("flow").alias("src_ip"),
        (F.col("flow") + (1 << 24)).alias("dst_ip"),
        (F.col("flow") % 65536).cast("int").alias("src_port"),
        F.lit(80).alias("dst_port"),
        F.lit(packet_size).cast("long").alias("pkt_len"),
        *op,
    )


def rate_stream(spark: SparkSession, packets_per_second: int, n_flows: int, churn_per_minute: int = 0, packet_size: int = 64) -> DataFrame:
    """An endless stream of packets at a rate. Churn replaces that many flows a minute by new ones, evenly over time."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", packets_per_second).load()
    now = F.unix_micros("timestamp")
    place = F.pmod(F.xxhash64("value"), F.lit(n_flows))
    age = F.floor((now * churn_per_minute / 60_000_000 + place) / n_flows) if churn_per_minute else F.lit(0)
    flow = (age * n_flows + place).cast("long")
    return rows.select(
        F.col("value").alias("seq"),
        now.alias("now_us"),
        F.lit("LAN").alias("device"),
        F.lit(17).alias("proto"),
        flow.alias("src_ip"),
        (flow + (1 << 24)).alias("dst_ip"),
        (flow % 65536).cast("int").alias("src_port"),
        F.lit(80).alias("dst_port"),
        F.lit(packet_size).cast("long").alias("pkt_len"),
    )
