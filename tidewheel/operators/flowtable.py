"""The flow table: idle timeouts, sessions and the firewall, as windows over canonical flows.

A flow lives while no gap between its packets exceeds the timeout (a gap equal to it keeps it alive). Only LAN packets
create a flow; a WAN packet passes if its flow is alive, and then keeps it alive. So within a run of packets without a longer
gap the WAN packets before the first LAN packet are dropped and all others pass.

Runs are found in two steps: within slices of time, where a key has a bounded share of its packets, and across slices on one
summary row a slice. A key that holds a third of all packets is thus spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DROP, LAN, MAX_FLOWS, TIMEOUT_US, WAN, canonical_key

SLICE_TIMEOUTS = 64


def with_sessions(df: DataFrame, timeout_us: int = TIMEOUT_US, key: Column | None = None, slice_us: int | None = None) -> DataFrame:
    """df with flow (the canonical key), session_start (time of the run's first packet) and lan_before (a LAN packet came
    earlier in the run). A null key is a key like any other; the packets of a key without a time are one run, whose start is null."""
    slice_us = slice_us or SLICE_TIMEOUTS * timeout_us
    df = df.withColumn("flow", canonical_key() if key is None else key).withColumn("__s", F.floor(F.col("now_us") / slice_us))
    part = Window.partitionBy("flow", "__s").orderBy("now_us", "seq")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__new", F.coalesce((F.col("now_us") - F.lag("now_us").over(part) > timeout_us).cast("int"), F.lit(0)))
    df = df.withColumn("__run", F.sum("__new").over(upto))
    df = df.withColumn("__lan", (F.col("device") == LAN).cast("int"))
    run = Window.partitionBy("flow", "__s", "__run").orderBy("now_us", "seq")
    df = df.withColumn("__lan_before", F.coalesce(F.max("__lan").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("__start", F.min("now_us").over(run))

    # to other slices a slice is its first and its last run: the segments of a key, put together by the same rule
    runs = df.groupBy("flow", "__s", "__run").agg(F.min("now_us").alias("a"), F.max("now_us").alias("b"), F.max("__lan").alias("lan"))
    ends = runs.groupBy("flow", "__s").agg(F.min(F.struct("__run", "a", "b", "lan")).alias("head"), F.max(F.struct("__run", "a", "b", "lan")).alias("tail"))
    both = F.when(F.col("head.__run") == F.col("tail.__run"), F.array("head")).otherwise(F.array("head", "tail"))
    segments = ends.select("flow", "__s", F.inline(both))
    order = Window.partitionBy("flow").orderBy("a")
    segments = segments.withColumn("new", F.coalesce((F.col("a") - F.lag("b").over(order) > timeout_us).cast("int"), F.lit(0)))
    segments = segments.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    session = Window.partitionBy("flow", "session").orderBy("a")
    segments = segments.select(
        "flow",
        "__s",
        F.col("__run"),
        F.min("a").over(session).alias("__open_start"),
        F.coalesce(F.max("lan").over(session.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__open_lan"),
    ).where("__run = 0")
    segments = segments.withColumnsRenamed({"flow": "__flow", "__s": "__slice", "__run": "__head"})
    df = df.join(segments, F.col("flow").eqNullSafe(F.col("__flow")) & F.col("__s").eqNullSafe(F.col("__slice")))
    in_head = F.col("__run") == 0
    df = df.withColumn("session_start", F.when(in_head, F.col("__open_start")).otherwise(F.col("__start")))
    df = df.withColumn("lan_before", F.greatest("__lan_before", F.when(in_head, F.col("__open_lan")).otherwise(F.lit(0))) > 0)
    return df.drop("__flow", "__slice", "__s", "__new", "__run", "__lan", "__lan_before", "__start", "__head", "__open_start", "__open_lan")


def firewall(df: DataFrame, timeout_us: int = TIMEOUT_US, slice_us: int | None = None, key: Column | None = None) -> DataFrame:
    """df with flow, session_start and action: LAN packets go to WAN, WAN packets to LAN if a flow is alive, else DROP.
    Packets that are not TCP or UDP over IPv4, and those without a time or a device, are dropped and leave the table alone. Flows are those of key,
    if given: with a lane in it each lane has a table of its own."""
    ok = F.col("proto").isin(6, 17) & F.col("now_us").isNotNull() & F.col("device").isNotNull()
    found = with_sessions(df.where(ok), timeout_us, key, slice_us)
    action = F.when(F.col("device") == LAN, WAN).when(F.col("lan_before"), LAN).otherwise(DROP)
    found = found.withColumn("action", action).drop("lan_before")
    rest = df.where(~F.coalesce(ok, F.lit(False)))
    return found.unionByName(rest.withColumn("action", F.lit(DROP)), allowMissingColumns=True)


def sessions(df: DataFrame, timeout_us: int = TIMEOUT_US, key: Column | None = None) -> DataFrame:
    """A row per run of a flow: flow, session_start, session_end, n_packets, n_bytes."""
    return with_sessions(df, timeout_us, key).groupBy("flow", "session_start").agg(F.max("now_us").alias("session_end"), F.count("*").alias("n_packets"), F.sum("pkt_len").alias("n_bytes"))


def live_flows(df: DataFrame, at_us: int, timeout_us: int = TIMEOUT_US) -> DataFrame:
    """Flows in the table at a time: those refreshed by then and not idle for longer than the timeout. Look-ups are semi-joins."""
    last = df.where(F.col("now_us") <= at_us).groupBy(canonical_key().alias("flow")).agg(F.max("now_us").alias("last_us"))
    return last.where(F.col("last_us") >= at_us - timeout_us)


def expired_flows(df: DataFrame, at_us: int, timeout_us: int = TIMEOUT_US) -> DataFrame:
    """Flows that a sweep at this time removes, oldest first by last_us."""
    last = df.where(F.col("now_us") <= at_us).groupBy(canonical_key().alias("flow")).agg(F.max("now_us").alias("last_us"))
    return last.where(F.col("last_us") < at_us - timeout_us)


def erase_range(table: DataFrame, start: int, stop: int, index: str = "idx") -> DataFrame:
    """The table without the entries from start up to stop, which stays."""
    return table.where((F.col(index) < start) | (F.col(index) >= stop))


def sample_above(values: DataFrame, samples: int, threshold: int, seed: int = 0, value: str = "value") -> DataFrame:
    """The first of some random entries that exceeds the threshold, if any does."""
    drawn = values.orderBy(F.xxhash64(F.struct(*values.columns), F.lit(seed))).limit(samples)
    return drawn.where(F.col(value) > threshold).limit(1)


def limited_firewall(df: DataFrame, capacity: int = MAX_FLOWS, timeout_us: int = TIMEOUT_US) -> DataFrame:
    """The firewall with a bounded table: when it is full a new flow's packets are forwarded untracked and its replies dropped.

    Who finds room depends on the order of all packets, so this runs in one task, packet by packet, holding capacity
    flows. Use it to study small tables; ``firewall`` has no bound and is distributed.
    """
    rows = df.withColumn("flow", canonical_key()).select("seq", "now_us", "device", "proto", F.to_json("flow").alias("flow"))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, int] = {}  # in order of last use
        for part in parts:
            out = []
            for now, device, proto, flow in zip(part.now_us, part.device, part.proto, part.flow, strict=True):
                while table and next(iter(table.values())) < now - timeout_us:
                    del table[next(iter(table))]
                if proto not in (6, 17):
                    out.append(DROP)
                    continue
                known = table.pop(flow, None) is not None
                if known or (device == LAN and len(table) < capacity):
                    table[flow] = now
                out.append(WAN if device == LAN else LAN if known else DROP)
            yield pd.DataFrame({"seq": part.seq, "action": out})

    decided = rows.repartition(1).sortWithinPartitions("now_us", "seq").mapInPandas(walk, "seq bigint, action string")
    return df.join(decided, "seq")


def overfull(df: DataFrame, capacity: int = MAX_FLOWS, timeout_us: int = TIMEOUT_US) -> DataFrame:
    """Whether an unbounded table would ever hold more than capacity flows: most_flows and overfull."""
    ends = sessions(df, timeout_us)
    steps = ends.select(F.col("session_start").alias("t"), F.lit(1).alias("d")).unionByName(ends.select((F.col("session_end") + timeout_us + 1).alias("t"), F.lit(-1).alias("d")))
    # per slice of time the sum of its steps, then the steps of a slice in order: one task sees a row per slice alone
    steps = steps.groupBy("t").agg(F.sum("d").alias("d")).withColumn("s", F.floor(F.col("t") / (SLICE_TIMEOUTS * timeout_us)))
    slices = steps.groupBy("s").agg(F.sum("d").alias("d"))
    before = F.coalesce(F.sum("d").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(F.col("s").alias("__s"), before.alias("before"))
    steps = steps.join(slices, F.col("s").eqNullSafe(F.col("__s")))
    held = steps.select((F.col("before") + F.sum("d").over(Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).alias("n"))
    return held.agg(F.max("n").alias("most_flows"), (F.max("n") > capacity).alias("overfull"))


def port_swap(df: DataFrame) -> DataFrame:
    """The forwarder without state: what comes in on one side goes out on the other."""
    return df.withColumn("action", F.when(F.col("device") == LAN, WAN).otherwise(LAN))
