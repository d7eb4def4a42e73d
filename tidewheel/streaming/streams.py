"""The engine on streams: sessions, windowed counts, the firewall as a stateful operator, runs by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import strides
from ..schema import LAN, TIMEOUT_US, WAN, DROP, canonical_key


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there, into Parquet under path with its checkpoint beside it, and read the result."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def with_event_time(packets: DataFrame) -> DataFrame:
    return packets.withColumn("event_time", F.timestamp_micros("now_us"))


def sessions(packets: DataFrame, timeout_us: int = TIMEOUT_US, late: str = "1 hour") -> DataFrame:
    """Runs of flows by idle time; a run is emitted once the watermark has passed its end."""
    rows = with_event_time(packets).withWatermark("event_time", late).withColumn("flow", F.to_json(canonical_key()))
    # a gap equal to the timeout keeps a session alive, as in the table
    by = rows.groupBy("flow", F.session_window("event_time", f"{timeout_us} microseconds"))
    return by.agg(F.min("now_us").alias("session_start"), F.max("now_us").alias("session_end"), F.count("*").alias("n_packets"), F.sum("pkt_len").alias("n_bytes")).drop("session_window")


def windowed_counts(packets: DataFrame, interval: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Packets and bytes of each flow by tumbling window."""
    rows = with_event_time(packets).withWatermark("event_time", late).withColumn("flow", F.to_json(canonical_key()))
    return rows.groupBy(F.window("event_time", interval), "flow").agg(F.count("*").alias("n_packets"), F.sum("pkt_len").alias("n_bytes")).select(F.unix_micros("window.start").alias("window_us"), "flow", "n_packets", "n_bytes")


def firewall(packets: DataFrame, timeout_us: int = TIMEOUT_US, late: str = "0 seconds") -> DataFrame:
    """seq, action for every packet. State is the time of the last use of each live flow and ends by event-time timeout.

    Packets of a flow must not be older than the watermark; within a micro-batch they are put in order.
    """
    rows = with_event_time(packets).withWatermark("event_time", late).withColumn("flow", F.to_json(canonical_key()))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        part = pd.concat(list(parts)).sort_values(["now_us", "seq"])
        actions = []
        for now, device in zip(part.now_us, part.device, strict=True):
            alive = last is not None and now - last <= timeout_us
            if device == LAN or alive:
                last = int(now)
            actions.append(WAN if device == LAN else LAN if alive else DROP)
        if last is not None:
            state.update((last,))
            end_ms = (last + timeout_us) // 1000 + 1
            if end_ms > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(end_ms)
        yield pd.DataFrame({"seq": part.seq, "action": actions})

    tracked = rows.where(F.col("proto").isin(6, 17))
    return tracked.groupBy("flow").applyInPandasWithState(step, "seq bigint, action string", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def strides_to(path: str, mode: str = "lazy", batch_size: int = 32) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the runs of a micro-batch, appended as Parquet under its number, so a repeat overwrites itself.

    Bursts are formed from sequence numbers, so a burst that two micro-batches share gives a run in each.
    """

    def write(batch: DataFrame, number: int) -> None:
        strides.strides(batch, mode, batch_size=batch_size).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
