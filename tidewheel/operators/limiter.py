"""Token buckets: per key an ordered fold over its packets.

A key's first packet passes and leaves burst - len tokens (0 at least). Each later one refills by the time since the last
times rate, up to burst, and passes if more tokens than bytes are left. A key that is idle for longer than burst // rate
seconds is forgotten and starts anew.

Forgetting cuts a key's packets into independent runs, which are found by windows over time slices. The rows of a run come
in order to one task, which carries two numbers from row to row, so a run of any length costs no memory and linear time.

Packets without a time do not pass and leave their bucket alone; a null key is a key like any other, a null length is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flowtable import with_sessions


def token_bucket(df: DataFrame, key: Column, rate: int, burst: int) -> DataFrame:
    """seq, key, passes for every packet (now_us, pkt_len); rate in bytes a second."""
    idle = burst // rate * 1_000_000
    rows = df.select("seq", "now_us", "device", F.coalesce(F.col("pkt_len").cast("long"), F.lit(0).cast("long")).alias("pkt_len"), key.alias("key"))
    timed = with_sessions(rows.where("now_us IS NOT NULL"), max(idle, 1), F.col("key"))
    order = ["now_us", "seq"]
    timed = timed.repartition("flow", "session_start").sortWithinPartitions("flow", "session_start", *order)
    first = F.row_number().over(Window.partitionBy("flow", "session_start").orderBy(*order)) == 1
    timed = timed.select("seq", "key", "now_us", "pkt_len", first.alias("first"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = before = 0
        for batch in batches:
            out = []
            for fresh, now, length in zip(*(batch.column(c).to_pylist() for c in ("first", "now_us", "pkt_len")), strict=True):
                have = burst if fresh else min(burst, tokens + int((now - before) * rate / 1_000_000))
                passes = fresh or have > length
                tokens, before = max(have - length, 0) if passes else have, now
                out.append(passes)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("key"), pa.array(out, pa.bool_())], ["seq", "key", "passes"])

    schema = timed.select("seq", "key", F.lit(True).alias("passes")).schema
    rest = rows.where("now_us IS NULL").select("seq", "key", F.lit(False).alias("passes"))
    return timed.mapInArrow(fold, schema).unionByName(rest)


def tracked(df: DataFrame, key: Column, at_us: int, rate: int, burst: int) -> DataFrame:
    """Keys that the limiter knows at a time."""
    last = df.where(F.col("now_us") <= at_us).groupBy(key.alias("key")).agg(F.max("now_us").alias("last_us"))
    return last.where(F.col("last_us") >= at_us - burst // rate * 1_000_000)
