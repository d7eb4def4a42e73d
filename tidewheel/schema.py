"""Record types of the engine and the keys derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAN, WAN, DROP, FLOOD = "LAN", "WAN", "DROP", "FLOOD"
BATCH_SIZE = 32
MAX_FLOWS = 1 << 20
TIMEOUT_US = 1_000_000

#: A parsed packet. A packet that cannot be parsed has zeros in the four key fields.
PACKET = "seq bigint, now_us bigint, device string, proto int, src_ip bigint, dst_ip bigint, src_port int, dst_port int, pkt_len bigint"
RAW_PACKET = "seq bigint, device string, now_us bigint, pkt_len int, pkt binary"
KEY = ("src_ip", "dst_ip", "src_port", "dst_port")


def flow_key(with_protocol: bool = False) -> Column:
    """The four key fields (zero where missing) as a struct; protocol on request."""
    cols = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in KEY]
    return F.struct(*cols, *([F.coalesce(F.col("proto"), F.lit(0)).alias("proto")] if with_protocol else []))


def ip_pair() -> Column:
    return F.struct("src_ip", "dst_ip")


def port_pair() -> Column:
    return F.struct("src_port", "dst_port")


def inverted_key() -> Column:
    """The key of the reply: both ends swapped."""
    return F.struct(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), F.col("dst_port").alias("src_port"), F.col("src_port").alias("dst_port"))


def canonical_key() -> Column:
    """One key for both directions: as the LAN side sends it."""
    return F.when(F.col("device") == LAN, F.struct(*KEY)).otherwise(inverted_key())


def key_order(descending: bool = True) -> list[Column]:
    """Sort expressions over the key fields, one after the other."""
    return [F.col(c).desc() if descending else F.col(c).asc() for c in KEY]


def parseable(df: DataFrame) -> DataFrame:
    """IPv4 TCP or UDP packets only."""
    return df.where(F.col("proto").isin(6, 17))
