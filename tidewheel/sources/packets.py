"""Packet sources and sinks: table adapters, raw headers, captures, lanes, flooding."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import BATCH_SIZE, LAN, RAW_PACKET, WAN, canonical_key


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 as the clock reads, whatever the session's time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def events_as_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_packets(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_as_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_packets(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def as_packets(events: DataFrame) -> DataFrame:
    """Events as packets: users on the LAN side talk to seven services on the WAN side."""
    lan = F.col("event_type").isin("click", "view")
    user, service = F.col("user_id"), F.lit(1_000_000) + F.col("user_id") % 7
    own, port = (F.lit(40_000) + F.col("user_id") % 100).cast("int"), F.lit(80)
    return events.select(
        F.col("event_id").alias("seq"),
        wall_micros(F.col("ts")).alias("now_us"),
        F.when(lan, LAN).otherwise(WAN).alias("device"),
        F.when(F.col("event_type") == "error", 6).otherwise(17).alias("proto"),
        F.when(lan, user).otherwise(service).alias("src_ip"),
        F.when(lan, service).otherwise(user).alias("dst_ip"),
        F.when(lan, own).otherwise(port).alias("src_port"),
        F.when(lan, port).otherwise(own).alias("dst_port"),
        F.floor("value").cast("long").alias("pkt_len"),
    )


def with_batch(df: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """The burst a packet arrives in: a run of size sequence numbers."""
    return df.withColumn("batch_id", F.floor(F.col("seq") / size).cast("long"))


def parse_headers(raw: DataFrame, packet: str = "pkt") -> DataFrame:
    """Ethernet, IPv4 and TCP or UDP headers from bytes, in the JVM. What cannot be parsed has proto 0 and a zero key."""

    def number(at: Column, size: int) -> Column:
        return F.conv(F.hex(F.substring(F.col(packet), at, F.lit(size))), 16, 10).cast("long")

    pos = lambda i: F.lit(i + 1)
    ihl = number(pos(14), 1) % 16 * 4
    proto = number(pos(23), 1).cast("int")
    size = F.length(packet)
    ok = (size >= 34) & (number(pos(12), 2) == 0x0800) & proto.isin(6, 17) & (size >= ihl + 18)
    keep = lambda c, kind: F.when(F.coalesce(ok, F.lit(False)), c).otherwise(F.lit(0)).cast(kind)
    return raw.select(
        *[F.col(c) for c in raw.columns if c not in (packet, "pkt_len")],
        keep(proto, "int").alias("proto"),
        keep(number(pos(26), 4), "long").alias("src_ip"),
        keep(number(pos(30), 4), "long").alias("dst_ip"),
        keep(number(ihl + 15, 2), "int").alias("src_port"),
        keep(number(ihl + 17, 2), "int").alias("dst_port"),
        F.coalesce(F.col("pkt_len") if "pkt_len" in raw.columns else size, size).cast("long").alias("pkt_len"),
    )


class _CaptureReader(DataSourceReader):
    def __init__(self, paths: list[str], device: str):
        self.paths, self.device = paths, device

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, p)) for i, p in enumerate(self.paths)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, path = partition.value
        with open(path, "rb") as f:
            head = f.read(24)
            magic = head[:4]
            order = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}.get(magic)
            if order is None:
                raise ValueError(f"{path} is no capture file")
            n = 0
            while len(h := f.read(16)) == 16:
                seconds, part, kept, whole = struct.unpack(order[0] + "IIII", h)
                yield (number << 40) + n, self.device, seconds * 1_000_000 + part // order[1], whole, f.read(kept)
                n += 1


class CaptureSource(DataSource):
    """spark.read.format('capture').option('paths', 'a.pcap,b.pcap'): a partition per file, streamed packet by packet."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return RAW_PACKET

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _CaptureReader(self.options["paths"].split(","), self.options.get("device", LAN))


def captures(spark: SparkSession, paths: list[str], device: str = LAN) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("paths", ",".join(paths)).option("device", device).load()


def redirection_bucket(key: Column, buckets: int = 512) -> Column:
    """The entry of a redirection table that a key's hash selects."""
    return F.pmod(key, F.lit(buckets))


def queue_of(bucket: Column, queues: int, reserved: int = 0) -> Column:
    """Entries are dealt in turn over the queues that are not reserved."""
    return F.lit(reserved) + bucket % (queues - reserved)


def partitioned_by_flow(df: DataFrame, partitions: int) -> DataFrame:
    """Both directions of a flow in one partition."""
    return df.withColumn("__key", canonical_key()).repartition(partitions, "__key").drop("__key")


def flood(df: DataFrame, ports: list[str]) -> DataFrame:
    """A copy for every port but the one of arrival."""
    return df.withColumn("out_port", F.explode(F.filter(F.array(*[F.lit(p) for p in ports]), lambda p: p != F.col("device"))))


def send(df: DataFrame, path: str, action: str = "action") -> None:
    """The sink: a directory per output port; dropped packets are not written."""
    df.where(F.col(action) != "DROP").write.mode("append").partitionBy(action).parquet(path)
