"""Every query of the flow engine, with its SQL counterpart."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import core
from ..operators import chash, flowtable, limiter, sketches, skew, stats, strides, windows
from ..schema import DROP, LAN, WAN, flow_key
from ..sources import packets as source
from ..sources import results, traffic
from ..streaming import streams
from . import programs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000
TIMEOUT = 6 * HOUR

#: the packet view in SQL
PACKETS = """packets AS (
SELECT event_id AS seq, epoch_us(ts) AS now_us, CASE WHEN event_type IN ('click', 'view') THEN 'LAN' ELSE 'WAN' END AS device,
  CASE WHEN event_type = 'error' THEN 6 ELSE 17 END AS proto,
  CASE WHEN event_type IN ('click', 'view') THEN user_id ELSE 1000000 + user_id % 7 END AS src_ip,
  CASE WHEN event_type IN ('click', 'view') THEN 1000000 + user_id % 7 ELSE user_id END AS dst_ip,
  CASE WHEN event_type IN ('click', 'view') THEN 40000 + user_id % 100 ELSE 80 END AS src_port,
  CASE WHEN event_type IN ('click', 'view') THEN 80 ELSE 40000 + user_id % 100 END AS dst_port,
  floor(value)::BIGINT AS pkt_len, user_id, event_type FROM events),
k AS (SELECT *, seq // 32 AS batch_id, (src_ip, dst_ip, src_port, dst_port) AS key FROM packets)"""
LAZY = """b AS (SELECT *, CASE WHEN lag(key) OVER w IS DISTINCT FROM key AND lag(seq) OVER w IS NOT NULL THEN 1 ELSE 0 END AS brk FROM k WINDOW w AS (PARTITION BY batch_id ORDER BY seq)),
lz AS (SELECT *, sum(brk) OVER (PARTITION BY batch_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stride_id FROM b),
lazy AS (SELECT batch_id, stride_id::BIGINT AS stride_id, min(seq) AS head_seq, count(*) AS stride_size FROM lz GROUP BY 1, 2)"""
GROUPED = "g AS (SELECT batch_id, key, min(seq) AS head_seq, count(*) AS stride_size FROM k GROUP BY 1, 2)"
HIST = "h AS (SELECT s.i AS stride_size, count(r.stride_size) AS n_strides FROM range(1, 33) s(i) LEFT JOIN {runs} r ON r.stride_size = s.i GROUP BY 1)"
FLOW = """f AS (SELECT *, CASE WHEN device = 'LAN' THEN (src_ip, dst_ip, src_port, dst_port) ELSE (dst_ip, src_ip, dst_port, src_port) END AS flow FROM packets),
fg AS (SELECT *, CASE WHEN now_us - lag(now_us) OVER (PARTITION BY flow ORDER BY now_us, seq) > {timeout} THEN 1 ELSE 0 END AS brk FROM f),
fs AS (SELECT *, sum(brk) OVER (PARTITION BY flow ORDER BY now_us, seq ROWS UNBOUNDED PRECEDING) AS session FROM fg),
fw AS (SELECT *, CASE WHEN device = 'LAN' THEN 'WAN' WHEN coalesce(max((device = 'LAN')::INT) OVER (PARTITION BY flow, session ORDER BY now_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'LAN' ELSE 'DROP' END AS action FROM fs)""".replace("{timeout}", str(TIMEOUT))
COUNTS = "c AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1)"
RANKED = "r AS (SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS rank, sum(n) OVER (ORDER BY n DESC, key ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total, count(*) OVER () AS n_flows FROM c)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    return source.events_as_packets(spark, sf)


def _runs(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return strides.strides(_packets(spark, sf), mode)


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# sources


@query(f"WITH {PACKETS} SELECT seq, now_us, device, proto, src_ip, dst_ip, src_port, dst_port, pkt_len FROM packets")
def packet_view(spark, sf):
    return _packets(spark, sf)


@query(f"WITH {PACKETS} SELECT seq, o.p AS out_port FROM packets, (SELECT unnest(['LAN', 'WAN', 'MGMT']) AS p) o WHERE o.p <> device")
def flood_fanout(spark, sf):
    return source.flood(_packets(spark, sf), ["LAN", "WAN", "MGMT"]).select("seq", "out_port")


@query("SELECT event_id AS seq, ((1103515245 * (user_id % 2147483647) + 12345) % 2147483647) % 512 AS bucket, 1 + (((1103515245 * (user_id % 2147483647) + 12345) % 2147483647) % 512) % 7 AS queue FROM events")
def rss_partition(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), source.redirection_bucket(core.row_hash(F.col("user_id"), 0, 512)).alias("bucket"))
    return rows.withColumn("queue", source.queue_of(F.col("bucket"), 8, 1))


@query(
    """WITH x AS (SELECT event_id AS seq, user_id, event_id % 5 AS kind FROM events)
SELECT seq, CASE WHEN kind < 3 THEN (CASE WHEN kind = 0 THEN 6 ELSE 17 END) ELSE 0 END AS proto, CASE WHEN kind < 3 THEN 167772160 + user_id % 65536 ELSE 0 END AS src_ip,
  CASE WHEN kind < 3 THEN 3232235521 ELSE 0 END AS dst_ip, CASE WHEN kind < 3 THEN seq % 65536 ELSE 0 END AS src_port, CASE WHEN kind < 3 THEN 443 ELSE 0 END AS dst_port FROM x"""
)
def header_parse(spark, sf):
    """Frames written from the events: TCP, UDP, UDP, another protocol, another frame type; parsed again."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id"), (F.col("event_id") % 5).alias("kind"))
    number = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    frame = F.concat(
        F.lit("020000000001020000000002"),
        F.when(F.col("kind") == 4, "86DD").otherwise("0800"),
        F.lit("4500002E0000000040"),
        F.when(F.col("kind") == 0, "06").when(F.col("kind") == 3, "01").otherwise("11"),
        F.lit("0000"),
        number(F.lit(167_772_160) + F.col("user_id") % 65536, 4),
        F.lit("C0A80001"),
        number(F.col("seq") % 65536, 2),
        F.lit("01BB00000000"),
    )
    return source.parse_headers(e.select("seq", F.unhex(frame).alias("pkt"))).drop("pkt_len")


# runs


@query(f"WITH {PACKETS} SELECT seq, batch_id, CASE WHEN first_value(device) OVER (PARTITION BY batch_id ORDER BY seq) = 'LAN' THEN 'WAN' ELSE 'LAN' END AS action FROM k")
def straw_actions(spark, sf):
    runs = strides.assign_strides(flowtable.port_swap(_packets(spark, sf)).withColumnRenamed("action", "own_action"), "straw")
    return strides.apply_per_stride(runs).select("seq", "batch_id", "action")


@query(f"WITH {PACKETS}, {LAZY} SELECT * FROM lazy")
def lazy_strides(spark, sf):
    return _long(_runs(spark, sf, "lazy"), "stride_id")


@query(f"WITH {PACKETS}, {LAZY}, {HIST.format(runs='lazy')} SELECT stride_size, n_strides FROM h")
def lazy_stride_hist(spark, sf):
    return strides.stride_histogram(_runs(spark, sf, "lazy"))


@query(f"WITH {PACKETS}, {GROUPED} SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY head_seq) - 1 AS stride_id, head_seq, stride_size FROM g")
def greedy_strides(spark, sf):
    return _long(_runs(spark, sf, "greedy"), "stride_id")


@query(f"WITH {PACKETS}, {GROUPED} SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY key DESC) - 1 AS stride_id, head_seq, stride_size FROM g")
def sorted_strides(spark, sf):
    return _long(_runs(spark, sf, "sorted"), "stride_id")


@query(f"WITH {PACKETS}, {GROUPED}, {HIST.format(runs='g')} SELECT stride_size, n_strides FROM h")
def grouped_stride_hist(spark, sf):
    return strides.stride_histogram(strides.grouped_strides(_packets(spark, sf)))


@query(f"WITH {PACKETS}, {LAZY}, {HIST.format(runs='lazy')} SELECT round(sum(stride_size * n_strides) / sum(n_strides), 9) AS mean_stride FROM h")
def stride_mean(spark, sf):
    return strides.mean_stride(lazy_stride_hist(spark, sf)).select(F.round("mean_stride", 9).alias("mean_stride"))


@query(f"WITH {PACKETS}, {LAZY}, {HIST.format(runs='lazy')} SELECT stride_size, round(100.0 * n_strides / sum(n_strides) OVER (), 9) AS percent FROM h")
def stride_relfreq(spark, sf):
    return strides.relative_frequency(lazy_stride_hist(spark, sf)).withColumn("percent", F.round("percent", 9))


@query(f"WITH {PACKETS}, {LAZY}, {HIST.format(runs='lazy')} SELECT stride_size, round(sum(n_strides) OVER (ORDER BY stride_size) / sum(n_strides) OVER (), 9) AS cumulative FROM h")
def stride_cdf(spark, sf):
    return strides.cumulative_frequency(lazy_stride_hist(spark, sf)).withColumn("cumulative", F.round("cumulative", 9))


@query(
    f"""WITH {PACKETS}, {LAZY}, {GROUPED} SELECT 'baseline' AS technique, count(*) AS n_packets, count(*) AS n_strides FROM k UNION ALL SELECT 'straw', count(*), count(DISTINCT batch_id) FROM k
UNION ALL SELECT 'lazy', sum(stride_size)::BIGINT, count(*) FROM lazy UNION ALL SELECT 'greedy', sum(stride_size)::BIGINT, count(*) FROM g UNION ALL SELECT 'sorted', sum(stride_size)::BIGINT, count(*) FROM g"""
)
def coalescing_gain(spark, sf):
    out = None
    for mode in strides.MODES:
        runs = strides.grouped_strides(_packets(spark, sf)) if mode in ("greedy", "sorted") else _runs(spark, sf, mode)
        one = runs.agg(F.sum("stride_size").alias("n_packets"), F.count("*").alias("n_strides")).select(F.lit(mode).alias("technique"), "n_packets", "n_strides")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH b AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS DISTINCT FROM role AND lag(turn) OVER w IS NOT NULL THEN 1 ELSE 0 END AS brk FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT conv_id, run::BIGINT AS run, min(turn) AS first_turn, any_value(role) AS role, count(*) AS n_turns FROM s GROUP BY 1, 2"""
)
def role_runs(spark, sf):
    """Adjacent turns of one role, by the same operator with a conversation as the batch."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("seq"), "role")
    runs = strides.assign_strides(c, "lazy", F.col("role")).where("position = 0")
    return runs.select(F.col("batch_id").alias("conv_id"), F.col("stride_id").cast("long").alias("run"), F.col("head_seq").alias("first_turn"), "role", F.col("stride_size").alias("n_turns"))


# the flow table


@query(f"WITH {PACKETS}, {FLOW} SELECT seq, action FROM fw")
def firewall_actions(spark, sf):
    return flowtable.firewall(_packets(spark, sf), TIMEOUT).select("seq", "action")


@query(f"WITH {PACKETS}, {FLOW} SELECT device, action, count(*) AS n, sum(pkt_len)::BIGINT AS n_bytes FROM fw GROUP BY 1, 2")
def firewall_summary(spark, sf):
    return flowtable.firewall(_packets(spark, sf), TIMEOUT).groupBy("device", "action").agg(F.count("*").alias("n"), F.sum("pkt_len").alias("n_bytes"))


@query(f"WITH {PACKETS}, {FLOW} SELECT flow[1]::BIGINT AS user_ip, min(now_us) AS session_start, max(now_us) AS session_end, count(*) AS n_packets, sum(pkt_len)::BIGINT AS n_bytes FROM fw GROUP BY flow, session".replace("flow[1]", "struct_extract(flow, 1)"))
def flow_sessions(spark, sf):
    return flowtable.sessions(_packets(spark, sf), TIMEOUT).select(F.col("flow.src_ip").alias("user_ip"), "session_start", "session_end", "n_packets", "n_bytes")


_NOON = 1704240000000000  # 2024-01-03


@query(f"WITH {PACKETS}, {FLOW} SELECT struct_extract(flow, 1)::BIGINT AS user_ip, max(now_us) AS last_us, max(now_us) >= {_NOON} - {TIMEOUT} AS live FROM f WHERE now_us <= {_NOON} GROUP BY flow")
def table_at(spark, sf):
    p = _packets(spark, sf)
    live = flowtable.live_flows(p, _NOON, TIMEOUT).withColumn("live", F.lit(True))
    return live.unionByName(flowtable.expired_flows(p, _NOON, TIMEOUT).withColumn("live", F.lit(False))).select(F.col("flow.src_ip").alias("user_ip"), "last_us", "live")


@query(
    f"""WITH {PACKETS}, {FLOW}, s AS (SELECT flow, session, min(now_us) AS a, max(now_us) AS b FROM fw GROUP BY 1, 2), d AS (SELECT a AS t, 1 AS d FROM s UNION ALL SELECT b + {TIMEOUT} + 1, -1 FROM s),
g AS (SELECT t, sum(d) AS d FROM d GROUP BY 1), r AS (SELECT sum(d) OVER (ORDER BY t) AS n FROM g) SELECT max(n)::BIGINT AS most_flows, max(n) > 100 AS overfull FROM r"""
)
def table_pressure(spark, sf):
    return flowtable.overfull(_packets(spark, sf), 100, TIMEOUT)


@query()
def limited_table(spark, sf):
    """A table of 64 flows: who finds room depends on the order of all packets."""
    found = flowtable.limited_firewall(_packets(spark, sf), 64, TIMEOUT)
    return found.groupBy("device", "action").agg(F.count("*").alias("n"))


@query(f"WITH {PACKETS}, {FLOW} SELECT seq, action FROM fw")
def stream_firewall(spark, sf):
    """The firewall as a stateful stream, into the session's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidewheel-")
    return streams.drained(streams.firewall(source.events_as_stream(spark, sf), TIMEOUT), f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}")


def _telemetry_sql(rows: str) -> str:
    return f"""SELECT 'flow' AS kind, concat_ws(',', src_ip, dst_ip, src_port, dst_port) AS key, count(*) AS n FROM {rows} GROUP BY 2
UNION ALL SELECT 'ips', concat_ws(',', src_ip, dst_ip), count(*) FROM {rows} GROUP BY 2 UNION ALL SELECT 'ports', concat_ws(',', src_port, dst_port), count(*) FROM {rows} GROUP BY 2"""


def _plain_keys(df):
    return df.withColumn("key", F.regexp_replace("key", "[{} ]", ""))


@query(f"WITH {PACKETS} {_telemetry_sql('packets')}")
def telemetry_counts_packets(spark, sf):
    return _plain_keys(programs.telemetry(_packets(spark, sf)))


@query(f"WITH {PACKETS}, {LAZY}, heads AS (SELECT * FROM lz QUALIFY row_number() OVER (PARTITION BY batch_id, stride_id ORDER BY seq) = 1) {_telemetry_sql('heads')}")
def telemetry_counts_strides(spark, sf):
    return _plain_keys(programs.telemetry(_packets(spark, sf), "strides"))


@query(f"WITH {PACKETS} SELECT now_us // {24 * HOUR} AS window_id, 'ips' AS kind, concat_ws(',', src_ip, dst_ip) AS key, count(*) AS n FROM packets GROUP BY 1, 3")
def telemetry_by_window(spark, sf):
    return _plain_keys(programs.telemetry(_packets(spark, sf), interval_us=24 * HOUR)).where("kind = 'ips'")


# sketches


def _cells_sql(column: str, table: str, height: int, width: int, count: str) -> str:
    return " UNION ALL ".join(f"SELECT {r} AS row, (({core.A[r]} * ({column} % {core.P}) + {core.B[r]}) % {core.P}) % {width} AS cell, {count} FROM {table}" for r in range(height))


@query(
    f"""WITH c AS ({_cells_sql('l_partkey', 'lineitem', 4, 1024, '1 AS one')}), s AS (SELECT row, cell, count(*) AS count FROM c GROUP BY 1, 2), q AS (SELECT DISTINCT l_partkey AS key FROM lineitem),
a AS ({' UNION ALL '.join(f'SELECT key, {r} AS row, (({core.A[r]} * (key % {core.P}) + {core.B[r]}) % {core.P}) % 1024 AS cell FROM q' for r in range(4))})
SELECT key, min(count) AS estimate FROM a JOIN s USING (row, cell) GROUP BY 1"""
)
def count_min_estimate(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey")
    sketch = sketches.count_min(items, F.col("l_partkey"), 4, 1024)
    return sketches.estimate(sketch, items.select(F.col("l_partkey").alias("key")).distinct(), F.col("key"), 4, 1024)


@query(
    f"""WITH d AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT row, cell FROM ({_cells_sql('l_partkey', 'd', 3, 4096, '1')})),
a AS ({' UNION ALL '.join(f'SELECT p_partkey AS key, {r} AS row, (({core.A[r]} * (p_partkey % {core.P}) + {core.B[r]}) % {core.P}) % 4096 AS cell FROM part' for r in range(3))})
SELECT key, count(b.cell) = 3 AS member FROM a LEFT JOIN b USING (row, cell) GROUP BY 1"""
)
def bloom_membership(spark, sf):
    large = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 49")
    keys = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("key"))
    return sketches.maybe_in(sketches.bloom(large, F.col("l_partkey"), 3, 4096), keys, F.col("key"), 3, 4096)


@query("SELECT user_id AS key, count(*) AS weight FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32")
def top_k_flows(spark, sf):
    return sketches.top_k(spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id"), 32)


@query("SELECT event_type AS item, count(*) AS count FROM events GROUP BY 1")
def approximate_top_k(spark, sf):
    return sketches.approximate_top_k(spark.read.parquet(f"{sf}/events.parquet"), F.col("event_type"), 5)


@query("WITH c AS (SELECT user_id AS key, count(*) AS weight FROM events GROUP BY 1) SELECT key, weight, round(100.0 * weight / sum(weight) OVER (), 9) AS share, format('{:5.2f}%', 100.0 * weight / sum(weight) OVER ()) AS shown FROM c")
def heavy_hitter_share(spark, sf):
    counts = skew.flow_counts(spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id")).withColumnRenamed("n", "weight")
    found = sketches.shares(counts)
    return found.select("key", "weight", F.round("share", 9).alias("share"), core.percent(F.col("weight"), F.col("total")).alias("shown"))


# elephants and mice


@query(f"WITH {COUNTS} SELECT key, n, (SELECT median(n) FROM c) AS median, n >= 1.2 * (SELECT median(n) FROM c) AS elephant FROM c")
def elephants_by_median(spark, sf):
    return skew.elephants_by_median(skew.flow_counts(spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id")), 1.2)


@query(f"WITH {COUNTS}, {RANKED} SELECT key, n FROM r WHERE before < 0.8 * total")
def elephants_by_share(spark, sf):
    return skew.elephants_by_share(skew.flow_counts(spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id")), 0.8)


@query(f"WITH {COUNTS}, {RANKED} SELECT key, n, round(100.0 * rank / n_flows, 9) AS pct_flows, round((before + n) / total, 9) AS share FROM r")
def flow_cdf(spark, sf):
    found = skew.flow_cdf(skew.flow_counts(spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id")))
    return found.select("key", "n", F.round("pct_flows", 9).alias("pct_flows"), F.round("share", 9).alias("share"))


@query(
    f"""WITH {COUNTS}, e AS (SELECT n, n >= 1.2 * (SELECT median(n) FROM c) AS x FROM c), s AS (SELECT sum(CASE WHEN x THEN n ELSE 0 END) / sum(n) AS share, count(*) FILTER (x) AS n_elephants FROM e)
SELECT g.model, round(share, 9) AS share, n_elephants, round(share * g.e + (1 - share) * g.m, 9) AS speedup FROM s, (VALUES ('optimistic', 8.0, 32.0), ('conservative', 4.0, 1.5)) g(model, e, m)"""
)
def expected_speedup(spark, sf):
    counts = skew.flow_counts(spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id"))
    rows = [skew.expected_speedup(counts, e, m, 1.2).withColumn("model", F.lit(name)) for name, e, m in (("optimistic", 8.0, 32.0), ("conservative", 4.0, 1.5))]
    return rows[0].unionByName(rows[1]).select("model", F.round("share", 9).alias("share"), "n_elephants", F.round("speedup", 9).alias("speedup"))


LANES = f"WITH {PACKETS}, top AS (SELECT key, count(*) AS n FROM k WHERE seq < 4000 GROUP BY 1 ORDER BY n DESC, key LIMIT 32), l AS (SELECT k.*, CASE WHEN top.key IS NOT NULL AND proto = 17 THEN 'elephant' ELSE 'mice' END AS lane FROM k LEFT JOIN top USING (key))"


def _lanes(spark, sf):
    return skew.split_lanes(_packets(spark, sf), flow_key(), 32, phase=4000)


@query(f"{LANES} SELECT seq, lane, CASE WHEN seq < 4000 THEN 'sampling' ELSE 'steady' END AS phase FROM l")
def lane_split(spark, sf):
    return _lanes(spark, sf).select("seq", "lane", "phase")


@query(
    f"""{LANES}, n AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY seq) - 1 AS lane_seq FROM l), r AS (SELECT lane, lane_seq // 32 AS batch_id, CASE WHEN lane = 'mice' THEN seq END AS alone, key, count(*) AS stride_size FROM n GROUP BY ALL)
SELECT lane, count(*) AS n_strides, sum(stride_size)::BIGINT AS n_packets, max(stride_size) AS longest FROM r GROUP BY 1"""
)
def orchestrated_strides(spark, sf):
    runs = skew.run_lanes(_lanes(spark, sf), "sorted").where("position = 0")
    return runs.groupBy("lane").agg(F.count("*").alias("n_strides"), F.sum("stride_size").alias("n_packets"), F.max("stride_size").alias("longest"))


def _program(function: str, technique: str, **options):
    def run(spark, sf):
        found = programs.program(_packets(spark, sf), function, technique, timeout_us=TIMEOUT, **options)
        return found.groupBy("device", "action").agg(F.count("*").alias("n_packets"), F.count(F.when(F.col("position") == 0, 1)).alias("n_strides"))

    return run


_SWAP = "CASE WHEN device = 'LAN' THEN 'WAN' ELSE 'LAN' END"
_HEADS = {
    "baseline": "h AS (SELECT *, seq AS head FROM k)",
    "straw": "h AS (SELECT *, min(seq) OVER (PARTITION BY batch_id) AS head FROM k)",
    "lazy": f"{LAZY}, h AS (SELECT * EXCLUDE (brk), min(seq) OVER (PARTITION BY batch_id, stride_id) AS head FROM lz)",
    "greedy": "h AS (SELECT *, min(seq) OVER (PARTITION BY batch_id, key) AS head FROM k)",
    "sorted": "h AS (SELECT *, min(seq) OVER (PARTITION BY batch_id, key) AS head FROM k)",
}
_LANED = "n AS (SELECT * EXCLUDE (batch_id), (row_number() OVER (PARTITION BY lane ORDER BY seq) - 1) // 32 AS batch_id FROM l)"
_ADJACENT = """lb AS (SELECT *, CASE WHEN lag(key) OVER w IS DISTINCT FROM key AND lag(seq) OVER w IS NOT NULL THEN 1 ELSE 0 END AS brk FROM n WINDOW w AS (PARTITION BY lane, batch_id ORDER BY seq)),
lr AS (SELECT *, sum(brk) OVER (PARTITION BY lane, batch_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM lb)"""
_TO_CORE = "l AS (SELECT *, ('0x' || substr(md5(CASE WHEN device = 'LAN' THEN concat_ws(',', src_ip, dst_ip, src_port, dst_port) ELSE concat_ws(',', dst_ip, src_ip, dst_port, src_port) END), 1, 8))::BIGINT % 4 AS lane FROM k)"
_HEADS["multicore"] = f"{_TO_CORE}, {_LANED}, h AS (SELECT *, seq AS head FROM n)"
_HEADS["lazy_multicore"] = f"{_TO_CORE}, {_LANED}, {_ADJACENT}, h AS (SELECT * EXCLUDE (brk), min(seq) OVER (PARTITION BY lane, batch_id, run) AS head FROM lr)"
for _mode, _tracked in programs.TRACKED.items():
    _split = f"top AS (SELECT key, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, key LIMIT {_tracked}), l AS (SELECT k.*, CASE WHEN top.key IS NOT NULL AND proto = 17 THEN 'elephant' ELSE 'mice' END AS lane FROM k LEFT JOIN top USING (key)), {_LANED}"
    _within = {"greedy": "lane, batch_id, run", "sorted": "lane, batch_id, key", "straw": "lane, batch_id"}[_mode]
    _from = "lr" if _mode == "greedy" else "n"
    _cols = "* EXCLUDE (brk)" if _mode == "greedy" else "*"
    _HEADS[f"orchestrator_{_mode}"] = f"{_split}{', ' + _ADJACENT if _mode == 'greedy' else ''}, h AS (SELECT {_cols}, CASE WHEN lane = 'mice' THEN seq ELSE min(seq) OVER (PARTITION BY {_within}) END AS head FROM {_from})"
_FW_HEADS = FLOW.replace("FROM packets)", "FROM h WHERE seq = head)")


def _counting_program(technique: str):
    def run(spark, sf):
        found = programs.program(_packets(spark, sf), "telemetry", technique).where("position = 0")
        return _plain_keys(sketches.key_counts(found, {"ips": programs.telemetry_keys()["ips"]}))

    return run


for _t in programs.TECHNIQUES:
    QUERIES[f"program_telemetry_{_t}"] = _counting_program(_t)
    ORACLE_SQL[f"program_telemetry_{_t}"] = f"WITH {PACKETS}, {_HEADS[_t]} SELECT 'ips' AS kind, concat_ws(',', src_ip, dst_ip) AS key, count(*) AS n FROM h WHERE seq = head GROUP BY 2"
    QUERIES[f"program_nop_{_t}"] = _program("nop", _t)
    QUERIES[f"program_fw_{_t}"] = _program("fw", _t)
    _end = "SELECT h.device, d.action, count(*) AS n_packets, count(*) FILTER (h.seq = h.head) AS n_strides FROM h JOIN d ON d.seq = h.head GROUP BY 1, 2"
    ORACLE_SQL[f"program_nop_{_t}"] = f"WITH {PACKETS}, {_HEADS[_t]}, d AS (SELECT seq, {_SWAP} AS action FROM h WHERE seq = head) {_end}"
    ORACLE_SQL[f"program_fw_{_t}"] = f"WITH {PACKETS}, {_HEADS[_t]}, {_FW_HEADS}, d AS (SELECT seq, action FROM fw) {_end}"


# a flow table for each lane
_OWN_HEADS = _FW_HEADS.replace("PARTITION BY flow", "PARTITION BY lane, flow")
for _t in programs.TECHNIQUES[programs.TECHNIQUES.index("multicore") :]:
    QUERIES[f"program_fw_own_state_{_t}"] = _program("fw", _t, own_state=True)
    ORACLE_SQL[f"program_fw_own_state_{_t}"] = f"WITH {PACKETS}, {_HEADS[_t]}, {_OWN_HEADS}, d AS (SELECT seq, action FROM fw) {_end}"


@query(
    f"""{LANES} WHERE seq >= 4000), {_LANED}, h AS (SELECT *, CASE WHEN lane = 'mice' THEN seq ELSE min(seq) OVER (PARTITION BY lane, batch_id, key) END AS head FROM n), {_OWN_HEADS}, d AS (SELECT seq, action FROM fw),
e AS ({_end} UNION ALL SELECT device, 'DROP', count(*), 0 FROM k WHERE seq < 4000 GROUP BY 1) SELECT device, action, sum(n_packets)::BIGINT AS n_packets, sum(n_strides)::BIGINT AS n_strides FROM e GROUP BY 1, 2""".replace("USING (key)) WHERE", "USING (key) WHERE")
)
def program_fw_sampled(spark, sf):
    """The orchestrated firewall: 4,000 packets are sampled and dropped, then lanes run with tables of their own."""
    return _program("fw", "orchestrator_sorted", own_state=True, phase=4000)(spark, sf)


def _estimate_sql(rows: str, by: str, height: int, width: int) -> str:
    each = " UNION ALL ".join(f"SELECT *, {r} AS row, (({core.A[r]} * (x % {core.P}) + {core.B[r]}) % {core.P}) % {width} AS cell FROM hx" for r in range(height))
    return f"hx AS (SELECT *, ('0x' || substr(md5(key), 1, 8))::BIGINT AS x FROM {rows}), ce AS ({each}), cs AS (SELECT *, sum(n) OVER (PARTITION BY {by}row, cell) AS s FROM ce)"


_IPS = "'{' || src_ip || ', ' || dst_ip || '}'"


@query(f"WITH {PACKETS}, ct AS (SELECT now_us // {24 * HOUR} AS window_id, {_IPS} AS key, count(*) AS n FROM packets GROUP BY 1, 2), {_estimate_sql('ct', 'window_id, ', 3, 16)} SELECT window_id, 'ips' AS kind, key, min(s)::BIGINT AS estimate FROM cs GROUP BY 1, 3")
def telemetry_sketched(spark, sf):
    """Narrow sketches of address pairs, cleared every day."""
    return programs.sketched_telemetry(_packets(spark, sf), 24 * HOUR, 3, 16).where("kind = 'ips'")


@query(
    f"""WITH RECURSIVE {PACKETS}, t AS (SELECT DISTINCT now_us FROM packets), r(reset_us) AS (SELECT min(now_us) FROM t UNION ALL SELECT (SELECT min(now_us) FROM t WHERE now_us >= r.reset_us + {24 * HOUR}) FROM r WHERE r.reset_us IS NOT NULL),
a AS (SELECT reset_us FROM r WHERE reset_us IS NOT NULL), ct AS (SELECT (SELECT max(reset_us) FROM a WHERE reset_us <= now_us) AS window_id, {_IPS} AS key, count(*) AS n FROM packets GROUP BY 1, 2),
{_estimate_sql('ct', 'window_id, ', 3, 16)} SELECT window_id, 'ips' AS kind, key, min(s)::BIGINT AS estimate FROM cs GROUP BY 1, 3"""
)
def telemetry_sketched_anchored(spark, sf):
    """The same, cleared at the first packet a day after the last time."""
    return programs.sketched_telemetry(_packets(spark, sf), 24 * HOUR, 3, 16, anchored=True).where("kind = 'ips'")


@query(f"WITH ct AS (SELECT user_id::VARCHAR AS key, count(*) AS n FROM events GROUP BY 1), {_estimate_sql('ct', '', 2, 64)} SELECT key, min(s)::BIGINT AS estimate FROM cs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32")
def top_k_sketched(spark, sf):
    return sketches.top_k_sketched(spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id"), 32, 2, 64)


@query(
    f"""WITH w AS (SELECT DISTINCT epoch_us(ts) // {24 * HOUR} AS window_id, user_id AS key, event_type FROM events), x AS (SELECT * FROM w WHERE event_type = 'login'),
b AS (SELECT DISTINCT window_id, row, cell FROM ({' UNION ALL '.join(f'SELECT window_id, {r} AS row, (({core.A[r]} * (key % {core.P}) + {core.B[r]}) % {core.P}) % 128 AS cell FROM x' for r in range(3))})),
a AS ({' UNION ALL '.join(f"SELECT window_id, key, {r} AS row, (({core.A[r]} * (key % {core.P}) + {core.B[r]}) % {core.P}) % 128 AS cell FROM w WHERE event_type = 'error'" for r in range(3))})
SELECT window_id, key, count(b.cell) = 3 AS member FROM a LEFT JOIN b USING (window_id, row, cell) GROUP BY 1, 2"""
)
def bloom_by_window(spark, sf):
    """Whether users with an error logged in on the same day, by a filter that is cleared every day."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (24 * HOUR)).cast("long").alias("window_id"))
    asked = e.where("event_type = 'error'").select("window_id", F.col("user_id").alias("key")).distinct()
    filters = sketches.bloom(e.where("event_type = 'login'"), F.col("user_id"), 3, 128, F.col("window_id"))
    return sketches.maybe_in(filters, asked, F.col("key"), 3, 128)


# windows, limits, hashing


@query(
    f"""WITH RECURSIVE t AS (SELECT DISTINCT epoch_us(ts) AS now_us FROM events), r(reset_us) AS (SELECT min(now_us) FROM t UNION ALL SELECT (SELECT min(now_us) FROM t WHERE now_us >= r.reset_us + {24 * HOUR}) FROM r WHERE r.reset_us IS NOT NULL),
a AS (SELECT reset_us FROM r WHERE reset_us IS NOT NULL) SELECT event_id AS seq, (SELECT max(reset_us) FROM a WHERE reset_us <= epoch_us(ts)) AS reset_us FROM events"""
)
def reset_windows(spark, sf):
    return windows.with_reset_window(_packets(spark, sf), 24 * HOUR).select("seq", "reset_us")


@query("WITH t AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS window_id, user_id FROM events) SELECT window_id, count(*) AS n_users FROM t GROUP BY 1")
def fixed_windows(spark, sf):
    return windows.fixed_window(_packets(spark, sf).withColumn("user", F.when(F.col("device") == LAN, F.col("src_ip")).otherwise(F.col("dst_ip"))), 24 * HOUR).groupBy("window_id").agg(F.countDistinct("user").alias("n_users"))


@query(
    f"""WITH RECURSIVE {PACKETS}, e AS (SELECT user_id AS key, seq, now_us, pkt_len, row_number() OVER (PARTITION BY user_id ORDER BY now_us, seq) AS i FROM packets),
r AS (SELECT key, seq, now_us, i, TRUE AS passes, greatest(200 - pkt_len, 0)::BIGINT AS tokens FROM e WHERE i = 1
UNION ALL SELECT e.key, e.seq, e.now_us, e.i, e.now_us - r.now_us > 200000000000 OR h.have > e.pkt_len,
  CASE WHEN e.now_us - r.now_us > 200000000000 THEN greatest(200 - e.pkt_len, 0) WHEN h.have > e.pkt_len THEN h.have - e.pkt_len ELSE h.have END::BIGINT
  FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1, LATERAL (SELECT least(200, r.tokens + ((e.now_us - r.now_us) // 1000000000))::BIGINT AS have) h)
SELECT seq, key, passes FROM r""".replace("200000000000", str(200 * 1_000_000_000))
)
def token_bucket(spark, sf):
    """One byte a thousand seconds, 200 at most; time runs a thousandfold slower, so that the table's pauses matter."""
    slow = _packets(spark, sf).withColumn("user", F.when(F.col("device") == LAN, F.col("src_ip")).otherwise(F.col("dst_ip"))).withColumn("now_us", F.expr("now_us div 1000"))
    return limiter.token_bucket(slow, F.col("user"), 1, 200)


@query("WITH v AS (SELECT i, j, (31 * j % 31 + (j % 30 + 1) * i) % 31 AS bucket FROM range(31) a(i), range(5) b(j)) SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY i, j) - 1 AS prio, j AS backend FROM v")
def consistent_hash_table(spark, sf):
    return chash.build_table(spark, 31, 5)


@query(
    """WITH v AS (SELECT i, j, (31 * j % 31 + (j % 30 + 1) * i) % 31 AS bucket FROM range(31) a(i), range(5) b(j)), t AS (SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY i, j) - 1 AS prio, j AS backend FROM v),
f AS (SELECT bucket, arg_min(backend, prio) AS backend FROM t WHERE backend IN (0, 2, 3) GROUP BY 1) SELECT o_orderkey AS key, f.bucket, f.backend FROM orders LEFT JOIN f ON f.bucket = o_orderkey % 31"""
)
def consistent_hash_route(spark, sf):
    active = spark.createDataFrame([(0,), (2,), (3,)], "backend long")
    keys = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("key"))
    return chash.route(keys, F.col("key"), chash.build_table(spark, 31, 5), active, 31)


# generated traffic

_DRAW = "(('0x' || substr(md5('{salt}' || i::VARCHAR), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE"


@query(f"SELECT i AS seq, floor({_DRAW.format(salt='u')} * 1000)::BIGINT AS flow FROM range(20000) r(i)")
def uniform_flows(spark, sf):
    return traffic.uniform_flows(spark.range(20_000).withColumnRenamed("id", "seq"), 1000)


@query(
    f"WITH w AS (SELECT k, sum(1.0::DOUBLE / (k + 1)) OVER (ORDER BY k) / (SELECT sum(1.0::DOUBLE / (x + 1)) FROM range(1000) q(x)) AS c FROM range(1000) r(k)), u AS (SELECT i, {_DRAW.format(salt='z')} AS u FROM range(5000) r(i)) SELECT i AS seq, (SELECT least(count(*), 999) FROM w WHERE c <= u) AS flow FROM u"
)
def zipf_flows(spark, sf):
    return traffic.zipf_flows(spark.range(5000).withColumnRenamed("id", "seq"), 1000, 1.0)


@query(
    f"""WITH e AS (SELECT unnest([0.4, 0.8, 1.0, 1.2])::DOUBLE AS zipf), w AS (SELECT zipf, k, sum(pow((k + 1)::DOUBLE, -zipf)) OVER (PARTITION BY zipf ORDER BY k) AS c FROM e, range(40000) r(k)),
t AS (SELECT zipf, k, coalesce(lag(c) OVER (PARTITION BY zipf ORDER BY k), 0) AS low FROM w), total AS (SELECT zipf, max(c) AS total FROM w GROUP BY 1),
u AS (SELECT i, {_DRAW.format(salt='z')} AS u FROM range(20000) r(i)), goal AS (SELECT i, zipf, u * total AS goal FROM u, total),
f AS (SELECT i, goal.zipf, k AS flow FROM goal ASOF JOIN t ON goal.zipf = t.zipf AND goal.goal >= t.low UNION ALL SELECT i, 0, floor(u * 40000)::BIGINT FROM u),
g AS (SELECT zipf, i // 32 AS b, flow, count(*) AS n FROM f GROUP BY ALL) SELECT zipf, avg(n) AS mean_stride, count(*) AS n_strides FROM g GROUP BY 1"""
)
def zipf_sweep(spark, sf):
    rows = traffic.sweep(spark.range(20_000).withColumnRenamed("id", "seq"), 40_000, [0.0, 0.4, 0.8, 1.0, 1.2])
    runs = strides.grouped_strides(rows.withColumn("batch", F.col("zipf")), F.struct("zipf", "flow"))
    return runs.groupBy("key.zipf").agg(F.avg("stride_size").alias("mean_stride"), F.count("*").alias("n_strides"))


@query(f"SELECT i AS seq, floor({_DRAW.format(salt='7:u')} * 1000)::BIGINT AS src_ip, CASE WHEN {_DRAW.format(salt='7:k')} < 0.9 THEN 'get' ELSE 'put' END AS op FROM range(20000) r(i)")
def generated_requests(spark, sf):
    """Requests to a key-value store, nine of ten of them reads, drawn with a seed."""
    return traffic.packets(spark, 20_000, 1000, seed=7, get_ratio=0.9).select("seq", "src_ip", "op")


@query()
def generated_gain(spark, sf):
    """Mean run of skewed traffic with and without a logical batch."""
    out = None
    for batch in (1, 64):
        p = traffic.packets(spark, 32_000, 1000, 0.99, logical_batch=batch)
        one = strides.strides(p, "lazy").agg(F.avg("stride_size").alias("mean_stride")).select(F.lit(batch).alias("logical_batch"), "mean_stride")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def vector_sample(spark, sf):
    return flowtable.sample_above(spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("value").cast("long").alias("value")), 100, 20)


# benchmark results: rows of recorded runs

_RUNS = [
    ("univ2_pt0-single-core-fw.csv", 12_690_000, 6_090_000_000),
    ("univ2_pt0-single-core-fw.csv", 12_750_000, 6_120_000_000),
    ("univ2_pt0-single-core-fw_batch_lazy-lbatch4096.csv", 30_740_000, 14_750_000_000),
    ("univ2_pt0-single-core-fw_batch_greedy-lbatch4096.csv", 29_850_000, 14_330_000_000),
    ("univ2_pt0-single-core-nop_batch_sorted-lbatch64.csv", 23_540_000, 11_300_000_000),
    ("notes.csv", 1, 1),
]
_RUNS_SQL = ", ".join(f"('{f}', {p}, {b})" for f, p, b in _RUNS)


@query(
    f"""WITH r AS (SELECT regexp_extract(file, '^(.+)-single-core-(fw|nop|telemetry)(_batch_([a-z]+))?(-lbatch([0-9]+))?\\.csv$', ['trace', 'nf', 'x', 't', 'y', 'l']) AS p, pps, bps FROM (VALUES {_RUNS_SQL}) v(file, pps, bps))
SELECT p.trace AS trace, p.nf AS nf, CASE WHEN p.t = '' THEN 'baseline' ELSE p.t END AS technique, try_cast(nullif(p.l, '') AS INT) AS lbatch, round(avg(pps / 1e6), 9) AS mpps_mean, round(stddev_pop(pps / 1e6), 9) AS mpps_std,
  round(avg(bps / 1e6), 9) AS mbps_mean, round(stddev_pop(bps / 1e6), 9) AS mbps_std, count(*) AS n FROM r WHERE p.trace <> '' GROUP BY 1, 2, 3, 4"""
)
def bench_stats(spark, sf):
    rows = results.file_fields(spark.createDataFrame(_RUNS, "file string, pps long, bps long"))
    found = stats.mean_and_std(rows, ["trace", "nf", "technique", "lbatch"])
    return found.select("trace", "nf", "technique", "lbatch", *[F.round(c, 9).alias(c) for c in ("mpps_mean", "mpps_std", "mbps_mean", "mbps_std")], "n")


_REPORT = "Stable report:\r\n  TX  {t} pkts  {tb} bytes\r\n  RX  {r} pkts  {rb} bytes\r\n  Elapsed  {e} seconds\r\n"


@query("SELECT i AS it, 1000 * (i + 1) AS tx_pkts, 64000 * (i + 1) AS tx_bytes, 900 * (i + 1) AS rx_pkts, 57600 * (i + 1) AS rx_bytes, 2.5::DOUBLE AS elapsed, 184320 * (i + 1) AS bps, 360 * (i + 1) AS pps, round(0.1::DOUBLE, 9) AS loss FROM range(4) r(i)")
def bench_report(spark, sf):
    rows = [(i, _REPORT.format(t=1000 * (i + 1), tb=64000 * (i + 1), r=900 * (i + 1), rb=57600 * (i + 1), e="2.5")) for i in range(4)]
    return results.parse_bench_report(spark.createDataFrame(rows, "it long, report string")).withColumn("loss", F.round("loss", 9))


@query("SELECT * FROM (VALUES (1, 1, 30), (1, 2, 0), (1, 3, 7), (2, 1, 0), (2, 2, 5)) v(run_id, stride_size, n_strides)")
def stride_report(spark, sf):
    rows = [(1, "Stride size 1: 30 packets\nStride size 3: 7 packets"), (2, "Stride size 2: 5 packets"), (3, "nothing")]
    return results.parse_stride_report(spark.createDataFrame(rows, "run_id int, report string"))


@query("SELECT n AS n, CASE WHEN n <= 0 THEN 1 ELSE 1 << (floor(log2(n))::INT + 1) END::BIGINT AS next_pow2, (n & (n - 1)) = 0 AS is_pow2, n > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 400) d(d) WHERE d.d < n AND n % d.d = 0) AS is_prime FROM range(400) r(n)")
def integer_functions(spark, sf):
    n = spark.range(400).withColumnRenamed("id", "n")
    return n.select("n", core.next_power_of_two(F.col("n")).alias("next_pow2"), core.is_power_of_two(F.col("n")).alias("is_pow2"), core.is_prime(F.col("n")).alias("is_prime"))


@query(
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 100))::INT + 1, 100) AS bin, count(*) AS n FROM events, b GROUP BY 1"""
)
def value_histogram(spark, sf):
    return stats.histogram(spark.read.parquet(f"{sf}/events.parquet"), "value", 100)


@query(
    "WITH g AS (SELECT t.t AS event_type, w.w AS hour FROM (SELECT unnest(['click', 'error', 'login', 'view']) AS t) t, range(24) w(w)), c AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2) SELECT g.event_type, g.hour::INT AS hour, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (event_type, hour)"
)
def filled_grid(spark, sf):
    counts = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return stats.filled_grid(counts, {"event_type": ["click", "error", "login", "view"], "hour": list(range(24))}, ["n"])


# functions of the user's own, run by a technique


@query(f"WITH {PACKETS}, {_HEADS['lazy']}, d AS (SELECT seq, CASE WHEN pkt_len > 50 THEN 'DROP' ELSE {_SWAP} END AS action FROM h WHERE seq = head) {_end}")
def program_user_expression(spark, sf):
    """A function of one packet: long ones are dropped, others forwarded."""
    swap = F.when(F.col("device") == LAN, WAN).otherwise(LAN)
    return _program(F.when(F.col("pkt_len") > 50, DROP).otherwise(swap), "lazy")(spark, sf)


@query(f"WITH {PACKETS}, {_HEADS['greedy']}, d AS (SELECT seq, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY seq) > 3 THEN 'DROP' ELSE {_SWAP} END AS action FROM h WHERE seq = head) {_end}")
def program_user_state(spark, sf):
    """A function with state: of a flow three runs are forwarded, later ones dropped."""

    def three(heads: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(flow_key()).orderBy("seq"))
        return heads.withColumn("action", F.when(nth > 3, DROP).when(F.col("device") == LAN, WAN).otherwise(LAN))

    return _program(three, "greedy")(spark, sf)


# relational categories over the star schema, beside the flow engine


def _t(spark, sf, *names):
    return [spark.read.parquet(f"{sf}/{n}.parquet") for n in names]


@query(
    "SELECT r_name, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"
)
def star_join(spark, sf):
    o, c, n, r = _t(spark, sf, "orders", "customer", "nation", "region")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def returns_cube(spark, sf):
    (x,) = _t(spark, sf, "lineitem")
    return x.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_anti_join(spark, sf):
    c, o = _t(spark, sf, "customer", "orders")
    has = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return c.select("c_custkey").join(has("F"), "c_custkey", "left_semi").join(has("P"), "c_custkey", "left_anti")


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, sf):
    s, c, n = _t(spark, sf, "supplier", "customer", "nation")
    both = s.select(F.col("s_nationkey").alias("nation")).intersect(c.where("c_acctbal < 0").select("c_nationkey"))
    return both.subtract(n.where("n_regionkey = 0").select("n_nationkey"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_orders(spark, sf):
    (o,) = _t(spark, sf, "orders")
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("rn", rn).where("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1")
def outer_join_counts(spark, sf):
    n, s = _t(spark, sf, "nation", "supplier")
    return n.join(s, (s.s_nationkey == n.n_nationkey) & (s.s_acctbal > 0), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n_suppliers"))


@query("SELECT band, count(*) AS n FROM orders JOIN (VALUES (0, 0, 1000), (1, 1000, 50000), (2, 50000, 200000), (3, 200000, 1000000000)) b(band, low, high) ON o_totalprice >= low AND o_totalprice < high GROUP BY 1")
def range_join(spark, sf):
    """Bands that do not overlap: a row's band is known by its place among their lower bounds, so the join has a key."""
    (o,) = _t(spark, sf, "orders")
    rows = [(0, 0, 1000), (1, 1000, 50_000), (2, 50_000, 200_000), (3, 200_000, 1_000_000_000)]
    place = F.size(F.filter(F.array(*[F.lit(low) for _, low, _ in rows]), lambda low: low <= F.col("o_totalprice"))) - 1
    bands = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, band int, low long, high long")
    return o.withColumn("place", place).join(F.broadcast(bands), "place").where("o_totalprice < high").groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, (SELECT epoch_us(max(l.ts)) FROM events l WHERE l.user_id = e.user_id AND l.event_type = 'login' AND l.ts <= e.ts) AS login_us FROM events e WHERE e.event_type = 'error'")
def asof_join(spark, sf):
    """Of each error the last login of its user: one sort by (user, time), no join."""
    (e,) = _t(spark, sf, "events")
    e = e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    upto = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    return e.withColumn("login_us", F.max(F.when(F.col("event_type") == "login", F.col("us"))).over(upto)).where("event_type = 'error'").select("event_id", "login_us")


@query("SELECT e.event_id, count(c.event_id) AS n_clicks FROM events e LEFT JOIN events c ON c.user_id = e.user_id AND c.event_type = 'click' AND epoch_us(c.ts) BETWEEN epoch_us(e.ts) - 3600000000 AND epoch_us(e.ts) WHERE e.event_type = 'error' GROUP BY 1")
def interval_join(spark, sf):
    """Clicks of the hour before each error: joined by user and hour, of which an interval meets two."""
    (e,) = _t(spark, sf, "events")
    e = e.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("h", F.floor(F.col("us") / HOUR))
    errors = e.where("event_type = 'error'").withColumn("h", F.explode(F.array(F.col("h"), F.col("h") - 1))).drop("event_type")
    clicks = e.where("event_type = 'click'").select("user_id", "h", F.col("us").alias("at"))
    met = errors.join(clicks, ["user_id", "h"], "left")
    return met.groupBy("event_id").agg(F.count(F.when(F.col("at").between(F.col("us") - HOUR, F.col("us")), 1)).alias("n_clicks"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n_day FROM events")
def range_frame(spark, sf):
    (e,) = _t(spark, sf, "events")
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-24 * HOUR, 0)
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count("*").over(day).alias("n_day"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def orders_rollup(spark, sf):
    (o,) = _t(spark, sf, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf):
    (o,) = _t(spark, sf, "orders")
    keys = [F.col("o_orderstatus"), F.col("o_orderpriority")]
    return o.groupingSets([keys[:1], keys[1:], []], *keys).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity < 20 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity >= 30")
def except_all(spark, sf):
    (x,) = _t(spark, sf, "lineitem")
    return x.where("l_quantity < 20").select(F.col("l_suppkey").alias("k")).exceptAll(x.where("l_quantity >= 30").select("l_suppkey"))


@query("SELECT n_name, s_suppkey FROM (SELECT * FROM nation WHERE n_regionkey < 2) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON s_nationkey = n_nationkey")
def full_outer_join(spark, sf):
    n, s = _t(spark, sf, "nation", "supplier")
    return n.where("n_regionkey < 2").join(s.where("s_acctbal > 9000"), F.col("s_nationkey") == F.col("n_nationkey"), "full").select("n_name", "s_suppkey")


_ABOVE = "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey)"


@query(_ABOVE)
def correlated_subquery(spark, sf):
    (c,) = _t(spark, sf, "customer")
    c.createOrReplaceTempView("tw_customer")
    return spark.sql(_ABOVE.replace("customer", "tw_customer"))


_STEPS = "WITH RECURSIVE s(n, size) AS (SELECT 0, 1::BIGINT UNION ALL SELECT n + 1, size * 2 FROM s WHERE n < 12) SELECT n, size FROM s"


@query(_STEPS)
def recursive_sizes(spark, sf):
    return spark.sql(_STEPS)


@query("SELECT event_type, round(exp(avg(ln(1 + abs(value)))), 6) AS mean FROM events GROUP BY 1")
def user_aggregate(spark, sf):
    """An aggregate of the user's own, over Arrow batches of a group: the geometric mean."""

    @F.pandas_udf("double")
    def geometric(x: pd.Series) -> float:
        return float(np.exp(np.log1p(x.abs()).mean()))

    (e,) = _t(spark, sf, "events")
    return e.groupBy("event_type").agg(F.round(geometric("value"), 6).alias("mean"))


@query("SELECT n_nationkey, i AS place, n_name[i + 1] AS letter FROM nation, range(40) r(i) WHERE i < length(n_name)")
def user_table_function(spark, sf):
    """A table function of the user's own, joined laterally: the letters of a name."""

    @F.udtf(returnType="place long, letter string")
    class Letters:
        def eval(self, name: str):
            yield from enumerate(name or "")

    (n,) = _t(spark, sf, "nation")
    return n.lateralJoin(Letters(F.col("n_name").outer())).select("n_nationkey", "place", "letter")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def sorted_places(spark, sf):
    """A global sort and each row's place in it: sums over parts of the range first, then within a part."""
    (c,) = _t(spark, sf, "customer")
    cuts = c.agg(F.percentile_approx("c_acctbal", [i / 64 for i in range(1, 64)])).first()[0] or [0.0]
    part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x > F.col("c_acctbal")))
    rows = c.select("c_custkey", "c_acctbal", part.alias("part"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", ahead.alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return rows.withColumn("nth", nth).join(parts, "part").select("c_custkey", (F.col("ahead") + F.col("nth")).alias("place"))
