"""Sources, sinks, generators, streams, and the entry points."""

import os
import shutil
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import flowtable, strides
from tidewheel.schema import PACKET
from tidewheel.sources import packets as source
from tidewheel.sources import results, traffic
from tidewheel.streaming import streams

from .test_flow import packets as make
from .test_flow import traffic as some_traffic

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def frame(proto=17, kind=0x0800, options=0):
    ip = struct.pack(">BBHHHBBH4s4s", 0x40 | (5 + options), 0, 46, 0, 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([192, 168, 0, 9])) + b"\0" * 4 * options
    return b"\2" * 12 + struct.pack(">H", kind) + ip + struct.pack(">HH", 5555, 443) + b"\0" * 8


def test_headers(spark):
    raw = [(0, frame()), (1, frame(6, options=2)), (2, frame(1)), (3, frame(kind=0x86DD)), (4, frame()[:30]), (5, b""), (6, None)]
    got = {r.seq: tuple(r)[1:6] for r in source.parse_headers(spark.createDataFrame(raw, "seq long, pkt binary")).collect()}
    full = (167772161, 3232235529, 5555, 443)
    assert got[0] == (17, *full) and got[1] == (6, *full) and all(got[i] == (0, 0, 0, 0, 0) for i in range(2, 7))


def test_captures(spark, tmp_path):
    for name, n in (("a.pcap", 3), ("b.pcap", 2)):
        body = b"".join(struct.pack("<IIII", 7, i, len(frame()), 99) + frame() for i in range(n))
        (tmp_path / name).write_bytes(b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + body)
    df = source.captures(spark, [str(tmp_path / "a.pcap"), str(tmp_path / "b.pcap")])
    assert [r.now_us for r in df.orderBy("seq").collect()] == [7_000_000, 7_000_001, 7_000_002, 7_000_000, 7_000_001]
    assert {(r.src_port, r.pkt_len) for r in source.parse_headers(df).collect()} == {(5555, 99)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "LAN"), (2, "DROP"), (3, "WAN")], "seq long, action string")
    source.send(df, str(tmp_path / "out"))
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]
    rows = spark.createDataFrame([(i, 1, 10 * i, i) for i in range(4)], results.MULTI)
    results.append_missing(rows.where("it < 2"), str(tmp_path / "res"), ["it", "nb_cores"])
    results.append_missing(rows, str(tmp_path / "res"), ["it", "nb_cores"])
    assert spark.read.parquet(str(tmp_path / "res")).count() == 4
    assert source.flood(df.withColumn("device", F.lit("LAN")), ["LAN", "WAN"]).count() == 3


def test_result_files(spark, tmp_path):
    (tmp_path / "zipf-s0-99-f10-single-core-fw_batch_lazy-lbatch64.csv").write_text("#it, tput (bps), tput (pps)\n0,100,10\n1,300,30\n")
    (tmp_path / "univ2-single-core-nop.csv").write_text("#it, tput (bps), tput (pps)\n0,5,6\n")
    got = {(r.trace, r.nf, r.technique, r.lbatch, r.it, r.pps) for r in results.read_single(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("zipf-s0-99-f10", "fw", "lazy", 64, 0, 10), ("zipf-s0-99-f10", "fw", "lazy", 64, 1, 30), ("univ2", "nop", "baseline", None, 0, 6)}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "univ2-multi-core-fw_batch_lazy_multicore-lbatch4096.csv").write_text("#it, nb_cores, tput (bps), tput (pps)\n0,2,5,6\n")
    r = results.read_multi(spark, str(tmp_path / "m")).first()
    assert (r.trace, r.nf, r.technique, r.lbatch, r.nb_cores) == ("univ2", "fw", "lazy", 4096, 2)
    hist = spark.createDataFrame([(1, 1, 5), (1, 3, 9), (2, 1, 7)], "run_id int, stride_size int, n long")
    assert [(r.stride_size, r.n) for r in results.latest_histogram(hist).orderBy("stride_size").collect()] == [(1, 7), (2, 0), (3, 9)]
    (tmp_path / "hist.csv").write_text("# stride_size,count\n1,5\n3,9\n# stride_size,count\n1,7\n")
    assert [(r.stride_size, r.n) for r in results.read_stride_csv(spark, str(tmp_path / "hist.csv")).orderBy("stride_size").collect()] == [(1, 7), (2, 0), (3, 9)]
    stats = results.parse_stats_report(spark.createDataFrame([("~~~~~~ Totals ~~~~~~\r\n  TX: 10 pkts 640 bytes\r\n  RX: 9 pkts 576 bytes",)], "report string")).first()
    assert tuple(stats) == (10, 640, 9, 576)


def test_generators(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "seq")
    u = np.bincount([r.flow for r in traffic.uniform_flows(rows, 10).collect()], minlength=10)
    assert u.min() > 1800
    for s in (0.5, 1.0, 1.5):
        got = np.bincount([r.flow for r in traffic.zipf_flows(rows, 50, s).collect()], minlength=50) / 20_000
        want = np.arange(1, 51, dtype=float) ** -s
        assert np.abs(got - want / want.sum()).max() < 0.015
        # the law is the same whether a flow's weight is tabled or summed by formula
        law = traffic.Zipf(3 * traffic.TABLED, s)
        whole = np.cumsum(np.arange(1, 3 * traffic.TABLED + 1, dtype=float) ** -s)
        at = np.array([1, 2, traffic.TABLED, traffic.TABLED + 1, traffic.TABLED + 77, 3 * traffic.TABLED])
        assert np.allclose(law.weight(at), whole[at - 1], rtol=1e-12, atol=0)
        u = np.linspace(0, 1, 5001)[:-1] + 1e-5
        exact = np.searchsorted(whole, u * whole[-1], "right")
        assert np.abs(law.pick(u) - exact).max() <= 1 and (law.pick(u) == exact).mean() > 0.999
    assert traffic.zipf_flows(rows, 10, 0.0).where("flow < 0 OR flow > 9").count() == 0
    p = traffic.packets(spark, 640, 100, 0.9, logical_batch=64)
    assert {r.stride_size for r in strides.strides(p, "lazy").collect()} == {32}


def test_rate_stream(spark, tmp_path):
    q = traffic.rate_stream(spark, 1000, 50, churn_per_minute=100).writeStream.format("memory").queryName("rate").option("checkpointLocation", str(tmp_path / "c")).start()
    while not spark.table("rate").count():
        q.processAllAvailable()
    q.stop()
    got = spark.table("rate")
    assert got.schema.simpleString() == spark.createDataFrame([], PACKET).schema.simpleString()
    assert got.agg(F.max(F.col("dst_ip") - F.col("src_ip"))).first()[0] == 1 << 24


@pytest.fixture
def stream_dir(spark, tmp_path):
    rows = [r for r in some_traffic(11, 400) if r[3] in (6, 17)]
    for i in range(4):
        make(spark, rows[i * 100 : (i + 1) * 100]).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    (tmp_path / "in").mkdir()
    for i in range(4):
        target = tmp_path / "in" / f"{i}.parquet"
        shutil.copy(next((tmp_path / f"p{i}").glob("*.parquet")), target)
        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    return rows, str(tmp_path / "in"), tmp_path


def run(df, sink, check, mode="append"):
    q = df.writeStream.format("memory").queryName(sink).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(sink)


def test_streaming_firewall_equals_batch(spark, stream_dir):
    rows, path, tmp = stream_dir
    stream = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.seq: r.action for r in run(streams.firewall(stream, 12), "fw", str(tmp / "c1")).collect()}
    assert got == {r.seq: r.action for r in flowtable.firewall(make(spark, rows), 12).collect()}


def test_streaming_sessions_equal_batch(spark, stream_dir):
    rows, path, tmp = stream_dir
    stream = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(streams.sessions(stream, 12, "1 second"), "sess", str(tmp / "c2"), "append")
    assert got.count() <= flowtable.sessions(make(spark, rows), 12).count()
    batch = {(r.session_start, r.session_end, r.n_packets) for r in streams.sessions(make(spark, rows), 12).collect()}
    assert batch == {(r.session_start, r.session_end, r.n_packets) for r in flowtable.sessions(make(spark, rows), 12).collect()}


def test_streaming_counts_and_runs(spark, stream_dir):
    rows, path, tmp = stream_dir
    stream = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(streams.windowed_counts(stream, "100 microseconds", "10 seconds"), "win", str(tmp / "c3"), "update")
    assert got.agg(F.max("n_packets")).first()[0] >= 1
    q = stream.writeStream.foreachBatch(streams.strides_to(str(tmp / "runs"))).option("checkpointLocation", str(tmp / "c4")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp / "runs")).agg(F.sum("stride_size")).first()[0] == len(rows)


def test_entry_works_without_the_text_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=copy, capture_output=True, text=True, timeout=120)
    n, m, there = said.stdout.split()
    assert int(n) > 50 and int(m) > 40 and there == "False"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 32
    assert set(e.oracle_sql()) <= set(e.queries())
