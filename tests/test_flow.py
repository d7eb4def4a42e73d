"""The flow engine against sequential simulations of its semantics."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import core
from tidewheel.operators import chash, flowtable, limiter, sketches, skew, stats, strides, windows
from tidewheel.plans import programs
from tidewheel.schema import PACKET, canonical_key, flow_key, inverted_key


def packets(spark, rows):
    """rows: (seq, now, device, proto, src, dst, sport, dport, len)"""
    return spark.createDataFrame(rows, PACKET).repartition(3)


def traffic(seed, n, flows=6, step=12):
    rng, now, rows = random.Random(seed), 0, []
    for i in range(n):
        now += rng.choice([0, 1, 3, step - 2, step, step + 1]) if rng.random() < 0.5 else 0
        f, lan = rng.randrange(flows), rng.random() < 0.4
        a, b = (f, 1000 + f % 3), (40 + f, 80)
        ends = (*a, *b) if lan else (a[1], a[0], b[1], b[0])
        rows.append((i, now, "LAN" if lan else "WAN", rng.choice([6, 17, 17, 1]) if rng.random() < 0.2 else 17, *ends, rng.randrange(120)))
    return rows


def simulated_strides(keys, mode):
    """(stride_id, size) per packet of one batch."""
    if mode == "baseline":
        ids = list(range(len(keys)))
    elif mode == "straw":
        ids = [0] * len(keys)
    elif mode == "lazy":
        ids = [0]
        for a, b in zip(keys, keys[1:], strict=False):
            ids.append(ids[-1] + (a != b))
    else:
        order = sorted(set(keys), key=keys.index) if mode == "greedy" else sorted(set(keys), reverse=True)
        ids = [order.index(k) for k in keys]
    sizes = Counter(ids)
    return [(i, sizes[i]) for i in ids]


@pytest.mark.parametrize("mode", strides.MODES)
def test_strides(spark, mode):
    rows = traffic(1, 300)
    got = {r.seq: (r.stride_id, r.stride_size) for r in strides.assign_strides(packets(spark, rows), mode).collect()}
    for b in range(0, 300, 32):
        part = rows[b : b + 32]
        assert [got[r[0]] for r in part] == simulated_strides([r[4:8] for r in part], mode)


def test_golden_strides(spark):
    df = spark.createDataFrame(list(enumerate("AABABBC")), "seq long, k string")
    sizes = lambda mode: [r.stride_size for r in strides.strides(df, mode, F.col("k")).orderBy("batch_id", "stride_id").collect()]
    assert sizes("lazy") == [2, 1, 1, 2, 1] and sizes("greedy") == [3, 3, 1] and sizes("sorted") == [1, 3, 3] and sizes("straw") == [7]
    hist = strides.stride_histogram(strides.strides(df, "lazy", F.col("k")))
    assert hist.count() == 32 and strides.mean_stride(hist).first()[0] == pytest.approx(1.4)
    same = spark.range(33).select(F.col("id").alias("seq"), F.lit("A").alias("k"))
    assert sorted(r.stride_size for r in strides.strides(same, "lazy", F.col("k")).collect()) == [1, 32]
    assert strides.mean_stride(strides.stride_histogram(strides.strides(df.limit(0), "lazy", F.col("k")))).first()[0] == 0


def simulated_firewall(rows, timeout, capacity=None):
    table, out = {}, {}
    for seq, now, device, proto, a, b, c, d, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        table = {k: t for k, t in table.items() if t >= now - timeout}
        if proto not in (6, 17):
            out[seq] = "DROP"
            continue
        key = (a, b, c, d) if device == "LAN" else (b, a, d, c)
        if device == "LAN":
            if key in table or capacity is None or len(table) < capacity:
                table[key] = now
            out[seq] = "WAN"
        else:
            out[seq] = "LAN" if key in table else "DROP"
            if key in table:
                table[key] = now
    return out


@pytest.mark.parametrize("slice_us", [None, 1, 7, 30, 200])
def test_firewall_whatever_the_slices(spark, slice_us):
    for seed in (1, 2):
        rows = traffic(seed, 500)
        got = {r.seq: r.action for r in flowtable.firewall(packets(spark, rows), 12, slice_us).collect()}
        assert got == simulated_firewall(rows, 12)


def test_golden_firewall(spark):
    rows = [(i, t, d, 17, *((1, 2, 3, 4) if d == "LAN" else (2, 1, 4, 3)), 9) for i, (t, d) in enumerate([(0, "WAN"), (1, "LAN"), (11, "WAN"), (22, "WAN"), (23, "LAN")])]
    got = [r.action for r in flowtable.firewall(packets(spark, rows), 10).orderBy("seq").collect()]
    assert got == ["DROP", "WAN", "LAN", "DROP", "WAN"]


def test_sessions_and_table(spark):
    rows = [r for r in traffic(3, 400) if r[3] in (6, 17)]
    df = packets(spark, rows)
    by = defaultdict(list)
    for r in rows:
        by[r[4:8] if r[2] == "LAN" else (r[5], r[4], r[7], r[6])].append(r)
    want = Counter()
    for part in by.values():
        run = None
        for r in sorted(part, key=lambda r: (r[1], r[0])):
            run = [r[1], r[1], 0] if run is None or r[1] - run[1] > 12 else run
            run[1] = r[1]
            want[(r[4] if r[2] == "LAN" else r[5], run[0])] += 1
    got = {(r.flow.src_ip, r.session_start): r.n_packets for r in flowtable.sessions(df, 12).collect()}
    assert got == dict(want)
    at = rows[200][1]
    live = {r.flow.src_ip for r in flowtable.live_flows(df, at, 12).collect()}
    assert live == {k[0] for k, p in by.items() if any(at - 12 <= r[1] <= at for r in p)}
    gone = {r.flow.src_ip for r in flowtable.expired_flows(df, at, 12).collect()}
    assert live.isdisjoint(gone) and live | gone == {k[0] for k, p in by.items() if any(r[1] <= at for r in p)}


@pytest.mark.parametrize("capacity", [1, 3, 100])
def test_limited_firewall(spark, capacity):
    rows = traffic(4, 400)
    got = {r.seq: r.action for r in flowtable.limited_firewall(packets(spark, rows), capacity, 12).collect()}
    assert got == simulated_firewall(rows, 12, capacity)


def test_overfull_and_erase(spark):
    df = packets(spark, [r for r in traffic(5, 200) if r[3] in (6, 17)])
    assert flowtable.overfull(df, 100, 12).first().overfull is False and flowtable.overfull(df, 1, 12).first().overfull is True
    table = spark.range(10).withColumnRenamed("id", "idx")
    assert [r.idx for r in flowtable.erase_range(table, 2, 8).orderBy("idx").collect()] == [0, 1, 8, 9]
    values = spark.createDataFrame([(i,) for i in range(50)], "value long")
    assert flowtable.sample_above(values, 50, 48).first().value == 49 and flowtable.sample_above(values, 50, 49).count() == 0


def test_keys(spark):
    df = packets(spark, traffic(6, 50))
    both = df.select(canonical_key().alias("c"), F.when(F.col("device") == "LAN", flow_key()).otherwise(inverted_key()).alias("x"))
    assert both.where("c <> x").count() == 0


def test_telemetry_counts(spark):
    rows = traffic(7, 300)
    for mode, pick in (("packets", lambda p, ids: range(len(p))), ("strides", lambda p, ids: [i for i in range(len(p)) if i == 0 or ids[i] != ids[i - 1]])):
        want = Counter()
        for b in range(0, 300, 32):
            part = rows[b : b + 32]
            ids = [i for i, _ in simulated_strides([r[4:8] for r in part], "lazy")]
            want.update(part[i][4:6] for i in pick(part, ids))
        got = {r.key: r.n for r in programs.telemetry(packets(spark, rows), mode).where("kind = 'ips'").collect()}
        assert sorted(got.values()) == sorted(want.values())


@pytest.mark.parametrize("technique", programs.TECHNIQUES)
@pytest.mark.parametrize("function", ["nop", "fw"])
def test_programs_keep_every_packet_and_follow_the_head(spark, function, technique):
    rows = traffic(8, 200)
    out = programs.program(packets(spark, rows), function, technique, timeout_us=12).collect()
    assert sorted(r.seq for r in out) == list(range(200))
    heads = {(r.lane, r.batch_id, r.stride_id): r.action for r in out if r.position == 0}
    assert all(heads[(r.lane, r.batch_id, r.stride_id)] == r.action for r in out)
    if function == "fw" and technique in ("baseline", "multicore"):
        assert {r.seq: r.action for r in out} == simulated_firewall(rows, 12)


def test_lanes_with_tables_of_their_own(spark):
    """A reply that falls into another lane than its request passes a shared table alone."""
    rows = [(0, 1, "LAN", 17, 5, 9, 40, 80, 1), (1, 2, "WAN", 17, 9, 5, 80, 40, 1)]
    df = packets(spark, rows).withColumn("lane", F.when(F.col("seq") == 0, "a").otherwise("b"))
    acted = lambda own: {r.seq: r.action for r in programs.decide(df, "fw", 10, own).collect()}
    assert acted(False) == {0: "WAN", 1: "LAN"} and acted(True) == {0: "WAN", 1: "DROP"}


def test_sampled_packets_are_dropped_and_leave_no_state(spark):
    rows = [(0, 1, "LAN", 17, 5, 9, 40, 80, 1), (1, 2, "WAN", 17, 9, 5, 80, 40, 1), (2, 3, "LAN", 17, 5, 9, 40, 80, 1), (3, 4, "WAN", 17, 9, 5, 80, 40, 1)]
    run = lambda **o: {r.seq: r.action for r in programs.program(packets(spark, rows), "fw", "orchestrator_sorted", timeout_us=10, **o).collect()}
    assert run(phase=1) == {0: "DROP", 1: "DROP", 2: "WAN", 3: "LAN"}
    assert run() == run(sketch=(3, 64)) == {0: "WAN", 1: "LAN", 2: "WAN", 3: "LAN"}


def test_sketches_that_windows_clear(spark):
    df = packets(spark, traffic(6, 400))
    exact = {(r.window_id, r.kind, r.key): r.n for r in programs.telemetry(df, interval_us=100).collect()}
    wide = {(r.window_id, r.kind, r.key): r.estimate for r in programs.sketched_telemetry(df, 100).collect()}
    narrow = {(r.window_id, r.kind, r.key): r.estimate for r in programs.sketched_telemetry(df, 100, 1, 2).collect()}
    assert wide == exact and narrow.keys() == exact.keys() and all(narrow[k] >= n for k, n in exact.items()) and narrow != exact
    rows = windows.fixed_window(df, 100)
    sketch = sketches.count_min(rows, F.col("src_ip"), window=F.col("window_id"))
    keys = rows.select("window_id", F.col("src_ip").alias("key")).distinct()
    true = {(r.window_id, r.src_ip): r["count"] for r in rows.groupBy("window_id", "src_ip").count().collect()}
    assert {(r.window_id, r.key): r.estimate for r in sketches.estimate(sketch, keys, F.col("key")).collect()} == true
    early = sketches.bloom(rows.where("window_id = 0"), F.col("src_ip"), window=F.col("window_id"))
    assert {(r.window_id == 0, r.member) for r in sketches.maybe_in(early, keys, F.col("key")).collect()} == {(True, True), (False, False)}


def test_programs_reject_unknown_names(spark):
    with pytest.raises(ValueError):
        programs.program(packets(spark, traffic(1, 2)), "nop", "none")


def test_sketches(spark):
    rng = random.Random(1)
    keys = [int(rng.paretovariate(0.7)) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    true = Counter(keys)
    small = sketches.count_min(df, F.col("k"), 5, 64)
    got = {r.key: r.estimate for r in sketches.estimate(small, df.select(F.col("k").alias("key")).distinct(), F.col("key"), 5, 64).collect()}
    assert set(got) == set(true) and all(got[k] >= n for k, n in true.items())
    wide = {r.key: r.estimate for r in sketches.estimate(sketches.count_min(df, F.col("k")), df.select(F.col("k").alias("key")).distinct(), F.col("key")).collect()}
    assert sum(wide[k] == n for k, n in true.items()) >= 0.99 * len(true)
    other = spark.range(10**6, 10**6 + 500).withColumnRenamed("id", "key")
    members = sketches.maybe_in(sketches.bloom(df, F.col("k"), 4, 8192), df.select(F.col("k").alias("key")).distinct().unionByName(other), F.col("key"), 4, 8192).collect()
    assert all(r.member for r in members if r.key in true) and sum(r.member for r in members if r.key not in true) < 50
    top = [(r.key, r.weight) for r in sketches.top_k(df, F.col("k"), 5).collect()]
    assert top == sorted(true.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert sketches.running_maximum(df, F.col("k")).first().weight == max(true.values())


def test_elephants(spark):
    counts = spark.createDataFrame([("A", 5), ("B", 3), ("C", 1), ("D", 1)], "key string, n long")
    assert {r.key for r in skew.elephants_by_share(counts, 0.8).collect()} == {"A", "B"}
    by_median = skew.elephants_by_median(counts, 2).collect()
    assert {r.key for r in by_median if r.elephant} == {"A"} and by_median[0].median == 2.0
    cdf = {r.key: (r.pct_flows, r.share) for r in skew.flow_cdf(counts).collect()}
    assert cdf["A"] == (25.0, 0.5) and cdf["D"] == (100.0, 1.0)
    few = skew.sampled_keys(spark.range(4000).withColumnRenamed("id", "seq"), F.col("seq") % 5, 0.25).count()
    assert 850 < few < 1150
    r = skew.expected_speedup(counts, 8, 32, 2).first()
    assert r.share == 0.5 and r.speedup == pytest.approx(20)


def test_lane_sequence_counts_within_a_lane(spark):
    df = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "elephant").otherwise("mice").alias("lane")).repartition(7)
    got = sorted((r.lane, r.lane_seq, r.seq) for r in skew.lane_sequence(df, bucket=100).collect())
    assert [x[1] for x in got] == list(range(1667)) + list(range(3333)) and got == sorted(got, key=lambda x: (x[0], x[2]))


def simulated_bucket(rows, rate, burst):
    state, out = {}, {}
    for seq, now, key, size in sorted(rows, key=lambda r: (r[1], r[0])):
        idle = burst // rate * 1_000_000
        if key in state and now - state[key][1] > max(idle, 1):
            del state[key]
        if key not in state:
            state[key], out[seq] = (max(burst - size, 0), now), True
            continue
        tokens, last = state[key]
        tokens = min(burst, tokens + (now - last) * rate // 1_000_000)
        out[seq] = tokens > size
        state[key] = (tokens - size if tokens > size else tokens, now)
    return out


def test_token_bucket(spark):
    golden = [(0, 0, "k", 40), (1, 1_000_000, "k", 60), (2, 2_000_000, "k", 20), (3, 12_000_000, "k", 100)]
    make = lambda rows: spark.createDataFrame([(*r[:2], "LAN", r[3], r[2]) for r in rows], "seq long, now_us long, device string, pkt_len long, k string")
    assert [r.passes for r in limiter.token_bucket(make(golden), F.col("k"), 10, 100).orderBy("seq").collect()] == [True, True, False, False]
    rng, rows, now = random.Random(3), [], 0
    for i in range(400):
        now += rng.choice([0, 50_000, 400_000, 3_000_000, 11_000_000]) if rng.random() < 0.7 else 0
        rows.append((i, now, rng.choice("abc"), rng.randrange(150)))
    assert {r.seq: r.passes for r in limiter.token_bucket(make(rows), F.col("k"), 10, 100).collect()} == simulated_bucket(rows, 10, 100)


def test_packets_with_nulls_are_kept(spark):
    rows = [(0, 0, "LAN", 17, 1, 2, 3, 4, 10), (1, None, "LAN", 17, 1, 2, 3, 4, 10), (2, 5, "WAN", 17, 2, 1, 4, 3, 10), (3, 6, "LAN", 17, None, 2, 3, 4, 10), (4, 7, "WAN", 17, 2, None, 4, 3, 10), (5, 8, None, 17, 1, 2, 3, 4, 10), (6, 9, "LAN", None, 1, 2, 3, 4, None)]
    df = spark.createDataFrame(rows, PACKET)
    got = {r.seq: r.action for r in flowtable.firewall(df, 1_000_000).collect()}
    assert got == {0: "WAN", 1: "DROP", 2: "LAN", 3: "WAN", 4: "LAN", 5: "DROP", 6: "DROP"}
    keyed = spark.createDataFrame([(0, 0, "LAN", 40, None), (1, 1, "LAN", 70, None), (2, None, "LAN", 1, "k"), (3, 3, "LAN", None, "k")], "seq long, now_us long, device string, pkt_len long, k string")
    assert {r.seq: r.passes for r in limiter.token_bucket(keyed, F.col("k"), 10, 100).collect()} == {0: True, 1: False, 2: False, 3: True}
    assert flowtable.firewall(df.limit(0)).count() == 0 and limiter.token_bucket(keyed.limit(0), F.col("k"), 10, 100).count() == 0


def test_ranks_of_ties(spark):
    rng = random.Random(5)
    for keys, kind in (([None, *range(500)], "long"), ([f"k{i}" for i in range(500)], "string")):
        n = {k: rng.choice([1, 1, 1, 1, 2, 9]) for k in keys}
        got = {r.key: (r["rank"], r.before) for r in skew.ranked(spark.createDataFrame(list(n.items()), f"key {kind}, n long")).collect()}
        order = sorted(keys, key=lambda k: (-n[k], k is not None, k if k is not None else 0))
        assert [got[k][0] for k in order] == list(range(1, len(order) + 1))
        assert all(got[k][1] == sum(n[x] for x in order[:i]) for i, k in enumerate(order))
    assert skew.ranked(spark.createDataFrame([], "key long, n long")).count() == 0


def test_consistent_hashing(spark):
    table = {}
    for r in chash.build_table(spark, 5, 2).orderBy("bucket", "prio").collect():
        table.setdefault(r.bucket, []).append(r.backend)
    assert table == {0: [0, 1], 1: [1, 0], 2: [0, 1], 3: [1, 0], 4: [0, 1]}
    keys = spark.range(5).withColumnRenamed("id", "key")
    none = chash.route(keys, F.col("key"), chash.build_table(spark, 5, 2), spark.createDataFrame([], "backend long"), 5)
    assert none.where("backend IS NOT NULL").count() == 0 and none.count() == 5
    one = chash.route(keys, F.col("key"), chash.build_table(spark, 5, 2), spark.createDataFrame([(1,)], "backend long"), 5)
    assert {r.backend for r in one.collect()} == {1}
    with pytest.raises(ValueError):
        chash.build_table(spark, 6, 2)


def test_reset_windows(spark):
    at = [0, 4, 10, 13, 25, 31, 35]
    df = spark.createDataFrame(list(enumerate(at)), "seq long, now_us long")
    assert [r.reset_us for r in windows.reset_points(df, 10).collect()] == [0, 10, 25, 35]
    got = [r.reset_us for r in windows.with_reset_window(df, 10).orderBy("seq").collect()]
    assert got == [0, 0, 10, 10, 25, 25, 35]
    assert windows.reset_points(df.limit(0), 10).count() == 0


def test_integer_functions(spark):
    n = spark.createDataFrame([(65536,), (458752,), (1,), (0,)], "n long")
    assert [r[0] for r in n.select(core.next_power_of_two(F.col("n"))).collect()] == [131072, 524288, 2, 1]
    text = n.select(core.humanised(F.lit(12_345_678)).alias("a"), core.stem(F.lit("/x/univ2_pt0.tar.gz")).alias("b")).first()
    assert tuple(text) == ("12.3M", "univ2_pt0")
    name = n.select(core.experiment_name(F.lit(None), F.lit("zipf"), F.lit(0.99), F.lit(100000), F.lit("fw"), F.lit(64))).first()[0]
    assert name == "zipf-s0-99-f100000-single-core-fw-lbatch64"


def test_statistics(spark):
    rows = spark.createDataFrame([("sorted",), ("lazy",), ("baseline",), ("other",), ("greedy",)], "technique string")
    assert [r[0] for r in rows.orderBy(stats.technique_order()).collect()] == ["baseline", "greedy", "lazy", "sorted", "other"]
    df = spark.createDataFrame([(1, None), (2, 4), (1, 2)], "a int, b int")
    assert [r.b for r in stats.key_set(df, "b").collect()] == [None, 2, 4]
    assert stats.of_keys(df, spark.createDataFrame([(1,)], "a int"), ["a"]).count() == 2
    grid = {(r.a, r.b): r.n for r in stats.filled_grid(df.withColumn("n", F.lit(7)), {"a": [1, 2], "b": [None, 4]}, ["n"]).collect()}
    assert grid == {(1, None): 7, (1, 4): 0, (2, None): 0, (2, 4): 7}


def test_percent_prints_as_c_does(spark):
    parts = [(n, 800) for n in range(801)] + [(75, 100_000), (1005, 100_000), (1, 3), (2, 3), (4321, 100)]
    rows = spark.createDataFrame(parts, "part long, whole long").select("part", "whole", core.percent(F.col("part"), F.col("whole")).alias("shown")).collect()
    assert [r.shown for r in rows] == [f"{100.0 * r.part / r.whole:5.2f}%" for r in rows]
