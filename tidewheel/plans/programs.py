"""The network programs: a function (forwarder, firewall, telemetry) run by a technique, as one plan.

A technique forms runs within batches; the function decides at the head of a run and the others follow. The firewall's
state is per run too: only heads refresh a flow. Telemetry counts packets or, as batched programs do, runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import string_key
from ..operators import flowtable, sketches, skew, strides, windows
from ..schema import BATCH_SIZE, DROP, KEY, TIMEOUT_US, canonical_key, flow_key, ip_pair, port_pair

FUNCTIONS = ("nop", "fw", "telemetry")
TECHNIQUES = ("baseline", "straw", "lazy", "greedy", "sorted", "multicore", "lazy_multicore", "orchestrator_greedy", "orchestrator_sorted", "orchestrator_straw")
#: heaviest flows that an orchestrated program tracks, by the technique of its elephant lane
TRACKED = {"greedy": 256, "sorted": 32, "straw": 1}


def core_of(cores: int) -> Column:
    """The core that both directions of a flow go to, by a hash that other engines have too."""
    ends = canonical_key()
    return F.pmod(string_key(F.concat_ws(",", *[ends[c].cast("string") for c in KEY])), F.lit(cores))


def telemetry_keys() -> dict[str, Column]:
    return {"flow": flow_key(), "ips": ip_pair(), "ports": port_pair()}


def telemetry(df: DataFrame, count_mode: str = "packets", mode: str = "lazy", interval_us: int | None = None, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Counts of flows, address pairs and port pairs, of packets or of runs; by window if an interval is given."""
    if count_mode == "strides":
        df = strides.assign_strides(df, mode, batch_size=batch_size).where("position = 0")
    window = None
    if interval_us is not None:
        df = windows.fixed_window(df, interval_us)
        window = F.col("window_id")
    return sketches.key_counts(df, telemetry_keys(), window)


def sketched_telemetry(df: DataFrame, interval_us: int | None = None, height: int = sketches.HEIGHT, width: int = sketches.WIDTH, anchored: bool = False) -> DataFrame:
    """kind, key and estimate as Count-Min sketches of a kind have it, for each window if an interval is given: the sketches
    are cleared at its multiples, or (anchored) at the first packet an interval after they were cleared before."""
    if interval_us is not None:
        df = windows.with_reset_window(df, interval_us) if anchored else windows.fixed_window(df, interval_us)
    window = None if interval_us is None else F.col("reset_us" if anchored else "window_id")
    return sketches.sketched(sketches.key_counts(df, telemetry_keys(), window), [*([] if window is None else ["window_id"]), "kind"], height, width)


def decide(df: DataFrame, function: str | Column | Callable[[DataFrame], DataFrame], timeout_us: int = TIMEOUT_US, own_state: bool = False) -> DataFrame:
    """df with action, what the function says of each packet by itself. A function of the user's own is an expression over a
    packet, or takes the packets (those at the heads of runs, with all their columns) and returns them with action, by any
    stateful plan. own_state: each lane has a flow table of its own, as cores that share nothing have."""
    if isinstance(function, Column):
        return df.withColumn("action", function)
    if callable(function):
        return function(df)
    key = F.struct("lane", canonical_key().alias("ends")) if own_state else None
    return flowtable.firewall(df, timeout_us, key=key).drop("flow", "session_start") if function == "fw" else flowtable.port_swap(df)


def program(df: DataFrame, function: str | Column | Callable[[DataFrame], DataFrame], technique: str, cores: int = 4, timeout_us: int = TIMEOUT_US, batch_size: int = BATCH_SIZE, own_state: bool = False, phase: int | None = None, sketch: tuple[int, int] | None = None) -> DataFrame:
    """Packets with batch_id, stride_id, stride_size, lane and action, as one of the programs forwards them.

    A function that looks at one packet alone is run on all, and the others of a run take what its head has; only one
    with state is run on the heads and joined. own_state: a flow table for each lane. An orchestrated program may find its
    elephants in the packets with seq below phase, by the estimates of a sketch of some height and width; those packets are
    dropped, and the function does not see them.
    """
    if isinstance(function, str) and function not in FUNCTIONS or technique not in TECHNIQUES:
        raise ValueError(f"a function of {FUNCTIONS}, an expression or a callable, and a technique of {TECHNIQUES}")
    lane, sampled = ["lane"], None
    if technique.startswith("orchestrator_"):
        mode = technique.removeprefix("orchestrator_")
        split = skew.split_lanes(df, flow_key(), TRACKED[mode], phase, sketch=sketch)
        if phase is not None:
            sampled, split = split.where("phase = 'sampling'").withColumn("action", F.lit(DROP)), split.where("phase = 'steady'")
        # adjacent runs are what the elephant lane of the first kind merges
        runs = skew.run_lanes(split, {"greedy": "lazy"}.get(mode, mode), batch_size=batch_size)
    elif technique.endswith("multicore"):
        by_core = df.withColumn("lane", core_of(cores).cast("string"))
        runs = strides.assign_strides(skew.lane_sequence(by_core, batch_size=batch_size), "lazy" if technique == "lazy_multicore" else "baseline", batch_size=batch_size, lane=lane)
    else:
        runs = strides.assign_strides(df.withColumn("lane", F.lit("all")), technique, batch_size=batch_size, lane=lane)
    run = ["lane", "batch_id", "stride_id"]
    if function == "fw" if isinstance(function, str) else not isinstance(function, Column):
        heads = decide(runs.where("position = 0"), function, timeout_us, own_state).select(*run, "action")
        found = runs.join(heads, run)
    else:
        head = F.first("action").over(Window.partitionBy("lane", "batch_id", "stride_id").orderBy("position"))
        found = decide(runs, function).withColumn("action", head)
    return found if sampled is None else found.unionByName(sampled, allowMissingColumns=True)
