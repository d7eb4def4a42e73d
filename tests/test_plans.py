"""Shapes of the plans: what is shuffled, pushed down and broadcast."""

import re

import pytest

from tidewheel.operators import flowtable, strides
from tidewheel.plans import catalog
from tidewheel.sources import packets as source

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def nodes(df, name):
    return len(re.findall(rf"^[\s:+\-*|(0-9)]*{name}\b.* \(\d+\)$", plan(df).split("\n\n(1)")[0], re.M))


@pytest.mark.parametrize("mode", strides.MODES)
def test_runs_shuffle_once(spark, mode):
    assert nodes(strides.strides(source.events_as_packets(spark, SF), mode), "Exchange") == 1


def test_grouped_runs_aggregate_before_the_shuffle(spark):
    df = strides.grouped_strides(source.events_as_packets(spark, SF))
    assert nodes(df, "Exchange") == 1 and nodes(df, "HashAggregate") == 2


def test_firewall_shuffles_packets_by_flow_and_slice(spark):
    df = flowtable.firewall(source.events_as_packets(spark, SF).where("proto IN (6, 17)"), catalog.TIMEOUT)
    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", plan(df))
    assert any("__s" in x for x in exchanges)


def test_scans_read_what_they_need(spark):
    text = plan(catalog.QUERIES["top_k_flows"](spark, SF))
    assert "ReadSchema: struct<user_id:bigint>" in text and "TakeOrderedAndProject" in text
    text = plan(catalog.QUERIES["bloom_membership"](spark, SF))
    assert "GreaterThan(l_quantity,49.0)" in text


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_query_pairs_rows_without_a_key(spark, name):
    if name in ("limited_table", "vector_sample"):
        return
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    if name not in ("heavy_hitter_share", "elephants_by_median", "expected_speedup", "value_histogram", "filled_grid", "consistent_hash_table", "consistent_hash_route", "flow_cdf", "elephants_by_share"):
        assert "BroadcastNestedLoopJoin" not in text  # those above join one row, a grid or the ring


def test_every_query_runs(spark):
    for name, query in catalog.QUERIES.items():
        df = query(spark, SF)
        assert df.columns and df.count() >= 0, name
