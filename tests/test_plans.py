"""What the plans look like: pruned and pushed down, Python only where it must be, broadcasts only behind a check."""

from __future__ import annotations

import re

import pytest

from weftline.plans import catalogue
from weftline.plans.sizes import small_side


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["f1_timeline_days", "f3_event_filter", "f14_folder", "f16_own_and_present", "w5_latest_versions", "j16_neighbours", "r9_usable_evidence", "q1_task_refs", "i7_retention", "t_sessions", "j13_nearest", "j14_asof_backward", "m_map_records", "i2_upsert"])
def test_stays_in_the_jvm(spark, data, name):
    found = plan(catalogue.QUERIES[name](spark, data))
    assert not re.search("Python|Arrow|Pandas", found), found


def test_filters_and_columns_reach_the_scan(spark, data):
    found = plan(catalogue.QUERIES["f1_timeline_days"](spark, data))
    assert "GreaterThanOrEqual(occurred_at" in found and "LessThan(occurred_at" in found
    schema = re.search(r"ReadSchema: (\S+)", found)[1]
    assert "metadata" not in schema and "people" not in schema and "content" in schema


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_no_cartesian_product(spark, data, name):
    assert "CartesianProduct" not in plan(catalogue.QUERIES[name](spark, data))


def test_large_tables_are_not_broadcast(spark):
    small, large = spark.range(10), spark.range(100)
    key = spark.range(1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastExchange" in plan(key.join(small_side(small, 50), "id"))
        assert "BroadcastExchange" not in plan(key.join(small_side(large, 50), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
