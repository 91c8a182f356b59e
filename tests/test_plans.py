"""Shapes of physical plans, and the driver contract."""

import re

import __spark_entry__ as entry_points
from strataline.plans.catalog import CATALOG
from strataline.settings import checkpoint, clear_work

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return CATALOG[name].plan(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|single|RoundRobin)", text))


def test_a_chain_of_window_features_shuffles_once(spark):
    for name in ("d01_rolling_trailing", "d20_window_chain", "e10_tortuosity", "b05_carry_last_known", "c10_robust_zscore"):
        assert exchanges(plan(spark, name)) == 1, name


def test_lookups_do_not_multiply_rows(spark):
    for name in ("f01_interp_join", "f06_lag_scan", "g06_boundary_count", "n03_overlap_gate", "h04_knn_idw"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text, name
        # The only nested loop allowed is the one-row table of overall values.
        for line in text.splitlines():
            assert "BroadcastNestedLoopJoin" not in line or "Cross" in line, (name, line)


def test_scans_read_only_the_needed_columns(spark):
    text = plan(spark, "k05_assign_folds")
    assert "ReadSchema: struct<user_id:bigint>" in text


def test_contract(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() == 3


def test_written_steps_can_be_removed(spark):
    clear_work(spark)
    kept = checkpoint(spark.range(5))
    assert kept.count() == 5
    assert clear_work(spark) == 1 and clear_work(spark) == 0
