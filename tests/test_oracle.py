"""Every catalogue query with SQL gives the same rows in DuckDB; the others give rows."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from oracle import compare, database

from strataline.plans.catalog import CATALOG
from strataline.settings import GROUP_ROWS

SF_DIR = "/root/testdata/sf0.001"
# Long series: one query per way of crossing a chunk border.
LONG = [
    "b02_zone_info", "b05_carry_last_known", "c03_interpolate_gaps", "c10_robust_zscore", "c11_pct_rank", "d20_window_chain",
    "e03_lateral_distance", "f01_interp_join", "f06_lag_scan", "f16_self_match", "g03_layer_lookup", "h07_neighbor_dip", "j01_savgol", "j09_slope_limit", "p07_safe_corr",
]


def run_all(spark, names):
    con = database(SF_DIR)

    def one(name):
        try:
            return name, compare(spark, con.cursor(), CATALOG[name], SF_DIR)
        except Exception as error:  # noqa: BLE001
            return name, (f"{type(error).__name__}: {str(error)[:500]}", -1)

    with ThreadPoolExecutor(6) as pool:
        return dict(pool.map(one, names))


@pytest.fixture(scope="module")
def results(spark):
    return run_all(spark, list(CATALOG))


@pytest.fixture(scope="module")
def long_results(spark, results):
    spark.conf.set(GROUP_ROWS, "40")
    found = run_all(spark, LONG)
    spark.conf.unset(GROUP_ROWS)
    return found


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(results, name):
    problem, rows = results[name]
    assert problem is None, problem
    # At this size every test entity has a training copy, so that none is left to exclude.
    assert rows > 0 or name == "n06_exclude_entities"


@pytest.mark.parametrize("name", LONG)
def test_long_series(long_results, name):
    problem, rows = long_results[name]
    assert problem is None, problem
    assert rows > 0
