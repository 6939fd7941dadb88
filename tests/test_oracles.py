"""A spread of registered queries against their SQL at the smallest scale; tools/check.py runs them all."""

import pytest

from barlab.catalog import load_all
from barlab.registry import ORACLES, QUERIES
from check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = """
sma rolling_zscore bar_structure market_panel rate_curve_features align_ffill asof_join pairwise_candidate_join bars_validate bars_quarantine
bars_adjust returns_quality series_read_latest ratio_csv_parse position_memory rsi_wilder examples_weekly calendar_cycle asset_momentum
spec_catalog_weekly stage_shard seed_combinations feature_vote annual_vote select_asset backtest_long_cash long_cash_trades metrics_full
trades_from_position survival_gate weekly_scores verified_rows leaderboard_merge state_merge chunk_split parallelism_sweep engine_comparison
leave_one_year_out cost_stress duplicates_exact regime_calmar corr_model anti_overfit_penalty
""".split()


@pytest.fixture(scope="module")
def con():
    load_all()
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    err, _ = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert err is None, err


def test_names_are_stable():
    load_all()
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 250
