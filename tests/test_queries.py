"""Registered queries against DuckDB; TAPELINE_FULL=1 runs every one of them."""

import os

import pytest

from compare import compare
from tapeline.plans.checks import with_views
from tapeline.registry import all_queries, run

CORE = """weekly_snapshot resample_week resample_stored sma bollinger stochastic cci ema rsi macd adx_di ichimoku rs_line
change_windows merge_statements carry_forward_balance period_offset ttm_window fye_month consolidated_fallback
financials_snapshot metrics metrics_per_period static_roce valuation collapse_facts filter_facts_by_period diff_cumulative q4_asof
q4_eps us_income_rows pivots cluster_levels support_resistance supply_demand_zones market_structure candle_dedupe gaps
volume_profile value_area divergence historical_analogues signals confluence levels_engine option_chain_stats
insider_holdings upsert_statements dedup_content_hash select_pages news_symbol_match map_growth histogram_quantile
dq_majority rate_window stream_indicators to_float parse_period_label round_py xbrl_facts
ema_long us_cashflow_rows unpivot_periods order_nulls_last skip_existing stream_resample_month stream_upsert_bars
stream_dedup_filings stream_gap_sessions rate_decisions upsert_bars structure_topic_counts price_history_section union_news_dedup scan_news""".split()

ALL = all_queries()
NAMES = [n for n, q in ALL.items() if q.sql] if os.environ.get("TAPELINE_FULL") else CORE


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(name, spark, duck, sf):
    ok, message = compare(run(name, spark, sf), duck, with_views(ALL[name].sql))
    assert ok, message


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 9
    assert CORE and set(CORE) <= set(entry.queries())
