"""The sectioned report, its values checked section by section against the SQL of what it shows."""

from __future__ import annotations

from tapeline.operators import report as RP
from tapeline.operators import signals as SG
from tapeline.plans.calls import AS_OF
from tapeline.plans.checks import view
from tapeline.registry import _QUERIES, query

# -- SQL of a section's values -------------------------------------------------------------------


def _sql(name: str) -> str:
    return f"({_QUERIES[name].sql})"


def _values(section: str, source: str, numbers: str = "", texts: str = "", prefix: str = "''") -> str:
    """Values of rows: ``numbers`` and ``texts`` name columns (path=column where they differ), ``prefix`` is put before the path."""
    cells = []
    for names, kind in ((numbers, "number"), (texts, "text")):
        for name in names.split():
            path, _, column = name.partition("=")
            column = column or path
            number, text = (f"CAST({column} AS DOUBLE)", "CAST(NULL AS VARCHAR)") if kind == "number" else ("CAST(NULL AS DOUBLE)", f"CAST({column} AS VARCHAR)")
            cells.append(f"{{'p': '{path}', 'n': {number}, 't': {text}}}")
    return (f"SELECT symbol, '{section}' AS section, pre||c.p AS path, c.n AS number, c.t AS text FROM (SELECT symbol, {prefix} AS pre, unnest([{', '.join(cells)}]) AS c FROM {source})"
            " WHERE c.n IS NOT NULL OR c.t IS NOT NULL")


def _listed(source: str, order: str, where: str = "true") -> str:
    """Rows of each symbol with their number in the list."""
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY {order})-1 AS VARCHAR)||'.' AS i FROM {source} WHERE {where})"


def _texts(section: str, **texts: str) -> str:
    """Fixed texts of every symbol."""
    cells = ", ".join(f"{{'p': '{p}', 't': '{t}'}}" for p, t in texts.items())
    return f"SELECT symbol, '{section}' AS section, c.p AS path, CAST(NULL AS DOUBLE) AS number, c.t AS text FROM (SELECT symbol, unnest([{cells}]) AS c FROM v_dl)"


_D, _W, _M = (f"timeframe='{t}'" for t in ("daily", "weekly", "monthly"))
_ch = "change_pct_1d change_pct_1w change_pct_1m change_pct_3m change_pct_1y"
view("v_rlc", "SELECT l.* EXCLUDE (change_pct_1y), c1d AS change_pct_1d, c1w AS change_pct_1w, c1m AS change_pct_1m, c3m AS change_pct_3m, c1y AS change_pct_1y FROM v_rl l JOIN (SELECT * FROM v_changes WHERE rd=1) c USING (symbol, timeframe)")
view("v_rday", f"SELECT * FROM v_rlc WHERE {_D}")
view("v_hv2", "SELECT symbol, round(stddev_samp(lr) FILTER (rd<=20)*sqrt(252)*100,4) AS hv_20d_annualized_pct, round(stddev_samp(lr) FILTER (rd<=60)*sqrt(252)*100,4) AS hv_60d_annualized_pct FROM v_ret1 WHERE n>60 GROUP BY 1")
view("v_rs1", _QUERIES["rs_line"].sql.replace("FROM v_bars b", "FROM v_1y b"))
view("v_dfib7", """SELECT symbol, swing_high, swing_low, CASE WHEN hd>=ld THEN 'up' ELSE 'down' END AS direction, label, round(CASE WHEN hd>=ld THEN swing_high-(swing_high-swing_low)*r ELSE swing_low+(swing_high-swing_low)*r END,4) AS level
 FROM v_dfib0, (VALUES ('0.0%',0.0::DOUBLE),('23.6%',0.236::DOUBLE),('38.2%',0.382::DOUBLE),('50.0%',0.5::DOUBLE),('61.8%',0.618::DOUBLE),('78.6%',0.786::DOUBLE),('100.0%',1.0::DOUBLE)) t(label,r) WHERE swing_high<>swing_low""")
view("v_rzone", """SELECT symbol, side, z.kind AS kind, z.level AS level, CAST(k-1 AS VARCHAR)||'.' AS i FROM (SELECT symbol, 'entry' AS side, ez[k] AS z, k FROM (SELECT symbol, ez, unnest(range(1,len(ez)+1)) AS k FROM v_lv)
 UNION ALL SELECT symbol, 'exit', xz[k], k FROM (SELECT symbol, xz, unnest(range(1,len(xz)+1)) AS k FROM v_lv))""")
view("v_levels1", """SELECT symbol, p AS reference_price, stop AS stop_level, basis AS stop_basis, res[1] AS tp1, res[2] AS tp2, res[3] AS tp3, CASE WHEN p>stop THEN round((res[1]-p)/(p-stop),2) END AS risk_reward_to_tp1, sup[-1] AS invalidation_level FROM v_lv""")
view("v_dbrk", f"SELECT * FROM {_sql('breakout')} WHERE {_D}")
view("v_rcloud", """SELECT *, CASE WHEN current_price>greatest(ichimoku_senkou_a,ichimoku_senkou_b) THEN 'above cloud (bullish)' WHEN current_price<least(ichimoku_senkou_a,ichimoku_senkou_b) THEN 'below cloud (bearish)' ELSE 'inside cloud (neutral)' END AS price_vs_cloud FROM v_rday""")
view("v_rsummary", f"""SELECT d.symbol, current_price, overall, regime, m.classification, m.confidence, trend_headline, price_vs_sma200_pct, {len(RP.SECTIONS)} AS supported, 0 AS unsupported,
 bullish||' bullish / '||bearish||' bearish / '||neutral||' neutral of '||total_signals||' deterministic signals' AS headline FROM v_rday d JOIN v_conf USING (symbol) JOIN (SELECT * FROM v_tr WHERE {_D}) r USING (symbol)
 JOIN (SELECT * FROM v_ms WHERE {_D}) m USING (symbol) JOIN {_sql('trend_dimensions')} t USING (symbol)""")

_SR, _CANDLES, _CHARTS = _sql("support_resistance"), _sql("candle_dedupe"), _sql("chart_patterns")
_VOLUME = ("v_rday", "obv acc_dist"), (_sql("volume_stats"), "avg_volume_20bar recent_5bar_avg recent_vs_avg20_ratio", "trend")
_REGIME = (f"(SELECT * FROM {_sql('trend_regime')} WHERE {_D})", "adx sma20_slope_pct", "regime basis")
_TEXT_INDICATORS = {"golden_death_cross_state": "golden_death_cross_state=gdc"}


def _indicators(section: str) -> str:
    columns = RP.INDICATOR_SECTIONS[section]
    return _values(section, "v_rday", " ".join(c for c in columns if c not in _TEXT_INDICATORS), " ".join(_TEXT_INDICATORS[c] for c in columns if c in _TEXT_INDICATORS))


_HISTORY = _sql("price_history_section")
_PARTS = [
    _values("executive_summary", "v_rsummary", "price=current_price sections_supported=supported sections_unsupported=unsupported",
            "confluence=overall regime structure_class=classification structure_confidence=confidence trend_headline"),
    _values("asset_overview", "v_rday", texts="symbol"),
    _values("current_price_market_data", "v_rday", f"current_price high_52w low_52w {_ch}"),
    _values("multi_timeframe_price_analysis", _listed("v_rlc", "timeframe"), f"bars current_price {_ch}", "timeframe", "i"),
    *[_values("price_history", _listed(_HISTORY, "date", w), "open high low close volume", "date is_partial", f"'{t}.'||i") for t, w in (("daily", _D), ("weekly", _W))],
    _values("trend_analysis", _sql("trend_dimensions"), "price_vs_sma200_pct", "structural_direction confidence momentum di_direction agreement weekly_structure trend_headline"),
    _values("market_structure", f"(SELECT * FROM v_ms WHERE {_D})", "pivot_highs pivot_lows high_prev high_last low_prev low_last", "classification confidence price_vs_sma200"),
    *[_values("support_resistance", _listed(_SR, "price", w), "price touches", "side", f"'{t}.'||i") for t, w in (("daily", _D), ("weekly", _W))],
    _values("supply_demand_zones", _listed(_sql("supply_demand_zones"), "rank", _D), "zone_low zone_high strength_pct volume_in_zone", "kind", "i"),
    _texts("price_action_analysis", note="intraday data unavailable; price action described from the last completed daily candle"),
    _values("price_action_analysis", _sql("price_daily_candle"), "open close", "date direction", "'daily_candle.'"),
    *[_values("candlestick_analysis", _listed(_CANDLES, "date, pattern", w), "bar_offset_from_end", "date pattern", f"'{t}.'||i") for t, w in (("daily", _D), ("weekly", _W))],
    *[_values("chart_pattern_analysis", _listed(_CHARTS, "pattern", w), "", "pattern", f"'{t}.'||i") for t, w in (("daily", _D), ("weekly", _W))],
    _values("breakout_breakdown", "v_dbrk", "level", "type volume_confirmed"),
    "SELECT * FROM (" + _texts("breakout_breakdown", note="no active breakout/breakdown from the 60-bar range") + ") WHERE symbol NOT IN (SELECT symbol FROM v_dbrk)",
    *[_indicators(s) for s in RP.INDICATOR_SECTIONS],
    *[_values(s, *_VOLUME[0]) for s in ("volume_analysis", "obv_accumulation_distribution")],
    *[_values(s, *_VOLUME[1], "'volume_stats.'") for s in ("volume_analysis", "obv_accumulation_distribution")],
    _values("volume_profile", f"(SELECT * FROM {_sql('value_area')} WHERE {_D})", "poc value_area_low value_area_high"),
    _values("vwap_analysis", f"(SELECT * FROM v_rday JOIN (SELECT symbol, min(date) AS window_start, max(date) AS window_end FROM v_frn WHERE {_D} GROUP BY 1) USING (symbol))", "vwap_anchored", "window_start window_end"),
    _values("volatility_analysis", "v_rday", "atr_14"),
    _values("volatility_analysis", "v_hv2", "hv_20d_annualized_pct hv_60d_annualized_pct", "", "'historical.'"),
    _values("historical_volatility", "v_hv2", "hv_20d_annualized_pct hv_60d_annualized_pct"),
    _values("relative_strength", "v_rs1", "rs_ratio rs_ratio_1m_ago rs_ratio_3m_ago stock_3m_change_pct benchmark_3m_change_pct", "verdict"),
    _values("fibonacci_analysis", "(SELECT DISTINCT symbol, swing_high, swing_low, direction FROM v_dfib7)", "swing_high swing_low", "direction"),
    _values("fibonacci_analysis", _listed("v_dfib7", "label"), "level", "label", "'levels.'||i"),
    _values("ichimoku_analysis", "v_rcloud", "ichimoku_tenkan ichimoku_kijun ichimoku_senkou_a ichimoku_senkou_b ichimoku_chikou=current_price", "price_vs_cloud"),
    _values("gap_analysis", _listed(_sql("gaps"), "rank", _D), "gap_low gap_high gap_pct", "date type filled", "'gaps.'||i"),
    *[_values(s, *_REGIME) for s in ("market_regime", "trend_vs_range")],
    _values("bullish_bearish_signals", _listed("v_sig", "position"), "", "signal bias note", "i"),
    _values("indicator_confluence", "v_conf", "bullish bearish neutral total_signals bullish_share", "overall"),
    _values("divergence_analysis", _listed("v_div", "anchor"), "", "type anchor", "'divergences.'||i"),
    _texts("short_term_setup", basis_timeframe="daily"),
    _values("short_term_setup", f"(SELECT * FROM v_mtf WHERE {_D})", "", "daily_state=state"),
    _values("medium_term_setup", f"(SELECT * FROM v_rlc WHERE {_W})", f"bars rsi_14 sma_20 sma_50 sma_200 {_ch}", "golden_death_cross_state=gdc", "'indicators.'"),
    _values("medium_term_setup", f"(SELECT * FROM v_ms WHERE {_W})", "", "structure=classification structure_confidence=confidence"),
    _values("long_term_structure", f"(SELECT * FROM v_rlc WHERE {_M})", "rsi_14 sma_20 sma_50", "", "'indicators.'"),
    _values("long_term_structure", f"(SELECT * FROM v_ms WHERE {_M})", "", "structure=classification structure_confidence=confidence"),
    *[_values(s, f"(SELECT * FROM v_rzone WHERE side='{side}')", "level", "kind", f"'{side}_zones.'||i")
      for side, sections in (("entry", ("entry_zones", "key_technical_levels")), ("exit", ("exit_zones", "key_technical_levels"))) for s in sections],
    _values("stop_loss", "v_levels1", "stop_level", "stop_basis"),
    _values("take_profit_targets", "v_levels1", "tp1 tp2 tp3"),
    _values("risk_reward", "v_levels1", "risk_reward_to_tp1"),
    _values("invalidation_levels", "v_levels1", "invalidation_level"),
    _texts("invalidation_levels", basis=SG.INVALIDATION_BASIS),
    _values("key_technical_levels", "v_levels1", "reference_price stop_level tp1 tp2 tp3 invalidation_level"),
    *[_values(s, f"(SELECT * FROM v_rzone WHERE side='{side}' AND i='0.')", "level", "kind", f"'{way}.'") for s, side, way in (("breakout_scenarios", "exit", "above"), ("breakdown_scenarios", "entry", "below"))],
    *[_values(s, "v_dbrk", "level", "type volume_confirmed", f"'volume_confirmed_{s.removesuffix('_scenarios')}.'") for s in ("breakout_scenarios", "breakdown_scenarios")],
    *[_values(f"{s}_scenario", f"(SELECT * FROM {_sql('scenarios')} WHERE scenario='{s}')", "", "trigger targets invalidation supporting_factors weighting_hint") for s in ("bullish", "bearish", "neutral")],
    _values("technical_signal_summary", "v_rsummary", "", "overall headline"),
    _values("indicator_dashboard", _listed(_sql("indicator_dashboard"), "timeframe, indicator"), "", "timeframe indicator value", "i"),
    _values("mtf_signal_matrix", _listed("v_mtf", "timeframe"), "bull bear", "timeframe state", "i"),
    _values("upcoming_catalysts", _listed(_sql("catalysts"), "kind, date, title"), "", "date title kind", "i"),
    _values("historical_pattern_comparison", _listed(_sql("historical_analogues"), "rank"), "distance forward_20d_pct", "start_date end_date", "i"),
    _values("technical_risk_factors", _listed("v_risk", "position"), "", "flag", "i"),
    _values("overall_assessment", "v_rsummary", "price_vs_sma200_pct", "confluence=overall regime structure=classification structure_confidence=confidence"),
    _values("overall_assessment", "v_levels1", "risk_reward_to_tp1"),
    _texts("data_sources_methodology", price_adjustment="split+dividend adjusted", bar_filter="zero-volume placeholder bars dropped",
           indicator_definitions="Wilder smoothing, exponential averages seeded with the first value", levels="clustered levels, retracements and ATR; no discretion"),
]


# -- queries -------------------------------------------------------------------------------------


def _documents(v):
    return RP.technical_report(v.spark, v.bars, v.market_index, v.announcements, v.earnings, AS_OF)


@query("technical_report", " UNION ALL ".join(_PARTS))
def technical_report(v):
    """Every value of every section, read back from the sections' documents."""
    return RP.report_values(v.spark, _documents(v))


@query("report_documents", f"""SELECT symbol, CAST(unnest(range(0, {len(RP.SECTIONS)})) AS INTEGER) AS position, unnest([{', '.join(f"'{s}'" for s in RP.SECTIONS)}]) AS section, 'ok' AS status FROM v_bars GROUP BY symbol HAVING count(*) >= 260""")
def report_documents(v):
    """Sections of every symbol in order; the payloads are checked value by value in ``technical_report``."""
    return _documents(v).select("symbol", "position", "section", "status")


@query("section_status_counts", f"SELECT symbol, CAST({len(RP.SECTIONS)} AS BIGINT) AS ok, CAST(0 AS BIGINT) AS unsupported FROM v_bars GROUP BY 1 HAVING count(*) >= 260")
def section_status_counts(v):
    """Every symbol of the test tables has a year of bars and more, so no section may be missing."""
    return RP.section_status_counts(_documents(v))
