"""The 61-section technical report as long rows (symbol, position, section, status, reason, payload).

Each topic is reduced to JSON texts per symbol. The topics are stacked as
(symbol, name, text) rows and meet in one grouped pass per symbol - a single small
shuffle instead of a join per topic - and one ``inline`` spreads the sections. A
topic without data degrades to an 'unsupported' section; the document always has
all sections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import rolling as R
from tapeline.operators import bars as B
from tapeline.operators import indicators as I
from tapeline.operators import signals as SG
from tapeline.operators import structure as ST
from tapeline.session import cut_lineage, cut_partitioned

# Report sections in order.
SECTIONS = [
    "executive_summary", "asset_overview", "current_price_market_data",
    "multi_timeframe_price_analysis", "price_history", "trend_analysis",
    "market_structure",
    "support_resistance", "supply_demand_zones", "price_action_analysis",
    "candlestick_analysis", "chart_pattern_analysis", "breakout_breakdown",
    "moving_averages", "momentum_analysis", "rsi_analysis", "macd_analysis",
    "stochastic_analysis", "adx_analysis", "cci_analysis", "williams_r_analysis",
    "volume_analysis", "volume_profile", "vwap_analysis",
    "obv_accumulation_distribution", "volatility_analysis", "atr_analysis",
    "bollinger_bands_analysis", "historical_volatility", "relative_strength",
    "fibonacci_analysis", "ichimoku_analysis", "gap_analysis",
    "market_regime", "trend_vs_range", "bullish_bearish_signals",
    "indicator_confluence", "divergence_analysis", "short_term_setup",
    "medium_term_setup", "long_term_structure", "entry_zones", "exit_zones",
    "stop_loss", "take_profit_targets", "risk_reward", "invalidation_levels",
    "breakout_scenarios", "breakdown_scenarios", "bullish_scenario",
    "bearish_scenario", "neutral_scenario", "technical_signal_summary",
    "indicator_dashboard", "mtf_signal_matrix", "key_technical_levels",
    "upcoming_catalysts", "historical_pattern_comparison",
    "technical_risk_factors", "overall_assessment", "data_sources_methodology",
]
# Indicators shown per section.
INDICATOR_SECTIONS = {
    "moving_averages": ["sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "golden_death_cross_state"],
    "momentum_analysis": ["rsi_14", "macd", "macd_signal", "macd_hist", "stoch_k", "stoch_d", "cci_20", "williams_r_14"],
    "rsi_analysis": ["rsi_14"],
    "macd_analysis": ["macd", "macd_signal", "macd_hist"],
    "stochastic_analysis": ["stoch_k", "stoch_d"],
    "adx_analysis": ["adx_14", "plus_di_14", "minus_di_14"],
    "cci_analysis": ["cci_20"],
    "williams_r_analysis": ["williams_r_14"],
    "atr_analysis": ["atr_14"],
    "bollinger_bands_analysis": ["bb_upper", "bb_middle", "bb_lower"],
}
CHANGES = [f"change_pct_{c}" for c in I.CHANGE_LABELS]


def js(*cols) -> Column:
    """JSON object of columns, nulls left out."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "true"})


def obj(**parts: Column) -> Column:
    """JSON object of ready JSON texts; missing parts are left out."""
    fields = [F.concat(F.lit(f'"{k}":'), p) for k, p in parts.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))


def q(c: Column) -> Column:
    """Scalar column as JSON text, null when missing."""
    return F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', ""))


def rows_json(df: DataFrame, key, cols: list[str], name: str, order: list[str]) -> DataFrame:
    """One JSON array per key, ordered by ``order`` (lists here are bounded by the operators)."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*cols).alias("_v"))))
    texts = F.transform(packed, lambda x: F.to_json(x["_v"], {"ignoreNullFields": "true"}))
    return df.groupBy(*key).agg(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias(name))


def one_json(df: DataFrame, key, name: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.select(*key, js(*rest).alias(name))


def melt(df: DataFrame) -> DataFrame:
    """(symbol, name, text) rows of a topic's text columns."""
    names = [c for c in df.columns if c != "symbol"]
    return df.select("symbol", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("text")) for c in names])))


def _tf(df: DataFrame, tf: str, rename: dict | None = None) -> DataFrame:
    d = df.filter(F.col("timeframe") == tf).drop("timeframe")
    for a, b in (rename or {}).items():
        d = d.withColumnRenamed(a, b)
    return d


def technical_report(spark: SparkSession, bars: DataFrame, index: DataFrame, announcements: DataFrame, earnings: DataFrame, as_of: str) -> DataFrame:
    K = ["symbol", "timeframe"]
    S = ["symbol"]
    # the bars feed the history topics, the frames a dozen structure topics, the indicator row all signals
    # all of them dealt by symbol once, so no topic shuffles bars or frames again
    bars = cut_partitioned(spark, bars, S, ["symbol", "date"])
    fr = cut_partitioned(spark, R.number_rows(B.report_frames(bars), K), S, [*K, "rn"])
    last = cut_partitioned(spark, SG.report_last(fr.drop("rn", "rd", "n")), S, K)
    year = B.recent_years(bars, 1)
    day = SG.daily(last)

    sr = cut_lineage(spark, ST.support_resistance(fr))
    ms = cut_lineage(spark, ST.market_structure(fr))
    tr = _tf(ST.trend_regime(fr), "daily")
    div = _tf(ST.divergence(fr), "daily")
    brk = _tf(ST.breakout(fr), "daily")
    fib = I.fib_levels(fr.filter("timeframe = 'daily'").drop("timeframe", "rn", "rd", "n"))
    sig = cut_lineage(spark, SG.signals(day))
    conf = SG.confluence(sig)
    lv = cut_lineage(spark, SG.levels(day, _tf(sr, "daily"), fib))
    mtf = SG.mtf_matrix(last)
    hv = I.hv20_hv60(year)
    rs = I.rs_line(year, index)
    trend = SG.trend_dimensions(day, _tf(ms, "daily"), _tf(ms, "weekly"), conf)
    scen = SG.scenarios(lv, conf, sig)

    def by_tf(df, cols, order, name):
        both = rows_json(df.filter(F.col("timeframe").isin("daily", "weekly")), K, cols, name, order)
        return [_tf(both, "daily"), _tf(both, "weekly", {name: f"w_{name}"})]

    hist = B.price_history(bars)
    hist = rows_json(hist, K, ["date", *B.OHLC, "volume", "is_partial"], "hist", ["date"])
    topics: list[DataFrame] = [
        _tf(hist, "daily", {"hist": "hist_daily"}), _tf(hist, "weekly", {"hist": "hist_weekly"}),
        one_json(B.daily_candle(bars), S, "candle"),
        *by_tf(sr, ["side", "price", "touches"], ["price"], "sr"),
        rows_json(_tf(ST.supply_demand_zones(fr), "daily"), S, ["kind", "zone_low", "zone_high", "strength_pct", "volume_in_zone"], "zones", ["rank"]),
        one_json(_tf(ms, "daily"), S, "ms"),
        *[_tf(ms, tf).select("symbol", F.col("classification").alias(f"{p}_class"), F.col("confidence").alias(f"{p}_conf"))
          for tf, p in (("daily", "ms"), ("weekly", "wms"), ("monthly", "mms"))],
        one_json(tr, S, "regime_json"), tr.select("symbol", "regime"),
        *by_tf(ST.candle_hits(fr), ["date", "bar_offset_from_end", "pattern"], ["date", "pattern"], "candles"),
        *by_tf(ST.chart_patterns(fr), ["pattern"], ["pattern"], "charts"),
        one_json(brk, S, "brk"),
        rows_json(_tf(ST.gaps(fr), "daily"), S, ["date", "type", "gap_low", "gap_high", "gap_pct", "filled"], "gaps", ["rank"]),
        one_json(_tf(ST.value_area(ST.volume_profile(fr)), "daily"), S, "profile"),
        rows_json(div, S, ["type", "anchor"], "div", ["anchor"]),
        rows_json(fib, S, ["label", "level"], "fib_levels", ["label"]),
        fib.groupBy("symbol").agg(*[q(F.max(c)).alias(c) for c in ("swing_high", "swing_low", "direction")]),
        one_json(I.volume_stats(fr.filter("timeframe = 'daily'"), S), S, "vstats"),
        one_json(hv, S, "hv"), one_json(rs, S, "rs"),
        rows_json(sig, S, ["signal", "bias", "note"], "signals", ["position"]),
        conf.select("symbol", js(*[c for c in conf.columns if c != "symbol"]).alias("conf"), "overall", F.format_string(
            "%d bullish / %d bearish / %d neutral of %d deterministic signals", "bullish", "bearish", "neutral", "total_signals").alias("headline")),
        lv.select("symbol", js("entry_zones").alias("entry_zones"), js("exit_zones").alias("exit_zones"),
                  F.to_json(F.try_element_at("entry_zones", F.lit(1))).alias("entry1"), F.to_json(F.try_element_at("exit_zones", F.lit(1))).alias("exit1"),
                  js("stop_level", "stop_basis").alias("stop_loss"), js("tp1", "tp2", "tp3").alias("take_profit_targets"),
                  js("risk_reward_to_tp1").alias("risk_reward"), q(F.col("risk_reward_to_tp1")).alias("rr"),
                  js("invalidation_level", F.lit(SG.INVALIDATION_BASIS).alias("basis")).alias("invalidation_levels"),
                  js("reference_price", "entry_zones", "exit_zones", "stop_level", "tp1", "tp2", "tp3", "invalidation_level").alias("key_technical_levels")),
        *[one_json(scen.filter(F.col("scenario") == s).drop("scenario"), S, f"sc_{s}") for s in ("bullish", "bearish", "neutral")],
        one_json(trend, S, "trend"), trend.select("symbol", "trend_headline", q(F.col("price_vs_sma200_pct")).alias("vs200")),
        rows_json(mtf, S, ["timeframe", "state", "bull", "bear"], "mtf", ["timeframe"]),
        _tf(mtf, "daily").select("symbol", F.col("state").alias("daily_state")),
        rows_json(SG.dashboard(last), S, ["timeframe", "indicator", "value"], "dash", ["timeframe", "indicator"]),
        rows_json(SG.catalysts(announcements, SG.earnings_upcoming(earnings, as_of)), S, ["date", "title", "kind"], "catalysts", ["kind", "date", "title"]),
        rows_json(ST.historical_analogues(R.number_rows(year)), S, ["start_date", "end_date", "distance", "forward_20d_pct"], "analogues", ["rank"]),
        rows_json(SG.risk_flags(day, _tf(ms, "daily"), conf, div, hv, rs), S, ["flag"], "risks", ["position"]),
        last.filter("timeframe = 'weekly'").select("symbol", js("bars", "rsi_14", "sma_20", "sma_50", "sma_200", "golden_death_cross_state", *CHANGES).alias("weekly_row")),
        last.filter("timeframe = 'monthly'").select("symbol", js("rsi_14", "sma_20", "sma_50").alias("monthly_row")),
        rows_json(last, S, ["timeframe", "bars", "current_price", *CHANGES], "mtf_price", ["timeframe"]),
    ]
    names = [c for t in topics for c in t.columns if c != "symbol"]
    stacked = reduce(lambda a, b: a.unionByName(b), [melt(t) for t in topics])
    texts = stacked.groupBy("symbol").agg(*[F.max(F.when(F.col("name") == n, F.col("text"))).alias(n) for n in names])
    wide = day.join(texts, "symbol", "left")
    c = F.col
    level = lambda x: F.when(c("key_technical_levels").isNotNull(), x)
    no_levels = "daily timeframe unavailable"
    any_of = lambda cols: F.coalesce(*[c(x).cast("string") for x in cols]).isNotNull()
    volume = F.when(any_of(["obv", "acc_dist", "vstats"]), obj(obv=q(c("obv")), acc_dist=q(c("acc_dist")), volume_stats=c("vstats")))
    ich = ["ichimoku_tenkan", "ichimoku_kijun", "ichimoku_senkou_a", "ichimoku_senkou_b", "ichimoku_chikou"]
    cloud = F.when(c("current_price") > F.greatest("ichimoku_senkou_a", "ichimoku_senkou_b"), "above cloud (bullish)").when(
        c("current_price") < F.least("ichimoku_senkou_a", "ichimoku_senkou_b"), "below cloud (bearish)").otherwise("inside cloud (neutral)")
    price_known = c("current_price").isNotNull()
    sections: dict[str, tuple[Column, str]] = {
        "asset_overview": (js("symbol"), ""),
        "current_price_market_data": (F.when(price_known, js("current_price", "high_52w", "low_52w", *CHANGES)), "no live price"),
        "multi_timeframe_price_analysis": (c("mtf_price"), "no price data"),
        "price_history": (F.when(c("hist_daily").isNotNull(), obj(daily=c("hist_daily"), weekly=c("hist_weekly"))), "no price data"),
        "trend_analysis": (c("trend"), "insufficient bars"),
        "market_structure": (c("ms"), "insufficient bars"),
        "support_resistance": (F.when(c("sr").isNotNull(), obj(daily=c("sr"), weekly=c("w_sr"))), "insufficient bars"),
        "supply_demand_zones": (c("zones"), "no zones detected"),
        "price_action_analysis": (F.when(c("candle").isNotNull(), obj(
            note=q(F.lit("intraday data unavailable; price action described from the last completed daily candle")), daily_candle=c("candle"))), "no price data"),
        "candlestick_analysis": (F.coalesce(obj(daily=c("candles"), weekly=c("w_candles")), F.lit("{}")), "insufficient bars"),
        "chart_pattern_analysis": (obj(daily=c("charts"), weekly=c("w_charts")), "insufficient bars"),
        "breakout_breakdown": (F.coalesce(c("brk"), obj(note=q(F.lit("no active breakout/breakdown from the 60-bar range")))), ""),
        **{s: (F.when(any_of(cols), js(*cols)), "not computable on available data") for s, cols in INDICATOR_SECTIONS.items()},
        "volume_analysis": (volume, "no volume data"),
        "obv_accumulation_distribution": (volume, "no volume data"),
        "volume_profile": (c("profile"), "needs >= 20 bars with volume"),
        "vwap_analysis": (F.when(c("vwap_anchored").isNotNull(), js("vwap_anchored", "window_start", "window_end")), "no volume data"),
        "volatility_analysis": (F.when(any_of(["atr_14", "hv"]), obj(atr_14=q(c("atr_14")), historical=c("hv"))), "insufficient history"),
        "historical_volatility": (c("hv"), "insufficient history"),
        "relative_strength": (c("rs"), "benchmark history unavailable"),
        "fibonacci_analysis": (F.when(c("fib_levels").isNotNull(), obj(
            swing_high=c("swing_high"), swing_low=c("swing_low"), direction=c("direction"), levels=c("fib_levels"))), "insufficient bars for swing levels"),
        "ichimoku_analysis": (F.when(any_of(ich), js(*ich, cloud.alias("price_vs_cloud"))), "needs >= 78 bars (Senkou B shift)"),
        "gap_analysis": (obj(gaps=F.coalesce(c("gaps"), F.lit("[]"))), "no gaps found"),
        "market_regime": (c("regime_json"), "insufficient bars"),
        "trend_vs_range": (c("regime_json"), "insufficient bars"),
        "bullish_bearish_signals": (c("signals"), "no price data"),
        "indicator_confluence": (c("conf"), "no price data"),
        "divergence_analysis": (obj(divergences=F.coalesce(c("div"), F.lit("[]"))), "insufficient bars"),
        "short_term_setup": (level(js(F.lit("daily").alias("basis_timeframe"), "daily_state")), no_levels),
        "medium_term_setup": (F.when(c("weekly_row").isNotNull(), obj(indicators=c("weekly_row"), structure=q(c("wms_class")), structure_confidence=q(c("wms_conf")))), "weekly timeframe unavailable"),
        "long_term_structure": (F.when(c("monthly_row").isNotNull(), obj(indicators=c("monthly_row"), structure=q(c("mms_class")), structure_confidence=q(c("mms_conf")))), "monthly timeframe unavailable"),
        **{n: (c(n), no_levels) for n in ("entry_zones", "exit_zones", "stop_loss", "take_profit_targets", "risk_reward", "invalidation_levels", "key_technical_levels")},
        "breakout_scenarios": (level(obj(above=c("exit1"), volume_confirmed_breakout=c("brk"))), no_levels),
        "breakdown_scenarios": (level(obj(below=c("entry1"), volume_confirmed_breakdown=c("brk"))), no_levels),
        **{f"{s}_scenario": (c(f"sc_{s}"), "daily data or levels unavailable") for s in ("bullish", "bearish", "neutral")},
        "technical_signal_summary": (F.when(c("overall").isNotNull(), obj(overall=q(c("overall")), headline=q(c("headline")))), "no price data"),
        "indicator_dashboard": (c("dash"), "no price data"),
        "mtf_signal_matrix": (c("mtf"), "no price data"),
        "upcoming_catalysts": (c("catalysts"), "no announcements or earnings dates available"),
        "historical_pattern_comparison": (c("analogues"), "needs >= 120 daily bars"),
        "technical_risk_factors": (c("risks"), "no price data"),
        "overall_assessment": (obj(confluence=q(c("overall")), regime=q(c("regime")), structure=q(c("ms_class")), structure_confidence=q(c("ms_conf")),
                                   price_vs_sma200_pct=c("vs200"), risk_reward_to_tp1=c("rr")), "no price data"),
        "data_sources_methodology": (js(F.lit("split+dividend adjusted").alias("price_adjustment"), F.lit("zero-volume placeholder bars dropped").alias("bar_filter"),
                                        F.lit("Wilder smoothing, exponential averages seeded with the first value").alias("indicator_definitions"),
                                        F.lit("clustered levels, retracements and ATR; no discretion").alias("levels")), ""),
    }
    n_ok = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), 1).otherwise(0) for p, _ in sections.values()]) + 1
    wide = wide.withColumns({f"p_{n}": p for n, (p, _) in sections.items()}).withColumn("_ok", n_ok)
    summary = js(c("current_price").alias("price"), c("overall").alias("confluence"), "regime", c("ms_class").alias("structure_class"), c("ms_conf").alias("structure_confidence"),
                 "trend_headline", c("_ok").alias("sections_supported"), (F.lit(len(SECTIONS)) - c("_ok")).alias("sections_unsupported"))
    wide = wide.withColumn("p_executive_summary", summary)
    reasons = {n: r for n, (_, r) in sections.items()}
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("section"), F.when(c(f"p_{n}").isNotNull(), "ok").otherwise("unsupported").alias("status"),
                 F.when(c(f"p_{n}").isNull(), F.lit(reasons.get(n, "not assembled"))).alias("reason"), c(f"p_{n}").alias("payload"))
        for i, n in enumerate(SECTIONS)
    ]
    return wide.select("symbol", F.inline(F.array(*cells)))


def section_status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("symbol").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "unsupported").alias("unsupported")
    )


def report_values(spark: SparkSession, report: DataFrame, levels: int = 4) -> DataFrame:
    """The report's values, typed: (symbol, section, path, number, text), one row a value.

    ``path`` names the value inside its section, list entries by their number. Payloads are
    parsed once and opened level by level; no section is nested deeper than ``levels``.
    """
    report = cut_lineage(spark, report.where("payload IS NOT NULL").select("symbol", "section", "payload"))
    d = report.select("symbol", "section", F.lit("").alias("path"), F.parse_json("payload").alias("v"))
    found = []
    for _ in range(levels):
        d = spark.sql("""SELECT d.symbol, d.section, concat(d.path, CASE WHEN d.path = '' THEN '' ELSE '.' END, coalesce(e.key, CAST(e.pos AS STRING))) AS path, e.value AS v
            FROM {d} d, LATERAL variant_explode(d.v) e""", d=d)
        kind = F.schema_of_variant("v")
        plain = d.where(~(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID")))
        text = kind.isin("STRING", "BOOLEAN")
        found.append(plain.select("symbol", "section", "path", F.when(~text, F.expr("try_variant_get(v, '$', 'double')")).alias("number"), F.when(text, F.expr("try_variant_get(v, '$', 'string')")).alias("text")))
        d = d.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    return reduce(lambda a, b: a.unionByName(b), found)
