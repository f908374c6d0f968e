"""Signals, levels, scenarios and the sectioned report, from the last row of each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import rolling as R
from tapeline.functions.scalars import finite, number_text, round_scaled, safe_div
from tapeline.operators import bars as B
from tapeline.operators import indicators as I
from tapeline.operators import structure as ST

K = ("symbol", "timeframe")
# Bars the report needs before it shows the cloud.
ICHIMOKU_BARS = 78


def report_last(frames: DataFrame, keys=K) -> DataFrame:
    """One wide row per frame: indicators, slopes, cross state, changes, 52-week extremes, anchored VWAP."""
    d = I.change_windows(I.cross_state(I.sma_slope(I.indicator_frame(frames, keys), keys=keys)), keys)
    d = d.withColumns({"high_52w": F.max("high").over(R.back(252, keys)), "low_52w": F.min("low").over(R.back(252, keys))})
    r4 = lambda c: round_scaled(finite(F.col(c).cast("double")), 4)
    n = F.col("n")
    ind = {c: F.when(n >= need, r4(c)) for c, need in I.MIN_BARS.items() if not c.startswith("ichimoku")}
    cloud = {c: F.when(n >= ICHIMOKU_BARS, r4(c)) for c in
             ("ichimoku_tenkan", "ichimoku_kijun", "ichimoku_senkou_a", "ichimoku_senkou_b")}
    cloud["ichimoku_chikou"] = F.when(n >= ICHIMOKU_BARS, r4("close"))  # 26 bars ahead of bar -27 is the last close
    row = d.filter("rd = 1").select(
        *keys, n.alias("bars"), r4("close").alias("current_price"), "date",
        *[e.alias(c) for c, e in {**ind, **cloud}.items()],
        *[F.col(f"sma_{p}_slope_pct") for p in (20, 50, 200)], "golden_death_cross_state",
        *[F.col(f"change_pct_{c}") for c in I.CHANGE_LABELS], r4("high_52w").alias("high_52w"), r4("low_52w").alias("low_52w"),
    )
    return row.join(B.vwap_anchored(frames, keys), list(keys), "left")


def daily(last: DataFrame) -> DataFrame:
    return last.filter(F.col("timeframe") == "daily").drop("timeframe")


def _side(up: Column) -> Column:
    return F.when(up, "bullish").otherwise("bearish")


def _side_of(up: str) -> str:
    return f"CASE WHEN {up} THEN 'bullish' ELSE 'bearish' END"


def signal_rules(row: str = "") -> list[tuple[str, tuple[str, ...], str, str]]:
    """(signal, columns that must be there besides the price, bias, note) in SQL over the columns of ``row``.

    One text serves the DataFrame form (``signals``) and the table function (functions/sql.py).
    """
    p = f"{row}." if row else ""
    price, rsi, adx, cci, wr, k, d = (f"{p}{c}" for c in ("current_price", "rsi_14", "adx_14", "cci_20", "williams_r_14", "stoch_k", "stoch_d"))
    di = f"coalesce({p}plus_di_14, 0D) > coalesce({p}minus_di_14, 0D)"
    return [
        *[(f"price_vs_sma_{n}", (f"sma_{n}",), _side_of(f"{price} > {p}sma_{n}"), "''") for n in (20, 50, 200)],
        ("golden_death_cross_state", ("sma_50", "sma_200"), _side_of(f"{p}sma_50 > {p}sma_200"), "'50 above 200 = golden-cross state; below = death-cross state'"),
        ("rsi_14", ("rsi_14",), f"CASE WHEN {rsi} >= 70 THEN 'bearish' WHEN {rsi} <= 30 THEN 'bullish' WHEN {rsi} > 60 THEN 'bullish' WHEN {rsi} < 40 THEN 'bearish' ELSE 'neutral' END",
         f"CASE WHEN {rsi} >= 70 THEN 'overbought' WHEN {rsi} <= 30 THEN 'oversold' WHEN {rsi} > 60 OR {rsi} < 40 THEN '' ELSE '40-60 neutral band' END"),
        ("macd_vs_signal", ("macd", "macd_signal"), _side_of(f"{p}macd > {p}macd_signal"), "''"),
        ("stochastic", ("stoch_k", "stoch_d"), _side_of(f"{k} > {d}"), f"CASE WHEN {k} >= 80 THEN 'overbought' WHEN {k} <= 20 THEN 'oversold' ELSE '' END"),
        ("adx_14", ("adx_14",), f"CASE WHEN {adx} <= 20 THEN 'neutral' ELSE {_side_of(di)} END",
         f"CASE WHEN {adx} <= 20 THEN 'weak trend — direction unreliable' ELSE 'strength from ADX; direction from +DI vs -DI' END"),
        ("cci_20", ("cci_20",), f"CASE WHEN {cci} > 50 THEN 'bullish' WHEN {cci} < -50 THEN 'bearish' ELSE 'neutral' END", f"CASE WHEN {cci} > 50 OR {cci} < -50 THEN '' ELSE '±50 neutral band' END"),
        ("williams_r_14", ("williams_r_14",), _side_of(f"{wr} > -50"), f"CASE WHEN {wr} > -20 THEN 'overbought' WHEN {wr} < -80 THEN 'oversold' ELSE '' END"),
        ("price_vs_vwap", ("vwap_anchored",), _side_of(f"{price} > {p}vwap_anchored"), "'anchored to window start (see vwap_anchored_meta), not a session VWAP'"),
    ]


def signal_inputs() -> list[str]:
    """Columns that the rules read."""
    return ["current_price", *dict.fromkeys(c for _, needs, _, _ in signal_rules() for c in needs), "plus_di_14", "minus_di_14"]


def signal_array(row: str = "") -> str:
    """SQL of the array of a row's signals, in order, each with its position."""
    p = f"{row}." if row else ""
    some = [f"CASE WHEN {' AND '.join(f'{p}{c} IS NOT NULL' for c in ('current_price', *needs))} THEN struct('{name}' AS signal, {bias} AS bias, {note} AS note) END"
            for name, needs, bias, note in signal_rules(row)]
    return f"transform(array_compact(array({', '.join(some)})), (s, i) -> struct(i AS position, s.signal AS signal, s.bias AS bias, s.note AS note))"


def signals(day: DataFrame) -> DataFrame:
    """About a dozen deterministic calls per symbol: (symbol, position, signal, bias, note)."""
    return day.select("symbol", F.inline(F.expr(signal_array())))


def confluence(sig: DataFrame) -> DataFrame:
    g = sig.groupBy("symbol").agg(*[F.count_if(F.col("bias") == b).alias(b) for b in ("bullish", "bearish", "neutral")])
    total = F.col("bullish") + F.col("bearish") + F.col("neutral")
    g = g.withColumn("total_signals", total)
    t = F.col("total_signals")
    overall = (
        F.when(t == 0, "neutral")
        .when((F.col("bullish") / t >= 0.6) & (F.col("bullish") > F.col("bearish")), "bullish")
        .when((F.col("bearish") / t >= 0.6) & (F.col("bearish") > F.col("bullish")), "bearish")
        .otherwise("mixed")
    )
    return g.withColumn("overall", overall).withColumn("bullish_share", F.round(safe_div("bullish", "total_signals") * 100, 2))


def mtf_matrix(last: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Vote per timeframe; a timeframe without data reads 'unavailable'."""
    c = F.col
    vote = lambda up, dn: F.struct(up.cast("int").alias("b"), dn.cast("int").alias("s"))
    cond = lambda e: F.coalesce(e, F.lit(False))
    votes = [
        *[vote(cond(c("current_price") > c(f"sma_{p}")), cond(~(c("current_price") > c(f"sma_{p}")))) for p in (20, 50)],
        vote(cond(c("rsi_14") > 60), cond(c("rsi_14") < 40)),
        vote(cond(c("macd") > c("macd_signal")), cond(~(c("macd") > c("macd_signal")))),
    ]
    d = last.withColumns({"bull": sum((v["b"] for v in votes[1:]), votes[0]["b"]), "bear": sum((v["s"] for v in votes[1:]), votes[0]["s"])})
    state = F.when(c("bull") > c("bear"), "bullish").when(c("bear") > c("bull"), "bearish").otherwise("neutral")
    d = d.select("symbol", "timeframe", state.alias("state"), "bull", "bear")
    if sessions is not None:
        none = F.lit(None).cast("int")
        intraday = sessions.select(
            "symbol", F.lit("intraday").alias("timeframe"),
            F.when(c("above_vwap"), "bullish").when(~c("above_vwap"), "bearish").otherwise("neutral").alias("state"), none.alias("bull"), none.alias("bear"),
        )
        d = d.unionByName(intraday)
    names = F.array(*[F.lit(t) for t in ("intraday", "daily", "weekly", "monthly")])
    grid = d.select("symbol").distinct().select("symbol", F.explode(names).alias("timeframe"))
    return grid.join(d, ["symbol", "timeframe"], "left").withColumn("state", F.coalesce("state", F.lit("unavailable")))


# Retracements offered as entries and exits.
ENTRY_FIBS, EXIT_FIBS = ("38.2%", "50.0%", "61.8%"), ("23.6%", "38.2%")
INVALIDATION_BASIS = "loss of the deepest support cluster invalidates the bullish structure"


def levels(day: DataFrame, sr_daily: DataFrame, fib: DataFrame) -> DataFrame:
    """Entry and exit zones, stop, targets, risk/reward and invalidation per symbol."""
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("price"))))
    sr = sr_daily.groupBy("symbol").agg(F.reverse(side("support")).alias("sup"), side("resistance").alias("res"))
    f = fib.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("label", "level"))).alias("fib"))
    d = day.join(sr, "symbol", "left").join(f, "symbol", "left")
    none = F.array().cast("array<double>")
    d = d.withColumns({"sup": F.coalesce("sup", none), "res": F.coalesce("res", none)})
    price = F.col("current_price")
    zone = lambda kind, lvl: F.struct(F.lit(kind).alias("kind"), lvl.alias("level"))

    def fibs(labels, keep):
        out = []
        for lb in labels:
            lvl = F.try_element_at("fib", F.lit(lb))
            out.append(F.when(keep(lvl), zone(f"fib_{lb}", lvl)))
        return out

    at = lambda arr, i: F.try_element_at(arr, F.lit(i))
    entry = F.concat(
        F.transform(F.slice("sup", 1, 3), lambda x: zone("support", x)),
        F.array_compact(F.array(F.when((F.col("vwap_anchored") != 0) & (F.col("vwap_anchored") < price), zone("vwap", F.col("vwap_anchored"))),
                                *fibs(ENTRY_FIBS, lambda x: x < price))),
    )
    exit_ = F.concat(F.transform(F.slice("res", 1, 3), lambda x: zone("resistance", x)), F.array_compact(F.array(*fibs(EXIT_FIBS, lambda x: x > price))))
    order = lambda sign: (lambda a, b: F.when(a["level"] < b["level"], -sign).when(a["level"] > b["level"], sign).otherwise(0))
    swing, atr_stop = at("sup", 1), round_scaled(price - 2 * F.col("atr_14"), 4)
    use_atr = F.coalesce(atr_stop.isNotNull() & (swing.isNull() | (atr_stop > swing * 0.98)), F.lit(False))
    d = d.withColumns({
        "entry_zones": F.array_sort(entry, order(-1)), "exit_zones": F.array_sort(exit_, order(1)),
        "stop_level": F.when(use_atr, atr_stop).otherwise(swing),
        "stop_basis": F.when(use_atr, "2x ATR below price (tighter of structure/ATR)").when(swing.isNotNull(), "nearest confirmed support"),
        "tp1": at("res", 1), "tp2": at("res", 2), "tp3": at("res", 3), "invalidation_level": at("sup", -1),
    })
    rr = F.when(price > F.col("stop_level"), round_scaled(safe_div(F.col("tp1") - price, price - F.col("stop_level")), 2))
    return d.filter(price.isNotNull()).select(
        "symbol", price.alias("reference_price"), "entry_zones", "exit_zones", "stop_level", "stop_basis",
        "tp1", "tp2", "tp3", rr.alias("risk_reward_to_tp1"), "invalidation_level",
    )


def zone_text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda z: F.concat(z["kind"], F.lit("@"), number_text(z["level"]))), "; ")


def scenarios(lv: DataFrame, conf: DataFrame, sig: DataFrame) -> DataFrame:
    """Bull, bear and neutral rows: trigger, targets, invalidation, supporting signals."""
    factors = sig.groupBy("symbol").agg(*[
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("bias") == b, F.struct("position", "signal")))), lambda x: x["signal"]), 1, 4).alias(f"f_{b}")
        for b in ("bullish", "bearish", "neutral")
    ])
    d = lv.join(conf, "symbol").join(factors, "symbol")
    pick = lambda arr, kind: F.transform(F.filter(arr, lambda z: z["kind"] == kind), lambda z: z["level"])
    d = d.withColumns({"_sup": pick("entry_zones", "support"), "_res": pick("exit_zones", "resistance")})
    sup1, res1 = F.try_element_at("_sup", F.lit(1)), F.try_element_at("_res", F.lit(1))
    s = number_text
    txt = lambda *xs: F.array_join(F.array_compact(F.array(*[s(x) for x in xs])), ", ")
    hint = lambda b: F.concat(F.lit(f"{b} signals "), F.col(b).cast("string"), F.lit(" of "), F.col("total_signals").cast("string"))
    rows = F.array(
        F.struct(F.lit("bullish").alias("scenario"),
                 F.coalesce(F.concat(F.lit("close above resistance "), s(res1)), F.lit("sustained closes above current range high")).alias("trigger"),
                 txt(F.col("tp1"), F.col("tp2"), F.col("tp3")).alias("targets"), s(F.col("invalidation_level")).alias("invalidation"),
                 F.array_join("f_bullish", ", ").alias("supporting_factors"), hint("bullish").alias("weighting_hint")),
        F.struct(F.lit("bearish").alias("scenario"),
                 F.coalesce(F.concat(F.lit("close below support "), s(sup1)), F.lit("loss of the current range low")).alias("trigger"),
                 F.array_join(F.transform(F.slice("_sup", 1, 3), s), ", ").alias("targets"), s(res1).alias("invalidation"),
                 F.array_join("f_bearish", ", ").alias("supporting_factors"), hint("bearish").alias("weighting_hint")),
        F.struct(F.lit("neutral").alias("scenario"), F.lit("hold inside support/resistance band").alias("trigger"), txt(sup1, res1).alias("targets"),
                 F.lit("break of either band edge").alias("invalidation"), F.array_join("f_neutral", ", ").alias("supporting_factors"), F.col("overall").alias("weighting_hint")),
    )
    return d.select("symbol", F.inline(rows))


# Announcements and earnings dates shown as catalysts.
MAX_ANNOUNCEMENTS, MAX_EARNINGS = 8, 4


def earnings_upcoming(earnings: DataFrame, as_of: str, limit: int = MAX_EARNINGS) -> DataFrame:
    """First calendar entries from ``as_of`` on (the as-of date is a parameter, never the clock)."""
    win = Window.partitionBy("symbol").orderBy("date", "ord")
    d = earnings.filter(F.col("date").isNotNull() & (F.col("date") >= F.lit(as_of).cast("date")))
    return d.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= limit).drop("ord")


def catalysts(announcements: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Upcoming earnings and the titled ones among the newest eight announcements."""
    win = Window.partitionBy("symbol").orderBy(F.col("published_at").desc(), "ord")
    a = announcements.withColumn("_r", F.row_number().over(win)).filter(F.col("_r") <= MAX_ANNOUNCEMENTS)
    a = a.select("symbol", F.coalesce("date", "broadcast_date").alias("date"), F.coalesce("heading", "subject", "title").alias("title"),
                 F.lit("announcement").alias("kind")).filter(F.col("title").isNotNull())
    e = upcoming.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), F.lit("Earnings date").alias("title"), F.lit("earnings").alias("kind"))
    return e.unionByName(a)


def risk_flags(day: DataFrame, ms: DataFrame, conf: DataFrame, div: DataFrame, hv: DataFrame, bench: DataFrame) -> DataFrame:
    """(symbol, position, flag); a default line when nothing triggers."""
    c = F.col
    d = day.join(ms.select("symbol", "classification"), "symbol", "left").join(conf.select("symbol", "overall"), "symbol", "left")
    dv = div.groupBy("symbol").agg(F.array_sort(F.collect_list(F.concat_ws("|", "anchor", "type"))).alias("_div"))
    d = d.join(dv, "symbol", "left").join(hv.select("symbol", "hv_20d_annualized_pct"), "symbol", "left")
    d = d.join(bench.select("symbol", F.lit(True).alias("_bench")), "symbol", "left")
    dd = (c("current_price") / c("high_52w") - 1) * 100
    text = lambda x: x.cast("string")
    flags = F.array(
        F.when(c("adx_14") < 20, "ADX below 20: range regime — trend-following signals less reliable"),
        F.when(c("hv_20d_annualized_pct") > 60, F.concat(F.lit("20d realized volatility "), text(c("hv_20d_annualized_pct")), F.lit("%: elevated — size positions accordingly"))),
        F.when(dd < -20, F.concat(text(F.round(dd, 1)), F.lit("% below the 52-week high: deep drawdown"))),
        F.when(c("golden_death_cross_state") == "death-cross regime", "SMA50 below SMA200: death-cross regime"),
        F.when(c("current_price") < c("sma_200"), "price below SMA200: long-term trend filter is bearish"),
        F.when(c("change_pct_1y") < -20, F.concat(F.lit("1y change "), text(c("change_pct_1y")), F.lit("%: significant capital loss over the last year"))),
        F.when(c("classification").startswith("uptrend") & c("overall").isin("bearish", "mixed"),
               F.concat(F.lit("pivot structure says uptrend while indicator confluence is "), c("overall"), F.lit(" — treat the structure label as low confidence"))),
    )
    divs = F.transform(F.coalesce("_div", F.array().cast("array<string>")), lambda x: F.concat(
        F.split_part(x, F.lit("|"), F.lit(2)), F.lit(" divergence against current trend at "), F.split_part(x, F.lit("|"), F.lit(1))))
    tail = F.array(F.when(c("_bench").isNull(), "relative strength could not be computed — benchmark feed unavailable"))
    allf = F.concat(F.array_compact(flags), divs, F.array_compact(tail))
    shown = F.when(F.size(allf) > 0, allf).otherwise(F.array(F.lit("no quantitative risk flags triggered")))
    return d.withColumn("_f", shown).select("symbol", F.posexplode("_f").alias("position", "flag"))


def trend_dimensions(day: DataFrame, ms_daily: DataFrame, ms_weekly: DataFrame, conf: DataFrame) -> DataFrame:
    """Structural direction, current momentum, DI direction, their agreement and the headline."""
    c = F.col
    d = day.join(ms_daily.select("symbol", "classification", "confidence"), "symbol", "left").join(conf.select("symbol", "overall"), "symbol", "left")
    d = d.join(ms_weekly.select("symbol", F.col("classification").alias("weekly")), "symbol", "left")
    direction = (
        F.when(c("classification").startswith("uptrend"), "bullish").when(c("classification").startswith("downtrend"), "bearish")
        .otherwise(F.coalesce("classification", F.lit("unknown")))
    )
    di = F.when(F.coalesce(c("adx_14") <= 20, F.lit(True)), "unreliable (ADX<=20)").otherwise(
        _side(F.coalesce("plus_di_14", F.lit(0.0)) > F.coalesce("minus_di_14", F.lit(0.0))))
    d = d.withColumns({"structural_direction": direction, "di_direction": di, "weekly_structure": F.coalesce("weekly", F.lit("unknown"))})
    sided = ("bullish", "bearish")
    d = d.withColumn("agreement", F.when(c("structural_direction").isin(*sided) & c("overall").isin(*sided), c("structural_direction") == c("overall")))
    headline = (
        F.when(~c("agreement"), F.concat(F.lit("structural "), c("structural_direction"), F.lit(" ("), c("confidence"), F.lit(" confidence) conflicts with "),
                                         c("overall"), F.lit(" current momentum — weekly structure: "), c("weekly_structure")))
        .when(c("agreement"), F.concat(F.lit("structural and current trend aligned: "), c("overall")))
        .otherwise(F.concat(F.lit("current momentum "), c("overall"), F.lit("; structure "), c("structural_direction")))
    )
    vs200 = F.round((safe_div("current_price", "sma_200") - 1) * 100, 2)
    return d.select("symbol", "structural_direction", "confidence", F.col("overall").alias("momentum"), "di_direction",
                    vs200.alias("price_vs_sma200_pct"), "agreement", "weekly_structure", headline.alias("trend_headline"))


# Indicator rows of the dashboard.
DASHBOARD = (
    "sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "rsi_14", "macd", "macd_signal", "macd_hist", "stoch_k", "stoch_d",
    "adx_14", "plus_di_14", "minus_di_14", "cci_20", "williams_r_14", "atr_14", "bb_upper", "bb_middle", "bb_lower",
    "golden_death_cross_state",
)


def dashboard(last: DataFrame) -> DataFrame:
    """(symbol, timeframe, indicator, value) without nulls."""
    wide = last.select(*K, *[(F.col(c) if c == "golden_death_cross_state" else number_text(c)).alias(c) for c in DASHBOARD])
    return wide.unpivot(list(K), list(DASHBOARD), "indicator", "value").filter(F.col("value").isNotNull())


def setups(last: DataFrame, ms: DataFrame, lv: DataFrame, mtf: DataFrame) -> DataFrame:
    """Short-, medium- and long-term rows from the daily, weekly and monthly frames."""
    m = ms.select(*K, "classification", "confidence")
    d = last.join(m, list(K), "left").join(mtf.select(*K, "state"), list(K), "left")
    near = lv.select("symbol", F.try_element_at("exit_zones", F.lit(1))["level"].alias("nearest_exit"),
                     F.try_element_at("entry_zones", F.lit(1))["level"].alias("nearest_entry"))
    d = d.join(near, "symbol", "left")
    horizon = F.when(F.col("timeframe") == "daily", "short_term_setup").when(F.col("timeframe") == "weekly", "medium_term_setup").otherwise("long_term_structure")
    short = F.col("timeframe") == "daily"
    return d.select("symbol", horizon.alias("setup"), F.col("timeframe").alias("basis_timeframe"), F.when(short, F.col("state")).alias("state"),
                    F.when(short, F.col("nearest_exit")).alias("nearest_resistance"), F.when(short, F.col("nearest_entry")).alias("nearest_support"),
                    F.when(~short, F.col("rsi_14")).alias("rsi_14"), F.when(~short, F.col("sma_20")).alias("sma_20"), F.when(~short, F.col("sma_50")).alias("sma_50"),
                    F.when(~short, F.col("classification")).alias("structure"), F.when(~short, F.col("confidence")).alias("structure_confidence"))
