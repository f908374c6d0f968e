"""Indicator series and last values.

Every function adds columns to a bar table; ``keys`` names the series (symbol, or
symbol and timeframe). All windows of one frame share partitioning and order, so a
full indicator row costs one shuffle and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import rolling as R
from tapeline.functions.ewm import ewm, span_alpha, wilder_alpha
from tapeline.functions.scalars import finite, round_scaled, safe_div, typical_price

KEYS = ("symbol",)


def _lag(c, n=1, keys=KEYS) -> Column:
    return F.lag(c, n).over(R.w(keys))


def sma(df: DataFrame, lengths=(20, 50, 200), keys=KEYS) -> DataFrame:
    return df.withColumns({f"sma_{n}": R.exact_mean_n("close", n, keys) for n in lengths})


def bollinger(df: DataFrame, n=20, width=2.0, keys=KEYS) -> DataFrame:
    mid = R.exact_mean_n("close", n, keys)
    sd = R.full(F.stddev_pop("close"), "close", n, keys)
    return df.withColumns({"bb_upper": mid + width * sd, "bb_middle": mid, "bb_lower": mid - width * sd})


def stochastic(df: DataFrame, k=14, d=3, smooth=3, keys=KEYS) -> DataFrame:
    lo, hi = R.min_n("low", k, keys), R.max_n("high", k, keys)
    df = df.withColumn("_fast", safe_div(100.0 * (F.col("close") - lo), hi - lo))
    df = df.withColumn("stoch_k", R.mean_n("_fast", smooth, keys))
    return df.withColumn("stoch_d", R.mean_n("stoch_k", d, keys)).drop("_fast")


def williams_r(df: DataFrame, n=14, keys=KEYS) -> DataFrame:
    hh, ll = R.max_n("high", n, keys), R.min_n("low", n, keys)
    return df.withColumn(f"williams_r_{n}", safe_div(-100.0 * (hh - F.col("close")), hh - ll))


def cci(df: DataFrame, n=20, keys=KEYS) -> DataFrame:
    """Mean absolute deviation needs the window's own mean, hence the bounded n-element array."""
    df = df.withColumn("_tp", typical_price())
    df = df.withColumn("_m", R.mean_n("_tp", n, keys)).withColumn("_a", F.collect_list("_tp").over(R.back(n, keys)))
    dev = F.aggregate("_a", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_m"))) / n
    return df.withColumn(f"cci_{n}", safe_div(F.col("_tp") - F.col("_m"), 0.015 * dev)).drop("_tp", "_m", "_a")


def obv(df: DataFrame, keys=KEYS) -> DataFrame:
    sign = F.coalesce(F.signum(F.col("close") - _lag("close", 1, keys)), F.lit(0.0)).cast("bigint")
    return df.withColumn("_sv", sign * F.col("volume")).withColumn("obv", F.sum("_sv").over(R.running(keys))).drop("_sv")


def acc_dist(df: DataFrame, keys=KEYS) -> DataFrame:
    hl = F.col("high") - F.col("low")
    clv = safe_div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), hl)
    df = df.withColumn("_ad", F.coalesce(clv * F.col("volume"), F.lit(0.0)))
    return df.withColumn("acc_dist", F.sum("_ad").over(R.running(keys))).drop("_ad")


def vwap_running(df: DataFrame, keys=KEYS) -> DataFrame:
    df = df.withColumn("_tpv", typical_price() * F.col("volume"))
    total, vol = F.sum("_tpv").over(R.running(keys)), F.sum("volume").over(R.running(keys))
    return df.withColumn("vwap", safe_div(total, vol)).drop("_tpv")


def log_return(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.withColumn("log_ret", F.ln(safe_div("close", _lag("close", 1, keys))))


def hist_volatility(df: DataFrame, n=20, bars_per_year=252, keys=KEYS) -> DataFrame:
    df = log_return(df, keys)
    sd = R.full(F.stddev_samp("log_ret"), "log_ret", n, keys)
    return df.withColumn("hist_volatility", sd * math.sqrt(bars_per_year) * 100.0)


def hv20_hv60(df: DataFrame, keys=KEYS) -> DataFrame:
    """Annualised sample volatility of the last 20 and 60 log returns; needs more than 60 bars."""
    d = log_return(R.number_rows(df, keys), keys).filter((F.col("n") > 60) & (F.col("rd") <= 60))
    year = math.sqrt(252)
    return d.groupBy(*keys).agg(
        F.round(F.stddev_samp(F.when(F.col("rd") <= 20, F.col("log_ret"))) * year * 100, 4).alias("hv_20d_annualized_pct"),
        F.round(F.stddev_samp("log_ret") * year * 100, 4).alias("hv_60d_annualized_pct"),
    )


def ichimoku(df: DataFrame, keys=KEYS) -> DataFrame:
    mid = lambda n: (R.max_n("high", n, keys) + R.min_n("low", n, keys)) / 2.0
    df = df.withColumns({"ichimoku_tenkan": mid(9), "ichimoku_kijun": mid(26), "_m52": mid(52)})
    win = R.w(keys)
    return df.withColumns({
        "ichimoku_senkou_a": F.lag((F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2.0, 26).over(win),
        "ichimoku_senkou_b": F.lag("_m52", 26).over(win),
        "ichimoku_chikou": F.lead("close", 26).over(win),
    }).drop("_m52")


def price_vs_cloud(df: DataFrame) -> DataFrame:
    a, b, p = F.col("ichimoku_senkou_a"), F.col("ichimoku_senkou_b"), F.col("close")
    label = (
        F.when(p > F.greatest(a, b), "above cloud (bullish)")
        .when(p < F.least(a, b), "below cloud (bearish)")
        .otherwise("inside cloud (neutral)")
    )
    return df.withColumn("price_vs_cloud", F.when(a.isNotNull() & b.isNotNull() & p.isNotNull(), label))


def movement(df: DataFrame, keys=KEYS) -> DataFrame:
    """Inputs of the recursive family: gains, losses, true range, directional movement."""
    pc = _lag("close", 1, keys)
    delta = F.col("close") - pc
    up = F.col("high") - _lag("high", 1, keys)
    down = _lag("low", 1, keys) - F.col("low")
    return df.withColumns({
        "_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
        "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })


def rsi_of(gain, loss) -> Column:
    """No losses with gains reads 100; neither gives null."""
    g, l = F.col(gain), F.col(loss)  # noqa: E741
    return F.when((l == 0) & (g > 0), 100.0).otherwise(100.0 - F.try_divide(F.lit(100.0), 1.0 + safe_div(g, l)))


WILDER = wilder_alpha(14)


def ema(df: DataFrame, spans=(12, 26), keys=KEYS) -> DataFrame:
    return ewm(df, [(f"ema_{n}", "close", span_alpha(n)) for n in spans], keys)


def rsi(df: DataFrame, keys=KEYS) -> DataFrame:
    d = ewm(movement(df, keys), [("_ag", "_gain", WILDER), ("_al", "_loss", WILDER)], keys)
    return d.withColumn("rsi_14", rsi_of("_ag", "_al")).drop("_ag", "_al", "_gain", "_loss", "_tr", "_pdm", "_mdm")


def atr(df: DataFrame, keys=KEYS) -> DataFrame:
    d = ewm(movement(df, keys), [("atr_14", "_tr", WILDER)], keys)
    return d.drop("_gain", "_loss", "_tr", "_pdm", "_mdm")


def macd(df: DataFrame, keys=KEYS) -> DataFrame:
    d = ema(df, (12, 26), keys).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    d = ewm(d, [("macd_signal", "macd", span_alpha(9))], keys)
    return d.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def _directional(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "plus_di_14": safe_div(100.0 * F.col("_p"), F.col("_atr")),
        "minus_di_14": safe_div(100.0 * F.col("_m"), F.col("_atr")),
    })
    total = F.col("plus_di_14") + F.col("minus_di_14")
    return df.withColumn("_dx", safe_div(100.0 * F.abs(F.col("plus_di_14") - F.col("minus_di_14")), total))


def adx_di(df: DataFrame, keys=KEYS) -> DataFrame:
    """ADX with +DI and -DI.

    DX is missing only before the first directional move (a smoothed movement
    never returns to exactly zero), so the smoothing sees leading nulls only.
    """
    d = ewm(movement(df, keys), [("_p", "_pdm", WILDER), ("_m", "_mdm", WILDER), ("_atr", "_tr", WILDER)], keys)
    d = ewm(_directional(d), [("adx_14", "_dx", WILDER)], keys)
    return d.drop("_p", "_m", "_atr", "_dx", "_gain", "_loss", "_tr", "_pdm", "_mdm")


def recursive_family(df: DataFrame, keys=KEYS) -> DataFrame:
    """EMA, RSI, MACD, ATR, ADX and DI in two smoothing passes."""
    d = ewm(movement(df, keys), [
        ("ema_12", "close", span_alpha(12)), ("ema_26", "close", span_alpha(26)),
        ("_ag", "_gain", WILDER), ("_al", "_loss", WILDER),
        ("atr_14", "_tr", WILDER), ("_p", "_pdm", WILDER), ("_m", "_mdm", WILDER),
    ], keys)
    d = d.withColumns({"rsi_14": rsi_of("_ag", "_al"), "macd": F.col("ema_12") - F.col("ema_26"), "_atr": F.col("atr_14")})
    d = ewm(_directional(d), [("adx_14", "_dx", WILDER), ("macd_signal", "macd", span_alpha(9))], keys)
    d = d.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return d.drop("_ag", "_al", "_p", "_m", "_atr", "_dx", "_gain", "_loss", "_tr", "_pdm", "_mdm")


def sma_slope(df: DataFrame, lengths=(20, 50, 200), keys=KEYS) -> DataFrame:
    """Percent change of each SMA over the last 5 bars."""
    return df.withColumns({
        f"sma_{n}_slope_pct": F.round((safe_div(f"sma_{n}", _lag(f"sma_{n}", 5, keys)) - 1) * 100, 2) for n in lengths
    })


def cross_state(df: DataFrame) -> DataFrame:
    both = F.col("sma_50").isNotNull() & F.col("sma_200").isNotNull()
    label = F.when(F.col("sma_50") > F.col("sma_200"), "golden-cross regime").otherwise("death-cross regime")
    return df.withColumn("golden_death_cross_state", F.when(both, label))


# Bar-count lookback per change label and timeframe.
CHANGE_WINDOWS = {
    "daily": (("1d", 1), ("1w", 5), ("1m", 21), ("3m", 63), ("1y", 252)),
    "weekly": (("1w", 1), ("1m", 4), ("3m", 13), ("1y", 52)),
    "monthly": (("1m", 1), ("3m", 3), ("1y", 12)),
}
CHANGE_LABELS = ("1d", "1w", "1m", "3m", "1y")


def change_windows(df: DataFrame, keys=("symbol", "timeframe")) -> DataFrame:
    """Percent change per label; the bar count behind a label depends on the timeframe."""
    cols = {}
    for label in CHANGE_LABELS:
        out = F.lit(None).cast("double")
        for tf, windows in CHANGE_WINDOWS.items():
            n = dict(windows).get(label)
            if n is not None:
                chg = F.round((safe_div("close", _lag("close", n, keys)) - 1) * 100, 2)
                out = F.when(F.col("timeframe") == tf, chg).otherwise(out)
        cols[f"change_pct_{label}"] = out
    return df.withColumns(cols)


# Indicators of the last-value row and the bars each needs.
MIN_BARS = {
    "sma_20": 20, "sma_50": 50, "sma_200": 200, "ema_12": 12, "ema_26": 26,
    "rsi_14": 14, "macd": 26, "macd_signal": 26, "macd_hist": 26,
    "bb_upper": 20, "bb_middle": 20, "bb_lower": 20, "atr_14": 14, "williams_r_14": 14,
    "adx_14": 14, "plus_di_14": 14, "minus_di_14": 14, "cci_20": 20, "stoch_k": 14, "stoch_d": 14,
    "obv": 1, "acc_dist": 1, "ichimoku_tenkan": 26, "ichimoku_kijun": 26,
    "ichimoku_senkou_a": 26, "ichimoku_senkou_b": 26, "ichimoku_chikou": 27,
}


def indicator_frame(frames: DataFrame, keys=("symbol", "timeframe")) -> DataFrame:
    """All indicator series of every frame, row numbers included."""
    d = R.number_rows(frames, keys)
    d = sma(d, keys=keys)
    d = bollinger(d, keys=keys)
    d = stochastic(d, keys=keys)
    d = williams_r(d, keys=keys)
    d = cci(d, keys=keys)
    d = obv(d, keys=keys)
    d = acc_dist(d, keys=keys)
    d = ichimoku(d, keys=keys)
    return recursive_family(d, keys=keys)


def technicals_last(frames: DataFrame, keys=("symbol", "timeframe")) -> DataFrame:
    """One row per frame: bars, price and each indicator's last value when the frame is long enough."""
    last = indicator_frame(frames, keys).filter(F.col("rd") == 1)
    digits = lambda c: round_scaled(finite(F.col(c).cast("double")), 4)
    return last.select(
        *keys, F.col("n").alias("bars"), F.col("close").alias("current_price"),
        *[F.when(F.col("n") >= need, digits(c)).alias(c) for c, need in MIN_BARS.items()],
    )


# Retracement ratios.
FIB_RATIOS = {"0.0%": 0.0, "23.6%": 0.236, "38.2%": 0.382, "50.0%": 0.5, "61.8%": 0.618, "78.6%": 0.786, "100.0%": 1.0}


def fib_swing(df: DataFrame, lookback=120, keys=KEYS) -> DataFrame:
    """Swing extremes of the last bars; up when the (first) high is not before the (first) low."""
    win = R.tail(df, lookback, keys)
    sw = win.groupBy(*keys).agg(
        F.max("high").alias("swing_high"), F.min("low").alias("swing_low"),
        F.min_by("date", F.struct(-F.col("high"), F.col("date"))).alias("_hd"),
        F.min_by("date", F.struct("low", "date")).alias("_ld"),
    )
    sw = sw.filter(F.col("swing_high") != F.col("swing_low"))
    return sw.withColumn("direction", F.when(F.col("_hd") >= F.col("_ld"), "up").otherwise("down")).drop("_hd", "_ld")


def fib_level(ratio: float) -> Column:
    diff = F.col("swing_high") - F.col("swing_low")
    up = F.col("swing_high") - diff * ratio
    return round_scaled(F.when(F.col("direction") == "up", up).otherwise(F.col("swing_low") + diff * ratio), 4)


def fib_levels(df: DataFrame, lookback=120, keys=KEYS) -> DataFrame:
    levels = F.array(*[F.struct(F.lit(k).alias("label"), fib_level(r).alias("level")) for k, r in FIB_RATIOS.items()])
    return fib_swing(df, lookback, keys).select(*keys, "swing_high", "swing_low", "direction", F.inline(levels))


def rs_line(bars: DataFrame, index: DataFrame) -> DataFrame:
    """Relative strength against a benchmark over their common dates (at least 60)."""
    b = index.select("date", F.col("close").alias("bench"))
    d = R.number_rows(bars.select("symbol", "date", "close").join(b, "date"))
    d = d.withColumn("ratio", safe_div("close", "bench"))
    past = {}
    for label, n in (("1m", 20), ("3m", 62)):
        past[f"rs_ratio_{label}_ago"] = F.round(_lag("ratio", n), 6)
    d = d.withColumns({
        **past,
        "rs_ratio": F.round("ratio", 6),
        "stock_3m_change_pct": F.round((safe_div("close", _lag("close", 62)) - 1) * 100, 2),
        "benchmark_3m_change_pct": F.round((safe_div("bench", _lag("bench", 62)) - 1) * 100, 2),
    }).filter((F.col("rd") == 1) & (F.col("n") >= 60))
    r, m1, m3 = F.col("rs_ratio"), F.col("rs_ratio_1m_ago"), F.col("rs_ratio_3m_ago")
    long_enough = F.col("n") > 63
    verdict = (
        F.when((r > m1) & (m1 > m3), "outperforming (RS rising across 1m and 3m)")
        .when((r < m1) & (m1 < m3), "underperforming (RS falling across 1m and 3m)")
        .otherwise("mixed")
    )
    gate = lambda c: F.when(long_enough, F.col(c)).alias(c)
    return d.select(
        "symbol", "rs_ratio", F.when(F.col("n") > 21, m1).alias("rs_ratio_1m_ago"), gate("rs_ratio_3m_ago"),
        gate("stock_3m_change_pct"), gate("benchmark_3m_change_pct"), F.when(long_enough, verdict).alias("verdict"),
    )


def volume_base(numbered: DataFrame, keys=KEYS) -> DataFrame:
    """avg20, recent5, their ratio and trend per series, median intraday range included."""
    v = F.col("volume").cast("double")
    rng = safe_div(F.col("high") - F.col("low"), F.col("low")) * 100
    g = numbered.groupBy(*keys).agg(
        F.sum("volume").alias("_total"),
        F.avg(F.when(F.col("rd") <= 20, v)).alias("_avg20"),
        F.avg(F.when(F.col("rd") <= 5, v)).alias("_recent5"),
        F.median(rng).alias("_med"),
    ).filter((F.col("_total") > 0) & (F.col("_avg20") > 0))
    ratio = F.col("_recent5") / F.col("_avg20")
    return g.withColumn("_ratio", ratio).withColumn(
        "trend", F.when(ratio > 1.2, "rising").when(ratio < 0.8, "falling").otherwise("stable")
    )


def volume_stats(numbered: DataFrame, keys=KEYS) -> DataFrame:
    return volume_base(numbered, keys).select(
        *keys, F.round("_avg20", 4).alias("avg_volume_20bar"), F.round("_recent5", 4).alias("recent_5bar_avg"),
        F.round("_ratio", 4).alias("recent_vs_avg20_ratio"), "trend",
    )


def volume_spikes(numbered: DataFrame, keys=KEYS) -> DataFrame:
    """Top five bars of the last 60 above twice the 20-bar average."""
    d = numbered.filter(F.col("rd") <= 60).join(volume_base(numbered, keys), list(keys))
    d = d.filter(F.col("volume") > 2 * F.col("_avg20")).withColumn("multiple_of_avg20", F.round(F.col("volume") / F.col("_avg20"), 4))
    win = R.Window.partitionBy(*keys).orderBy(F.col("multiple_of_avg20").desc(), "date")
    return d.withColumn("rank", F.row_number().over(win)).filter("rank <= 5").select(*keys, "rank", "date", "multiple_of_avg20")


def unusual_days(numbered: DataFrame, keys=KEYS) -> DataFrame:
    """Top five bars whose range exceeds three times the median range."""
    rng = safe_div(F.col("high") - F.col("low"), F.col("low")) * 100
    d = numbered.withColumn("_r", rng).join(volume_base(numbered, keys), list(keys))
    d = d.filter((F.col("_med") > 0) & (F.col("_r") > 3 * F.col("_med")))
    win = R.Window.partitionBy(*keys).orderBy(F.col("range_pct").desc(), "date")
    return (
        d.withColumn("range_pct", F.round("_r", 4))
        .withColumn("rank", F.row_number().over(win)).filter("rank <= 5")
        .select(*keys, "rank", "date", "range_pct",
                F.round((safe_div("close", "open") - 1) * 100, 4).alias("close_change_pct"),
                F.when(F.col("volume") != 0, F.round(F.col("volume") / F.col("_avg20"), 4)).alias("volume_multiple_of_avg20"))
    )
