"""Bar-level operators: cleaning, ranges, resampling, frames per timeframe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import rolling as R
from tapeline.functions.scalars import col, finite, safe_div

OHLC = ["open", "high", "low", "close"]


def scan_bars(df: DataFrame) -> DataFrame:
    """Typed bar rows: NaN to null per field, whole-number volume."""
    price = [c for c in (*OHLC, "adjusted_close") if c in df.columns]
    return df.select(
        *[c for c in df.columns if c not in price + ["volume"]],
        *[finite(F.col(c).cast("double")).alias(c) for c in price],
        F.col("volume").cast("bigint").alias("volume"),
    )


def clean_bars(df: DataFrame) -> DataFrame:
    """Drop partial bars (any OHLC missing) and zero-volume placeholders."""
    return df.dropna(subset=OHLC).filter(F.coalesce(F.col("volume"), F.lit(0)) > 0)


def filter_range(df: DataFrame, start=None, end=None, exchange=None, country=None) -> DataFrame:
    """Inclusive date range with optional exchange and country; all push to the scan."""
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    if exchange is not None:
        df = df.filter(F.col("exchange") == exchange)
    if country is not None:
        df = df.filter(F.col("country") == country)
    return df


def period_label(rule: str) -> Column:
    """Right edge of the bar's bucket: the Sunday of its week or its month end."""
    if rule == "week":
        return F.date_add(F.date_trunc("week", F.col("date")).cast("date"), 6)
    if rule == "month":
        return F.last_day(F.col("date"))
    raise ValueError(f"unknown rule {rule!r}; use 'week' or 'month'")


def resample(df: DataFrame, rule: str, keys=("symbol",)) -> DataFrame:
    """Daily to weekly / month-end bars: first open, extremes, last close, summed volume.

    Nulls are skipped inside a bucket; a bucket without an open or close is dropped.
    The aggregate combines map-side, so a hot symbol costs one row per bucket and task.
    """
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("date"))
    return (
        df.groupBy(*keys, period_label(rule).alias("bucket"))
        .agg(
            F.min_by("open", has("open")).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", has("close")).alias("close"),
            F.sum("volume").cast("bigint").alias("volume"),
        )
        .withColumnRenamed("bucket", "date")
        .dropna(subset=["open", "close"])
    )


def resample_stored(df: DataFrame, interval: str, keys=("symbol", "exchange")) -> DataFrame:
    """Stored bars per ISO week or calendar month, labelled by the last trading date.

    Open comes from the first row and the closes from the last row even when null;
    high, low and volume skip nulls.
    """
    if interval == "week":
        bucket = [F.extract(F.lit("YEAROFWEEK"), "date").alias("_y"), F.extract(F.lit("WEEK"), "date").alias("_p")]
    else:
        bucket = [F.year("date").alias("_y"), F.month("date").alias("_p")]
    first = F.min(F.struct("date", "open"))
    last = F.max(F.struct("date", "close", "adjusted_close"))
    return (
        df.groupBy(*keys, *bucket)
        .agg(first.alias("_f"), last.alias("_l"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.sum("volume").cast("bigint").alias("volume"))
        .select(*keys, F.col("_l.date").alias("date"), F.col("_f.open").alias("open"), "high", "low",
                F.col("_l.close").alias("close"), F.col("_l.adjusted_close").alias("adjusted_close"), "volume")
    )


def recent_years(df: DataFrame, years: int | None, keys=("symbol",)) -> DataFrame:
    """Bars of the last ``years`` years before each symbol's newest bar; None keeps the whole history."""
    return df if years is None else since(with_newest(df, keys), years)


def with_newest(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """Adds ``_last``, the newest date of a series: a combined aggregate joined back, so the history is filtered before any window."""
    last = df.groupBy(*keys).agg(F.max("date").alias("_last"))
    return df.join(last, list(keys)).select(*df.columns, "_last")


def since(df: DataFrame, years: int) -> DataFrame:
    return df.filter(F.col("date") > F.add_months("_last", -12 * years)).drop("_last")


# History and bar limits of the report timeframes.
REPORT_YEARS = 5
DAILY_BARS = 320
WEEKLY_BARS = 280
# Years of daily history behind the indicator row of each timeframe.
TECHNICALS_YEARS = {"daily": 1, "weekly": 2, "monthly": 5}
TIMEFRAMES = ("daily", "weekly", "monthly")

BAR_COLS = ["symbol", "timeframe", "date", *OHLC, "volume"]


def _tagged(df: DataFrame, timeframe: str) -> DataFrame:
    return df.withColumn("timeframe", F.lit(timeframe)).select(*BAR_COLS)


def report_frames(bars: DataFrame, years: int | None = REPORT_YEARS, daily_bars: int | None = DAILY_BARS, weekly_bars: int | None = WEEKLY_BARS) -> DataFrame:
    """Daily, weekly and monthly frames of every symbol in one long table; a limit of None keeps everything."""
    base = recent_years(bars, years)
    daily = _tagged(R.tail(base, daily_bars), "daily")
    weekly = _tagged(R.tail(resample(base, "week"), weekly_bars), "weekly")
    return daily.unionByName(weekly).unionByName(_tagged(resample(base, "month"), "monthly"))


def technicals_frames(bars: DataFrame) -> DataFrame:
    """Frames behind the indicator row: 1y daily, 2y weekly, 5y monthly."""
    dated = with_newest(bars)
    daily = _tagged(since(dated, TECHNICALS_YEARS["daily"]), "daily")
    weekly = _tagged(resample(since(dated, TECHNICALS_YEARS["weekly"]), "week"), "weekly")
    monthly = _tagged(resample(since(dated, TECHNICALS_YEARS["monthly"]), "month"), "monthly")
    return daily.unionByName(weekly).unionByName(monthly)


def latest_price(df: DataFrame, keys=("symbol",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.max_by("close", "date").alias("current_price"), F.max("date").alias("price_date")
    )


def load_span(df: DataFrame, keys=("symbol", "exchange")) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("row_count")
    )


def high_low_52w(numbered: DataFrame, keys=("symbol",)) -> DataFrame:
    """Extremes of the last 252 bars (bars, not calendar days, on every timeframe)."""
    return numbered.filter(F.col("rd") <= 252).groupBy(*keys).agg(
        F.max("high").alias("high_52w"), F.min("low").alias("low_52w")
    )


def exact_sum_tp_volume(high="high", low="low", close="close", volume="volume") -> Column:
    """Sum of typical price times volume, added in decimals so order does not matter."""
    tp3 = (col(high).cast("decimal(18,6)") + col(low).cast("decimal(18,6)") + col(close).cast("decimal(18,6)"))
    return F.sum((tp3 * col(volume).cast("decimal(18,0)")).cast("decimal(38,6)")).cast("double") / 3.0


def vwap_anchored(df: DataFrame, keys=("symbol",)) -> DataFrame:
    total = F.sum("volume")
    return df.groupBy(*keys).agg(
        F.when(total > 0, F.round(safe_div(exact_sum_tp_volume(), total), 4)).alias("vwap_anchored"),
        F.min("date").alias("window_start"),
        F.max("date").alias("window_end"),
    )


def session_snapshot(ticks: DataFrame, ts="ts") -> DataFrame:
    """Per (symbol, day): bars, last, day open / high / low, session VWAP, position in range."""
    day = ticks.groupBy("symbol", F.to_date(ts).alias("date")).agg(
        F.count(F.lit(1)).alias("bars"),
        F.max_by("close", F.struct(ts, "ord")).alias("last"),
        F.min_by("open", F.struct(ts, "ord")).alias("day_open"),
        F.max("high").alias("day_high"),
        F.min("low").alias("day_low"),
        F.when(F.sum("volume") > 0, F.round(safe_div(exact_sum_tp_volume(), F.sum("volume")), 4)).alias("session_vwap"),
    )
    rng = F.col("day_high") - F.col("day_low")
    return day.withColumn(
        "position_in_day_range_pct",
        F.when(rng > 0, F.round(safe_div(F.col("last") - F.col("day_low"), rng) * 100, 2)),
    ).withColumn("above_vwap", F.col("last") > F.col("session_vwap"))


def daily_candle(df: DataFrame) -> DataFrame:
    last = df.groupBy("symbol").agg(F.max(F.struct("date", "open", "close")).alias("b"))
    return last.select(
        "symbol", "b.date", "b.open", "b.close",
        F.when(F.col("b.close") >= F.col("b.open"), "up").otherwise("down").alias("direction"),
    )


def downsample_stride(df: DataFrame, target: int = 500, keys=("symbol",)) -> DataFrame:
    """Even-stride thinning to about ``target`` rows, first and last kept."""
    d = R.number_rows(df, keys)
    step = F.ceil(F.col("n") / target)
    keep = (F.col("n") <= target) | (F.pmod(F.col("rn") - 1, step) == 0) | (F.col("rn") == F.col("n"))
    return d.filter(keep)


def weekly_history(bars: DataFrame, weekly_bars: int | None = WEEKLY_BARS) -> DataFrame:
    """Weekly bars with the partial-week flag; volume nulled two years before the last daily bar."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_daily"))
    weekly = R.tail(resample(bars, "week"), weekly_bars)
    newest = F.max("date").over(R.Window.partitionBy("symbol"))
    return (
        weekly.withColumn("newest", newest).join(last, "symbol")
        .select(
            "symbol", "date", *OHLC,
            F.when(F.col("date") >= F.date_sub("last_daily", 730), F.col("volume")).alias("volume"),
            ((F.col("date") == F.col("newest")) & (F.col("last_daily") < F.col("date"))).alias("is_partial"),
        )
    )


def price_history(bars: DataFrame, years: int | None = REPORT_YEARS, daily_bars: int | None = DAILY_BARS, weekly_bars: int | None = WEEKLY_BARS) -> DataFrame:
    """Report bars: the newest daily and weekly rows per symbol; a limit of None keeps everything."""
    base = recent_years(bars, years)
    daily = R.tail(base, daily_bars).select(
        "symbol", F.lit("daily").alias("timeframe"), "date", *OHLC, "volume", F.lit(False).alias("is_partial")
    )
    weekly = weekly_history(base, weekly_bars).withColumn("timeframe", F.lit("weekly"))
    return daily.unionByName(weekly)


def apply_frame(frames: DataFrame, fn, schema: str, keys=("symbol", "timeframe")) -> DataFrame:
    """Escape hatch: a user's pandas function per frame, fed in date order.

    For rules no built-in expresses; a frame holds a few hundred bars, so the group a
    task sees stays small. The library itself does not depend on it.
    """
    def ordered(pdf):
        return fn(pdf.sort_values("date", kind="stable"))

    return frames.groupBy(*keys).applyInPandas(ordered, schema)
