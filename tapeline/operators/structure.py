"""Price structure per frame: pivots, levels, zones, candles, chart patterns, gaps, volume profile.

A frame is one (symbol, timeframe) series of at most a few hundred bars, so arrays
collected per frame are bounded by the frame length, never by raw data size.
Order-dependent rules (clustering, greedy selection) are folds over a sorted array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import rolling as R
from tapeline.functions.scalars import round_scaled, safe_div
from tapeline.operators.indicators import adx_di, rsi

K = ("symbol", "timeframe")


def find_pivots(numbered: DataFrame, left=3, right=3, keys=K) -> DataFrame:
    """Flags ``pivot_high`` / ``pivot_low``.

    A pivot high is the maximum of the bars from ``left`` before to ``right`` after and
    strictly above the bar before it, so a plateau counts once and a flat stretch never.
    """
    win = R.w(keys).rowsBetween(-left, right)
    inside = (F.col("rn") > left) & (F.col("rn") <= F.col("n") - right)
    up = (F.col("high") == F.max("high").over(win)) & (F.col("high") > F.lag("high").over(R.w(keys)))
    dn = (F.col("low") == F.min("low").over(win)) & (F.col("low") < F.lag("low").over(R.w(keys)))
    return numbered.withColumns({"pivot_high": inside & up, "pivot_low": inside & dn})


def pivot_rows(numbered: DataFrame, left=3, right=3, keys=K) -> DataFrame:
    """One row per pivot: side, price, position."""
    p = find_pivots(numbered, left, right, keys)
    sides = F.array(
        F.struct(F.lit("high").alias("side"), F.col("high").alias("price"), F.col("pivot_high").alias("hit")),
        F.struct(F.lit("low").alias("side"), F.col("low").alias("price"), F.col("pivot_low").alias("hit")),
    )
    return p.select(*keys, "rn", "date", F.inline(sides)).filter("hit").drop("hit")


# Level clustering.
LEVEL_TOLERANCE = 0.015
LEVELS_PER_SIDE = 8


def cluster_fold(prices: Column, tolerance: float) -> Column:
    """Greedy clustering of sorted prices: join the first level within the tolerance, else open one."""
    start = F.array().cast("array<struct<price:double,touches:bigint>>")

    def step(levels, v):
        near = F.transform(levels, lambda lv: F.abs(v - lv["price"]) / lv["price"] <= tolerance)
        pos = F.array_position(near, F.lit(True))
        fresh = F.struct(round_scaled(v, 4).alias("price"), F.lit(1).cast("bigint").alias("touches"))

        def merge(lv, i):
            touches = lv["touches"] + 1
            mean = round_scaled((lv["price"] * lv["touches"] + v) / touches, 4)
            return F.when(i == pos - 1, F.struct(mean.alias("price"), touches.alias("touches"))).otherwise(lv)

        return F.when(pos == 0, F.concat(levels, F.array(fresh))).otherwise(F.transform(levels, merge))

    return F.aggregate(F.array_sort(prices), start, step)


def cluster_levels(pivots: DataFrame, tolerance=LEVEL_TOLERANCE, keys=K) -> DataFrame:
    """(key, position, price, touches) per price level; position is the order of creation."""
    g = pivots.groupBy(*keys).agg(F.collect_list("price").alias("p"))
    return g.select(*keys, F.posexplode(cluster_fold(F.col("p"), tolerance)).alias("position", "l")).select(
        *keys, "position", "l.price", "l.touches"
    )


def support_resistance(numbered: DataFrame, keys=K, per_side: int | None = LEVELS_PER_SIDE) -> DataFrame:
    """Levels split at the last close, the ``per_side`` most touched of each side (None: all; one grouped pass per frame)."""
    p = find_pivots(numbered, 3, 3, keys)
    hit = lambda flag, c: F.collect_list(F.when(F.col(flag), F.col(c)))
    g = p.groupBy(*keys).agg(
        F.concat(hit("pivot_high", "high"), hit("pivot_low", "low")).alias("p"), F.max(F.when(F.col("rd") == 1, F.col("close"))).alias("_close")
    )
    d = g.select(*keys, "_close", F.posexplode(cluster_fold(F.col("p"), LEVEL_TOLERANCE)).alias("position", "l"))
    d = d.select(*keys, "position", "l.price", "l.touches", F.when(F.col("l.price") < F.col("_close"), "support").otherwise("resistance").alias("side"))
    win = Window.partitionBy(*keys, "side").orderBy(F.col("touches").desc(), "position")
    d = d.withColumn("_r", F.row_number().over(win)).filter(R.at_most("_r", per_side))
    return d.select(*keys, "side", "price", "touches")


# Supply and demand zones.
ZONE_LOOKBACK = 90
MAX_ZONES = 4
ZONE_WIDTH = 0.02
ZONE_MIN_MOVE = 0.03
ZONE_CAP = 0.06


def supply_demand_zones(numbered: DataFrame, keys=K) -> DataFrame:
    """Bands around the pivots that started the strongest moves of the last 90 bars.

    Strongest first, at most twelve considered and four kept; a zone overlapping a
    kept zone of its kind is the same level. Volume counts from the pivot bar to the
    last bar.
    """
    win90 = R.number_rows(numbered.filter(F.col("rd") <= ZONE_LOOKBACK).drop("rn", "rd", "n"), keys).filter("n >= 20")
    after = R.w(keys).rowsBetween(0, Window.unboundedFollowing)
    d = find_pivots(win90, 5, 5, keys).withColumns({
        "_up": F.max("close").over(after) / F.col("low") - 1,
        "_dn": 1 - F.min("close").over(after) / F.col("high"),
        "_vol": F.sum("volume").over(after),
        "_close": F.last("close").over(R.whole(keys)),
    })
    sides = F.array(
        F.struct(F.lit("demand").alias("kind"), F.lit(0).alias("_k"), F.col("_up").alias("strength"), F.col("pivot_low").alias("hit")),
        F.struct(F.lit("supply").alias("kind"), F.lit(1).alias("_k"), F.col("_dn").alias("strength"), F.col("pivot_high").alias("hit")),
    )
    c = d.select(*keys, "rn", "low", "high", "_vol", "_close", F.inline(sides)).filter(F.col("hit") & (F.col("strength") > ZONE_MIN_MOVE))
    strongest = Window.partitionBy(*keys).orderBy(F.col("strength").desc(), "_k", "rn")
    c = c.withColumn("_rank", F.row_number().over(strongest)).filter(F.col("_rank") <= MAX_ZONES * 3)
    width = F.least(F.greatest(F.col("high") - F.col("low"), F.col("low") * ZONE_WIDTH), F.col("_close") * ZONE_CAP)
    c = c.withColumns({"zl": F.col("low"), "zh": F.col("low") + width})
    ok = F.when(F.col("kind") == "demand", F.col("zh") <= F.col("_close") * 1.001).otherwise(F.col("zl") >= F.col("_close") * 0.999)
    zone = F.struct("_rank", "kind", "zl", "zh", "strength", F.col("_vol").cast("bigint").alias("volume_in_zone"))
    g = c.filter(ok).groupBy(*keys).agg(F.array_sort(F.collect_list(zone)).alias("z"))

    def keep(acc, z):
        clash = F.exists(acc, lambda k: (k["kind"] == z["kind"]) & (z["zl"] < k["zh"]) & (z["zh"] > k["zl"]))
        return F.when((F.size(acc) < MAX_ZONES) & ~clash, F.concat(acc, F.array(z))).otherwise(acc)

    zones = F.aggregate("z", F.filter("z", lambda z: F.lit(False)), keep)
    return g.select(*keys, F.inline(zones)).select(
        *keys, F.col("_rank").alias("rank"), "kind", F.round("zl", 4).alias("zone_low"), F.round("zh", 4).alias("zone_high"),
        F.round(F.col("strength") * 100, 2).alias("strength_pct"), "volume_in_zone",
    )


def last_pivots(numbered: DataFrame, keep: int, left=3, right=3, keys=K, extra=(), more=()) -> DataFrame:
    """Per frame: pivot counts and the prices of the last pivots, newest first (h1 is the newest high).

    ``extra`` names further columns reported at each pivot, ``more`` further aggregates of the frame.
    """
    p = find_pivots(numbered, left, right, keys)
    for side, flag in (("h", "pivot_high"), ("l", "pivot_low")):
        newest = R.Window.partitionBy(*keys, flag).orderBy(F.col("rn").desc())
        p = p.withColumn(f"_{side}r", F.when(F.col(flag), F.row_number().over(newest)))
    aggs = [F.count_if("pivot_high").alias("pivot_highs"), F.count_if("pivot_low").alias("pivot_lows")]
    for side, price in (("h", "high"), ("l", "low")):
        for i in range(1, keep + 1):
            at = F.col(f"_{side}r") == i
            aggs.append(F.max(F.when(at, F.col(price))).alias(f"{side}{i}"))
            aggs += [F.max(F.when(at, F.col(c))).alias(f"{side}{i}_{c}") for c in extra]
    return p.groupBy(*keys).agg(*aggs, *more)


def market_structure(numbered: DataFrame, keys=K) -> DataFrame:
    """Higher/lower pivots classification with pivot counts, confidence and side of the 200-bar average."""
    d = last_pivots(numbered, 2, keys=keys, more=(
        F.max("n").alias("n"), F.max(F.when(F.col("rd") == 1, F.col("close"))).alias("_close"),
        F.avg(F.when(F.col("rd") <= 200, F.col("close"))).alias("_sma200"),
    ))
    enough = (F.col("pivot_highs") >= 2) & (F.col("pivot_lows") >= 2)
    hh, hl = F.col("h1") > F.col("h2"), F.col("l1") > F.col("l2")
    label = (
        F.when(~enough, "insufficient_data")
        .when(hh & hl, "uptrend (higher highs & higher lows)")
        .when(~hh & ~hl, "downtrend (lower highs & lower lows)")
        .otherwise("range / transition (mixed pivots)")
    )
    below = F.when(enough & (F.col("n") >= 200), F.col("_close") < F.col("_sma200"))
    conflict = (F.col("classification").startswith("uptrend") & F.coalesce(below, F.lit(False))) | (
        F.col("classification").startswith("downtrend") & F.coalesce(~below, F.lit(False))
    )
    few = (F.col("pivot_highs") < 3) | (F.col("pivot_lows") < 3) | ~enough
    d = d.withColumn("classification", label)
    swing = lambda c: F.when(enough, F.round(c, 4))
    return d.select(
        *keys, "classification", F.when(conflict | few, "low").otherwise("high").alias("confidence"),
        "pivot_highs", "pivot_lows", F.when(below, "below").when(~below, "above").alias("price_vs_sma200"),
        swing("h2").alias("high_prev"), swing("h1").alias("high_last"), swing("l2").alias("low_prev"), swing("l1").alias("low_last"),
    )


def regime_from(adx: Column, slope: Column, bars: Column) -> tuple[Column, Column]:
    """(regime, basis text): trending needs ADX of 20 and a sloping 20-bar average."""
    trending = (adx >= 20) & slope.isNotNull() & (F.abs(slope) > 0.1)
    regime = (
        F.when((bars < 40) | adx.isNull(), "insufficient_data")
        .when(trending, F.when(slope > 0, "trending up").otherwise("trending down"))
        .otherwise("ranging")
    )
    basis = (
        F.when((bars >= 40) & adx.isNull(), "insufficient bars for ADX")
        .when(regime.startswith("trending"), F.format_string("ADX %.1f >= 20 (strength) + SMA20 slope %+.2f%% (direction)", adx, slope))
        .when(regime == "ranging", F.format_string("ADX %.1f < 20 or flat SMA20 slope — no confirmed trend", adx))
    )
    return regime, basis


def trend_regime(numbered: DataFrame, keys=K) -> DataFrame:
    d = adx_di(numbered, keys)
    d = d.withColumn("_s", R.mean_n("close", 20, keys))
    d = d.withColumn("_slope", (safe_div("_s", F.lag("_s", 5).over(R.w(keys))) - 1) * 100).filter("rd = 1")
    regime, basis = regime_from(F.col("adx_14"), F.col("_slope"), F.col("n"))
    ok = F.col("n") >= 40
    return d.select(
        *keys, regime.alias("regime"), F.when(ok, F.round("adx_14", 2)).alias("adx"),
        F.when(ok, F.round("_slope", 3)).alias("sma20_slope_pct"), basis.alias("basis"),
    )


# Bars scanned for candles, and how each pattern counts.
CANDLE_BARS = 10
BULLISH_CANDLES = ("bullish_engulfing", "hammer", "morning_star", "three_white_soldiers")
BEARISH_CANDLES = ("bearish_engulfing", "shooting_star", "evening_star", "three_black_crows")
STREAK_CANDLES = ("morning_star", "evening_star", "three_white_soldiers", "three_black_crows")
CANDLES = (
    "bullish_engulfing", "bearish_engulfing", "hammer", "shooting_star", "doji",
    "morning_star", "evening_star", "three_white_soldiers", "three_black_crows",
)


def candle_flags(numbered: DataFrame, scan: int | None = CANDLE_BARS, keys=K) -> DataFrame:
    """One boolean column per pattern.

    Bars two behind are looked up inside the scanned tail only. The star rules ask
    for a bullish first candle in the morning star and a bearish one in the evening
    star - the reverse of the textbook - and are kept that way on purpose.
    """
    d = numbered.filter(F.col("rd") <= scan + 3) if scan else numbered
    d = R.number_rows(d.drop("rn", "rd", "n"), keys)
    win = R.w(keys)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    d = d.withColumns({
        "_body": F.abs(c - o), "_rng": F.when(h != l, h - l), "_bull": c > o, "_bear": c < o,
        "_up": h - F.greatest(o, c), "_lo": F.least(o, c) - l,
    })

    def at(x, i):
        return F.col(x) if i == 0 else F.lag(x, i).over(win)

    body, rng = (lambda i: at("_body", i)), (lambda i: at("_rng", i))
    pos = (c - l) / F.col("_rng")
    mid2 = (at("open", 2) + at("close", 2)) / 2
    star = (body(2) > 0.7 * rng(2)) & (body(1) < 0.3 * rng(1))
    solid = (body(0) > 0.3 * rng(0)) & (body(1) > 0.3 * rng(1)) & (body(2) > 0.3 * rng(2))
    rules = {
        "bullish_engulfing": F.col("_bull") & at("_bear", 1) & (c > at("open", 1)) & (o < at("close", 1)) & (body(0) > body(1)),
        "bearish_engulfing": F.col("_bear") & at("_bull", 1) & (c < at("open", 1)) & (o > at("close", 1)) & (body(0) > body(1)),
        "hammer": (F.col("_lo") > 2 * body(0)) & (F.col("_up") < body(0)) & (pos >= 0.6),
        "shooting_star": (F.col("_up") > 2 * body(0)) & (F.col("_lo") < body(0)) & (pos <= 0.4),
        "doji": body(0) <= 0.1 * F.col("_rng"),
        "morning_star": star & at("_bull", 2) & (at("open", 1) < at("close", 2)) & (c > mid2),
        "evening_star": star & at("_bear", 2) & (at("open", 1) > at("close", 2)) & (c < mid2),
        "three_white_soldiers": (F.col("rn") > 3) & F.col("_bull") & at("_bull", 1) & at("_bull", 2) & solid
        & (c > at("close", 1)) & (at("close", 1) > at("close", 2)),
        "three_black_crows": (F.col("rn") > 3) & F.col("_bear") & at("_bear", 1) & at("_bear", 2) & solid
        & (c < at("close", 1)) & (at("close", 1) < at("close", 2)),
    }
    ready = F.col("rn") > 2
    d = d.withColumns({k: ready & F.coalesce(rule, F.lit(False)) for k, rule in rules.items()})
    return d.drop("_body", "_rng", "_bull", "_bear", "_up", "_lo")


def _named_candles(numbered: DataFrame, scan: int | None, keys) -> DataFrame:
    """Pattern names per bar, streaks of a multi-bar pattern reduced to their first bar."""
    d = candle_flags(numbered, scan, keys)
    first = {p: F.col(p) & ~F.coalesce(F.lag(p).over(R.w(keys)), F.lit(False)) for p in STREAK_CANDLES}
    return d.withColumn("_names", F.array_compact(F.array(*[F.when(first.get(p, F.col(p)), F.lit(p)) for p in CANDLES])))


def candle_hits(numbered: DataFrame, scan: int | None = CANDLE_BARS, keys=K) -> DataFrame:
    """(key, date, pattern) of the scanned bars."""
    d = _named_candles(numbered, scan, keys)
    return d.select(*keys, "date", (F.col("n") - F.col("rn")).alias("bar_offset_from_end"), F.explode("_names").alias("pattern"))


def candle_tally(numbered: DataFrame, keys=K) -> DataFrame:
    """Bullish and bearish patterns per frame, zero included."""
    count = lambda names: F.sum(F.size(F.filter("_names", lambda p: p.isin(*names)))).cast("bigint")
    return _named_candles(numbered, CANDLE_BARS, keys).groupBy(*keys).agg(
        count(BULLISH_CANDLES).alias("bullish_count"), count(BEARISH_CANDLES).alias("bearish_count"))


# Chart-pattern window and tolerances.
CHART_BARS = 60
SAME_LEVEL = 0.02


def chart_window(numbered: DataFrame, keys=K, bars: int | None = CHART_BARS) -> DataFrame:
    """Last ``bars`` bars (None: all) of frames that have at least 30, renumbered."""
    tail = numbered.filter(R.at_most("rd", bars)).drop("rn", "rd", "n")
    return R.number_rows(tail, keys).filter("n >= 30")


def ordered_slope(points: Column) -> Column:
    """Slope of y over x, the points always taken by x: an even row of pivots leaves a rounding error whose sign is the order's."""
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mx", "my", "c", "v")])

    def step(acc, p):
        n = acc["n"] + 1
        dx, dy = p["x"] - acc["mx"], p["y"] - acc["my"]
        mx, my = acc["mx"] + dx / n, acc["my"] + dy / n
        return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), (acc["c"] + dx * (p["y"] - my)).alias("c"), (acc["v"] + (p["x"] - mx) * dx).alias("v"))

    return F.aggregate(F.array_sort(points), start, step, lambda s: F.try_divide(F.try_divide(s["c"], s["n"]), F.try_divide(s["v"], s["n"])))


def chart_row(numbered: DataFrame, keys=K) -> DataFrame:
    """Everything the chart rules need, one row per frame from one pass over its last 60 bars.

    Pivots, range without the last bar, touches on both sides, trend line, pivot
    slopes and the volume check share one partitioning.
    """
    d = find_pivots(chart_window(numbered, keys), 3, 3, keys)
    whole = Window.partitionBy(*keys)
    past = F.col("rd") > 1
    cols = {"range_high": F.max(F.when(past, F.col("high"))).over(whole), "range_low": F.min(F.when(past, F.col("low"))).over(whole)}
    for side, flag in (("h", "pivot_high"), ("l", "pivot_low")):
        same = Window.partitionBy(*keys, flag)
        cols[f"_{side}x"] = F.when(F.col(flag), F.row_number().over(same.orderBy("rn")).cast("double"))
        cols[f"_{side}r"] = F.when(F.col(flag), F.row_number().over(same.orderBy(F.col("rn").desc())))
    d = d.withColumns(cols)
    x = F.col("rn").cast("double")
    aggs = [
        F.count_if("pivot_high").alias("nh"), F.count_if("pivot_low").alias("nl"),
        F.max(F.when(F.col("rd") == 1, F.col("close"))).alias("close"), F.max("range_high").alias("range_high"), F.min("range_low").alias("range_low"),
        F.max(F.when(F.col("rd") == 1, F.col("volume"))).alias("last_volume"),
        F.avg(F.when(F.col("rd").between(2, 21), F.col("volume"))).alias("avg_volume"),
        F.regr_slope("close", x).alias("slope"), F.regr_r2("close", x).alias("_r2"), F.var_pop("close").alias("_var"),
        F.count_if(past & (F.col("high") >= F.col("range_high") * 0.99)).alias("near_high"),
        F.count_if(past & (F.col("low") <= F.col("range_low") * 1.01)).alias("near_low"),
        ordered_slope(F.collect_list(F.when(F.col("pivot_high"), F.struct(F.col("_hx").alias("x"), F.col("high").alias("y"))))).alias("hs"),
        ordered_slope(F.collect_list(F.when(F.col("pivot_low"), F.struct(F.col("_lx").alias("x"), F.col("low").alias("y"))))).alias("ls"),
    ]
    for side, price in (("h", "high"), ("l", "low")):
        aggs += [F.max(F.when(F.col(f"_{side}r") == i, F.col(price))).alias(f"{side}{i}") for i in (1, 2, 3)]
    g = d.groupBy(*keys).agg(*aggs)
    return g.withColumn("r2", F.when(F.col("_var") == 0, 0.0).otherwise(F.col("_r2"))).drop("_r2", "_var")


def _near(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) / F.col(b) <= SAME_LEVEL


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def chart_rules() -> dict[str, Column]:
    """Chart rules over a ``chart_row``."""
    c = F.col
    lo, hi = c("range_low"), c("range_high")
    tight = (lo != 0) & ((hi - lo) / lo < 0.15)
    enough = (c("nh") >= 3) & (c("nl") >= 3)
    return {
        "double_top": _holds(_near("h1", "h2")),
        "double_bottom": _holds(_near("l1", "l2")),
        # the last three pivots: an extreme first one, then two at the same level
        "head_and_shoulders": _holds((c("h3") > c("h2") * 1.01) & _near("h1", "h2")),
        "inverse_head_and_shoulders": _holds((c("l3") < c("l2") * 0.99) & _near("l1", "l2")),
        "trading_range": _holds(tight & (c("near_high") >= 2) & (c("near_low") >= 2)),
        "channel": F.when(c("r2") >= 0.7, F.when(c("slope") > 0, "rising_channel").otherwise("falling_channel")),
        "triangle": F.when(enough & (c("ls") > 0) & (c("hs") < c("ls")), "ascending_triangle").when(
            enough & (c("hs") < 0) & (c("ls") > c("hs")), "descending_triangle"),
    }


def _chart(numbered: DataFrame, keys, *names: str, also=()) -> DataFrame:
    rules = chart_rules()
    return chart_row(numbered, keys).select(*keys, *also, *[rules[n].alias(n) for n in names])


def double_top_bottom(numbered: DataFrame, keys=K) -> DataFrame:
    return _chart(numbered, keys, "double_top", "double_bottom")


def head_shoulders(numbered: DataFrame, keys=K) -> DataFrame:
    return _chart(numbered, keys, "head_and_shoulders", "inverse_head_and_shoulders")


def trading_range(numbered: DataFrame, keys=K) -> DataFrame:
    """A box under 15 percent with two touches within one percent on each side."""
    return _chart(numbered, keys, "trading_range", also=("near_high", "near_low"))


def channel(numbered: DataFrame, keys=K) -> DataFrame:
    """Straight-line channel on closes when R2 reaches 0.7."""
    return _chart(numbered, keys, "channel", also=(F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2")))


def triangle(numbered: DataFrame, keys=K) -> DataFrame:
    """Converging slopes of pivot highs and lows over their ordinals (three of each at least)."""
    return _chart(numbered, keys, "triangle")


def breakout(numbered: DataFrame, keys=K) -> DataFrame:
    """Close outside the 60-bar range, with a volume confirmation."""
    d = chart_row(numbered, keys)
    kind = F.when(F.col("close") > F.col("range_high"), "breakout").when(F.col("close") < F.col("range_low"), "breakdown")
    level = F.when(kind == "breakout", F.col("range_high")).when(kind == "breakdown", F.col("range_low"))
    return d.select(
        *keys, kind.alias("type"), F.round(level, 4).alias("level"),
        F.when(kind.isNotNull(), F.col("last_volume") > 1.5 * F.col("avg_volume")).alias("volume_confirmed"),
    ).filter(F.col("type").isNotNull())


def chart_patterns(numbered: DataFrame, keys=K) -> DataFrame:
    """(key, pattern) rows of everything found in the chart window."""
    r = chart_rules()
    named = {"double_top": "possible_double_top", "double_bottom": "possible_double_bottom", "head_and_shoulders": "possible_head_and_shoulders",
             "inverse_head_and_shoulders": "possible_inverse_head_and_shoulders", "trading_range": "trading_range"}
    found = F.array(*[F.when(r[k], F.lit(v)) for k, v in named.items()], r["channel"], r["triangle"])
    return chart_row(numbered, keys).select(*keys, F.explode(F.array_compact(found)).alias("pattern"))


# Gap size and number of gaps reported.
GAP_UP, GAP_DOWN, MAX_GAPS = 1.005, 0.995, 5


def gaps(numbered: DataFrame, keys=K, most: int | None = MAX_GAPS) -> DataFrame:
    """Newest ``most`` opening gaps (None: all); filled when one later bar spans from the previous close to the open.

    Gaps are cut to the newest of a frame before meeting the later bars, so the lookup is
    ``most`` comparisons per bar.
    """
    pc = F.lag("close").over(R.w(keys))
    g = numbered.withColumn("pc", pc).filter((F.col("open") > F.col("pc") * GAP_UP) | (F.col("open") < F.col("pc") * GAP_DOWN))
    newest = Window.partitionBy(*keys).orderBy(F.col("rn").desc())
    g = g.withColumn("rank", F.row_number().over(newest)).filter(R.at_most("rank", most))
    g = g.select(*keys, "rank", "date", F.col("rn").alias("_at"), "pc", F.col("open").alias("o"))
    later = numbered.select(*keys, "rn", "low", "high")
    hit = (F.col("rn") > F.col("_at")) & (F.col("low") <= F.col("pc")) & (F.col("high") >= F.col("o"))
    j = g.join(later, list(keys))
    out = j.groupBy(*keys, "rank", "date", "pc", "o").agg(F.bool_or(hit).alias("filled"))
    return out.select(
        *keys, "rank", "date", F.when(F.col("o") > F.col("pc"), "gap_up").otherwise("gap_down").alias("type"),
        F.round("pc", 4).alias("gap_low"), F.round("o", 4).alias("gap_high"),
        F.round((F.col("o") / F.col("pc") - 1) * 100, 2).alias("gap_pct"), "filled",
    )


# Volume profile.
PROFILE_BARS, PROFILE_BINS, VALUE_AREA = 120, 24, 0.7


def volume_profile(numbered: DataFrame, keys=K, bars: int | None = PROFILE_BARS) -> DataFrame:
    """Volume per price bin over the last ``bars`` bars (None: all), each bar spread evenly over the bins it spans."""
    d = numbered.filter(R.at_most("rd", bars) & (F.col("n") >= 20))
    win = Window.partitionBy(*keys)
    d = d.withColumns({"_lo": F.min("low").over(win), "_hi": F.max("high").over(win)}).filter(F.col("_hi") > F.col("_lo"))
    step = (F.col("_hi") - F.col("_lo")) / PROFILE_BINS
    edges = F.array(*[F.lit(float(i)) * step + F.col("_lo") for i in range(PROFILE_BINS)], F.col("_hi"))
    d = d.withColumn("edges", edges)
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(PROFILE_BINS - 1))
    d = d.withColumns({
        "_first": clip(F.size(F.filter("edges", lambda e: e <= F.col("low"))) - 1),
        "_last": clip(F.size(F.filter("edges", lambda e: e < F.col("high"))) - 1),
    })
    base = d.select(*keys, "edges").distinct().select(*keys, "edges", F.explode(F.sequence(F.lit(0), F.lit(PROFILE_BINS - 1))).alias("bin"))
    used = d.filter((F.col("volume") != 0) & (F.col("_last") >= F.col("_first")))
    spread = used.select(
        *keys, (F.col("volume") / (F.col("_last") - F.col("_first") + 1)).alias("v"), F.explode(F.sequence("_first", "_last")).alias("bin")
    ).groupBy(*keys, "bin").agg(F.sum("v").alias("v"))
    out = base.join(spread, [*keys, "bin"], "left")
    return out.select(*keys, "bin", F.col("edges")[F.col("bin")].alias("lo"), F.col("edges")[F.col("bin") + 1].alias("hi"),
                      F.coalesce("v", F.lit(0.0)).alias("volume"))


def value_area(profile: DataFrame, keys=K) -> DataFrame:
    """Point of control and the 70 percent area grown from it to the larger neighbour (ties go up)."""
    g = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "volume"))).alias("b"))
    vol = F.transform("b", lambda x: x["volume"])
    g = g.withColumns({"v": vol, "total": F.aggregate(vol, F.lit(0.0), lambda a, x: a + x)})
    g = g.withColumn("poc", (F.array_position("v", F.array_max("v")) - 1).cast("int"))
    start = F.struct(F.col("poc").alias("lo"), F.col("poc").alias("hi"), F.col("v")[F.col("poc")].alias("cov"))
    top = PROFILE_BINS - 1

    def grow(s, _):
        open_ = (s["cov"] < VALUE_AREA * F.col("total")) & ((s["lo"] > 0) | (s["hi"] < top))
        below = F.when(s["lo"] > 0, F.try_element_at("v", s["lo"])).otherwise(-1.0)
        above = F.when(s["hi"] < top, F.try_element_at("v", s["hi"] + 2)).otherwise(-1.0)
        up = above >= below
        grown = F.struct(
            F.when(up, s["lo"]).otherwise(s["lo"] - 1).alias("lo"), F.when(up, s["hi"] + 1).otherwise(s["hi"]).alias("hi"),
            (s["cov"] + F.when(up, above).otherwise(below)).alias("cov"),
        )
        return F.when(open_, grown).otherwise(s)

    g = g.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.lit(PROFILE_BINS)), start, grow))
    mid = lambda i: F.round((F.col("b")[i]["lo"] + F.col("b")[i]["hi"]) / 2, 4)
    return g.select(*keys, mid(F.col("poc")).alias("poc"), mid(F.col("a.lo")).alias("value_area_low"), mid(F.col("a.hi")).alias("value_area_high"))


def divergence(numbered: DataFrame, keys=K) -> DataFrame:
    """Price and RSI disagreeing between the last two confirmed pivots."""
    d = rsi(numbered.filter("n >= 40"), keys)
    p = last_pivots(d, 2, keys=keys, extra=("close", "rsi_14"))
    known = lambda s: F.col(f"{s}1_rsi_14").isNotNull() & F.col(f"{s}2_rsi_14").isNotNull()
    bear = known("h") & (F.col("h1_close") > F.col("h2_close")) & (F.col("h1_rsi_14") < F.col("h2_rsi_14"))
    bull = known("l") & (F.col("l1_close") < F.col("l2_close")) & (F.col("l1_rsi_14") > F.col("l2_rsi_14"))
    found = F.array(
        F.when(bear, F.struct(F.lit("bearish_regular").alias("type"), F.lit("price_high").alias("anchor"))),
        F.when(bull, F.struct(F.lit("bullish_regular").alias("type"), F.lit("price_low").alias("anchor"))),
    )
    return p.select(*keys, F.inline(F.array_compact(found)))


# Analogue search.
PATH, AHEAD, ANALOGUES, MIN_ANALOGUE_BARS = 20, 20, 6, 120


def analogue_distances(numbered: DataFrame, keys=("symbol",)) -> DataFrame:
    """Distance of every 20-bar path to the latest one, and the 20-bar return that followed it.

    Paths are changes since their first bar. A row looks ahead along its own path and has the
    latest path's bars beside it, so all windows share one shuffle and one sort, and no row
    holds an array.
    """
    d = numbered.filter(F.col("n") >= MIN_ANALOGUE_BARS).select(*keys, "rn", "n", "date", "close")
    along, whole = R.w(keys), Window.partitionBy(*keys)
    latest = {f"_q{i}": F.max(F.when(F.col("rn") == F.col("n") - PATH + 1 + i, F.col("close"))).over(whole) for i in range(PATH)}
    ahead = {f"_p{i}": F.lead("close", i).over(along) for i in range(1, PATH)}
    d = d.withColumns({**ahead, "_next": F.lead("close", PATH).over(along), "_far": F.lead("close", PATH + AHEAD).over(along), "end_date": F.lead("date", PATH - 1).over(along)})
    d = d.withColumns(latest).filter(F.col("rn") <= F.col("n") - PATH - AHEAD - 1)
    apart = [(F.col(f"_p{i}") / F.col("close") - 1) - (F.col(f"_q{i}") / F.col("_q0") - 1) for i in range(1, PATH)]
    sq = reduce(lambda acc, x: acc + x * x, apart, F.lit(0.0))
    return d.select(*keys, (F.col("rn") - 1).alias("start_idx"), F.col("date").alias("start_date"), "end_date",
                    F.sqrt(sq).alias("distance"), ((F.col("_far") / F.col("_next") - 1) * 100).alias("forward_20d_pct"))


def greedy_nonoverlap(candidates: Column, position, gap: int, k: int) -> Column:
    """First k entries of a sorted array whose positions lie at least ``gap`` apart."""
    def keep(acc, c):
        near = F.exists(acc, lambda t: F.abs(position(t) - position(c)) < gap)
        return F.when((F.size(acc) < k) & ~near, F.concat(acc, F.array(c))).otherwise(acc)

    return F.aggregate(candidates, F.filter(candidates, lambda c: F.lit(False)), keep)


def historical_analogues(numbered: DataFrame, keys=("symbol",), count: int = ANALOGUES) -> DataFrame:
    """The ``count`` nearest paths that don't overlap.

    A kept path rules out itself and the 2 * (PATH - 1) starts around it, so ``count`` paths are
    found among the nearest (count - 1) * (2 * PATH - 1) + 1, however long the history is.
    """
    near = Window.partitionBy(*keys).orderBy("distance", "start_idx")
    d = analogue_distances(numbered, keys).withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= (count - 1) * (2 * PATH - 1) + 1)
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("distance", "start_idx", "start_date", "end_date", "forward_20d_pct"))).alias("c"))
    top = greedy_nonoverlap(F.col("c"), lambda t: t["start_idx"], PATH, count)
    return g.select(*keys, F.posexplode(top).alias("rank", "t")).select(
        *keys, (F.col("rank") + 1).alias("rank"), "t.start_idx", "t.start_date", "t.end_date",
        F.round("t.distance", 5).alias("distance"), F.round("t.forward_20d_pct", 4).alias("forward_20d_pct"),
    )


def structure_all(numbered: DataFrame, keys=K) -> DataFrame:
    """Every structure finding of every frame as typed rows: the keys, the topic, and the columns of all topics (null where a topic hasn't them).

    ``numbered`` is read once a topic; a frame table dealt by the keys (``session.cut_partitioned``) isn't shuffled for it.
    """
    topics = {
        "support_resistance": support_resistance(numbered, keys),
        "supply_demand_zones": supply_demand_zones(numbered, keys),
        "market_structure": market_structure(numbered, keys),
        "trend_regime": trend_regime(numbered, keys),
        "candlesticks": candle_hits(numbered, keys=keys),
        "chart_patterns": chart_patterns(numbered, keys),
        "breakout": breakout(numbered, keys),
        "gaps": gaps(numbered, keys),
        "value_area": value_area(volume_profile(numbered, keys), keys),
        "divergence": divergence(numbered, keys),
    }
    rows = [df.withColumn("topic", F.lit(name)) for name, df in topics.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def structure_json(structure: DataFrame, keys=K) -> DataFrame:
    """(key, topic, payload): each finding as a JSON object of what its topic has."""
    rest = [c for c in structure.columns if c not in (*keys, "topic")]
    return structure.select(*keys, "topic", F.to_json(F.struct(*rest), {"ignoreNullFields": "true"}).alias("payload"))
