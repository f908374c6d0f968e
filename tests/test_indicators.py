"""Indicator and structure operators against pandas and hand-made series."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.functions import rolling as R
from tapeline.functions.ewm import ewm, ewm_fold_last, wilder_alpha
from tapeline.operators import bars as B
from tapeline.operators import indicators as I
from tapeline.operators import signals as SG
from tapeline.operators import structure as ST

DAY0 = dt.date(2026, 1, 1)


def frame(spark, rows, symbol="T"):
    """Bars from (open, high, low, close[, volume]) tuples, one per day."""
    data = [(symbol, "daily", DAY0 + dt.timedelta(days=i), *map(float, r[:4]), int(r[4]) if len(r) > 4 else 1_000_000) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, timeframe string, date date, open double, high double, low double, close double, volume bigint")


def zigzag(n, base=100.0, amp=5.0, cycle=20):
    closes = [base + amp * (1 - abs((i % cycle) / (cycle / 2) - 1) * 2) for i in range(n)]
    return [(c, c + 0.5, c - 0.5, c) for c in closes]


def walk(n, seed=7):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n)).round(2)
    close = np.maximum(close, 20)
    open_ = np.r_[100.0, close[:-1]] + rng.normal(0, 0.3, n).round(2)
    high = np.maximum(open_, close) + rng.uniform(0.05, 1, n).round(2)
    low = np.minimum(open_, close) - rng.uniform(0.05, 1, n).round(2)
    return pd.DataFrame({"open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(100, 9000, n)})


def numbered(spark, rows):
    return R.number_rows(frame(spark, rows), ST.K)


@pytest.fixture(scope="module")
def series(spark):
    pdf = walk(1100)
    return pdf, R.number_rows(frame(spark, list(pdf.itertuples(index=False)))).cache()


def column(df, *cols):
    out = df.orderBy("date").select(*cols).toPandas()
    return out if len(cols) > 1 else out[cols[0]]


def test_smoothing_crosses_blocks(series):
    pdf, df = series
    got = column(I.ema(df), "ema_12", "ema_26")
    for n in (12, 26):
        want = pdf.close.ewm(span=n, adjust=False).mean()
        assert np.allclose(got[f"ema_{n}"], want, rtol=1e-12)


def test_smoothing_skips_leading_nulls(spark):
    rows = [("a", i + 1, None if i < 3 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "symbol string, rn int, x double")
    got = ewm(df, [("y", "x", 0.1)]).orderBy("rn").toPandas().y
    want = pd.Series([r[2] for r in rows], dtype=float).ewm(alpha=0.1, adjust=False).mean()
    assert got[:3].isna().all() and np.allclose(got[3:], want[3:], rtol=1e-12)


def test_fold_ages_interior_gaps(spark):
    xs = [1.0, None, 3.0, None, None, 2.0, 5.0]
    df = spark.createDataFrame([(xs,)], "xs array<double>")
    got = df.select(ewm_fold_last(F.col("xs"), 0.25).alias("y")).first().y
    assert math.isclose(got, pd.Series(xs, dtype=float).ewm(alpha=0.25, adjust=False).mean().iloc[-1])


def test_rsi_atr_adx(series):
    pdf, df = series
    delta = pdf.close.diff()
    smooth = lambda s: s.ewm(alpha=wilder_alpha(14), adjust=False).mean()
    gain, loss = smooth(delta.clip(lower=0)), smooth((-delta).clip(lower=0))
    assert np.allclose(column(I.rsi(df), "rsi_14")[1:], (100 - 100 / (1 + gain / loss))[1:], rtol=1e-9)
    pc = pdf.close.shift()
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - pc).abs(), (pdf.low - pc).abs()], axis=1).max(axis=1)
    assert np.allclose(column(I.atr(df), "atr_14"), smooth(tr), rtol=1e-10)
    up, dn = pdf.high.diff(), -pdf.low.diff()
    p = 100 * smooth(up.where((up > dn) & (up > 0), 0.0)) / smooth(tr)
    m = 100 * smooth(dn.where((dn > up) & (dn > 0), 0.0)) / smooth(tr)
    dx = (100 * (p - m).abs() / (p + m)).where((p + m) != 0)
    got = column(I.adx_di(df), "adx_14", "plus_di_14")
    assert np.allclose(got.plus_di_14, p, rtol=1e-9) and np.allclose(got.adx_14[5:], smooth(dx)[5:], rtol=1e-9)


def test_flat_series_gives_nulls(spark):
    d = R.number_rows(frame(spark, [(100, 100, 100, 100)] * 60))
    row = I.cci(I.williams_r(I.stochastic(I.rsi(d)))).filter("rd = 1").first()
    assert row.rsi_14 is None and row.williams_r_14 is None and row.cci_20 is None and row.stoch_k is None
    up = R.number_rows(frame(spark, [(100 + i, 101 + i, 99 + i, 100 + i) for i in range(30)]))
    assert I.rsi(up).filter("rd = 1").first().rsi_14 == 100.0
    assert I.fib_levels(frame(spark, [(100, 100, 100, 100)] * 30)).count() == 0


def test_bollinger_uses_population_deviation(series):
    pdf, df = series
    got = column(I.bollinger(df), "bb_upper")
    want = pdf.close.rolling(20).mean() + 2 * pdf.close.rolling(20).std(ddof=0)
    assert got[:19].isna().all() and np.allclose(got[19:], want[19:], rtol=1e-9)


def test_weekly_bins_end_sunday(spark):
    d = frame(spark, [(i, i + 1, i - 1, i, 10) for i in range(100, 115)])
    got = [(r.date, r.open, r.close, r.volume) for r in B.resample(d, "week").orderBy("date").collect()]
    assert got[0] == (dt.date(2026, 1, 4), 100.0, 103.0, 40) and all(r[0].weekday() == 6 for r in got)


def test_stored_resample_keeps_null_edges(spark):
    rows = [("T", "NSE", DAY0 + dt.timedelta(days=i), None if i == 0 else 1.0 + i, 5.0, 1.0, None if i == 3 else 2.0, 2.0, 7) for i in range(4)]
    d = spark.createDataFrame(rows, "symbol string, exchange string, date date, open double, high double, low double, close double, adjusted_close double, volume bigint")
    r = B.resample_stored(d, "week").first()
    assert r.open is None and r.close is None and r.date == DAY0 + dt.timedelta(days=3) and r.volume == 28
    assert B.resample(d, "week").first().open == 2.0


def test_pivots_plateau_counts_once_and_flat_never(spark):
    highs = [1, 2, 3, 5, 5, 3, 2, 1, 1, 1]
    p = ST.find_pivots(numbered(spark, [(h, h, h - 0.5, h) for h in highs]))
    assert [r.rn for r in p.filter("pivot_high").collect()] == [4]
    flat = ST.find_pivots(numbered(spark, [(1, 1, 1, 1)] * 20))
    assert flat.filter("pivot_high OR pivot_low").count() == 0


def candles(spark, rows):
    return {(r.pattern, r.bar_offset_from_end) for r in ST.candle_hits(numbered(spark, rows)).collect()}


def test_candles_trigger_and_do_not(spark):
    pad = [(100, 101, 99, 100.5)] * 6
    assert ("bullish_engulfing", 0) in candles(spark, [*pad, (102, 102.5, 99.5, 100), (99.5, 103.5, 99, 103)])
    assert not any(p == "bullish_engulfing" for p, o in candles(spark, [*pad, (100, 102.5, 99.5, 102), (99.5, 103.5, 99, 103)]) if o == 0)
    assert ("hammer", 0) in candles(spark, [*pad, (100, 100.6, 95, 100.5)])
    assert ("shooting_star", 0) in candles(spark, [*pad, (100, 105, 99.4, 99.5)])
    streak = [(100 + 2 * i, 102.2 + 2 * i, 99.8 + 2 * i, 102 + 2 * i) for i in range(6)]
    assert len([1 for p, _ in candles(spark, [*pad, *streak]) if p == "three_white_soldiers"]) == 1


def test_gap_needs_one_bar_spanning_it(spark):
    base = [(100, 101, 99, 100)] * 3
    up = ST.gaps(numbered(spark, [*base, (105, 106, 104, 105), (105, 106, 104, 105)])).first()
    assert up.type == "gap_up" and up.gap_pct == 5.0 and not up.filled
    halves = [*base, (105, 106, 104, 105), (104, 104.5, 99, 103), (105, 106, 104, 105)]
    assert not [r for r in ST.gaps(numbered(spark, halves)).collect() if r.gap_pct == 5.0][0].filled
    assert [r for r in ST.gaps(numbered(spark, [*base, (105, 106, 104, 105), (103, 106, 99, 103)])).collect() if r.gap_pct == 5.0][0].filled


def test_levels_and_patterns_on_a_zigzag(spark):
    d = numbered(spark, zigzag(120))
    sr = ST.support_resistance(d).collect()
    close = zigzag(120)[-1][3]
    assert {r.side for r in sr} == {"support", "resistance"}
    assert all(r.price < close for r in sr if r.side == "support") and all(r.price >= close for r in sr if r.side == "resistance")
    found = {r.pattern for r in ST.chart_patterns(d).collect()}
    assert {"possible_double_top", "possible_double_bottom"} <= found
    line = numbered(spark, [(100 + i, 101 + i, 99 + i, 100 + i) for i in range(60)])
    assert ST.channel(line).first().channel == "rising_channel"


def brute_clusters(values, tol):
    levels = []
    for v in sorted(values):
        hit = next((x for x in levels if abs(v - x[0]) / x[0] <= tol), None)
        if hit:
            hit[1] += 1
            hit[0] = round((hit[0] * (hit[1] - 1) + v) / hit[1], 4)
        else:
            levels.append([round(v, 4), 1])
    return [tuple(x) for x in levels]


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vals = [float(x) for x in rng.uniform(80, 130, 60).round(2)]
    p = spark.createDataFrame([("T", "daily", v) for v in vals], "symbol string, timeframe string, price double")
    got = [(r.price, r.touches) for r in ST.cluster_levels(p).orderBy("position").collect()]
    assert got == brute_clusters(vals, 0.015)


def test_analogues_match_brute_force(spark):
    pdf = walk(400, 11)
    d = R.number_rows(frame(spark, list(pdf.itertuples(index=False))))
    got = [(r.start_idx, r.distance) for r in ST.historical_analogues(d).orderBy("rank").collect()]
    c = pdf.close.to_numpy()
    path = lambda i: c[i : i + 20] / c[i] - 1
    ranked = sorted((float(np.sqrt(((path(s) - path(len(c) - 20)) ** 2).sum())), s) for s in range(len(c) - 41))
    top = []
    for dist, s in ranked:
        if all(abs(s - t) >= 20 for t, _ in top):
            top.append((s, round(dist, 5)))
        if len(top) == 6:
            break
    assert got == top


def test_volume_is_spread_over_spanned_bins(spark):
    d = numbered(spark, [(100, 110, 90, 100, 240)] + [(100, 100.4, 100, 100.2, 10)] * 30)
    prof = ST.volume_profile(d).orderBy("bin").collect()
    assert len(prof) == 24 and math.isclose(sum(r.volume for r in prof), 540)
    assert all(r.volume >= 10 for r in prof)


def test_report_has_all_sections(spark):
    from tapeline.operators import report as RP

    pdf = [(c[0], c[1], c[2], c[3], 1000 + i % 7) for i, c in enumerate(zigzag(420))]
    bars = frame(spark, pdf).drop("timeframe")
    index = bars.select("date", F.col("close"))
    none = spark.createDataFrame([], "symbol string, ord bigint, published_at timestamp_ntz, heading string, subject string, title string, date string, broadcast_date string")
    earn = spark.createDataFrame([], "symbol string, date date, ord bigint, eps_estimate double, eps_reported double")
    rep = RP.technical_report(spark, bars, index, none, earn, "2026-01-01").collect()
    assert [r.section for r in sorted(rep, key=lambda r: r.position)] == RP.SECTIONS and len(rep) == 61
    state = {r.section: r for r in rep}
    assert state["upcoming_catalysts"].status == "unsupported" and state["upcoming_catalysts"].reason
    assert state["moving_averages"].status == "ok" and "sma_200" in state["moving_averages"].payload
    import json

    s = json.loads(state["executive_summary"].payload)
    assert s["sections_supported"] + s["sections_unsupported"] == 61 == len(rep)
    assert s["sections_supported"] == sum(r.status == "ok" for r in rep)
    for r in rep:
        if r.payload is not None:
            json.loads(r.payload)


def test_smoothing_is_exact_for_long_spans_and_gaps(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=3000)) + 75
    gaps = np.where(rng.random(3000) < 0.2, np.nan, x)
    gaps[500:1200] = np.nan
    gaps[:2] = np.nan
    rows = [(g, i + 1, None if np.isnan(v) else float(v)) for g, s in (("whole", x), ("gaps", gaps)) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "symbol string, rn int, x double")
    spans = (1, 1.05, 2, 12, 26, 100, 200, 400)
    got = ewm(df, [(f"y{i}", "x", 2 / (n + 1)) for i, n in enumerate(spans)]).orderBy("symbol", "rn").toPandas()
    for g, s in (("whole", x), ("gaps", gaps)):
        for i, n in enumerate(spans):
            want = pd.Series(s).ewm(span=n, adjust=False).mean().to_numpy()
            assert np.allclose(got[got.symbol == g][f"y{i}"], want, rtol=1e-10, equal_nan=True), (g, n)


def test_ties_and_texts_of_the_dashboard(spark):
    """F1: closes whose 200-bar mean is a half of the fourth decimal, and values below 0.001."""
    # the mean, 92.80695, is a double just below the half; adding the closes one by one loses it
    cents = [9280 + i % 3 for i in range(199)]
    cents.append(1856139 - sum(cents))
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), c / 100) for i, c in enumerate(cents)]
    d = I.sma(spark.createDataFrame(rows, "symbol string, date date, close double"), (200,)).where("sma_200 IS NOT NULL")
    assert [r.sma_200 for r in d.collect()] == [1856139 / 20000]
    odd = [(f"A{i}", dt.date(2020, 1, 1) + dt.timedelta(days=j), 1 / (3 + i + j)) for i in range(3) for j in range(4)]
    got = I.sma(spark.createDataFrame(odd, "symbol string, date date, close double"), (4,)).where("sma_4 IS NOT NULL")
    assert all(abs(r.sma_4 - sum(1 / (3 + int(r.symbol[1]) + j) for j in range(4)) / 4) < 1e-15 for r in got.collect())

    values = [-0.0005, 0.0001, 0.001, 0.0, 12345678.5, 2.5e7, -92.807, 100.0]
    last = spark.createDataFrame([(f"S{i}", "daily", *[v] * (len(SG.DASHBOARD) - 1), "x") for i, v in enumerate(values)],
                                 "symbol string, timeframe string, " + ", ".join(f"{c} {'string' if c == SG.DASHBOARD[-1] else 'double'}" for c in SG.DASHBOARD))
    got = {r.symbol: r.value for r in SG.dashboard(last).where("indicator = 'macd_hist'").collect()}
    assert got == {"S0": "-0.0005", "S1": "0.0001", "S2": "0.001", "S3": "0.0", "S4": "12345678.5", "S5": "25000000.0", "S6": "-92.807", "S7": "100.0"}


def test_levels_round_ties_as_sql(spark):
    """the mean of a level and a retracement are rounded like the SQL check rounds them."""
    import random
    import duckdb

    rng, con = random.Random(3), duckdb.connect()
    means = [(i, [round(rng.uniform(50, 51), 2) for _ in range(8)]) for i in range(1500)]
    d = spark.createDataFrame(means, "i int, p array<double>").select("i", ST.cluster_fold(F.col("p"), 0.5)[0]["price"].alias("x"))
    fold = "list_reduce(list_transform(list_sort(p), lambda v: [v, 1.0::DOUBLE]), lambda a, v: [round((a[1]*a[2]+v[1])/(a[2]+1),4), a[2]+1])[1]"
    con.execute("CREATE TABLE t (i INT, p DOUBLE[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", means)
    assert {r.i: r.x for r in d.collect()} == dict(con.execute(f"SELECT i, {fold} FROM t").fetchall())

    swings = [(i, round(rng.uniform(90, 99), 2), round(rng.uniform(80, 89), 2)) for i in range(1500)]
    got = spark.createDataFrame(swings, "i int, swing_high double, swing_low double").withColumn("direction", F.lit("up")).select("i", I.fib_level(0.382).alias("x"))
    con.execute("CREATE TABLE s (i INT, h DOUBLE, l DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?)", swings)
    assert {r.i: r.x for r in got.collect()} == dict(con.execute("SELECT i, round(h-(h-l)*0.382::DOUBLE,4) FROM s").fetchall())


def test_scenario_texts_have_no_exponent(spark):
    """prices below 0.001 and from 10**7 in triggers, targets and zones."""
    zones = [[("support", 0.0005)], [("resistance", 12345678.5)]]
    lv = spark.createDataFrame([("A", *zones, 12345678.5, 2.5e7, None, 0.0005)], "symbol string, entry_zones array<struct<kind string, level double>>, "
                               "exit_zones array<struct<kind string, level double>>, tp1 double, tp2 double, tp3 double, invalidation_level double")
    sig = spark.createDataFrame([("A", 0, "rsi_14", "bullish", "")], "symbol string, position int, signal string, bias string, note string")
    got = {r.scenario: (r.trigger, r.targets, r.invalidation) for r in SG.scenarios(lv, SG.confluence(sig), sig).collect()}
    assert got["bullish"] == ("close above resistance 12345678.5", "12345678.5, 25000000.0", "0.0005")
    assert got["bearish"] == ("close below support 0.0005", "0.0005", "12345678.5")
    assert lv.select(SG.zone_text("entry_zones")).first()[0] == "support@0.0005"


def test_slope_of_an_even_row_of_pivots(spark):
    """the sign of a slope that is zero but for rounding is the SQL's, in whatever order rows come."""
    import random
    import duckdb

    rng, con, rows = random.Random(5), duckdb.connect(), []
    for i in range(200):
        a, b = rng.randint(8000, 9900) / 100, rng.randint(8000, 9900) / 100
        rows += [(i, float(x + 1), y) for x, y in enumerate(rng.choice([[a, b, a], [a, b, b, a]]))]
    con.execute("CREATE TABLE t (i INT, x DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT i, regr_slope(y, x ORDER BY x) FROM t GROUP BY i").fetchall())
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "i int, x double, y double").groupBy("i").agg(ST.ordered_slope(F.collect_list(F.struct("x", "y"))).alias("s"))
    assert {r.i: r.s for r in d.collect()} == want and any(want.values())
