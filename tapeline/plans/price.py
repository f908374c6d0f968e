"""Price-bar queries: scans, resampling, rolling and recursive indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import rolling as R
from tapeline.functions.sql import register_table_functions
from tapeline.operators import bars as B
from tapeline.operators import indicators as I
from tapeline.plans.checks import view
from tapeline.registry import query


def rounded(df, keep, cols, digits=6):
    """Key columns plus value columns rounded for a stable comparison."""
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in cols])


KEYCOLS = ["symbol", "date"]

# -- scans, ranges, resampling -------------------------------------------------


@query("scan_bars", "SELECT symbol, exchange, country, date, open, high, low, close, adjusted_close, volume FROM v_raw_bars")
def scan_bars(v):
    return B.scan_bars(v.raw_bars)


@query("filter_bars_range", """SELECT symbol, exchange, date, open, high, low, close, volume FROM v_raw_bars
WHERE date >= DATE '1998-01-01' AND date <= DATE '1999-12-31' AND exchange='NSE'""")
def filter_bars_range(v):
    d = B.filter_range(v.raw_bars, "1998-01-01", "1999-12-31", exchange="NSE")
    return d.select("symbol", "exchange", "date", "open", "high", "low", "close", "volume")


@query("clean_bars", """SELECT symbol, date, open, high, low, close, volume FROM v_raw_bars
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND coalesce(volume,0) > 0""")
def clean_bars(v):
    return B.clean_bars(v.raw_bars).select("symbol", "date", "open", "high", "low", "close", "volume")


_RES = """SELECT symbol, {b} AS date, min_by(open, date) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
 max_by(close, date) FILTER (close IS NOT NULL) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM {t} GROUP BY symbol, {b}
HAVING min_by(open, date) FILTER (open IS NOT NULL) IS NOT NULL AND max_by(close, date) FILTER (close IS NOT NULL) IS NOT NULL"""
WEEK = "CAST(date_trunc('week', date) AS DATE) + 6"
MONTH = "last_day(date)"


@query("resample_week", _RES.format(b=WEEK, t="v_raw_bars"))
def resample_week(v):
    return B.resample(v.raw_bars, "week")


@query("resample_month", _RES.format(b=MONTH, t="v_raw_bars"))
def resample_month(v):
    return B.resample(v.raw_bars, "month")


_STORED = """SELECT symbol, exchange, max(date) AS date, arg_min_null(open, date) AS open, max(high) AS high, min(low) AS low,
 arg_max_null(close, date) AS close, arg_max_null(adjusted_close, date) AS adjusted_close, CAST(sum(volume) AS BIGINT) AS volume
FROM v_raw_bars GROUP BY symbol, exchange, {b}"""


@query("resample_stored", _STORED.format(b="isoyear(date), week(date)"))
def resample_stored(v):
    return B.resample_stored(v.raw_bars, "week")


@query("resample_stored_month", _STORED.format(b="year(date), month(date)"))
def resample_stored_month(v):
    return B.resample_stored(v.raw_bars, "month")


@query("load_span", "SELECT symbol, exchange, min(date) AS first_date, max(date) AS last_date, count(*) AS row_count FROM v_raw_bars GROUP BY 1,2")
def load_span(v):
    return B.load_span(v.raw_bars)


@query("tail_n", "SELECT symbol, date, close FROM v_rn WHERE rd <= 320")
def tail_n(v):
    return R.tail(v.bars, 320).select("symbol", "date", "close")


@query("latest_price_join", """SELECT m.symbol, m.exchange, q.close AS current_price, q.date AS price_date FROM v_meta m LEFT JOIN
 (SELECT symbol, max_by(close,date) AS close, max(date) AS date FROM v_quotes GROUP BY 1) q USING (symbol)""")
def latest_price_join(v):
    return v.stock_metadata.select("symbol", "exchange").join(B.latest_price(v.quotes), "symbol", "left")


@query("price_daily_candle", """SELECT symbol, date, open, close, CASE WHEN close>=open THEN 'up' ELSE 'down' END AS direction FROM v_rn WHERE rd=1""")
def price_daily_candle(v):
    return B.daily_candle(v.bars)


@query("downsample_stride", """SELECT symbol, date, close FROM v_rn
WHERE n<=500 OR (rn-1) % CAST(ceil(n/500.0) AS BIGINT) = 0 OR rn=n""")
def downsample_stride(v):
    return B.downsample_stride(v.bars).select("symbol", "date", "close")


view("v_5y", """SELECT b.* FROM v_bars b JOIN (SELECT symbol, max(date) AS m FROM v_bars GROUP BY 1) x USING (symbol) WHERE date > CAST(m - INTERVAL 60 MONTH AS DATE)""")
view("v_week5", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS wd FROM (" + _RES.format(b=WEEK, t="v_5y") + ")")
view("v_month5", _RES.format(b=MONTH, t="v_5y"))


@query("price_history_section", """SELECT symbol, 'daily' AS timeframe, date, open, high, low, close, volume, false AS is_partial FROM
 (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rd FROM v_5y) WHERE rd<=320
UNION ALL SELECT w.symbol, 'weekly', date, open, high, low, close, CASE WHEN date >= m - 730 THEN volume END, (wd=1 AND m < date) FROM v_week5 w
 JOIN (SELECT symbol, max(date) AS m FROM v_5y GROUP BY 1) x ON x.symbol=w.symbol WHERE wd<=280""")
def price_history_section(v):
    return B.price_history(v.bars)


@query("weekly_partial_flag", """SELECT w.symbol, date, CASE WHEN date >= m - 730 THEN volume END AS volume, (wd=1 AND m < date) AS is_partial FROM v_week5 w
 JOIN (SELECT symbol, max(date) AS m FROM v_5y GROUP BY 1) x ON x.symbol=w.symbol WHERE wd<=280""")
def weekly_partial_flag(v):
    d = B.weekly_history(B.recent_years(v.bars, B.REPORT_YEARS))
    return d.select("symbol", "date", "volume", "is_partial")


# -- rolling indicators ------------------------------------------------------------


def _mean(c, n):
    return f"CASE WHEN count({c}) OVER (PARTITION BY symbol ORDER BY date ROWS {n-1} PRECEDING)={n} THEN avg({c}) OVER (PARTITION BY symbol ORDER BY date ROWS {n-1} PRECEDING) END"


def _win(fn, c, n):
    return f"CASE WHEN rn>={n} THEN {fn}({c}) OVER (PARTITION BY symbol ORDER BY date ROWS {n-1} PRECEDING) END"


@query("sma", f"SELECT symbol, date, round({_mean('close',20)},6) AS sma_20, round({_mean('close',50)},6) AS sma_50, round({_mean('close',200)},6) AS sma_200 FROM v_rn")
def sma(v):
    return rounded(I.sma(v.bars), KEYCOLS, ["sma_20", "sma_50", "sma_200"])


@query("bollinger", f"""SELECT symbol, date, round(m+2*s,6) AS bb_upper, round(m,6) AS bb_middle, round(m-2*s,6) AS bb_lower FROM
 (SELECT symbol, date, {_win('avg','close',20)} AS m, {_win('stddev_pop','close',20)} AS s FROM v_rn)""")
def bollinger(v):
    return rounded(I.bollinger(v.bars), KEYCOLS, ["bb_upper", "bb_middle", "bb_lower"])


view("v_fast", f"SELECT *, 100.0*(close-{_win('min','low',14)})/nullif({_win('max','high',14)}-{_win('min','low',14)},0) AS fast FROM v_rn")
view("v_stochk", f"SELECT *, {_mean('fast',3)} AS k FROM v_fast")


@query("stochastic", f"SELECT symbol, date, round(k,6) AS stoch_k, round({_mean('k',3)},6) AS stoch_d FROM v_stochk")
def stochastic(v):
    return rounded(I.stochastic(v.bars), KEYCOLS, ["stoch_k", "stoch_d"])


@query("obv", """SELECT symbol, date, CAST(sum(s*volume) OVER (PARTITION BY symbol ORDER BY date) AS BIGINT) AS obv FROM
 (SELECT symbol, date, volume, coalesce(sign(close-lag(close) OVER (PARTITION BY symbol ORDER BY date)),0) AS s FROM v_bars)""")
def obv(v):
    return I.obv(v.bars).select("symbol", "date", "obv")


view("v_tp", f"SELECT *, (high+low+close)/3.0 AS tp FROM v_rn")
view("v_cci", f"SELECT *, {_win('avg','tp',20)} AS m, {_win('list','tp',20)} AS l FROM v_tp")


@query("cci", "SELECT symbol, date, round((tp-m)/nullif(0.015*(list_sum(list_transform(l, lambda x: abs(x-m)))/20),0),6) AS cci_20 FROM v_cci")
def cci(v):
    return rounded(I.cci(v.bars), KEYCOLS, ["cci_20"])


@query("williams_r", f"SELECT symbol, date, round(-100.0*({_win('max','high',14)}-close)/nullif({_win('max','high',14)}-{_win('min','low',14)},0),6) AS williams_r_14 FROM v_rn")
def williams_r(v):
    return rounded(I.williams_r(v.bars), KEYCOLS, ["williams_r_14"])


@query("acc_dist", """SELECT symbol, date, round(sum(coalesce(((close-low)-(high-close))/nullif(high-low,0)*volume,0)) OVER (PARTITION BY symbol ORDER BY date),4) AS acc_dist FROM v_bars""")
def acc_dist(v):
    return rounded(I.acc_dist(v.bars), KEYCOLS, ["acc_dist"], 4)


@query("vwap_running", """SELECT symbol, date, round(sum(tp*volume) OVER w / nullif(sum(volume) OVER w,0),6) AS vwap FROM v_tp WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def vwap_running(v):
    return rounded(I.vwap_running(v.bars), KEYCOLS, ["vwap"])


view("v_ret", "SELECT *, ln(close/lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS lr FROM v_rn")


@query("hist_volatility", """SELECT symbol, date, round(CASE WHEN count(lr) OVER w = 20 THEN stddev_samp(lr) OVER w END * sqrt(252) * 100,6) AS hist_volatility
FROM v_ret WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""")
def hist_volatility(v):
    return rounded(I.hist_volatility(v.bars), KEYCOLS, ["hist_volatility"])


@query("hv20_hv60", """SELECT symbol, round(stddev_samp(lr) FILTER (rd<=20)*sqrt(252)*100,4) AS hv_20d_annualized_pct,
 round(stddev_samp(lr) FILTER (rd<=60)*sqrt(252)*100,4) AS hv_60d_annualized_pct FROM v_ret WHERE n>60 GROUP BY 1""")
def hv20_hv60(v):
    return I.hv20_hv60(v.bars)


view("v_mids", f"""SELECT *, ({_win('max','high',9)}+{_win('min','low',9)})/2.0 AS t9, ({_win('max','high',26)}+{_win('min','low',26)})/2.0 AS k26,
 ({_win('max','high',52)}+{_win('min','low',52)})/2.0 AS m52 FROM v_rn""")
view("v_ichi", """SELECT *, t9 AS tenkan, k26 AS kijun, lag((t9+k26)/2.0,26) OVER w AS sa, lag(m52,26) OVER w AS sb, lead(close,26) OVER w AS ch FROM v_mids
 WINDOW w AS (PARTITION BY symbol ORDER BY date)""")


@query("ichimoku", """SELECT symbol, date, round(tenkan,6) AS ichimoku_tenkan, round(kijun,6) AS ichimoku_kijun, round(sa,6) AS ichimoku_senkou_a,
 round(sb,6) AS ichimoku_senkou_b, round(ch,6) AS ichimoku_chikou FROM v_ichi""")
def ichimoku(v):
    cols = ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou"]
    return rounded(I.ichimoku(v.bars), KEYCOLS, [f"ichimoku_{c}" for c in cols])


@query("price_vs_cloud", """SELECT symbol, date, CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN CASE WHEN close>greatest(sa,sb) THEN 'above cloud (bullish)'
 WHEN close<least(sa,sb) THEN 'below cloud (bearish)' ELSE 'inside cloud (neutral)' END END AS price_vs_cloud FROM v_ichi""")
def price_vs_cloud(v):
    return I.price_vs_cloud(I.ichimoku(v.bars)).select("symbol", "date", "price_vs_cloud")


view("v_swing", """SELECT symbol, max(high) AS swing_high, min(low) AS swing_low, min_by(date, {'h':-high,'d':date}) AS hd, min_by(date, {'l':low,'d':date}) AS ld
 FROM v_rn WHERE rd<=120 GROUP BY 1""")
view("v_fib", """SELECT symbol, swing_high, swing_low, CASE WHEN hd>=ld THEN 'up' ELSE 'down' END AS direction, label,
 round(CASE WHEN hd>=ld THEN swing_high-(swing_high-swing_low)*r ELSE swing_low+(swing_high-swing_low)*r END,4) AS level
 FROM v_swing, (VALUES ('0.0%',0.0::DOUBLE),('23.6%',0.236::DOUBLE),('38.2%',0.382::DOUBLE),('50.0%',0.5::DOUBLE),('61.8%',0.618::DOUBLE),('78.6%',0.786::DOUBLE),('100.0%',1.0::DOUBLE)) t(label,r)
 WHERE swing_high<>swing_low""")


@query("fib_levels", "SELECT symbol, swing_high, swing_low, direction, label, level FROM v_fib")
def fib_levels(v):
    return I.fib_levels(v.bars)


@query("udtf_fib", "SELECT symbol, label, level FROM v_fib WHERE level BETWEEN swing_low AND swing_high")
def udtf_fib(v):
    """The registered table function, called for every symbol's swing."""
    register_table_functions(v.spark)
    swings = I.fib_swing(v.bars).select("symbol", "swing_high", "swing_low", "direction")
    return v.spark.sql("""SELECT s.symbol, f.label, f.level FROM {swings} s, LATERAL fib_levels_of(s.swing_high, s.swing_low, s.direction) f
        WHERE f.level BETWEEN s.swing_low AND s.swing_high""", swings=swings)


view("v_sma", f"SELECT *, {_mean('close',20)} AS s20, {_mean('close',50)} AS s50, {_mean('close',200)} AS s200 FROM v_rn")


@query("sma_slope", """SELECT symbol, date, round((s20/lag(s20,5) OVER w-1)*100,2) AS sma_20_slope_pct, round((s50/lag(s50,5) OVER w-1)*100,2) AS sma_50_slope_pct,
 round((s200/lag(s200,5) OVER w-1)*100,2) AS sma_200_slope_pct FROM v_sma WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def sma_slope(v):
    d = I.sma_slope(I.sma(v.bars))
    return d.select("symbol", "date", *[f"sma_{n}_slope_pct" for n in (20, 50, 200)])


@query("cross_state", """SELECT symbol, date, CASE WHEN s50 IS NOT NULL AND s200 IS NOT NULL THEN CASE WHEN s50>s200 THEN 'golden-cross regime' ELSE 'death-cross regime' END END AS golden_death_cross_state FROM v_sma""")
def cross_state(v):
    return I.cross_state(I.sma(v.bars, (50, 200))).select("symbol", "date", "golden_death_cross_state")


view("v_frames", """SELECT symbol,'daily' AS timeframe,date,open,high,low,close,volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rd FROM v_5y) WHERE rd<=320
 UNION ALL SELECT symbol,'weekly',date,open,high,low,close,volume FROM v_week5 WHERE wd<=280
 UNION ALL SELECT symbol,'monthly',date,open,high,low,close,volume FROM v_month5""")
view("v_frn", """SELECT *, row_number() OVER (PARTITION BY symbol,timeframe ORDER BY date) AS rn, row_number() OVER (PARTITION BY symbol,timeframe ORDER BY date DESC) AS rd,
 count(*) OVER (PARTITION BY symbol,timeframe) AS n FROM v_frames""")
_CW = "round((close/lag(close,{n}) OVER w-1)*100,2)"


def _chg(d=None, w=None, m=None):
    parts = [f"WHEN timeframe='{t}' THEN {_CW.format(n=n)}" for t, n in (("daily", d), ("weekly", w), ("monthly", m)) if n]
    return "CASE " + " ".join(parts) + " END"


view("v_changes", f"""SELECT symbol, timeframe, rd, {_chg(1)} AS c1d, {_chg(5,1)} AS c1w, {_chg(21,4,1)} AS c1m, {_chg(63,13,3)} AS c3m, {_chg(252,52,12)} AS c1y
 FROM v_frn WINDOW w AS (PARTITION BY symbol,timeframe ORDER BY date)""")


@query("change_windows", """SELECT symbol, timeframe, c1d AS change_pct_1d, c1w AS change_pct_1w, c1m AS change_pct_1m, c3m AS change_pct_3m, c1y AS change_pct_1y FROM v_changes WHERE rd=1""")
def change_windows(v):
    keys = ("symbol", "timeframe")
    d = I.change_windows(R.number_rows(B.report_frames(v.bars), keys)).filter("rd = 1")
    return d.select(*keys, *[f"change_pct_{c}" for c in I.CHANGE_LABELS])


@query("rs_line", """WITH a AS (SELECT b.symbol, b.date, b.close, i.close AS bench, round(b.close/i.close,6) AS r, row_number() OVER w AS rd, count(*) OVER (PARTITION BY symbol) AS n,
  lead(round(b.close/i.close,6),20) OVER w AS m1, lead(round(b.close/i.close,6),62) OVER w AS m3,
  round((b.close/lead(b.close,62) OVER w-1)*100,2) AS sc, round((i.close/lead(i.close,62) OVER w-1)*100,2) AS bc
  FROM v_bars b JOIN v_market_index i USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY date DESC))
 SELECT symbol, r AS rs_ratio, CASE WHEN n>21 THEN m1 END AS rs_ratio_1m_ago, CASE WHEN n>63 THEN m3 END AS rs_ratio_3m_ago, CASE WHEN n>63 THEN sc END AS stock_3m_change_pct,
  CASE WHEN n>63 THEN bc END AS benchmark_3m_change_pct, CASE WHEN n>63 THEN CASE WHEN r>m1 AND m1>m3 THEN 'outperforming (RS rising across 1m and 3m)'
  WHEN r<m1 AND m1<m3 THEN 'underperforming (RS falling across 1m and 3m)' ELSE 'mixed' END END AS verdict FROM a WHERE rd=1 AND n>=60""")
def rs_line(v):
    return I.rs_line(v.bars, v.market_index)


@query("benchmark_align", """SELECT symbol, date, b.close AS close, i.close AS bench FROM v_bars b JOIN v_market_index i USING (date)
 QUALIFY count(*) OVER (PARTITION BY symbol) >= 60""")
def benchmark_align(v):
    d = v.bars.select("symbol", "date", "close").join(v.market_index.select("date", F.col("close").alias("bench")), "date")
    n = F.count(F.lit(1)).over(R.Window.partitionBy("symbol"))
    return d.withColumn("_n", n).filter("_n >= 60").select("symbol", "date", "close", "bench")


view("v_vol", """SELECT symbol, avg(volume) FILTER (rd<=20) AS a20, avg(volume) FILTER (rd<=5) AS r5, median((high-low)/nullif(low,0)*100) AS med FROM v_rn GROUP BY 1""")


@query("volume_stats", """SELECT symbol, round(a20,4) AS avg_volume_20bar, round(r5,4) AS recent_5bar_avg, round(r5/a20,4) AS recent_vs_avg20_ratio,
 CASE WHEN r5/a20>1.2 THEN 'rising' WHEN r5/a20<0.8 THEN 'falling' ELSE 'stable' END AS trend FROM v_vol""")
def volume_stats(v):
    return I.volume_stats(R.number_rows(v.bars))


@query("volume_spikes", """SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY m DESC, date) AS rank, date, m AS multiple_of_avg20 FROM
 (SELECT symbol, date, round(volume/a20,4) AS m FROM v_rn JOIN v_vol USING (symbol) WHERE rd<=60 AND volume>2*a20)
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY m DESC, date) <= 5""")
def volume_spikes(v):
    return I.volume_spikes(R.number_rows(v.bars))


@query("unusual_days", """SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY range_pct DESC, date) AS rank, date, range_pct, close_change_pct, volume_multiple_of_avg20 FROM
 (SELECT symbol, date, round((high-low)/low*100,4) AS range_pct, round((close/open-1)*100,4) AS close_change_pct, round(volume/a20,4) AS volume_multiple_of_avg20
  FROM v_rn JOIN v_vol USING (symbol) WHERE (high-low)/low*100 > 3*med) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY range_pct DESC, date) <= 5""")
def unusual_days(v):
    return I.unusual_days(R.number_rows(v.bars))


@query("vwap_anchored", """SELECT symbol, round(CAST(sum(CAST(high AS DECIMAL(18,6))*volume+CAST(low AS DECIMAL(18,6))*volume+CAST(close AS DECIMAL(18,6))*volume) AS DOUBLE)/3.0/sum(volume),4) AS vwap_anchored,
 min(date) AS window_start, max(date) AS window_end FROM v_rn WHERE rd<=320 GROUP BY 1""")
def vwap_anchored(v):
    return B.vwap_anchored(R.tail(v.bars, B.DAILY_BARS))


@query("high_low_52w", "SELECT symbol, max(high) AS high_52w, min(low) AS low_52w FROM v_rn WHERE rd<=252 GROUP BY 1")
def high_low_52w(v):
    return B.high_low_52w(R.number_rows(v.bars))


view("v_ticks", """SELECT event_type AS symbol, ts, event_id AS ord, value AS open, value+1 AS high, value-1 AS low, value AS close, CAST(event_id % 7 AS BIGINT) AS volume FROM events""")


def ticks(v):
    """Intraday prints derived from the event stream: one tick per event, symbol = event type."""
    val = F.col("value")
    return v.table("events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("ord"), val.alias("open"),
        (val + 1).alias("high"), (val - 1).alias("low"), val.alias("close"), (F.col("event_id") % 7).alias("volume"),
    )


@query("session_snapshot", """SELECT symbol, date, bars, last, day_open, day_high, day_low, session_vwap,
  CASE WHEN day_high>day_low THEN round((last-day_low)/(day_high-day_low)*100,2) END AS position_in_day_range_pct, last>session_vwap AS above_vwap FROM (
 SELECT symbol, CAST(ts AS DATE) AS date, count(*) AS bars, max_by(close,{'t':ts,'o':ord}) AS last, min_by(open,{'t':ts,'o':ord}) AS day_open, max(high) AS day_high, min(low) AS day_low,
  CASE WHEN sum(volume)>0 THEN round(CAST(sum((CAST(high AS DECIMAL(18,6))+CAST(low AS DECIMAL(18,6))+CAST(close AS DECIMAL(18,6)))*CAST(volume AS DECIMAL(10,0))) AS DOUBLE)/3.0/sum(volume),4) END AS session_vwap
 FROM v_ticks GROUP BY 1,2)""")
def session_snapshot(v):
    return B.session_snapshot(ticks(v))


# -- recursive indicators ------------------------------------------------------------

view("v_move0", """SELECT symbol, date, rn, rd, n, close, high, low, close-lag(close) OVER w AS d, lag(close) OVER w AS pc, high-lag(high) OVER w AS up, lag(low) OVER w-low AS dn
 FROM v_rn WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
_MOVE = """SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d,0.0::DOUBLE) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d,0.0::DOUBLE) END AS l,
 greatest(high-low, abs(high-pc), abs(low-pc)) AS tr, CASE WHEN up>dn AND up>0 THEN up ELSE 0.0::DOUBLE END AS pdm, CASE WHEN dn>up AND dn>0 THEN dn ELSE 0.0::DOUBLE END AS mdm FROM {t}"""
view("v_move", _MOVE.format(t="v_move0"))


def recursion(src: str, name: str, cols: dict[str, tuple[str, str]], keys=("symbol",)) -> str:
    """Recursive SQL for smoothed columns: name -> (input, alpha text)."""
    k = ", ".join(keys)
    sk = ", ".join(f"s.{c}" for c in keys)
    on = " AND ".join(f"s.{c}=e.{c}" for c in keys)
    seed = ", ".join(f"CAST({x} AS DOUBLE) AS {o}" for o, (x, _) in cols.items())
    step = ", ".join(f"CASE WHEN e.{o} IS NULL THEN s.{x} ELSE (1-{a})*e.{o}+{a}*s.{x} END" for o, (x, a) in cols.items())
    return (f"SELECT {k}, rn, {seed} FROM {src} WHERE rn=1 UNION ALL SELECT {sk}, s.rn, {step} FROM {name} e JOIN {src} s ON {on} AND s.rn=e.rn+1")


A14, A12, A26, A9 = "(1.0::DOUBLE/14)", "(2.0::DOUBLE/13)", "(2.0::DOUBLE/27)", "(2.0::DOUBLE/10)"
_FAMILY = {"e12": ("close", A12), "e26": ("close", A26), "ag": ("g", A14), "al": ("l", A14), "atr": ("tr", A14), "p": ("pdm", A14), "m": ("mdm", A14)}
view("v_rec_one", recursion("v_move", "v_rec_one", _FAMILY))
_DX = """SELECT s.*, e12, e26, atr, e12-e26 AS macd, CASE WHEN al=0 AND ag>0 THEN 100.0 WHEN al=0 THEN NULL ELSE 100.0-100.0/(1.0+ag/al) END AS rsi,
 100.0*p/nullif(atr,0) AS pdi, 100.0*m/nullif(atr,0) AS mdi, 100.0*abs(100.0*p/nullif(atr,0)-100.0*m/nullif(atr,0))/nullif(100.0*p/nullif(atr,0)+100.0*m/nullif(atr,0),0) AS dx
 FROM {a} s JOIN {b} e ON {on} AND s.rn=e.rn"""
view("v_dx", _DX.format(a="v_move", b="v_rec_one", on="s.symbol=e.symbol"))
view("v_rec_two", recursion("v_dx", "v_rec_two", {"adx": ("dx", A14), "sig": ("macd", A9)}))


@query("ema", "SELECT s.symbol, s.date, round(e12,6) AS ema_12, round(e26,6) AS ema_26 FROM v_move s JOIN v_rec_one e ON s.symbol=e.symbol AND s.rn=e.rn")
def ema(v):
    return rounded(I.ema(R.number_rows(v.bars)), KEYCOLS, ["ema_12", "ema_26"])


view("v_rec_long", recursion("v_move", "v_rec_long", {f"e{n}": ("close", f"(2.0::DOUBLE/{n + 1})") for n in (50, 200, 400)}))


@query("ema_long", "SELECT s.symbol, s.date, round(e50,6) AS ema_50, round(e200,6) AS ema_200, round(e400,6) AS ema_400 FROM v_move s JOIN v_rec_long e ON s.symbol=e.symbol AND s.rn=e.rn")
def ema_long(v):
    """Long memories: the whole history counts."""
    return rounded(I.ema(R.number_rows(v.bars), (50, 200, 400)), KEYCOLS, ["ema_50", "ema_200", "ema_400"])


@query("rsi", "SELECT symbol, date, round(rsi,6) AS rsi_14 FROM v_dx")
def rsi(v):
    return rounded(I.rsi(R.number_rows(v.bars)), KEYCOLS, ["rsi_14"])


@query("atr", "SELECT symbol, date, round(atr,6) AS atr_14 FROM v_dx")
def atr(v):
    return rounded(I.atr(R.number_rows(v.bars)), KEYCOLS, ["atr_14"])


@query("macd", """SELECT s.symbol, s.date, round(s.macd,6) AS macd, round(sig,6) AS macd_signal, round(s.macd-sig,6) AS macd_hist FROM v_dx s JOIN v_rec_two e ON s.symbol=e.symbol AND s.rn=e.rn""")
def macd(v):
    return rounded(I.macd(R.number_rows(v.bars)), KEYCOLS, ["macd", "macd_signal", "macd_hist"])


@query("adx_di", """SELECT s.symbol, s.date, round(adx,6) AS adx_14, round(pdi,6) AS plus_di_14, round(mdi,6) AS minus_di_14 FROM v_dx s JOIN v_rec_two e ON s.symbol=e.symbol AND s.rn=e.rn""")
def adx_di(v):
    return rounded(I.adx_di(R.number_rows(v.bars)), KEYCOLS, ["adx_14", "plus_di_14", "minus_di_14"])


@query("ema_series", "SELECT s.symbol, s.date, round(e12,6) AS ema_12 FROM v_move s JOIN v_rec_one e ON s.symbol=e.symbol AND s.rn=e.rn WHERE s.rn>=12")
def ema_series(v):
    d = R.number_rows(v.bars)
    return rounded(I.ema(d, (12,)).filter("rn >= 12"), KEYCOLS, ["ema_12"])


# -- the indicator row -----------------------------------------------------------------


def _years(y):
    return f"(SELECT b.* FROM v_bars b JOIN (SELECT symbol, max(date) AS m FROM v_bars GROUP BY 1) x USING (symbol) WHERE date > CAST(m - INTERVAL {12*y} MONTH AS DATE))"


view("v_tframes", f"""SELECT symbol,'daily' AS timeframe,date,open,high,low,close,volume FROM {_years(1)}
 UNION ALL SELECT symbol,'weekly',date,open,high,low,close,volume FROM ({_RES.format(b=WEEK, t=_years(2))})
 UNION ALL SELECT symbol,'monthly',date,open,high,low,close,volume FROM v_month5""")


def indicator_views(p: str, frames: str) -> str:
    """Check views of the whole indicator row over a (symbol, timeframe) table; returns the last-row view."""
    k = "symbol, timeframe"
    w = f"PARTITION BY {k} ORDER BY date"
    view(f"v_{p}rn", f"""SELECT *, row_number() OVER ({w}) AS rn, row_number() OVER ({w} DESC) AS rd, count(*) OVER (PARTITION BY {k}) AS n FROM {frames}""")
    view(f"v_{p}mv0", f"""SELECT *, (high+low+close)/3.0 AS tp, close-lag(close) OVER w AS d, lag(close) OVER w AS pc, high-lag(high) OVER w AS up, lag(low) OVER w-low AS dn FROM v_{p}rn WINDOW w AS ({w})""")
    view(f"v_{p}mv", _MOVE.format(t=f"v_{p}mv0"))
    view(f"v_rec_{p}1", recursion(f"v_{p}mv", f"v_rec_{p}1", _FAMILY, ("symbol", "timeframe")))
    on = "s.symbol=e.symbol AND s.timeframe=e.timeframe"
    view(f"v_{p}dx", _DX.format(a=f"v_{p}mv", b=f"v_rec_{p}1", on=on))
    view(f"v_rec_{p}2", recursion(f"v_{p}dx", f"v_rec_{p}2", {"adx": ("dx", A14), "sig": ("macd", A9)}, ("symbol", "timeframe")))

    def win(fn, c, n):
        return f"CASE WHEN rn>={n} THEN {fn}({c}) OVER ({w} ROWS {n-1} PRECEDING) END"

    def cents(n):  # closes are whole cents, so their mean is exact in integers
        return f"CASE WHEN rn>={n} THEN CAST(sum(CAST(round(close*100) AS BIGINT)) OVER ({w} ROWS {n-1} PRECEDING) AS DOUBLE)/{n*100} END"

    view(f"v_{p}w1", f"""SELECT s.*, adx, sig, {cents(20)} AS s20, {cents(50)} AS s50, {cents(200)} AS s200, {win('stddev_pop','close',20)} AS sd,
 100.0*(close-{win('min','low',14)})/nullif({win('max','high',14)}-{win('min','low',14)},0) AS fast,
 -100.0*({win('max','high',14)}-close)/nullif({win('max','high',14)}-{win('min','low',14)},0) AS wr, {win('avg','tp',20)} AS tpm, {win('list','tp',20)} AS tpl,
 CAST(sum(coalesce(sign(d),0)*volume) OVER ({w}) AS BIGINT) AS obv, sum(coalesce(((close-low)-(high-close))/nullif(high-low,0)*volume,0)) OVER ({w}) AS ad,
 ({win('max','high',9)}+{win('min','low',9)})/2.0 AS t9, ({win('max','high',26)}+{win('min','low',26)})/2.0 AS k26, ({win('max','high',52)}+{win('min','low',52)})/2.0 AS m52
 FROM v_{p}dx s JOIN (SELECT symbol AS es, timeframe AS et, rn AS er, adx, sig FROM v_rec_{p}2) e ON symbol=es AND timeframe=et AND rn=er""")
    view(f"v_{p}w2", f"""SELECT *, CASE WHEN count(fast) OVER x=3 THEN avg(fast) OVER x END AS k, lag((t9+k26)/2.0,26) OVER o AS sa, lag(m52,26) OVER o AS sb, lead(close,26) OVER o AS chik, lag(close,0) OVER o AS c0
 FROM v_{p}w1 WINDOW x AS ({w} ROWS 2 PRECEDING), o AS ({w})""")
    view(f"v_{p}ind", f"""SELECT *, CASE WHEN count(k) OVER x=3 THEN avg(k) OVER x END AS dd, (tp-tpm)/nullif(0.015*(list_sum(list_transform(tpl, lambda z: abs(z-tpm)))/20),0) AS cci,
 lag(s20,5) OVER o AS s20p, lag(s50,5) OVER o AS s50p, lag(s200,5) OVER o AS s200p FROM v_{p}w2 WINDOW x AS ({w} ROWS 2 PRECEDING), o AS ({w})""")
    cols = {"sma_20": "s20", "sma_50": "s50", "sma_200": "s200", "ema_12": "e12", "ema_26": "e26", "rsi_14": "rsi", "macd": "macd", "macd_signal": "sig", "macd_hist": "macd-sig",
            "bb_upper": "s20+2*sd", "bb_middle": "s20", "bb_lower": "s20-2*sd", "atr_14": "atr", "williams_r_14": "wr", "adx_14": "adx", "plus_di_14": "pdi", "minus_di_14": "mdi",
            "cci_20": "cci", "stoch_k": "k", "stoch_d": "dd", "obv": "CAST(obv AS DOUBLE)", "acc_dist": "ad", "ichimoku_tenkan": "t9", "ichimoku_kijun": "k26",
            "ichimoku_senkou_a": "sa", "ichimoku_senkou_b": "sb", "ichimoku_chikou": "chik"}
    sel = ", ".join(f"CASE WHEN n>={I.MIN_BARS[c]} THEN round({e},4) END AS {c}" for c, e in cols.items())
    return view(f"v_{p}last", f"SELECT symbol, timeframe, n AS bars, close AS current_price, {sel} FROM v_{p}ind WHERE rd=1")


_TECH_LAST = indicator_views("t", "v_tframes")
IND_COLS = ", ".join(["symbol", "timeframe", "bars", "current_price", *I.MIN_BARS])


@query("technicals_last", f"SELECT {IND_COLS} FROM {_TECH_LAST}")
def technicals_last(v):
    return I.technicals_last(B.technicals_frames(v.bars))


@query("weekly_snapshot", """WITH a AS (SELECT symbol, date, close, row_number() OVER d AS rd, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS s20, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS s50,
  lead(close,1) OVER d AS p1, lead(close,4) OVER d AS p4, lead(close,13) OVER d AS p13, lead(close,52) OVER d AS p52, count(*) OVER (PARTITION BY symbol) AS n FROM (""" + _RES.format(b=WEEK, t="v_bars") + """) WINDOW d AS (PARTITION BY symbol ORDER BY date DESC))
 SELECT symbol, date, close, round(CASE WHEN n>=20 THEN s20 END,4) AS sma_20, round(CASE WHEN n>=50 THEN s50 END,4) AS sma_50, round((close/p1-1)*100,2) AS change_pct_1w, round((close/p4-1)*100,2) AS change_pct_1m,
 round((close/p13-1)*100,2) AS change_pct_3m, round((close/p52-1)*100,2) AS change_pct_1y FROM a WHERE rd=1""")
def weekly_snapshot(v):
    """Latest weekly averages and changes of every symbol (the flagship query)."""
    d = B.resample(v.bars, "week").withColumn("timeframe", F.lit("weekly"))
    d = I.change_windows(I.sma(R.number_rows(d), (20, 50)), ("symbol",)).filter("rd = 1")
    return d.select("symbol", "date", "close", F.round("sma_20", 4).alias("sma_20"), F.round("sma_50", 4).alias("sma_50"),
                    *[f"change_pct_{c}" for c in ("1w", "1m", "3m", "1y")])
