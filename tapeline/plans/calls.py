"""Signal, level and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions.sql import register_table_functions
from tapeline.operators import bars as B
from tapeline.operators import indicators as I
from tapeline.operators import signals as SG
from tapeline.operators import structure as ST
from tapeline.plans.checks import view
from tapeline.plans.shapes import KEYS, K, frames
from tapeline.registry import query

AS_OF = "2001-07-20"


def _last(v):
    return SG.report_last(B.report_frames(v.bars))


def _sr_daily(v):
    return ST.support_resistance(frames(v)).filter(F.col("timeframe") == "daily")


def _fib_daily(v):
    d = B.report_frames(v.bars).filter(F.col("timeframe") == "daily")
    return I.fib_levels(d)


view("v_fvwap", f"""SELECT {K}, round(CAST(sum((CAST(high AS DECIMAL(18,6))+CAST(low AS DECIMAL(18,6))+CAST(close AS DECIMAL(18,6)))*CAST(volume AS DECIMAL(18,0))) AS DOUBLE)/3.0/sum(volume),4) AS vwap_anchored,
 max(high) FILTER (rd<=252) AS high_52w, min(low) FILTER (rd<=252) AS low_52w FROM v_frn GROUP BY ALL""")
view("v_rl", f"""SELECT l.*, vwap_anchored, round(high_52w,4) AS high_52w, round(low_52w,4) AS low_52w, c1y AS change_pct_1y, CASE WHEN sma_50 IS NOT NULL AND sma_200 IS NOT NULL THEN
 CASE WHEN i.s50>i.s200 THEN 'golden-cross regime' ELSE 'death-cross regime' END END AS gdc FROM v_rlast l JOIN v_fvwap USING ({K}) JOIN (SELECT {K}, c1y FROM v_changes WHERE rd=1) USING ({K}) JOIN (SELECT {K}, s50, s200 FROM v_rind WHERE rd=1) i USING ({K})""")
view("v_dl", "SELECT * FROM v_rl WHERE timeframe='daily'")


@query("report_last", f"""SELECT {K}, bars, current_price, vwap_anchored, high_52w, low_52w, change_pct_1y, gdc AS golden_death_cross_state, rsi_14, macd, atr_14, adx_14 FROM v_rl""")
def report_last(v):
    return _last(v).select(*KEYS, "bars", "current_price", "vwap_anchored", "high_52w", "low_52w", "change_pct_1y", "golden_death_cross_state", "rsi_14", "macd", "atr_14", "adx_14")


_side = lambda e: f"CASE WHEN {e} THEN 'bullish' ELSE 'bearish' END"
_SIG = [
    *[(f"price_vs_sma_{p}", f"sma_{p} IS NOT NULL", _side(f"current_price>sma_{p}"), "''") for p in (20, 50, 200)],
    ("golden_death_cross_state", "sma_50 IS NOT NULL AND sma_200 IS NOT NULL", _side("sma_50>sma_200"), "'50 above 200 = golden-cross state; below = death-cross state'"),
    ("rsi_14", "rsi_14 IS NOT NULL", "CASE WHEN rsi_14>=70 THEN 'bearish' WHEN rsi_14<=30 THEN 'bullish' WHEN rsi_14>60 THEN 'bullish' WHEN rsi_14<40 THEN 'bearish' ELSE 'neutral' END",
     "CASE WHEN rsi_14>=70 THEN 'overbought' WHEN rsi_14<=30 THEN 'oversold' WHEN rsi_14>60 OR rsi_14<40 THEN '' ELSE '40-60 neutral band' END"),
    ("macd_vs_signal", "macd IS NOT NULL AND macd_signal IS NOT NULL", _side("macd>macd_signal"), "''"),
    ("stochastic", "stoch_k IS NOT NULL AND stoch_d IS NOT NULL", _side("stoch_k>stoch_d"), "CASE WHEN stoch_k>=80 THEN 'overbought' WHEN stoch_k<=20 THEN 'oversold' ELSE '' END"),
    ("adx_14", "adx_14 IS NOT NULL", f"CASE WHEN adx_14<=20 THEN 'neutral' ELSE {_side('plus_di_14>minus_di_14')} END", "CASE WHEN adx_14<=20 THEN 'weak trend — direction unreliable' ELSE 'strength from ADX; direction from +DI vs -DI' END"),
    ("cci_20", "cci_20 IS NOT NULL", "CASE WHEN cci_20>50 THEN 'bullish' WHEN cci_20<-50 THEN 'bearish' ELSE 'neutral' END", "CASE WHEN cci_20 BETWEEN -50 AND 50 THEN '±50 neutral band' ELSE '' END"),
    ("williams_r_14", "williams_r_14 IS NOT NULL", _side("williams_r_14>-50"), "CASE WHEN williams_r_14>-20 THEN 'overbought' WHEN williams_r_14<-80 THEN 'oversold' ELSE '' END"),
    ("price_vs_vwap", "vwap_anchored IS NOT NULL", _side("current_price>vwap_anchored"), "'anchored to window start (see vwap_anchored_meta), not a session VWAP'"),
]
view("v_sig", "SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY o)-1 AS INT) AS position, signal, bias, note FROM (" + " UNION ALL ".join(
    f"SELECT symbol, {i} AS o, '{n}' AS signal, {b} AS bias, {t} AS note FROM v_dl WHERE {c}" for i, (n, c, b, t) in enumerate(_SIG)) + ")")


@query("signals", "SELECT * FROM v_sig")
def signals(v):
    return SG.signals(SG.daily(_last(v)))


@query("udtf_signals", "SELECT symbol, signal, bias FROM v_sig WHERE bias<>'neutral'")
def udtf_signals(v):
    """The registered table function, called for every symbol's last row."""
    register_table_functions(v.spark)
    last = SG.daily(_last(v)).select("symbol", F.struct(*SG.signal_inputs()).alias("last"))
    return v.spark.sql("SELECT d.symbol, s.signal, s.bias FROM {last} d, LATERAL signals_of(d.last) s WHERE s.bias <> 'neutral'", last=last)


view("v_conf0", "SELECT symbol, count(*) FILTER (bias='bullish') AS bullish, count(*) FILTER (bias='bearish') AS bearish, count(*) FILTER (bias='neutral') AS neutral, count(*) AS total_signals FROM v_sig GROUP BY 1")
view("v_conf", """SELECT *, CASE WHEN bullish/total_signals>=0.6::DOUBLE AND bullish>bearish THEN 'bullish' WHEN bearish/total_signals>=0.6::DOUBLE AND bearish>bullish THEN 'bearish' ELSE 'mixed' END AS overall,
 round(bullish/total_signals*100,2) AS bullish_share FROM v_conf0""")


@query("confluence", "SELECT * FROM v_conf")
def confluence(v):
    return SG.confluence(SG.signals(SG.daily(_last(v))))


view("v_mtf0", f"""SELECT {K}, (current_price>sma_20)::INT AS a1, (current_price>sma_50)::INT AS a2, (rsi_14>60)::INT AS a3, (macd>macd_signal)::INT AS a4, (NOT current_price>sma_20)::INT AS b1,
 (NOT current_price>sma_50)::INT AS b2, (rsi_14<40)::INT AS b3, (NOT macd>macd_signal)::INT AS b4 FROM v_rl""")
view("v_mtf1", f"SELECT {K}, coalesce(a1,0)+coalesce(a2,0)+coalesce(a3,0)+coalesce(a4,0) AS bull, coalesce(b1,0)+coalesce(b2,0)+coalesce(b3,0)+coalesce(b4,0) AS bear FROM v_mtf0")
view("v_mtf", """SELECT s.symbol, t.timeframe, CASE WHEN bull>bear THEN 'bullish' WHEN bear>bull THEN 'bearish' WHEN bull IS NULL THEN 'unavailable' ELSE 'neutral' END AS state, bull, bear
 FROM (SELECT DISTINCT symbol FROM v_rl) s, (VALUES ('intraday'),('daily'),('weekly'),('monthly')) t(timeframe) LEFT JOIN v_mtf1 m ON m.symbol=s.symbol AND m.timeframe=t.timeframe""")


@query("mtf_matrix", "SELECT symbol, timeframe, state, bull, bear FROM v_mtf")
def mtf_matrix(v):
    return SG.mtf_matrix(_last(v))


view("v_dfib0", """SELECT symbol, max(high) AS swing_high, min(low) AS swing_low, min_by(date, {'h':-high,'d':date}) AS hd, min_by(date, {'l':low,'d':date}) AS ld FROM v_frn WHERE timeframe='daily' AND rd<=120 GROUP BY 1""")
view("v_dfib", """SELECT symbol, label, round(CASE WHEN hd>=ld THEN swing_high-(swing_high-swing_low)*r ELSE swing_low+(swing_high-swing_low)*r END,4) AS level
 FROM v_dfib0, (VALUES ('23.6%',0.236::DOUBLE),('38.2%',0.382::DOUBLE),('50.0%',0.5::DOUBLE),('61.8%',0.618::DOUBLE)) t(label,r) WHERE swing_high<>swing_low""")
view("v_lv0", """SELECT symbol, list(price ORDER BY price DESC) FILTER (side='support') AS sup, list(price ORDER BY price) FILTER (side='resistance') AS res FROM v_sr WHERE timeframe='daily' GROUP BY 1""")
view("v_entry", """SELECT symbol, list({'kind':kind,'level':level} ORDER BY level DESC, o) AS z FROM (SELECT symbol, 'support' AS kind, unnest(sup[1:3]) AS level, 0 AS o FROM v_lv0
 UNION ALL SELECT symbol, 'vwap', vwap_anchored, 1 FROM v_dl WHERE vwap_anchored<current_price UNION ALL SELECT symbol, 'fib_'||label, level, 2 FROM v_dfib JOIN v_dl USING (symbol) WHERE label IN ('38.2%','50.0%','61.8%') AND level<current_price) GROUP BY 1""")
view("v_exit", """SELECT symbol, list({'kind':kind,'level':level} ORDER BY level, o) AS z FROM (SELECT symbol, 'resistance' AS kind, unnest(res[1:3]) AS level, 0 AS o FROM v_lv0
 UNION ALL SELECT symbol, 'fib_'||label, level, 2 FROM v_dfib JOIN v_dl USING (symbol) WHERE label IN ('23.6%','38.2%') AND level>current_price) GROUP BY 1""")
view("v_lv1", """SELECT d.symbol, current_price AS p, e.z AS ez, x.z AS xz, sup, res, round(current_price-2*atr_14,4) AS ast, sup[1] AS sw FROM v_dl d LEFT JOIN v_lv0 l USING (symbol) LEFT JOIN v_entry e USING (symbol) LEFT JOIN v_exit x USING (symbol)""")
view("v_lv", """SELECT *, CASE WHEN ast IS NOT NULL AND (sw IS NULL OR ast>sw*0.98::DOUBLE) THEN ast ELSE sw END AS stop, CASE WHEN ast IS NOT NULL AND (sw IS NULL OR ast>sw*0.98::DOUBLE) THEN '2x ATR below price (tighter of structure/ATR)'
 WHEN sw IS NOT NULL THEN 'nearest confirmed support' END AS basis FROM v_lv1""")
_ZT = "coalesce(array_to_string(list_transform({z}, lambda q: q.kind||'@'||CAST(q.level AS VARCHAR)),'; '),'')"
view("v_levelrow", f"""SELECT symbol, p AS reference_price, {_ZT.format(z='ez')} AS entry_zones, {_ZT.format(z='xz')} AS exit_zones, stop AS stop_level, basis AS stop_basis, res[1] AS tp1, res[2] AS tp2, res[3] AS tp3,
 CASE WHEN p>stop THEN round((res[1]-p)/(p-stop),2) END AS risk_reward_to_tp1, sup[-1] AS invalidation_level FROM v_lv""")


def _levels(v, last=None):
    return SG.levels(SG.daily(last if last is not None else _last(v)), _sr_daily(v), _fib_daily(v))


@query("levels_engine", "SELECT * FROM v_levelrow")
def levels_engine(v):
    return _levels(v).withColumns({"entry_zones": SG.zone_text("entry_zones"), "exit_zones": SG.zone_text("exit_zones")})


view("v_fac", "SELECT symbol, list(signal ORDER BY position) FILTER (bias='bullish') AS fb, list(signal ORDER BY position) FILTER (bias='bearish') AS fs, list(signal ORDER BY position) FILTER (bias='neutral') AS fn FROM v_sig GROUP BY 1")
view("v_sc0", """SELECT v_lv.*, c.*, f.*, list_transform(list_filter(ez, lambda q: q.kind='support'), lambda q: CAST(q.level AS VARCHAR)) AS ss, list_transform(list_filter(xz, lambda q: q.kind='resistance'), lambda q: CAST(q.level AS VARCHAR)) AS rr
 FROM v_lv JOIN v_conf c USING (symbol) JOIN v_fac f USING (symbol)""")


@query("scenarios", """SELECT symbol, 'bullish' AS scenario, coalesce('close above resistance '||rr[1],'sustained closes above current range high') AS trigger, coalesce(array_to_string(list_transform(res[1:3], lambda q: CAST(q AS VARCHAR)),', '),'') AS targets,
  CAST(sup[-1] AS VARCHAR) AS invalidation, coalesce(array_to_string(fb[1:4],', '),'') AS supporting_factors, 'bullish signals '||bullish||' of '||total_signals AS weighting_hint FROM v_sc0
 UNION ALL SELECT symbol, 'bearish', coalesce('close below support '||ss[1],'loss of the current range low'), coalesce(array_to_string(ss[1:3],', '),''), rr[1], coalesce(array_to_string(fs[1:4],', '),''), 'bearish signals '||bearish||' of '||total_signals FROM v_sc0
 UNION ALL SELECT symbol, 'neutral', 'hold inside support/resistance band', concat_ws(', ', ss[1], rr[1]), 'break of either band edge', coalesce(array_to_string(fn[1:4],', '),''), overall FROM v_sc0""")
def scenarios(v):
    last = _last(v)
    sig = SG.signals(SG.daily(last))
    return SG.scenarios(_levels(v, last), SG.confluence(sig), sig)


_SYM = "CASE {k}%6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END"
view("v_earn", f"SELECT {_SYM.format(k='o_orderkey')} AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey AS ord, round(o_totalprice/1000,2) AS eps_estimate, CASE WHEN o_orderstatus='F' THEN round(o_totalprice/900,2) END AS eps_reported FROM orders")
view("v_upcoming", f"""SELECT symbol, date, eps_estimate, eps_reported, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date, ord) AS INT) AS rank FROM v_earn WHERE date>=DATE '{AS_OF}' QUALIFY rank<=4""")
view("v_ann", f"""SELECT {_SYM.format(k='doc_id')} AS symbol, doc_id AS ord, published_at, CASE WHEN doc_id%7<>0 THEN title END AS title, strftime(published_at,'%Y-%m-%d') AS date FROM v_news""")


@query("earnings_upcoming", "SELECT * FROM v_upcoming")
def earnings_upcoming(v):
    return SG.earnings_upcoming(v.earnings, AS_OF)


@query("catalysts", """SELECT symbol, strftime(date,'%Y-%m-%d') AS date, 'Earnings date' AS title, 'earnings' AS kind FROM v_upcoming UNION ALL
 SELECT symbol, date, title, 'announcement' FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, ord) AS r FROM v_ann) WHERE r<=8 AND title IS NOT NULL""")
def catalysts(v):
    return SG.catalysts(v.announcements, SG.earnings_upcoming(v.earnings, AS_OF))


view("v_hv", "SELECT symbol, round(stddev_samp(lr) FILTER (rd<=20)*sqrt(252)*100,4) AS hv20 FROM v_ret1 WHERE n>60 GROUP BY 1")
view("v_ret1", "SELECT symbol, rn, n, n-rn+1 AS rd, ln(close/lag(close) OVER (PARTITION BY symbol ORDER BY rn)) AS lr FROM v_1y")
view("v_div", "SELECT symbol, 'bearish_regular' AS type, 'price_high' AS anchor FROM v_lprsi WHERE timeframe='daily' AND h1_c>h2_c AND h1_r<h2_r UNION ALL SELECT symbol, 'bullish_regular', 'price_low' FROM v_lprsi WHERE timeframe='daily' AND l1_c<l2_c AND l1_r>l2_r")
view("v_bench", "SELECT symbol FROM v_1y JOIN v_market_index USING (date) GROUP BY symbol HAVING count(*)>=60")
view("v_risk0", """SELECT d.*, classification, overall, hv20, b.symbol IS NOT NULL AS bench, list_transform(coalesce((SELECT list({'a':anchor,'t':type} ORDER BY anchor) FROM v_div x WHERE x.symbol=d.symbol),[]), lambda q: q.t||' divergence against current trend at '||q.a) AS divs,
 (current_price/high_52w-1)*100 AS dd FROM v_dl d LEFT JOIN (SELECT symbol, classification FROM v_ms WHERE timeframe='daily') USING (symbol) LEFT JOIN v_conf USING (symbol) LEFT JOIN v_hv USING (symbol) LEFT JOIN v_bench b ON b.symbol=d.symbol""")
view("v_risk1", """SELECT symbol, list_concat(list_concat(list_filter([CASE WHEN adx_14<20 THEN 'ADX below 20: range regime — trend-following signals less reliable' END,
 CASE WHEN hv20>60 THEN '20d realized volatility '||CAST(hv20 AS VARCHAR)||'%: elevated — size positions accordingly' END, CASE WHEN dd < -20 THEN CAST(round(dd,1) AS VARCHAR)||'% below the 52-week high: deep drawdown' END,
 CASE WHEN gdc='death-cross regime' THEN 'SMA50 below SMA200: death-cross regime' END, CASE WHEN current_price<sma_200 THEN 'price below SMA200: long-term trend filter is bearish' END,
 CASE WHEN change_pct_1y < -20 THEN '1y change '||CAST(change_pct_1y AS VARCHAR)||'%: significant capital loss over the last year' END,
 CASE WHEN classification LIKE 'uptrend%' AND overall IN ('bearish','mixed') THEN 'pivot structure says uptrend while indicator confluence is '||overall||' — treat the structure label as low confidence' END], lambda q: q IS NOT NULL), divs),
 CASE WHEN NOT bench THEN ['relative strength could not be computed — benchmark feed unavailable'] ELSE [] END) AS f FROM v_risk0""")
view("v_risk", "SELECT symbol, CAST(i-1 AS INT) AS position, ff[i] AS flag FROM (SELECT symbol, ff, unnest(range(1,len(ff)+1)) AS i FROM (SELECT symbol, CASE WHEN len(f)>0 THEN f ELSE ['no quantitative risk flags triggered'] END AS ff FROM v_risk1))")


def _tf(df, name):
    return df.filter(F.col("timeframe") == name).drop("timeframe")


def _risk(v, last):
    fr = frames(v)
    sig = SG.signals(SG.daily(last))
    year = B.recent_years(v.bars, 1)
    return SG.risk_flags(SG.daily(last), _tf(ST.market_structure(fr), "daily"), SG.confluence(sig), _tf(ST.divergence(fr), "daily"),
                         I.hv20_hv60(year), I.rs_line(year, v.market_index))


@query("risk_flags", "SELECT * FROM v_risk")
def risk_flags(v):
    return _risk(v, _last(v))


view("v_td0", """SELECT d.*, w.classification AS wk, m.classification, m.confidence, overall, CASE WHEN m.classification LIKE 'uptrend%' THEN 'bullish' WHEN m.classification LIKE 'downtrend%' THEN 'bearish' ELSE m.classification END AS sd
 FROM v_dl d JOIN (SELECT * FROM v_ms WHERE timeframe='daily') m ON m.symbol=d.symbol JOIN v_conf c ON c.symbol=d.symbol JOIN (SELECT * FROM v_ms WHERE timeframe='weekly') w ON w.symbol=d.symbol""")
view("v_td", "SELECT *, CASE WHEN sd IN ('bullish','bearish') AND overall IN ('bullish','bearish') THEN sd=overall END AS agree FROM v_td0")


@query("trend_dimensions", """SELECT symbol, sd AS structural_direction, confidence, overall AS momentum, CASE WHEN adx_14>20 THEN CASE WHEN plus_di_14>minus_di_14 THEN 'bullish' ELSE 'bearish' END ELSE 'unreliable (ADX<=20)' END AS di_direction,
 round((current_price/sma_200-1)*100,2) AS price_vs_sma200_pct, agree AS agreement, wk AS weekly_structure, CASE WHEN NOT agree THEN 'structural '||sd||' ('||confidence||' confidence) conflicts with '||overall||' current momentum — weekly structure: '||wk
 WHEN agree THEN 'structural and current trend aligned: '||overall ELSE 'current momentum '||overall||'; structure '||sd END AS trend_headline FROM v_td""")
def trend_dimensions(v):
    last = _last(v)
    ms = ST.market_structure(frames(v))
    return SG.trend_dimensions(SG.daily(last), _tf(ms, "daily"), _tf(ms, "weekly"), SG.confluence(SG.signals(SG.daily(last))))


_DASH = [c for c in SG.DASHBOARD if c != "golden_death_cross_state"]


@query("indicator_dashboard", f"""SELECT {K}, indicator, value FROM (UNPIVOT (SELECT {K}, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _DASH)}, gdc AS golden_death_cross_state FROM v_rl)
 ON {', '.join(SG.DASHBOARD)} INTO NAME indicator VALUE value) WHERE value IS NOT NULL""")
def indicator_dashboard(v):
    return SG.dashboard(_last(v))


@query("setups", """SELECT l.symbol, CASE l.timeframe WHEN 'daily' THEN 'short_term_setup' WHEN 'weekly' THEN 'medium_term_setup' ELSE 'long_term_structure' END AS setup, l.timeframe AS basis_timeframe,
 CASE WHEN l.timeframe='daily' THEN t.state END AS state, CASE WHEN l.timeframe='daily' THEN v.xz[1].level END AS nearest_resistance, CASE WHEN l.timeframe='daily' THEN v.ez[1].level END AS nearest_support,
 CASE WHEN l.timeframe<>'daily' THEN rsi_14 END AS rsi_14, CASE WHEN l.timeframe<>'daily' THEN sma_20 END AS sma_20, CASE WHEN l.timeframe<>'daily' THEN sma_50 END AS sma_50,
 CASE WHEN l.timeframe<>'daily' THEN m.classification END AS structure, CASE WHEN l.timeframe<>'daily' THEN m.confidence END AS structure_confidence
 FROM v_rl l JOIN v_ms m ON m.symbol=l.symbol AND m.timeframe=l.timeframe JOIN v_mtf t ON t.symbol=l.symbol AND t.timeframe=l.timeframe JOIN v_lv v ON v.symbol=l.symbol""")
def setups(v):
    last = _last(v)
    return SG.setups(last, ST.market_structure(frames(v)), _levels(v, last), SG.mtf_matrix(last))
