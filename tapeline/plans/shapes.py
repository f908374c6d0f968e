"""Price-structure queries over the daily, weekly and monthly frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import rolling as R
from tapeline.operators import bars as B
from tapeline.operators import structure as ST
from tapeline.plans.checks import view
from tapeline.plans.price import indicator_views
from tapeline.registry import _QUERIES, query
from tapeline.session import cut_partitioned

K = "symbol, timeframe"
KEYS = ("symbol", "timeframe")
WF = f"PARTITION BY {K} ORDER BY rn"


def frames(v):
    return R.number_rows(B.report_frames(v.bars), KEYS)


def pivot_sql(src, left, right, cols="date, high, low, close, volume, open"):
    return f"""SELECT {K}, rn, n, {cols}, rn>{left} AND rn<=n-{right} AND high=max(high) OVER x AND high>lag(high) OVER o AS ph, rn>{left} AND rn<=n-{right} AND low=min(low) OVER x AND low<lag(low) OVER o AS pl
 FROM {src} WINDOW x AS ({WF} ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING), o AS ({WF})"""


view("v_piv", pivot_sql("v_frn", 3, 3))


@query("pivots", f"SELECT {K}, date, coalesce(ph,false) AS pivot_high, coalesce(pl,false) AS pivot_low FROM v_piv")
def pivots(v):
    d = ST.find_pivots(frames(v))
    return d.select(*KEYS, "date", F.coalesce("pivot_high", F.lit(False)).alias("pivot_high"), F.coalesce("pivot_low", F.lit(False)).alias("pivot_low"))


view("v_pvals", f"SELECT {K}, list_sort(list(p)) AS ps FROM (SELECT {K}, high AS p FROM v_piv WHERE ph UNION ALL SELECT {K}, low FROM v_piv WHERE pl) GROUP BY ALL")
# every element is a one-level list; the fold joins a level within the tolerance or appends a new one
_NEAR = "list_position(list_transform(acc, lambda l: abs(x[1].price-l.price)/l.price<=0.015::DOUBLE), true)"
view("v_fold", f"""SELECT {K}, list_reduce(list_transform(ps, lambda p: [{{'price':CASE WHEN true THEN p END,'touches':CAST(1 AS BIGINT)}}]), lambda acc, x: CASE WHEN coalesce({_NEAR},0)=0
 THEN list_concat(acc, [{{'price':round(x[1].price,4),'touches':CAST(1 AS BIGINT)}}])
 ELSE list_transform(acc, lambda l, i: CASE WHEN i={_NEAR} THEN {{'price':round((l.price*l.touches+x[1].price)/(l.touches+1),4),'touches':l.touches+1}} ELSE l END) END) AS lv FROM v_pvals""")
view("v_levels", f"SELECT {K}, CAST(p-1 AS INT) AS position, lv[p].price AS price, lv[p].touches AS touches FROM (SELECT {K}, lv, unnest(range(1, len(lv)+1)) AS p FROM v_fold)")


@query("cluster_levels", f"SELECT {K}, position, price, touches FROM v_levels")
def cluster_levels(v):
    return ST.cluster_levels(ST.pivot_rows(frames(v)))


view("v_fclose", f"SELECT {K}, close AS last_close FROM v_frn WHERE rd=1")
view("v_sr", f"""SELECT {K}, side, price, touches FROM (SELECT *, CASE WHEN price<last_close THEN 'support' ELSE 'resistance' END AS side FROM v_levels JOIN v_fclose USING ({K}))
 QUALIFY row_number() OVER (PARTITION BY {K}, side ORDER BY touches DESC, position)<=8""")


@query("support_resistance", f"SELECT {K}, side, price, touches FROM v_sr")
def support_resistance(v):
    return ST.support_resistance(frames(v))


view("v_f90", f"""SELECT {K}, date, open, high, low, close, volume, row_number() OVER (PARTITION BY {K} ORDER BY date) AS rn, count(*) OVER (PARTITION BY {K}) AS n FROM v_frn WHERE rd<=90""")
view("v_p90", pivot_sql("v_f90", 5, 5))
view("v_z0", f"""SELECT *, max(close) OVER a/low-1 AS up, 1-min(close) OVER a/high AS dn, CAST(sum(volume) OVER a AS BIGINT) AS vol, last_value(close) OVER a AS lc FROM v_p90 WHERE n>=20 WINDOW a AS ({WF} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
view("v_z1", f"""SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY strength DESC, k, rn) AS rank FROM (SELECT {K}, rn, low, high, vol, lc, 'demand' AS kind, 0 AS k, up AS strength FROM v_z0 WHERE pl AND up>0.03
 UNION ALL SELECT {K}, rn, low, high, vol, lc, 'supply', 1, dn FROM v_z0 WHERE ph AND dn>0.03)""")
view("v_z2", f"""SELECT *, low AS zl, low+least(greatest(high-low, low*0.02::DOUBLE), lc*0.06::DOUBLE) AS zh FROM v_z1 WHERE rank<=12""")
view("v_z3", f"""SELECT {K}, list([{{'rank':rank,'kind':kind,'zl':zl,'zh':zh,'s':strength,'vol':vol}}] ORDER BY rank) AS zs FROM v_z2
 WHERE CASE WHEN kind='demand' THEN zh<=lc*1.001::DOUBLE ELSE zl>=lc*0.999::DOUBLE END GROUP BY ALL""")
view("v_z4", f"""SELECT {K}, unnest(list_reduce(zs, lambda acc, x: CASE WHEN len(acc)<4 AND len(list_filter(acc, lambda q: q.kind=x[1].kind AND x[1].zl<q.zh AND x[1].zh>q.zl))=0 THEN list_concat(acc,x) ELSE acc END)) AS z FROM v_z3""")


@query("supply_demand_zones", f"""SELECT {K}, CAST(z.rank AS INT) AS rank, z.kind AS kind, round(z.zl,4) AS zone_low, round(z.zh,4) AS zone_high, round(z.s*100,2) AS strength_pct, z.vol AS volume_in_zone FROM v_z4""")
def supply_demand_zones(v):
    return ST.supply_demand_zones(frames(v))


def lastpiv(src, keep, extra=()):
    """SQL of last pivots per frame: h1.. and l1.. with optional extra columns."""
    aggs = []
    for s, price in (("h", "high"), ("l", "low")):
        for i in range(1, keep + 1):
            aggs.append(f"max({price}) FILTER ({s}r={i}) AS {s}{i}")
            aggs += [f"max({c}) FILTER ({s}r={i}) AS {s}{i}_{a}" for a, c in extra]
    return f"""SELECT {K}, count(*) FILTER (ph) AS nh, count(*) FILTER (pl) AS nl, {', '.join(aggs)} FROM
 (SELECT *, CASE WHEN ph THEN row_number() OVER (PARTITION BY {K}, ph ORDER BY rn DESC) END AS hr, CASE WHEN pl THEN row_number() OVER (PARTITION BY {K}, pl ORDER BY rn DESC) END AS lr FROM {src}) GROUP BY {K}"""


view("v_lp2", lastpiv("v_piv", 2))
view("v_flast", f"SELECT {K}, max(n) AS n, max(close) FILTER (rd=1) AS c, avg(close) FILTER (rd<=200) AS s200 FROM v_frn GROUP BY ALL")
view("v_ms0", f"""SELECT *, CASE WHEN nh<2 OR nl<2 THEN 'insufficient_data' WHEN h1>h2 AND l1>l2 THEN 'uptrend (higher highs & higher lows)' WHEN NOT h1>h2 AND NOT l1>l2 THEN 'downtrend (lower highs & lower lows)'
 ELSE 'range / transition (mixed pivots)' END AS classification, CASE WHEN nh>=2 AND nl>=2 AND n>=200 THEN c<s200 END AS below FROM v_lp2 JOIN v_flast USING ({K})""")
view("v_ms", f"""SELECT {K}, classification, CASE WHEN (classification LIKE 'uptrend%' AND coalesce(below,false)) OR (classification LIKE 'downtrend%' AND coalesce(NOT below,false)) OR nh<3 OR nl<3 THEN 'low' ELSE 'high' END AS confidence,
 nh AS pivot_highs, nl AS pivot_lows, CASE WHEN below THEN 'below' WHEN NOT below THEN 'above' END AS price_vs_sma200,
 CASE WHEN nh>=2 AND nl>=2 THEN round(h2,4) END AS high_prev, CASE WHEN nh>=2 AND nl>=2 THEN round(h1,4) END AS high_last, CASE WHEN nh>=2 AND nl>=2 THEN round(l2,4) END AS low_prev, CASE WHEN nh>=2 AND nl>=2 THEN round(l1,4) END AS low_last FROM v_ms0""")


@query("market_structure", "SELECT * FROM v_ms")
def market_structure(v):
    return ST.market_structure(frames(v))


# the wide indicator row of the report frames

LAST = indicator_views("r", "v_frames")
view("v_tr0", f"SELECT {K}, n, adx, (s20/s20p-1)*100 AS slope FROM v_rind WHERE rd=1")
view("v_tr", f"""SELECT *, CASE WHEN n<40 OR adx IS NULL THEN 'insufficient_data' WHEN adx>=20 AND abs(slope)>0.1::DOUBLE THEN CASE WHEN slope>0 THEN 'trending up' ELSE 'trending down' END ELSE 'ranging' END AS regime FROM v_tr0""")


@query("trend_regime", f"""SELECT {K}, regime, CASE WHEN n>=40 THEN round(adx,2) END AS adx, CASE WHEN n>=40 THEN round(slope,3) END AS sma20_slope_pct,
 CASE WHEN n>=40 AND adx IS NULL THEN 'insufficient bars for ADX' WHEN regime LIKE 'trending%' THEN format('ADX {{:.1f}} >= 20 (strength) + SMA20 slope {{:+.2f}}% (direction)', adx, slope)
 WHEN regime='ranging' THEN format('ADX {{:.1f}} < 20 or flat SMA20 slope — no confirmed trend', adx) END AS basis FROM v_tr""")
def trend_regime(v):
    return ST.trend_regime(frames(v))


def candle_sql(src):
    lag = lambda c, i: c if i == 0 else f"lag({c},{i}) OVER o"
    b, r = (lambda i: lag("body", i)), (lambda i: lag("rng", i))
    star = f"{b(2)}>0.7::DOUBLE*{r(2)} AND {b(1)}<0.3::DOUBLE*{r(1)}"
    solid = " AND ".join(f"{b(i)}>0.3::DOUBLE*{r(i)}" for i in range(3))
    rules = {
        "bullish_engulfing": f"bull AND {lag('bear',1)} AND close>{lag('open',1)} AND open<{lag('close',1)} AND body>{b(1)}",
        "bearish_engulfing": f"bear AND {lag('bull',1)} AND close<{lag('open',1)} AND open>{lag('close',1)} AND body>{b(1)}",
        "hammer": "lw>2*body AND uw<body AND (close-low)/rng>=0.6::DOUBLE", "shooting_star": "uw>2*body AND lw<body AND (close-low)/rng<=0.4::DOUBLE", "doji": "body<=0.1::DOUBLE*rng",
        "morning_star": f"{star} AND {lag('bull',2)} AND {lag('open',1)}<{lag('close',2)} AND close>({lag('open',2)}+{lag('close',2)})/2",
        "evening_star": f"{star} AND {lag('bear',2)} AND {lag('open',1)}>{lag('close',2)} AND close<({lag('open',2)}+{lag('close',2)})/2",
        "three_white_soldiers": f"rn>3 AND bull AND {lag('bull',1)} AND {lag('bull',2)} AND {solid} AND close>{lag('close',1)} AND {lag('close',1)}>{lag('close',2)}",
        "three_black_crows": f"rn>3 AND bear AND {lag('bear',1)} AND {lag('bear',2)} AND {solid} AND close<{lag('close',1)} AND {lag('close',1)}<{lag('close',2)}",
    }
    sel = ", ".join(f"rn>2 AND coalesce({e},false) AS {n}" for n, e in rules.items())
    return f"""SELECT {K}, date, rn, n, {sel} FROM (SELECT *, abs(close-open) AS body, CASE WHEN high<>low THEN high-low END AS rng, close>open AS bull, close<open AS bear, high-greatest(open,close) AS uw, least(open,close)-low AS lw FROM
 (SELECT {K}, date, open, high, low, close, row_number() OVER (PARTITION BY {K} ORDER BY date) AS rn, count(*) OVER (PARTITION BY {K}) AS n FROM {src})) WINDOW o AS ({WF})"""


view("v_candle", candle_sql("(SELECT * FROM v_frn WHERE rd<=13)"))
view("v_candleall", candle_sql("v_frn"))
_CNAMES = {
    "a": "bullish_engulfing", "b": "bearish_engulfing", "c": "hammer", "d": "shooting_star", "e": "doji",
    "f": "morning_star", "g": "evening_star", "h": "three_white_soldiers", "i": "three_black_crows",
}


def _candle(letter, name):
    @query(f"candle_{name}", f"SELECT {K}, date FROM v_candleall WHERE {name}")
    def build(v):
        return ST.candle_flags(frames(v), None).filter(name).select(*KEYS, "date")


for _l, _n in _CNAMES.items():
    _candle(_l, _n)

_first = ", ".join(
    f"CASE WHEN {p} AND NOT coalesce(lag({p}) OVER o,false) THEN '{p}' END" if p in ST.STREAK_CANDLES else f"CASE WHEN {p} THEN '{p}' END" for p in ST.CANDLES)
view("v_chits", f"SELECT * FROM (SELECT {K}, date, n-rn AS bar_offset_from_end, unnest([{_first}]) AS pattern FROM v_candle WINDOW o AS ({WF})) WHERE pattern IS NOT NULL")


@query("candle_dedupe", f"SELECT {K}, date, bar_offset_from_end, pattern FROM v_chits")
def candle_dedupe(v):
    return ST.candle_hits(frames(v))


_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("candle_tally", f"""SELECT f.symbol, f.timeframe, count(*) FILTER (pattern IN {_in(ST.BULLISH_CANDLES)}) AS bullish_count, count(*) FILTER (pattern IN {_in(ST.BEARISH_CANDLES)}) AS bearish_count
 FROM (SELECT DISTINCT {K} FROM v_frn) f LEFT JOIN v_chits h ON f.symbol=h.symbol AND f.timeframe=h.timeframe GROUP BY 1,2""")
def candle_tally(v):
    return ST.candle_tally(frames(v))


view("v_f60", f"""SELECT * FROM (SELECT {K}, date, open, high, low, close, volume, rd, row_number() OVER (PARTITION BY {K} ORDER BY date) AS rn, count(*) OVER (PARTITION BY {K}) AS n FROM v_frn WHERE rd<=60) WHERE n>=30""")
view("v_p60", pivot_sql("v_f60", 3, 3))
view("v_lp60", lastpiv("v_p60", 3))


@query("double_top_bottom", f"SELECT {K}, coalesce(abs(h1-h2)/h2<=0.02::DOUBLE,false) AS double_top, coalesce(abs(l1-l2)/l2<=0.02::DOUBLE,false) AS double_bottom FROM v_lp60")
def double_top_bottom(v):
    return ST.double_top_bottom(frames(v))


@query("head_shoulders", f"""SELECT {K}, coalesce(h3>h2*1.01::DOUBLE AND abs(h2-h1)/h2<=0.02::DOUBLE,false) AS head_and_shoulders, coalesce(l3<l2*0.99::DOUBLE AND abs(l2-l1)/l2<=0.02::DOUBLE,false) AS inverse_head_and_shoulders FROM v_lp60""")
def head_shoulders(v):
    return ST.head_shoulders(frames(v))


view("v_rng", f"""SELECT {K}, max(close) FILTER (rd=1) AS c, max(high) FILTER (rd>1) AS hi, min(low) FILTER (rd>1) AS lo, max(volume) FILTER (rd=1) AS lv, avg(volume) FILTER (rd BETWEEN 2 AND 21) AS av,
 regr_slope(close, rn) AS slope, CASE WHEN var_pop(close)=0 THEN 0 ELSE regr_r2(close, rn) END AS r2 FROM v_f60 GROUP BY ALL""")


@query("breakout", f"""SELECT {K}, CASE WHEN c>hi THEN 'breakout' ELSE 'breakdown' END AS type, round(CASE WHEN c>hi THEN hi ELSE lo END,4) AS level, lv>1.5::DOUBLE*av AS volume_confirmed FROM v_rng WHERE c>hi OR c<lo""")
def breakout(v):
    return ST.breakout(frames(v))


view("v_trange", f"""SELECT {K}, count(*) FILTER (high>=hi*0.99::DOUBLE) AS near_high, count(*) FILTER (low<=lo*1.01::DOUBLE) AS near_low, any_value((hi-lo)/lo<0.15::DOUBLE) AS tight FROM v_f60 JOIN v_rng USING ({K}) WHERE rd>1 GROUP BY ALL""")


@query("trading_range", f"SELECT {K}, near_high, near_low, tight AND near_high>=2 AND near_low>=2 AS trading_range FROM v_trange")
def trading_range(v):
    return ST.trading_range(frames(v))


@query("linreg_channel", f"SELECT {K}, round(slope,6) AS slope, round(r2,6) AS r2 FROM v_rng")
def linreg_channel(v):
    return ST.channel(frames(v)).select(*KEYS, "slope", "r2")


_CH = "CASE WHEN r2>=0.7::DOUBLE THEN CASE WHEN slope>0 THEN 'rising_channel' ELSE 'falling_channel' END END"


@query("channel", f"SELECT {K}, round(slope,6) AS slope, round(r2,6) AS r2, {_CH} AS channel FROM v_rng")
def channel(v):
    return ST.channel(frames(v))


view("v_pr60", f"""SELECT *, CAST(row_number() OVER (PARTITION BY {K}, side ORDER BY rn) AS DOUBLE) AS x FROM (SELECT {K}, rn, 'high' AS side, high AS price FROM v_p60 WHERE ph UNION ALL SELECT {K}, rn, 'low', low FROM v_p60 WHERE pl)""")
view("v_tri", f"""SELECT {K}, CASE WHEN nh>=3 AND nl>=3 AND ls>0 AND hs<ls THEN 'ascending_triangle' WHEN nh>=3 AND nl>=3 AND hs<0 AND ls>hs THEN 'descending_triangle' END AS triangle FROM (SELECT {K}, count(*) FILTER (side='high') AS nh, count(*) FILTER (side='low') AS nl,
 regr_slope(price,x) FILTER (side='high') AS hs, regr_slope(price,x) FILTER (side='low') AS ls FROM v_pr60 GROUP BY ALL)""")


@query("triangle", f"SELECT {K}, triangle FROM v_tri")
def triangle(v):
    return ST.triangle(frames(v))


@query("chart_patterns", f"""SELECT {K}, pattern FROM (SELECT {K}, unnest([CASE WHEN abs(h1-h2)/h2<=0.02::DOUBLE THEN 'possible_double_top' END, CASE WHEN abs(l1-l2)/l2<=0.02::DOUBLE THEN 'possible_double_bottom' END,
 CASE WHEN h3>h2*1.01::DOUBLE AND abs(h2-h1)/h2<=0.02::DOUBLE THEN 'possible_head_and_shoulders' END, CASE WHEN l3<l2*0.99::DOUBLE AND abs(l2-l1)/l2<=0.02::DOUBLE THEN 'possible_inverse_head_and_shoulders' END,
 CASE WHEN tight AND near_high>=2 AND near_low>=2 THEN 'trading_range' END, {_CH}, triangle]) AS pattern FROM v_lp60 JOIN v_rng USING ({K}) JOIN v_trange USING ({K}) LEFT JOIN v_tri USING ({K})) WHERE pattern IS NOT NULL""")
def chart_patterns(v):
    return ST.chart_patterns(frames(v))


view("v_gap", f"""SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY rn DESC) AS rank FROM (SELECT *, lag(close) OVER ({WF}) AS pc FROM v_frn) WHERE open>pc*1.005::DOUBLE OR open<pc*0.995::DOUBLE""")
_GAP = f"""SELECT {K}, CAST(rank AS INT) AS rank, date, CASE WHEN open>pc THEN 'gap_up' ELSE 'gap_down' END AS type, round(pc,4) AS gap_low, round(open,4) AS gap_high, round((open/pc-1)*100,2) AS gap_pct,
 EXISTS (SELECT 1 FROM v_frn b WHERE b.symbol=g.symbol AND b.timeframe=g.timeframe AND b.rn>g.rn AND b.low<=g.pc AND b.high>=g.open) AS filled FROM v_gap g WHERE rank<=5"""


@query("gaps", _GAP)
def gaps(v):
    return ST.gaps(frames(v))


@query("gap_fill_lookup", f"SELECT {K}, rank, date FROM ({_GAP}) WHERE filled")
def gap_fill_lookup(v):
    return ST.gaps(frames(v)).filter("filled").select(*KEYS, "rank", "date")


view("v_vp0", f"""SELECT *, min(low) OVER (PARTITION BY {K}) AS lo_, max(high) OVER (PARTITION BY {K}) AS hi_ FROM v_frn WHERE rd<=120 AND n>=20""")
view("v_vp1", f"""SELECT *, list_append(list_transform(range(0,24), lambda i: CAST(i AS DOUBLE)*((hi_-lo_)/24)+lo_), hi_) AS edges FROM v_vp0 WHERE hi_>lo_""")
view("v_vp2", """SELECT *, least(greatest(len(list_filter(edges, lambda e: e<=low))-1,0),23) AS f, least(greatest(len(list_filter(edges, lambda e: e<high))-1,0),23) AS l FROM v_vp1""")
view("v_vp3", f"SELECT {K}, bin, sum(v) AS v FROM (SELECT {K}, volume/(l-f+1) AS v, unnest(range(f,l+1)) AS bin FROM v_vp2 WHERE volume<>0 AND l>=f) GROUP BY ALL")
view("v_vp", f"""SELECT a.symbol, a.timeframe, a.bin, edges[a.bin+1] AS lo, edges[a.bin+2] AS hi, coalesce(v,0) AS volume FROM (SELECT {K}, edges, unnest(range(0,24)) AS bin FROM (SELECT DISTINCT {K}, edges FROM v_vp2)) a
 LEFT JOIN v_vp3 b ON a.symbol=b.symbol AND a.timeframe=b.timeframe AND a.bin=b.bin""")


@query("volume_profile", f"SELECT {K}, CAST(bin AS INT) AS bin, round(lo,6) AS price_low, round(hi,6) AS price_high, round(volume,4) AS volume FROM v_vp")
def volume_profile(v):
    d = ST.volume_profile(frames(v))
    return d.select(*KEYS, "bin", F.round("lo", 6).alias("price_low"), F.round("hi", 6).alias("price_high"), F.round("volume", 4).alias("volume"))


view("v_va0", f"""SELECT {K}, list(volume ORDER BY bin) AS v, list(lo ORDER BY bin) AS los, list(hi ORDER BY bin) AS his FROM v_vp GROUP BY ALL""")
view("v_va1", "SELECT *, list_sum(v) AS total, list_position(v, list_max(v)) AS poc FROM v_va0")
view("v_rec_va", f"""SELECT {K}, 0 AS step, poc AS lo, poc AS hi, v[poc] AS cov, v, total FROM v_va1 UNION ALL
 SELECT {K}, step+1, CASE WHEN up THEN lo ELSE lo-1 END, CASE WHEN up THEN hi+1 ELSE hi END, cov+CASE WHEN up THEN v[hi+1] ELSE v[lo-1] END, v, total FROM
 (SELECT *, CASE WHEN hi<24 THEN v[hi+1] ELSE -1 END >= CASE WHEN lo>1 THEN v[lo-1] ELSE -1 END AS up FROM v_rec_va) WHERE cov<0.7::DOUBLE*total AND (lo>1 OR hi<24)""")


@query("value_area", f"""SELECT a.symbol, a.timeframe, round((los[poc]+his[poc])/2,4) AS poc, round((los[r.lo]+his[r.lo])/2,4) AS value_area_low, round((los[r.hi]+his[r.hi])/2,4) AS value_area_high
 FROM v_va1 a JOIN (SELECT * FROM v_rec_va QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY step DESC)=1) r ON a.symbol=r.symbol AND a.timeframe=r.timeframe""")
def value_area(v):
    return ST.value_area(ST.volume_profile(frames(v)))


view("v_pivrsi", f"SELECT p.*, r.rsi FROM v_piv p JOIN v_rdx r ON p.symbol=r.symbol AND p.timeframe=r.timeframe AND p.rn=r.rn WHERE p.n>=40")
view("v_lprsi", lastpiv("v_pivrsi", 2, (("c", "close"), ("r", "rsi"))))


@query("divergence", f"""SELECT {K}, 'bearish_regular' AS type, 'price_high' AS anchor FROM v_lprsi WHERE h1_c>h2_c AND h1_r<h2_r UNION ALL SELECT {K}, 'bullish_regular', 'price_low' FROM v_lprsi WHERE l1_c<l2_c AND l1_r>l2_r""")
def divergence(v):
    return ST.divergence(frames(v))


view("v_1y", """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM
 (SELECT b.* FROM v_bars b JOIN (SELECT symbol, max(date) AS m FROM v_bars GROUP BY 1) x USING (symbol) WHERE date > CAST(m - INTERVAL 12 MONTH AS DATE))""")
view("v_path", """SELECT symbol, rn, n, date, list_transform(list(close) OVER p, lambda c: c/close-1) AS path, lead(close,40) OVER o/lead(close,20) OVER o-1 AS fwd, lead(date,19) OVER o AS end_date FROM v_1y
 WINDOW p AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), o AS (PARTITION BY symbol ORDER BY rn)""")
view("v_adist", """SELECT a.symbol, a.rn-1 AS start_idx, a.date AS start_date, a.end_date, sqrt(list_sum(list_transform(list_zip(a.path, b.path), lambda z: (z[1]-z[2])*(z[1]-z[2])))) AS distance, a.fwd*100 AS fwd
 FROM v_path a JOIN v_path b ON a.symbol=b.symbol AND b.rn=b.n-19 WHERE a.rn<=a.n-41 AND a.n>=120""")


def _year(v):
    return R.number_rows(B.recent_years(v.bars, 1))


@query("analogue_distances", "SELECT symbol, CAST(start_idx AS INT) AS start_idx, start_date, end_date, round(distance,5) AS distance, round(fwd,4) AS forward_20d_pct FROM v_adist")
def analogue_distances(v):
    d = ST.analogue_distances(_year(v))
    return d.select("symbol", "start_idx", "start_date", "end_date", F.round("distance", 5).alias("distance"), F.round("forward_20d_pct", 4).alias("forward_20d_pct"))


view("v_greedy", """SELECT symbol, list_reduce(list([{'d':distance,'s':start_idx,'a':start_date,'e':end_date,'f':fwd}] ORDER BY distance, start_idx),
 lambda acc, x: CASE WHEN len(acc)<6 AND len(list_filter(acc, lambda q: abs(q.s-x[1].s)<20))=0 THEN list_concat(acc,x) ELSE acc END) AS t FROM v_adist GROUP BY symbol""")
_GREEDY = "SELECT symbol, CAST(r AS INT) AS rank, CAST(t[r].s AS INT) AS start_idx, t[r].a AS start_date, t[r].e AS end_date, round(t[r].d,5) AS distance, round(t[r].f,4) AS forward_20d_pct FROM (SELECT symbol, t, unnest(range(1,len(t)+1)) AS r FROM v_greedy)"


@query("historical_analogues", _GREEDY)
def historical_analogues(v):
    return ST.historical_analogues(_year(v))


@query("greedy_topk_nonoverlap", f"SELECT symbol, rank, start_idx, distance FROM ({_GREEDY})")
def greedy_topk_nonoverlap(v):
    return ST.historical_analogues(_year(v)).select("symbol", "rank", "start_idx", "distance")


# topic -> the registered query whose SQL gives the topic's rows
_TOPICS = {t: t for t in ("support_resistance", "supply_demand_zones", "market_structure", "trend_regime", "chart_patterns", "breakout", "gaps", "value_area", "divergence")}
_TOPICS["candlesticks"] = "candle_dedupe"


def _dealt_frames(v):
    """All frames, dealt by symbol once for every topic."""
    return cut_partitioned(v.spark, frames(v), ["symbol"], [*KEYS, "rn"])


@query("structure_all", " UNION ALL BY NAME ".join(f"SELECT *, '{t}' AS topic FROM ({_QUERIES[name].sql})" for t, name in _TOPICS.items()))
def structure_all(v):
    """Every topic's typed rows, against the SQL of every topic."""
    return ST.structure_all(_dealt_frames(v))


@query("structure_topic_counts", " UNION ALL ".join(f"SELECT {K}, '{t}' AS topic, count(*) AS findings FROM ({_QUERIES[name].sql}) GROUP BY ALL" for t, name in _TOPICS.items()))
def structure_topic_counts(v):
    """Findings of each frame by topic, counted from the JSON rows."""
    found = ST.structure_json(ST.structure_all(_dealt_frames(v))).where("payload <> '{}'")
    return found.groupBy("symbol", "timeframe", "topic").agg(F.count("*").alias("findings"))


def frame_vwap(pdf):
    """Anchored VWAP of one frame in pandas, the independent form of the built-in one."""
    import pandas as pd

    tp = (pdf.high + pdf.low + pdf.close) / 3
    return pd.DataFrame({"symbol": [pdf.symbol.iloc[0]], "timeframe": [pdf.timeframe.iloc[0]], "vwap": [round(float((tp * pdf.volume).sum() / pdf.volume.sum()), 3)]})


@query("apply_frame", f"SELECT {K}, round(sum((high+low+close)/3*volume)/sum(volume),3) AS vwap FROM v_frn GROUP BY ALL")
def apply_frame(v):
    return B.apply_frame(B.report_frames(v.bars), frame_vwap, "symbol string, timeframe string, vwap double")
