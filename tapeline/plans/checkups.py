"""Profiles, request metrics and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import metrics as M
from tapeline.operators import quality as QL
from tapeline.operators import signals as SG
from tapeline.operators import structure as ST
from tapeline.plans.calls import _fib_daily, _last, _levels
from tapeline.plans.checks import view
from tapeline.plans.fundamentals import BAL, CF, INC, _TTM, _metrics
from tapeline.plans.shapes import K, frames
from tapeline.registry import query
from tapeline.sources import schema as S


def _cov(table, cols):
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{c}' AS field, count(*) AS total, count({c}) AS filled, round(count({c})/count(*)*100,1) AS coverage_pct FROM {table_view}"
                              for c in cols for table_view in [{"income": "v_income", "balance": "v_balance", "cashflow": "v_cashflow"}[table]])


@query("field_coverage", " UNION ALL ".join([_cov("income", INC), _cov("balance", BAL), _cov("cashflow", CF)]))
def field_coverage(v):
    a = QL.field_coverage(v.income, INC, "income")
    return a.unionByName(QL.field_coverage(v.balance, BAL, "balance")).unionByName(QL.field_coverage(v.cashflow, CF, "cashflow"))


@query("period_coverage", " UNION ALL ".join(f"SELECT '{t}' AS table_name, min(period_end_date) AS first_period, max(period_end_date) AS last_period, count(DISTINCT period_end_date) AS periods FROM v_{t}" for t in ("income", "balance", "cashflow")))
def period_coverage(v):
    return QL.period_coverage(v.income, "income").unionByName(QL.period_coverage(v.balance, "balance")).unionByName(QL.period_coverage(v.cashflow, "cashflow"))


@query("top_symbols", "SELECT symbol, count(*) AS row_count FROM v_income GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_symbols(v):
    return QL.top_counts(v.income, "symbol")


@query("filing_type_counts", "SELECT filing_type, count(*) AS row_count FROM v_income GROUP BY 1")
def filing_type_counts(v):
    return v.income.groupBy("filing_type").agg(F.count(F.lit(1)).alias("row_count"))


@query("unnest_count", "SELECT role, count(*) AS keys FROM (SELECT conv_id, unnest(list(DISTINCT role)) AS role FROM conversations GROUP BY 1) GROUP BY 1")
def unnest_count(v):
    """Array column exploded and counted: keys per granted scope, scopes being a conversation's roles."""
    scopes = v.table("conversations").groupBy("conv_id").agg(F.collect_set("role").alias("scopes"))
    return scopes.select(F.explode("scopes").alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("keys"))


_T14 = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("table_counts", "WITH t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _T14) + ") SELECT * FROM t UNION ALL SELECT 'total', CAST(sum(row_count) AS BIGINT) FROM t")
def table_counts(v):
    return QL.table_counts({t: v.table(t) for t in _T14})


@query("conditional_counts", "SELECT count(*) AS total, count(*) FILTER (c_acctbal>0 AND c_custkey%5<>0) AS enabled, count(*) FILTER (c_custkey%5=0) AS revoked, count(*) FILTER (c_acctbal<=0) AS expired FROM customer")
def conditional_counts(v):
    c, revoked, expired = v.table("customer"), F.col("c_custkey") % 5 == 0, F.col("c_acctbal") <= 0
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if(~revoked & ~expired).alias("enabled"), F.count_if(revoked).alias("revoked"), F.count_if(expired).alias("expired"))


@query("distinct_symbols", "SELECT symbol FROM v_income UNION SELECT symbol FROM v_balance UNION SELECT symbol FROM v_cashflow UNION SELECT symbol FROM v_bars ORDER BY 1")
def distinct_symbols(v):
    parts = [d.select("symbol").distinct() for d in (v.income, v.balance, v.cashflow, v.bars)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.distinct().orderBy("symbol")


_RQ = "SELECT CASE WHEN event_id%50=0 THEN '' ELSE method END AS method, CASE WHEN event_id%40=0 THEN 'unmatched' ELSE route END AS route, count(*) AS requests, count(*) FILTER (status>=500) AS errors FROM v_requests GROUP BY 1,2"


@query("route_error_rate", f"SELECT method, route, requests, errors, round(errors/requests*100,4) AS error_pct FROM ({_RQ} UNION ALL SELECT '*', '*', count(*), count(*) FILTER (status>=500) FROM v_requests)")
def route_error_rate(v):
    r = v.requests.withColumn("method", F.when(F.col("event_id") % 50 != 0, F.col("method"))).withColumn("route", F.when(F.col("event_id") % 40 != 0, F.col("route")))
    return QL.route_error_rate(r)


_B = QL.LATENCY_BOUNDS
view("v_buckets", " UNION ALL ".join(f"SELECT method, route, {b}::DOUBLE AS le, count(*) FILTER (latency_ms/1000.0::DOUBLE<={b}::DOUBLE) AS cum FROM v_requests GROUP BY 1,2" for b in _B) + " UNION ALL SELECT method, route, NULL, count(*) FROM v_requests GROUP BY 1,2")
view("v_bk", "SELECT *, coalesce(lag(le) OVER w,0) AS ple, coalesce(lag(cum) OVER w,0) AS pc, max(cum) OVER (PARTITION BY method, route) AS total FROM v_buckets WINDOW w AS (PARTITION BY method, route ORDER BY le NULLS LAST)")


def _q(p):
    return f"SELECT method, route, max(total) AS requests, CAST(format('{{:.1f}}', min_by(CASE WHEN cum-pc<=0 THEN le ELSE ple+(le-ple)*((total*{p}::DOUBLE-pc)/(cum-pc)) END, coalesce(le,1e9)) FILTER (cum>=total*{p}::DOUBLE)*1000) AS DOUBLE) AS q FROM v_bk GROUP BY 1,2"


@query("histogram_quantile", f"SELECT a.method, a.route, a.requests, a.q AS p50_ms, b.q AS p95_ms FROM ({_q(0.5)}) a JOIN ({_q(0.95)}) b USING (method, route)")
def histogram_quantile(v):
    return QL.histogram_quantile(QL.latency_buckets(v.requests))


@query("batch_summary", """SELECT grp, ok, skipped, failed, counter, total FROM (SELECT event_type AS grp, count(*) FILTER (event_id%7 NOT IN (0,1)) AS ok, count(*) FILTER (event_id%7=1) AS skipped, count(*) FILTER (event_id%7=0) AS failed FROM events GROUP BY 1) JOIN
 (SELECT event_type AS grp, 'saved' AS counter, CAST(sum(event_id%13) AS BIGINT) AS total FROM events GROUP BY 1 UNION ALL SELECT event_type, 'parsed', CAST(sum(event_id%3) AS BIGINT) FROM events WHERE event_id%2=0 GROUP BY 1) USING (grp)""")
def batch_summary(v):
    k = F.col("event_id")
    saved = F.create_map(F.lit("saved"), k % 13)
    counters = F.when(k % 2 == 0, F.map_concat(saved, F.create_map(F.lit("parsed"), k % 3))).otherwise(saved)
    rows = v.table("events").select(F.col("event_type").alias("grp"), F.when(k % 7 == 0, "failed").when(k % 7 == 1, "skipped").otherwise("ok").alias("outcome"), counters.alias("counters"))
    return QL.batch_summary(rows, "grp")


# -- data-quality checks ---------------------------------------------------------------------------

def _ident(name, left, right, tol):
    if " / " in right:
        a, b = right.split(" / ")
        right = f"({a})/nullif({b},0)"
    bad = f"abs({left}-({right}))>greatest(abs({right})*{tol}::DOUBLE, 0.02::DOUBLE)"
    return f"SELECT '{name}' AS identity, count({bad}) AS checked, count(*) FILTER ({bad}) AS violated, count(*) FILTER (({bad}) IS NULL) AS unverifiable FROM {_TTM} WHERE rn=1"


@query("dq_identities", " UNION ALL ".join(_ident(*i) for i in QL.IDENTITIES))
def dq_identities(v):
    return QL.identity_checks(_metrics(v))


@query("dq_bounds", f"""SELECT 'rsi' AS check_name, count(rsi_14) AS checked, count(*) FILTER (NOT rsi_14 BETWEEN 0 AND 100) AS violated FROM v_rlast UNION ALL SELECT 'williams_r', count(williams_r_14), count(*) FILTER (NOT williams_r_14 BETWEEN -100 AND 0) FROM v_rlast
 UNION ALL SELECT 'adx', count(adx_14), count(*) FILTER (NOT adx_14 BETWEEN 0 AND 100) FROM v_rlast
 UNION ALL SELECT 'split', count(*), count(*) FILTER (NOT CASE WHEN side='support' THEN price<last_close ELSE price>=last_close END) FROM v_sr JOIN v_fclose USING ({K})
 UNION ALL SELECT 'stop_below_price', count(stop_level), count(*) FILTER (NOT stop_level<reference_price) FROM v_levelrow UNION ALL SELECT 'target_above_price', count(tp1), count(*) FILTER (NOT reference_price<tp1) FROM v_levelrow
 UNION ALL SELECT 'fib_between_swings', count(*), count(*) FILTER (NOT level BETWEEN swing_low AND swing_high) FROM (SELECT label, level, swing_high, swing_low FROM v_dfiball)""")
def dq_bounds(v):
    last = _last(v)
    a = QL.count_violations(last, {"rsi": F.col("rsi_14").between(0, 100), "williams_r": F.col("williams_r_14").between(-100, 0), "adx": F.col("adx_14").between(0, 100)})
    fr = frames(v)
    sr = ST.support_resistance(fr).join(fr.filter("rd = 1").select("symbol", "timeframe", F.col("close").alias("last_close")), ["symbol", "timeframe"])
    split = F.when(F.col("side") == "support", F.col("price") < F.col("last_close")).otherwise(F.col("price") >= F.col("last_close"))
    lv = _levels(v, last)
    fib = _fib_daily(v)
    out = a.unionByName(QL.count_violations(sr, {"split": split}))
    out = out.unionByName(QL.count_violations(lv, {"stop_below_price": F.col("stop_level") < F.col("reference_price"), "target_above_price": F.col("reference_price") < F.col("tp1")}))
    return out.unionByName(QL.count_violations(fib, {"fib_between_swings": F.col("level").between(F.col("swing_low"), F.col("swing_high"))}))


view("v_dfiball", """SELECT symbol, label, swing_high, swing_low, round(CASE WHEN hd>=ld THEN swing_high-(swing_high-swing_low)*r ELSE swing_low+(swing_high-swing_low)*r END,4) AS level
 FROM v_dfib0, (VALUES ('0.0%',0.0::DOUBLE),('23.6%',0.236::DOUBLE),('38.2%',0.382::DOUBLE),('50.0%',0.5::DOUBLE),('61.8%',0.618::DOUBLE),('78.6%',0.786::DOUBLE),('100.0%',1.0::DOUBLE)) t(label,r) WHERE swing_high<>swing_low""")


@query("dq_counts", "SELECT 'signal_total' AS check_name, count(*) AS checked, count(*) FILTER (bullish+bearish+neutral<>total_signals) AS violated FROM v_conf UNION ALL SELECT 'weekly_has_no_1d', count(*), count(*) FILTER (c1d IS NOT NULL) FROM v_changes WHERE rd=1 AND timeframe='weekly'")
def dq_counts(v):
    last = _last(v)
    conf = SG.confluence(SG.signals(SG.daily(last)))
    a = QL.count_violations(conf, {"signal_total": F.col("bullish") + F.col("bearish") + F.col("neutral") == F.col("total_signals")})
    return a.unionByName(QL.count_violations(last.filter("timeframe = 'weekly'"), {"weekly_has_no_1d": F.col("change_pct_1d").isNull()}))


@query("dq_null_rate", " UNION ALL ".join(f"SELECT source, count(*) AS total, '{c}' AS field, count(*)-count({c}) AS nulls, round((count(*)-count({c}))/count(*)*100,2) AS null_pct FROM {_TTM} WHERE rn=1 GROUP BY source" for c in M.METRICS))
def dq_null_rate(v):
    return QL.null_rates(_metrics(v), M.METRICS, "source")


_CLS = {"price_to_earnings_ratio": "multiple", "net_margin": "percent", "revenue_growth_annual": "growth", "days_receivable_outstanding": "days", "earnings_per_share": "per_share", "market_capitalization": "currency"}
_FACTOR = "(1+CASE CAST(substring(symbol,2) AS BIGINT)%5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.01 WHEN 2 THEN -0.035 WHEN 3 THEN 0.2 ELSE 0.015 END::DOUBLE)"
view("v_score0", " UNION ALL ".join(f"SELECT symbol, '{m}' AS metric, '{c}' AS class, {m} AS value, CASE WHEN CAST(substring(symbol,2) AS BIGINT)%11<>0 THEN {m}*{_FACTOR} END AS reference FROM {_TTM} WHERE rn=1 AND consolidated" for m, c in _CLS.items()))
view("v_score1", """SELECT *, (value-reference)/nullif(abs(reference),0) AS rel, CASE class WHEN 'multiple' THEN 0.02 WHEN 'percent' THEN 0.5 WHEN 'growth' THEN 1.5 WHEN 'days' THEN 3.0 WHEN 'per_share' THEN 0.01 ELSE 0.02 END::DOUBLE AS p, CASE class WHEN 'multiple' THEN 0.05 WHEN 'percent' THEN 1.5 WHEN 'growth' THEN 4.0 WHEN 'days' THEN 8.0 WHEN 'per_share' THEN 0.03 ELSE 0.05 END::DOUBLE AS n
 FROM v_score0 WHERE value IS NOT NULL AND reference IS NOT NULL""")
view("v_score2", "SELECT *, CASE WHEN dist<=p THEN 'pass' WHEN dist<=n THEN 'near' ELSE 'fail' END AS verdict FROM (SELECT *, CASE WHEN class IN ('percent','growth','days') THEN abs(value-reference) ELSE abs(rel) END AS dist FROM v_score1)")
view("v_score3", """SELECT metric, count(*) FILTER (verdict='pass') AS pass_, count(*) FILTER (verdict='near') AS near_, count(*) FILTER (verdict='fail') AS fail_, round(avg(abs(rel))*100,4) AS mape_pct, round(avg(rel)*100,4) AS bias_pct, max_by(symbol, {'r':abs(rel),'s':symbol}) FILTER (rel IS NOT NULL) AS worst_symbol FROM v_score2 GROUP BY 1""")
view("v_score", """SELECT *, round((pass_+0.5::DOUBLE*near_)/(pass_+near_+fail_)*100,2) AS score FROM v_score3""")


@query("dq_scoring", """SELECT metric, pass_ AS pass, near_ AS near, fail_ AS fail, mape_pct, bias_pct, worst_symbol, score, CASE WHEN score>=90 THEN 'A' WHEN score>=80 THEN 'B' WHEN score>=70 THEN 'C' WHEN score>=60 THEN 'D' ELSE 'F' END AS grade FROM v_score""")
def dq_scoring(v):
    """Metrics scored against a disturbed copy standing in for an outside reference."""
    m = _metrics(v).filter("consolidated")
    k = F.substring("symbol", 2, 20).cast("bigint")
    factor = 1 + F.when(k % 5 == 0, 0.0).when(k % 5 == 1, 0.01).when(k % 5 == 2, -0.035).when(k % 5 == 3, 0.2).otherwise(0.015)
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(c).alias("class"), F.col(n).alias("value")) for n, c in _CLS.items()])
    d = m.select("symbol", F.inline(rows))
    d = d.withColumn("reference", F.when(k % 11 != 0, F.col("value") * factor))
    return QL.score_pairs(d)


view("v_srcs", """SELECT symbol, period_end_date, u.s AS source_name, u.v AS value FROM (SELECT symbol, period_end_date, unnest([{'s':'a','v':revenue_from_operations},{'s':'b','v':CASE WHEN month(period_end_date)=3 THEN revenue_from_operations*1.5::DOUBLE ELSE revenue_from_operations END},
 {'s':'c','v':CASE WHEN month(period_end_date) IN (3,6) THEN revenue_from_operations*2 ELSE revenue_from_operations END}]) AS u FROM v_income WHERE consolidated AND filing_type='quarterly')""")


@query("dq_majority", """SELECT symbol, period_end_date, CASE month(period_end_date) WHEN 3 THEN NULL ELSE max(value) FILTER (source_name='a') END AS value, CASE month(period_end_date) WHEN 3 THEN 'contested' ELSE 'agreed' END AS status,
 CASE month(period_end_date) WHEN 3 THEN NULL WHEN 6 THEN 'c' ELSE '' END AS dissent FROM v_srcs GROUP BY symbol, period_end_date""")
def dq_majority(v):
    q = v.income.filter(F.col("consolidated") & (F.col("filing_type") == "quarterly"))
    m, r = F.month("period_end_date"), F.col(S.REVENUE)
    rows = F.array(F.struct(F.lit("a").alias("source"), r.alias("value")), F.struct(F.lit("b").alias("source"), F.when(m == 3, r * 1.5).otherwise(r).alias("value")),
                   F.struct(F.lit("c").alias("source"), F.when(m.isin(3, 6), r * 2).otherwise(r).alias("value")))
    d = q.select("symbol", "period_end_date", F.inline(rows))
    return QL.majority_value(d, ["symbol", "period_end_date"], 0.02)


