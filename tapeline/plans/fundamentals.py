"""Statement and fundamental-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import scalars as X
from tapeline.operators import bars as B
from tapeline.operators import metrics as M
from tapeline.operators import ratios as RT
from tapeline.operators import statements as ST
from tapeline.plans.checks import view
from tapeline.registry import query
from tapeline.sources import schema as S

KEY = ", ".join(S.STATEMENT_KEY)
SER = "symbol, source, consolidated, filing_type"
W_SER = f"PARTITION BY {SER} ORDER BY period_end_date"
INC = ["revenue_from_operations", "cost_of_revenue", "expenses", "finance_costs", S.DEPRECIATION, "operating_income",
       "profit_before_tax", "tax_expense", "profit_loss_for_period", S.EPS_BASIC, S.EPS_DILUTED, "weighted_average_shares_basic"]
BAL = ["assets", "assets_current", "noncurrent_assets", "equity_share_capital", "other_equity", "borrowings_current", "borrowings_noncurrent",
       "noncurrent_liabilities", "current_liabilities", "inventories", "trade_receivables_current", "trade_payables", S.CASH, S.BANK,
       "reserve_excluding_revaluation_reserves", S.PAID_UP, S.FACE, "debt_equity_ratio"]
CF = [S.OCF, S.CAPEX, "dividends_paid"]
ALLC = ", ".join(INC + BAL + CF)

view("v_pkeys", f"SELECT {KEY} FROM v_income UNION SELECT {KEY} FROM v_balance UNION SELECT {KEY} FROM v_cashflow")
view("v_mergeall", f"""SELECT {KEY}, {', '.join('i.'+c for c in INC)}, {', '.join('b.'+c for c in BAL)}, {', '.join('c.'+c for c in CF)},
 coalesce(i.fiscal_period, b.fiscal_period, c.fiscal_period) AS fiscal_period, i.period_end_date AS ie, b.period_end_date AS be, c.period_end_date AS ce
 FROM v_pkeys LEFT JOIN v_income i USING ({KEY}) LEFT JOIN v_balance b USING ({KEY}) LEFT JOIN v_cashflow c USING ({KEY})""")
view("v_merged", "SELECT * FROM v_mergeall WHERE filing_type='quarterly'")
view("v_cfwd", f"""SELECT {KEY}, {', '.join(INC)}, {', '.join(CF)}, fiscal_period, ie, be, ce, row_number() OVER ({W_SER} DESC) AS rn, max(period_end_date) OVER (PARTITION BY {SER}) AS newest,
 {', '.join(f"last_value({c} IGNORE NULLS) OVER cw AS {c}" for c in BAL)} FROM v_merged
 WINDOW cw AS ({W_SER} RANGE BETWEEN INTERVAL 380 DAYS PRECEDING AND CURRENT ROW)""")


def _recs(v):
    return M.records(v.income, v.balance, v.cashflow)


def _quarterly(df):
    return df.filter(F.col("filing_type") == "quarterly")


# -- scans and joins -----------------------------------------------------------------

@query("scan_statements", f"""SELECT {KEY}, revenue_from_operations, profit_loss_for_period FROM v_income
WHERE consolidated AND filing_type='quarterly' AND source='NSE'""")
def scan_statements(v):
    d = v.income.filter(F.col("consolidated") & (F.col("filing_type") == "quarterly") & (F.col("source") == "NSE"))
    return d.select(*S.STATEMENT_KEY, S.REVENUE, S.PAT)


@query("merge_statements", f"SELECT {KEY}, fiscal_period, {ALLC} FROM v_mergeall WHERE filing_type='quarterly' AND consolidated")
def merge_statements(v):
    parts = [f.filter((F.col("filing_type") == "quarterly") & F.col("consolidated")) for f in (v.income, v.balance, v.cashflow)]
    d = ST.merge_statements(*parts)
    return d.select(*S.STATEMENT_KEY, "fiscal_period", *INC, *BAL, *CF)


@query("merge_history", f"SELECT {KEY}, {ALLC} FROM v_mergeall")
def merge_history(v):
    d = ST.merge_statements(v.income, v.balance, v.cashflow)
    return d.select(*S.STATEMENT_KEY, *INC, *BAL, *CF)


@query("union_periods", f"SELECT {KEY} FROM v_pkeys")
def union_periods(v):
    a, b, c = (f.select(*S.STATEMENT_KEY) for f in (v.income, v.balance, v.cashflow))
    return a.unionByName(b).unionByName(c).distinct()


view("v_incgap", "SELECT * FROM v_income WHERE NOT (consolidated AND (month(period_end_date)=6 OR abs(hash_k) % 2 = 1))".replace("abs(hash_k) % 2 = 1", "CAST(substring(symbol,2) AS BIGINT) % 10 = 3"))


def income_with_gaps(v):
    """Income statements where some issuers and quarters never filed consolidated figures."""
    gap = F.col("consolidated") & ((F.month("period_end_date") == 6) | (F.substring("symbol", 2, 20).cast("bigint") % 10 == 3))
    return v.income.filter(~gap)


view("v_consfb", f"""SELECT * FROM v_incgap a WHERE consolidated OR NOT EXISTS (SELECT 1 FROM v_incgap b WHERE b.consolidated AND a.symbol=b.symbol AND a.source=b.source
 AND a.filing_type=b.filing_type AND a.period_end_date=b.period_end_date)""")


@query("consolidated_fallback", f"SELECT {KEY}, revenue_from_operations FROM v_consfb")
def consolidated_fallback(v):
    return ST.consolidated_fallback(income_with_gaps(v)).select(*S.STATEMENT_KEY, S.REVENUE)


view("v_incnew", """SELECT * FROM v_incgap QUALIFY row_number() OVER (PARTITION BY symbol, source, filing_type ORDER BY consolidated DESC, period_end_date DESC)=1""")


@query("snapshot_fallback", "SELECT symbol, source, filing_type, consolidated, period_end_date, revenue_from_operations, NOT consolidated AS fallback, 'IncomeStatement' AS statement FROM v_incnew")
def snapshot_fallback(v):
    d = ST.snapshot_fallback(income_with_gaps(v), "IncomeStatement")
    return d.select("symbol", "source", "filing_type", "consolidated", "period_end_date", S.REVENUE, "fallback", "statement")


@query("carry_forward_balance", f"SELECT {KEY}, {', '.join(BAL)} FROM v_cfwd")
def carry_forward_balance(v):
    return _recs(v).select(*S.STATEMENT_KEY, *BAL)


@query("period_offset", f"""SELECT a.symbol, a.source, a.consolidated, a.filing_type, a.period_end_date, a.revenue_from_operations AS value,
 (SELECT max_by(b.revenue_from_operations, b.period_end_date) FROM v_income b WHERE b.symbol=a.symbol AND b.source=a.source AND b.consolidated=a.consolidated AND b.filing_type=a.filing_type
  AND date_trunc('month', b.period_end_date) = date_trunc('month', a.period_end_date) - INTERVAL 3 MONTH) AS previous FROM v_income a WHERE filing_type='quarterly'""")
def period_offset(v):
    return ST.period_offset(_quarterly(v.income), S.REVENUE, 3)


@query("period_offset_yoy", f"""SELECT a.symbol, a.source, a.consolidated, a.filing_type, a.period_end_date, a.revenue_from_operations AS value, b.revenue_from_operations AS previous
 FROM v_income a LEFT JOIN v_income b ON b.symbol=a.symbol AND b.source=a.source AND b.consolidated=a.consolidated AND b.filing_type=a.filing_type
  AND date_trunc('month', b.period_end_date) = date_trunc('month', a.period_end_date) - INTERVAL 12 MONTH WHERE a.filing_type='quarterly'""")
def period_offset_yoy(v):
    return ST.period_offset(_quarterly(v.income), S.REVENUE, 12)


@query("exchange_lookup", """SELECT DISTINCT i.symbol, i.source, coalesce(m.exchange, CASE WHEN i.source='SEC' THEN 'NASDAQ' ELSE i.source END) AS trading_exchange FROM v_income i LEFT JOIN v_meta m USING (symbol)""")
def exchange_lookup(v):
    syms = v.income.select("symbol", "source").distinct()
    d = syms.join(v.stock_metadata.select("symbol", "exchange"), "symbol", "left")
    default = F.when(F.col("source") == "SEC", "NASDAQ").otherwise(F.col("source"))
    return d.select("symbol", "source", F.coalesce("exchange", default).alias("trading_exchange"))


# -- series aggregates ------------------------------------------------------------------

def _ttm(c, start, strict, rn="rn"):
    f = f"FILTER ({rn} BETWEEN {start+1} AND {start+4})"
    return f"CASE WHEN count({c}) {f} = 4 THEN sum({c}) {f} END" if strict else f"sum({c}) {f}"


@query("ttm_window", f"""SELECT {SER}, {', '.join(f"round({_ttm(c,0,c not in ST.SPARSE_FLOWS)},6) AS {c}" for c in ST.FLOWS)} FROM v_cfwd GROUP BY {SER}""")
def ttm_window(v):
    d = ST.ttm_windows(_recs(v), ST.FLOWS)
    return d.select(*ST.SERIES, *[F.round(c, 6).alias(c) for c in ST.FLOWS])


@query("ttm_window_prior", f"""SELECT {SER}, {', '.join(f"round({_ttm(c,4,c not in ST.SPARSE_FLOWS)},6) AS {c}" for c in ST.FLOWS)} FROM v_cfwd GROUP BY {SER}""")
def ttm_window_prior(v):
    d = ST.ttm_windows(_recs(v), ST.FLOWS, 4)
    return d.select(*ST.SERIES, *[F.round(c, 6).alias(c) for c in ST.FLOWS])


@query("ttm_completeness", f"""SELECT {SER}, count(revenue_from_operations) FILTER (rn<=4) AS ttm_quarters_used, count(revenue_from_operations) FILTER (rn<=4)>=4 AS ttm_window_complete,
 coalesce({_ttm('revenue_from_operations',0,True)}, max(revenue_from_operations) FILTER (rn=1)) AS revenue FROM v_cfwd GROUP BY {SER}""")
def ttm_completeness(v):
    return ST.ttm_completeness(_recs(v))


@query("latest_annual_end", "SELECT symbol, source, consolidated, max(period_end_date) AS annual_end FROM v_balance WHERE filing_type='annual' GROUP BY 1,2,3")
def latest_annual_end(v):
    return ST.latest_annual_end(v.balance)


view("v_month", f"""SELECT {SER}, month(period_end_date) AS m, count(*) AS cnt, count(*) FILTER (fiscal_period='Q4') AS q4, max(period_end_date) FILTER (fiscal_period='Q4') AS seen FROM v_cfwd GROUP BY ALL""")
view("v_fye", f"""SELECT {SER}, CAST(CASE WHEN sum(q4)>0 THEN max_by(m, {{'c':q4,'s':seen}}) WHEN sum(cnt)>=4 AND count(*) FILTER (cnt=mn)=1 THEN max(m) FILTER (cnt=mn) END AS INT) AS fye_month
 FROM (SELECT *, min(cnt) OVER (PARTITION BY {SER}) AS mn FROM v_month) GROUP BY {SER}""")


@query("fye_month", f"SELECT {SER}, fye_month FROM v_fye")
def fye_month(v):
    return ST.fye_month(_recs(v))


view("v_fye2", f"""SELECT {SER}, CAST(CASE WHEN sum(cnt)>=4 AND count(*) FILTER (cnt=mn)=1 THEN max(m) FILTER (cnt=mn) END AS INT) AS fye_month
 FROM (SELECT *, min(cnt) OVER (PARTITION BY {SER}) AS mn FROM v_month) GROUP BY {SER}""")


@query("fye_month_untagged", f"SELECT {SER}, fye_month FROM v_fye2")
def fye_month_untagged(v):
    """Same inference when no filing carries a fiscal-period tag."""
    return ST.fye_month(_recs(v).withColumn("fiscal_period", F.lit(None).cast("string")))


view("v_annual", f"""SELECT symbol, source, consolidated, max(period_end_date) AS annual_end FROM v_balance WHERE filing_type='annual' GROUP BY 1,2,3""")
_GUESS = """CAST(CASE WHEN month(newest)>=fye_month THEN year(newest) ELSE year(newest)-1 END AS VARCHAR)||'-'||lpad(CAST(fye_month AS VARCHAR),2,'0')||'-'||
 CASE fye_month WHEN 3 THEN '31' WHEN 6 THEN '30' WHEN 9 THEN '30' WHEN 12 THEN '31' WHEN 2 THEN '28' ELSE '30' END"""


@query("annual_end_inferred", f"""SELECT {SER}, CASE WHEN filed IS NOT NULL THEN strftime(filed,'%Y-%m-%d') ELSE {_GUESS} END AS last_annual_end_date,
 CASE WHEN filed IS NOT NULL THEN 'filing' WHEN fye_month IS NOT NULL THEN 'inferred' ELSE 'unknown' END AS last_annual_end_date_source
 FROM (SELECT DISTINCT {SER}, newest FROM v_cfwd) JOIN v_fye USING ({SER}) LEFT JOIN (SELECT symbol, source, consolidated, annual_end AS filed FROM v_annual WHERE source='NSE') USING (symbol, source, consolidated)""")
def annual_end_inferred(v):
    recs = _recs(v)
    newest = recs.groupBy(*ST.SERIES).agg(F.max("period_end_date").alias("newest"))
    filed = ST.latest_annual_end(v.balance).filter(F.col("source") == "NSE")
    d = newest.join(ST.fye_month(recs), ST.SERIES).join(filed, S.SERIES_KEY, "left")
    value, src = ST.annual_end_inferred(F.col("newest"), F.col("fye_month"), F.col("annual_end"))
    return d.select(*ST.SERIES, value.alias("last_annual_end_date"), src.alias("last_annual_end_date_source"))


@query("latest_per_key", f"SELECT {SER}, period_end_date, revenue_from_operations FROM v_income QUALIFY row_number() OVER ({W_SER} DESC)=1")
def latest_per_key(v):
    return ST.latest_per_key(v.income.select(*S.STATEMENT_KEY, S.REVENUE), ST.SERIES)


_REAL = ", ".join(c for c in BAL if c in S.PRIORITY["balance_sheets"])
view("v_popbal", f"""SELECT * FROM (SELECT *, row_number() OVER ({W_SER} DESC) AS rn FROM v_balance) WHERE rn<=12
 QUALIFY row_number() OVER (PARTITION BY {SER} ORDER BY (coalesce({_REAL}) IS NOT NULL) DESC, period_end_date DESC)=1""")


@query("filter_populated_balance", f"SELECT {SER}, period_end_date, assets, {S.PAID_UP} FROM v_popbal")
def filter_populated_balance(v):
    return ST.populated_balance(v.balance).select(*ST.SERIES, "period_end_date", "assets", S.PAID_UP)


@query("filter_period_range", f"SELECT {KEY}, revenue_from_operations FROM v_income WHERE period_end_date >= DATE '1997-01-01' AND period_end_date <= DATE '1998-12-31'")
def filter_period_range(v):
    return ST.filter_period_range(v.income, "1997-01-01", "1998-12-31").select(*S.STATEMENT_KEY, S.REVENUE)


@query("filter_period_range_bad_bound", f"SELECT {KEY}, revenue_from_operations FROM v_income WHERE period_end_date <= DATE '1996-06-30'")
def filter_period_range_bad_bound(v):
    return ST.filter_period_range(v.income, "not-a-date", "1996-06-30").select(*S.STATEMENT_KEY, S.REVENUE)


_PRI = [c for c in CF if c in S.PRIORITY["cash_flows"]]


@query("project_fields", f"SELECT {KEY}, revenue_from_operations, finance_costs FROM v_income")
def project_fields(v):
    return ST.project_fields(v.income, [S.REVENUE, S.FINANCE, "no_such_metric"], S.STATEMENT_KEY)


def _json(cols_sql):
    """Text of a JSON object of (name, sql text) with nulls left out."""
    parts = ", ".join(f"CASE WHEN {e} IS NOT NULL THEN '\"{n}\":'||{e} END" for n, e in cols_sql)
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


@query("project_priority", f"""SELECT {KEY}, {_json([("symbol", "'\"'||symbol||'\"'"), ("consolidated", "CAST(consolidated AS VARCHAR)"), ("filing_type", "'\"'||filing_type||'\"'"),
 ("period_end_date", "'\"'||period_end_date||'\"'"), ("period_start_date", "'\"'||period_start_date||'\"'"), ("fiscal_period", "'\"'||fiscal_period||'\"'"),
 (S.OCF, f"CAST(CAST({S.OCF} AS BIGINT) AS VARCHAR)"), (S.CAPEX, f"CAST(CAST({S.CAPEX} AS BIGINT) AS VARCHAR)"), ("dividends_paid", "CAST(CAST(dividends_paid AS BIGINT) AS VARCHAR)")])} AS document FROM v_cashflow""")
def project_priority(v):
    whole = v.cashflow.select(*[F.col(c).cast("bigint").alias(c) if c in CF else F.col(c) for c in
                                ("symbol", "source", "consolidated", "filing_type", "period_end_date", "period_start_date", "fiscal_period", "source_endpoint", *CF)])
    return ST.project_priority(whole, "cash_flows")


@query("statement_page", f"""SELECT {KEY}, revenue_from_operations, total, position FROM (SELECT *, count(*) OVER (PARTITION BY symbol, source, filing_type) AS total,
 row_number() OVER (PARTITION BY symbol, source, filing_type ORDER BY period_end_date DESC, source_endpoint) AS position FROM v_consfb WHERE period_end_date>=DATE '1996-01-01') WHERE position>4 AND position<=12""")
def statement_page(v):
    d = ST.statement_page(income_with_gaps(v), gte="1996-01-01", offset=4, limit=8)
    return d.select(*S.STATEMENT_KEY, S.REVENUE, "total", "position")


@query("page_total", f"""SELECT {KEY}, total FROM (SELECT *, count(*) OVER (PARTITION BY symbol, source, filing_type) AS total, row_number() OVER (PARTITION BY symbol, source, filing_type ORDER BY period_end_date DESC, source_endpoint) AS p FROM v_consfb) WHERE p<=10""")
def page_total(v):
    return ST.statement_page(income_with_gaps(v), limit=10).select(*S.STATEMENT_KEY, "total")


view("v_balnew", """SELECT * FROM v_popbal QUALIFY row_number() OVER (PARTITION BY symbol, source, filing_type ORDER BY consolidated DESC)=1""")
view("v_cfnew", """SELECT * FROM v_cashflow QUALIFY row_number() OVER (PARTITION BY symbol, source, filing_type ORDER BY consolidated DESC, period_end_date DESC)=1""")


@query("financials_snapshot", f"""SELECT symbol, source, filing_type, coalesce(i.period_end_date, c.period_end_date, b.period_end_date) AS period_end_date,
 CASE WHEN fb<>'' THEN 'No consolidated data for '||fb||'; using standalone (the whole-company picture at that date)'
  WHEN len(list_distinct(list_filter([i.period_end_date,b.period_end_date,c.period_end_date], lambda x: x IS NOT NULL)))>1 THEN 'Merged data mixes different reporting periods' END AS data_quality_warning,
 CASE WHEN fb<>'' THEN fb END AS standalone_fallback, {ALLC}
 FROM v_incnew i FULL JOIN v_balnew b USING (symbol, source, filing_type) FULL JOIN v_cfnew c USING (symbol, source, filing_type),
 LATERAL (SELECT concat_ws(', ', CASE WHEN NOT b.consolidated THEN 'BalanceSheet' END, CASE WHEN NOT c.consolidated THEN 'CashFlow' END, CASE WHEN NOT i.consolidated THEN 'IncomeStatement' END) AS fb)""")
def financials_snapshot(v):
    return ST.financials_snapshot(income_with_gaps(v), v.balance, v.cashflow)


_NUM = "profit_loss_for_period"


@query("derive_fields", f"""SELECT {KEY}, round(coalesce(weighted_average_shares_basic, {_NUM}/nullif({S.EPS_BASIC},0)),4) AS weighted_average_shares_basic, round({_NUM}/nullif({S.EPS_DILUTED},0),4) AS weighted_average_shares_diluted,
 equity_share_capital+other_equity AS total_equity, CAST(10 AS DOUBLE)+CASE WHEN other_equity IS NULL THEN NULL ELSE 0 END AS minority_interest FROM v_mergeall WHERE filing_type='quarterly'""")
def derive_fields(v):
    d = ST.merge_statements(*[_quarterly(f) for f in (v.income, v.balance, v.cashflow)])
    total = F.col("equity_share_capital") + F.col("other_equity")
    d = d.withColumns({"total_equity_including_nci": total, "stockholders_equity": total - 10})
    d = ST.derive_fields(d)
    return d.select(*S.STATEMENT_KEY, *[F.round(c, 4).alias(c) for c in ("weighted_average_shares_basic", "weighted_average_shares_diluted")],
                    "total_equity", "minority_interest")


@query("derive_operating_income", f"SELECT {KEY}, coalesce(operating_income, CASE WHEN source='NSE' THEN revenue_from_operations-expenses END) AS operating_income FROM v_income")
def derive_operating_income(v):
    return ST.derive_operating_income(v.income).select(*S.STATEMENT_KEY, "operating_income")


# -- metrics -----------------------------------------------------------------------------

def _r2(e):
    # text formatting rounds the exact binary value, ties to even
    return f"0+CAST(CASE WHEN abs({e})<1 THEN format('{{:.4f}}',{e}) ELSE format('{{:.2f}}',{e}) END AS DOUBLE)"


def _div(a, b):
    return f"(({a})/nullif(({b}),0))"


def _pct(e):
    return f"round(({e})*100,4)"


def _gr(a, b):
    return _pct(_div(f"({a})-({b})", b))


_T = {c: f"t{i}" for i, c in enumerate([*ST.FLOWS, "operating_income"])}
_P = {c: f"p{i}" for i, c in enumerate(M.GROWTH_FLOWS)}
_PASTS = [c for c in M.PAST]
view("v_minputs", f"""SELECT {SER}, {', '.join(f"{_ttm(c,0,c not in ST.SPARSE_FLOWS)} AS {a}" for c,a in _T.items())}, {', '.join(f"{_ttm(c,4,True)} AS {a}" for c,a in _P.items())},
 count(revenue_from_operations) FILTER (rn<=4) AS ttm_quarters_used, arg_max(weighted_average_shares_basic, period_end_date) FILTER (weighted_average_shares_basic<>0) AS any_shares,
 max(ie) AS income_statement_period, max(be) AS balance_sheet_period, max(ce) AS cash_flow_period FROM v_cfwd GROUP BY {SER}""")
for _nm, _mo in (("y", 12), ("q", 3)):
    view(f"v_past{_nm}", f"""SELECT {SER}, {', '.join(f"{c} AS {_nm}{i}" for i,c in enumerate(_PASTS))}, 1 AS has_{_nm} FROM v_cfwd
 WHERE date_trunc('month', period_end_date) = date_trunc('month', newest) - INTERVAL {_mo} MONTH QUALIFY row_number() OVER ({W_SER} DESC)=1""")
_Y = {c: f"y{i}" for i, c in enumerate(_PASTS)}
_Q = {c: f"q{i}" for i, c in enumerate(_PASTS)}
view("v_price", "SELECT symbol, max_by(close, date) AS current_price FROM v_quotes GROUP BY 1")
view("v_mrows", f"""SELECT r.*, i.* EXCLUDE ({SER}), y.* EXCLUDE ({SER}), q.* EXCLUDE ({SER}), f.fye_month, a.annual_end, pr.current_price FROM v_cfwd r JOIN v_minputs i USING ({SER}) LEFT JOIN v_pasty y USING ({SER})
 LEFT JOIN v_pastq q USING ({SER}) LEFT JOIN v_fye f USING ({SER}) LEFT JOIN v_annual a ON a.symbol=r.symbol AND a.source=r.source AND a.consolidated=r.consolidated LEFT JOIN v_price pr ON pr.symbol=r.symbol""")
_rev_t = _T[S.REVENUE]


def metric_views(prefix: str, mode: str) -> str:
    """Check views of the metric set; returns the final view over v_mrows."""
    ttm = mode == "ttm"
    t = {c: f"x_{a}" for c, a in _T.items()}
    w1 = ", ".join(f"CASE WHEN {_rev_t} IS NULL THEN coalesce({_T[c]}, {c}) ELSE {_T[c]} END AS {t[c]}" for c in ST.FLOWS)
    view(f"v_{prefix}1", f"SELECT *, {w1} FROM v_mrows")
    fl = (lambda c: t[c]) if ttm else (lambda c: c)
    w2 = {
        "sh": f"coalesce({S.PAID_UP}/nullif({S.FACE},0), weighted_average_shares_basic, any_shares)",
        "t_ebit": f"coalesce({_T['operating_income']}, {t[S.PBT]}+{t[S.FINANCE]})",
        "l_ebit": f"coalesce(operating_income, {fl(S.PBT)}+{fl(S.FINANCE)})",
        "veps": f"coalesce({t[S.EPS_BASIC]}, {fl(S.EPS_BASIC)})", "vrev": f"coalesce({t[S.REVENUE]}, {fl(S.REVENUE)})",
        "vocf": f"coalesce({t[S.OCF]}, {fl(S.OCF)})", "vdep": f"coalesce({t[S.DEPRECIATION]}, {fl(S.DEPRECIATION)})",
        "vcapex": f"coalesce(abs({t[S.CAPEX]}), abs({fl(S.CAPEX)}))", "vpat": f"coalesce({t[S.PAT]}, {fl(S.PAT)})",
        "debt": "coalesce(borrowings_current,0)+coalesce(borrowings_noncurrent,0)", "eq": "coalesce(equity_share_capital,0)+coalesce(other_equity,0)",
        "cash": f"nullif(coalesce({S.CASH},0)+coalesce({S.BANK},0),0)",
        "yeq": f"CASE WHEN has_y=1 THEN coalesce({_Y['equity_share_capital']},0)+coalesce({_Y['other_equity']},0) END",
        "qeq": f"CASE WHEN has_q=1 THEN coalesce({_Q['equity_share_capital']},0)+coalesce({_Q['other_equity']},0) END",
        "ydebt": f"CASE WHEN has_y=1 THEN coalesce({_Y['borrowings_current']},0)+coalesce({_Y['borrowings_noncurrent']},0) END",
        "yebit": f"CASE WHEN has_y=1 THEN coalesce({_Y[S.PBT]},0)+coalesce({_Y[S.FINANCE]},0) END",
        "pebit": f"coalesce({_P['operating_income']}, {_P[S.PBT]}+{_P[S.FINANCE]})",
        "trate": f"CASE WHEN {t[S.PBT]}<>0 AND {t['tax_expense']} IS NOT NULL THEN greatest(0, least({t['tax_expense']}/{t[S.PBT]}, 1)) END",
    }
    view(f"v_{prefix}2", f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in w2.items())} FROM v_{prefix}1")
    w3 = {
        "vebit": "coalesce(t_ebit, l_ebit)", "mcap": "current_price*sh", "ev": "current_price*sh+debt-coalesce(cash,0)",
        "fcf": "coalesce(vocf-vcapex, vocf)", "bvps": "nullif(eq,0)/nullif(sh,0)", "ebitda": "coalesce(coalesce(t_ebit,l_ebit)+vdep, coalesce(t_ebit,l_ebit))",
        "cbase": f"coalesce({t['cost_of_revenue']}, vrev)",
        "aveq": "CASE WHEN eq<>0 AND yeq<>0 THEN (eq+yeq)/2 ELSE eq END", "avas": f"CASE WHEN assets<>0 AND {_Y['assets']}<>0 THEN (assets+{_Y['assets']})/2 ELSE assets END",
        "inv_": "CASE WHEN yeq<>0 AND ydebt+yeq<>0 THEN (debt+eq+ydebt+yeq)/2 ELSE debt+eq END",
        "spend": "CASE WHEN vcapex IS NOT NULL OR {d} IS NOT NULL THEN coalesce(vcapex,0)+abs(coalesce({d},0)) END".format(d=t["dividends_paid"]),
    }
    view(f"v_{prefix}3", f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in w3.items())} FROM v_{prefix}2")
    nopat = f"CASE WHEN vebit IS NOT NULL THEN CASE WHEN trate IS NOT NULL THEN vebit*(1-trate) ELSE {t[S.PAT]}+{t[S.FINANCE]} END END"
    if ttm:
        g = {c: _gr(t[c], _P[c]) for c in (S.REVENUE, S.PAT, S.EPS_BASIC)}
        both = f"{t[S.CAPEX]} IS NOT NULL AND {_P[S.CAPEX]} IS NOT NULL"
        g_fcf = _gr(f"CASE WHEN {both} THEN {t[S.OCF]}-abs({t[S.CAPEX]}) ELSE {t[S.OCF]} END", f"CASE WHEN {both} THEN {_P[S.OCF]}-abs({_P[S.CAPEX]}) ELSE {_P[S.OCF]} END")
        g_op, g_ebitda = _gr("t_ebit", "pebit"), _gr(f"t_ebit+{t[S.DEPRECIATION]}", f"pebit+{_P[S.DEPRECIATION]}")
    else:
        g = {c: _gr(c, _Y[c]) for c in (S.REVENUE, S.PAT, S.EPS_BASIC)}
        g_fcf = _gr(f"coalesce({S.OCF}-abs({S.CAPEX}),{S.OCF})", f"coalesce({_Y[S.OCF]}-abs({_Y[S.CAPEX]}),{_Y[S.OCF]})")
        g_op = _gr("l_ebit", "yebit")
        g_ebitda = f"CASE WHEN has_y=1 AND {S.DEPRECIATION} IS NOT NULL AND {_Y[S.DEPRECIATION]} IS NOT NULL THEN {_gr(f'l_ebit+{S.DEPRECIATION}', f'yebit+{_Y[S.DEPRECIATION]}')} ELSE {g_op} END"
    dso, dpo = _div("trade_receivables_current", "vrev"), _div("trade_payables", "cbase")
    o = {
        "enterprise_value": "ev", "price_to_earnings_ratio": _div("current_price", "veps"), "price_to_book_ratio": _div("nullif(current_price,0)", "bvps"),
        "price_to_sales_ratio": _div("nullif(current_price,0)", "vrev/nullif(sh,0)"), "enterprise_value_to_ebitda_ratio": _div("ev", "ebitda"), "enterprise_value_to_revenue_ratio": _div("ev", "vrev"),
        "peg_ratio": f"CASE WHEN {g[S.EPS_BASIC]}>0 THEN {_div('current_price/nullif(veps,0)', g[S.EPS_BASIC])} END",
        "gross_margin": _pct(_div(f"{t[S.REVENUE]}-{t['cost_of_revenue']}", t[S.REVENUE])), "ebitda_margin": f"CASE WHEN vdep IS NOT NULL THEN {_pct(_div('ebitda','vrev'))} END",
        "operating_margin": _pct(_div("vebit", "vrev")), "net_margin": _pct(_div(t[S.PAT], "vrev")), "pretax_profit_margin": _pct(_div(t[S.PBT], "vrev")),
        "return_on_equity": _pct(_div("vpat", "aveq")), "return_on_assets": _pct(_div("vpat", "avas")), "effective_tax_rate": _pct("trate"), "return_on_invested_capital": _pct(_div(nopat, "inv_")),
        "asset_turnover": _div("vrev", "assets"), "inventory_turnover": _div("cbase", "inventories"),
        "working_capital_turnover": f"CASE WHEN vrev<>0 AND abs(assets_current-current_liabilities)>=0.01::DOUBLE*abs(vrev) THEN {_div('vrev','assets_current-current_liabilities')} END",
        "current_ratio": _div("assets_current", "current_liabilities"), "quick_ratio": _div("assets_current-coalesce(inventories,0)", "current_liabilities"),
        "days_inventory_outstanding": f"round(365.0::DOUBLE/nullif({_div('cbase','inventories')},0),2)", "days_receivable_outstanding": f"round({dso}*365,2)", "days_payable_outstanding": f"round({dpo}*365,2)",
        "receivables_turnover": f"round(1.0::DOUBLE/nullif({dso},0),4)", "payables_turnover": f"round(1.0::DOUBLE/nullif({dpo},0),4)",
        "capital_expenditure_coverage_ratio": _div("vocf", "vcapex"), "dividend_and_capex_coverage_ratio": _div("vocf", "spend"), "operating_cash_flow_ratio": _div("vocf", "current_liabilities"),
        "operating_cash_flow_sales_ratio": _pct(_div("vocf", "vrev")), "cash_ratio": _div("cash", "current_liabilities"), "financial_leverage_ratio": _div("assets", "eq"), "debt_to_assets_ratio": _div("debt", "assets"),
        "debt_to_equity": _div("debt", "eq"), "interest_coverage": _div("vebit", t[S.FINANCE]), "enterprise_value_to_ebit_ratio": _div("ev", "vebit"), "price_to_operating_cash_flow_ratio": _div("mcap", "vocf"),
        "price_to_free_cash_flow_ratio": _div("mcap", "fcf"),
        "revenue_growth_annual": g[S.REVENUE], "revenue_growth_quarterly_qoq": _gr(S.REVENUE, _Q[S.REVENUE]), "revenue_growth_quarterly_yoy": _gr(S.REVENUE, _Y[S.REVENUE]),
        "earnings_growth_annual": g[S.PAT], "earnings_growth_quarterly_qoq": _gr(S.PAT, _Q[S.PAT]), "earnings_growth_quarterly_yoy": _gr(S.PAT, _Y[S.PAT]),
        "book_value_growth_annual": _gr("nullif(eq,0)", "yeq"), "book_value_growth_quarterly_qoq": _gr("nullif(eq,0)", "qeq"), "book_value_growth_quarterly_yoy": _gr("nullif(eq,0)", "yeq"),
        "earnings_per_share_growth_annual": g[S.EPS_BASIC], "earnings_per_share_growth_quarterly_qoq": _gr(S.EPS_BASIC, _Q[S.EPS_BASIC]), "earnings_per_share_growth_quarterly_yoy": _gr(S.EPS_BASIC, _Y[S.EPS_BASIC]),
        "free_cash_flow_growth_annual": g_fcf, "operating_income_growth_annual": g_op, "ebitda_growth_annual": g_ebitda, "earnings_per_share": "veps", "book_value_per_share": "bvps",
        "free_cash_flow_per_share": _div("fcf", "sh"), "revenue_per_share": _div("vrev", "sh"), "net_income_per_share": _div(t[S.PAT], "sh"), "operating_cash_flow_per_share": _div("vocf", "sh"),
        "capex_per_share": _div("vcapex", "sh"), "cash_per_share": _div("cash", "sh"), "payout_ratio": _pct(_div(f"abs({t['dividends_paid']})", t[S.PAT])), "market_capitalization": "mcap",
        "total_debt": "debt", "total_equity": "nullif(eq,0)", "cash_and_equivalents": "cash",
    }
    assert list(o) == M.METRICS
    meta = f"""period_end_date AS last_quarter_end_date, CASE WHEN annual_end IS NOT NULL THEN strftime(annual_end,'%Y-%m-%d') ELSE {_GUESS} END AS last_annual_end_date,
 CASE WHEN annual_end IS NOT NULL THEN 'filing' WHEN fye_month IS NOT NULL THEN 'inferred' ELSE 'unknown' END AS last_annual_end_date_source,
 CASE WHEN current_price IS NOT NULL THEN 'live' ELSE 'unavailable' END AS price_data, ttm_quarters_used>=4 AS ttm_window_complete, ttm_quarters_used, income_statement_period, balance_sheet_period, cash_flow_period,
 CASE WHEN vocf IS NOT NULL AND vcapex IS NOT NULL THEN 'operating_cash_flow_minus_capex' WHEN vocf IS NOT NULL THEN 'operating_cash_flow_capex_absent' END AS free_cash_flow_source,
 'trailing_annual_eps_growth_pct' AS peg_ratio_growth_basis, current_price"""
    # metric values are named apart from the statement columns they are computed from, then rounded
    view(f"v_{prefix}4", f"SELECT symbol, source, consolidated, rn, {meta}, {', '.join(f'CAST({e} AS DOUBLE) AS z_{n}' for n, e in o.items())} FROM v_{prefix}3")
    plain = ", ".join(M.META_OUT)
    return view(f"v_{prefix}out", f"SELECT symbol, source, consolidated, rn, {plain}, {', '.join(f'{_r2(f'z_{n}')} AS {n}' for n in o)} FROM v_{prefix}4")


_OUT = ", ".join([*S.SERIES_KEY, *M.META_OUT, *M.METRICS])
_TTM = metric_views("mt", "ttm")
_QTR = metric_views("mq", "quarterly")


def _metrics(v, mode="ttm"):
    return M.financial_metrics(v.income, v.balance, v.cashflow, B.latest_price(v.quotes), mode)


@query("metrics", f"SELECT {_OUT} FROM {_TTM} WHERE rn=1")
def metrics(v):
    return _metrics(v)


@query("metrics_quarterly", f"SELECT {_OUT} FROM {_QTR} WHERE rn=1")
def metrics_quarterly(v):
    return _metrics(v, "quarterly")


@query("metrics_per_period", f"""SELECT {_OUT} FROM {_TTM} WHERE last_quarter_end_date >= DATE '1997-01-01' QUALIFY row_number() OVER (PARTITION BY symbol, source, consolidated ORDER BY last_quarter_end_date DESC) <= 8""")
def metrics_per_period(v):
    return M.metrics_per_period(v.income, v.balance, v.cashflow, B.latest_price(v.quotes), gte="1997-01-01", limit=8)


# One registered query per metric group: the columns a user of that metric asks for.
GROUPS = {
    "cash_and_equivalents": ["cash_and_equivalents"],
    "ebit": ["operating_margin", "interest_coverage"],
    "total_debt_equity": ["total_debt", "total_equity"],
    "market_capitalization": ["market_capitalization"],
    "enterprise_value": ["enterprise_value"],
    "earnings_per_share": ["earnings_per_share"],
    "price_to_earnings_ratio": ["price_to_earnings_ratio"],
    "price_to_book_ratio": ["book_value_per_share", "price_to_book_ratio"],
    "price_to_sales_ratio": ["price_to_sales_ratio"],
    "enterprise_value_to_ebitda_ratio": ["enterprise_value_to_ebitda_ratio"],
    "enterprise_value_multiples": ["enterprise_value_to_revenue_ratio", "enterprise_value_to_ebit_ratio"],
    "free_cash_flow": ["free_cash_flow_source", "free_cash_flow_per_share"],
    "peg_ratio": ["peg_ratio", "peg_ratio_growth_basis"],
    "gross_margin": ["gross_margin"],
    "ebitda_margin": ["ebitda_margin"],
    "margins": ["operating_margin", "net_margin", "pretax_profit_margin"],
    "returns": ["return_on_equity", "return_on_assets"],
    "effective_tax_rate": ["effective_tax_rate"],
    "return_on_invested_capital": ["return_on_invested_capital"],
    "asset_turnover": ["asset_turnover"],
    "inventory_turnover": ["inventory_turnover", "days_inventory_outstanding"],
    "working_capital_turnover": ["working_capital_turnover"],
    "liquidity_ratios": ["current_ratio", "quick_ratio", "cash_ratio"],
    "receivables": ["days_receivable_outstanding", "receivables_turnover"],
    "payables": ["days_payable_outstanding", "payables_turnover"],
    "capital_expenditure_coverage_ratio": ["capital_expenditure_coverage_ratio"],
    "dividend_and_capex_coverage_ratio": ["dividend_and_capex_coverage_ratio"],
    "operating_cash_flow_ratios": ["operating_cash_flow_ratio", "operating_cash_flow_sales_ratio"],
    "leverage": ["financial_leverage_ratio", "debt_to_assets_ratio", "debt_to_equity"],
    "interest_coverage": ["interest_coverage"],
    "price_to_cash_flow": ["price_to_operating_cash_flow_ratio", "price_to_free_cash_flow_ratio"],
    "growth": [f"{n}_growth_{p}" for n in ("revenue", "earnings", "earnings_per_share") for p in ("annual", "quarterly_qoq", "quarterly_yoy")],
    "operating_income_growth_annual": ["operating_income_growth_annual"],
    "free_cash_flow_growth_annual": ["free_cash_flow_growth_annual"],
    "ebitda_growth_annual": ["ebitda_growth_annual"],
    "book_value_growth": ["book_value_growth_annual", "book_value_growth_quarterly_qoq", "book_value_growth_quarterly_yoy"],
    "per_share": ["revenue_per_share", "net_income_per_share", "operating_cash_flow_per_share", "capex_per_share", "cash_per_share"],
    "payout_ratio": ["payout_ratio"],
    "metrics_meta": M.META_OUT,
}


def _register_group(name, cols):
    @query(f"metric_{name}" if not name.startswith("metrics") else name, f"SELECT {', '.join([*S.SERIES_KEY, *cols])} FROM {_TTM} WHERE rn=1")
    def build(v):
        return _metrics(v).select(*S.SERIES_KEY, *cols)


for _n, _c in GROUPS.items():
    _register_group(_n, _c)


@query("shares_outstanding", f"""SELECT {SER}, round(coalesce({S.PAID_UP}/nullif({S.FACE},0), weighted_average_shares_basic, any_shares),4) AS shares_outstanding FROM v_cfwd JOIN v_minputs USING ({SER}) WHERE rn=1""")
def shares_outstanding(v):
    inputs = M.series_inputs(_recs(v)).select(*ST.SERIES, "_any_shares", "_latest.*")
    sh = F.coalesce(RT.shares_from_capital(), "weighted_average_shares_basic", "_any_shares")
    return inputs.select(*ST.SERIES, F.round(sh, 4).alias("shares_outstanding"))


view("v_syms", "SELECT 'S'||s_suppkey AS symbol FROM supplier UNION SELECT 'C'||c_custkey FROM customer")


@query("metrics_no_data", "SELECT symbol, false AS data_available FROM v_syms WHERE symbol NOT IN (SELECT symbol FROM v_merged)")
def metrics_no_data(v):
    s = v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    c = v.table("customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"))
    return M.metrics_no_data(s.unionByName(c).distinct(), _quarterly(v.income))


view("v_mlong", "SELECT * FROM (UNPIVOT (SELECT symbol, source, consolidated, {c} FROM {t} WHERE rn=1) ON {c} INTO NAME metric VALUE value) WHERE value IS NOT NULL".format(c=", ".join(M.METRICS), t=_TTM))


@query("metrics_long", "SELECT symbol, source, consolidated, metric, value FROM v_mlong")
def metrics_long(v):
    return M.long_form(_metrics(v), M.METRICS)


@query("metrics_round", f"""SELECT {KEY}, {_r2(_div(S.FINANCE, S.REVENUE))} AS small_ratio, {_r2(_div(S.REVENUE, S.FINANCE))} AS large_ratio FROM v_income""")
def metrics_round(v):
    return v.income.select(*S.STATEMENT_KEY, X.round_metric(X.safe_div(S.FINANCE, S.REVENUE)).alias("small_ratio"), X.round_metric(X.safe_div(S.REVENUE, S.FINANCE)).alias("large_ratio"))


# -- static ratios ---------------------------------------------------------------------------

_EQ = "coalesce(equity_share_capital,0)+coalesce(other_equity,0)"
_EB = f"CASE WHEN {S.PBT} IS NOT NULL OR {S.FINANCE} IS NOT NULL THEN coalesce({S.PBT},0)+coalesce({S.FINANCE},0) END"
_RATIO_SQL = {
    "net_profit_margin": _pct(_div(S.PAT, S.REVENUE)), "operating_margin": _pct(_div(_EB, S.REVENUE)), "pre_tax_margin": _pct(_div(S.PBT, S.REVENUE)), "interest_cost_ratio": _pct(_div(S.FINANCE, S.REVENUE)),
    "roa": _pct(_div(S.PAT, "assets")), "roe": _pct(_div(S.PAT, _EQ)), "roce": _pct(_div(_EB, "coalesce(assets,0)-coalesce(noncurrent_liabilities,0)")),
    "debt_to_equity": f"coalesce(nullif(debt_equity_ratio,0), {_div('coalesce(borrowings_current,0)+coalesce(borrowings_noncurrent,0)', _EQ)})",
    "equity_ratio": _pct(_div(_EQ, "assets")), "financial_leverage": _div("assets", _EQ), "cash_ratio": _div(S.CASH, "borrowings_current"), "operating_cash_flow_ratio": _div(S.OCF, "borrowings_current"),
    "operating_cash_flow_margin": _pct(_div(S.OCF, S.REVENUE)), "ocf_to_net_income": _div(S.OCF, S.PAT),
    "dilution_impact": _pct(_div(f"coalesce({S.EPS_BASIC},0)-coalesce({S.EPS_DILUTED},0)", S.EPS_BASIC)),
}
RATIO_GROUPS = {
    "static_profitability": ["net_profit_margin", "pre_tax_margin", "interest_cost_ratio"],
    "static_operating_margin": ["operating_margin"],
    "static_returns": ["roa", "roe"],
    "static_roce": ["roce"],
    "static_debt_to_equity": ["debt_to_equity"],
    "static_capital_structure": ["equity_ratio", "financial_leverage"],
    "static_liquidity": ["cash_ratio", "operating_cash_flow_ratio"],
    "static_cash_flow": ["operating_cash_flow_margin", "ocf_to_net_income"],
    "static_dilution_impact": ["dilution_impact"],
}


def _register_ratios(name, cols):
    @query(name, f"SELECT {KEY}, {', '.join(f'round({_RATIO_SQL[c]},6) AS static_{c}' for c in cols)} FROM v_cfwd")
    def build(v):
        d = RT.static_ratios(_recs(v), cols)
        return d.select(*S.STATEMENT_KEY, *[F.round(f"static_{c}", 6).alias(f"static_{c}") for c in cols])


for _n, _c in RATIO_GROUPS.items():
    _register_ratios(_n, _c)


@query("ratio_categories_long", " UNION ALL ".join(
    f"SELECT {KEY}, '{RT.registered()[n][0]}' AS category, '{n}' AS ratio, round({e},6) AS value FROM v_cfwd" for n, e in _RATIO_SQL.items()))
def ratio_categories_long(v):
    d = RT.ratio_categories_long(_recs(v), S.STATEMENT_KEY)
    return d.withColumn("value", F.round("value", 6))


_COST = _div("expenses", S.REVENUE)


@query("register_ratio", f"SELECT {KEY}, round({_COST},6) AS user_cost_income, round({_div(_COST, _RATIO_SQL['net_profit_margin'])},6) AS user_cost_per_margin FROM v_cfwd")
def register_ratio(v):
    """Ratios added by a user, one over the statement columns and one over two other ratios; they go again when the plan is made."""
    RT.register_ratio("cost_income", "User", lambda: X.safe_div("expenses", S.REVENUE))
    RT.register_ratio("cost_per_margin", "User", lambda cost, margin: X.safe_div(cost, margin), uses=("cost_income", "net_profit_margin"))
    try:
        d = RT.static_ratios(_recs(v), ["cost_per_margin", "cost_income"], prefix="user_")
    finally:
        RT.unregister_ratio("cost_income", cascade=True)
    return d.select(*S.STATEMENT_KEY, *[F.round(c, 6).alias(c) for c in ("user_cost_income", "user_cost_per_margin")])


@query("static_growth", f"""SELECT a.symbol, a.source, a.consolidated, a.filing_type, a.period_end_date, {_gr('a.revenue_from_operations','b.revenue_from_operations')} AS revenue_growth_qoq,
 {_gr('a.profit_loss_for_period','b.profit_loss_for_period')} AS net_profit_growth_qoq FROM v_merged a LEFT JOIN v_merged b ON a.symbol=b.symbol AND a.source=b.source AND a.consolidated=b.consolidated
 AND date_trunc('month', b.period_end_date) = date_trunc('month', a.period_end_date) - INTERVAL 3 MONTH WHERE a.revenue_from_operations IS NOT NULL""")
def static_growth(v):
    q = _quarterly(v.income)
    r = ST.period_offset(q, S.REVENUE, 3).select(*S.STATEMENT_KEY, X.growth("value", "previous").alias("revenue_growth_qoq"))
    p = ST.period_offset(q, S.PAT, 3).select(*S.STATEMENT_KEY, X.growth("value", "previous").alias("net_profit_growth_qoq"))
    return r.join(p, S.STATEMENT_KEY)


view("v_valin", f"""SELECT c.*, pr.current_price, i.{_T[S.EPS_BASIC]} AS ttm_eps, i.{_rev_t} AS ttm_revenue, {_gr(_T[S.EPS_BASIC], _P[S.EPS_BASIC])} AS eps_growth FROM v_cfwd c JOIN v_minputs i USING ({SER}) LEFT JOIN v_price pr USING (symbol) WHERE rn=1""")
view("v_val", f"""SELECT *, nullif({S.PAID_UP}/nullif({S.FACE},0),0) AS sh, CASE WHEN reserve_excluding_revaluation_reserves IS NOT NULL AND {S.PAID_UP} IS NOT NULL THEN {S.PAID_UP}+reserve_excluding_revaluation_reserves ELSE {_EQ} END AS eqv FROM v_valin""")


@query("valuation", f"""SELECT {SER}, pe_ratio, round(nullif(current_price,0)/nullif(eqv/sh,0),4) AS pb_ratio, round(nullif(current_price,0)/nullif(coalesce(ttm_revenue,revenue_from_operations)/sh,0),4) AS ps_ratio,
 round(nullif(current_price,0)/nullif({S.OCF}/sh,0),4) AS pcf_ratio, CASE WHEN eps_growth>0 AND sh IS NOT NULL THEN round(nullif(pe_ratio,0)/eps_growth,4) END AS peg_ratio FROM (SELECT *, round(nullif(current_price,0)/nullif(coalesce(ttm_eps,{S.EPS_BASIC}),0),4) AS pe_ratio FROM v_val)""")
def valuation(v):
    recs = _recs(v)
    i = M.series_inputs(recs).select(*ST.SERIES, "_newest", F.col(f"_t_{S.EPS_BASIC}").alias("ttm_eps"), F.col(f"_t_{S.REVENUE}").alias("ttm_revenue"),
                                     X.growth(f"_t_{S.EPS_BASIC}", f"_p_{S.EPS_BASIC}").alias("eps_growth"))
    d = recs.join(i, ST.SERIES).filter(F.col("period_end_date") == F.col("_newest"))
    d = d.join(B.latest_price(v.quotes).select("symbol", "current_price"), "symbol", "left")
    return RT.valuation(d).select(*ST.SERIES, "pe_ratio", "pb_ratio", "ps_ratio", "pcf_ratio", "peg_ratio")


