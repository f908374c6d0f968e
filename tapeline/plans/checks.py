"""SQL texts of the derived views, used only to check Spark results.

``with_views(sql)`` puts the views a statement mentions in front of it as common
table expressions, dependencies first.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["v_day"] = """
SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
  CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS sd,
  CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS st,
  max(CAST(l_quantity AS BIGINT)) AS mq, min(CAST(l_quantity AS BIGINT)) AS nq,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
VIEWS["v_walk"] = """
SELECT *, 10000 + CAST(sum(CAST(floor(30.0*(sd-5*n)/n) AS BIGINT)) OVER (PARTITION BY symbol ORDER BY date) AS BIGINT) AS close_t FROM v_day"""
VIEWS["v_open"] = """
SELECT *, lag(close_t,1,10000) OVER (PARTITION BY symbol ORDER BY date) + CAST(floor(10.0*(st-4*n)/n) AS BIGINT) AS open_t FROM v_walk"""
VIEWS["v_bars"] = """
SELECT symbol, date, CAST(open_t AS DOUBLE)/100 AS open, CAST(greatest(open_t,close_t)+mq AS DOUBLE)/100 AS high,
  CAST(least(open_t,close_t)-nq AS DOUBLE)/100 AS low, CAST(close_t AS DOUBLE)/100 AS close, volume FROM v_open"""
VIEWS["v_rn"] = """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rd, count(*) OVER (PARTITION BY symbol) AS n FROM v_bars"""
VIEWS["v_raw_bars"] = """
SELECT symbol, CASE WHEN symbol <= 'PROMO' THEN 'NSE' ELSE 'NASDAQ' END AS exchange,
  CASE WHEN symbol <= 'PROMO' THEN 'in' ELSE 'us' END AS country, date, open, high, low,
  CASE WHEN dayofyear(date) % 101 <> 0 THEN close END AS close, close AS adjusted_close,
  CAST(CASE WHEN dayofyear(date) % 97 = 0 THEN 0 ELSE volume END AS BIGINT) AS volume FROM v_bars"""
VIEWS["v_market_index"] = """
SELECT date, CAST(floor(CAST(sum(CAST(round(close*100) AS BIGINT)) AS DOUBLE)/count(*)) AS DOUBLE)/100 AS close FROM v_bars GROUP BY date
HAVING count(*) = (SELECT count(DISTINCT symbol) FROM v_bars)"""
VIEWS["v_quotes"] = """
SELECT 'S'||l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
 floor(CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)) AS close,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume FROM lineitem GROUP BY 1,2"""
VIEWS["v_fq"] = """
SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INT) AS y, CAST(quarter(l_shipdate) AS INT) AS qn, l_linestatus='F' AS consolidated,
 CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS rev,
 CAST(sum(CAST(round(l_extendedprice*l_discount*100) AS BIGINT)) AS BIGINT) AS fcr,
 CAST(sum(CAST(round(l_extendedprice*l_tax*100) AS BIGINT)) AS BIGINT) AS txr FROM lineitem GROUP BY 1,2,3,4"""
VIEWS["v_fb0"] = """
SELECT k,y,qn,consolidated,rev,fcr,txr,'quarterly' AS filing_type FROM v_fq UNION ALL
SELECT k,y,4,consolidated,CAST(sum(rev) AS BIGINT),CAST(sum(fcr) AS BIGINT),CAST(sum(txr) AS BIGINT),'annual' FROM v_fq GROUP BY k,y,consolidated"""
VIEWS["v_fb"] = """
SELECT 'S'||k AS symbol, CASE WHEN k%2=0 THEN 'SEC' ELSE 'NSE' END AS source, CASE WHEN k%2=0 THEN 'us' ELSE 'in' END AS country,
 consolidated, filing_type, last_day(make_date(y,qn*3,1)) AS period_end_date,
 CASE WHEN filing_type='annual' THEN make_date(y,1,1) ELSE make_date(y,qn*3-2,1) END AS period_start_date,
 'Q'||qn AS fiscal_period, CASE WHEN filing_type='annual' THEN 'annual-results' ELSE 'integrated-filing' END AS source_endpoint,
 CAST(last_day(make_date(y,qn*3,1)) + INTERVAL 45 DAY AS TIMESTAMP) AS pulled_at,
 k, qn, rev, fcr, txr, 1000*(k+1) AS shares, floor(rev*80/100) AS exp_, floor(fcr/10) AS fc_, floor(txr/10) AS tx_ FROM v_fb0"""
_ID = "symbol, source, country, consolidated, filing_type, period_end_date, period_start_date, fiscal_period, source_endpoint, pulled_at"
_EB = "basic_earnings_loss_per_share_from_continuing_and_discontinued_operations"
_ED = "diluted_earnings_loss_per_share_from_continuing_and_discontinued_operations"
_DA = "depreciation_depletion_and_amortisation_expense"
VIEWS["v_income"] = f"""
SELECT {_ID}, CAST(rev AS DOUBLE) AS revenue_from_operations, CAST(CASE WHEN k%11<>0 THEN floor(rev*55/100) END AS DOUBLE) AS cost_of_revenue,
 CAST(exp_ AS DOUBLE) AS expenses, CAST(fc_ AS DOUBLE) AS finance_costs, CAST(CASE WHEN k%13<>0 THEN floor(rev*4/100) END AS DOUBLE) AS {_DA},
 CAST(CASE WHEN source='SEC' THEN rev-exp_ END AS DOUBLE) AS operating_income, CAST(rev-exp_-fc_ AS DOUBLE) AS profit_before_tax,
 CAST(tx_ AS DOUBLE) AS tax_expense, CAST(rev-exp_-fc_-tx_ AS DOUBLE) AS profit_loss_for_period,
 CAST(rev-exp_-fc_-tx_ AS DOUBLE)/shares AS {_EB}, CAST(rev-exp_-fc_-tx_ AS DOUBLE)/(1050*(k+1)) AS {_ED},
 CAST(CASE WHEN k%2=0 THEN shares END AS DOUBLE) AS weighted_average_shares_basic FROM v_fb"""
VIEWS["v_balance"] = f"""
SELECT {_ID},
 CAST(CASE WHEN NOT stub THEN rev*4 END AS DOUBLE) AS assets, CAST(CASE WHEN NOT stub THEN floor(rev*180/100) END AS DOUBLE) AS assets_current,
 CAST(CASE WHEN NOT stub THEN rev*4-floor(rev*180/100) END AS DOUBLE) AS noncurrent_assets,
 CAST(CASE WHEN NOT stub THEN shares*10 END AS DOUBLE) AS equity_share_capital, CAST(CASE WHEN NOT stub THEN floor(rev*150/100) END AS DOUBLE) AS other_equity,
 CAST(CASE WHEN NOT stub THEN floor(rev*30/100) END AS DOUBLE) AS borrowings_current, CAST(CASE WHEN NOT stub THEN floor(rev*70/100) END AS DOUBLE) AS borrowings_noncurrent,
 CAST(CASE WHEN NOT stub THEN floor(rev*90/100) END AS DOUBLE) AS noncurrent_liabilities, CAST(CASE WHEN NOT stub THEN floor(rev*110/100) END AS DOUBLE) AS current_liabilities,
 CAST(CASE WHEN NOT stub AND k%7<>0 THEN floor(rev*25/100) END AS DOUBLE) AS inventories, CAST(CASE WHEN NOT stub THEN floor(rev*35/100) END AS DOUBLE) AS trade_receivables_current,
 CAST(CASE WHEN NOT stub THEN floor(rev*20/100) END AS DOUBLE) AS trade_payables, CAST(CASE WHEN NOT stub THEN floor(rev*15/100) END AS DOUBLE) AS cash_and_cash_equivalents,
 CAST(CASE WHEN NOT stub AND k%4<>1 THEN floor(rev*2/100) END AS DOUBLE) AS bank_balance_other_than_cash_and_cash_equivalents,
 CAST(CASE WHEN NOT stub AND k%3=0 THEN floor(rev*140/100) END AS DOUBLE) AS reserve_excluding_revaluation_reserves,
 CAST(shares*10 AS DOUBLE) AS paid_up_value_of_equity_share_capital, CAST(CASE WHEN k%17<>0 THEN 10 END AS DOUBLE) AS face_value_of_equity_share_capital,
 CASE WHEN k%9=0 THEN CAST(0.007 AS DOUBLE) END AS debt_equity_ratio
FROM (SELECT *, (k%5=0 AND qn=4) AS stub FROM v_fb WHERE qn IN (2,4))"""
VIEWS["v_cashflow"] = f"""
SELECT {_ID}, CAST(floor(rev*22/100) AS DOUBLE) AS cash_flows_from_used_in_operating_activities,
 CAST(CASE WHEN k%3<>0 THEN -floor(rev*9/100) END AS DOUBLE) AS payments_for_purchase_of_noncurrent_assets,
 CAST(CASE WHEN k%4<>3 THEN -floor(rev*3/100) END AS DOUBLE) AS dividends_paid FROM v_fb WHERE qn=4"""
VIEWS["v_facts_in"] = """
SELECT symbol, consolidated, period_start_date AS s, period_end_date AS e, make_date(year(period_end_date),1,1) AS ys,
 CAST(revenue_from_operations AS BIGINT) AS r, CAST(profit_loss_for_period AS BIGINT) AS p, CAST(finance_costs AS BIGINT) AS f FROM v_income WHERE filing_type='quarterly'"""
VIEWS["v_facts"] = """
SELECT symbol||'|'||e||'|'||consolidated AS filing_id, symbol, e AS period_end, CASE WHEN consolidated THEN 'integrated-filing' ELSE 'annual-results' END AS category,
 u.ord, u.tag, u.value, u.context_ref, u.start_date, u.end_date, u.instant_date FROM (SELECT *, unnest([
 {'ord':1,'tag':'RevenueFromOperations','value':r::VARCHAR,'context_ref':'OneD','start_date':s,'end_date':e,'instant_date':NULL::DATE},
 {'ord':2,'tag':'RevenueFromOperations','value':(r*4)::VARCHAR,'context_ref':'FourD','start_date':ys,'end_date':e,'instant_date':NULL::DATE},
 {'ord':3,'tag':'ProfitLossForPeriod','value':p::VARCHAR,'context_ref':'OneD','start_date':s,'end_date':e,'instant_date':NULL::DATE},
 {'ord':4,'tag':'ProfitLossForPeriod','value':(p*4)::VARCHAR,'context_ref':'FourD','start_date':ys,'end_date':e,'instant_date':NULL::DATE},
 {'ord':5,'tag':'FinanceCosts','value':f::VARCHAR,'context_ref':'CustomA','start_date':e-91,'end_date':e,'instant_date':NULL::DATE},
 {'ord':6,'tag':'FinanceCosts','value':(f*4)::VARCHAR,'context_ref':'CustomB','start_date':e-364,'end_date':e,'instant_date':NULL::DATE},
 {'ord':7,'tag':'Assets','value':(r*4)::VARCHAR,'context_ref':'OneI','start_date':NULL::DATE,'end_date':NULL::DATE,'instant_date':e},
 {'ord':8,'tag':'Assets','value':(r*3)::VARCHAR,'context_ref':'PriorI','start_date':NULL::DATE,'end_date':NULL::DATE,'instant_date':e-90},
 {'ord':9,'tag':'CashFlowsFromUsedInOperatingActivities','value':(r*2)::VARCHAR,'context_ref':'FourD','start_date':ys,'end_date':e,'instant_date':NULL::DATE},
 {'ord':10,'tag':'PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities','value':(f*-2)::VARCHAR,'context_ref':'FourD','start_date':ys,'end_date':e,'instant_date':NULL::DATE},
 {'ord':11,'tag':'PurchaseOfIntangibleAssetsClassifiedAsInvestingActivities','value':(f*-1)::VARCHAR,'context_ref':'FourD','start_date':ys,'end_date':e,'instant_date':NULL::DATE},
 {'ord':12,'tag':'DescriptionOfSegmentPolicy','value':'n/a','context_ref':'OneD','start_date':s,'end_date':e,'instant_date':NULL::DATE},
 {'ord':13,'tag':'DebtEquityRatio','value':'0.5','context_ref':'NoDates','start_date':NULL::DATE,'end_date':NULL::DATE,'instant_date':NULL::DATE}]) AS u FROM v_facts_in)"""
VIEWS["v_ytd"] = """
SELECT symbol, period_end_date, qn, k, shares, CASE WHEN qn=4 THEN '10-K' ELSE '10-Q' END AS form,
 CAST(sum(rev) OVER w AS BIGINT) AS rev, CAST(sum(fcr) OVER w AS BIGINT) AS fcr, CAST(sum(txr) OVER w AS BIGINT) AS txr
FROM v_fb WHERE filing_type='quarterly' AND consolidated AND source='SEC'
WINDOW w AS (PARTITION BY symbol, year(period_end_date) ORDER BY period_end_date ROWS UNBOUNDED PRECEDING)"""
VIEWS["v_concepts"] = """
SELECT symbol, form, period_end, u.statement, u.concept, CAST(u.value AS DOUBLE) AS value FROM (SELECT symbol, form, period_end_date AS period_end, unnest([
 {'statement':'income','concept':'us-gaap_RevenueFromContractWithCustomerExcludingAssessedTax','value':CASE WHEN k%4=0 THEN rev END},
 {'statement':'income','concept':'us-gaap_Revenues','value':CASE WHEN k%4<>0 THEN rev END},
 {'statement':'income','concept':'us-gaap_NetIncomeLoss','value':rev-floor(rev*80/100)-floor(fcr/10)-floor(txr/10)},
 {'statement':'income','concept':'us-gaap_InterestExpense','value':floor(fcr/10)},
 {'statement':'income','concept':'us-gaap_CostOfRevenue','value':CASE WHEN k%6<>0 THEN floor(rev*55/100) END},
 {'statement':'income','concept':'us-gaap_OperatingIncomeLoss','value':rev-floor(rev*80/100)},
 {'statement':'income','concept':'us-gaap_WeightedAverageNumberOfSharesOutstandingBasic','value':shares},
 {'statement':'income','concept':'us-gaap_WeightedAverageNumberOfDilutedSharesOutstanding','value':1050*(k+1)},
 {'statement':'income','concept':'us-gaap_DepreciationDepletionAndAmortization','value':CASE WHEN k%8=0 THEN floor(rev*4/100) END},
 {'statement':'cashflow','concept':'us-gaap_NetCashProvidedByUsedInOperatingActivities','value':floor(rev*22/100)},
 {'statement':'cashflow','concept':'us-gaap_PaymentsToAcquirePropertyPlantAndEquipment','value':floor(rev*9/100)},
 {'statement':'cashflow','concept':'us-gaap_Depreciation','value':floor(rev*3/100)},
 {'statement':'cashflow','concept':'us-gaap_AmortizationOfIntangibleAssets','value':CASE WHEN k%3=0 THEN floor(rev*1/100) END},
 {'statement':'balance','concept':'us-gaap_Assets','value':rev*4},
 {'statement':'balance','concept':'us-gaap_CommonStockValue','value':CASE WHEN k%3<>0 THEN shares*10 END},
 {'statement':'balance','concept':'us-gaap_StockholdersEquity','value':shares*10+floor(rev*150/100)},
 {'statement':'balance','concept':'us-gaap_LiabilitiesAndStockholdersEquity','value':rev*4},
 {'statement':'balance','concept':'us-gaap_Liabilities','value':rev*4-shares*10-floor(rev*152/100)}]) AS u FROM v_ytd) WHERE u.value IS NOT NULL"""
VIEWS["v_news"] = """
SELECT doc_id, CASE WHEN lang='en' THEN 'us' ELSE 'in' END AS country, source, md5(text) AS url, substring(text,1,80) AS title, substring(text,81) AS summary,
 TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INT)) AS published_at, text FROM documents"""
VIEWS["v_requests"] = """
SELECT user_id AS key, ts, 'GET' AS method, event_type AS route, CASE WHEN event_type='error' THEN 500 ELSE 200 END AS status, value AS latency_ms, event_id FROM events"""
VIEWS["v_options"] = """
SELECT p_type AS underlying, p_size*100 AS strike, last_day(make_date(CAST(year(l_shipdate) AS INT),CAST(quarter(l_shipdate)*3 AS INT),1)) AS expiry,
 CASE l_returnflag WHEN 'A' THEN 'CE' WHEN 'R' THEN 'PE' ELSE 'XX' END AS option_type, CAST(l_quantity AS BIGINT) AS oi, CAST(l_linenumber AS BIGINT) AS doi,
 l_orderkey*10+l_linenumber AS ord, CAST(round(l_extendedprice*100) AS BIGINT) AS value_minor FROM lineitem JOIN part ON l_partkey=p_partkey"""
VIEWS["v_members"] = """
SELECT r_name AS index_name, 'S'||s_suppkey AS symbol, CASE WHEN s_suppkey%2=0 THEN 'NASDAQ' ELSE 'NSE' END AS exchange,
 CASE WHEN s_suppkey%2=0 THEN 'us' ELSE 'in' END AS country, n_name AS industry
FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey"""
VIEWS["v_meta"] = """
SELECT 'S'||s_suppkey AS symbol, CASE WHEN s_suppkey%2=0 THEN CASE WHEN s_suppkey%6=0 THEN 'NYSE' END ELSE 'NSE' END AS exchange,
 CASE WHEN s_suppkey%2=0 THEN 'us' ELSE 'in' END AS country FROM supplier"""
VIEWS["v_insider"] = """
SELECT c_mktsegment AS company, o_custkey AS insider, CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice) AS BIGINT) AS remaining_shares, o_orderkey AS ord
FROM orders JOIN customer ON o_custkey=c_custkey"""
VIEWS["v_growth"] = """
SELECT symbol, period_end_date, last, prev, round((last-prev)/nullif(prev,0)*100,4) AS change_pct FROM (
 SELECT symbol, period_end_date, revenue_from_operations AS last, lead(revenue_from_operations) OVER w AS prev, row_number() OVER w AS rn
 FROM v_income WHERE filing_type='quarterly' AND consolidated WINDOW w AS (PARTITION BY symbol ORDER BY period_end_date DESC)) WHERE rn=1"""


def view(name: str, sql: str) -> str:
    """Add a view for the checks of one module."""
    if name in VIEWS:
        raise ValueError(f"view {name!r} defined twice")
    VIEWS[name] = sql
    return name


def _plain_zero(sql: str) -> str:
    """``round`` may give -0.0 in the checking engine; adding 0 makes it plain."""
    out, pos = [], 0
    for m in re.finditer(r"\bround\(", sql):
        before = sql[: m.start()].rstrip()[-1:]
        out.append(sql[pos : m.start()])
        out.append("" if before in "*/-+%|" and before else "0+")
        pos = m.start()
    out.append(sql[pos:])
    return "".join(out)


def with_views(sql: str) -> str:
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\bv_\w+\b", text))):
            if name in VIEWS and name not in seen:
                seen.add(name)
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    if not order:
        return _plain_zero(sql)
    parts = [f"{n} AS ({VIEWS[n]})" if n.startswith("v_rec_") else f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order]
    recursive = any(n.startswith("v_rec_") for n in order)
    body = sql.strip()
    own = re.match(r"WITH\s+(?!RECURSIVE)", body)
    tail = ",\n" + body[own.end() :] if own else "\n" + body
    return _plain_zero(("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + tail)
