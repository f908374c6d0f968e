"""Index, flow, option-chain, insider and list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import scalars as X
from tapeline.operators import market as MK
from tapeline.operators import quality as QL
from tapeline.operators import text as TX
from tapeline.plans.checks import view
from tapeline.registry import query
from tapeline.sources import schema as S

# -- index snapshots ----------------------------------------------------------------

view("v_snap", """SELECT m.index_name AS symbol, 'Index '||m.index_name AS name, CAST(sum(g.last) AS BIGINT) AS last, CAST(sum(g.prev) AS BIGINT) AS prev, CAST(max(g.last) AS BIGINT) AS hi, CAST(min(g.last) AS BIGINT) AS lo,
 count(*) FILTER (g.change_pct>0) AS adv, count(*) FILTER (g.change_pct<0) AS dec FROM v_members m JOIN v_growth g USING (symbol) GROUP BY 1""")
_SNAP = """SELECT symbol, name, CAST(last AS DOUBLE) AS last, CASE WHEN symbol='ASIA' THEN NULL ELSE round((last-prev)*100.0::DOUBLE/prev,4) END AS change_pct, CAST(prev AS DOUBLE) AS open, CAST(hi AS DOUBLE) AS high, CAST(lo AS DOUBLE) AS low,
 CAST(prev AS DOUBLE) AS previous_close, CAST(hi AS DOUBLE) AS year_high, CAST(lo AS DOUBLE) AS year_low, CAST(adv+10 AS DOUBLE) AS pe, CAST(dec+1 AS DOUBLE) AS pb, CAST(NULL AS DOUBLE) AS dy, CAST(adv AS DOUBLE) AS advances, CAST(dec AS DOUBLE) AS declines,
 CAST(NULL AS DOUBLE) AS per_change_30d, CAST(adv-dec AS DOUBLE) AS per_change_365d FROM v_snap"""
view("v_snapshot", _SNAP)


def snapshot_json(v):
    """One JSON document per index, as an index feed delivers it ('-' for a missing number)."""
    g = v.index_members.join(v.quarter_growth, "symbol").groupBy("index_name").agg(
        F.sum("last").cast("bigint").alias("last"), F.sum("prev").cast("bigint").alias("prev"), F.max("last").cast("bigint").alias("hi"), F.min("last").cast("bigint").alias("lo"),
        F.count_if(F.col("change_pct") > 0).alias("adv"), F.count_if(F.col("change_pct") < 0).alias("dec"))
    chg = F.round((F.col("last") - F.col("prev")) * F.lit(100.0) / F.col("prev"), 4).cast("string")
    return g.select(F.to_json(F.struct(
        F.col("index_name").alias("indexSymbol"), F.concat(F.lit("Index "), "index_name").alias("index"), F.col("last"),
        F.when(F.col("index_name") == "ASIA", "-").otherwise(chg).alias("percentChange"), F.col("prev").alias("open"), F.col("hi").alias("high"), F.col("lo").alias("low"),
        F.col("prev").alias("previousClose"), F.col("hi").alias("yearHigh"), F.col("lo").alias("yearLow"), (F.col("adv") + 10).alias("pe"), (F.col("dec") + 1).alias("pb"),
        F.lit("n/a").alias("dy"), F.col("adv").alias("advances"), F.col("dec").alias("declines"), (F.col("adv") - F.col("dec")).alias("perChange365d"))).alias("body"))


def _snapshot(v):
    return MK.index_snapshot(snapshot_json(v))


@query("scan_index_snapshot", "SELECT * FROM v_snapshot")
def scan_index_snapshot(v):
    return _snapshot(v)


@query("index_list", "SELECT symbol, name, last, change_pct FROM v_snapshot WHERE symbol IS NOT NULL")
def index_list(v):
    return _snapshot(v).filter(F.col("symbol").isNotNull()).select("symbol", "name", "last", "change_pct")


@query("index_quote", """SELECT n.n_name AS asked, s.symbol, s.last, s.change_pct, CASE WHEN s.symbol IS NULL THEN 'index '''||upper(trim(n.n_name))||''' not found; closest match: '||(SELECT min(symbol) FROM v_snapshot) END AS error
 FROM (SELECT n_name FROM nation UNION ALL SELECT ' '||lower(r_name)||' ' FROM region) n LEFT JOIN v_snapshot s ON s.symbol=upper(trim(n.n_name))""")
def index_quote(v):
    asked = v.table("nation").select(F.col("n_name").alias("asked")).unionByName(v.table("region").select(F.concat(F.lit(" "), F.lower("r_name"), F.lit(" ")).alias("asked")))
    return MK.index_quote(_snapshot(v), asked)


@query("filter_top_indices", "SELECT symbol, last, change_pct FROM v_snapshot WHERE upper(symbol) IN ('ASIA','EUROPE','AMERICA')")
def filter_top_indices(v):
    return _snapshot(v).filter(F.upper("symbol").isin("ASIA", "EUROPE", "AMERICA")).select("symbol", "last", "change_pct")


@query("index_constituents", "SELECT index_name, symbol, industry, count(*) OVER (PARTITION BY index_name) AS constituents FROM v_members")
def index_constituents(v):
    n = v.index_members.groupBy("index_name").agg(F.count(F.lit(1)).alias("constituents"))
    return v.index_members.select("index_name", "symbol", "industry").join(n, "index_name")


@query("index_membership_count", "SELECT index_name, count(*) AS symbols FROM v_members GROUP BY 1")
def index_membership_count(v):
    return v.index_members.groupBy("index_name").agg(F.count(F.lit(1)).alias("symbols"))


@query("market_breadth", "SELECT index_name, count(*) FILTER (change_pct>0) AS advances, count(*) FILTER (change_pct<0) AS declines FROM v_members JOIN v_growth USING (symbol) GROUP BY 1")
def market_breadth(v):
    return MK.market_breadth(v.index_members, v.quarter_growth)


@query("top_movers", """SELECT symbol, change_pct, last, 'gainer' AS side FROM (SELECT * FROM v_growth WHERE change_pct IS NOT NULL ORDER BY change_pct DESC, symbol LIMIT 5)
 UNION ALL SELECT symbol, change_pct, last, 'loser' FROM (SELECT * FROM v_growth WHERE change_pct IS NOT NULL ORDER BY change_pct, symbol LIMIT 5)""")
def top_movers(v):
    return MK.top_movers(v.quarter_growth).select("symbol", "change_pct", "last", "side")


_SER = """WITH s AS (SELECT date, close, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM v_market_index {w}), t AS (SELECT * FROM s WHERE n<=500 OR (rn-1)%CAST(ceil(n/500.0) AS BIGINT)=0 OR rn=n)
 SELECT 'INDEX' AS symbol, date, {c}, n AS bars_available, count(*) OVER () < n AS downsampled FROM t"""


def _index_series(v):
    return v.market_index.withColumn("symbol", F.lit("INDEX"))


@query("index_history", _SER.format(w="WHERE date>=DATE '1996-01-01'", c="close"))
def index_history(v):
    return MK.series_payload(_index_series(v), "1996-01-01").select("symbol", "date", "close", "bars_available", "downsampled")


@query("index_valuation", _SER.format(w="", c="round(close/10,4) AS pe, round(close/40,6) AS pb"))
def index_valuation(v):
    d = MK.series_payload(_index_series(v))
    return d.select("symbol", "date", F.round(F.col("close") / 10, 4).alias("pe"), F.round(F.col("close") / 40, 6).alias("pb"), "bars_available", "downsampled")


@query("index_returns", _SER.format(w="WHERE date<=DATE '1999-12-31'", c="round(close*1.1::DOUBLE,4) AS total_return_index"))
def index_returns(v):
    d = MK.series_payload(_index_series(v), None, "1999-12-31")
    return d.select("symbol", "date", F.round(F.col("close") * 1.1, 4).alias("total_return_index"), "bars_available", "downsampled")


@query("market_valuation", """SELECT 'S'||l_suppkey AS symbol, TRY_CAST(CASE WHEN l_suppkey%7=0 THEN '-' ELSE CAST(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS VARCHAR) END AS DOUBLE) AS pe,
 (SELECT max(strftime(l_shipdate,'%Y-%m-%d')) FROM lineitem) AS trade_date FROM lineitem GROUP BY l_suppkey""")
def market_valuation(v):
    li = v.table("lineitem")
    rows = li.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).cast("string").alias("q"), F.date_format(F.max("l_shipdate"), " yyyy-MM-dd ").alias("DATE"))
    rows = rows.select(F.concat(F.lit(" S"), "l_suppkey").alias("SYMBOL"), "DATE", F.when(F.col("l_suppkey") % 7 == 0, "-").otherwise(F.col("q")).alias("P/E"))
    return MK.market_valuation(rows)


# -- flows, turnover, rates -------------------------------------------------------------

view("v_flows", """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'fii/fpi **' WHEN '2-HIGH' THEN 'dii **' ELSE o_orderpriority END AS category, date_trunc('month', o_orderdate) AS m,
 CAST(sum(CASE WHEN o_orderstatus='F' THEN CAST(round(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN o_orderstatus<>'F' THEN CAST(round(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS s FROM orders GROUP BY 1,2""")
_FL = """SELECT CASE WHEN upper(category) LIKE '%FII%' THEN 'FII' ELSE upper(category) END AS category, strftime(m,'%Y-%m-%d') AS date, CAST(b AS DOUBLE) AS equity_buy_crore, CAST(s AS DOUBLE) AS equity_sell_crore, CAST(b-s AS DOUBLE) AS equity_net_crore FROM v_flows"""
view("v_flowrows", _FL)


def flow_feed(v):
    """Buy and sell values per investor category and month, as texts of a flow feed."""
    o = v.table("orders")
    p, amount = F.col("o_orderpriority"), F.round("o_totalprice").cast("bigint")
    g = o.groupBy(F.when(p == "1-URGENT", "fii/fpi **").when(p == "2-HIGH", "dii **").otherwise(p).alias("category"), F.trunc("o_orderdate", "MM").alias("m")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", amount).otherwise(0)).alias("b"), F.sum(F.when(F.col("o_orderstatus") != "F", amount).otherwise(0)).alias("s"))
    txt = lambda c: c.cast("string")
    return g.select("category", F.date_format("m", "dd-MMM-yyyy").alias("date"), txt(F.col("b")).alias("buyValue"), txt(F.col("s")).alias("sellValue"), txt(F.col("b") - F.col("s")).alias("netValue"))


@query("flows_by_category", "SELECT * FROM v_flowrows")
def flows_by_category(v):
    return MK.flows_by_category(flow_feed(v))


view("v_seg", """SELECT segment, max(volume) FILTER (date=td AND segment<>'PROMO') AS tv, max(value) FILTER (date=td AND segment<>'PROMO') AS tval, max(volume) FILTER (date=td-1) AS yv, max(value) FILTER (date=td-1) AS yval FROM
 (SELECT p_type AS segment, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2),
 (SELECT CAST(max(l_shipdate) AS DATE) AS td FROM lineitem) WHERE date>=td-1 GROUP BY 1""")
_TO = """SELECT segment, CASE WHEN tv IS NOT NULL THEN td ELSE td-1 END AS date, CAST(coalesce(tv,yv) AS DOUBLE) AS volume, round(coalesce(tval,yval)/1e7::DOUBLE,2) AS value_crore, CAST(coalesce(tv,yv)*2 AS DOUBLE) AS open_interest FROM v_seg, (SELECT CAST(max(l_shipdate) AS DATE) AS td FROM lineitem)"""
view("v_turnover", _TO)


def turnover_rows(v):
    """Turnover per segment from today's and yesterday's trades (one segment has no rows today)."""
    li = v.table("lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_extendedprice")
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("segment"))
    d = li.withColumn("td", li.agg(F.max("date")).scalar()).filter(F.col("date") >= F.date_sub("td", 1))
    g = d.join(part, "l_partkey").groupBy("segment", "date", "td").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("volume"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("value"))
    rec = F.struct(F.col("volume").cast("double").alias("volume"), F.col("value").cast("double").alias("value"), (F.col("volume") * 2).cast("double").alias("open_interest"))
    g = g.groupBy("segment", "td").agg(F.max_by(rec, F.when((F.col("date") == F.col("td")) & (F.col("segment") != "PROMO"), 1)).alias("today"),
                                       F.max_by(rec, F.when(F.col("date") < F.col("td"), 1)).alias("yesterday"))
    pick = lambda f: F.when(F.col("today").isNotNull(), F.col(f"today.{f}")).otherwise(F.col(f"yesterday.{f}"))
    return g, pick


@query("turnover_by_segment", "SELECT * FROM v_turnover")
def turnover_by_segment(v):
    g, pick = turnover_rows(v)
    return g.select("segment", F.when(F.col("today").isNotNull(), F.col("td")).otherwise(F.date_sub("td", 1)).alias("date"), pick("volume").alias("volume"),
                    X.crore(pick("value")).alias("value_crore"), pick("open_interest").alias("open_interest"))


@query("crore", "SELECT symbol, source, period_end_date, consolidated, filing_type, round(revenue_from_operations/1e7::DOUBLE,2) AS revenue_crore FROM v_income")
def crore(v):
    return v.income.select("symbol", "source", "period_end_date", "consolidated", "filing_type", X.crore(S.REVENUE).alias("revenue_crore"))


_RN = list(MK.RATE_KEYS)
_RATE_CASE = "CASE " + " ".join(f"WHEN o_orderkey%12={i} THEN '{n}'" for i, n in enumerate(_RN)) + " ELSE 'Other' END"
view("v_ratefeed", f"""SELECT o_orderpriority AS provider, {_RATE_CASE} AS name, max(CAST(round(o_totalprice) AS BIGINT)%1000) AS r FROM orders GROUP BY 1,2""")


def rate_feed(v):
    """Named rates as percent texts, per provider."""
    key = F.col("o_orderkey") % 12
    name = F.lit("Other")
    for i, n in enumerate(_RN):
        name = F.when(key == i, F.lit(n)).otherwise(name)
    g = v.table("orders").groupBy(F.col("o_orderpriority").alias("provider"), name.alias("name")).agg(F.max(F.round("o_totalprice").cast("bigint") % 1000).alias("r"))
    return g.select("provider", "name", F.concat(F.format_string("%.2f", F.col("r") / 100), F.lit("%")).alias("value"))


@query("rate_percent_text", f"SELECT provider, {', '.join(f'max(r/100.0::DOUBLE) FILTER (name={chr(39)}{n}{chr(39)}) AS {c}' for n, c in MK.RATE_KEYS.items())} FROM v_ratefeed GROUP BY 1")
def rate_percent_text(v):
    return MK.rates_row(rate_feed(v), ["provider"])


@query("regex_extract_rate", """SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN CAST(CAST(round(o_totalprice) AS BIGINT)%1000 AS VARCHAR)||'.5%' END AS t_bill_rate FROM orders""")
def regex_extract_rate(v):
    o = v.table("orders")
    r = (F.round("o_totalprice").cast("bigint") % 1000).cast("string")
    txt = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Repo 6.5% | 91 Day\nT-Bills yield "), r, F.lit(".5% as of 7%"))).otherwise(F.lit("Repo 6.5% only"))
    d = o.select("o_orderkey", txt.alias("t"))
    return d.select("o_orderkey", X.extract_rate("t", "91.*?day.*?T-bill[s]?").alias("t_bill_rate"))


@query("macro_overview", """SELECT i.symbol, i.last, i.change_pct, f.fii AS fii_net_crore, f.dii AS dii_net_crore, f.d AS flows_date, t.value_crore AS turnover_cash_crore, r.rr AS policy_repo_rate_pct FROM v_snapshot i,
 (SELECT max(date) AS d, sum(equity_net_crore) FILTER (category='FII' AND date=md) AS fii, sum(equity_net_crore) FILTER (category LIKE 'DII%' AND date=md) AS dii FROM v_flowrows, (SELECT max(date) AS md FROM v_flowrows)) f,
 (SELECT value_crore FROM v_turnover WHERE segment='STANDARD') t, (SELECT max(r/100.0::DOUBLE) FILTER (name='Policy Repo Rate') AS rr FROM v_ratefeed) r WHERE i.symbol IN ('ASIA','EUROPE','AMERICA')""")
def macro_overview(v):
    """Main indices beside the latest flows, cash turnover and policy rate (each a scalar subquery)."""
    flows = MK.flows_by_category(flow_feed(v))
    newest = flows.groupBy("date").agg(F.sum(F.when(F.col("category") == "FII", F.col("equity_net_crore"))).alias("fii_net_crore"),
                                       F.sum(F.when(F.col("category").startswith("DII"), F.col("equity_net_crore"))).alias("dii_net_crore"))
    newest = newest.agg(F.max(F.struct("date", "fii_net_crore", "dii_net_crore"))).scalar()
    cash = turnover_by_segment(v).agg(F.max(F.when(F.col("segment") == "STANDARD", F.col("value_crore")))).scalar()
    repo = rate_feed(v).agg(F.max(F.when(F.col("name") == "Policy Repo Rate", X.rate_text("value")))).scalar()
    d = _snapshot(v).filter(F.upper("symbol").isin("ASIA", "EUROPE", "AMERICA")).select("symbol", "last", "change_pct")
    d = d.withColumns({"_flows": newest, "turnover_cash_crore": cash, "policy_repo_rate_pct": repo})
    return d.select("symbol", "last", "change_pct", F.col("_flows.date").alias("flows_date"), "_flows.fii_net_crore", "_flows.dii_net_crore", "turnover_cash_crore", "policy_repo_rate_pct")


# -- options and insiders --------------------------------------------------------------------

@query("filter_valid_option_rows", "SELECT underlying, strike, expiry, option_type, oi, doi, ord, value_minor FROM v_options WHERE strike<>0 AND option_type<>'XX'")
def filter_valid_option_rows(v):
    return MK.valid_options(v.option_chain)


_lastby = lambda t, c: f"max_by({c}, {{'o':ord,'a':oi,'b':doi}}) FILTER (option_type='{t}')"
view("v_pairs", f"""SELECT underlying, strike, expiry, {_lastby('CE','oi')} AS ce_oi, {_lastby('CE','doi')} AS ce_doi, {_lastby('PE','oi')} AS pe_oi, {_lastby('PE','doi')} AS pe_doi, min(ord) AS first_ord, max(ord) AS last_ord
 FROM v_options WHERE strike<>0 AND option_type<>'XX' GROUP BY 1,2,3""")


@query("option_pair", "SELECT underlying, strike, expiry, ce_oi, ce_doi, pe_oi, pe_doi, first_ord, last_ord FROM v_pairs")
def option_pair(v):
    return MK.option_pair(v.option_chain)


@query("option_chain_stats", """SELECT underlying, min_by(expiry, {'f':first_ord,'e':expiry}) AS expiry_date, CAST(sum(coalesce(ce_oi,0)+coalesce(pe_oi,0)) AS BIGINT) AS total_oi_lots,
 round(sum(coalesce(ce_doi,0)+coalesce(pe_doi,0))/(sum(coalesce(ce_oi,0)+coalesce(pe_oi,0))-sum(coalesce(ce_doi,0)+coalesce(pe_doi,0)))*100,2) AS change_oi_pct, round(sum(coalesce(pe_oi,0))/sum(coalesce(ce_oi,0)),4) AS put_call_ratio,
 max_by(strike, {'o':coalesce(ce_oi,0)+coalesce(pe_oi,0),'f':-first_ord}) AS maxpain FROM v_pairs GROUP BY 1""")
def option_chain_stats(v):
    return MK.option_chain_stats(MK.option_pair(v.option_chain))


view("v_holdings", """SELECT company, CAST(sum(held) AS BIGINT) AS insider_shares, max(date) AS as_of FROM (SELECT company, insider, max_by(remaining_shares, {'d':date,'o':ord}) AS held, max(date) AS date FROM v_insider GROUP BY 1,2) GROUP BY 1""")


@query("insider_holdings", "SELECT * FROM v_holdings")
def insider_holdings(v):
    return MK.insider_holdings(v.insider_tx)


@query("insider_pct", """SELECT company, insider_shares, as_of, shares_outstanding, round(least(insider_shares/nullif(shares_outstanding,0)*100,100),2) AS insider_ownership_pct FROM v_holdings LEFT JOIN
 (SELECT c_mktsegment AS company, CASE WHEN c_mktsegment<>'BUILDING' THEN CAST(sum(CAST(round(c_acctbal*100) AS BIGINT)) AS BIGINT)*CASE WHEN c_mktsegment='FURNITURE' THEN 0 ELSE 3 END END AS shares_outstanding FROM customer GROUP BY 1) USING (company)""")
def insider_pct(v):
    c = v.table("customer").groupBy(F.col("c_mktsegment").alias("company")).agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("s"))
    n = F.when(F.col("company") == "FURNITURE", 0).otherwise(3)
    shares = c.select("company", F.when(F.col("company") != "BUILDING", F.col("s") * n).alias("shares_outstanding"))
    return MK.insider_pct(MK.insider_holdings(v.insider_tx), shares)


# -- lists and symbols --------------------------------------------------------------------------

@query("scan_index_list", """SELECT index_name, symbol, CASE WHEN CAST(substring(symbol,2) AS BIGINT)%3=0 THEN 'NSE' ELSE exchange END AS exchange, CASE WHEN CAST(substring(symbol,2) AS BIGINT)%3=2 THEN upper(country) ELSE 'IN' END AS country FROM v_members""")
def scan_index_list(v):
    """List lines with one, two or three fields, blank lines and comments, parsed back to rows."""
    k = F.substring("symbol", 2, 20).cast("bigint")
    line = F.concat(F.lit("  "), F.lower("symbol"), F.when(k % 3 != 0, F.concat(F.lit("   "), F.col("exchange"))).otherwise(F.lit("")),
                    F.when(k % 3 == 2, F.concat(F.lit("\t"), F.col("country"))).otherwise(F.lit("")))
    lines = v.index_members.select("index_name", F.explode(F.array(line, F.lit("   "), F.concat(F.lit("# "), "symbol"))).alias("value"))
    return TX.parse_index_list(lines, keys=("index_name",))


@query("scan_csv_dim", "SELECT index_name, symbol, 'Company '||symbol AS company, industry FROM v_members")
def scan_csv_dim(v):
    """Delimited constituent lines to trimmed columns."""
    line = F.concat_ws(",", F.concat(F.lit(" "), "symbol"), F.concat(F.lit('"Company '), "symbol", F.lit('"')), F.concat("industry", F.lit(" ")))
    d = v.index_members.select("index_name", F.from_csv(line, "Symbol string, `Company Name` string, Industry string", {"ignoreLeadingWhiteSpace": "true"}).alias("r"))
    return d.select("index_name", F.trim("r.Symbol").alias("symbol"), F.trim("r.Company Name").alias("company"), F.trim("r.Industry").alias("industry"))


@query("route_by_country", """SELECT symbol, country, CASE WHEN upper(country)='US' THEN 'us_filings' ELSE 'in_filings' END AS route, upper(country)<>'US' AS shareholdings FROM v_members""")
def route_by_country(v):
    m = v.index_members.select("symbol", "country")
    us = F.upper("country") == "US"
    a = m.filter(us).withColumns({"route": F.lit("us_filings"), "shareholdings": F.lit(False)})
    return a.unionByName(m.filter(~us).withColumns({"route": F.lit("in_filings"), "shareholdings": F.lit(True)}))


@query("validate_source_country", """SELECT symbol, asked_source, country, CASE WHEN asked_source NOT IN ('NSE','SEC') THEN 'unknown source' WHEN (asked_source='NSE' AND country<>'in') OR (asked_source='SEC' AND country<>'us') THEN 'source serves another country' END AS reason
 FROM (SELECT symbol, country, CASE CAST(substring(symbol,2) AS BIGINT)%3 WHEN 0 THEN 'NSE' WHEN 1 THEN 'SEC' ELSE 'LSE' END AS asked_source FROM v_members) WHERE reason IS NOT NULL""")
def validate_source_country(v):
    """Requests whose source is unknown or serves another country, with the reason."""
    k = F.substring("symbol", 2, 20).cast("bigint") % 3
    asked = v.index_members.select("symbol", "country", F.when(k == 0, "NSE").when(k == 1, "SEC").otherwise("LSE").alias("asked_source"))
    dim = F.create_map(*[F.lit(x) for kv in S.SOURCE_COUNTRY.items() for x in kv])
    served = F.try_element_at(dim, F.upper("asked_source"))
    reason = F.when(served.isNull(), "unknown source").when(served != F.lower("country"), "source serves another country")
    return asked.withColumn("reason", reason).filter(F.col("reason").isNotNull())


view("v_catalog", """SELECT symbol, exchange, country, coalesce(p,0) AS prices, coalesce(i,0) AS income_statements, coalesce(b,0) AS balance_sheets, coalesce(c,0) AS cash_flows, coalesce(f,0) AS filings, coalesce(p,0)+coalesce(i,0)+coalesce(b,0)+coalesce(c,0)+coalesce(f,0) AS total_records,
 pd AS prices_last_updated, iu AS income_last_updated FROM (SELECT symbol, coalesce(exchange,'NASDAQ') AS exchange, country FROM v_meta) LEFT JOIN (SELECT symbol, count(*) AS p, max(date) AS pd FROM v_quotes GROUP BY 1) USING (symbol)
 LEFT JOIN (SELECT symbol, count(*) AS i, max(pulled_at) AS iu FROM v_income GROUP BY 1) USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS b FROM v_balance GROUP BY 1) USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS c FROM v_cashflow GROUP BY 1) USING (symbol)
 LEFT JOIN (SELECT symbol, count(*) AS f FROM v_shareholding GROUP BY 1) USING (symbol)""")


def _catalog(v):
    from tapeline.operators import facts as FA
    from tapeline.plans.filings import ownership_facts

    meta = v.stock_metadata.withColumn("exchange", F.coalesce("exchange", F.lit("NASDAQ")))
    return QL.data_catalog(meta, v.quotes, v.income, v.balance, v.cashflow, FA.shareholding(ownership_facts(v)))


@query("data_catalog", "SELECT * FROM v_catalog")
def data_catalog(v):
    return _catalog(v)


@query("filter_symbol_ilike", "SELECT symbol, total_records FROM v_catalog WHERE symbol ILIKE '%s1%' AND country='in'")
def filter_symbol_ilike(v):
    return _catalog(v).filter(F.col("symbol").ilike("%s1%") & (F.col("country") == "in")).select("symbol", "total_records")


@query("topk_search", "SELECT symbol, total_records FROM v_catalog WHERE symbol ILIKE '%s%' ORDER BY total_records DESC, symbol LIMIT 50")
def topk_search(v):
    limit = min(max(500, 1), 50)  # the caller's limit is clamped to 1..50
    return _catalog(v).filter(F.col("symbol").ilike("%s%")).orderBy(F.col("total_records").desc(), "symbol").limit(limit).select("symbol", "total_records")


@query("exchange_suffix", "SELECT symbol, exchange, symbol||CASE exchange WHEN 'NSE' THEN '.NS' WHEN 'BSE' THEN '.BO' WHEN 'NASDAQ' THEN '' WHEN 'NYSE' THEN '' ELSE '.'||exchange END AS quote_symbol FROM (SELECT symbol, CASE WHEN CAST(substring(symbol,2) AS BIGINT)%5=0 THEN 'BSE' WHEN CAST(substring(symbol,2) AS BIGINT)%5=1 THEN 'LSE' ELSE exchange END AS exchange FROM v_members)")
def exchange_suffix(v):
    k = F.substring("symbol", 2, 20).cast("bigint") % 5
    d = v.index_members.select("symbol", F.when(k == 0, "BSE").when(k == 1, "LSE").otherwise(F.col("exchange")).alias("exchange"))
    return d.withColumn("quote_symbol", X.exchange_suffix("symbol", "exchange"))
