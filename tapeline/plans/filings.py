"""Fact-normalisation and concept-frame queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import scalars as X
from tapeline.operators import facts as FA
from tapeline.operators import instances as IN
from tapeline.plans.checks import view
from tapeline.registry import query
from tapeline.sources import schema as S

_ROWS = ", ".join(f"('{t[1]}','{S.CATEGORY_STATEMENT.get(t[0], '')}','{t[0]}','{t[2] if len(t) > 2 else FA.snake(t[1])}')" for t in S.TAG_CATALOG)
view("v_tags", f"SELECT tag, nullif(st,'') AS statement, cat AS category_of_tag, col AS column_ FROM (VALUES {_ROWS}) t(tag,st,cat,col)")
view("v_factst", "SELECT f.*, statement, category_of_tag, column_, end_date-start_date AS days FROM v_facts f LEFT JOIN v_tags USING (tag)")
view("v_fkeep", """SELECT * FROM v_factst WHERE CASE WHEN instant_date IS NOT NULL AND start_date IS NULL THEN true WHEN context_ref IN ('OneD','OneI') THEN category='integrated-filing'
 WHEN context_ref IN ('FourD','FourI') THEN category='annual-results' OR (category='integrated-filing' AND coalesce(category_of_tag='cash_flow',false))
 WHEN start_date IS NOT NULL AND end_date IS NOT NULL THEN CASE WHEN category='integrated-filing' THEN (days>60 AND days<=130) OR (days>=300 AND coalesce(category_of_tag='cash_flow',false)) ELSE days>=300 END ELSE true END""")


def _dim(v):
    return FA.tag_dimension(v.spark)


def _kept(v):
    return FA.filter_by_period(v.facts, _dim(v))


def _values(v):
    return FA.collapse(_kept(v))


@query("filter_facts_by_period", "SELECT filing_id, ord, tag, value, context_ref FROM v_fkeep")
def filter_facts_by_period(v):
    return _kept(v).select("filing_id", "ord", "tag", "value", "context_ref")


@query("facts_tag_dim", "SELECT filing_id, ord, tag, value, statement, column_ AS store_column FROM v_factst WHERE statement IS NOT NULL")
def facts_tag_dim(v):
    d = FA.with_tags(v.facts, _dim(v), "inner").filter(F.col("statement").isNotNull())
    return d.select("filing_id", "ord", "tag", "value", "statement", F.col("column").alias("store_column"))


@query("mode_period_start", """SELECT filing_id, start_date AS period_start_date FROM (SELECT filing_id, start_date, count(*) AS n, min(ord) AS o FROM v_facts WHERE start_date IS NOT NULL GROUP BY 1,2)
 QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY n DESC, o)=1""")
def mode_period_start(v):
    return FA.period_start_mode(v.facts)


view("v_pick", """SELECT *, row_number() OVER (PARTITION BY filing_id, statement, column_ ORDER BY CASE WHEN d IS NULL THEN 0 WHEN d=period_end THEN 2 ELSE 1 END DESC, d DESC NULLS LAST, ord) AS r
 FROM (SELECT *, coalesce(end_date, instant_date) AS d FROM v_fkeep WHERE statement IS NOT NULL)""")
view("v_collapsed", """SELECT filing_id, symbol, period_end, statement, column_, CAST(CASE WHEN count(DISTINCT tag)>1 THEN sum(TRY_CAST(value AS DECIMAL(28,6))) ELSE max(TRY_CAST(value AS DECIMAL(28,6))) FILTER (r=1) END AS DOUBLE) AS value
 FROM v_pick GROUP BY ALL""")


@query("collapse_facts", "SELECT filing_id, statement, column_ AS store_column, value FROM v_collapsed")
def collapse_facts(v):
    return _values(v).select("filing_id", "statement", F.col("column").alias("store_column"), "value")


_INC = ["revenue_from_operations", "profit_loss_for_period", "finance_costs"]


@query("statement_pivot", f"SELECT filing_id, symbol, period_end, {', '.join(f'max(value) FILTER (column_={chr(39)}{c}{chr(39)}) AS {c}' for c in _INC)} FROM v_collapsed WHERE statement='income' GROUP BY 1,2,3")
def statement_pivot(v):
    return FA.statement_pivot(_values(v), "income").select("filing_id", "symbol", "period_end", *_INC)


@query("statement_pivot_cashflow", f"SELECT filing_id, symbol, period_end, max(value) FILTER (column_='{S.OCF}') AS {S.OCF}, max(value) FILTER (column_='{S.CAPEX}') AS {S.CAPEX} FROM v_collapsed WHERE statement='cashflow' GROUP BY 1,2,3")
def statement_pivot_cashflow(v):
    return FA.statement_pivot(_values(v), "cashflow").select("filing_id", "symbol", "period_end", S.OCF, S.CAPEX)


@query("flatten_facts", """SELECT filing_id, tag, coalesce(max_by(value, ord) FILTER (q), min_by(value, ord)) AS flat_value, coalesce(min_by(value, ord) FILTER (q), min_by(value, ord)) AS quarterly_value
 FROM (SELECT *, contains(context_ref,'OneI') OR contains(context_ref,'OneD') AS q FROM v_facts) GROUP BY 1,2""")
def flatten_facts(v):
    return FA.flatten_facts(v.facts)


@query("day_count_class", "SELECT filing_id, ord, CASE WHEN end_date-start_date>60 AND end_date-start_date<=130 THEN 'quarter' WHEN end_date-start_date>=300 THEN 'annual' END AS duration_class FROM v_facts")
def day_count_class(v):
    return v.facts.select("filing_id", "ord", X.duration_class("start_date", "end_date").alias("duration_class"))


@query("camel_to_snake", r"SELECT filing_id, ord, lower(regexp_replace(regexp_replace(tag, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS store_column FROM v_facts")
def camel_to_snake(v):
    return v.facts.select("filing_id", "ord", X.camel_to_snake("tag").alias("store_column"))


@query("metric_catalog", """SELECT t.tag, t.category_of_tag AS category, t.column_ AS store_column, count(f.tag) AS facts FROM v_tags t LEFT JOIN v_facts f ON f.tag=t.tag GROUP BY 1,2,3""")
def metric_catalog(v):
    """The tag catalog with the number of stored facts behind each entry."""
    used = v.facts.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    d = _dim(v).join(used, "tag", "left")
    return d.select("tag", F.col("category_of_tag").alias("category"), F.col("column").alias("store_column"), F.coalesce("n", F.lit(0)).alias("facts"))


# -- ownership -----------------------------------------------------------------------------

view("v_sh", f"""SELECT * FROM (SELECT symbol, period_end, unnest([{', '.join(f"{{'ctx':'{c}_Context','f':{i+1}}}" for i, c in enumerate(FA.OWNERSHIP_CONTEXTS))}, {{'ctx':'UnknownI_Context','f':7}}]) AS u, rev FROM
 (SELECT 'S'||l_suppkey AS symbol, last_day(make_date(CAST(year(l_shipdate) AS INT),CAST(quarter(l_shipdate)*3 AS INT),1)) AS period_end, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS rev FROM lineitem GROUP BY 1,2))""")
_SH = ", ".join(f"max(CASE WHEN v<1 THEN round(v*100,4) ELSE v END) FILTER (u.ctx='{c}_Context') AS {n}" for c, n in FA.OWNERSHIP_CONTEXTS.items())
view("v_shareholding", f"SELECT symbol, period_end, {_SH} FROM (SELECT *, CASE WHEN u.f%2=0 THEN CAST((rev*u.f)%97 AS DOUBLE)/100 ELSE CAST(1+(rev*u.f)%55 AS DOUBLE) END AS v FROM v_sh) GROUP BY 1,2")


def ownership_facts(v):
    """Ownership facts per company and quarter, some as fractions, one in an unknown context."""
    li = v.table("lineitem")
    d = F.col("l_shipdate").cast("date")
    base = li.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1))).alias("period_end")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("rev"))
    ctxs = F.array(*[F.struct(F.lit(f"{c}_Context").alias("context_ref"), F.lit(i + 1).alias("f")) for i, c in enumerate([*FA.OWNERSHIP_CONTEXTS, "UnknownI"])])
    rows = base.select("symbol", "period_end", "rev", F.inline(ctxs))
    value = F.when(F.col("f") % 2 == 0, ((F.col("rev") * F.col("f")) % 97).cast("double") / 100).otherwise((1 + (F.col("rev") * F.col("f")) % 55).cast("double"))
    return rows.select("symbol", "period_end", "context_ref", F.lit(FA.OWNERSHIP_TAG).alias("tag"), value.cast("string").alias("value"))


@query("filter_shareholding_ctx", "SELECT * FROM v_shareholding")
def filter_shareholding_ctx(v):
    return FA.shareholding(ownership_facts(v))


@query("shareholdings_latest", f"SELECT symbol, period_end, {', '.join(FA.OWNERSHIP_CONTEXTS.values())} FROM v_shareholding QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC)<=4")
def shareholdings_latest(v):
    from tapeline.functions.rolling import tail

    return tail(FA.shareholding(ownership_facts(v)), 4, ("symbol",), "period_end")


# -- XML instances ------------------------------------------------------------------------------

def filing_documents(v):
    """One XML instance per filing, written from the facts; filings differ in their namespace prefixes.

    A filing grows from a narrow row to some kilobytes here and is parsed by the same task, so the narrow
    rows are dealt to several tasks a core; their size alone would leave hardly a task a core.
    """
    c = F.col
    lit = lambda *a: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in a])
    odd = F.pmod(F.xxhash64("symbol"), F.lit(2)) == 1
    quarters = v.filed_quarters.repartition(8 * v.spark.sparkContext.defaultParallelism, "symbol", "period_end_date")
    d = v.fact_lists(quarters).withColumns({"own": F.when(odd, "in-bse-fin:").otherwise("in:"), "base": F.when(odd, "").otherwise("xbrli:")})
    own, base = c("own"), c("base")
    tag = lambda f: lit("<", own, f["tag"], ' contextRef="', f["context_ref"], '">', f["value"], "</", own, f["tag"], ">")
    span = lambda f: F.when(f["instant_date"].isNotNull(), lit("<", base, "instant>", f["instant_date"].cast("string"), "</", base, "instant>")).otherwise(
        lit("<", base, "startDate>", f["start_date"].cast("string"), "</", base, "startDate><", base, "endDate>", f["end_date"].cast("string"), "</", base, "endDate>"))
    context = lambda f: lit("<", base, 'context id="', f["context_ref"], '"><', base, "entity><", base, 'identifier scheme="s">', c("symbol"), "</", base, "identifier></", base, "entity><", base, "period>", span(f), "</", base, "period></", base, "context>")
    contexts, body = F.array_join(F.array_sort(F.array_distinct(F.transform("f", context))), ""), F.array_join(F.transform("f", tag), "\n")
    spaces = ' xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns="http://www.xbrl.org/2003/instance" xmlns:in="urn:in" xmlns:in-bse-fin="urn:fin">'
    xml = lit("<", base, "xbrl", spaces, contexts, "<", base, 'unit id="INR"><', base, "measure>INR</", base, "measure></", base, "unit><!-- facts -->\n<", own, "endDate>",
              c("period_end").cast("string"), "</", own, "endDate>", body, "</", base, "xbrl>")
    return d.select("filing_id", "symbol", xml.alias("xml"))


@query("xbrl_facts", """SELECT filing_id, symbol, period_end, 'INR' AS currency, CAST(row_number() OVER (PARTITION BY filing_id ORDER BY ord) AS INT) AS ord, tag, value, context_ref, symbol AS entity, start_date, end_date, instant_date FROM v_facts
 UNION ALL SELECT DISTINCT filing_id, symbol, period_end, 'INR', 0, 'endDate', strftime(period_end, '%Y-%m-%d'), NULL, symbol, NULL, NULL, NULL FROM v_facts""")
def xbrl_facts(v):
    return IN.parse_filings(filing_documents(v))


# -- concept frames --------------------------------------------------------------------------------

@query("unpivot_periods", """WITH q AS (SELECT symbol, concept, period_end, max(value) AS value FROM v_concepts WHERE form='10-Q' GROUP BY 1,2,3)
 SELECT symbol, concept, period_end, value FROM (SELECT DISTINCT symbol, concept FROM q) CROSS JOIN (SELECT DISTINCT period_end FROM q) LEFT JOIN q USING (symbol, concept, period_end)""")
def unpivot_periods(v):
    """Frames with a column for every quarter end (a calendar's worth), and back to rows."""
    q = v.concept_periods.filter(F.col("form") == "10-Q")
    wide = q.groupBy("symbol", "concept").pivot("period_end").agg(F.max("value"))
    return FA.unpivot_periods(wide, ["symbol", "concept"])


_YTD = "SELECT symbol, concept, period_end, value FROM v_concepts WHERE form='10-Q' AND statement='{s}'"


def _ytd(v, statement="income", form="10-Q"):
    return v.concept_periods.filter((F.col("form") == form) & (F.col("statement") == statement)).select("symbol", "concept", "period_end", "value")


@query("merge_concept_frames", """SELECT symbol, concept, period_end, value FROM (SELECT symbol, concept, period_end, CASE WHEN month(period_end)=6 THEN NULL ELSE value END AS value, 0 AS b FROM v_concepts WHERE form='10-Q' AND statement='income'
 UNION ALL SELECT symbol, concept, period_end, value+1, 1 FROM v_concepts WHERE form='10-Q' AND statement='income') WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, concept, period_end ORDER BY b)=1""")
def merge_concept_frames(v):
    d = _ytd(v)
    first = d.withColumn("value", F.when(F.month("period_end") != 6, F.col("value")))
    return FA.merge_concept_frames([first, d.withColumn("value", F.col("value") + 1)])


_CDIM = ", ".join(f"('{c}','{t}',{i})" for c, ts in S.INCOME_CONCEPTS.items() for i, t in enumerate(ts))
view("v_cdim", f"SELECT * FROM (VALUES {_CDIM}) t(col, concept, prio)")


@query("coalesce_tags", "SELECT symbol, period_end, col AS store_column, min_by(value, prio) AS value FROM v_concepts JOIN v_cdim USING (concept) WHERE form='10-Q' AND statement='income' GROUP BY 1,2,3")
def coalesce_tags(v):
    d = FA.coalesce_tags(_ytd(v), FA.concept_dimension(v.spark, S.INCOME_CONCEPTS))
    return d.withColumnRenamed("column", "store_column")


_PARTS = "('us-gaap_Depreciation','us-gaap_AmortizationOfIntangibleAssets','us-gaap_AmortizationOfDeferredCharges')"


@query("sum_tags", f"""SELECT symbol, period_end, coalesce(d, s) AS depreciation FROM (SELECT symbol, period_end, sum(value) FILTER (concept IN {_PARTS}) AS s, max(value) FILTER (concept='us-gaap_DepreciationDepletionAndAmortization') AS d FROM v_concepts WHERE form='10-Q' GROUP BY 1,2)""")
def sum_tags(v):
    parts = FA.sum_tags(_ytd(v, "cashflow"), S.DEPRECIATION_PARTS, S.DEPRECIATION).select("symbol", "period_end", F.col("value").alias("s"))
    direct = _ytd(v).filter(F.col("concept") == "us-gaap_DepreciationDepletionAndAmortization").select("symbol", "period_end", F.col("value").alias("d"))
    return parts.join(direct, ["symbol", "period_end"], "full").select("symbol", "period_end", F.coalesce("d", "s").alias("depreciation"))


def _diff(s):
    return f"""SELECT c.symbol, c.concept, c.period_end, CASE WHEN c.period_end - p.prev <= 125 THEN c.value - b.value ELSE c.value END AS value FROM ({_YTD.format(s=s)}) c
 JOIN (SELECT symbol, period_end, lag(period_end) OVER (PARTITION BY symbol ORDER BY period_end) AS prev FROM (SELECT DISTINCT symbol, period_end FROM v_concepts WHERE form='10-Q' AND statement='{s}')) p ON p.symbol=c.symbol AND p.period_end=c.period_end
 LEFT JOIN ({_YTD.format(s=s)}) b ON b.symbol=c.symbol AND b.concept=c.concept AND b.period_end=p.prev"""


@query("diff_cumulative", _diff("income"))
def diff_cumulative(v):
    return FA.diff_cumulative(_ytd(v))


view("v_q4pairs", """SELECT a.symbol, a.period_end AS annual_period, max(q.period_end) AS ytd_period FROM (SELECT DISTINCT symbol, period_end FROM v_concepts WHERE form='10-K') a
 JOIN (SELECT DISTINCT symbol, period_end FROM v_concepts WHERE form='10-Q') q ON q.symbol=a.symbol AND q.period_end<a.period_end AND a.period_end-q.period_end<=125 GROUP BY 1,2""")


def _pairs(v):
    p = v.concept_periods.select("symbol", "form", "period_end").distinct()
    return FA.q4_asof(p.filter("form = '10-K'"), p.filter("form = '10-Q'"))


@query("q4_asof", "SELECT * FROM v_q4pairs")
def q4_asof(v):
    return _pairs(v)


view("v_q4", """SELECT a.symbol, a.statement, a.concept, p.annual_period, p.ytd_period, a.value-y.value AS value FROM v_concepts a JOIN v_q4pairs p ON p.symbol=a.symbol AND p.annual_period=a.period_end AND a.form='10-K'
 JOIN v_concepts y ON y.symbol=a.symbol AND y.statement=a.statement AND y.concept=a.concept AND y.period_end=p.ytd_period AND y.form='10-Q'""")


@query("q4_concept_intersect", "SELECT symbol, statement, concept, annual_period, value FROM v_q4")
def q4_concept_intersect(v):
    return FA.q4_values(v.concept_periods, _pairs(v)).drop("ytd_period")


@query("intersect_concepts", "SELECT symbol, concept FROM v_concepts WHERE form='10-K' INTERSECT SELECT symbol, concept FROM v_concepts WHERE form='10-Q'")
def intersect_concepts(v):
    c = v.concept_periods
    return c.filter("form = '10-K'").select("symbol", "concept").intersect(c.filter("form = '10-Q'").select("symbol", "concept"))


@query("q4_eps", f"""SELECT q.symbol, q.annual_period, round(q.value/b.value,6) AS eps_basic, round(q.value/d.value,6) AS eps_diluted FROM v_q4 q JOIN v_concepts b ON b.symbol=q.symbol AND b.period_end=q.annual_period AND b.form='10-K' AND b.concept='{FA.BASIC_SHARES}'
 JOIN v_concepts d ON d.symbol=q.symbol AND d.period_end=q.annual_period AND d.form='10-K' AND d.concept='{FA.DILUTED_SHARES}' WHERE q.concept='us-gaap_NetIncomeLoss'""")
def q4_eps(v):
    d = FA.q4_eps(FA.q4_values(v.concept_periods, _pairs(v)), v.concept_periods)
    return d.select("symbol", "annual_period", F.round(S.EPS_BASIC, 6).alias("eps_basic"), F.round(S.EPS_DILUTED, 6).alias("eps_diluted"))


view("v_diffinc", _diff("income"))
view("v_diffcash", _diff("cashflow"))
_USCOLS = {"revenue_from_operations": "coalesce(max(value) FILTER (concept='us-gaap_RevenueFromContractWithCustomerExcludingAssessedTax'), max(value) FILTER (concept='us-gaap_Revenues'))",
           "profit_loss_for_period": "max(value) FILTER (concept='us-gaap_NetIncomeLoss')", "finance_costs": "max(value) FILTER (concept='us-gaap_InterestExpense')",
           "cost_of_revenue": "max(value) FILTER (concept='us-gaap_CostOfRevenue')", "operating_income": "max(value) FILTER (concept='us-gaap_OperatingIncomeLoss')"}
_SHB = f"max(value) FILTER (concept='{FA.BASIC_SHARES}')"
_DDA = "max(value) FILTER (concept='us-gaap_DepreciationDepletionAndAmortization')"


@query("us_income_rows", f"""SELECT symbol, period_end, {', '.join(_USCOLS)}, coalesce(dd, da) AS depreciation, CAST(NULL AS DOUBLE) AS weighted_average_shares_basic, 'quarterly' AS filing_type FROM
  (SELECT symbol, period_end, {', '.join(f'{e} AS {c}' for c, e in _USCOLS.items())}, {_DDA} AS dd FROM v_diffinc GROUP BY 1,2) LEFT JOIN (SELECT symbol, period_end, sum(value) AS da FROM v_diffcash WHERE concept IN {_PARTS} GROUP BY 1,2) USING (symbol, period_end)
 UNION ALL SELECT symbol, period_end, {', '.join(_USCOLS)}, coalesce(dd, da), sb, 'annual' FROM
  (SELECT symbol, period_end, {', '.join(f'{e} AS {c}' for c, e in _USCOLS.items())}, {_DDA} AS dd, {_SHB} AS sb FROM v_concepts WHERE form='10-K' AND statement='income' GROUP BY 1,2)
  LEFT JOIN (SELECT symbol, period_end, sum(value) AS da FROM v_concepts WHERE form='10-K' AND concept IN {_PARTS} GROUP BY 1,2) USING (symbol, period_end)""")
def us_income_rows(v):
    d = FA.income_rows(v.spark, v.concept_periods, False).unionByName(FA.income_rows(v.spark, v.concept_periods, True))
    return d.select("symbol", "period_end", *_USCOLS, F.col(S.DEPRECIATION).alias("depreciation"), "weighted_average_shares_basic", "filing_type")


view("v_q4cash", "SELECT symbol, concept, annual_period AS period_end, value FROM v_q4 WHERE statement='cashflow'")
view("v_kcash", "SELECT symbol, concept, period_end, value FROM v_concepts WHERE form='10-K' AND statement='cashflow'")
_CASHCOLS = {c: "coalesce(" + ", ".join(f"max(value) FILTER (concept='{t}')" for t in ts) + ")" for c, ts in S.CASHFLOW_CONCEPTS.items()}


@query("us_cashflow_rows", " UNION ALL ".join(
    f"SELECT symbol, period_end, {', '.join(f'{e} AS {c}' for c, e in _CASHCOLS.items())}, {_CASHCOLS[S.OCF]} AS {S.OCF_ALIAS}, '{kind}' AS filing_type, '{form}' AS frame FROM {src} GROUP BY 1,2"
    for form, src, kind in (("10-K", "v_kcash", "annual"), ("10-Q", "v_diffcash", "quarterly"), ("Q4", "v_q4cash", "quarterly"))))
def us_cashflow_rows(v):
    """Cash-flow rows of annual, quarterly and derived fourth-quarter frames."""
    rows = [FA.cashflow_rows(v.spark, v.concept_periods, f).withColumn("frame", F.lit(f)) for f in ("10-K", "10-Q", "Q4")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("annual_vs_quarterly_shares", f"""SELECT symbol, period_end, CASE WHEN form='10-K' THEN value END AS weighted_average_shares_basic, CASE WHEN form='10-K' THEN 'annual' ELSE 'quarterly' END AS filing_type FROM v_concepts WHERE concept='{FA.BASIC_SHARES}'""")
def annual_vs_quarterly_shares(v):
    d = FA.income_rows(v.spark, v.concept_periods, False).unionByName(FA.income_rows(v.spark, v.concept_periods, True))
    return d.select("symbol", "period_end", "weighted_average_shares_basic", "filing_type")


view("v_bal", """SELECT symbol, period_end, max(value) FILTER (concept='us-gaap_CommonStockValue') AS sc, max(value) FILTER (concept='us-gaap_StockholdersEquity') AS eq, max(value) FILTER (concept='us-gaap_LiabilitiesAndStockholdersEquity') AS le,
 max(value) FILTER (concept='us-gaap_Liabilities') AS l, max(value) FILTER (concept='us-gaap_Assets') AS assets FROM v_concepts WHERE statement='balance' GROUP BY 1,2""")


@query("equity_split", "SELECT symbol, period_end, assets, sc AS equity_share_capital, CASE WHEN sc IS NOT NULL AND eq IS NOT NULL THEN eq-sc ELSE eq END AS other_equity, le-l AS total_equity_including_nci FROM v_bal")
def equity_split(v):
    return FA.balance_rows(v.spark, v.concept_periods).select("symbol", "period_end", "assets", "equity_share_capital", "other_equity", "total_equity_including_nci")


@query("fiscal_quarter", """SELECT symbol, period_end, fye_month, CASE WHEN fye_month IS NULL THEN 'Q'||((quarter(period_end)+2)%4+1) ELSE CASE (month(period_end)-fye_month+12)%12 WHEN 0 THEN 'Q4' WHEN 3 THEN 'Q1' WHEN 6 THEN 'Q2' WHEN 9 THEN 'Q3' END END AS fiscal_period
 FROM (SELECT DISTINCT symbol, period_end, CAST(CASE CAST(substring(symbol,2) AS BIGINT)%4 WHEN 0 THEN 9 WHEN 2 THEN 12 END AS INT) AS fye_month FROM (SELECT symbol, period_end FROM v_concepts UNION SELECT symbol, period_end_date FROM v_income))""")
def fiscal_quarter(v):
    d = v.concept_periods.select("symbol", "period_end").unionByName(v.income.select("symbol", F.col("period_end_date").alias("period_end"))).distinct()
    k = F.substring("symbol", 2, 20).cast("bigint") % 4
    d = d.withColumn("fye_month", F.when(k == 0, 9).when(k == 2, 12))
    return FA.stamp_fiscal_quarter(d, F.col("fye_month"))


@query("announcements_8k", """SELECT 'C'||o_custkey AS symbol, strftime(CAST(o_orderdate AS DATE),'%Y-%m-%d') AS date, o_orderpriority AS heading, '8-K' AS category,
 'https://www.sec.gov/Archives/edgar/data/'||o_custkey||'/'||lpad(CAST(o_orderkey AS VARCHAR),10,'0')||'01/doc'||o_orderkey||'.htm' AS url FROM orders""")
def announcements_8k(v):
    o = v.table("orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.col("o_custkey").alias("cik"), F.col("o_orderdate").cast("date").alias("filing_date"),
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-01")).alias("accession"),
        F.concat(F.lit("doc"), "o_orderkey", F.lit(".htm")).alias("document"), F.col("o_orderpriority").alias("description"), F.lit("8-K").alias("form"))
    return FA.announcements_8k(o)
