"""Statements, metrics, facts, text and streaming on small hand-computed fixtures."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tapeline.functions import scalars as X
from tapeline.operators import facts as FA
from tapeline.operators import instances as IN
from tapeline.operators import metrics as M
from tapeline.operators import quality as QL
from tapeline.operators import ratios as RT
from tapeline.operators import statements as ST
from tapeline.operators import text as TX
from tapeline.sources import schema as S

ID = "symbol string, source string, country string, consolidated boolean, filing_type string, period_end_date date, period_start_date date, fiscal_period string, source_endpoint string, pulled_at timestamp_ntz"
QUARTERS = [dt.date(2024, 3, 31), dt.date(2024, 6, 30), dt.date(2024, 9, 30), dt.date(2024, 12, 31), dt.date(2025, 3, 31), dt.date(2025, 6, 30), dt.date(2025, 9, 30), dt.date(2025, 12, 31)]


def rows(spark, data, cols, filing_type="quarterly"):
    base = [("AAA", "NSE", "in", True, filing_type, d, None, f"Q{(d.month - 1) // 3 + 1}", "integrated-filing", None, *[None if v is None else float(v) for v in vals]) for d, vals in data]
    return spark.createDataFrame(base, ID + ", " + ", ".join(f"{c} double" for c in cols))


INC = [S.REVENUE, S.PAT, S.PBT, S.FINANCE, S.EPS_BASIC, S.EPS_DILUTED, "cost_of_revenue", "expenses", "tax_expense", S.DEPRECIATION, "operating_income", "weighted_average_shares_basic"]
BAL = ["equity_share_capital", "other_equity", "assets", "borrowings_current", "borrowings_noncurrent", "inventories", "trade_receivables_current", "trade_payables",
       "current_liabilities", "assets_current", S.CASH, S.BANK, S.PAID_UP, S.FACE]


def one(spark, n=8, capex=-20.0, finance=10.0):
    inc = rows(spark, [(q, [100 + 10 * i, 20 + i, 30, finance, 2.0, 1.9, 60, 70, 6, 5, None, None]) for i, q in enumerate(QUARTERS[-n:])], INC)
    bal = rows(spark, [(QUARTERS[3], [50, 150, 500, 20, 30, 25, 40, 30, 100, 180, 10, 5, 100, 10])], BAL)
    cf = rows(spark, [(QUARTERS[-1], [80, capex, -15])], [S.OCF, S.CAPEX, "dividends_paid"])
    price = spark.createDataFrame([("AAA", 50.0)], "symbol string, current_price double")
    return M.financial_metrics(inc, bal, cf, price).first()


def test_trailing_metrics(spark):
    r = one(spark)
    # newest four quarters: revenue 140..170, profit 24..27
    assert r.ttm_window_complete and r.ttm_quarters_used == 4
    assert r.earnings_per_share == 8.0 and r.price_to_earnings_ratio == 6.25
    assert r.revenue_growth_annual == round((620 / 460 - 1) * 100, 2)
    assert r.revenue_growth_quarterly_qoq == round((170 / 160 - 1) * 100, 2) and r.revenue_growth_quarterly_yoy == round((170 / 130 - 1) * 100, 2)
    assert r.market_capitalization == 500.0 and r.total_debt == 50.0 and r.cash_and_equivalents == 15.0
    assert r.enterprise_value == 500 + 50 - 15 and r.free_cash_flow_source == "operating_cash_flow_minus_capex"
    assert r.free_cash_flow_per_share == 6.0 and r.interest_coverage == 4.0 and r.net_margin == round(102 / 620 * 100, 2)
    assert r.quick_ratio == 1.55 and r.payout_ratio == round(15 / 102 * 100, 2)


def test_short_history_degrades_and_says_so(spark):
    r = one(spark, n=2, capex=None, finance=0.0)
    assert not r.ttm_window_complete and r.ttm_quarters_used == 2
    assert r.revenue_growth_annual is None and r.earnings_per_share == 2.0
    assert r.interest_coverage is None and r.free_cash_flow_source == "operating_cash_flow_capex_absent"


def test_carry_forward_stops_after_380_days(spark):
    inc = rows(spark, [(dt.date(2025, 1, 25), [1]), (dt.date(2025, 5, 15), [1])], [S.REVENUE])
    bal = rows(spark, [(dt.date(2024, 3, 31), [7])], ["assets"])
    cf = rows(spark, [(dt.date(2024, 3, 31), [1])], [S.OCF])
    got = {r.period_end_date: r.assets for r in ST.carry_forward(ST.merge_statements(inc, bal, cf), ["assets"]).collect()}
    assert got[dt.date(2025, 1, 25)] == 7.0 and got[dt.date(2025, 5, 15)] is None


def test_bad_period_bound_is_ignored(spark):
    inc = rows(spark, [(q, [1]) for q in QUARTERS], [S.REVENUE])
    assert ST.filter_period_range(inc, "2025-13-45", None).count() == 8
    assert ST.filter_period_range(inc, "2025-01-01", "2025-06-30").count() == 2


def test_upsert_keeps_absent_columns(spark):
    old = spark.createDataFrame([(1, 10.0, 20.0), (2, 5.0, 6.0)], "k int, a double, b double")
    new = spark.createDataFrame([(1, None, 99.0, ["a"]), (3, 1.0, 2.0, ["a", "b"])], "k int, a double, b double, present_cols array<string>")
    got = {r.k: (r.a, r.b, r.action) for r in ST.upsert_present(old, new, ["k"]).collect()}
    assert got == {1: (None, 20.0, "update"), 2: (5.0, 6.0, "keep"), 3: (1.0, 2.0, "insert")}


def test_static_ratios(spark):
    cols = [S.REVENUE, S.PAT, S.PBT, S.FINANCE, "assets", "equity_share_capital", "other_equity", "noncurrent_liabilities", "debt_equity_ratio", "borrowings_current", "borrowings_noncurrent", S.CASH, S.OCF, S.EPS_BASIC, S.EPS_DILUTED]
    vals = (100000, 15000, 20000, 3000, 500000, 50000, 150000, 100000, 1.5, 20000, 0, 10000, 25000, 10, 9.5)
    d = spark.createDataFrame([tuple(map(float, vals))], ", ".join(f"{c} double" for c in cols))
    r = RT.static_ratios(d).first()
    assert r.static_net_profit_margin == 15.0 and r.static_operating_margin == 23.0 and r.static_roe == 7.5
    assert r.static_roce == 5.75 and r.static_debt_to_equity == 1.5 and r.static_cash_ratio == 0.5 and r.static_dilution_impact == 5.0
    RT.register_ratio("double_margin", "User", lambda: RT.pct(RT.safe_div(F.col(S.PAT) * 2, S.REVENUE)))
    assert RT.static_ratios(d, ["double_margin"]).first().static_double_margin == 30.0
    assert RT.unregister_ratio("double_margin") == ["double_margin"]


def test_ratios_of_ratios(spark):
    d = spark.createDataFrame([(8.0, 2.0)], "a double, b double")
    before = set(RT.registered())
    RT.register_ratio("one", "User", lambda: F.col("a") / F.col("b"))
    RT.register_ratio("two", "User", lambda one: one * 10, uses=["one"])
    RT.register_ratio("three", "User", lambda two, one: two + one, uses=["two", "one"])
    assert RT.evaluation_order(["three"]) == [["one"], ["two"], ["three"]]
    got = RT.static_ratios(d, ["three"])
    assert got.columns == ["a", "b", "static_three"] and got.first().static_three == 44.0
    assert RT.static_ratios(d, ["three", "one"]).first().static_one == 4.0
    with pytest.raises(ValueError, match="one -> three -> two -> one"):
        RT.register_ratio("one", "User", lambda three: three, uses=["three"])
    with pytest.raises(KeyError):
        RT.register_ratio("four", "User", lambda x: x, uses=["nothing"])
    with pytest.raises(ValueError):
        RT.register_ratio("self", "User", lambda x: x, uses=["self"])
    assert RT.static_ratios(d, ["one"]).first().static_one == 4.0  # a refused change leaves the ratio as it was
    with pytest.raises(ValueError, match="two, three"):
        RT.unregister_ratio("one")
    assert sorted(RT.unregister_ratio("one", cascade=True)) == ["one", "three", "two"] and set(RT.registered()) == before


def test_table_functions(spark):
    from tapeline.functions.sql import register_table_functions
    from tapeline.operators import signals as SG

    register_table_functions(spark)
    d = spark.createDataFrame([("A", 20.0, 10.0, "up"), ("B", 20.0, 10.0, "down"), ("C", None, 10.0, "up")], "symbol string, hi double, lo double, way string")
    q = spark.sql("SELECT d.symbol, f.label, f.level FROM {d} d, LATERAL fib_levels_of(d.hi, d.lo, d.way) f WHERE f.level > 15", d=d)
    assert sorted((r.symbol, r.label, r.level) for r in q.collect()) == [
        ("A", "0.0%", 20.0), ("A", "23.6%", 17.64), ("A", "38.2%", 16.18), ("B", "100.0%", 20.0), ("B", "61.8%", 16.18), ("B", "78.6%", 17.86)]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and not any(w in plan for w in ("Python", "Join", "Exchange"))
    inputs = SG.signal_inputs()
    rows = [("A", *range(1, len(inputs) + 1)), ("B", 50.0, *[None] * (len(inputs) - 1)), ("C", *[75.0] * len(inputs)), ("D", *[None] * len(inputs))]
    last = spark.createDataFrame([(s, *[None if x is None else float(x) for x in v]) for s, *v in rows], f"symbol string, {', '.join(f'{c} double' for c in inputs)}")
    called = spark.sql("SELECT d.symbol, s.* FROM {d} d, LATERAL signals_of(d.r) s", d=last.select("symbol", F.struct(*inputs).alias("r")))
    assert sorted(map(tuple, called.collect())) == sorted(map(tuple, SG.signals(last).collect()))
    assert {r.symbol for r in called.collect()} == {"A", "C"}


def fact(spark, data):
    cols = "filing_id string, symbol string, period_end date, category string, ord bigint, tag string, value string, context_ref string, start_date date, end_date date, instant_date date"
    return spark.createDataFrame(data, cols)


E1, E0 = dt.date(2025, 9, 30), dt.date(2025, 6, 30)


def test_collapse_sums_tags_but_picks_contexts(spark):
    f = fact(spark, [
        ("f", "A", E1, "integrated-filing", 1, "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities", "100", "FourD", dt.date(2025, 1, 1), E1, None),
        ("f", "A", E1, "integrated-filing", 2, "PurchaseOfIntangibleAssetsClassifiedAsInvestingActivities", "40", "FourD", dt.date(2025, 1, 1), E1, None),
        ("f", "A", E1, "integrated-filing", 3, "Assets", "7", "PriorI", None, None, E0),
        ("f", "A", E1, "integrated-filing", 4, "Assets", "9", "OneI", None, None, E1),
        ("f", "A", E1, "integrated-filing", 5, "RevenueFromOperations", "5", "OneD", dt.date(2025, 7, 1), E1, None),
        ("f", "A", E1, "integrated-filing", 6, "RevenueFromOperations", "15", "FourD", dt.date(2025, 1, 1), E1, None),
        ("f", "A", E1, "integrated-filing", 7, "SomeUnmappedTag", "1", "OneD", dt.date(2025, 7, 1), E1, None),
    ])
    dim = FA.tag_dimension(spark)
    got = {r.column: r.value for r in FA.collapse(FA.filter_by_period(f, dim)).collect()}
    assert got == {S.CAPEX: 140.0, "assets": 9.0, S.REVENUE: 5.0}
    annual = FA.filter_by_period(f.withColumn("category", F.lit("annual-results")), dim)
    assert {r.ord for r in annual.collect()} == {1, 2, 3, 4, 6}


def test_ytd_to_quarters(spark):
    p = [dt.date(2025, 3, 31), dt.date(2025, 6, 30), dt.date(2025, 9, 30)]
    d = spark.createDataFrame([("A", "rev", p[0], 143.7), ("A", "rev", p[1], 254.9), ("A", "rev", p[2], 364.4), ("A", "x", p[2], 5.0)], "symbol string, concept string, period_end date, value double")
    got = {(r.concept, r.period_end): r.value for r in FA.diff_cumulative(d).collect()}
    assert [round(got["rev", q], 1) for q in p] == [143.7, 111.2, 109.5] and got["x", p[2]] is None


def test_fiscal_quarter(spark):
    d = spark.createDataFrame([(dt.date(2025, 9, 30), 9), (dt.date(2025, 12, 31), 9), (dt.date(2025, 3, 31), None), (dt.date(2025, 8, 31), 9)], "d date, f int")
    assert [r.q for r in d.select(X.fiscal_quarter("d", "f").alias("q")).collect()] == ["Q4", "Q1", "Q4", None]


def test_xml_instance(spark):
    xml = """<xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:in="urn:x">
    <xbrli:context id="OneI"><xbrli:entity><xbrli:identifier>ACME</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2025-07-01</xbrli:startDate><xbrli:endDate>2025-09-30</xbrli:endDate></xbrli:period></xbrli:context>
    <xbrli:context id="FourD"><xbrli:entity><xbrli:identifier>ACME</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2025-01-01</xbrli:startDate><xbrli:endDate>2025-12-31</xbrli:endDate></xbrli:period></xbrli:context>
    <xbrli:unit id="INR"><xbrli:measure>iso4217:INR</xbrli:measure></xbrli:unit><in:endDate contextRef="OneI">2025-09-30</in:endDate>
    <in:RevenueFromOperations contextRef="OneI">5000000</in:RevenueFromOperations><in:RevenueFromOperations contextRef="FourD">15000000</in:RevenueFromOperations></xbrl>"""
    got = IN.parse_filings(spark.createDataFrame([("A", "f1", xml)], "symbol string, filing_id string, xml string")).orderBy("ord").collect()
    assert [(r.tag, r.value, r.context_ref, r.start_date) for r in got] == [
        ("endDate", "2025-09-30", "OneI", dt.date(2025, 7, 1)), ("RevenueFromOperations", "5000000", "OneI", dt.date(2025, 7, 1)), ("RevenueFromOperations", "15000000", "FourD", dt.date(2025, 1, 1))]
    assert got[0].period_end == dt.date(2025, 9, 30) and got[0].currency == "iso4217:INR" and got[0].entity == "ACME"
    bare = xml.replace('<in:endDate contextRef="OneI">2025-09-30</in:endDate>', "")
    assert IN.parse_filings(spark.createDataFrame([("A", "f1", bare)], "symbol string, filing_id string, xml string")).first().period_end == dt.date(2025, 12, 31)


def test_instance_as_filed(spark):
    xml = """<?xml version="1.0"?><xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:in-bse-fin="urn:y">
    <xbrli:context id='OneI'><xbrli:entity><xbrli:identifier scheme="u">T</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2025-07-01</xbrli:startDate><xbrli:endDate> 2025-09-30 </xbrli:endDate></xbrli:period></xbrli:context>
    <!-- <in-bse-fin:Assets contextRef="OneI">1</in-bse-fin:Assets> --><in-bse-fin:endDate>2025-09-30</in-bse-fin:endDate>
    <in-bse-fin:ProfitLossForPeriod decimals="0" contextRef="OneI">7</in-bse-fin:ProfitLossForPeriod><in-bse-fin:RevenueFromOperations contextRef="OneI">
      5 </in-bse-fin:RevenueFromOperations><in-bse-fin:NotInCatalog contextRef="Gone">a &amp;lt; &lt;b&gt;</in-bse-fin:NotInCatalog><in-bse-fin:Assets contextRef="OneI"/><in-bse-fin:Assets contextRef="OneI"> </in-bse-fin:Assets></xbrli:xbrl>"""
    d = spark.createDataFrame([("A", "f", xml), ("B", "g", None), ("C", "h", "no markup")], "symbol string, filing_id string, xml string")
    got = [(r.ord, r.tag, r.value, r.context_ref, r.entity, r.start_date) for r in IN.parse_filings(d).orderBy("ord").collect()]
    q = dt.date(2025, 7, 1)
    assert got == [(0, "endDate", "2025-09-30", None, "A", None), (1, "ProfitLossForPeriod", "7", "OneI", "T", q), (2, "RevenueFromOperations", "5", "OneI", "T", q), (3, "NotInCatalog", "a &lt; <b>", "Gone", "A", None)]


AWKWARD = """<?xml version="1.0"?><!DOCTYPE x [<!ENTITY co "Co &amp; Sons">]><x:xbrl xmlns:x="http://www.xbrl.org/2003/instance" xmlns:f="urn:f">
<!-- a > b <f:Assets>0</f:Assets> <![CDATA[ --><f:Assets contextRef='c1' note="1 > 0">5</f:Assets><f:Name contextRef="c2"><![CDATA[<b>R&D</b> -- > ]]]]><![CDATA[> <!-- no comment -->]]></f:Name>
<f:Owner contextRef="c1">&co; &#65;&#x20B9;</f:Owner><f:Text>a<!-- cut -->b</f:Text><f:Tuple><f:Part contextRef="c1"> 1
</f:Part></f:Tuple><f:Mixed>out<f:Leaf>in</f:Leaf>er</f:Mixed><f:Empty/><f:Blank> </f:Blank>
<x:context id="c1"><x:entity><x:identifier>OLD</x:identifier></x:entity><x:period><x:instant>2024-03-31</x:instant></x:period></x:context>
<x:context id="c1"><x:entity><x:identifier>NEW</x:identifier><x:segment><f:Leaf>skipped</f:Leaf></x:segment></x:entity><x:period><x:startDate>2024-01-01</x:startDate><x:endDate>2024-12-31</x:endDate></x:period></x:context>
<x:context><x:entity><x:identifier>NONE</x:identifier></x:entity></x:context><x:unit id="u"><x:divide><x:measure>INR</x:measure><x:measure>shares</x:measure></x:divide></x:unit><x:unit id="v"><x:measure>pure</x:measure></x:unit></x:xbrl>
"""


def test_awkward_instances(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    want = [("Assets", "5", "c1", "NEW", day), ("Name", "<b>R&D</b> -- > ]]> <!-- no comment -->", "c2", "S", None), ("Owner", "Co & Sons A\u20b9", "c1", "NEW", day),
            ("Text", "ab", None, "S", None), ("Part", "1", "c1", "NEW", day), ("Leaf", "in", None, "S", None)]
    broken = "<a><b contextRef='q'>1</b><c>2</d></a>"
    texts = {"S_1": AWKWARD, "S_2": broken, "S_3": AWKWARD.rstrip(), "S_4": "", "S_5": "<a><b>7</b"}
    strings = spark.createDataFrame([("S", k, v) for k, v in texts.items()], "symbol string, filing_id string, xml string")
    for k, v in texts.items():
        (tmp_path / f"{k}.xml").write_text(v)
    for parsed, rows in ((IN.parse_filings(strings), IN.read_instances(strings)), (IN.parse_filing_files(spark, str(tmp_path)), IN.read_instance_files(spark, str(tmp_path)))):
        got = {}
        for r in parsed.orderBy("filing_id", "ord").collect():
            got.setdefault(r.filing_id, []).append((r.tag, r.value, r.context_ref, r.entity, r.start_date))
            assert r.filing_id in ("S_2", "S_5") or (r.currency, r.period_end) == ("shares", dt.date(2024, 12, 31))
        assert got == {"S_1": want, "S_3": want, "S_2": [("b", "1", "q", "S", None)]} | ({"S_5": got["S_5"]} if "S_5" in got else {})
        assert {r.filing_id for r in IN.broken_instances(rows).collect()} - {"S_4"} == {"S_2", "S_5"}


def test_large_filings_are_read_in_splits(spark, tmp_path):
    n = 60_000
    contexts = "".join(f'<context id="c{i}"><entity><identifier>E{i}</identifier></entity><period><instant>2024-03-31</instant></period></context>' for i in range(n // 10))
    facts = "\n".join(f'<in:Tag{i % 50} contextRef="c{i % (n // 10)}">{i}</in:Tag{i % 50}><!-- > -->' for i in range(n))
    for k in "AB":
        (tmp_path / f"{k}_1.xml").write_text(f"<xbrl xmlns:in='urn:in'>{contexts}{facts}</xbrl>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        d = IN.parse_filing_files(spark, str(tmp_path))
        assert spark.read.option("lineSep", ">").text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert d.count() == 2 * n and d.where("value <> ord OR entity <> concat('E', ord % 6000) OR instant_date IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_strings_of_several_slices_without_a_shuffle(spark, tmp_path):
    n = 3000
    facts = "".join(f'<f:T{i % 7} contextRef="c{i % 40}">{i}</f:T{i % 7}>' for i in range(n))
    contexts = "".join(f"<context id='c{i % 30}'><entity><identifier>E{i}</identifier></entity><period><startDate>2024-01-01</startDate><endDate>2024-0{1 + i % 9}-28</endDate></period></context>" for i in range(45))
    body = f"<xbrl xmlns:f='urn:f'>{facts}<f:endDate>2024-03-31</f:endDate>{contexts}<unit><measure>INR</measure></unit><unit><measure>USD</measure></unit>"
    texts = {"S_1": body + "</xbrl>", "S_2": body.replace("<f:endDate>2024-03-31</f:endDate>", "") + facts + "</xbrl>", "S_3": body + facts + "</wrong>", "S_4": AWKWARD.rstrip(), "S_5": AWKWARD.rstrip() + " " * IN.SLICE}
    assert min(len(texts[k]) for k in ("S_1", "S_2", "S_3")) > IN.SLICE > len(texts["S_4"])
    for k, v in texts.items():
        (tmp_path / f"{k}.xml").write_text(v)
    parsed = IN.parse_filings(spark.createDataFrame([("S", k, v) for k, v in texts.items()], "symbol string, filing_id string, xml string"))
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got, want = (sorted(map(repr, d.select(sorted(d.columns)).collect())) for d in (parsed, IN.parse_filing_files(spark, str(tmp_path))))
    assert got == want and len(got) == 5 * n + 2 + 2 * 6
    rows = {r.ord: r for r in parsed.where("filing_id = 'S_1'").collect()}
    assert [(rows[i].entity, rows[i].end_date, rows[i].period_end, rows[i].currency) for i in (0, 20, 35, n)] == [
        ("E30", dt.date(2024, 4, 28), dt.date(2024, 3, 31), "INR"), ("E20", dt.date(2024, 3, 28), dt.date(2024, 3, 31), "INR"),
        ("S", None, dt.date(2024, 3, 31), "INR"), ("S", None, dt.date(2024, 3, 31), "INR")]


def test_shareholding_instance(spark):
    tag, ids = "ShareholdingAsAPercentageOfTotalNumberOfShares", ("ShareholdingOfPromoterAndPromoterGroup", "PublicShareholding")
    facts = "".join(f'<s:{tag} contextRef="{i}_ContextI">{x}</s:{tag}>' for i, x in zip(ids, ("0.7177", "0.2823")))
    xml = f'<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:s="urn:s"><s:endDate>2026-06-30</s:endDate>{facts}</xbrli:xbrl>'
    r = FA.shareholding(IN.parse_filings(spark.createDataFrame([("A", "f", xml)], "symbol string, filing_id string, xml string"))).first().asDict()
    assert r["period_end"] == dt.date(2026, 6, 30) and sorted(x for x in r.values() if isinstance(x, float)) == [28.23, 71.77]


def test_histogram_quantiles(spark):
    d = spark.createDataFrame([("GET", "/a", le, c) for le, c in ((0.1, 3), (0.5, 5), (1.0, 5), (2.5, 5), (None, 5))], "method string, route string, le double, cum bigint")
    r = QL.histogram_quantile(d).first()
    assert (r.p50_ms, r.p95_ms) == (83.3, 450.0)
    slow = spark.createDataFrame([("GET", "/a", 0.1, 1), ("GET", "/a", None, 9)], "method string, route string, le double, cum bigint")
    assert QL.histogram_quantile(slow).first().p50_ms is None


def test_scalars(spark):
    d = spark.createDataFrame([(s,) for s in ("1,234.5", "nan", "inf", "", "abc", "-7", "1e3", "3d")], "s string")
    assert [r.v for r in d.select(X.to_float("s").alias("v")).collect()] == [1234.5, None, None, None, None, -7.0, 1000.0, None]
    p = spark.createDataFrame([("Mar 2024",), ("5 Feb 2024",), ("TTM",), ("12 Jan",), ("junk",)], "s string")
    assert [r.v for r in p.select(X.parse_period_label("s", 2025).alias("v")).collect()] == ["2024-03-31", "2024-02-05", "TTM", "2025-01-12", "junk"]
    r = spark.createDataFrame([(x,) for x in (2.675, 0.125, 2.5, -2.675, 1.005, -0.001)], "x double")
    got = [v.y for v in r.select(X.round_half_even_exact("x", 2).alias("y")).collect()]
    assert got == [round(x, 2) for x in (2.675, 0.125, 2.5, -2.675, 1.005, -0.001)]
    assert all(math.copysign(1, y) == 1 for y in got if y == 0)


def test_page_specs(spark):
    specs = ["3,5-9", "2,1,2", "1-x", " 4 , ", "8-2000000000", "0-2", "99999999999999999999", "7-3", "11-20"]
    d = spark.createDataFrame([(s, 10) for s in specs], "s string, n bigint")
    assert [r.p for r in d.select(TX.page_numbers("s", "n").alias("p")).collect()] == [[3, 5, 6, 7, 8, 9], [1, 2], None, [4], [8, 9, 10], [1, 2], [], [], []]


def test_mentions_match_brute_force(spark):
    import re

    texts = ["Buy TCS now, (TCS) TCSX xTCS", "M&M rose; M&MX fell", "code 500 and 15003 or A500", "", "S12 and S123, S1", "3M 33M A3M", "TCS"]
    symbols = ["TCS", "M&M", "500", "S12", "S1", "3M", "A.B", "12"]
    news = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    sym = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    got = sorted((r.id, r.symbol) for r in TX.symbol_mentions(news, sym, "id", F.col("body")).collect())
    want = sorted((i, s) for i, t in enumerate(texts) for s in symbols if re.search(rf"(?<![A-Za-z]){re.escape(s)}(?![A-Za-z])", t))
    assert got == want


@pytest.mark.parametrize("word", ["localCheckpoint", "crossJoin", ".collect()", "toPandas("])
def test_library_avoids(word):
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tapeline"
    assert not [p for p in root.rglob("*.py") if word in p.read_text()]


def test_read_side_does_not_import_streaming():
    import pathlib

    ops = pathlib.Path(__file__).parent.parent / "tapeline" / "operators"
    assert not [p for p in ops.glob("*.py") if "tapeline.streaming" in p.read_text() or "tapeline.plans" in p.read_text()]


def test_metrics_per_period_merges_the_statements_once(spark, sf):
    """three statements, the annual ends and the prices are read once each (8 reads before)."""
    from tapeline.registry import run

    plan = run("metrics_per_period", spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 5
