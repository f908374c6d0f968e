"""Domain tables derived from the parquet test tables.

Money is kept in whole minor units and every aggregate feeding a price or an
amount is an integer sum, so results do not depend on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.sources import schema as S


def _pc(c: str, percent: int) -> Column:
    return F.floor(F.col(c) * percent / 100)


def _unless(cond: Column, value: Column) -> Column:
    return F.when(~cond, value)


class Views:
    """Lazy views over one data folder; every property builds a plan, nothing runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- price bars ---------------------------------------------------------

    @cached_property
    def bars(self) -> DataFrame:
        """One bar per (symbol, date): an integer tick walk over the trades of a product type."""
        li = self.table("lineitem").select("l_partkey", "l_shipdate", "l_discount", "l_tax", "l_quantity")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("symbol"))
        qty = F.col("l_quantity").cast("bigint")
        day = (
            li.join(part, "l_partkey")
            .groupBy("symbol", F.col("l_shipdate").cast("date").alias("date"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("sd"),
                F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("st"),
                F.max(qty).alias("mq"),
                F.min(qty).alias("nq"),
                F.sum(qty).alias("volume"),
            )
        )
        win = Window.partitionBy("symbol").orderBy("date")
        step = F.floor(F.lit(30.0) * (F.col("sd") - 5 * F.col("n")) / F.col("n"))
        walk = day.withColumn(
            "close_t", F.lit(10000).cast("bigint") + F.sum(step).over(win.rowsBetween(Window.unboundedPreceding, 0))
        )
        pc = F.lag("close_t", 1, 10000).over(win)
        walk = walk.withColumn(
            "open_t", pc + F.floor(F.lit(10.0) * (F.col("st") - 4 * F.col("n")) / F.col("n"))
        )
        return walk.select(
            "symbol",
            "date",
            (F.col("open_t").cast("double") / 100).alias("open"),
            ((F.greatest("open_t", "close_t") + F.col("mq")).cast("double") / 100).alias("high"),
            ((F.least("open_t", "close_t") - F.col("nq")).cast("double") / 100).alias("low"),
            (F.col("close_t").cast("double") / 100).alias("close"),
            "volume",
        )

    @cached_property
    def raw_bars(self) -> DataFrame:
        """Bars as delivered by a feed: some closes missing, some zero-volume placeholders."""
        doy = F.dayofyear("date")
        nse = F.col("symbol") <= "PROMO"
        return self.bars.select(
            "symbol",
            F.when(nse, "NSE").otherwise("NASDAQ").alias("exchange"),
            F.when(nse, "in").otherwise("us").alias("country"),
            "date", "open", "high", "low",
            _unless(doy % 101 == 0, F.col("close")).alias("close"),
            F.col("close").alias("adjusted_close"),
            F.when(doy % 97 == 0, F.lit(0)).otherwise(F.col("volume")).cast("bigint").alias("volume"),
        )

    @cached_property
    def market_index(self) -> DataFrame:
        """Benchmark close per date: mean tick over all symbols, dates where every symbol traded."""
        ticks = self.bars.select("symbol", "date", F.round(F.col("close") * 100).cast("bigint").alias("t"))
        symbols = ticks.agg(F.count_distinct("symbol")).scalar()
        per_day = ticks.groupBy("date").agg(F.sum("t").alias("s"), F.count(F.lit(1)).alias("n"))
        return per_day.filter(F.col("n") == symbols).select("date", (F.floor(F.col("s") / F.col("n")).cast("double") / 100).alias("close"))

    @cached_property
    def quotes(self) -> DataFrame:
        """Daily close per filing company (minor units): traded value over traded quantity."""
        li = self.table("lineitem")
        qty = F.sum(F.col("l_quantity").cast("bigint"))
        cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
        return li.groupBy(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").cast("date").alias("date")
        ).agg(F.floor(cents / qty).cast("double").alias("close"), qty.alias("volume"))

    # -- statements ---------------------------------------------------------

    @cached_property
    def _filing_base(self) -> DataFrame:
        li = self.table("lineitem")
        d = F.col("l_shipdate").cast("date")
        price = F.col("l_extendedprice")
        q = li.groupBy(
            F.col("l_suppkey").alias("k"),
            F.year(d).alias("y"),
            F.quarter(d).alias("qn"),
            (F.col("l_linestatus") == "F").alias("consolidated"),
        ).agg(
            F.sum(F.round(price * 100).cast("bigint")).alias("rev"),
            F.sum(F.round(price * F.col("l_discount") * 100).cast("bigint")).alias("fcr"),
            F.sum(F.round(price * F.col("l_tax") * 100).cast("bigint")).alias("txr"),
        )
        quarterly = q.withColumn("filing_type", F.lit("quarterly"))
        annual = (
            q.groupBy("k", "y", "consolidated")
            .agg(F.sum("rev").alias("rev"), F.sum("fcr").alias("fcr"), F.sum("txr").alias("txr"))
            .withColumn("qn", F.lit(4))
            .withColumn("filing_type", F.lit("annual"))
        )
        base = quarterly.unionByName(annual)
        end = F.last_day(F.make_date(F.col("y"), F.col("qn") * 3, F.lit(1)))
        start = F.when(F.col("filing_type") == "annual", F.make_date(F.col("y"), F.lit(1), F.lit(1))).otherwise(
            F.make_date(F.col("y"), F.col("qn") * 3 - 2, F.lit(1))
        )
        even = F.col("k") % 2 == 0
        return base.select(
            F.concat(F.lit("S"), F.col("k")).alias("symbol"),
            F.when(even, "SEC").otherwise("NSE").alias("source"),
            F.when(even, "us").otherwise("in").alias("country"),
            "consolidated",
            "filing_type",
            end.alias("period_end_date"),
            start.alias("period_start_date"),
            F.concat(F.lit("Q"), F.col("qn").cast("string")).alias("fiscal_period"),
            F.when(F.col("filing_type") == "annual", "annual-results").otherwise("integrated-filing").alias("source_endpoint"),
            F.date_add(end, 45).cast("timestamp_ntz").alias("pulled_at"),
            "k", "qn", "rev", "fcr", "txr",
            (F.lit(1000) * (F.col("k") + 1)).alias("shares"),
        )

    _IDENTITY = (
        "symbol", "source", "country", "consolidated", "filing_type", "period_end_date",
        "period_start_date", "fiscal_period", "source_endpoint", "pulled_at",
    )

    def _statement(self, base: DataFrame, cols: dict[str, Column]) -> DataFrame:
        return base.select(*self._IDENTITY, *[c.cast("double").alias(n) for n, c in cols.items()])

    @cached_property
    def income(self) -> DataFrame:
        k, rev = F.col("k"), F.col("rev")
        expenses, fc, tax = _pc("rev", 80), F.floor(F.col("fcr") / 10), F.floor(F.col("txr") / 10)
        pbt = rev - expenses - fc
        pat = pbt - tax
        return self._statement(self._filing_base, {
            S.REVENUE: rev,
            "cost_of_revenue": _unless(k % 11 == 0, _pc("rev", 55)),
            "expenses": expenses,
            S.FINANCE: fc,
            S.DEPRECIATION: _unless(k % 13 == 0, _pc("rev", 4)),
            "operating_income": F.when(F.col("source") == "SEC", rev - expenses),
            S.PBT: pbt,
            "tax_expense": tax,
            S.PAT: pat,
            S.EPS_BASIC: pat.cast("double") / F.col("shares"),
            S.EPS_DILUTED: pat.cast("double") / (F.lit(1050) * (k + 1)),
            "weighted_average_shares_basic": F.when(k % 2 == 0, F.col("shares")),
        })

    @cached_property
    def balance(self) -> DataFrame:
        base = self._filing_base.filter(F.col("qn").isin(2, 4))
        k, rev = F.col("k"), F.col("rev")
        stub = (k % 5 == 0) & (F.col("qn") == 4)
        real = lambda c: _unless(stub, c)
        return self._statement(base, {
            "assets": real(rev * 4),
            "assets_current": real(_pc("rev", 180)),
            "noncurrent_assets": real(rev * 4 - _pc("rev", 180)),
            "equity_share_capital": real(F.col("shares") * 10),
            "other_equity": real(_pc("rev", 150)),
            "borrowings_current": real(_pc("rev", 30)),
            "borrowings_noncurrent": real(_pc("rev", 70)),
            "noncurrent_liabilities": real(_pc("rev", 90)),
            "current_liabilities": real(_pc("rev", 110)),
            "inventories": _unless(stub | (k % 7 == 0), _pc("rev", 25)),
            "trade_receivables_current": real(_pc("rev", 35)),
            "trade_payables": real(_pc("rev", 20)),
            S.CASH: real(_pc("rev", 15)),
            S.BANK: _unless(stub | (k % 4 == 1), _pc("rev", 2)),
            "reserve_excluding_revaluation_reserves": F.when((k % 3 == 0) & ~stub, _pc("rev", 140)),
            S.PAID_UP: F.col("shares") * 10,
            S.FACE: _unless(k % 17 == 0, F.lit(10)),
            "debt_equity_ratio": F.when(k % 9 == 0, F.lit(0.007)),
        })

    @cached_property
    def cashflow(self) -> DataFrame:
        base = self._filing_base.filter(F.col("qn") == 4)
        k = F.col("k")
        return self._statement(base, {
            S.OCF: _pc("rev", 22),
            S.CAPEX: _unless(k % 3 == 0, -_pc("rev", 9)),
            "dividends_paid": _unless(k % 4 == 3, -_pc("rev", 3)),
        })

    # -- filing facts -------------------------------------------------------

    @cached_property
    def filed_quarters(self) -> DataFrame:
        """One narrow row per filing: what its facts are made of."""
        return self.income.filter(F.col("filing_type") == "quarterly").select(
            "symbol", "consolidated", "period_start_date", "period_end_date", S.REVENUE, S.PAT, S.FINANCE
        )

    def fact_lists(self, quarters: DataFrame) -> DataFrame:
        """One row per filing with its facts in ``f``: repeated contexts, an old instant and unmapped tags."""
        q = F.col("period_end_date")
        year_start = F.make_date(F.year(q), F.lit(1), F.lit(1))

        def amount(c, factor=1):
            return (F.col(c) * factor).cast("bigint").cast("string")

        def fact(ordn, tag, value, ctx, start=None, end=None, instant=None):
            none = F.lit(None).cast("date")
            return F.struct(
                F.lit(ordn).alias("ord"), F.lit(tag).alias("tag"), value.alias("value"), F.lit(ctx).alias("context_ref"),
                (start if start is not None else none).alias("start_date"),
                (end if end is not None else none).alias("end_date"),
                (instant if instant is not None else none).alias("instant_date"),
            )

        s, e = F.col("period_start_date"), q
        rows = F.array(
            fact(1, "RevenueFromOperations", amount(S.REVENUE), "OneD", s, e),
            fact(2, "RevenueFromOperations", amount(S.REVENUE, 4), "FourD", year_start, e),
            fact(3, "ProfitLossForPeriod", amount(S.PAT), "OneD", s, e),
            fact(4, "ProfitLossForPeriod", amount(S.PAT, 4), "FourD", year_start, e),
            fact(5, "FinanceCosts", amount(S.FINANCE), "CustomA", F.date_sub(e, 91), e),
            fact(6, "FinanceCosts", amount(S.FINANCE, 4), "CustomB", F.date_sub(e, 364), e),
            fact(7, "Assets", amount(S.REVENUE, 4), "OneI", instant=e),
            fact(8, "Assets", amount(S.REVENUE, 3), "PriorI", instant=F.date_sub(e, 90)),
            fact(9, "CashFlowsFromUsedInOperatingActivities", amount(S.REVENUE, 2), "FourD", year_start, e),
            fact(10, "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities", amount(S.FINANCE, -2), "FourD", year_start, e),
            fact(11, "PurchaseOfIntangibleAssetsClassifiedAsInvestingActivities", amount(S.FINANCE, -1), "FourD", year_start, e),
            fact(12, "DescriptionOfSegmentPolicy", F.lit("n/a"), "OneD", s, e),
            fact(13, "DebtEquityRatio", F.lit("0.5"), "NoDates"),
        )
        return quarters.select(
            F.concat_ws("|", "symbol", F.col("period_end_date").cast("string"), F.col("consolidated").cast("string")).alias("filing_id"),
            "symbol", F.col("period_end_date").alias("period_end"),
            F.when(F.col("consolidated"), "integrated-filing").otherwise("annual-results").alias("category"),
            rows.alias("f"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        """Long fact list of all filings."""
        return self.fact_lists(self.filed_quarters).withColumn("f", F.explode("f")).select("filing_id", "symbol", "period_end", "category", "f.*")

    @cached_property
    def concept_periods(self) -> DataFrame:
        """Concept x period values: year-to-date per 10-Q quarter, full year per 10-K."""
        q = self._filing_base.filter((F.col("filing_type") == "quarterly") & F.col("consolidated") & (F.col("source") == "SEC"))
        win = (
            Window.partitionBy("symbol", F.year("period_end_date")).orderBy("period_end_date")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        ytd = q.select(
            "symbol", "period_end_date", "qn", "k", "shares",
            F.sum("rev").over(win).alias("rev"), F.sum("fcr").over(win).alias("fcr"), F.sum("txr").over(win).alias("txr"),
        )
        ytd = ytd.withColumn("form", F.when(F.col("qn") == 4, "10-K").otherwise("10-Q"))
        ni = F.col("rev") - _pc("rev", 80) - F.floor(F.col("fcr") / 10) - F.floor(F.col("txr") / 10)
        alt = F.col("k") % 4 == 0

        def c(statement, concept, value, cond=None):
            v = value if cond is None else F.when(cond, value)
            return F.struct(F.lit(statement).alias("statement"), F.lit(concept).alias("concept"), v.cast("double").alias("value"))

        rows = F.array(
            c("income", "us-gaap_RevenueFromContractWithCustomerExcludingAssessedTax", F.col("rev"), alt),
            c("income", "us-gaap_Revenues", F.col("rev"), ~alt),
            c("income", "us-gaap_NetIncomeLoss", ni),
            c("income", "us-gaap_InterestExpense", F.floor(F.col("fcr") / 10)),
            c("income", "us-gaap_CostOfRevenue", _pc("rev", 55), F.col("k") % 6 != 0),
            c("income", "us-gaap_OperatingIncomeLoss", F.col("rev") - _pc("rev", 80)),
            c("income", "us-gaap_WeightedAverageNumberOfSharesOutstandingBasic", F.col("shares")),
            c("income", "us-gaap_WeightedAverageNumberOfDilutedSharesOutstanding", F.lit(1050) * (F.col("k") + 1)),
            c("income", "us-gaap_DepreciationDepletionAndAmortization", _pc("rev", 4), F.col("k") % 8 == 0),
            c("cashflow", "us-gaap_NetCashProvidedByUsedInOperatingActivities", _pc("rev", 22)),
            c("cashflow", "us-gaap_PaymentsToAcquirePropertyPlantAndEquipment", _pc("rev", 9)),
            c("cashflow", "us-gaap_Depreciation", _pc("rev", 3)),
            c("cashflow", "us-gaap_AmortizationOfIntangibleAssets", _pc("rev", 1), F.col("k") % 3 == 0),
            c("balance", "us-gaap_Assets", F.col("rev") * 4),
            c("balance", "us-gaap_CommonStockValue", F.col("shares") * 10, F.col("k") % 3 != 0),
            c("balance", "us-gaap_StockholdersEquity", F.col("shares") * 10 + _pc("rev", 150)),
            c("balance", "us-gaap_LiabilitiesAndStockholdersEquity", F.col("rev") * 4),
            c("balance", "us-gaap_Liabilities", F.col("rev") * 4 - F.col("shares") * 10 - _pc("rev", 152)),
        )
        return (
            ytd.withColumn("c", F.explode(rows))
            .select("symbol", "form", F.col("period_end_date").alias("period_end"), "c.*")
            .filter(F.col("value").isNotNull())
        )

    # -- news, requests, options, membership ----------------------------------

    @cached_property
    def news(self) -> DataFrame:
        """One story per document; exact copies share a url on purpose."""
        base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        # the first 80 characters stand in for a title, everything after them for the summary
        return self.table("documents").select(
            "doc_id",
            F.when(F.col("lang") == "en", "us").otherwise("in").alias("country"),
            "source",
            F.md5(F.col("text")).alias("url"),
            F.substring("text", 1, 80).alias("title"),
            F.expr("substring(text, 81)").alias("summary"),
            (base + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("published_at"),
            "text",
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("key"),
            "ts",
            F.lit("GET").alias("method"),
            F.col("event_type").alias("route"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
            F.col("value").alias("latency_ms"),
            "event_id",
        )

    @cached_property
    def option_chain(self) -> DataFrame:
        li = self.table("lineitem").select(
            "l_partkey", "l_shipdate", "l_returnflag", "l_quantity", "l_linenumber", "l_orderkey", "l_extendedprice", "l_suppkey"
        )
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
        d = F.col("l_shipdate").cast("date")
        flag = F.col("l_returnflag")
        return li.join(part, "l_partkey").select(
            F.col("p_type").alias("underlying"),
            (F.col("p_size") * 100).alias("strike"),
            F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1))).alias("expiry"),
            F.when(flag == "A", "CE").when(flag == "R", "PE").otherwise("XX").alias("option_type"),
            F.col("l_quantity").cast("bigint").alias("oi"),
            F.col("l_linenumber").cast("bigint").alias("doi"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("value_minor"),
        )

    @cached_property
    def index_members(self) -> DataFrame:
        sup = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
        nation = self.table("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
        region = self.table("region").select("r_regionkey", "r_name")
        return (
            sup.join(nation, "n_nationkey").join(region, "r_regionkey")
            .select(
                F.col("r_name").alias("index_name"),
                F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
                F.when(F.col("s_suppkey") % 2 == 0, "NASDAQ").otherwise("NSE").alias("exchange"),
                F.when(F.col("s_suppkey") % 2 == 0, "us").otherwise("in").alias("country"),
                F.col("n_name").alias("industry"),
            )
        )

    @cached_property
    def stock_metadata(self) -> DataFrame:
        sup = self.table("supplier")
        k = F.col("s_suppkey")
        return sup.select(
            F.concat(F.lit("S"), k).alias("symbol"),
            F.when(k % 2 == 0, F.when(k % 6 == 0, "NYSE")).otherwise("NSE").alias("exchange"),
            F.when(k % 2 == 0, "us").otherwise("in").alias("country"),
        )

    @cached_property
    def insider_tx(self) -> DataFrame:
        o = self.table("orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
        c = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("company"))
        return o.join(c, "o_custkey").select(
            "company",
            F.col("o_custkey").alias("insider"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.round("o_totalprice").cast("bigint").alias("remaining_shares"),
            F.col("o_orderkey").alias("ord"),
        )

    @cached_property
    def quarter_growth(self) -> DataFrame:
        """Latest quarterly revenue and its percent change per company (snapshot fixture)."""
        q = self.income.filter((F.col("filing_type") == "quarterly") & F.col("consolidated"))
        win = Window.partitionBy("symbol").orderBy(F.col("period_end_date").desc())
        r = q.select("symbol", "period_end_date", F.col(S.REVENUE).alias("last"),
                     F.lead(S.REVENUE).over(win).alias("prev"), F.row_number().over(win).alias("rn"))
        return r.filter("rn = 1").select(
            "symbol", "period_end_date", "last", "prev",
            F.round(F.try_divide(F.col("last") - F.col("prev"), F.col("prev")) * 100, 4).alias("change_pct"),
        )

    _BAR_SYMBOLS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

    def _bar_symbol(self, key: str) -> Column:
        names = F.array(*[F.lit(s) for s in self._BAR_SYMBOLS])
        return names[F.pmod(F.col(key), F.lit(len(self._BAR_SYMBOLS))).cast("int")]

    @cached_property
    def announcements(self) -> DataFrame:
        """Announcements of the bar symbols; title and date sit in alternative fields."""
        k = F.col("doc_id")
        title = F.when(k % 7 != 0, F.col("title"))
        day = F.date_format("published_at", "yyyy-MM-dd")
        return self.news.select(
            self._bar_symbol("doc_id").alias("symbol"), F.col("doc_id").alias("ord"), "published_at",
            F.when(k % 3 == 0, title).alias("heading"), F.when(k % 3 == 1, title).alias("subject"),
            F.when(k % 3 == 2, title).alias("title"),
            F.when(k % 2 == 0, day).alias("date"), F.when(k % 2 == 1, day).alias("broadcast_date"),
        )

    @cached_property
    def earnings(self) -> DataFrame:
        """Earnings calendar entries of the bar symbols."""
        return self.table("orders").select(
            self._bar_symbol("o_orderkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_orderkey").alias("ord"), F.round(F.col("o_totalprice") / 1000, 2).alias("eps_estimate"),
            F.when(F.col("o_orderstatus") == "F", F.round(F.col("o_totalprice") / 900, 2)).alias("eps_reported"),
        )
