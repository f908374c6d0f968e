"""Filing facts to statements, and the concept-frame derivation of quarterly rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.scalars import WORD_STARTS, camel_to_snake, duration_class, fiscal_quarter, nonzero, safe_div
from tapeline.sources import schema as S

# Context ids with a known period class.
QUARTER_CONTEXTS, ANNUAL_CONTEXTS = ("OneD", "OneI"), ("FourD", "FourI")
# Filing categories and the period class they report.
QUARTER_CATEGORIES, ANNUAL_CATEGORIES = ("integrated-filing", "quarterly-results", "integrated"), ("annual-results",)


def tag_dimension(spark: SparkSession) -> DataFrame:
    """tag -> statement, column, category: the fixed catalog, under a hundred rows."""
    rows = [(t[1], S.CATEGORY_STATEMENT.get(t[0]), t[0], t[2] if len(t) > 2 else None, i) for i, t in enumerate(S.TAG_CATALOG)]
    d = spark.createDataFrame(rows, "tag string, statement string, category_of_tag string, override string, tag_id int")
    return d.select("tag", "tag_id", "statement", "category_of_tag", F.coalesce("override", camel_to_snake("tag")).alias("column"))


def statement_columns(statement: str) -> list[str]:
    """Store columns of a statement in catalog order."""
    out = []
    for t in S.TAG_CATALOG:
        if S.CATEGORY_STATEMENT.get(t[0]) == statement:
            name = t[2] if len(t) > 2 else snake(t[1])
            if name not in out:
                out.append(name)
    return out


def snake(tag: str) -> str:
    """``camel_to_snake`` by the same rule, for naming columns on the driver."""
    for boundary in WORD_STARTS:
        tag = re.sub(boundary, r"\1_\2", tag)
    return tag.lower()


def with_tags(facts: DataFrame, dim: DataFrame, how: str = "left") -> DataFrame:
    """Facts with their catalog entry; the dimension is the fixed tag list, so it is broadcast."""
    return facts.join(F.broadcast(dim), "tag", how)


def filter_by_period(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts of the filing's own period class.

    Instants and undated facts always stay; known context ids decide first, other
    ranges by their length; a quarterly filing also keeps annual cash-flow facts,
    which are only published for the full year.
    """
    c = F.col
    d = with_tags(facts, dim)
    cash = F.coalesce(c("category_of_tag") == "cash_flow", F.lit(False))
    quarter_filing, annual_filing = c("category").isin(*QUARTER_CATEGORIES), c("category").isin(*ANNUAL_CATEGORIES)
    q_ctx, a_ctx = c("context_ref").isin(*QUARTER_CONTEXTS), c("context_ref").isin(*ANNUAL_CONTEXTS)
    length = duration_class("start_date", "end_date")
    keep = (
        F.when(~quarter_filing & ~annual_filing, True)
        .when(c("instant_date").isNotNull() & c("start_date").isNull(), True)
        .when(q_ctx, quarter_filing)
        .when(a_ctx, annual_filing | (quarter_filing & cash))
        .when(c("start_date").isNotNull() & c("end_date").isNotNull(), F.when(
            quarter_filing, F.coalesce((length == "quarter") | ((length == "annual") & cash), F.lit(False))
        ).otherwise(F.coalesce(length == "annual", F.lit(False))))
        .otherwise(True)
    )
    return d.filter(keep)


def period_start_mode(facts: DataFrame) -> DataFrame:
    """Most common start date per filing; the first seen wins ties."""
    per = facts.filter(F.col("start_date").isNotNull()).groupBy("filing_id", "start_date").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("o")
    )
    return per.groupBy("filing_id").agg(F.max_by("start_date", F.struct(F.col("n"), -F.col("o"))).alias("period_start_date"))


def collapse(facts: DataFrame) -> DataFrame:
    """One value per (filing, statement, column).

    Several distinct tags on one column add up; one tag in several contexts is a
    pick, never a sum: dated at the period end, else the latest date, else undated,
    first in document order among equals.
    """
    date = F.coalesce("end_date", "instant_date")
    rank = F.when(date.isNull(), 0).when(date == F.col("period_end"), 2).otherwise(1)
    # one whole number orders the candidates (class, then date, then earliest in the document), so the
    # aggregation buffers stay fixed-width and hash-aggregate map-side
    day = F.coalesce(F.unix_date(date), F.lit(0)).cast("bigint") + 1_000_000
    order = rank.cast("bigint") * 2**56 + day * 2**32 + (2**32 - 1 - F.col("ord"))
    number = F.col("value").try_cast("decimal(28,6)")
    g = facts.filter(F.col("statement").isNotNull()).groupBy("filing_id", "symbol", "period_end", "statement", "column").agg(
        (F.min("tag_id") != F.max("tag_id")).alias("_several"),
        F.max_by(number, F.when(F.col("value").isNotNull(), order)).alias("_pick"), F.sum(number).alias("_sum"),
    )
    value = F.when(F.col("_several"), F.col("_sum")).otherwise(F.col("_pick"))
    return g.select("filing_id", "symbol", "period_end", "statement", "column", value.cast("double").alias("value"))


def statement_pivot(values: DataFrame, statement: str, columns: list[str] | None = None) -> DataFrame:
    """One wide row per filing; columns come from the catalog, never from the data."""
    columns = columns or statement_columns(statement)
    d = values.filter(F.col("statement") == statement)
    return d.groupBy("filing_id", "symbol", "period_end").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    )


def flatten_facts(facts: DataFrame) -> DataFrame:
    """Per tag: the last quarterly-context fact, else the first fact; and the first-quarterly variant."""
    quarterly = F.col("context_ref").contains("OneI") | F.col("context_ref").contains("OneD")
    o = F.col("ord")
    return facts.groupBy("filing_id", "tag").agg(
        F.coalesce(F.max_by("value", F.when(quarterly, o)), F.min_by("value", o)).alias("flat_value"),
        F.coalesce(F.min_by("value", F.when(quarterly, o)), F.min_by("value", o)).alias("quarterly_value"),
    )


# Ownership contexts and their columns.
OWNERSHIP_CONTEXTS = {
    "ShareholdingOfPromoterAndPromoterGroupI": "promoters_and_promoter_group",
    "InstitutionsForeignI": "foreign_institutional_investors",
    "InstitutionsDomesticI": "domestic_institutional_investors",
    "NonInstitutionsI": "non_institutions",
    "PublicShareholdingI": "public_shareholding",
    "SharesHeldByNonPromoterNonPublicShareholdersI": "non_promoter_non_public_shareholding",
}
OWNERSHIP_TAG = "ShareholdingAsAPercentageOfTotalNumberOfShares"


def shareholding(facts: DataFrame) -> DataFrame:
    """One row per filing with the six known ownership shares; fractions become percent."""
    ctx = F.replace(F.col("context_ref"), F.lit("_Context"), F.lit(""))
    v = F.col("value").try_cast("double")
    d = facts.withColumn("_ctx", ctx).filter((F.col("tag") == OWNERSHIP_TAG) & F.col("_ctx").isin(*OWNERSHIP_CONTEXTS))
    d = d.withColumn("_v", F.when(v < 1, F.round(v * 100, 4)).otherwise(v))
    return d.groupBy("symbol", "period_end").agg(
        *[F.max(F.when(F.col("_ctx") == c, F.col("_v"))).alias(name) for c, name in OWNERSHIP_CONTEXTS.items()]
    )


# -- concept frames -----------------------------------------------------------------------


def unpivot_periods(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Concept x period frame to long rows: every non-key column is a period."""
    periods = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, periods, "period_end", "value").withColumn("period_end", F.col("period_end").cast("date"))


def merge_concept_frames(frames: list[DataFrame], keys=("symbol", "concept", "period_end")) -> DataFrame:
    """First non-null value per concept and period over filings in their order."""
    parts = [f.withColumn("_batch", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("value").isNotNull())
    return both.groupBy(*keys).agg(F.min_by("value", "_batch").alias("value"))


def concept_dimension(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    rows = [(c, tag, i) for c, tags in mapping.items() for i, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "column string, concept string, prio int")


def coalesce_tags(concepts: DataFrame, dim: DataFrame, keys=("symbol", "period_end")) -> DataFrame:
    """First non-null among the ordered concepts of each column: (key, column, value)."""
    d = concepts.filter(F.col("value").isNotNull()).join(F.broadcast(dim), "concept")  # dim: the fixed concept lists
    return d.groupBy(*keys, "column").agg(F.min_by("value", "prio").alias("value"))


def sum_tags(concepts: DataFrame, parts: list[str], column: str, keys=("symbol", "period_end")) -> DataFrame:
    """All parts present added up, no row when there is none."""
    d = concepts.filter(F.col("concept").isin(*parts) & F.col("value").isNotNull())
    return d.groupBy(*keys).agg(F.sum("value").alias("value")).withColumn("column", F.lit(column))


def diff_cumulative(concepts: DataFrame, keys=("symbol",), gap: int = S.MAX_QUARTER_GAP_DAYS) -> DataFrame:
    """Year-to-date values to single quarters.

    The previous column is the series' previous period, not the concept's: a concept
    missing there gives null. A longer gap starts a new year and keeps the value.
    Instead of a dense concept-by-period grid each row meets its one previous period.
    """
    k = list(keys)
    periods = concepts.select(*k, "period_end").distinct()
    periods = periods.withColumn("_prev", F.lag("period_end").over(Window.partitionBy(*k).orderBy("period_end")))
    prev = concepts.select(*k, "concept", F.col("period_end").alias("_prev"), F.col("value").alias("_pv"))
    d = concepts.join(periods, [*k, "period_end"]).join(prev, [*k, "concept", "_prev"], "left")
    single = F.when(F.datediff("period_end", "_prev") <= gap, F.col("value") - F.col("_pv")).otherwise(F.col("value"))
    return d.select(*k, "concept", "period_end", single.alias("value"))


def q4_asof(annual: DataFrame, quarters: DataFrame, gap: int = S.MAX_QUARTER_GAP_DAYS) -> DataFrame:
    """Per annual period the latest quarter strictly before it within ``gap`` days.

    The bounded look-back is one ordered pass per company over the union of both
    period lists (a range frame), so no range join is needed.
    """
    a = annual.select("symbol", F.col("period_end").alias("d"), F.lit(1).alias("is_annual"), F.lit(None).cast("date").alias("q"))
    q = quarters.select("symbol", F.col("period_end").alias("d"), F.lit(0).alias("is_annual"), F.col("period_end").alias("q"))
    win = Window.partitionBy("symbol").orderBy(F.unix_date("d")).rangeBetween(-gap, -1)
    u = a.unionByName(q).withColumn("ytd_period", F.max("q").over(win))
    return u.filter((F.col("is_annual") == 1) & F.col("ytd_period").isNotNull()).select("symbol", F.col("d").alias("annual_period"), "ytd_period")


def q4_values(concepts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Concepts present in both the annual and the nine-month frame: full year minus year-to-date."""
    a = concepts.filter(F.col("form") == "10-K").select("symbol", "statement", "concept", F.col("period_end").alias("annual_period"), F.col("value").alias("fy"))
    y = concepts.filter(F.col("form") == "10-Q").select("symbol", "statement", "concept", F.col("period_end").alias("ytd_period"), F.col("value").alias("ytd"))
    d = a.join(pairs, ["symbol", "annual_period"]).join(y, ["symbol", "statement", "concept", "ytd_period"])
    return d.filter(F.col("fy").isNotNull() & F.col("ytd").isNotNull()).select(
        "symbol", "statement", "concept", "annual_period", "ytd_period", (F.col("fy") - F.col("ytd")).alias("value")
    )


BASIC_SHARES = "us-gaap_WeightedAverageNumberOfSharesOutstandingBasic"
DILUTED_SHARES = "us-gaap_WeightedAverageNumberOfDilutedSharesOutstanding"
NET_INCOME = "us-gaap_NetIncomeLoss"


def q4_eps(q4: DataFrame, concepts: DataFrame) -> DataFrame:
    """Fourth-quarter EPS: its net income over the annual share counts."""
    ni = q4.filter(F.col("concept") == NET_INCOME).select("symbol", "annual_period", F.col("value").alias("ni"))
    sh = concepts.filter((F.col("form") == "10-K") & F.col("concept").isin(BASIC_SHARES, DILUTED_SHARES)).groupBy(
        "symbol", F.col("period_end").alias("annual_period")
    ).agg(*[F.max(F.when(F.col("concept") == c, F.col("value"))).alias(n) for c, n in ((BASIC_SHARES, "b"), (DILUTED_SHARES, "d"))])
    return ni.join(sh, ["symbol", "annual_period"]).select(
        "symbol", "annual_period", safe_div("ni", nonzero("b")).alias(S.EPS_BASIC), safe_div("ni", nonzero("d")).alias(S.EPS_DILUTED)
    )


def to_wide(values: DataFrame, columns: list[str], keys=("symbol", "period_end")) -> DataFrame:
    return values.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def income_rows(spark: SparkSession, concepts: DataFrame, annual: bool) -> DataFrame:
    """Income rows per period; depreciation falls back to the cash-flow parts, share counts stay annual-only."""
    form = "10-K" if annual else "10-Q"
    d = concepts.filter(F.col("form") == form)
    inc, cash = d.filter(F.col("statement") == "income"), d.filter(F.col("statement") == "cashflow")
    if not annual:
        inc, cash = diff_cumulative(inc.drop("form", "statement")), diff_cumulative(cash.drop("form", "statement"))
    cols = list(S.INCOME_CONCEPTS)
    wide = to_wide(coalesce_tags(inc, concept_dimension(spark, S.INCOME_CONCEPTS)), cols)
    parts = sum_tags(cash, S.DEPRECIATION_PARTS, S.DEPRECIATION).select("symbol", "period_end", F.col("value").alias("_da"))
    wide = wide.join(parts, ["symbol", "period_end"], "left").withColumn(S.DEPRECIATION, F.coalesce(S.DEPRECIATION, "_da")).drop("_da")
    if not annual:
        none = F.lit(None).cast("double")
        wide = wide.withColumns({"weighted_average_shares_basic": none, "weighted_average_shares_diluted": none})
    return wide.withColumn("filing_type", F.lit("annual" if annual else "quarterly"))


def cashflow_rows(spark: SparkSession, concepts: DataFrame, form: str) -> DataFrame:
    """Cash-flow rows per period: full years of 10-K, single quarters of 10-Q, or ``Q4``, the rest of the year.

    Operating cash flow fills both of its columns. Every period of the statement has a row, also
    when none of the columns is tagged.
    """
    cash = concepts.filter(F.col("statement") == "cashflow")
    if form == "Q4":
        ends = cash.select("symbol", "form", "period_end").distinct()
        d = q4_values(cash, q4_asof(ends.filter("form = '10-K'"), ends.filter("form = '10-Q'")))
        d = d.select("symbol", "concept", F.col("annual_period").alias("period_end"), "value")
    else:
        d = cash.filter(F.col("form") == form).drop("form", "statement")
        d = diff_cumulative(d) if form == "10-Q" else d
    columns = list(S.CASHFLOW_CONCEPTS)
    values = coalesce_tags(d, concept_dimension(spark, S.CASHFLOW_CONCEPTS))
    periods = d.select("symbol", "period_end", F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("value"))
    wide = to_wide(values.select("symbol", "period_end", "column", "value").unionByName(periods), columns)
    return wide.withColumns({S.OCF_ALIAS: F.col(S.OCF), "filing_type": F.lit("annual" if form == "10-K" else "quarterly")})


def balance_rows(spark: SparkSession, concepts: DataFrame) -> DataFrame:
    """Balance rows with the equity split and total equity from liabilities when untagged."""
    d = concepts.filter(F.col("statement") == "balance")
    wide = to_wide(coalesce_tags(d, concept_dimension(spark, S.BALANCE_CONCEPTS)), list(S.BALANCE_CONCEPTS))
    extra = d.groupBy("symbol", "period_end").agg(
        F.max(F.when(F.col("concept") == "us-gaap_LiabilitiesAndStockholdersEquity", F.col("value"))).alias("_le"),
        F.max(F.when(F.col("concept") == "us-gaap_Liabilities", F.col("value"))).alias("_l"),
    )
    return equity_split(wide.join(extra, ["symbol", "period_end"], "left")).drop("_le", "_l")


def equity_split(d: DataFrame) -> DataFrame:
    sc, eq = F.col("equity_share_capital"), F.col("stockholders_equity")
    return d.withColumns({
        "other_equity": F.when(sc.isNotNull() & eq.isNotNull(), eq - sc).otherwise(eq),
        "total_equity_including_nci": F.coalesce("total_equity_including_nci", F.col("_le") - F.col("_l")),
    })


def stamp_fiscal_quarter(d: DataFrame, fye: Column) -> DataFrame:
    return d.withColumn("_fye", fye).withColumn("fiscal_period", fiscal_quarter("period_end", "_fye")).drop("_fye")


def announcements_8k(filings: DataFrame) -> DataFrame:
    """Filing list to announcement rows with the archive address built from its parts."""
    acc = F.replace(F.col("accession"), F.lit("-"), F.lit(""))
    url = F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.col("cik").cast("string"), acc, F.col("document"))
    return filings.select("symbol", F.date_format("filing_date", "yyyy-MM-dd").alias("date"), F.col("description").alias("heading"),
                          F.col("form").alias("category"), url.alias("url"))
