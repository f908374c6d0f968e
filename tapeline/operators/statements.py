"""Statement series: merge, carry-forward, period offsets, TTM windows, fallbacks, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.scalars import fye_day, nonzero, safe_div
from tapeline.sources import schema as S

SERIES = [*S.SERIES_KEY, "filing_type"]
KEY = S.STATEMENT_KEY
META = ["country", "period_start_date", "fiscal_period", "source_endpoint", "pulled_at"]


def measures(df: DataFrame) -> list[str]:
    """Value columns of a statement frame."""
    return [c for c in df.columns if c not in KEY + META]


def merge_statements(income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    """One record per period over the union of the three statements' periods.

    The three frames are stacked, dealt by series once and grouped instead of joined: the
    group and all windows over the series share that shuffle. Inside a statement the
    first endpoint of a period wins, whole; identity columns come from the last
    statement that has the period, ``fiscal_period`` from the first non-null. Rows that
    tie are ordered by a hash of the whole row, so a result never depends on task order.
    """
    frames = (income, balance, cashflow)
    parts = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    stacked = stacked.withColumn("_tie", F.xxhash64(*stacked.columns)).repartition(*SERIES)
    own = [measures(f) for f in frames]
    mine = [F.col("_rank") == i for i in range(len(frames))]
    last = [c for c in META if c != "fiscal_period"]
    g = stacked.groupBy(*KEY).agg(
        F.max_by(F.struct(*last), F.struct("_rank", "_tie")).alias("_last"),
        F.min_by("fiscal_period", F.when(F.col("fiscal_period").isNotNull(), F.struct("_rank", "_tie"))).alias("fiscal_period"),
        *[F.min_by(F.struct(*[F.col(c).cast("double").alias(c) for c in cols]), F.when(m, F.struct("source_endpoint", "_tie"))).alias(f"_s{i}") for i, (cols, m) in enumerate(zip(own, mine))],
        *[F.max(F.when(m, F.col("period_end_date"))).alias(n) for n, m in zip(("_inc_end", "_bal_end", "_cf_end"), mine)])
    return g.select(*KEY, *[F.col(f"_last.{c}").alias(c) for c in last], "fiscal_period", *[F.col(f"_s{i}.{c}").alias(c) for i, cols in enumerate(own) for c in cols], "_inc_end", "_bal_end", "_cf_end")


def newest_first() -> Column:
    return F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("period_end_date").desc()))


def carry_forward(merged: DataFrame, fields: list[str], days: int = S.CARRY_FORWARD_DAYS) -> DataFrame:
    """Fill each missing stock column from the nearest older record within ``days`` days."""
    win = (
        Window.partitionBy(*SERIES).orderBy(F.unix_date("period_end_date")).rangeBetween(-days, 0)
    )
    return merged.withColumns({c: F.last(c, ignorenulls=True).over(win) for c in fields})


def balance_fields(balance: DataFrame) -> list[str]:
    return measures(balance)


def in_period_range(gte: str | None = None, lte: str | None = None) -> Column:
    def bound(text):
        return F.try_to_timestamp(F.lit(text), F.lit("yyyy-MM-dd")).cast("date")

    inside = F.lit(True)
    if gte is not None:
        inside &= F.coalesce(F.col("period_end_date") >= bound(gte), F.lit(True))
    if lte is not None:
        inside &= F.coalesce(F.col("period_end_date") <= bound(lte), F.lit(True))
    return inside


def filter_period_range(df: DataFrame, gte: str | None = None, lte: str | None = None) -> DataFrame:
    """Inclusive bounds on the period end; a bound that is no date is ignored."""
    return df.filter(in_period_range(gte, lte))


def same_month(months_back: int, ref: Column) -> Column:
    return F.trunc("period_end_date", "MM") == F.add_months(F.trunc(ref, "MM"), -months_back)


def period_offset(df: DataFrame, value: str, months: int) -> DataFrame:
    """Value of the record ``months`` calendar months before each record, null when there is none.

    The lookup goes by calendar month, not by row, so missing quarters stay missing.
    """
    base = df.select(*SERIES, "period_end_date", F.col(value).alias("value"))
    prev = base.groupBy(*SERIES, F.add_months(F.trunc("period_end_date", "MM"), months).alias("_m")).agg(
        F.max_by("value", "period_end_date").alias("previous")
    )
    out = base.withColumn("_m", F.trunc("period_end_date", "MM")).join(prev, [*SERIES, "_m"], "left")
    return out.drop("_m")


# Flow columns summed over four quarters; the sparse ones sum what exists.
FLOWS = [
    S.REVENUE, S.PBT, S.PAT, S.FINANCE, S.DEPRECIATION, S.OCF, S.CAPEX, S.EPS_BASIC,
    "cost_of_revenue", "expenses", "tax_expense", "dividends_paid",
]
SPARSE_FLOWS = [S.OCF, S.CAPEX, "dividends_paid"]


def ttm_sum(c: str, start: int, strict: bool) -> Column:
    """Sum over newest-first rows start+1 .. start+4 (aggregate over a series with ``_rn``)."""
    inside = F.col("_rn").between(start + 1, start + 4)
    total = F.sum(F.when(inside, F.col(c)))
    if not strict:
        return total
    return F.when(F.count(F.when(inside, F.col(c))) == 4, total)


def ttm_windows(records: DataFrame, fields: list[str], start: int = 0) -> DataFrame:
    """TTM sums of one row per series."""
    d = records.withColumn("_rn", newest_first())
    return d.groupBy(*SERIES).agg(*[ttm_sum(c, start, c not in SPARSE_FLOWS).alias(c) for c in fields])


def ttm_completeness(records: DataFrame) -> DataFrame:
    """Quarters with revenue among the newest four, and TTM revenue with its single-quarter fallback."""
    d = records.withColumn("_rn", newest_first())
    used = F.count(F.when(F.col("_rn") <= 4, F.col(S.REVENUE)))
    ttm = ttm_sum(S.REVENUE, 0, True)
    latest = F.max(F.when(F.col("_rn") == 1, F.col(S.REVENUE)))
    return d.groupBy(*SERIES).agg(
        used.alias("ttm_quarters_used"), (used >= 4).alias("ttm_window_complete"), F.coalesce(ttm, latest).alias("revenue")
    )


def latest_annual_end(balance: DataFrame) -> DataFrame:
    a = balance.filter(F.col("filing_type") == "annual")
    return a.groupBy(*S.SERIES_KEY).agg(F.max("period_end_date").alias("annual_end"))


def period_marks() -> Column:
    """Aggregate: (month, tagged Q4, period end) of every record of a series - bounded by its quarters."""
    return F.collect_list(F.struct(F.month("period_end_date").alias("m"), F.coalesce(F.upper("fiscal_period") == "Q4", F.lit(False)).alias("q4"),
                                   F.col("period_end_date").alias("d")))


def fye_from_marks(marks: str) -> Column:
    """Fiscal-year-end month: the modal month of Q4 records (newest wins ties), else the uniquely rarest month of four or more."""
    per_month = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.struct(
        F.size(F.filter(marks, lambda x: x["q4"] & (x["m"] == m))).alias("n"),
        F.array_max(F.transform(F.filter(marks, lambda x: x["q4"] & (x["m"] == m)), lambda x: x["d"])).alias("seen"), m.alias("m")))
    counts = F.filter(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.struct(
        F.size(F.filter(marks, lambda x: x["m"] == m)).alias("n"), m.alias("m"))), lambda c: c["n"] > 0)
    rare = F.array_sort(counts)
    alone = (F.size(rare) == 1) | (F.try_element_at(rare, F.lit(2))["n"] > F.try_element_at(rare, F.lit(1))["n"])
    untagged = F.when((F.size(marks) >= 4) & alone, F.try_element_at(rare, F.lit(1))["m"])
    return F.when(F.exists(marks, lambda x: x["q4"]), F.array_max(per_month)["m"]).otherwise(untagged)


def fye_month(records: DataFrame, keys=SERIES) -> DataFrame:
    marked = records.groupBy(*keys).agg(period_marks().alias("_marks"))
    return marked.select(*keys, fye_from_marks("_marks").alias("fye_month"))


def annual_end_inferred(latest: Column, fye: Column, filed: Column) -> tuple[Column, Column]:
    """(last annual end as text, its source): filed date, else inferred from the fiscal-year-end month."""
    year = F.when(F.month(latest) >= fye, F.year(latest)).otherwise(F.year(latest) - 1)
    guess = F.format_string("%d-%02d-%d", year, fye, fye_day(fye))
    value = F.when(filed.isNotNull(), F.date_format(filed, "yyyy-MM-dd")).when(fye.isNotNull(), guess)
    source = F.when(filed.isNotNull(), "filing").when(fye.isNotNull(), "inferred").otherwise("unknown")
    return value, source


def latest_per_key(df: DataFrame, keys, order="period_end_date") -> DataFrame:
    """Newest row per key with map-side combine."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), F.struct(order, F.xxhash64(*rest))).alias("_r")).select(*keys, "_r.*")


def consolidated_fallback(df: DataFrame) -> DataFrame:
    """Consolidated rows, plus standalone rows for periods without a consolidated one.

    One grouped pass instead of an anti join: a standalone row survives when its
    period's group holds no consolidated row.
    """
    keys = [c for c in KEY if c != "consolidated"]
    has = F.max(F.col("consolidated").cast("int")).over(Window.partitionBy(*keys)) == 1
    return df.withColumn("_has", has).filter(F.col("consolidated") | ~F.col("_has")).drop("_has")


def populated_balance(balance: DataFrame, look: int = 12) -> DataFrame:
    """Newest of each series' latest twelve balance rows that carries real statement values.

    A ratio-only stub must not shadow the last real balance sheet; with only stubs
    the newest row is used.
    """
    real = [c for c in S.PRIORITY["balance_sheets"] if c in balance.columns and c not in S.STUB_BALANCE]
    d = balance.withColumn("_rn", newest_first()).filter(F.col("_rn") <= look)
    full = F.coalesce(*[F.col(c) for c in real]).isNotNull()
    d = d.withColumn("_o", F.struct(full.cast("int").alias("f"), F.col("period_end_date").alias("d")))
    return latest_per_key(d.drop("_rn"), SERIES, "_o").drop("_o")


def snapshot_fallback(statement: DataFrame, name: str, picker=None) -> DataFrame:
    """Latest consolidated row per issuer, or the latest standalone one when none was ever filed."""
    newest = picker(statement) if picker else latest_per_key(statement, SERIES)
    keys = ["symbol", "source", "filing_type"]
    one = latest_per_key(newest.withColumn("_o", F.col("consolidated").cast("int")), keys, "_o")
    return one.withColumn("fallback", ~F.col("consolidated")).withColumn("statement", F.lit(name)).drop("_o")


def financials_snapshot(income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    """Latest statements of an issuer side by side with a data-quality note."""
    keys = ["symbol", "source", "filing_type"]

    def part(df, name, picker=None):
        s = snapshot_fallback(df, name, picker)
        return s.select(*keys, F.col("period_end_date").alias(f"_{name}_period"), F.col("fallback").alias(f"_{name}_fb"),
                        *[F.col(c) for c in measures(df)])

    d = part(income, "IncomeStatement").join(part(balance, "BalanceSheet", populated_balance), keys, "full").join(
        part(cashflow, "CashFlow"), keys, "full"
    )
    names = ("IncomeStatement", "BalanceSheet", "CashFlow")
    periods = F.array_compact(F.array_distinct(F.array(*[F.col(f"_{n}_period") for n in names])))
    fallbacks = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_{n}_fb"), F.lit(n)) for n in names])))
    period = F.coalesce(*[F.col(f"_{n}_period") for n in ("IncomeStatement", "CashFlow", "BalanceSheet")])
    joined = F.array_join(fallbacks, ", ")
    warning = F.when(
        F.size(fallbacks) > 0,
        F.concat(F.lit("No consolidated data for "), joined, F.lit("; using standalone (the whole-company picture at that date)")),
    ).when(F.size(periods) > 1, F.lit("Merged data mixes different reporting periods"))
    return d.select(
        *keys, period.alias("period_end_date"), warning.alias("data_quality_warning"),
        F.when(F.size(fallbacks) > 0, joined).alias("standalone_fallback"),
        *[c for f in (income, balance, cashflow) for c in measures(f)],
    )


def statement_page(df: DataFrame, gte=None, lte=None, offset=0, limit=0) -> DataFrame:
    """One statement's rows per issuer: fallback basis, period range, newest first, paged, with the total."""
    d = filter_period_range(consolidated_fallback(df), gte, lte)
    win = Window.partitionBy("symbol", "source", "filing_type")
    d = d.withColumn("total", F.count(F.lit(1)).over(win))
    d = d.withColumn("position", F.row_number().over(win.orderBy(F.col("period_end_date").desc(), "source_endpoint")))
    d = d.filter(F.col("position") > offset)
    return d.filter(F.col("position") <= offset + limit) if limit else d


def derive_fields(df: DataFrame) -> DataFrame:
    """Exact functions of values on the row: share counts from EPS, total equity, minority interest."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    num = F.coalesce(have("profit_or_loss_attributable_to_owners_of_parent"), have(S.PAT))
    out = {}
    for shares, eps in (("weighted_average_shares_basic", S.EPS_BASIC), ("weighted_average_shares_diluted", S.EPS_DILUTED)):
        out[shares] = F.coalesce(have(shares), safe_div(num, nonzero(have(eps))))
    total, parent = have("total_equity_including_nci"), have("stockholders_equity")
    out["total_equity"] = F.coalesce(have("total_equity"), total)
    out["minority_interest"] = F.coalesce(total - parent, have("minority_interest"))
    return df.withColumns(out)


def derive_operating_income(df: DataFrame) -> DataFrame:
    """Exchange filings report total expenses, so revenue minus expenses is operating profit there."""
    fill = F.when(F.col("source") == "NSE", F.col(S.REVENUE) - F.col("expenses"))
    return df.withColumn("operating_income", F.coalesce("operating_income", fill))


def project_priority(df: DataFrame, statement: str, all_fields: bool = False) -> DataFrame:
    """Configured columns plus identity, as a JSON document with nulls left out."""
    keep = df.columns if all_fields else [c for c in df.columns if c in S.PRIORITY[statement] + S.IDENTITY_KEEP]
    return df.select(*KEY, F.to_json(F.struct(*keep), {"ignoreNullFields": "true"}).alias("document"))


def project_fields(df: DataFrame, wanted: list[str], meta: list[str]) -> DataFrame:
    """Requested columns plus meta; unknown names are ignored."""
    return df.select(*meta, *[c for c in wanted if c in df.columns and c not in meta])


# -- incremental load ---------------------------------------------------------------


def upsert_present(stored: DataFrame, incoming: DataFrame, keys: list[str], present: str = "present_cols") -> DataFrame:
    """Insert or update on the key; only columns named in ``present_cols`` overwrite.

    An absent column keeps the stored value, a present null overwrites it. Stored and
    incoming rows meet in one full outer join on the key; the result replaces the
    affected partitions of a plain Parquet table.
    """
    cols = [c for c in stored.columns if c not in keys]
    new = incoming.select(*keys, present, *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = stored.withColumn("_old", F.lit(True)).join(new, keys, "full")
    fresh = F.col("_old").isNull()
    touched = lambda c: F.coalesce(F.array_contains(present, c), F.lit(False))
    return j.select(
        *keys,
        *[F.when(touched(c), F.col(f"_n_{c}")).when(~fresh, F.col(c)).alias(c) for c in cols],
        F.when(fresh, "insert").when(F.col(present).isNotNull(), "update").otherwise("keep").alias("action"),
    )


def latest_load(df: DataFrame, keys: list[str], load_order: str) -> DataFrame:
    """The latest delivery of every key (grouped, so re-deliveries combine map-side)."""
    rest = [c for c in df.columns if c not in keys and c != load_order]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(load_order, F.xxhash64(*rest))).alias("_r")).select(*keys, "_r.*")


def upsert_latest(stored: DataFrame, incoming: DataFrame, keys: list[str], load_order: str) -> DataFrame:
    """Replace all value columns of a key by its latest load."""
    return latest_load(stored.unionByName(incoming), keys, load_order)


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a batch whose key is not stored yet; the first of a key within the batch wins."""
    rest = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    return first.join(stored.select(key), key, "left_anti")


def highwater_incremental(incoming: DataFrame, stored: DataFrame, keys=("symbol", "exchange"), force: bool = False) -> DataFrame:
    """Rows newer than the stored maximum of their key; ``force`` takes everything."""
    if force:
        return incoming
    hwm = stored.groupBy(*keys).agg(F.max("date").alias("_hwm"))
    d = incoming.join(hwm, list(keys), "left")
    return d.filter(F.col("_hwm").isNull() | (F.col("date") > F.col("_hwm"))).drop("_hwm")


def freshness_gate(keys: DataFrame, loads: list[DataFrame], as_of: Column, max_age_hours: int, on="symbol") -> DataFrame:
    """Keys whose newest load in every table is too old; one fresh table is enough to skip."""
    newest = reduce(lambda a, b: a.unionByName(b), [d.select(on, "pulled_at") for d in loads])
    newest = newest.groupBy(on).agg(F.max("pulled_at").alias("last_pull"))
    fresh = newest.filter(F.col("last_pull") > as_of - F.make_dt_interval(hours=F.lit(max_age_hours)))
    return keys.join(fresh.select(on), on, "left_anti")


def skip_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """New filings only: stored urls dropped, first url of a batch wins, revisions considered last."""
    rest = [c for c in incoming.columns if c != "url"]
    first = incoming.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct("is_revision", "ord")).alias("_r"))
    return first.select("url", "_r.*").join(stored.select("url").distinct(), "url", "left_anti")


def pull_status(outcomes: DataFrame, key="symbol") -> DataFrame:
    """Classify a load by its endpoint outcomes; 'no data' is not a failure."""
    failed, ok = F.count_if(F.col("outcome") == "error"), F.count_if(F.col("outcome") == "ok")
    g = outcomes.groupBy(key).agg(failed.alias("failed"), ok.alias("succeeded"), F.count(F.lit(1)).alias("endpoints"))
    status = (
        F.when((F.col("failed") > 0) & (F.col("succeeded") == 0), "failed")
        .when(F.col("failed") > 0, "partial")
        .when(F.col("succeeded") > 0, "completed")
        .otherwise("no data")
    )
    return g.withColumn("status", status)


def append_pull_history(meta: DataFrame, pulls: DataFrame, key="symbol") -> DataFrame:
    """After a successful pull the old ``last_pull`` joins ``previous_pulls`` and the new time is set."""
    j = meta.join(pulls.select(key, F.col("pulled_at").alias("_new")), key, "left")
    moved = F.when(
        F.col("_new").isNotNull() & F.col("last_pull").isNotNull(), F.array_append("previous_pulls", F.col("last_pull"))
    ).otherwise(F.col("previous_pulls"))
    return j.withColumn("previous_pulls", moved).withColumn("last_pull", F.coalesce("_new", "last_pull")).drop("_new")


