"""Ledgers, coverage profiles, request metrics and data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.scalars import round_half_even_exact, safe_div


def data_catalog(meta: DataFrame, prices, income, balance, cashflow, filings) -> DataFrame:
    """Record counts per (symbol, exchange, country) and the newest update of each kind.

    Each table is counted on its own (map-side combine), the counts are stacked and
    grouped once: no join of the raw tables.
    """
    counted = []
    parts = {"prices": (prices, "date"), "income_statements": (income, "pulled_at"), "balance_sheets": (balance, None),
             "cash_flows": (cashflow, None), "filings": (filings, None)}
    for name, (df, stamp) in parts.items():
        newest = F.max(stamp) if stamp else F.lit(None)
        d = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), newest.cast("timestamp_ntz").alias("u"))
        counted.append(d.withColumn("kind", F.lit(name)))
    u = reduce(lambda a, b: a.unionByName(b), counted)
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    g = u.groupBy("symbol").agg(*[pick(k, "n").alias(k) for k in parts], pick("prices", "u").cast("date").alias("prices_last_updated"),
                                pick("income_statements", "u").alias("income_last_updated"))
    d = meta.select("symbol", "exchange", "country").join(g, "symbol", "left")
    zero = {k: F.coalesce(F.col(k), F.lit(0)) for k in parts}
    total = reduce(lambda a, b: a + b, zero.values())
    return d.select("symbol", "exchange", "country", *[e.alias(k) for k, e in zero.items()], total.alias("total_records"),
                    "prices_last_updated", "income_last_updated")


def field_coverage(df: DataFrame, fields: list[str], table: str) -> DataFrame:
    """(table, field, total, filled, coverage percent) for many fields in one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in fields])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in fields])
    d = counts.select(F.lit(table).alias("table_name"), "total", F.inline(rows))
    return d.withColumn("coverage_pct", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("filled") / F.col("total") * 100, 1)))


def period_coverage(df: DataFrame, table: str) -> DataFrame:
    return df.agg(F.min("period_end_date").alias("first_period"), F.max("period_end_date").alias("last_period"),
                  F.count_distinct("period_end_date").alias("periods")).select(F.lit(table).alias("table_name"), "*")


def top_counts(df: DataFrame, key: str, k: int = 15) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.col("row_count").desc(), key).limit(k)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and the grand total."""
    each = reduce(lambda a, b: a.unionByName(b), [d.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, d in tables.items()])
    total = each.agg(F.sum("row_count").alias("row_count")).select(F.lit("total").alias("table_name"), "row_count")
    return each.unionByName(total)


def route_error_rate(req: DataFrame) -> DataFrame:
    """Requests, errors and error share per (method, route); the overall share is errors over requests."""
    m, r = F.coalesce("method", F.lit("")), F.coalesce("route", F.lit("unmatched"))
    g = req.groupBy(m.alias("method"), r.alias("route")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"))
    all_ = g.agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors")).select(F.lit("*").alias("method"), F.lit("*").alias("route"), "requests", "errors")
    return g.unionByName(all_).withColumn("error_pct", F.round(safe_div("errors", "requests") * 100, 4))


# Latency bucket bounds in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def latency_buckets(req: DataFrame, latency_ms: str = "latency_ms") -> DataFrame:
    """Cumulative histogram rows (method, route, le, cum) with the unbounded bucket last (le null)."""
    sec = F.col(latency_ms) / 1000.0
    aggs = [F.count_if(sec <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)]
    g = req.groupBy("method", "route").agg(*aggs, F.count(F.lit(1)).alias("binf"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(LATENCY_BOUNDS)],
                   F.struct(F.lit(None).cast("double").alias("le"), F.col("binf").alias("cum")))
    return g.select("method", "route", F.inline(rows))


def histogram_quantile(buckets: DataFrame, quantiles=(("p50_ms", 0.5), ("p95_ms", 0.95))) -> DataFrame:
    """Interpolated quantiles of cumulative buckets; a crossing in the unbounded bucket gives null."""
    keys = ["method", "route"]
    win = Window.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    whole = Window.partitionBy(*keys)
    d = buckets.withColumns({"_ple": F.coalesce(F.lag("le").over(win), F.lit(0.0)), "_pc": F.coalesce(F.lag("cum").over(win), F.lit(0)), "_total": F.max("cum").over(whole)})
    aggs = []
    for name, p in quantiles:
        target = F.col("_total") * p
        width = F.col("cum") - F.col("_pc")
        at = F.when(width <= 0, F.col("le")).otherwise(F.col("_ple") + (F.col("le") - F.col("_ple")) * F.try_divide(target - F.col("_pc"), width))
        hit = F.col("cum") >= target
        aggs.append((F.min_by(at, F.when(hit, F.struct(F.col("le").isNull().alias("u"), F.col("le").alias("le")))) * 1000).alias(f"_{name}"))
    g = d.filter("_total > 0").groupBy(*keys).agg(F.max("_total").alias("requests"), *aggs)
    return g.select(*keys, "requests", *[round_half_even_exact(f"_{name}", 1).alias(name) for name, _ in quantiles])


def batch_summary(rows: DataFrame, key: str) -> DataFrame:
    """ok / skipped / failed rows of a batch and the summed integers per counter name."""
    g = rows.groupBy(key).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "skipped", "failed")])
    sums = rows.select(key, F.explode("counters").alias("counter", "v")).groupBy(key, "counter").agg(F.sum("v").alias("total"))
    return g.join(sums, key, "left")


# -- checks over results ------------------------------------------------------------------

# Identities of the metric row, (name, left, right, relative tolerance).
IDENTITIES = (
    ("pe_eps_price", "price_to_earnings_ratio * earnings_per_share", "current_price", 0.01),
    ("pb_bvps_price", "price_to_book_ratio * book_value_per_share", "current_price", 0.01),
    ("ev_parts", "enterprise_value", "market_capitalization + total_debt - coalesce(cash_and_equivalents, 0)", 0.005),
    ("debt_to_equity", "debt_to_equity", "total_debt / total_equity", 0.01),
    ("inventory_days", "days_inventory_outstanding", "365 / inventory_turnover", 0.01),
    ("receivable_days", "days_receivable_outstanding", "365 / receivables_turnover", 0.01),
    ("payable_days", "days_payable_outstanding", "365 / payables_turnover", 0.01),
)


def identity_checks(metrics: DataFrame) -> DataFrame:
    """Per identity: rows checked, violated, and not checkable because an input is null."""
    aggs = []
    for name, left, right, tol in IDENTITIES:
        a, b = F.expr(left), F.expr(_null_safe(right))
        # values are reported with two (small ones four) decimals, hence the absolute allowance
        bad = F.abs(a - b) > F.greatest(F.abs(b) * tol, F.lit(0.02))
        aggs.append(F.struct(F.lit(name).alias("identity"), F.count(bad).alias("checked"), F.count_if(bad).alias("violated"), F.count_if(bad.isNull()).alias("unverifiable")).alias(name))
    one = metrics.agg(*aggs)
    return one.select(F.inline(F.array(*[n for n, *_ in IDENTITIES])))


def _null_safe(expr: str) -> str:
    if " / " in expr:
        a, b = expr.split(" / ")
        return f"try_divide({a}, {b})"
    return expr


def count_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, checked, violated) for boolean expressions that must hold."""
    one = df.agg(*[F.struct(F.lit(n).alias("check_name"), F.count(c).alias("checked"), F.count_if(~c).alias("violated")).alias(n) for n, c in checks.items()])
    return one.select(F.inline(F.array(*list(checks))))


def null_rates(df: DataFrame, fields: list[str], by: str) -> DataFrame:
    """Null share per field and market."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in fields])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), (F.col("total") - F.col(c)).alias("nulls")) for c in fields])
    return g.select(by, "total", F.inline(rows)).withColumn("null_pct", F.round(F.col("nulls") / F.col("total") * 100, 2))


# Tolerance bands, (class, pass, near, relative).
BANDS = {"multiple": (0.02, 0.05, True), "percent": (0.5, 1.5, False), "growth": (1.5, 4.0, False), "days": (3.0, 8.0, False), "per_share": (0.01, 0.03, True), "currency": (0.02, 0.05, True)}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """pass / near / fail per metric with MAPE, signed bias, worst symbol, field score and grade.

    ``pairs`` has symbol, metric, class, value and reference; rows without a reference stay out.
    """
    v, r = F.col("value"), F.col("reference")
    rel = safe_div(v - r, F.abs(r))
    passed, near = F.lit(False), F.lit(False)
    for cls, (p, n, relative) in BANDS.items():
        dist = F.abs(rel) if relative else F.abs(v - r)
        hit = F.col("class") == cls
        passed = F.when(hit, dist <= p).otherwise(passed)
        near = F.when(hit, (dist > p) & (dist <= n)).otherwise(near)
    verdict = F.when(passed, "pass").when(near, "near").otherwise("fail")
    d = pairs.filter(v.isNotNull() & r.isNotNull()).withColumns({"verdict": verdict, "_rel": rel})
    g = d.groupBy("metric").agg(*[F.count_if(F.col("verdict") == x).alias(x) for x in ("pass", "near", "fail")],
                                F.round(F.avg(F.abs("_rel")) * 100, 4).alias("mape_pct"), F.round(F.avg("_rel") * 100, 4).alias("bias_pct"),
                                F.max_by("symbol", F.struct(F.abs("_rel"), "symbol")).alias("worst_symbol"))
    score = F.round((F.col("pass") + 0.5 * F.col("near")) / (F.col("pass") + F.col("near") + F.col("fail")) * 100, 2)
    grade = F.lit("F")
    for bound, letter in reversed(GRADES):
        grade = F.when(F.col("score") >= bound, letter).otherwise(grade)
    return g.withColumn("score", score).withColumn("grade", grade)


def majority_value(sources: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Value at least two sources agree on within the tolerance; others dissent, none means contested.

    Sources per key are a handful by construction, so each key's short list is compared in place.
    """
    g = sources.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source", "value"))).alias("s"))
    near = lambda a, b: F.abs(a["value"] - b["value"]) <= F.abs(a["value"]) * tolerance
    votes = F.transform("s", lambda a: F.struct(F.size(F.filter("s", lambda b: near(a, b))).alias("n"), a.alias("a")))
    g = g.withColumn("_v", votes)
    best = F.array_max(F.transform("_v", lambda x: x["n"]))
    g = g.withColumn("_w", F.when(best >= 2, F.element_at(F.filter("_v", lambda x: x["n"] == best), 1)["a"]))
    dissent = F.filter("s", lambda b: ~(F.abs(F.col("_w")["value"] - b["value"]) <= F.abs(F.col("_w")["value"]) * tolerance))
    return g.select(*keys, F.col("_w.value").alias("value"), F.when(F.col("_w").isNull(), "contested").otherwise("agreed").alias("status"),
                    F.when(F.col("_w").isNotNull(), F.array_join(F.transform(dissent, lambda b: b["source"]), ", ")).alias("dissent"))
