"""Indices, breadth, movers, flows, turnover, rates, option chains, insiders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.scalars import crore, parse_date, rate_text, safe_div
from tapeline.operators.bars import downsample_stride, filter_range

# Numeric fields of an index snapshot and their names in the feed.
SNAPSHOT_FIELDS = {
    "last": "last", "change_pct": "percentChange", "open": "open", "high": "high", "low": "low",
    "previous_close": "previousClose", "year_high": "yearHigh", "year_low": "yearLow", "pe": "pe", "pb": "pb", "dy": "dy",
    "advances": "advances", "declines": "declines", "per_change_30d": "perChange30d", "per_change_365d": "perChange365d",
}


def index_snapshot(raw: DataFrame, c: str = "body") -> DataFrame:
    """Typed index rows from JSON text; anything that is no number reads null."""
    schema = "indexSymbol string, `index` string, " + ", ".join(f"{f} string" for f in SNAPSHOT_FIELDS.values())
    d = raw.select(F.from_json(F.col(c), schema).alias("r"))
    number = lambda f: F.col(f"r.{f}").try_cast("double")
    return d.select(F.col("r.indexSymbol").alias("symbol"), F.col("r.index").alias("name"), *[number(f).alias(n) for n, f in SNAPSHOT_FIELDS.items()])


def index_quote(snapshot: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per asked index; an unknown one is answered with a suggestion instead of data."""
    key = F.upper(F.trim(F.col("asked")))
    j = wanted.withColumn("_k", key).join(snapshot.withColumn("_k", F.upper("symbol")), "_k", "left")
    some = snapshot.agg(F.min("symbol")).scalar()
    return j.select("asked", "symbol", "last", "change_pct", F.when(
        F.col("symbol").isNull(), F.concat(F.lit("index '"), F.col("_k"), F.lit("' not found; closest match: "), some)).alias("error"))


def market_breadth(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Advances and declines per index."""
    return members.join(changes, "symbol").groupBy("index_name").agg(
        F.count_if(F.col("change_pct") > 0).alias("advances"), F.count_if(F.col("change_pct") < 0).alias("declines"))


def top_movers(changes: DataFrame, k: int = 5, limit: int | None = None) -> DataFrame:
    """Top and bottom k by percent change, then the caller's limit."""
    d = changes.filter(F.col("change_pct").isNotNull())
    out = None
    for side, order in (("gainer", F.col("change_pct").desc()), ("loser", F.col("change_pct").asc())):
        top = d.orderBy(order, "symbol").limit(min(k, limit or k)).withColumn("side", F.lit(side))
        out = top if out is None else out.unionByName(top)
    return out


def flows_by_category(flows: DataFrame) -> DataFrame:
    """Buy, sell and net per normalised category and day."""
    cat = F.upper("category")
    return flows.select(
        F.when(cat.contains("FII"), "FII").otherwise(cat).alias("category"), F.date_format(parse_date("date"), "yyyy-MM-dd").alias("date"),
        *[F.col(a).try_cast("double").alias(b) for a, b in (("buyValue", "equity_buy_crore"), ("sellValue", "equity_sell_crore"), ("netValue", "equity_net_crore"))])


def turnover_by_segment(seg: DataFrame, today: str) -> DataFrame:
    """Today's numbers of a segment, else yesterday's, in crore."""
    pick = lambda f: F.when(F.col("today").isNotNull(), F.col(f"today.{f}")).otherwise(F.col(f"yesterday.{f}"))
    day = F.lit(today).cast("date")
    return seg.select("segment", F.when(F.col("today").isNotNull(), day).otherwise(F.date_sub(day, 1)).alias("date"),
                      pick("volume").alias("volume"), crore(pick("value")).alias("value_crore"), pick("open_interest").alias("open_interest"))


# Policy rate names and their columns.
RATE_KEYS = {
    "Policy Repo Rate": "policy_repo_rate_pct", "Savings Deposit Rate": "savings_deposit_rate_pct",
    "Marginal Standing Facility Rate": "msf_rate_pct", "Bank Rate": "bank_rate_pct", "Fixed Reverse Repo Rate": "fixed_reverse_repo_rate_pct",
    "CRR": "crr_pct", "SLR": "slr_pct", "INR / 1 USD": "inr_per_usd", "INR / 1 GBP": "inr_per_gbp", "INR / 1 EUR": "inr_per_eur", "INR / 100 JPY": "inr_per_100_jpy",
}


def rates_row(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Named percent texts to one numeric row per key."""
    return rates.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, rate_text("value"))).alias(c) for n, c in RATE_KEYS.items()])


def series_payload(df: DataFrame, start=None, end=None, target: int = 500, keys=("symbol",)) -> DataFrame:
    """Range, thinned to the point budget, with the full count and a thinned flag."""
    d = downsample_stride(filter_range(df, start, end), target, keys)
    shown = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return d.withColumn("bars_available", F.col("n")).withColumn("downsampled", shown < F.col("n")).drop("rn", "rd", "n")


def market_valuation(rows: DataFrame) -> DataFrame:
    """P/E per symbol under any of its header spellings, with the newest trade date."""
    pe = F.coalesce(*[F.col(f"`{c}`").try_cast("double") for c in ("p/e", "P/E", "PE") if c in rows.columns])
    last = rows.agg(F.max(F.trim("DATE"))).scalar()
    return rows.select(F.trim("SYMBOL").alias("symbol"), pe.alias("pe"), last.alias("trade_date"))


# -- option chains -----------------------------------------------------------------

def valid_options(chain: DataFrame) -> DataFrame:
    return chain.filter((F.col("strike") != 0) & F.col("expiry").isNotNull() & (F.col("option_type") != "XX"))


def option_pair(chain: DataFrame) -> DataFrame:
    """CE and PE records of a (strike, expiry) side by side; the last delivered record of a side wins."""
    side = lambda t, c: F.max_by(c, F.when(F.col("option_type") == t, F.struct("ord", "oi", "doi")))
    return valid_options(chain).groupBy("underlying", "strike", "expiry").agg(
        side("CE", "oi").alias("ce_oi"), side("CE", "doi").alias("ce_doi"), side("PE", "oi").alias("pe_oi"), side("PE", "doi").alias("pe_doi"),
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def option_chain_stats(pairs: DataFrame, spot: DataFrame | None = None) -> DataFrame:
    """Open interest totals, change percent, put/call ratio and the strike with the largest open interest.

    That strike is reported under the name ``maxpain`` by convention of the feed; it
    is the largest combined open interest, the first one on ties.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    oi = z("ce_oi") + z("pe_oi")
    g = pairs.groupBy("underlying").agg(
        F.sum(z("ce_oi")).alias("ce"), F.sum(z("pe_oi")).alias("pe"), F.sum(z("ce_doi") + z("pe_doi")).alias("chg"),
        F.max_by("strike", F.struct(oi, -F.col("first_ord"))).alias("maxpain"), F.min_by("expiry", "first_ord").alias("expiry_date"))
    total = F.col("ce") + F.col("pe")
    return g.select("underlying", "expiry_date", total.alias("total_oi_lots"), F.round(safe_div(F.col("chg"), total - F.col("chg")) * 100, 2).alias("change_oi_pct"),
                    F.round(safe_div("pe", "ce"), 4).alias("put_call_ratio"), "maxpain")


# -- insiders ------------------------------------------------------------------------

def insider_holdings(tx: DataFrame) -> DataFrame:
    """Latest post-transaction holding per insider, summed per company.

    Two grouped passes with map-side combine; a company's transactions never meet in one task.
    """
    d = tx.filter(F.col("remaining_shares").isNotNull())
    latest = d.groupBy("company", "insider").agg(
        F.max_by("remaining_shares", F.struct("date", "ord")).alias("held"), F.max("date").alias("date"))
    return latest.groupBy("company").agg(F.sum("held").alias("insider_shares"), F.max("date").alias("as_of"))


MAX_INSIDER_PCT = 100.0


def insider_pct(holdings: DataFrame, shares: DataFrame) -> DataFrame:
    d = holdings.join(shares, "company", "left")
    share = F.least(safe_div("insider_shares", "shares_outstanding") * 100, F.lit(MAX_INSIDER_PCT))
    return d.withColumn("insider_ownership_pct", F.round(share, 2))


