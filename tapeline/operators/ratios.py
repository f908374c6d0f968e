"""Static ratios of one record, a registry users can extend, and price multiples."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.scalars import nonzero, nz, pct, safe_div
from tapeline.sources import schema as S

class Ratio(NamedTuple):
    """``build`` gets the columns of the ratios it uses, in the order of ``uses``, and returns a Column over them and the statement columns."""

    category: str
    build: Callable[..., Column]
    uses: tuple[str, ...] = ()


_REGISTRY: dict[str, Ratio] = {}


def register_ratio(name: str, category: str, build: Callable[..., Column], uses: Iterable[str] = ()) -> None:
    """Add a ratio, or replace one. Ratios it uses have to be there, and none of them may rest on it."""
    uses = tuple(uses)
    unknown = [u for u in uses if u not in _REGISTRY and u != name]
    if unknown:
        raise KeyError(f"{name} uses unknown ratios: {', '.join(unknown)}")
    before = _REGISTRY.get(name)
    _REGISTRY[name] = Ratio(category, build, uses)
    try:
        evaluation_order([name])
    except ValueError:
        if before is None:
            del _REGISTRY[name]
        else:
            _REGISTRY[name] = before
        raise


def unregister_ratio(name: str, cascade: bool = False) -> list[str]:
    """Remove a ratio; those that use it go too with ``cascade``, else they are an error. Returns what went."""
    if name not in _REGISTRY:
        raise KeyError(name)
    gone = [name]
    for n in gone:  # grows while it is read
        gone += [m for m, r in _REGISTRY.items() if n in r.uses and m not in gone]
    if len(gone) > 1 and not cascade:
        raise ValueError(f"{name} is used by {', '.join(gone[1:])}")
    for n in gone:
        del _REGISTRY[n]
    return gone


def evaluation_order(names: Iterable[str]) -> list[list[str]]:
    """The named ratios and all they rest on, in layers: a ratio uses ratios of earlier layers only."""
    level: dict[str, int] = {}

    def place(n: str, path: tuple[str, ...]) -> int:
        if n in path:
            raise ValueError(f"ratios use each other: {' -> '.join((*path[path.index(n):], n))}")
        if n not in level:
            level[n] = 1 + max((place(u, (*path, n)) for u in _REGISTRY[n].uses), default=-1)
        return level[n]

    for n in names:
        place(n, ())
    return [[n for n in level if level[n] == k] for k in range(1 + max(level.values(), default=-1))]


def registered() -> dict[str, Ratio]:
    return dict(_REGISTRY)


def _equity() -> Column:
    return nz("equity_share_capital") + nz("other_equity")


def _ebit() -> Column:
    known = F.col(S.PBT).isNotNull() | F.col(S.FINANCE).isNotNull()
    return F.when(known, nz(S.PBT) + nz(S.FINANCE))


for _name, _cat, _build in (
    ("net_profit_margin", "Profitability", lambda: pct(safe_div(S.PAT, S.REVENUE))),
    ("operating_margin", "Profitability", lambda: pct(safe_div(_ebit(), S.REVENUE))),
    ("pre_tax_margin", "Profitability", lambda: pct(safe_div(S.PBT, S.REVENUE))),
    ("interest_cost_ratio", "Profitability", lambda: pct(safe_div(S.FINANCE, S.REVENUE))),
    ("roa", "Return Ratios", lambda: pct(safe_div(S.PAT, "assets"))),
    ("roe", "Return Ratios", lambda: pct(safe_div(S.PAT, _equity()))),
    ("roce", "Return Ratios", lambda: pct(safe_div(_ebit(), nz("assets") - nz("noncurrent_liabilities")))),
    ("debt_to_equity", "Capital Structure", lambda: F.coalesce(
        nonzero("debt_equity_ratio"), safe_div(nz("borrowings_current") + nz("borrowings_noncurrent"), _equity()))),
    ("equity_ratio", "Capital Structure", lambda: pct(safe_div(_equity(), "assets"))),
    ("financial_leverage", "Capital Structure", lambda: safe_div("assets", _equity())),
    ("cash_ratio", "Liquidity", lambda: safe_div(S.CASH, "borrowings_current")),
    ("operating_cash_flow_ratio", "Liquidity", lambda: safe_div(S.OCF, "borrowings_current")),
    ("operating_cash_flow_margin", "Cash Flow", lambda: pct(safe_div(S.OCF, S.REVENUE))),
    ("ocf_to_net_income", "Cash Flow", lambda: safe_div(S.OCF, S.PAT)),
    ("dilution_impact", "Earnings Quality", lambda: pct(safe_div(nz(S.EPS_BASIC) - nz(S.EPS_DILUTED), S.EPS_BASIC))),
):
    register_ratio(_name, _cat, _build)


def static_ratios(recs: DataFrame, names=None, prefix: str = "static_") -> DataFrame:
    """Ratio columns; the prefix keeps them apart from trailing metrics of the same name.

    A ratio that only others use is computed on the way and leaves no column.
    """
    names = list(names or _REGISTRY)
    d = recs
    held = lambda n: prefix + n if n in names else f"_ratio_{n}"
    layers = evaluation_order(names)
    for layer in layers:
        d = d.withColumns({held(n): _REGISTRY[n].build(*[F.col(held(u)) for u in _REGISTRY[n].uses]) for n in layer})
    return d.drop(*[held(n) for layer in layers for n in layer if n not in names])


def ratio_categories_long(recs: DataFrame, keys: list[str]) -> DataFrame:
    """(key, category, ratio, value) for every registered ratio, nulls included."""
    d = static_ratios(recs, prefix="_long_")
    rows = F.array(*[
        F.struct(F.lit(r.category).alias("category"), F.lit(n).alias("ratio"), F.col(f"_long_{n}").cast("double").alias("value"))
        for n, r in _REGISTRY.items()
    ])
    return d.select(*keys, F.inline(rows))


def shares_from_capital() -> Column:
    return F.try_divide(F.col(S.PAID_UP), F.col(S.FACE))


def valuation(d: DataFrame) -> DataFrame:
    """P/E, P/B, P/S, P/CF and PEG of a record with ``current_price`` and optional trailing inputs.

    All null without a non-zero price; negative multiples of book, sales and cash
    flow are kept (only zero is rejected).
    """
    opt = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("double")
    price = nonzero("current_price")
    eps = F.coalesce(opt("ttm_eps"), opt("single_eps"), F.col(S.EPS_BASIC))
    shares = nonzero(F.coalesce(nonzero(opt("shares_outstanding")), shares_from_capital()))
    reserves = F.col("reserve_excluding_revaluation_reserves")
    equity = F.when(reserves.isNotNull() & F.col(S.PAID_UP).isNotNull(), F.col(S.PAID_UP) + reserves).otherwise(
        nz("equity_share_capital") + nz("other_equity")
    )
    revenue = F.coalesce(opt("ttm_revenue"), F.col(S.REVENUE))
    mult = lambda per_share: F.round(safe_div(price, nonzero(per_share)), 4)
    d = d.withColumns({
        "pe_ratio": mult(eps),
        "pb_ratio": mult(safe_div(equity, shares)),
        "ps_ratio": mult(safe_div(revenue, shares)),
        "pcf_ratio": mult(safe_div(S.OCF, shares)),
    })
    g = opt("eps_growth")
    return d.withColumn("peg_ratio", F.when((g > 0) & shares.isNotNull(), F.round(safe_div(nonzero("pe_ratio"), g), 4)))
