"""Window helpers shared by the bar operators.

A bar table holds at most one row per (symbol, date) - the loaders keep that key
unique - so a per-symbol window is bounded by the trading calendar (about 250
rows a year) no matter how many raw rows one symbol owns. Raw rows are always
reduced to that key by a partial aggregate before any window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.scalars import col

KEYS = ["symbol"]


def w(keys=KEYS, order="date"):
    return Window.partitionBy(*keys).orderBy(order)


def back(n: int, keys=KEYS, order="date"):
    """The current row and the n-1 rows before it."""
    return w(keys, order).rowsBetween(-(n - 1), 0)


def running(keys=KEYS, order="date"):
    return w(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def whole(keys=KEYS, order="date"):
    return w(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def full(agg: Column, c, n: int, keys=KEYS, order="date") -> Column:
    """Window aggregate reported only when all n rows carry a value."""
    win = back(n, keys, order)
    return F.when(F.count(col(c)).over(win) == n, agg.over(win))


def mean_n(c, n, keys=KEYS, order="date") -> Column:
    return full(F.avg(col(c)), c, n, keys, order)


def exact_mean_n(c, n, keys=KEYS, order="date") -> Column:
    """``mean_n`` of values of at most six decimals: their sum is one of integers, so no addition shifts a tie.

    A window with another value has the plain mean.
    """
    win, units = back(n, keys, order), F.round(col(c) * 1e6)
    whole_units = (F.abs(units) < 9e15) & (units / 1e6 == col(c))
    total = F.sum(F.when(whole_units, units.cast("bigint"))).over(win).cast("double") / (n * 1e6)
    mean = F.when(F.min(whole_units).over(win), total).otherwise(F.avg(col(c)).over(win))
    return F.when(F.count(col(c)).over(win) == n, mean)


def max_n(c, n, keys=KEYS, order="date") -> Column:
    return full(F.max(col(c)), c, n, keys, order)


def min_n(c, n, keys=KEYS, order="date") -> Column:
    return full(F.min(col(c)), c, n, keys, order)


def number_rows(df: DataFrame, keys=KEYS, order="date") -> DataFrame:
    """rn = 1.. from the oldest row, rd = 1.. from the newest, n = rows of the series."""
    win = w(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = df.withColumn("rn", F.row_number().over(win)).withColumn("n", n)
    return out.withColumn("rd", (F.col("n") - F.col("rn") + 1).cast("int"))


def at_most(column, n: int | None) -> Column:
    """Condition of a feature's limit; None is no limit."""
    return F.lit(True) if n is None else F.col(column) <= n


def tail(df: DataFrame, n: int | None, keys=KEYS, order="date") -> DataFrame:
    """Last n rows of every series, all if n is None (the rank limit is applied before the shuffle)."""
    if n is None:
        return df
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rd", F.row_number().over(newest)).filter(F.col("_rd") <= n).drop("_rd")
