"""Recursive smoothing y[t] = (1-a) y[t-1] + a x[t] as plain window sums.

After a gap of k nulls the old value has aged to weight (1-a)^(k+1) and the average is
renormalised, so a row keeps the share c = (1-a)^(k+1) / ((1-a)^(k+1) + a) of it; without a
gap c is 1-a. Inside a block of B rows, with C[j] the product of the shares so far,
L[j] = C[j] * sum(u[i] / C[i]), i <= j, where u is the seed value on the first row and
(1-c) x after it. The ends of all blocks before carry over: they are folded in order, each
weighed by the products of the blocks behind it, so the result is exact for any alpha. All
windows share one partitioning and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def wilder_alpha(length: int) -> float:
    return 1.0 / length


def ewm(df: DataFrame, series: list[tuple[str, str, float]], keys=("symbol",), order="rn") -> DataFrame:
    """Add one smoothed column per (output, input, alpha).

    ``order`` is the dense 1-based row number of the series. Leading nulls of an input are
    skipped: the first value seeds the recursion. A row with a null keeps the value before it.
    """
    keys = list(keys)
    fastest = max((a for _, _, a in series if a < 1), default=0.0)
    block = BLOCK if fastest <= 0.9 else max(1, int(-250 / math.log10(1 - fastest)))  # the product stays a double
    df = df.withColumn("_b", F.floor((F.col(order) - 1) / block).cast("int"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b", order).rowsBetween(Window.unboundedPreceding, -1)

    def every(make) -> DataFrame:
        made = {}
        for i, (_, x, a) in enumerate(series):
            made.update(make(i, F.col(x), min(a, 1.0), max(1.0 - a, 0.0)))
        return df.withColumns(made)

    df = every(lambda i, x, a, d: {f"_g{i}": F.col(order) - F.last(F.when(x.isNotNull(), F.col(order)), ignorenulls=True).over(before)})

    def shares(i, x, a, d):
        gap, old = F.col(f"_g{i}"), F.pow(F.lit(d), F.col(f"_g{i}"))
        far = x.isNotNull() & (gap > 1)
        u = F.when(gap.isNull(), x).when(far, x * a / (old + a)).otherwise(x * a)
        return {f"_u{i}": F.coalesce(u, F.lit(0.0)), f"_n{i}": F.when(x.isNotNull() & (gap == 1), 1).otherwise(0),
                f"_e{i}": F.when(far, F.greatest(gap * math.log(d), F.lit(-60.0)) - F.log(old + a)).otherwise(0.0) if d else F.lit(0.0), f"_s{i}": x.isNotNull() | gap.isNotNull()}

    df = every(shares)
    # the product of the shares is kept as a power and, for rows behind gaps, a sum of logarithms
    df = every(lambda i, x, a, d: {f"_c{i}": F.pow(F.lit(d), F.sum(f"_n{i}").over(inside)) * F.exp(F.sum(f"_e{i}").over(inside))} if d else {})
    df = every(lambda i, x, a, d: {f"_l{i}": F.col(f"_c{i}") * F.sum(F.col(f"_u{i}") / F.col(f"_c{i}")).over(inside)} if d else {})
    is_tail = F.pmod(F.col(order), F.lit(block)) == 0
    df = every(lambda i, x, a, d: {f"_t{i}": F.collect_list(F.when(is_tail, F.struct(F.col(f"_l{i}").alias("l"), F.col(f"_c{i}").alias("c")))).over(before)} if d else {})

    def result(i, x, a, d):
        name = series[i][0]
        if not d:  # nothing is remembered
            return {name: F.coalesce(x, F.last(x, ignorenulls=True).over(before))}
        carried = F.aggregate(f"_t{i}", F.lit(0.0), lambda acc, t: acc * t["c"] + t["l"])
        return {name: F.when(F.col(f"_s{i}"), F.col(f"_l{i}") + F.col(f"_c{i}") * carried)}

    df = every(result)
    return df.drop("_b", *[f"_{k}{i}" for k in "gunescltp" for i in range(len(series))])


def ewm_fold_last(values: Column, alpha: float) -> Column:
    """Last smoothed value of an ordered array that may hold interior nulls.

    A gap of k nulls ages the old value to weight (1-a)^(k+1) and the average is
    renormalised, which is how the weighted mean treats missing observations.
    """
    d = 1.0 - alpha
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("wt"))

    def step(s, x):
        wt = s["wt"] * d
        y = F.when(s["y"].isNull(), x).otherwise((wt * s["y"] + alpha * x) / (wt + alpha))
        return F.when(x.isNull(), F.struct(s["y"].alias("y"), F.when(s["y"].isNull(), F.lit(1.0)).otherwise(wt).alias("wt"))).otherwise(
            F.struct(y.alias("y"), F.lit(1.0).alias("wt"))
        )

    return F.aggregate(values, start, step)["y"]
