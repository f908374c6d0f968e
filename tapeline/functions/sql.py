"""SQL forms of the scalar helpers; bodies are SQL, so calls are inlined into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "safe_div(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "try_divide(a, b)",
    "to_float(s STRING) RETURNS DOUBLE":
        r"CASE WHEN replace(s, ',', '') RLIKE '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$' THEN try_cast(trim(replace(s, ',', '')) AS DOUBLE) END",
    "pct(x DOUBLE) RETURNS DOUBLE": "round(x * 100, 4)",
    "growth_pct(cur DOUBLE, prev DOUBLE) RETURNS DOUBLE": "round(try_divide(cur - prev, prev) * 100, 4)",
}


def register_sql_functions(spark: SparkSession) -> None:
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def table_functions() -> dict[str, str]:
    """Functions that turn a row into rows, to be called laterally; each is one generator over its arguments."""
    from tapeline.operators.indicators import FIB_RATIOS
    from tapeline.operators.signals import signal_array, signal_inputs

    levels = ", ".join(
        f"struct('{label}' AS label, round(CASE WHEN direction = 'up' THEN swing_high - (swing_high - swing_low) * {r}D ELSE swing_low + (swing_high - swing_low) * {r}D END, 4) AS level)"
        for label, r in FIB_RATIOS.items())
    row = ", ".join(f"{c}: DOUBLE" for c in signal_inputs())
    return {
        "fib_levels_of(swing_high DOUBLE, swing_low DOUBLE, direction STRING) RETURNS TABLE (label STRING, level DOUBLE)":
            f"SELECT label, level FROM (SELECT inline(array({levels})))",
        f"signals_of(last STRUCT<{row}>) RETURNS TABLE (position INT, signal STRING, bias STRING, note STRING)":
            f"SELECT position, signal, bias, note FROM (SELECT inline({signal_array('last')}))",
    }


def register_table_functions(spark: SparkSession) -> None:
    for signature, body in table_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
