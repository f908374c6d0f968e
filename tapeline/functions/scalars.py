"""Scalar building blocks: null-safe arithmetic, parsing and text helpers.

All are plain ``Column`` builders, so they stay inside whole-stage codegen.
"null" never means zero here: a missing input gives a missing output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeric literals accepted by the number parser.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and infinities become null."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def round_scaled(c, digits: int) -> Column:
    """Round the scaled value, halves away from zero: what a query engine does to a double.

    ``F.round`` rounds the shortest decimal text, so it takes another side where the product is a half and the text isn't.
    """
    return F.round(col(c) * float(10**digits)) / float(10**digits)


def number_text(c) -> Column:
    """Text of a double without an exponent from 0.0001 up to 10**16 (a cast changes to one below 0.001 and from 10**7)."""
    c = col(c)
    size = F.abs(c)
    plain = F.regexp_replace(F.when(size < 1e16, c).try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    odd = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(odd, plain).otherwise(c.cast("string"))


def to_float(c) -> Column:
    """Text to double: thousands commas dropped; garbage, NaN and infinities give null."""
    s = F.replace(col(c).cast("string"), F.lit(","), F.lit(""))
    return F.when(s.rlike(NUMBER_PATTERN), finite(F.trim(s).try_cast("double")))


def safe_div(a, b) -> Column:
    """a / b, null when either is null, b is zero or the quotient is not finite."""
    return finite(F.try_divide(col(a).cast("double"), col(b).cast("double")))


def pct(c, digits: int = 4) -> Column:
    return F.round(col(c) * 100, digits)


def growth(cur, prev, digits: int = 4) -> Column:
    """Percent change; null without both values or with a zero base."""
    cur, prev = col(cur), col(prev)
    return pct(safe_div(cur - prev, prev), digits)


def growth_abs(cur, prev, digits: int = 2) -> Column:
    """Percent change over the magnitude of the base (screener convention)."""
    cur, prev = col(cur), col(prev)
    return F.round(safe_div(cur - prev, F.abs(prev)) * 100, digits)


def nz(c) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def nonzero(c) -> Column:
    """Zero counts as missing."""
    c = col(c)
    return F.when(c != 0, c)


def round_metric(c) -> Column:
    """Two decimals, four when the magnitude is below one; non-finite gives null."""
    return round_metrics([c])[0]


def round_metrics(cols: list) -> Column:
    """``round_metric`` over many columns at once, as one array in the given order.

    A lambda over the packed values keeps the generated code small: the rounding
    expression appears once instead of once per column.
    """
    def one(x):
        scale = F.when(F.abs(x) < 1, F.lit(10000.0)).otherwise(F.lit(100.0))
        exact = F.when(F.abs(x) >= 2.0**45, x).otherwise(_round_scaled(x, scale))
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), exact)

    return F.transform(F.array(*[col(c).cast("double") for c in cols]), one)


def round_half_even_exact(c, digits: int) -> Column:
    """Round on the exact binary value, ties to even (2.675 -> 2.67)."""
    return _round_scaled(col(c), F.lit(float(10**digits)))


def _round_scaled(c: Column, scale: Column) -> Column:
    """Exact rounding to 1/scale.

    ``F.round`` works on the shortest decimal text of the double. Here the scaled
    product is split into high part and exact error (Dekker's product; the scale
    has few enough bits to need no split), which decides the ties the text hides.
    """
    x = F.abs(c)
    big = x * 134217729.0  # 2**27 + 1
    high = big - (big - x)
    p = x * scale
    err = (high * scale - p) + (x - high) * scale
    base = F.floor(p).cast("double")
    rest = ((p - base) - 0.5) + err
    up = (rest > 0) | ((rest == 0) & (F.pmod(base, F.lit(2.0)) == 1))
    k = F.try_divide(F.when(up, base + 1).otherwise(base), scale)
    return F.when(c < 0, 0.0 - k).otherwise(k) + 0.0


def parse_value(c) -> Column:
    """Cell text without commas and percent signs; empty and '-' give null."""
    s = F.trim(F.regexp_replace(col(c), "[,%]", ""))
    return F.when((s != "") & (s != "-"), s)


def parse_value_number(c) -> Column:
    """Numeric reading of a cell, null when it stays text."""
    return to_float(parse_value(c))


# Word boundaries inside a tag name.
WORD_STARTS = ("(.)([A-Z][a-z]+)", "([a-z0-9])([A-Z])")


def camel_to_snake(c) -> Column:
    out = col(c)
    for boundary in WORD_STARTS:
        out = F.regexp_replace(out, boundary, "$1_$2")
    return F.lower(out)


def clean_edges(c) -> Column:
    return F.trim(F.regexp_replace(col(c), "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))


def strip_html(c, limit: int = 1500) -> Column:
    """Tags to blanks, trimmed, first ``limit`` characters (the summary length is the feature)."""
    return F.substring(F.trim(F.regexp_replace(col(c), "<[^>]+>", " ")), 1, limit)


# Index names whose list file does not follow the plain rule.
STEM_ALIASES = {"NIFTY FIN SERVICE": "niftyfinance", "NIFTY FINANCIAL SERVICES": "niftyfinance"}


def url_stem(c) -> Column:
    key = F.upper(col(c))
    out = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")
    for name, stem in STEM_ALIASES.items():
        out = F.when(key == name, F.lit(stem)).otherwise(out)
    return out


def escape_symbol(c) -> Column:
    return F.replace(col(c), F.lit("&"), F.lit("%26"))


# Exchange to quote-feed suffix; others use ".<exchange>".
EXCHANGE_SUFFIX = {"NSE": ".NS", "BSE": ".BO", "NASDAQ": "", "NYSE": ""}


def exchange_suffix(symbol, exchange) -> Column:
    ex = F.upper(col(exchange))
    suffix = F.concat(F.lit("."), ex)
    for name, value in EXCHANGE_SUFFIX.items():
        suffix = F.when(ex == name, F.lit(value)).otherwise(suffix)
    return F.concat(col(symbol), suffix)


# Accepted date-time and date layouts, tried in order.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
DATE_FORMATS = ("d MMM yyyy", "d-MMM-yyyy")


def parse_datetime(c) -> Column:
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in TIMESTAMP_FORMATS]).cast("timestamp_ntz")


def try_date(c, fmt: str) -> Column:
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("date")


def parse_date(c) -> Column:
    return F.coalesce(*[try_date(F.trim(col(c)), f) for f in DATE_FORMATS])


def parse_period_label(c, current_year) -> Column:
    """'TTM' kept; 'D Mon [YYYY]' to that day; 'Mon YYYY' to its month end; else unchanged."""
    d = F.trim(col(c))
    year = col(current_year) if not isinstance(current_year, int) else F.lit(current_year)
    full = F.when(d.rlike(r"^\d+\s+\S+\s+\S+$"), try_date(F.regexp_replace(d, r"\s+", " "), "d MMM yyyy"))
    short = F.when(
        d.rlike(r"^\d+\s+\S+$"),
        try_date(F.concat_ws(" ", F.regexp_replace(d, r"\s+", " "), year.cast("string")), "d MMM yyyy"),
    )
    month = F.regexp_extract(d, r"([A-Z][a-z]{2} \d{4})(?!\d)", 1)
    end = F.last_day(try_date(F.concat(F.lit("1 "), month), "d MMM yyyy"))
    iso = F.date_format(F.coalesce(short, full, end), "yyyy-MM-dd")
    return F.when(F.upper(d) == "TTM", F.lit("TTM")).otherwise(F.coalesce(iso, col(c)))


# Last day used for an inferred fiscal-year-end month.
FYE_DAYS = {3: 31, 6: 30, 9: 30, 12: 31, 2: 28}


def fye_day(month) -> Column:
    out = F.lit(30)
    for m, d in FYE_DAYS.items():
        out = F.when(col(month) == m, F.lit(d)).otherwise(out)
    return out


def calendar_fiscal_quarter(d) -> Column:
    """Jan-Mar is Q4 of the fiscal year that started in April."""
    return F.concat(F.lit("Q"), (F.pmod(F.quarter(col(d)) + 2, F.lit(4)) + 1).cast("string"))


def fiscal_quarter(d, fye_month) -> Column:
    """Quarter relative to the fiscal-year-end month; calendar map when it is unknown."""
    fye = col(fye_month)
    off = F.pmod(F.month(col(d)) - fye, F.lit(12))
    known = F.when(off == 0, "Q4").when(off == 3, "Q1").when(off == 6, "Q2").when(off == 9, "Q3")
    return F.when(fye.isNull(), calendar_fiscal_quarter(d)).otherwise(known)


def duration_class(start, end) -> Column:
    """'quarter' for 61..130 days, 'annual' from 300 days, else null."""
    days = F.datediff(col(end), col(start))
    return F.when((days > 60) & (days <= 130), "quarter").when(days >= 300, "annual")


def rate_text(c) -> Column:
    return to_float(F.regexp_replace(col(c), "%+$", ""))


def extract_rate(text, label: str) -> Column:
    """First percent number after a label, case-insensitive."""
    return F.nullif(F.regexp_extract(col(text), f"(?is){label}.*?(\\d+\\.?\\d*%)", 1), F.lit(""))


def encode_cursor(offset) -> Column:
    b64 = F.base64(col(offset).cast("string").cast("binary"))
    return F.rtrim(F.translate(b64, "+/", "-_"), F.lit("="))


def decode_cursor(cursor) -> Column:
    """Offset inside an opaque cursor; anything unreadable is offset 0."""
    std = F.translate(col(cursor), "-_", "+/")
    padded = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.coalesce(F.when(text.rlike(r"^\d{1,18}$"), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def url_extension(url) -> Column:
    """Lower-cased file extension of a URL path, empty when there is none."""
    path = F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def typical_price(high="high", low="low", close="close") -> Column:
    return (col(high) + col(low) + col(close)) / 3.0


def crore(c) -> Column:
    return F.round(col(c) / 1e7, 2)


def sanitize(df):
    """NaN and infinities to null in every float column of a frame."""
    kinds = {"double", "float"}
    return df.select(*[finite(c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])
