"""News, documents, captions, lists and screener tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.scalars import clean_edges, col, growth_abs, parse_value_number, strip_html

# Feed limits.
FEED_LIMIT, FEED_DAYS = 15, 7


def scan_news(items: DataFrame, as_of: Column, limit: int | None = FEED_LIMIT, days: int | None = FEED_DAYS) -> DataFrame:
    """First ``limit`` entries per feed, without linkless and outdated ones (undated ones stay); None is no limit."""
    win = Window.partitionBy("country", "source").orderBy("ord")
    d = items if limit is None else items.withColumn("_r", F.row_number().over(win)).filter(F.col("_r") <= limit)
    recent = F.lit(True) if days is None else F.col("published_at").isNull() | (F.col("published_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
    return d.filter(recent & F.col("link").isNotNull()).select(
        "country", "source", F.col("link").alias("url"), F.trim("title").alias("title"), strip_html("summary").alias("summary"), "published_at")


def filter_lookback(news: DataFrame, as_of: Column, days: int, country: str | None = None) -> DataFrame:
    d = news.filter(F.col("published_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
    return d if country is None else d.filter(F.col("country") == country)


def mention_pattern(symbol) -> Column:
    """Case-sensitive pattern of a symbol not touched by letters on either side."""
    return F.concat(F.lit("(?<![A-Za-z])\\Q"), col(symbol), F.lit("\\E(?![A-Za-z])"))


def filter_mentions(news: DataFrame, symbol: str) -> DataFrame:
    return news.filter(F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))).rlike("(?<![A-Za-z])\\Q" + symbol + "\\E(?![A-Za-z])"))


def symbol_mentions(news: DataFrame, symbols: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, symbol) for every symbol a story mentions, by token instead of comparing all pairs.

    A symbol's letter runs are bounded by non-letters wherever it matches, so the
    longest one is a whole letter run of the text: an equi-join on it finds every
    candidate. For an all-letter symbol the token is the match; other candidates go
    back to their story for the full pattern. A symbol without letters is looked up
    through the fixed-length pieces of the text's letter-free runs. Only keys and
    tokens are exploded and shuffled, never the texts.
    """
    s = symbols.select("symbol").distinct()
    runs = F.filter(F.split("symbol", "[^A-Za-z]+"), lambda x: x != "")
    longest = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))))["t"]
    s = s.withColumn("token", F.coalesce(longest, F.col("symbol"))).withColumn("_plain", longest.isNull())
    s = s.withColumn("_exact", F.col("token") == F.col("symbol"))
    stories = news.select(key, text.alias("_text"))
    pieces = lambda sep: F.array_distinct(F.filter(F.split("_text", sep), lambda x: x != ""))
    words = stories.select(key, F.explode(pieces("[^A-Za-z]+")).alias("token"))
    hits = words.join(s.filter(~F.col("_plain")), "token").select(key, "symbol", "_exact")
    # pieces of the lengths that letter-free symbols have, cut from the run's characters; a run of L characters gives L of each
    sizes = s.filter("_plain").agg(F.collect_set(F.length("symbol"))).scalar()
    gaps = stories.select(key, F.explode(pieces("[A-Za-z]+")).alias("_gap")).select(key, F.split("_gap", "").alias("_chars"), sizes.alias("_sizes"))
    at = lambda n: F.when(F.size("_chars") >= n, F.sequence(F.lit(1), F.size("_chars") - n + 1)).otherwise(F.array().cast("array<int>"))
    cut = F.flatten(F.transform("_sizes", lambda n: F.transform(at(n), lambda i: F.array_join(F.slice("_chars", i, n), ""))))
    codes = gaps.select(key, F.explode(F.array_distinct(cut)).alias("token")).join(s.filter("_plain"), "token")
    codes = codes.select(key, "symbol", F.lit(False).alias("_exact")).distinct()
    candidates = hits.unionByName(codes)
    exact = candidates.filter("_exact").select(key, "symbol")
    rest = candidates.filter("NOT _exact").join(stories, key)
    confirmed = rest.filter(F.expr("_text rlike concat('(?<![A-Za-z])\\\\Q', symbol, '\\\\E(?![A-Za-z])')")).select(key, "symbol")
    return exact.unionByName(confirmed)


def union_news_dedup(stock: DataFrame, market: DataFrame, stock_cap=50, market_cap=200, out_cap=50) -> DataFrame:
    """Stock stories before market stories, first url wins, newest first; the caps are the feature's limits (None: no limit)."""
    order = [F.col("published_at").desc_nulls_last(), F.col("doc_id")]
    upto = lambda d, n: d if n is None else d.orderBy(*order).limit(n)
    a = upto(stock, stock_cap).withColumn("_rank", F.lit(0))
    b = upto(market, market_cap).withColumn("_rank", F.lit(1))
    u = a.unionByName(b)
    rest = [c for c in u.columns if c not in ("url", "_rank")]
    first = u.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct("_rank", -F.unix_micros(F.col("published_at").cast("timestamp")), "doc_id")).alias("r"))
    out = first.select("url", "r.*").orderBy(*order)
    return out if out_cap is None else out.limit(out_cap)


# -- documents --------------------------------------------------------------------------

def page_texts(docs: DataFrame, key: str, text: str, max_chars: int | None = None) -> DataFrame:
    """(key, page, text) with 1-based pages; documents over the size guard are left out."""
    d = docs if max_chars is None else docs.filter(F.length(text) <= max_chars)
    return d.select(key, F.posexplode(F.split(text, "\n")).alias("p", "text")).select(key, (F.col("p") + 1).alias("page"), "text")


def page_numbers(spec, last) -> Column:
    """'3,5-9' to the sorted distinct page numbers from 1 to ``last``; a malformed part gives null for the whole spec.

    Ranges are cut to the pages that exist before they are expanded.
    """
    parts = F.filter(F.transform(F.split(col(spec), ","), lambda p: F.trim(p)), lambda p: p != "")
    ok = F.forall(parts, lambda p: p.rlike(r"^\d+(-\d+)?$"))

    def expand(p):
        number = lambda i: F.least(F.split_part(p, F.lit("-"), F.lit(i)).cast("decimal(38,0)"), F.lit(2**31 - 1)).cast("int")
        lo = F.greatest(number(1), F.lit(1))
        hi = F.least(F.when(p.contains("-"), number(2)).otherwise(number(1)), col(last).cast("int"))
        return F.when(lo <= hi, F.sequence(lo, F.greatest(hi, lo))).otherwise(F.array().cast("array<int>"))

    return F.when(ok, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand)))))


def select_pages(requests: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Requested pages of each document; a request without any existing page gives one error row."""
    n = pages.groupBy(key).agg(F.max("page").alias("num_pages"))
    r = requests.join(n, key).withColumn("wanted", page_numbers("spec", "num_pages"))
    r = r.withColumn("page", F.explode_outer(F.when(F.size("wanted") > 0, F.col("wanted"))))
    d = r.join(pages, [key, "page"], "left")
    err = F.when(F.col("wanted").isNull(), F.concat(F.lit("Bad page spec '"), F.col("spec"), F.lit("'; use e.g. 3,5-9"))).when(
        F.col("page").isNull(), F.concat(F.lit("No requested page is within 1-"), F.col("num_pages").cast("string")))
    return d.select(key, "spec", "num_pages", "page", "text", err.alias("error"))


def doc_cache(stored: DataFrame, incoming: DataFrame, key: str, text: str) -> DataFrame:
    """Re-ingest decision by content hash: cached, changed (replace) or new."""
    h = F.substring(F.sha2(F.col(text), 256), 1, 16)
    new = incoming.select(key, h.alias("new_hash"))
    d = new.join(stored.select(key, "doc_hash"), key, "left")
    action = F.when(F.col("doc_hash").isNull(), "new").when(F.col("doc_hash") == F.col("new_hash"), "cached").otherwise("replace")
    return d.select(key, F.col("new_hash").alias("doc_hash"), action.alias("action"))


# -- lists and captions -------------------------------------------------------------------

def parse_index_list(lines: DataFrame, c: str = "value", keys=()) -> DataFrame:
    """'SYMBOL [EXCHANGE] [COUNTRY]' lines: upper-cased, blanks and comments dropped, country default IN."""
    d = lines.withColumn("_p", F.split(F.trim(F.upper(F.col(c))), r"\s+")).filter((F.trim(c) != "") & ~F.trim(c).startswith("#"))
    at = lambda i: F.try_element_at("_p", F.lit(i))
    return d.select(*keys, at(1).alias("symbol"), F.coalesce(at(2), F.lit("NSE")).alias("exchange"), F.coalesce(at(3), F.lit("IN")).alias("country"))


CAPTION_SCHEMA = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"


def segment_text(event: Column) -> Column:
    """Non-empty segments of one caption event, trimmed and joined."""
    kept = F.filter(event["segs"], lambda s: s["utf8"].isNotNull() & (s["utf8"] != ""))
    return F.array_join(F.transform(kept, lambda s: F.trim(s["utf8"])), " ")


def caption_segments(events: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """Caption event JSON to rows: joined segment text, start and duration in seconds."""
    d = events.select(*keys, F.from_json(F.col(c), CAPTION_SCHEMA).alias("j")).select(*keys, F.posexplode("j.events").alias("position", "e"))
    ms = lambda f: F.coalesce(F.col(f"e.{f}"), F.lit(0)) / 1000.0
    return d.filter(F.size("e.segs") > 0).select(*keys, "position", segment_text(F.col("e")).alias("text"), ms("tStartMs").alias("start"), ms("dDurationMs").alias("duration"))


def caption_text(events: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """Whole transcript per document, joined inside its row: nothing is regrouped."""
    d = events.select(*keys, F.from_json(F.col(c), CAPTION_SCHEMA).alias("j"))
    spoken = F.filter("j.events", lambda e: F.size(e["segs"]) > 0)
    return d.select(*keys, F.array_join(F.transform(spoken, segment_text), " ").alias("full_text"))


# Caption languages in order of preference.
CAPTION_LANGS = ("a.en", "en", "en-orig", "en-US", "en-GB")


def caption_track_pick(tracks: DataFrame, key: str) -> DataFrame:
    """Best caption track per video: preferred language, then generated tracks, then list order."""
    rank = F.lit(99)
    for i, lang in enumerate(CAPTION_LANGS):
        rank = F.when(F.col("lang") == lang, i).otherwise(rank)
    auto = F.when(F.col("lang").contains("a.") | F.col("lang").isin(*CAPTION_LANGS), 0).otherwise(1)
    return tracks.groupBy(key).agg(F.min_by("lang", F.struct(rank, auto, "ord")).alias("lang"), F.min_by("ord", F.struct(rank, auto, "ord")).alias("track"))


def topk_posts(posts: DataFrame, per_group: int, limit: int) -> DataFrame:
    """Newest posts per group up to the group cap, then the best scores overall."""
    win = Window.partitionBy("group").orderBy(F.col("created").desc(), "post_id")
    d = posts.withColumn("_r", F.row_number().over(win)).filter(F.col("_r") <= per_group)
    return d.drop("_r").orderBy(F.coalesce("score", F.lit(0)).desc(), "post_id").limit(limit)


# -- screener tables ------------------------------------------------------------------------

DATE_KEY = r"^\d{4}-\d{2}-\d{2}"


def _dated(m) -> Column:
    return F.array_sort(F.filter(F.map_keys(col(m)), lambda k: k.rlike(DATE_KEY)))


def map_latest(m) -> Column:
    """Value at the largest date key; 'TTM' and other keys are ignored."""
    return F.try_element_at(col(m), F.try_element_at(_dated(m), F.lit(-1)))


def map_growth(df: DataFrame, m: str, qoq: str = "qoq", yoy: str = "yoy") -> DataFrame:
    """Latest date key against the one before (quarter) and against the same month a year before,
    over the base's magnitude."""
    at = lambda k: parse_value_number(F.try_element_at(F.col(m), F.col(k)))
    d = df.withColumn("_keys", _dated(m))
    d = d.withColumns({"_last": F.try_element_at("_keys", F.lit(-1)), "_prev": F.try_element_at("_keys", F.lit(-2))})
    month = F.concat((F.substring("_last", 1, 4).try_cast("int") - 1).cast("string"), F.substring("_last", 5, 3))
    d = d.withColumn("_month", month)
    d = d.withColumn("_year", F.try_element_at(F.filter("_keys", lambda k: F.substring(k, 1, 7) == F.col("_month")), F.lit(1)))
    d = d.withColumns({"_lv": at("_last"), "_pv": at("_prev"), "_yv": at("_year")})
    return d.withColumns({qoq: growth_abs("_lv", "_pv"), yoy: growth_abs("_lv", "_yv")}).drop(
        "_keys", "_last", "_prev", "_month", "_year", "_lv", "_pv", "_yv")


# Keywords that identify a scraped table.
TABLE_WORDS = {
    "months": ("dec", "mar", "jun", "sep"), "pnl": ("sales", "expenses", "profit", "eps"),
    "bs": ("assets", "equity", "borrowings", "liabilities"), "cf": ("activity", "cash", "cash flow", "operating"),
    "ratios": ("roce", "debtor days", "conversion cycle", "working capital days"), "holdings": ("promoters", "fiis", "diis", "public"),
}


def table_kind(cols, rows) -> Column:
    """Kind of a table from keyword counts in its header and row labels."""
    c, r = F.lower(clean_edges(cols)), F.lower(clean_edges(rows))
    count = lambda text, words: sum((text.contains(x).cast("int") for x in words[1:]), text.contains(words[0]).cast("int"))
    months = count(c, TABLE_WORDS["months"])
    n = {k: count(r, w) for k, w in TABLE_WORDS.items() if k != "months"}
    few = months <= 2
    return (
        F.when((months >= 3) & (n["pnl"] >= 3), "quarterly-results")
        .when(c.contains("compounded sales growth"), "sales-growth").when(c.contains("compounded profit growth"), "profit-growth")
        .when(c.contains("stock price cagr"), "price-cagr").when(c.contains("return on equity"), "return-on-equity")
        .when(few & (n["pnl"] >= 3), "annual-results").when(few & (n["bs"] >= 3), "balance-sheet").when(few & (n["cf"] >= 3), "cash-flow")
        .when(few & (n["ratios"] >= 3), "ratios").when(few & (n["holdings"] >= 3), "annual-shareholding")
        .when(~few & (n["holdings"] >= 3), "quarterly-shareholding")
    )


# Sections of a flattened company row and their prefixes.
SECTION_PREFIX = {
    "quarterly-results": "", "annual-results": "Annual ", "balance-sheet": "Balance Sheet ", "cash-flow": "Cash Flow ",
    "quarterly-shareholding": "Quarterly Shareholding ", "annual-shareholding": "Annual Shareholding ",
}


def flatten_company(cells: DataFrame, key: str) -> DataFrame:
    """(key, field, value): latest value per section and parameter, with the section prefix.

    ``cells`` has section, parameter, period label and cell text; only dated periods count.
    """
    prefix = F.lit(None).cast("string")
    for s, p in SECTION_PREFIX.items():
        prefix = F.when(F.col("section") == s, F.lit(p)).otherwise(prefix)
    d = cells.filter(F.col("period").rlike(DATE_KEY)).groupBy(key, "section", "parameter").agg(F.max_by("cell", "period").alias("cell"))
    return d.select(key, F.concat(prefix, "parameter").alias("field"), parse_value_number("cell").alias("value"))


# -- announcement feeds -----------------------------------------------------------------------

# Announcement feed fields and the columns they fill.
ANNOUNCEMENT_FIELDS = {
    "an_dt": "filed_at", "attchmntText": "title", "desc": "description",
    "attchmntFile": "url", "attFileSize": "file_size", "hasXbrl": "has_xbrl",
}


def scan_announcements(feed: DataFrame, c: str = "body", keys=("symbol",)) -> DataFrame:
    """JSON array of announcements to typed rows; the raw record is kept as text."""
    from tapeline.functions.scalars import parse_datetime

    fields = ", ".join(f"{f}: string" for f in ANNOUNCEMENT_FIELDS)
    d = feed.select(*keys, F.explode(F.from_json(F.col(c), f"array<struct<{fields}>>")).alias("r"))
    typed = {
        "filed_at": parse_datetime("r.an_dt"), "file_size": F.col("r.attFileSize").try_cast("bigint"),
        "has_xbrl": F.col("r.hasXbrl").try_cast("boolean"),
    }
    return d.select(*keys, *[typed.get(n, F.col(f"r.{f}")).alias(n) for f, n in ANNOUNCEMENT_FIELDS.items()],
                    F.to_json("r", {"ignoreNullFields": "true"}).alias("raw_data"))


def content_key(raw: str = "raw_data") -> Column:
    return F.md5(F.col(raw))


def dedup_filings(filings: DataFrame, order: str = "ord") -> DataFrame:
    """One row per (symbol, source, content hash), and per (source, url) among documents.

    The latest delivery of a key wins, like the upsert it stands for. ``order`` is
    unique: winners are chosen on hashes and order numbers alone, where copies
    combine before the shuffle, and the full rows are fetched once at the end.
    """
    d = filings.withColumn("content_hash", content_key())
    narrow = d.groupBy("symbol", "source", "content_hash").agg(
        F.max(order).alias(order), F.max_by("filing_type", order).alias("filing_type"), F.max_by("url", order).alias("url"))
    document = F.coalesce(F.col("filing_type") == "document", F.lit(False))
    docs = narrow.filter(document).groupBy("source", "url").agg(F.max(order).alias(order)).select(order)
    return d.join(narrow.filter(~document).select(order).unionByName(docs), order, "left_semi")
