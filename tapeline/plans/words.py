"""News, caption, screener and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import scalars as X
from tapeline.operators import text as TX
from tapeline.plans.checks import view
from tapeline.registry import query
from tapeline.sources import schema as S

AS_OF = "2024-01-02 00:00:00"


def _asof():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("filter_lookback", f"SELECT doc_id, country, url FROM v_news WHERE country='us' AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY")
def filter_lookback(v):
    return TX.filter_lookback(v.news, _asof(), 1, "us").select("doc_id", "country", "url")


_M = "(^|[^A-Za-z]){s}($|[^A-Za-z])"


@query("filter_mentions", f"SELECT doc_id, url FROM v_news WHERE regexp_matches(title||' '||summary, '{_M.format(s='The')}')")
def filter_mentions(v):
    return TX.filter_mentions(v.news, "The").select("doc_id", "url")


# symbols to look for: the distinct page-host words, capitalised and plain, and the part sizes as letterless codes
view("v_symbols", """SELECT DISTINCT symbol FROM (SELECT regexp_extract(url,'^https?://(?:[a-z]+\\.)*?([a-z]+)\\.example',1) AS symbol FROM pages UNION ALL SELECT upper(substring(w,1,1))||substring(w,2) FROM (SELECT regexp_extract(url,'^https?://(?:[a-z]+\\.)*?([a-z]+)\\.example',1) AS w FROM pages)
 UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part) WHERE symbol<>''""")


def watch_symbols(v):
    host = F.regexp_extract("url", r"^https?://(?:[a-z]+\.)*?([a-z]+)\.example", 1)
    w = v.table("pages").select(host.alias("symbol"))
    cap = w.select(F.concat(F.upper(F.substring("symbol", 1, 1)), F.substring("symbol", 2, 100)).alias("symbol"))
    return w.unionByName(cap).unionByName(v.table("part").select(F.col("p_size").cast("string").alias("symbol"))).filter("symbol <> ''").distinct()


@query("news_symbol_match", f"""SELECT doc_id, symbol FROM v_news, v_symbols WHERE contains(text, symbol) AND regexp_matches(text, '(^|[^A-Za-z])'||symbol||'($|[^A-Za-z])')""")
def news_symbol_match(v):
    return TX.symbol_mentions(v.news, watch_symbols(v), "doc_id", F.col("text"))


view("v_unews", """SELECT * FROM (SELECT *, 0 AS rk FROM (SELECT doc_id, country, source, url, title, published_at FROM v_news WHERE doc_id%10=0 ORDER BY published_at DESC NULLS LAST, doc_id LIMIT 50) UNION ALL
 SELECT *, 1 FROM (SELECT doc_id, country, source, url, title, published_at FROM v_news WHERE doc_id%10<>0 ORDER BY published_at DESC NULLS LAST, doc_id LIMIT 200)) QUALIFY row_number() OVER (PARTITION BY url ORDER BY rk, published_at DESC, doc_id)=1""")


@query("union_news_dedup", "SELECT doc_id, country, source, url, title, published_at FROM v_unews ORDER BY published_at DESC NULLS LAST, doc_id LIMIT 50")
def union_news_dedup(v):
    n = v.news.select("doc_id", "country", "source", "url", "title", "published_at")
    return TX.union_news_dedup(n.filter("doc_id % 10 = 0"), n.filter("doc_id % 10 <> 0"))


@query("order_nulls_last", "SELECT doc_id, p AS published_at FROM (SELECT doc_id, CASE WHEN doc_id%10<>0 THEN published_at END AS p FROM v_news)  ORDER BY p DESC NULLS LAST, doc_id")
def order_nulls_last(v):
    d = v.news.select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("published_at")).alias("published_at"))
    return d.orderBy(F.col("published_at").desc_nulls_last(), "doc_id")


@query("topk_posts", """SELECT grp AS "group", post_id, score FROM (SELECT event_type AS grp, event_id AS post_id, CASE WHEN event_id%9=0 THEN NULL ELSE value END AS score, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r<=25 ORDER BY coalesce(score,0) DESC, post_id LIMIT 40""")
def topk_posts(v):
    p = v.table("events").select(F.col("event_type").alias("group"), F.col("event_id").alias("post_id"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("score"), F.col("ts").alias("created"))
    return TX.topk_posts(p, 25, 40).select("group", "post_id", "score")


# -- paging -------------------------------------------------------------------------------

@query("order_limit_offset", "SELECT symbol, source, period_end_date, consolidated, revenue_from_operations FROM v_income WHERE filing_type='quarterly' ORDER BY period_end_date DESC, symbol, consolidated LIMIT 100 OFFSET 50")
def order_limit_offset(v):
    d = v.income.filter("filing_type = 'quarterly'").select("symbol", "source", "period_end_date", "consolidated", S.REVENUE)
    return d.orderBy(F.col("period_end_date").desc(), "symbol", "consolidated").offset(50).limit(100)


@query("cursor_page", """WITH c AS (SELECT 40 AS o, 20 AS l), p AS (SELECT symbol, period_end_date, consolidated, row_number() OVER (ORDER BY period_end_date DESC, symbol, consolidated) AS rn FROM v_income WHERE filing_type='quarterly')
 SELECT symbol, period_end_date, consolidated, true AS has_next, 'NjA' AS next_cursor FROM p, c WHERE rn>o AND rn<=o+l""")
def cursor_page(v):
    """Page behind an opaque cursor: limit+1 rows are fetched to know whether a next page exists."""
    import base64

    cursor, limit = "NDA", 20
    offset = int(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    d = v.income.filter("filing_type = 'quarterly'").select("symbol", "period_end_date", "consolidated")
    order = [F.col("period_end_date").desc(), "symbol", "consolidated"]
    page = d.orderBy(*order).offset(offset).limit(limit + 1)
    from tapeline.functions.rolling import Window

    page = page.withColumns({"_p": F.row_number().over(Window.orderBy(*order)), "has_next": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > limit})  # at most limit+1 rows
    nxt = F.when(F.col("has_next"), X.encode_cursor(F.lit(offset + limit)))
    return page.filter(F.col("_p") <= limit).withColumn("next_cursor", nxt).drop("_p")


@query("base64_cursor", """SELECT event_id, rtrim(translate(to_base64(CAST(CAST(event_id AS VARCHAR) AS BLOB)),'+/','-_'),'=') AS cursor_text, event_id AS decoded, 0 AS bad FROM events""")
def base64_cursor(v):
    d = v.table("events").select("event_id", X.encode_cursor("event_id").alias("cursor_text"))
    return d.select("event_id", "cursor_text", X.decode_cursor("cursor_text").alias("decoded"), X.decode_cursor(F.concat(F.lit("!"), "cursor_text")).cast("int").alias("bad"))


# -- captions -------------------------------------------------------------------------------

view("v_cap", "SELECT conv_id, turn, trim(text) AS text, turn*1500 AS s, length(text) AS d FROM conversations")


def caption_feed(v):
    """One caption document per conversation: an event per turn, one of them without segments."""
    c = v.table("conversations")
    ev = F.struct(F.col("turn"), F.struct((F.col("turn") * 1500).alias("tStartMs"), F.length("text").cast("bigint").alias("dDurationMs"),
                  F.when(F.col("turn") != 3, F.array(F.struct(F.concat(F.lit(" "), "text", F.lit(" ")).alias("utf8")), F.struct(F.lit("").alias("utf8")))).alias("segs")).alias("e"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(F.struct(ev["e"].alias("e"))).alias("j")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.regexp_extract(x["j"], r'(?s)^\{"e":(.*)\}$', 1)), ",")
    return g.select("conv_id", F.concat(F.lit('{"events":['), body, F.lit("]}")).alias("body"))


@query("json_segments_text", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS INT) AS position, trim(text) AS text, s/1000.0::DOUBLE AS start, d/1000.0::DOUBLE AS duration FROM v_cap QUALIFY turn<>3")
def json_segments_text(v):
    return TX.caption_segments(caption_feed(v), "body", ["conv_id"])


@query("caption_full_text", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS full_text FROM v_cap WHERE turn<>3 GROUP BY 1")
def caption_full_text(v):
    return TX.caption_text(caption_feed(v), "body", ["conv_id"])


@query("caption_track_pick", """SELECT video, lang, track FROM (SELECT source AS video, CASE doc_id%6 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'de' WHEN 2 THEN 'en' WHEN 3 THEN 'a.fr' WHEN 4 THEN 'a.en' ELSE 'es' END AS lang, doc_id AS track FROM documents WHERE (doc_id%6<>4 OR length(source)=5) AND (doc_id%6<>2 OR source<>'src3'))
 QUALIFY row_number() OVER (PARTITION BY video ORDER BY coalesce(list_position(['a.en','en','en-orig','en-US','en-GB'], lang)-1, 99), CASE WHEN lang LIKE '%a.%' OR lang IN ('a.en','en','en-orig','en-US','en-GB') THEN 0 ELSE 1 END, track)=1""")
def caption_track_pick(v):
    k = F.col("doc_id") % 6
    lang = F.when(k == 0, "en-GB").when(k == 1, "de").when(k == 2, "en").when(k == 3, "a.fr").when(k == 4, "a.en").otherwise("es")
    t = v.table("documents").filter(((k != 4) | (F.length("source") == 5)) & ((k != 2) | (F.col("source") != "src3"))).select(F.col("source").alias("video"), lang.alias("lang"), F.col("doc_id").alias("ord"))
    return TX.caption_track_pick(t, "video")


# -- screener tables ---------------------------------------------------------------------------

def company_cells(v):
    """Screener-style cells: section, parameter, period label and cell text per company."""
    q = v.income.filter(F.col("consolidated"))
    sec = F.when(F.col("filing_type") == "annual", "annual-results").otherwise("quarterly-results")
    txt = lambda c: F.when(F.col(c) < 0, F.col(c).cast("bigint").cast("string")).otherwise(F.concat(F.lit("1,"), F.col(c).cast("bigint").cast("string")))
    cells = F.array(F.struct(F.lit("Sales").alias("parameter"), txt(S.REVENUE).alias("cell")), F.struct(F.lit("Net Profit").alias("parameter"), txt(S.PAT).alias("cell")),
                    F.struct(F.lit("OPM").alias("parameter"), F.when(F.month("period_end_date") == 6, "-").otherwise(F.concat(F.quarter("period_end_date").cast("string"), F.lit(".5%"))).alias("cell")))
    d = q.select("symbol", sec.alias("section"), F.col("period_end_date").cast("string").alias("period"), F.inline(cells))
    ttm = q.filter("filing_type = 'annual'").select("symbol", F.lit("annual-results").alias("section"), F.lit("TTM").alias("period"), F.lit("Sales").alias("parameter"), F.lit("999").alias("cell")).distinct()
    return d.unionByName(ttm)


_CELL = "CASE WHEN {c}<0 THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE '1'||CAST(CAST({c} AS BIGINT) AS VARCHAR) END"
view("v_cells", f"""SELECT symbol, CASE WHEN filing_type='annual' THEN 'annual-results' ELSE 'quarterly-results' END AS section, period_end_date AS period, u.p AS parameter, CAST(u.v AS DOUBLE) AS v FROM (SELECT *, unnest([{{'p':'Sales','v':{_CELL.format(c='revenue_from_operations')}}},
 {{'p':'Net Profit','v':{_CELL.format(c='profit_loss_for_period')}}}, {{'p':'OPM','v':CASE WHEN month(period_end_date)<>6 THEN quarter(period_end_date)||'.5' END}}]) AS u FROM v_income WHERE consolidated)""")


@query("flatten_company_row", "SELECT symbol, CASE section WHEN 'annual-results' THEN 'Annual ' ELSE '' END||parameter AS field, arg_max_null(v, period) AS value FROM v_cells GROUP BY symbol, section, parameter")
def flatten_company_row(v):
    return TX.flatten_company(company_cells(v), "symbol")


def _cell_maps(v):
    d = company_cells(v).filter(F.col("section") == "quarterly-results")
    return d.groupBy("symbol", "parameter").agg(F.map_from_entries(F.collect_list(F.struct("period", "cell"))).alias("m"))


view("v_qcells", "SELECT symbol, parameter, period, v, row_number() OVER (PARTITION BY symbol, parameter ORDER BY period DESC) AS r FROM v_cells WHERE section='quarterly-results'")


@query("map_latest", "SELECT symbol, parameter, v AS latest FROM v_qcells WHERE r=1")
def map_latest(v):
    return _cell_maps(v).select("symbol", "parameter", X.parse_value_number(TX.map_latest("m")).alias("latest"))


@query("map_growth", """SELECT a.symbol, a.parameter, round((a.v-b.v)/nullif(abs(b.v),0)*100,2) AS qoq, round((a.v-c.v)/nullif(abs(c.v),0)*100,2) AS yoy FROM v_qcells a LEFT JOIN v_qcells b ON b.symbol=a.symbol AND b.parameter=a.parameter AND b.r=2
 LEFT JOIN v_qcells c ON c.symbol=a.symbol AND c.parameter=a.parameter AND year(c.period)=year(a.period)-1 AND month(c.period)=month(a.period) WHERE a.r=1""")
def map_growth(v):
    return TX.map_growth(_cell_maps(v), "m").drop("m")


@query("table_kind_classify", """SELECT symbol, kind_id, CASE kind_id WHEN 0 THEN 'quarterly-results' WHEN 1 THEN 'annual-results' WHEN 2 THEN 'balance-sheet' WHEN 3 THEN 'cash-flow' WHEN 4 THEN 'sales-growth' WHEN 5 THEN 'quarterly-shareholding' END AS kind
 FROM (SELECT DISTINCT symbol, CAST(CAST(substring(symbol,2) AS BIGINT)%7 AS INT) AS kind_id FROM v_income)""")
def table_kind_classify(v):
    """Header and row texts of one table per company, rendered from its statements."""
    q = v.income.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("period_end_date", "MMM yyyy"))), " ").alias("hdr"))
    k = (F.substring("symbol", 2, 20).cast("bigint") % 7).cast("int")
    cols = F.when(k.isin(0, 5), F.col("hdr")).when(k == 4, "--Compounded Sales Growth--").otherwise("Mar 2020 Mar 2021")
    rows = (F.when(k.isin(0, 1), "Sales + Expenses Net Profit EPS in Rs").when(k == 2, "Equity Capital Borrowings Other Liabilities Total Assets")
            .when(k == 3, "Cash from Operating Activity Net Cash Flow").when(k == 5, "Promoters FIIs DIIs Public").otherwise("Misc"))
    return q.select("symbol", k.alias("kind_id"), TX.table_kind(cols, rows).alias("kind"))


@query("json_nested_get", "SELECT event_id, TRY_CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, json_extract_string(props,'$.missing.deep') AS missing FROM events")
def json_nested_get(v):
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.missing.deep").alias("missing"))


@query("json_flatten_prefix", """SELECT event_id, 'EMA '||name AS field, CAST(value AS DOUBLE) AS value FROM (SELECT event_id, 'p'||k AS name, k*1.5::DOUBLE AS value FROM (SELECT event_id, TRY_CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events))
 UNION ALL SELECT event_id, 'EMA p'||k||' Change %', k/4.0::DOUBLE FROM (SELECT event_id, TRY_CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)""")
def json_flatten_prefix(v):
    """Parameter lists to prefixed (field, value) rows: the list key names the prefix."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"ema_parameters":[{"name":"p'), k, F.lit('","value":"'), (k.cast("bigint") * 1.5).cast("string"), F.lit('","changePercent":"'), (k.cast("bigint") / 4.0).cast("string"), F.lit('%"}]}'))
    d = v.table("events").select("event_id", F.from_json(body, "map<string,array<struct<name:string,value:string,changePercent:string>>>").alias("m"))
    d = d.select("event_id", F.explode("m").alias("key", "items")).select("event_id", "key", F.explode("items").alias("i"))
    prefix = F.upper(F.regexp_replace("key", "_parameters|_analysis|_insight", ""))
    name = F.concat_ws(" ", prefix, F.col("i.name"))
    rows = F.array(F.struct(name.alias("field"), X.parse_value_number("i.value").alias("value")), F.struct(F.concat(name, F.lit(" Change %")).alias("field"), X.parse_value_number("i.changePercent").alias("value")))
    return d.select("event_id", F.inline(rows))


# -- scalar functions over whole tables ------------------------------------------------------------

_CUST = """CASE c_custkey%8 WHEN 0 THEN 'nan' WHEN 1 THEN '1,234.5' WHEN 2 THEN '' WHEN 3 THEN '-' WHEN 4 THEN 'abc' WHEN 5 THEN 'inf' ELSE CAST(c_acctbal AS VARCHAR) END"""


def messy(v):
    """Customer balances as the texts a feed delivers."""
    k, bal = F.col("c_custkey") % 8, F.col("c_acctbal").cast("string")
    t = F.when(k == 0, "nan").when(k == 1, "1,234.5").when(k == 2, "").when(k == 3, "-").when(k == 4, "abc").when(k == 5, "inf").otherwise(bal)
    return v.table("customer").select("c_custkey", "c_acctbal", t.alias("t"))


@query("to_float", "SELECT c_custkey, CASE c_custkey%8 WHEN 1 THEN 1234.5::DOUBLE WHEN 6 THEN c_acctbal WHEN 7 THEN c_acctbal END AS value FROM customer")
def to_float(v):
    return messy(v).select("c_custkey", X.to_float("t").alias("value"))


@query("parse_value", "SELECT c_custkey, CASE c_custkey%8 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 1 THEN '1234.5' ELSE t END AS cell FROM (SELECT c_custkey, " + _CUST + " AS t FROM customer WHERE c_custkey%8 NOT IN (6,7)) UNION ALL SELECT c_custkey, CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) FROM customer WHERE c_custkey%8 IN (6,7)")
def parse_value(v):
    d = messy(v).withColumn("t", F.when(F.col("c_custkey") % 8 >= 6, F.concat(F.round("c_acctbal").cast("bigint").cast("string"), F.lit("%"))).otherwise(F.col("t")))
    return d.select("c_custkey", X.parse_value("t").alias("cell"))


@query("safe_div", "SELECT c_custkey, CASE WHEN c_custkey%5=0 THEN NULL WHEN c_custkey%7=0 THEN NULL ELSE round(c_acctbal/(c_custkey%7),6) END AS quotient FROM customer")
def safe_div(v):
    d = v.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("a"), (F.col("c_custkey") % 7).alias("b"))
    return d.select("c_custkey", F.round(X.safe_div("a", "b"), 6).alias("quotient"))


@query("pct", "SELECT c_custkey, round(c_acctbal/7*100,4) AS pct FROM customer")
def pct(v):
    return v.table("customer").select("c_custkey", X.pct(X.safe_div("c_acctbal", F.lit(7))).alias("pct"))


@query("growth_rate", "SELECT c_custkey, round((c_acctbal-p)/nullif(p,0)*100,4) AS growth, round((c_acctbal-p)/nullif(abs(p),0)*100,2) AS growth_abs FROM (SELECT c_custkey, c_acctbal, (c_custkey%11-5)*97 AS p FROM customer)")
def growth_rate(v):
    d = v.table("customer").select("c_custkey", "c_acctbal", ((F.col("c_custkey") % 11 - 5) * 97).alias("p"))
    return d.select("c_custkey", X.growth("c_acctbal", "p").alias("growth"), X.growth_abs("c_acctbal", "p").alias("growth_abs"))


@query("clean_edges", "SELECT page_id, trim(regexp_replace(url,'^[^A-Za-z0-9]+|[^A-Za-z0-9]+$','','g')) AS cleaned FROM (SELECT page_id, '* '||url||' /)' AS url FROM pages)")
def clean_edges(v):
    return v.table("pages").select("page_id", X.clean_edges(F.concat(F.lit("* "), "url", F.lit(" /)"))).alias("cleaned"))


@query("strip_html_summary", "SELECT page_id, substring(trim(regexp_replace(html,'<[^>]+>',' ','g')),1,1500) AS summary FROM pages")
def strip_html_summary(v):
    return v.table("pages").select("page_id", X.strip_html("html").alias("summary"))


@query("url_stem", "SELECT DISTINCT r_name, n_name, CASE WHEN n_nationkey=7 THEN 'niftyfinance' ELSE regexp_replace(lower(r_name||' & '||n_name),'[^a-z0-9]','','g') END AS stem FROM region JOIN nation ON n_regionkey=r_regionkey")
def url_stem(v):
    d = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.when(F.col("n_nationkey") == 7, "Nifty Fin Service").otherwise(F.concat_ws(" & ", "r_name", "n_name"))
    return d.select("r_name", "n_name", X.url_stem(label).alias("stem")).distinct()


@query("escape_symbol", "SELECT s_suppkey, replace(s_name||'&'||s_suppkey,'&','%26') AS escaped FROM supplier")
def escape_symbol(v):
    return v.table("supplier").select("s_suppkey", X.escape_symbol(F.concat_ws("&", "s_name", F.col("s_suppkey").cast("string"))).alias("escaped"))


@query("parse_datetime_multi", "SELECT o_orderkey, CASE WHEN o_orderkey%5=4 THEN NULL ELSE o_orderdate END AS at, CASE WHEN o_orderkey%2=0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def parse_datetime_multi(v):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(d, "dd-MMM-yyyy HH:mm:ss")).when(k == 4, "soon").otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
    s = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "d MMM yyyy")).otherwise(F.date_format(d, "dd-MMM-yyyy"))
    return v.table("orders").select("o_orderkey", X.parse_datetime(t).alias("at"), X.parse_date(s).alias("day"))


@query("parse_period_label", """SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN 'TTM' WHEN 1 THEN strftime(last_day(o_orderdate),'%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate,'%Y-%m-%d') WHEN 3 THEN '2001'||strftime(o_orderdate,'-%m-%d') ELSE 'n/a' END AS label
 FROM orders WHERE NOT (o_orderkey%5=3 AND strftime(o_orderdate,'%m-%d')='02-29') UNION ALL SELECT o_orderkey, strftime(o_orderdate,'%-d %b') FROM orders WHERE o_orderkey%5=3 AND strftime(o_orderdate,'%m-%d')='02-29'""")
def parse_period_label(v):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    t = F.when(k == 0, " ttm ").when(k == 1, F.date_format(d, "MMM yyyy")).when(k == 2, F.date_format(d, "d MMM yyyy")).when(k == 3, F.date_format(d, "d MMM")).otherwise("n/a")
    return v.table("orders").select("o_orderkey", X.parse_period_label(t, 2001).alias("label"))


@query("iso_date_string", "SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS day, strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S') AS stamp FROM orders")
def iso_date_string(v):
    return v.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))


@query("month_end_day", "SELECT o_orderkey, CASE month(o_orderdate) WHEN 3 THEN 31 WHEN 6 THEN 30 WHEN 9 THEN 30 WHEN 12 THEN 31 WHEN 2 THEN 28 ELSE 30 END AS fye_day, CAST(month(o_orderdate - INTERVAL 3 MONTH) AS INT) AS quarter_month, CAST(date_trunc('month', o_orderdate) - INTERVAL 3 MONTH AS DATE) AS quarter_start FROM orders")
def month_end_day(v):
    d = F.col("o_orderdate").cast("date")
    back = F.add_months(F.trunc(d, "MM"), -3)
    return v.table("orders").select("o_orderkey", X.fye_day(F.month(d)).alias("fye_day"), F.month(back).alias("quarter_month"), back.alias("quarter_start"))


@query("url_extension", "SELECT page_id, lower(regexp_extract(regexp_extract(url,'^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)',1),'\\.([A-Za-z0-9]+)$',1)) AS ext FROM pages")
def url_extension(v):
    return v.table("pages").select("page_id", X.url_extension("url").alias("ext"))


@query("log_return", "SELECT symbol, date, round(ln(close/lag(close) OVER w),8) AS log_ret, CAST(sign(close-lag(close) OVER w) AS DOUBLE) AS sgn, abs(open-close) AS body, round(sqrt(close),8) AS root, greatest(least(close,100.0::DOUBLE),90.0::DOUBLE) AS clipped FROM v_bars WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def log_return(v):
    from tapeline.functions import rolling as R

    prev = F.lag("close").over(R.w())
    return v.bars.select("symbol", "date", F.round(F.ln(X.safe_div("close", prev)), 8).alias("log_ret"), F.signum(F.col("close") - prev).alias("sgn"), F.abs(F.col("open") - F.col("close")).alias("body"),
                         F.round(F.sqrt("close"), 8).alias("root"), F.greatest(F.least("close", F.lit(100.0)), F.lit(90.0)).alias("clipped"))


@query("round_py", "SELECT c_custkey, CAST(format('{:.2f}', c_acctbal/8+0.005) AS DOUBLE) AS r2, CAST(format('{:.4f}', c_acctbal/16) AS DOUBLE) AS r4 FROM (SELECT c_custkey, c_acctbal FROM customer)")
def round_py(v):
    c = F.col("c_acctbal")
    return v.table("customer").select("c_custkey", X.round_half_even_exact(c / 8 + 0.005, 2).alias("r2"), X.round_half_even_exact(c / 16, 4).alias("r4"))


@query("typical_price", "SELECT symbol, date, round((high+low+close)/3,6) AS tp FROM v_bars")
def typical_price(v):
    return v.bars.select("symbol", "date", F.round(X.typical_price(), 6).alias("tp"))


@query("array_ops", "SELECT o_custkey, len(list_distinct(list(CAST(substring(o_orderpriority,1,1) AS INT)))) AS distinct_n, coalesce(list_position(list_sort(list_distinct(list(CAST(substring(o_orderpriority,1,1) AS INT)))),3),0) AS pos3, list_sort(list_distinct(list(CAST(substring(o_orderpriority,1,1) AS INT))))[1:2] AS first_two FROM orders GROUP BY 1")
def array_ops(v):
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    g = v.table("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(p)).alias("s"))
    both = F.array_sort(F.array_union("s", F.array().cast("array<int>")))
    return g.select("o_custkey", F.size(both).cast("bigint").alias("distinct_n"), F.array_position(both, 3).alias("pos3"), F.slice(both, 1, 2).alias("first_two"))


@query("row_sanitize", "SELECT c_custkey, CASE WHEN c_custkey%4 IN (0,1,2) THEN NULL ELSE c_acctbal END AS value FROM customer")
def row_sanitize(v):
    k = F.col("c_custkey") % 4
    bad = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("c_acctbal"))
    return X.sanitize(v.table("customer").select("c_custkey", bad.alias("value")))


@query("sql_functions", "SELECT c_custkey, round(c_acctbal/nullif(c_custkey%7,0),6) AS ratio, round((c_acctbal-500)/500*100,4) AS growth FROM customer")
def sql_functions(v):
    """The scalar helpers as SQL functions, inlined by the optimizer."""
    from tapeline.functions.sql import register_sql_functions

    register_sql_functions(v.spark)
    v.table("customer").createOrReplaceTempView("tapeline_customer")
    return v.spark.sql("SELECT c_custkey, round(safe_div(c_acctbal, c_custkey % 7), 6) AS ratio, growth_pct(c_acctbal, 500) AS growth FROM tapeline_customer")
