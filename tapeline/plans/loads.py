"""Incremental-load queries: upserts, dedup, gates, ledgers, sinks, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import scalars as X
from tapeline.operators import statements as ST
from tapeline.operators import text as TX
from tapeline.plans.checks import view
from tapeline.registry import query
from tapeline.session import new_run_dir
from tapeline.sources import schema as S
from tapeline.sources.snapshots import SnapshotTable, newest

KEY = ", ".join(S.STATEMENT_KEY)

# -- feeds -----------------------------------------------------------------------------


def announcement_feed(v):
    """One JSON array of announcement records per company and month."""
    o = v.table("orders")
    k = F.col("o_orderkey")
    ts = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy HH:mm:ss"))
    rec = F.struct(ts.alias("an_dt"), F.col("o_orderpriority").alias("attchmntText"), F.when(k % 5 != 0, F.concat(F.lit("order "), k)).alias("desc"),
                   F.concat(F.lit("https://example.com/f/"), k, F.lit(".PDF")).alias("attchmntFile"), F.when(k % 4 == 0, F.lit("n/a")).otherwise((k * 10).cast("string")).alias("attFileSize"),
                   F.when(k % 3 == 0, "true").otherwise("false").alias("hasXbrl"))
    return o.groupBy(F.concat(F.lit("C"), F.col("o_custkey")).alias("symbol"), F.trunc("o_orderdate", "MM").alias("month")).agg(F.to_json(F.collect_list(rec)).alias("body"))


@query("scan_filings_json", """SELECT 'C'||o_custkey AS symbol, o_orderdate AS filed_at, o_orderpriority AS title, CASE WHEN o_orderkey%5<>0 THEN 'order '||o_orderkey END AS description, 'https://example.com/f/'||o_orderkey||'.PDF' AS url,
 CASE WHEN o_orderkey%4<>0 THEN o_orderkey*10 END AS file_size, o_orderkey%3=0 AS has_xbrl FROM orders""")
def scan_filings_json(v):
    return TX.scan_announcements(announcement_feed(v)).drop("raw_data")


@query("scan_news", """SELECT country, source, url, trim(title) AS title, substring(trim(regexp_replace(summary,'<[^>]+>',' ','g')),1,1500) AS summary, published_at FROM (SELECT *, row_number() OVER (PARTITION BY country, source ORDER BY doc_id) AS r FROM v_news)
 WHERE r<=15 AND doc_id%6<>0 AND (doc_id%10=0 OR published_at >= TIMESTAMP '2024-01-01 02:00:00')""")
def scan_news(v):
    items = v.news.select(
        "country", "source", F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 6 != 0, F.col("url")).alias("link"), "title", "summary",
        F.when(F.col("doc_id") % 10 != 0, F.col("published_at")).alias("published_at"))
    d = TX.scan_news(items, F.lit("2024-01-08 02:00:00").cast("timestamp_ntz"))
    full = v.news.groupBy("country", "source", "url").agg(F.min("published_at").alias("at"))
    return d.join(full, ["country", "source", "url"], "left").withColumn("published_at", F.coalesce("published_at", "at")).drop("at")


@query("scan_pages_summary", "SELECT page_id, substring(trim(regexp_replace(html,'<[^>]+>',' ','g')),1,1500) AS summary FROM pages")
def scan_pages_summary(v):
    return v.table("pages").select("page_id", X.strip_html("html").alias("summary"))


# -- upserts ---------------------------------------------------------------------------------

_NEW = "SELECT symbol, source, consolidated, filing_type, period_end_date, revenue_from_operations+1 AS revenue_from_operations, CASE WHEN month(period_end_date)=3 THEN NULL ELSE expenses END AS expenses, finance_costs, CASE WHEN month(period_end_date)=3 THEN ['revenue_from_operations','expenses'] ELSE ['revenue_from_operations'] END AS present_cols FROM v_income WHERE period_end_date>=DATE '2000-01-01'"
view("v_stored", f"SELECT {KEY}, revenue_from_operations, expenses, finance_costs FROM v_income WHERE period_end_date<DATE '2001-01-01'")
view("v_incoming", _NEW)


@query("upsert_statements", f"""SELECT {KEY}, CASE WHEN list_contains(present_cols,'revenue_from_operations') THEN n.revenue_from_operations ELSE s.revenue_from_operations END AS revenue_from_operations,
 CASE WHEN list_contains(present_cols,'expenses') THEN n.expenses ELSE s.expenses END AS expenses, s.finance_costs AS finance_costs, CASE WHEN s.o IS NULL THEN 'insert' WHEN present_cols IS NOT NULL THEN 'update' ELSE 'keep' END AS action
 FROM (SELECT *, true AS o FROM v_stored) s FULL JOIN v_incoming n USING ({KEY})""")
def upsert_statements(v):
    """Statements merged field by field into a stored table by year: one version with what was stored, one with what came."""
    inc = v.income.select(*S.STATEMENT_KEY, S.REVENUE, "expenses", S.FINANCE)
    cut = lambda d: F.lit(d).cast("date")
    stored = inc.filter(F.col("period_end_date") < cut("2001-01-01"))
    march = F.month("period_end_date") == 3
    new = inc.filter(F.col("period_end_date") >= cut("2000-01-01")).withColumns({
        S.REVENUE: F.col(S.REVENUE) + 1, "expenses": F.when(~march, F.col("expenses")),
        "present_cols": F.when(march, F.array(F.lit(S.REVENUE), F.lit("expenses"))).otherwise(F.array(F.lit(S.REVENUE)))})
    table = SnapshotTable(v.spark, new_run_dir(v.spark, "statements"), _dated(stored.withColumn("action", F.lit("keep"))).schema, "year")
    table.append(_dated(stored.withColumn("action", F.lit("keep"))))
    table.upsert(_dated(new), lambda old, came: _dated(ST.upsert_present(old.drop("action", "year"), came.drop("year"), S.STATEMENT_KEY)))
    return table.read().drop("year")


def _dated(d):
    return d.withColumn("year", F.year("period_end_date").cast("string"))


@query("upsert_bars", """SELECT symbol, exchange, date, open, high, low, close+CASE WHEN date>=DATE '2001-01-01' THEN 1 ELSE 0 END AS close, adjusted_close, country, volume FROM v_raw_bars""")
def upsert_bars(v):
    """Bars delivered again with corrected closes replace the stored rows of their key; only the years that came are written again."""
    bars = v.raw_bars.withColumn("year", F.year("date").cast("string"))
    old = bars.withColumn("load_ts", F.lit(1))
    new = bars.filter(F.col("date") >= F.lit("2001-01-01").cast("date")).withColumn("close", F.col("close") + 1).withColumn("load_ts", F.lit(2))
    table = SnapshotTable(v.spark, new_run_dir(v.spark, "bars"), old.schema, "year")
    table.append(old)
    table.upsert(new, newest(old.columns, ["symbol", "exchange", "date"], "load_ts"))
    return table.read().drop("year", "load_ts")


view("v_batch", "SELECT url, doc_id, country, source, title FROM v_news WHERE doc_id%3<>0")


@query("insert_ignore", """SELECT url, doc_id, country, source, title FROM v_batch WHERE url NOT IN (SELECT url FROM v_news WHERE doc_id%3=0) QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id)=1""")
def insert_ignore(v):
    n = v.news.select("url", "doc_id", "country", "source", "title")
    return ST.insert_ignore(n.filter("doc_id % 3 = 0"), n.filter("doc_id % 3 <> 0"), "url", "doc_id")


@query("except_existing", "SELECT DISTINCT url FROM v_batch WHERE url NOT IN (SELECT url FROM v_news WHERE doc_id%3=0)")
def except_existing(v):
    n = v.news.select("url", "doc_id")
    new, stored = n.filter("doc_id % 3 <> 0").select("url").distinct(), n.filter("doc_id % 3 = 0").select("url").distinct()
    return new.join(stored, "url", "left_anti")


view("v_filings", """SELECT doc_id AS ord, source AS symbol, CASE WHEN doc_id%2=0 THEN 'NSE' ELSE 'SEC' END AS source, CASE WHEN doc_id%4=0 THEN 'document' ELSE 'announcement' END AS filing_type, CASE WHEN doc_id%4=0 THEN 'd/'||doc_id//20 ELSE 'u/'||doc_id//3 END AS url, text AS raw_data FROM documents""")


def filings(v):
    """Delivered filings: the raw record is the whole text, neighbouring ids share an address."""
    d = v.table("documents")
    k = F.col("doc_id")
    return d.select(k.alias("ord"), F.col("source").alias("symbol"), F.when(k % 2 == 0, "NSE").otherwise("SEC").alias("source"),
                    F.when(k % 4 == 0, "document").otherwise("announcement").alias("filing_type"), F.when(k % 4 == 0, F.concat(F.lit("d/"), F.expr("doc_id div 20"))).otherwise(F.concat(F.lit("u/"), F.expr("doc_id div 3"))).alias("url"), F.col("text").alias("raw_data"))


view("v_dedup1", "SELECT *, md5(raw_data) AS content_hash FROM v_filings QUALIFY row_number() OVER (PARTITION BY symbol, source, md5(raw_data) ORDER BY ord DESC)=1")


@query("dedup_content_hash", """SELECT symbol, source, content_hash, filing_type, url, ord FROM v_dedup1 WHERE filing_type<>'document' UNION ALL
 SELECT symbol, source, content_hash, filing_type, url, ord FROM v_dedup1 WHERE filing_type='document' QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY ord DESC)=1""")
def dedup_content_hash(v):
    return TX.dedup_filings(filings(v)).select("symbol", "source", "content_hash", "filing_type", "url", "ord")


view("v_hwm", "SELECT symbol, exchange, max(date) AS m FROM v_raw_bars WHERE date<CASE WHEN symbol='LARGE' THEN DATE '2100-01-01' ELSE DATE '2000-06-01' END AND symbol<>'SMALL' GROUP BY 1,2")


@query("highwater_incremental", "SELECT b.symbol, b.exchange, b.date, b.close FROM v_raw_bars b LEFT JOIN v_hwm h USING (symbol, exchange) WHERE h.m IS NULL OR b.date>h.m")
def highwater_incremental(v):
    """One symbol is up to date (yields nothing), one is new (yields everything)."""
    limit = F.when(F.col("symbol") == "LARGE", F.lit("2100-01-01")).otherwise(F.lit("2000-06-01")).cast("date")
    stored = v.raw_bars.filter((F.col("date") < limit) & (F.col("symbol") != "SMALL"))
    return ST.highwater_incremental(v.raw_bars.select("symbol", "exchange", "date", "close"), stored.select("symbol", "exchange", "date"))


_FRESH = "TIMESTAMP '2002-02-14 00:00:00'"
_loads = "SELECT symbol, pulled_at FROM v_income WHERE CAST(substring(symbol,2) AS BIGINT)%2=0 OR period_end_date<DATE '2001-06-01' UNION ALL SELECT symbol, pulled_at FROM v_balance WHERE CAST(substring(symbol,2) AS BIGINT)%3=0 OR period_end_date<DATE '2001-06-01'"


@query("freshness_gate", f"SELECT symbol FROM v_meta WHERE symbol NOT IN (SELECT symbol FROM ({_loads}) GROUP BY 1 HAVING max(pulled_at) > {_FRESH} - INTERVAL 7 DAY)")
def freshness_gate(v):
    old = F.col("period_end_date") < F.lit("2001-06-01").cast("date")
    k = F.substring("symbol", 2, 20).cast("bigint")
    loads = [v.income.filter((k % 2 == 0) | old), v.balance.filter((k % 3 == 0) | old)]
    return ST.freshness_gate(v.stock_metadata.select("symbol"), loads, F.lit("2002-02-14 00:00:00").cast("timestamp_ntz"), 7 * 24)


@query("freshness_gate_news", """SELECT country, source FROM v_news GROUP BY 1,2 HAVING max(published_at) <= TIMESTAMP '2024-01-01 18:00:00' - INTERVAL 4 HOUR""")
def freshness_gate_news(v):
    n = v.news.withColumn("feed", F.concat_ws("|", "country", "source"))
    stale = ST.freshness_gate(n.select("feed").distinct(), [n.select("feed", F.col("published_at").alias("pulled_at"))], F.lit("2024-01-01 18:00:00").cast("timestamp_ntz"), 4, "feed")
    return stale.select(F.split_part("feed", F.lit("|"), F.lit(1)).alias("country"), F.split_part("feed", F.lit("|"), F.lit(2)).alias("source"))


@query("skip_existing", """SELECT url, ord, symbol, is_revision FROM (SELECT url, ord, symbol, ord%5=0 AS is_revision FROM v_filings WHERE ord%2=1) WHERE url NOT IN (SELECT url FROM v_filings WHERE ord%2=0) QUALIFY row_number() OVER (PARTITION BY url ORDER BY is_revision, ord)=1""")
def skip_existing(v):
    f = filings(v)
    new = f.filter("ord % 2 = 1").select("url", "ord", "symbol", (F.col("ord") % 5 == 0).alias("is_revision"))
    return ST.skip_existing(new, f.filter("ord % 2 = 0").select("url"))


@query("union_reports", "SELECT symbol, source, 'integrated' AS feed, url, NULL AS filing_type FROM v_filings WHERE filing_type='document' UNION ALL SELECT symbol, source, 'quarterly', url, filing_type FROM v_filings WHERE filing_type<>'document'")
def union_reports(v):
    """Two feeds with different columns, one table."""
    f = filings(v)
    a = f.filter("filing_type = 'document'").select("symbol", "source", F.lit("integrated").alias("feed"), "url")
    b = f.filter("filing_type <> 'document'").select("symbol", "source", F.lit("quarterly").alias("feed"), "url", "filing_type")
    return a.unionByName(b, allowMissingColumns=True)


view("v_outcomes", "SELECT user_id, event_type, CASE WHEN user_id%4=0 THEN CASE WHEN event_type='error' THEN 'error' ELSE 'no data' END WHEN user_id%4=1 THEN 'no data' WHEN event_type='error' AND user_id%4=2 THEN 'error' ELSE 'ok' END AS outcome FROM events")


def outcomes(v):
    """Endpoint outcomes per key derived from the event stream."""
    e, u = v.table("events"), F.col("user_id") % 4
    err = F.col("event_type") == "error"
    o = F.when(u == 0, F.when(err, "error").otherwise("no data")).when(u == 1, "no data").when(err & (u == 2), "error").otherwise("ok")
    return e.select("user_id", o.alias("outcome"))


@query("pull_status", """SELECT user_id, count(*) FILTER (outcome='error') AS failed, count(*) FILTER (outcome='ok') AS succeeded, count(*) AS endpoints, CASE WHEN failed>0 AND succeeded=0 THEN 'failed' WHEN failed>0 THEN 'partial' WHEN succeeded>0 THEN 'completed' ELSE 'no data' END AS status FROM v_outcomes GROUP BY 1""")
def pull_status(v):
    return ST.pull_status(outcomes(v), "user_id")


@query("append_pull_history", """SELECT symbol, len(previous_pulls)+CASE WHEN fresh IS NOT NULL THEN 1 ELSE 0 END AS pulls, coalesce(fresh, last_pull) AS last_pull FROM (SELECT symbol, list(pulled_at ORDER BY pulled_at)[:-2] AS previous_pulls, max(pulled_at) AS last_pull FROM v_income WHERE filing_type='quarterly' AND consolidated GROUP BY 1)
 LEFT JOIN (SELECT symbol, max(pulled_at) + INTERVAL 1 DAY AS fresh FROM v_balance WHERE source='NSE' GROUP BY 1) USING (symbol)""")
def append_pull_history(v):
    q = v.income.filter((F.col("filing_type") == "quarterly") & F.col("consolidated"))
    meta = q.groupBy("symbol").agg(F.array_sort(F.collect_list("pulled_at")).alias("p")).select(
        "symbol", F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("previous_pulls"), F.array_max("p").alias("last_pull"))
    pulls = v.balance.filter(F.col("source") == "NSE").groupBy("symbol").agg((F.max("pulled_at") + F.make_dt_interval(days=F.lit(1))).alias("pulled_at"))
    return ST.append_pull_history(meta, pulls).select("symbol", F.size("previous_pulls").cast("bigint").alias("pulls"), "last_pull")


@query("sink_json_rows", """SELECT symbol, date, '{"date":"'||strftime(date,'%Y-%m-%d')||'","close":'||CAST(close AS VARCHAR)||',"volume":'||volume||'}' AS row_json FROM v_raw_bars WHERE close IS NOT NULL UNION ALL
 SELECT symbol, date, '{"date":"'||strftime(date,'%Y-%m-%d')||'","volume":'||volume||'}' FROM v_raw_bars WHERE close IS NULL""")
def sink_json_rows(v):
    """Bars as JSON objects: nulls dropped, ISO dates."""
    day = F.date_format("date", "yyyy-MM-dd").alias("date")
    return v.raw_bars.select("symbol", "date", F.to_json(F.struct(day, "close", "volume"), {"ignoreNullFields": "true"}).alias("row_json"))


# -- documents -----------------------------------------------------------------------------------

view("v_pagetext", "SELECT doc_id, CAST(p AS INT) AS page, t[p] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t)+1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))")


@query("page_text_table", "SELECT doc_id, page, text FROM v_pagetext")
def page_text_table(v):
    return TX.page_texts(v.table("documents"), "doc_id", "text")


@query("page_size_guard", "SELECT doc_id, count(*) AS pages, CAST(sum(length(v_pagetext.text)) AS BIGINT) AS chars, sum(length(v_pagetext.text)) > 50000 AS too_large FROM v_pagetext GROUP BY 1")
def page_size_guard(v):
    """Pages and characters per document, and whether structuring would be refused."""
    d = v.table("documents").select("doc_id", F.split("text", "\n").alias("p"))
    chars = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return d.select("doc_id", F.size("p").cast("bigint").alias("pages"), chars.alias("chars"), (chars > 50000).alias("too_large"))


@query("select_pages", """WITH r AS (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN '1-2' WHEN 1 THEN '2,1,2' WHEN 2 THEN '9000-9001' ELSE '1,x' END AS spec FROM documents), n AS (SELECT doc_id, max(page) AS num_pages FROM v_pagetext GROUP BY 1),
 w AS (SELECT doc_id, spec, num_pages, CASE WHEN spec='9000-9001' OR spec='1,x' THEN [NULL] ELSE CASE WHEN num_pages>=2 THEN [1,2] ELSE [1] END END AS ps FROM r JOIN n USING (doc_id)),
 u AS (SELECT doc_id, spec, num_pages, unnest(ps) AS page FROM w)
 SELECT u.doc_id, spec, num_pages, CASE WHEN u.page IS NULL AND spec='9000-9001' AND num_pages>=9000 THEN 9000 ELSE CAST(u.page AS INT) END AS page, p.text, CASE WHEN spec='1,x' THEN 'Bad page spec ''1,x''; use e.g. 3,5-9' WHEN u.page IS NULL THEN 'No requested page is within 1-'||num_pages END AS error
 FROM u LEFT JOIN v_pagetext p ON p.doc_id=u.doc_id AND p.page=u.page""")
def select_pages(v):
    k = F.col("doc_id") % 4
    req = v.table("documents").select("doc_id", F.when(k == 0, "1-2").when(k == 1, "2,1,2").when(k == 2, "9000-9001").otherwise("1,x").alias("spec"))
    return TX.select_pages(req, TX.page_texts(v.table("documents"), "doc_id", "text"), "doc_id")


@query("doc_cache_by_hash", """SELECT doc_id, substring(sha256(CASE WHEN doc_id%10=3 THEN text||'!' ELSE text END),1,16) AS doc_hash, CASE WHEN doc_id%5=0 THEN 'new' WHEN doc_id%10=3 THEN 'replace' ELSE 'cached' END AS action FROM documents""")
def doc_cache_by_hash(v):
    d = v.table("documents").select("doc_id", "text")
    stored = d.filter("doc_id % 5 <> 0").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("doc_hash"))
    incoming = d.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return TX.doc_cache(stored, incoming, "doc_id", "text")


@query("digest_keys", "SELECT doc_id, substring(sha256(text),1,16) AS sha_16, substring(sha256(text),1,24) AS sha_24, md5(text) AS md5_hex FROM documents")
def digest_keys(v):
    h = F.sha2("text", 256)
    return v.table("documents").select("doc_id", F.substring(h, 1, 16).alias("sha_16"), F.substring(h, 1, 24).alias("sha_24"), F.md5("text").alias("md5_hex"))


