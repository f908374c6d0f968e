"""File readers and writers on temporary folders."""

import datetime as dt

from tapeline.operators import instances as IN
from tapeline.sources import io


def test_index_lists(spark, tmp_path):
    (tmp_path / "fifty.txt").write_text("tcs\n\n# note\nINFY BSE\naapl nasdaq us\n")
    got = sorted(tuple(r) for r in io.read_index_lists(spark, str(tmp_path)).collect())
    assert got == [("fifty", "AAPL", "NASDAQ", "US"), ("fifty", "INFY", "BSE", "IN"), ("fifty", "TCS", "NSE", "IN")]


def test_csv_dim(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Symbol,Company,Rank\n ABC , A B C ,3\n")
    r = io.read_csv_dim(spark, str(tmp_path / "c.csv"), "Symbol string, Company string, Rank int").first()
    assert tuple(r) == ("ABC", "A B C", 3)


def test_filings_and_json(spark, tmp_path):
    xml = '''<xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:in="urn:x"><xbrli:context id="OneI"><xbrli:entity><xbrli:identifier>A</xbrli:identifier></xbrli:entity>
    <xbrli:period><xbrli:instant>2025-09-30</xbrli:instant></xbrli:period></xbrli:context><in:Assets contextRef="OneI">12</in:Assets></xbrl>'''
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "ABC_1.xml").write_text(xml)
    r = IN.parse_filing_files(spark, str(tmp_path / "x")).first()
    assert (r.symbol, r.filing_id, r.tag, r.value, r.instant_date) == ("ABC", "ABC_1", "Assets", "12", dt.date(2025, 9, 30))
    d = spark.createDataFrame([("a", dt.date(2024, 1, 2), None)], "s string, d date, x double")
    io.write_json_rows(d, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"s":"a","d":"2024-01-02"}'
    assert io.read_json_feed(spark, str(tmp_path / "j"), "s string, d date, x double").first() == d.first()


def test_page_guard(spark):
    from tapeline.operators import text as TX

    d = spark.createDataFrame([(1, "a\nb"), (2, "x" * 50)], "id int, t string")
    assert [tuple(r) for r in TX.page_texts(d, "id", "t", max_chars=10).orderBy("page").collect()] == [(1, 1, "a"), (1, 2, "b")]
    assert TX.page_texts(d, "id", "t").count() == 3
