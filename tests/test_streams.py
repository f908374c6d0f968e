"""Stored tables and streams: crashes, conflicting writers, late, repeated and corrected rows, many batches."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.sources.snapshots import Conflict, SnapshotTable, newest
from tapeline.streaming import jobs as J

KEPT = "k int, p string, x double, load int"


def table_of(spark, path, rows=None):
    t = SnapshotTable(spark, str(path), KEPT, "p")
    if rows:
        t.append(spark.createDataFrame(rows, KEPT))
    return t


MERGE = newest(["k", "p", "x", "load"], ["k", "p"], "load")


def rows_of(table):
    return sorted((r.k, r.p, r.x) for r in table.read().collect())


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    t = table_of(spark, tmp_path / "t", [(1, "a", 1.0, 1), (2, "a", 2.0, 1), (3, "b", 3.0, 1), (4, None, 0.0, 1), (5, "x/y z", 5.0, 1)])
    before = t.manifest()
    t.upsert(spark.createDataFrame([(2, "a", 20.0, 2), (2, "a", 0.5, 0), (6, "a", 4.0, 2), (7, "new", 7.0, 2)], KEPT), MERGE)
    after = t.manifest()
    want = [(1, "a", 1.0), (2, "a", 20.0), (3, "b", 3.0), (4, None, 0.0), (5, "x/y z", 5.0), (6, "a", 4.0), (7, "new", 7.0)]
    assert sorted(((r.k, r.p, r.x) for r in t.read().collect()), key=lambda r: r[0]) == want
    assert after.version == before.version + 1 and all(after.parts[p] == before.parts[p] for p in ("b", "", "x/y z")) and after.parts["a"] != before.parts["a"]
    # a reader of the version before still finds its files
    assert t.read(manifest=before).count() == 5
    assert table_of(spark, tmp_path / "empty").read().count() == 0


def test_a_writer_that_dies_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    t = table_of(spark, tmp_path / "t", [(1, "a", 1.0, 1)])

    def dies(manifest):
        raise OSError("killed")

    monkeypatch.setattr(t, "publish", dies)
    with pytest.raises(OSError):
        t.upsert(spark.createDataFrame([(1, "a", 9.0, 2)], KEPT), MERGE)
    again = table_of(spark, tmp_path / "t")
    assert rows_of(again) == [(1, "a", 1.0)]
    assert again.sweep(older_than=0) == 1 and again.sweep(older_than=0) == 0 and rows_of(again) == [(1, "a", 1.0)]


def test_two_writers(spark, tmp_path):
    one, two = table_of(spark, tmp_path / "t", [(1, "a", 1.0, 1), (2, "b", 2.0, 1)]), table_of(spark, tmp_path / "t")
    base = one.manifest()
    new = one._write(spark.createDataFrame([(1, "a", 5.0, 2)], KEPT))
    two.upsert(spark.createDataFrame([(2, "b", 7.0, 2)], KEPT), MERGE)  # another partition: the first writer still publishes
    one._commit(base, lambda m: {**m.parts, **new}, {"a"}, None)
    assert rows_of(one) == [(1, "a", 5.0), (2, "b", 7.0)]
    with pytest.raises(Conflict):  # the same partition: what was merged is out of date
        one._commit(base, lambda m: {**m.parts, **new}, {"b"}, None)
    with pytest.raises(Conflict):
        two.publish(one.manifest())  # a version has one writer
    # a writer that meets a conflict merges again with what the other one wrote
    calls = []

    def merge(stored, incoming):
        if not calls:
            calls.append(1)
            two.upsert(spark.createDataFrame([(8, "a", 8.0, 3)], KEPT), MERGE)
        return MERGE(stored, incoming)

    one.upsert(spark.createDataFrame([(9, "a", 9.0, 3)], KEPT), merge)
    assert rows_of(one) == [(1, "a", 5.0), (2, "b", 7.0), (8, "a", 8.0), (9, "a", 9.0)]


def test_feeds_are_applied_once_and_folders_compacted(spark, tmp_path):
    t = table_of(spark, tmp_path / "t")
    for epoch in (0, 1, 1, 0, 2):
        t.append(spark.createDataFrame([(epoch, "a", 1.0, 1)], KEPT), ("s", epoch))
    assert [r[0] for r in rows_of(t)] == [0, 1, 2] and len(t.manifest().parts["a"]) == 3
    t.compact(lambda d: d, most=2)
    assert [r[0] for r in rows_of(t)] == [0, 1, 2] and len(t.manifest().parts["a"]) == 1
    t.forget(lambda p: p == "a")
    assert rows_of(t) == [] and t.manifest().applied == {"s": 2}


def write_files(spark, path, frames):
    """One file a frame, oldest first."""
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(path))
        new = [p for p in path.iterdir() if p.suffix == ".parquet" and p.stat().st_mtime > 10**9 + 10**6]
        for p in new:
            os.utime(p, (10**9 + i, 10**9 + i))


def feed(spark, path, frames):
    write_files(spark, path, frames)
    return J.read_stream(spark, str(path))


def test_unseen_rows_over_many_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [[(rng.choice("abcdefghij") * rng.randint(1, 2), i * 100 + j, None if j % 7 == 0 else f"p{i}") for j in range(12)] for i in range(10)]
    rows[3] += [(None, 399, "n"), (None, 398, "m")]
    rows[8] += [(None, 1, "late")]
    write_files(spark, tmp_path / "t", [spark.createDataFrame(r, "k string, n int, payload string") for r in rows])
    got = J.drain_unseen(spark, str(tmp_path / "t"), [F.col("k"), F.col("n"), F.col("payload")], ["k"], "n", "t")
    seen, want = set(), []
    for epoch, batch in enumerate(rows):
        first = {}
        for k, n, p in sorted(batch, key=lambda r: r[1]):
            first.setdefault(k, (k, n, p, epoch))
        want += [r for k, r in first.items() if k not in seen]
        seen |= set(first)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    empty = tmp_path / "none"
    spark.createDataFrame([], "k string, n int").write.parquet(str(empty))
    assert J.drain_unseen(spark, str(empty), [F.col("k"), F.col("n")], ["k"], "n", "none").count() == 0


def test_lowest_order_stays_however_files_come(spark, tmp_path):
    batches = [[("a", 5, "x"), ("b", 1, "x"), (None, 7, "x")], [("a", 3, None), ("b", 2, "y"), ("c", 9, "y")], [("a", 4, "z"), (None, 6, "z"), ("c", 9, "z"), ("a", 3, None)]]
    write_files(spark, tmp_path / "t", [spark.createDataFrame(b, "k string, n int, payload string") for b in batches])
    got = J.drain_unseen(spark, str(tmp_path / "t"), [F.col("k"), F.col("n"), F.col("payload")], ["k"], "n", "t", lowest=True)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", 3, None, 1), ("b", 1, "x", 0), ("c", 9, "y", 1), (None, 6, "z", 2)]))


@pytest.mark.parametrize("name", ["stream_dedup_filings", "stream_news_insert_ignore"])
def test_documents_delivered_newest_first(spark, tmp_path, name):
    import duckdb
    from compare import compare
    from tapeline.registry import all_queries, run

    rows = [(i, f"text {i % 7}", f"s{i % 3}") for i in range(60)]
    frames = [spark.createDataFrame(rows[i : i + 20], "doc_id long, text string, source string") for i in (40, 20, 0)]
    write_files(spark, tmp_path / "documents.parquet", frames)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ok, message = compare(run(name, spark, str(tmp_path)), con, all_queries()[name].sql)
    assert ok, message


def test_a_batch_reads_its_own_files_only(spark, tmp_path, monkeypatch):
    frames = [spark.createDataFrame([(f"k{i}", i, "x"), ("same", i, "x")], "k string, n int, payload string") for i in range(10)]
    write_files(spark, tmp_path / "t", frames)
    sizes = []
    reader = type(spark.read)
    plain = reader.parquet

    def counted(self, *paths, **options):
        d = plain(self, *paths, **options)
        if paths and all(str(p).startswith("file:") and str(p).endswith(".parquet") for p in paths):
            sizes.append(len(paths))
        return d

    monkeypatch.setattr(reader, "parquet", counted)
    got = J.drain_unseen(spark, str(tmp_path / "t"), [F.col("k"), F.col("n"), F.col("payload")], ["k"], "n", "t")
    assert got.count() == 11 and sizes == [1] * 10


def test_rate_decisions(spark, tmp_path):
    at = lambda m, s: dt.datetime(2024, 1, 1, 10, m, s)
    batches = [[(1, 7, at(0, 1)), (2, 7, at(0, 2)), (3, 8, at(0, 3))], [(4, 7, at(0, 50)), (5, 7, at(1, 0)), (6, None, at(0, 5))], [(7, 7, at(0, 30)), (8, 8, at(0, 59)), (9, 7, dt.datetime(2024, 1, 9))]]
    stream = feed(spark, tmp_path / "t", [spark.createDataFrame(b, "event_id long, key long, ts timestamp_ntz") for b in batches])
    got = {r.event_id: (r.request, r.allowed, r.remaining, r.retry_after) for r in J.rate_decisions(stream, "d", rpm=2, keep_days=3).collect()}
    assert got == {1: (1, True, 1, None), 2: (2, True, 0, None), 3: (1, True, 1, None), 4: (3, False, 0, 10), 5: (1, True, 1, None), 6: (1, True, 1, None),
                   7: (4, False, 0, 30), 8: (2, True, 0, None), 9: (1, True, 1, None)}


def sessions(events, gap):
    out = []
    for symbol in sorted({e[0] for e in events}):
        own = sorted(e for e in events if e[0] == symbol)
        for e in own:
            if out and out[-1][0] == symbol and (e[1] - out[-1][2]).total_seconds() < gap:
                out[-1] = (symbol, out[-1][1], e[1], out[-1][3] + 1)
            else:
                out.append((symbol, e[1], e[1], 1))
    return out


def test_a_late_print_joins_sessions(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 9, 59, 58)
    rng = random.Random(4)
    events = [(s, t0 + dt.timedelta(seconds=x)) for s in "ab" for x in [0, 59, 118, 178, 300, 361, 362, *rng.sample(range(400, 4000), 60)]]
    rows = [(s, t, 1.5, i) for i, (s, t) in enumerate(events)]
    rng.shuffle(rows)
    bridge = ("a", t0 + dt.timedelta(seconds=240), 1.5, 999)  # between 178 and 300, read last
    schema = "event_type string, ts timestamp_ntz, value double, event_id long"
    stream = feed(spark, tmp_path / "t", [spark.createDataFrame(b, schema) for b in (rows[:40], rows[40:90], rows[90:], [bridge])])
    parts = J.drain(stream, "gaps", transform=J.gap_parts(60))
    for part, own in ((parts.where("epoch < 3"), events), (parts, events + [bridge[:2]])):
        got = sorted((r.symbol, r.session_start, r.session_end, r.bars) for r in J.gap_sessions(part, 60).collect())
        assert got == sorted(sessions(own, 60))


def smoothing(bars):
    d = pd.DataFrame(bars, columns=["date", "high", "low", "close"])
    step = d.close.diff()
    mean = lambda x, a: x.ewm(alpha=a, adjust=False, ignore_na=True).mean().iloc[-1]
    reach = pd.concat([d.high - d.low, (d.high - d.close.shift()).abs(), (d.low - d.close.shift()).abs()], axis=1).max(axis=1)
    gain, loss = mean(step.clip(lower=0), 1 / 14), mean((-step).clip(lower=0), 1 / 14)
    rsi = None if len(d) < 2 or gain == loss == 0 else 100 - 100 / (1 + gain / loss) if loss else 100.0
    return len(d), d.close.iloc[-1], mean(d.close, 2 / 13), mean(d.close, 2 / 27), rsi, mean(reach, 1 / 14)


def test_indicators_with_late_and_corrected_bars(spark, tmp_path):
    rng = random.Random(6)
    bars = {}
    for s in "AB":
        close = 100.0
        for i in range(400 if s == "A" else 70):
            close += rng.uniform(-3, 3)
            bars[s, dt.date(2020, 11, 2) + dt.timedelta(days=i)] = (close + 1, close - 2, close)
    bars["C", dt.date(2021, 3, 1)] = (2.0, 1.0, 1.5)
    flat = [(s, d, *v, 1) for (s, d), v in bars.items()]
    early = [r for r in flat if r[1].month % 3 == 0]
    first = [r for r in flat if r not in early and r[1] >= dt.date(2021, 5, 1)]
    second = [r for r in flat if r not in early and r[1] < dt.date(2021, 5, 1)]
    correction = ("A", dt.date(2021, 1, 15), 500.0, 400.0, 450.0, 2)
    schema = "symbol string, date date, high double, low double, close double, load bigint"
    # newest first, then older ones, quarters' ends last, then one corrected bar, its old load again and a repeated bar
    batches = [first, second, early, [correction], [next(r for r in flat if r[:2] == correction[:2]), flat[-1]]]
    table = J.indicators(feed(spark, tmp_path / "t", [spark.createDataFrame(b, schema) for b in batches]), "state")
    bars["A", dt.date(2021, 1, 15)] = correction[2:5]
    for r in J.latest_indicators(table.read()).collect():
        own = sorted((d, *v) for (s, d), v in bars.items() if s == r.symbol)
        want = smoothing(own)
        assert r.date == own[-1][0] and (r.bars, r.close) == want[:2]
        assert all(a == pytest.approx(b, abs=1e-9) if b is not None else a is None for a, b in zip((r.ema_12, r.ema_26, r.rsi_14, r.atr_14), want[2:]))
    months = {(s, d.year, d.month) for s, d in bars}
    assert table.read().count() == len(months)


def test_partial_bars_are_compacted(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    schema = "symbol string, date date, open double, high double, low double, close double, volume long"
    frames = [spark.createDataFrame([("A", d, float(i), i + 1.0, i - 1.0, i + 0.5, 10) for i, d in enumerate(days) if i % 9 == k], schema) for k in range(9)]
    table = J.drain_parts(feed(spark, tmp_path / "t", frames), "weekly", J.bar_parts("week"), J.merge_bar_parts, "bucket", most=3)
    assert all(len(f) <= 3 for f in table.manifest().parts.values())
    got = J.merge_bars(table.read().drop("year")).orderBy("date").collect()
    assert sum(r.volume for r in got) == 600 and got[0].open == 0.0 and got[0].close == 6.5 and got[-1].high == 60.0
