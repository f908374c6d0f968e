"""Benchmark decontamination with a positional inverted index.

The index is partitioned by document: a row of it holds, for one training document, the terms
of the test set that occur in it, sorted, with their position lists. Test windows are looked up
by their rarest terms, rarity being counted over the whole index: the position lists of these
terms, moved back by the terms' offsets in the window, are intersected from the rarest on until
all terms of the window agree (exact phrase), or met with some slack (proximity).

The test set is taken in blocks of at most ``block_windows`` windows, so what the tasks hold of
it is bounded however large it is; every block meets every document.

Edge cases: null and empty texts have no words, no hits and aren't contaminated; an item without
words has no window; items may share windows; null item ids are the item 'null'; rows equal in
id and text are one document read several times and get the same result each; an empty
benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import bounded, lower_words, map_texts, neutral
from tapeline.session import new_run_dir

WINDOW = 13
#: Windows of the test set that are looked up in one pass; the vocabulary is at most WINDOW times as large.
BLOCK_WINDOWS = 200_000
#: Rarest terms that have to lie near each other for a proximity match.
NEAR_TERMS = 4

INDEX = "doc_id long, text_key binary, n_words long, terms array<int>, ends array<int>, positions array<int>"
SPANS = "doc_id long, text_key binary, spans array<struct<item_id:string,start:int,length:int>>, near_items array<string>"


def windows_of(items: list[tuple], width: int = WINDOW) -> dict[tuple, set[str]]:
    """Windows of the items' words, each with the items that have it."""
    found: dict[tuple, set[str]] = defaultdict(set)
    for item_id, text in items:
        words = lower_words(text.encode() if isinstance(text, str) else text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            found[tuple(words[i : i + width])].add("null" if item_id is None else str(item_id))
    return found


def _blocks(benchmark: DataFrame, width: int, block_windows: int):
    """Window dictionaries of bounded size, streamed from the test set (one partition at a time)."""
    held: list[tuple] = []
    room = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(lower_words(row["text"].encode())) if row["text"] else 0
        if held and room + n > block_windows:
            yield windows_of(held, width)
            held, room = [], 0
        held.append((row["item_id"], row["text"]))
        room += n
    yield windows_of(held, width)  # the last block, or the empty one of an empty test set


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Position lists, by document, of the terms in ``vocabulary`` (its size is bounded by the block)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(piece: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        number = shared.value.get
        keys, n_words, terms, ends, positions = [], [], [], [], []
        for text in texts:
            words = lower_words(text)
            ids = np.array([number(w, -1) for w in words], dtype=np.int32)
            at = np.nonzero(ids >= 0)[0]
            at = at[np.argsort(ids[at], kind="stable")].astype(np.int32)
            own = ids[at]
            last = np.nonzero(np.append(own[1:] != own[:-1], True))[0] if len(own) else at
            keys.append(hashlib.md5(text or b"", usedforsecurity=False).digest() if text is not None else b"")
            n_words.append(len(words))
            terms.append(own[last])
            ends.append((last + 1).astype(np.int32))
            positions.append(at)
        cols = [piece.column(0), pa.array(keys, pa.binary()), pa.array(n_words, pa.int64()), *map(_lists, (terms, ends, positions))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_words", "terms", "ends", "positions"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), INDEX, run)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def _rows(batch: pa.RecordBatch, name: str):
    """The lists of a column as numpy slices."""
    column = batch.column(batch.schema.names.index(name))
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def term_counts(index: DataFrame) -> DataFrame:
    """Occurrences of every term over all documents of the index, summed inside the tasks first."""

    def run(batches):
        for batch in batches:
            terms, ends = _rows(batch, "terms"), _rows(batch, "ends")
            if not len(terms) or not sum(map(len, terms)):
                continue
            n = np.concatenate([np.diff(e, prepend=0) for e in ends])
            t = np.concatenate(terms)
            total = np.bincount(t, weights=n).astype(np.int64)
            some = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    return index.select("terms", "ends").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _plans(windows: dict[tuple, set[str]], vocabulary: dict[bytes, int], counts: dict[int, int]) -> dict[int, list]:
    """By rarest term: (terms by rarity, their offsets, length, items) of each window; windows with an absent term can't occur."""
    plans: dict[int, list] = defaultdict(list)
    for words, items in windows.items():
        ids = [vocabulary[w] for w in words]
        order = sorted(range(len(ids)), key=lambda i: (counts.get(ids[i], 0), ids[i], i))
        if ids and counts.get(ids[order[0]], 0):
            plans[ids[order[0]]].append((np.array([ids[i] for i in order]), np.array(order), len(ids), sorted(items)))
    return dict(plans)


def search(index: DataFrame, plans: dict[int, list], slack: int | None = None) -> DataFrame:
    """Documents with an exact match, or a proximity match when ``slack`` is given.

    ``spans``: the exact matches as item, first word and length. ``near_items``: the items of
    windows whose NEAR_TERMS rarest terms all occur, each at most ``slack`` words off its place
    relative to the rarest one.
    """
    shared = index.sparkSession.sparkContext.broadcast(plans)

    def lookup(terms, ends, positions):
        places = {}
        start = 0
        for t, e in zip(terms.tolist(), ends.tolist()):
            places[t] = (start, e)
            start = e
        return lambda t: positions[slice(*places[t])] if t in places else None

    def run(batches):
        by_term = shared.value
        anchors = np.array(sorted(by_term), dtype=np.int32)
        for batch in batches:
            ids, keys, spans, nears = [], [], [], []
            for k, (terms, ends, positions) in enumerate(zip(_rows(batch, "terms"), _rows(batch, "ends"), _rows(batch, "positions"))):
                rare = np.intersect1d(terms, anchors, assume_unique=True)
                if not len(rare):
                    continue
                there = set(terms.tolist())
                places = None
                found, near = [], set()
                for t in rare.tolist():
                    for window, offsets, length, items in by_term[t]:
                        if slack is None and not there.issuperset(window.tolist()):
                            continue
                        places = places or lookup(terms, ends, positions)
                        starts = places(t) - offsets[0]
                        if slack is not None:
                            close = starts
                            for w, o in zip(window[1:NEAR_TERMS].tolist(), offsets[1:NEAR_TERMS].tolist()):
                                other = places(w)
                                if other is None:
                                    close = close[:0]
                                    break
                                other = other - o
                                i = np.searchsorted(other, close - slack)
                                close = close[(i < len(other)) & (other[np.minimum(i, len(other) - 1)] <= close + slack)]
                            if len(close):
                                near.update(items)
                        starts = starts[starts >= 0]
                        for w, o in zip(window[1:].tolist(), offsets[1:].tolist()):
                            if not len(starts):
                                break
                            other = places(w)
                            starts = starts[:0] if other is None else np.intersect1d(starts, other - o, assume_unique=True)
                        found += [{"item_id": x, "start": s, "length": length} for s in starts.tolist() for x in items]
                if found or near:
                    ids.append(batch.column(0)[k])
                    keys.append(batch.column(1)[k].as_py())
                    spans.append(found)
                    nears.append(sorted(near))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py() for x in ids], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))), pa.array(nears, pa.list_(pa.string()))],
                ["doc_id", "text_key", "spans", "near_items"])

    return index.mapInArrow(run, SPANS)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slack: int | None = None, block_windows: int = BLOCK_WINDOWS):
    """(documents, matches): doc_id, text_key and n_words of every row, and the spans found by any block.

    The index of each block is a table in the shared folder, read once for the counts (terms
    only) and once for the search.
    """
    spark = docs.sparkSession
    base, found = None, None
    for windows in _blocks(benchmark, width, block_windows):
        vocabulary = {w: i for i, w in enumerate(sorted({w for ws in windows for w in ws}))}
        index = stored(spark, build_index(docs, vocabulary), "positions")
        counts = {r["term"]: r["n"] for r in bounded(term_counts(index), len(vocabulary))} if vocabulary else {}
        base = index.select("doc_id", "text_key", "n_words") if base is None else base
        hits = search(index, _plans(windows, vocabulary, counts), slack)
        found = hits if found is None else found.unionByName(hits)
    return base, found


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder, which survives lost executors."""
    path = new_run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slack: int | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """For each document: n_words, n_hit (words inside any occurrence), items with occurring windows, near items, spans, contaminated."""
    base, found = matches(docs, benchmark, width, slack, block_windows)
    spans = found.select("doc_id", "text_key", F.explode_outer("spans").alias("s"), "near_items")
    per_doc = spans.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s.start", "s.length")))).alias("places"),
        F.array_sort(F.collect_set("s.item_id")).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("near_items")))).alias("near_items"))
    # words of the union of the places, which are sorted by their start
    union = F.aggregate("places", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, p: F.struct(
        F.greatest(acc.end, p.start + p.length).alias("end"),
        (acc.n + F.greatest(F.lit(0), p.start + p.length - F.greatest(acc.end, p.start))).alias("n"))).getField("n")
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), union.alias("n_hit"), "items", "near_items", "places")
    d = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    return d.select(
        "doc_id", "text_key", "n_words", hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
        F.coalesce("places", F.array().cast("array<struct<start:int,length:int>>")).alias("places"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated; same columns. Only keys of the contaminated ones meet the texts."""
    bad = decontaminate(docs, benchmark, width).where("contaminated").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("text_key").alias("_key")).distinct()
    key = F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.md5("text")))
    d, restored = neutral(docs, "doc_id", "text")
    d = d.withColumns({"_id": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "_key": key})
    return d.join(bad, ["_id", "_key"], "left_anti").select(*restored)


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
