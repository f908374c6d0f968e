"""Ranked lexical search by Block-Max MaxScore.

The corpus is cut into shards of bounded text size. A shard is one row of the index: the lengths
of its documents and, for every term of the queries, a posting list in compressed blocks. A block
keeps its last document, its largest term frequency and its shortest document outside the
compressed part, which bound the score of any of its postings.

A query's terms are ordered by their bounds in the shard. As long as the bounds of the weakest
terms add up to less than the score needed, their lists are non-essential: only documents of the
other, essential lists are candidates. The non-essential lists are then taken from the strongest
down: a candidate is dropped when its score, the bound of its block and the bounds of all weaker
lists stay below the score needed, and only blocks that keep a candidate are decompressed. Each
task keeps a heap of the best documents for every query over all its shards, whose last score is
the score needed; the heaps of all tasks are merged by Spark.

Queries come in blocks of bounded size, every block over all documents, so what the tasks hold of
them is bounded. Corpus statistics cover all documents.

Scores are whole numbers: a term of weight w = floor(1000 * ln((2N + 2) / (2df + 1))) adds
w * (10^9 tf div (1000 tf + 8 m)) to a document of m = 10 + 90 n N div L. Bounds of the same
formula are exact, so nothing that could reach the result is dropped.

Edge cases: null and empty texts have no terms and don't count as documents; items without terms
have no rows, nor have items whose terms no document has or only with weight 0; rows of the same
item id are one item with the terms of all of them, null ids are the item null; repeated documents
are ranked each; equal scores go by document id, null first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import bounded, broadcast_model, lower_words, pieces
from tapeline.llm.decontamination import stored

TOP = 10
#: Postings of a block.
BLOCK = 128
#: Text bytes of a shard; a document is never split. Documents of a shard are numbered in 16 bits.
SHARD_BYTES, SHARD_DOCS = 16_000_000, 60_000
#: Terms of the queries that are searched together; an item is never split.
BLOCK_TERMS = 200_000

SHARD = ("doc_ids array<bigint>, lengths array<bigint>, terms array<int>, blocks array<int>, df array<int>, "
         "last array<int>, most array<bigint>, shortest array<bigint>, ends array<bigint>, payload binary")


def item_terms(benchmark: DataFrame) -> DataFrame:
    """The distinct terms of every item, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            found = [sorted(set(lower_words(t))) for t in texts]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(at)), pa.array([w for f in found for w in f], pa.binary())], ["item_id", "term"])

    schema = f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, term binary"
    return benchmark.select("item_id", "text").mapInArrow(run, schema).distinct()


def query_blocks(terms: DataFrame, size: int = BLOCK_TERMS) -> Iterator[list[tuple]]:
    """Items with their terms in blocks of at most ``size`` terms (one item at least), streamed in the order of the ids."""
    held: list[tuple] = []
    room = 0
    for row in terms.orderBy("item_id", "term").toLocalIterator():
        if not held or held[-1][0] != row["item_id"]:
            if room >= size:
                yield held
                held, room = [], 0
            held.append((row["item_id"], []))
        held[-1][1].append(bytes(row["term"]))
        room += 1
    if held:
        yield held


# -- the index of one shard ------------------------------------------------------------------------


def _width(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def packed(lists: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray) -> dict[str, object]:
    """Posting lists (ascending documents, frequencies) as compressed blocks, with what bounds each block's scores.

    A block is a byte that tells both widths, the steps between its documents (the first from 0), and its frequencies.
    """
    n_blocks, last, most, shortest, ends, payload = [], [], [], [], [], []
    size = 0
    for docs, tf in lists:
        starts = np.arange(0, len(docs), BLOCK)
        n_blocks.append(len(starts))
        block_most = np.maximum.reduceat(tf, starts)
        most.append(block_most)
        shortest.append(np.minimum.reduceat(lengths[docs], starts))
        last.append(docs[np.minimum(starts + BLOCK, len(docs)) - 1])
        steps = np.diff(docs, prepend=0)
        steps[starts] = docs[starts]
        step_width, tf_width = _width(np.maximum.reduceat(steps, starts)), _width(block_most)
        for s, a, b in zip(starts.tolist(), step_width.tolist(), tf_width.tolist()):
            part = bytes([a << 4 | b]) + steps[s : s + BLOCK].astype(f"<u{a}").tobytes() + tf[s : s + BLOCK].astype(f"<u{b}").tobytes()
            payload.append(part)
            size += len(part)
            ends.append(size)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return {"blocks": np.array(n_blocks, np.int32), "df": np.array([len(d) for d, _ in lists], np.int32), "last": join(last), "most": join(most),
            "shortest": join(shortest), "ends": np.array(ends, np.int64), "payload": b"".join(payload)}


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and frequencies of a block."""
    a, b = block[0] >> 4, block[0] & 15
    n = (len(block) - 1) // (a + b)
    steps = np.frombuffer(block, f"<u{a}", n, 1).astype(np.int64)
    return np.cumsum(steps), np.frombuffer(block, f"<u{b}", n, 1 + a * n).astype(np.int64)


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard with the posting lists of the terms in ``vocabulary`` (its size is bounded by the block of queries)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(ids: list, texts: list) -> list[pa.Array]:
        number = shared.value.get
        lengths, found, counts = [], [], []
        for text in texts:
            words = lower_words(text)
            lengths.append(len(words))
            known = [i for i in map(number, words) if i is not None]
            t, n = np.unique(np.array(known, dtype=np.int64), return_counts=True)
            found.append(t)
            counts.append(n)
        lengths = np.array(lengths, dtype=np.int64)
        terms, tf = np.concatenate(found), np.concatenate(counts)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in found])
        order = np.argsort(terms, kind="stable")  # documents stay ascending
        terms, tf, owner = terms[order], tf[order], owner[order]
        own, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        p = packed([(owner[a:b], tf[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], lengths)
        columns = [ids, lengths, own, p["blocks"], p["df"], p["last"], p["most"], p["shortest"], p["ends"]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return [pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds)] + [pa.array([p["payload"]], pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches, size=shard_bytes):
            ids = piece.column(0).to_pylist()
            for i in range(0, len(ids), SHARD_DOCS):
                yield pa.RecordBatch.from_arrays(index(ids[i : i + SHARD_DOCS], texts[i : i + SHARD_DOCS]), [c.split()[0] for c in SHARD.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SHARD)


# -- search ----------------------------------------------------------------------------------------


@dataclass
class Search:
    """A block of queries: for each its item id, its terms' numbers and their weights; and the corpus statistics."""

    items: list
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    n_docs: int
    n_terms: int
    top: int

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        return 10 + 90 * lengths * self.n_docs // self.n_terms

    @staticmethod
    def impact(weight, tf, norm):
        return weight * (1_000_000_000 * tf // (1000 * tf + 8 * norm))


class Lists:
    """The posting lists of one shard."""

    def __init__(self, row: dict, search: Search):
        self.doc_ids = row["doc_ids"]
        self.norms = search.norms(row["lengths"])
        self.of_term = {t: i for i, t in enumerate(row["terms"].tolist())}
        self.starts = np.concatenate([[0], np.cumsum(row["blocks"])])
        self.last, self.most, self.ends, self.payload = row["last"], row["most"], row["ends"], row["payload"]
        self.block_norms = search.norms(row["shortest"])
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.read:
            self.read[k] = unpacked(self.payload[self.ends[k - 1] if k else 0 : self.ends[k]])
        return self.read[k]


class Heap:
    """The best documents of a query so far: highest score first, then smallest id."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.needed = top, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.top:
            self.needed = int(self.scores[-1])  # an equal score may still win by its id


def best_of_shard(lists: Lists, terms: np.ndarray, weights: np.ndarray, search: Search, heap: Heap) -> None:
    """Offers the documents of the shard that can be among the best; equal scores are never dropped."""
    held = [(lists.of_term[t], w) for t, w in zip(terms.tolist(), weights.tolist()) if w > 0 and t in lists.of_term]
    if not held:
        return
    spans = [slice(lists.starts[i], lists.starts[i + 1]) for i, _ in held]
    block_bounds = [search.impact(w, lists.most[s], lists.block_norms[s]) for (_, w), s in zip(held, spans)]
    bounds = np.array([b.max() for b in block_bounds])
    order = np.argsort(bounds, kind="stable")  # weakest first
    below = np.cumsum(bounds[order])
    if below[-1] < heap.needed:
        return
    essential = int(np.searchsorted(below, heap.needed))  # lists before it can't reach the score needed together
    scores = np.zeros(len(lists.norms), np.int64)
    for k in order[essential:].tolist():
        weight = held[k][1]
        for b in range(spans[k].start, spans[k].stop):
            docs, tf = lists.block(b)
            scores[docs] += search.impact(weight, tf, lists.norms[docs])
    at = np.nonzero(scores)[0]
    have = scores[at]
    for rank in range(essential - 1, -1, -1):
        keep = have + below[rank] >= heap.needed  # by the global bounds of this and all weaker lists
        at, have = at[keep], have[keep]
        k = int(order[rank])
        rest = below[rank - 1] if rank else 0
        first, stop = spans[k].start, spans[k].stop
        block = np.searchsorted(lists.last[first:stop], at)  # the block that would hold the document
        inside = block < stop - first
        bound = np.where(inside, block_bounds[k][np.minimum(block, stop - first - 1)], 0)
        keep = have + bound + rest >= heap.needed  # by the block's bound, before it is decompressed
        at, have, block, inside = at[keep], have[keep], block[keep], inside[keep]
        if not len(at):
            return
        for b in np.unique(block[inside]).tolist():
            mine = np.nonzero(inside & (block == b))[0]
            docs, tf = lists.block(first + b)
            place = np.minimum(np.searchsorted(docs, at[mine]), len(docs) - 1)
            there = docs[place] == at[mine]
            mine, place = mine[there], place[there]
            have[mine] += search.impact(held[k][1], tf[place], lists.norms[at[mine]])
    keep = have >= heap.needed
    heap.offer(have[keep], lists.doc_ids[at[keep]])


_NO_ID = -(1 << 63)


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Index rows as arrays; a null document id is the smallest one."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            arrays = {n: v.values.cast(pa.int64()).fill_null(_NO_ID).to_numpy() for n, v in row.items() if n != "payload"}
            yield {**arrays, "payload": row["payload"].as_py()}


def search_block(index: DataFrame, search: Search, item_type: str) -> DataFrame:
    """The best documents of every query in each task: item_id, doc_id, score."""
    import pickle

    shared = broadcast_model(index.sparkSession, search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Search = pickle.loads(shared.value)
        heaps = [Heap(s.top) for _ in s.items]
        for row in shard_rows(batches):
            lists = Lists(row, s)
            for terms, weights, heap in zip(s.terms, s.weights, heaps):
                best_of_shard(lists, terms, weights, s, heap)
        n = [len(h.ids) for h in heaps]
        items = pa.array([x for x, k in zip(s.items, n) for _ in range(k)])
        ids = np.concatenate([h.ids for h in heaps]) if heaps else np.zeros(0, np.int64)
        scores = np.concatenate([h.scores for h in heaps]) if heaps else ids
        if len(ids):
            yield pa.RecordBatch.from_arrays([items, pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, f"item_id {item_type}, doc_id long, score long")


def statistics(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and the terms of all documents with repeats."""
    per = index.select(F.size(F.filter("lengths", lambda n: n > 0)).cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("l"))
    r = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    return r["n"], r["l"]


def document_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term."""
    each = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for r in bounded(each, n_terms):
        df[r["terms"]] = r["df"]
    return df


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked_search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item. The index of each block of items is a table in the shared folder."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {item_type}, doc_id long, score long")
    for items in query_blocks(item_terms(benchmark), block_terms):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
        index = stored(spark, build_index(docs, vocabulary, shard_bytes), "postings")
        n_docs, n_terms = statistics(index)
        if not n_docs:
            break
        df = document_counts(index, len(vocabulary))
        terms = [np.array([vocabulary[t] for t in own], dtype=np.int64) for _, own in items]
        weights = [np.array([weight(n_docs, int(df[i])) for i in own], dtype=np.int64) for own in terms]
        found = found.unionByName(search_block(index, Search([i for i, _ in items], terms, weights, n_docs, n_terms, top), item_type))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
