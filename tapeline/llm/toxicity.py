"""Toxicity by nearest labelled examples.

Texts and examples are TF-IDF vectors over all words of the examples: sublinear term frequency
times the squared inverse document frequency over all documents, and a word that few examples
have counts in proportion to how many have it, so that a chance match of two rare words doesn't
make neighbours. The examples form an inverted index whose postings lie in blocks of examples of
one label, each term having the largest weight of every block: blocks whose bound can't reach the
k-th best cosine are skipped, the others are scored exactly. Words that many examples have are
full rows of weights, and the texts of a batch meet them in one matrix product.

The nearest examples of each label vote, each with its cosine: a vote is the mean cosine of the
nearest toxic examples less that of the nearest others, taken among near and among more distant
neighbours. A logistic curve fitted on leave-one-out votes, rows weighted to the labels' shares,
turns the votes into scores. The nearest examples are the evidence.

Bounds: ``PER_CLASS`` examples of each label (those with the smallest hash of the id); the index
that tasks hold has the different words of these whole texts.

Edge cases: a text that is null, empty or has no word of any example has no neighbour and the
score of the examples without neighbours; an id labelled twice is toxic if any label says so; ties
go to the example that comes first in the index; repeated rows get the same score; without
examples of both labels every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import bounded, broadcast_model, fold, lower_words, pieces

PER_CLASS = 2_000
#: Neighbours of each label: one in so many of its examples for each vote, at most NEIGHBOURS, at least LEAST.
NEAR, NEIGHBOURS, LEAST = (20, 5), 400, 3
#: A word counts in full when it is in one example for every COMMON of the smaller label, else in proportion.
COMMON = 50
FOLDS, HELD_OUT = 5, 0
#: Examples in a block of the index.
BLOCK = 256
#: Texts whose scores a task remembers; beyond it the memory starts anew.
REMEMBERED = 20_000
#: Texts that meet the full rows together.
BATCH = 256
#: Words that one in OFTEN examples has get full rows, the most frequent ones at most.
OFTEN, MOST_OFTEN = 64, 1_000


def examples(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of the sampled labelled rows outside the held-out fold, and how many rows each label has there."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in bounded(named.groupBy("toxic").agg(F.count("*").alias("n")), 2)}
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    picked = [named.where(F.col("toxic") == y).orderBy(*by_hash).limit(per_class) for y in (0, 1)]
    return picked[0].unionByName(picked[1]), totals


def _term_rows(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """doc_id, toxic, term and its count for every term of the sampled documents; every text has the empty term too."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")

    def run(batches):
        for piece, texts in pieces(batches, "text"):
            counts = [Counter([b"", *lower_words(t)]) for t in texts]
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            words = pa.array([w for c in counts for w in c], pa.binary())
            n = pa.array([v for c in counts for v in c.values()], pa.int32())
            same = [piece.column(piece.schema.names.index(c)).take(pa.array(at)) for c in ("doc_id", "toxic")]
            yield pa.RecordBatch.from_arrays([*same, words, n], ["doc_id", "toxic", "term", "tf"])

    rows = texts.mapInArrow(run, "doc_id long, toxic int, term binary, tf int")
    return rows.groupBy("doc_id", "toxic", "term").agg(F.max("tf").alias("tf"))


def document_frequencies(docs: DataFrame, terms: pa.Array) -> np.ndarray:
    """Documents that have each of these terms, over every whole text; the empty term counts all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}.get
        n = np.zeros(len(shared.value), np.int64)
        for _, texts in pieces(batches):
            found = [i for t in texts for i in map(number, {b"", *lower_words(t)}) if i is not None]
            n += np.bincount(np.array(found, np.int64), minlength=len(n))
        some = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], ["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms), np.int64)
    for r in bounded(counted, len(terms)):
        out[r["term"]] = r["n"]
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its size, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


#: Term numbers, ascending, and weights; and cosines with the numbers of their examples.
Vector = tuple[np.ndarray, np.ndarray]
Found = tuple[np.ndarray, np.ndarray]


@dataclass
class Index:
    """Block-max inverted index of the examples; postings of a term are sorted by example."""

    weights: dict[bytes, tuple[int, float]]  # term: number, weight of one occurrence
    first: np.ndarray  # postings of term i: first[i] to first[i + 1]
    example: np.ndarray
    weight: np.ndarray
    block_first: np.ndarray  # (term, block) entries of term i
    block: np.ndarray
    block_max: np.ndarray
    block_at: np.ndarray  # postings of an entry: block_at[j] to block_at[j + 1]
    ids: np.ndarray
    toxic: np.ndarray
    own_at: np.ndarray  # terms and weights of example i: own_at[i] to own_at[i + 1]
    own_term: np.ndarray
    own_weight: np.ndarray
    parts: list[tuple[slice, slice]]  # examples and blocks of label 0 and 1
    starts: np.ndarray  # first example of each block
    row: np.ndarray  # a frequent term's row of weights, -1 for other terms, which have postings
    rows: np.ndarray
    alone: float = 0.0  # score without neighbours
    slopes: tuple[float, ...] = (1.0,) * len(NEAR)
    shift: float = 0.0

    def __reduce__(self):
        """Sent to tasks without what follows from the vectors."""
        parts = (self.ids, self.toxic, np.diff(self.own_at), self.own_term, self.own_weight, self.weights)
        return _index, parts, {"alone": self.alone, "slopes": self.slopes, "shift": self.shift}

    def arrays(self, words) -> Vector:
        """Term numbers and weights of a text, of length 1; words that no example has count nothing."""
        known = self.weights.get
        held = [(*x, n) for w, n in Counter(words).items() if (x := known(w))]
        if not held:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, weights, n = (np.array(c) for c in zip(*held))
        order = np.argsort(terms)
        v = ((1 + np.log(n)) * weights)[order]
        norm = math.sqrt(v @ v)
        return (terms[order], v / norm) if norm else (np.zeros(0, np.int64), np.zeros(0))

    def vector(self, words) -> dict[int, float]:
        """The same as a dictionary."""
        terms, weights = self.arrays(words)
        return dict(zip(terms.tolist(), weights.tolist()))

    def own(self, i: int) -> Vector:
        """The vector of an example."""
        at = slice(self.own_at[i], self.own_at[i + 1])
        return self.own_term[at].astype(np.int64), self.own_weight[at]

    def _scores(self, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Parts of the cosines from the postings of these (term, block) entries, by example."""
        size = self.block_at[entries + 1] - self.block_at[entries]
        at = _ranges(self.block_at[entries], size)
        return np.bincount(self.example[at], np.repeat(weights, size) * self.weight[at], len(self.ids))

    def _search(self, score: np.ndarray, terms: np.ndarray, own: np.ndarray, k: list[int], without: int, parts: list[tuple[slice, slice]]) -> list[Found]:
        """For each part the k examples of the largest cosine over 0, exact.

        ``score`` has the parts of the cosines from frequent terms; ``terms`` are the others. The
        blocks with the largest bounds are scored until they hold enough examples, then all
        blocks whose bound reaches the k-th best cosine found so far.
        """
        size = self.block_first[terms + 1] - self.block_first[terms]
        entries, weights = _ranges(self.block_first[terms], size), np.repeat(own, size)
        blocks = self.block[entries]
        bound = np.bincount(blocks, weights * self.block_max[entries], len(self.starts)) + np.maximum.reduceat(score, self.starts)
        first, rest = np.zeros(len(bound), bool), np.zeros(len(bound), bool)
        for (_, at), n in zip(parts, k):
            first[at.start + np.argsort(-bound[at], kind="stable")[: 2 + 2 * n // BLOCK]] = True
        use = first[blocks]
        score = score + self._scores(entries[use], weights[use])
        for (those, at), n in zip(parts, k):
            found = score[those]
            if those.start <= without < those.stop:
                found = np.delete(found, without - those.start)
            least = np.partition(found, -n)[-n] if len(found) >= n else 0.0
            rest[at] = (bound[at] >= least - 1e-8) & ~first[at]
        if rest.any():
            use = rest[blocks]
            score += self._scores(entries[use], weights[use])
        score = score.round(9)
        if without >= 0:
            score[without] = 0
        out = []
        for (those, _), n in zip(parts, k):
            some = np.nonzero(score[those] > 0)[0] + those.start
            if len(some) > n:
                some = some[score[some] >= np.partition(score[some], -n)[-n]]
            some = some[np.lexsort((some, -score[some]))[:n]]
            out.append((score[some], some))
        return out

    def neighbours(self) -> list[list[int]]:
        """For each vote how many examples of label 0 and 1 take part."""
        return [[max(LEAST, min(NEIGHBOURS, (those.stop - those.start) // one_in)) for those, _ in self.parts] for one_in in NEAR]

    def nearest(self, vectors: list[Vector], without: list[int] | None = None, k: list[int] | None = None, parts: list[tuple[slice, slice]] | None = None) -> list[list[Found]]:
        """For each vector and label the cosines and numbers of the nearest examples, nearest first; ``without`` names examples to leave out."""
        parts, k = parts or self.parts, k or [max(n) for n in zip(*self.neighbours())]
        flat = np.zeros((len(vectors), len(self.rows)))
        sparse = []
        for i, (terms, own) in enumerate(vectors):
            row = self.row[terms]
            often = row >= 0
            flat[i, row[often]] = own[often]
            sparse.append((terms[~often], own[~often]))
        scores = flat @ self.rows
        none = np.zeros(0), np.zeros(0, np.int64)
        return [self._search(scores[i], *sparse[i], k, without[i] if without else -1, parts) if len(v[0]) else [none for _ in parts] for i, v in enumerate(vectors)]

    def votes(self, near: list[Found]) -> list[float]:
        """Mean cosines of the toxic neighbours less those of the others."""
        clean, toxic = near
        return [float(toxic[0][:t].sum() / t - clean[0][:c].sum() / c) for c, t in self.neighbours()]

    def score(self, near: list[Found]) -> float:
        if not any(len(cosines) for cosines, _ in near):
            return self.alone
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.slopes, self.votes(near)) + self.shift, -700, 700))))


def build_index(vectors: list[tuple[int, int, dict[int, float]]], weights: dict[bytes, tuple[int, float]]) -> Index:
    """Index of (id, toxic, vector)."""
    size = np.array([len(v) for _, _, v in vectors], np.int64)
    terms = np.fromiter((t for _, _, v in vectors for t in v), np.int64, size.sum())
    own = np.fromiter((w for _, _, v in vectors for w in v.values()), float, size.sum())
    return _index(np.array([x[0] for x in vectors], np.int64), np.array([x[1] for x in vectors], np.int64), size, terms, own, weights)


def _index(ids: np.ndarray, toxic: np.ndarray, size: np.ndarray, terms: np.ndarray, own: np.ndarray, weights: dict) -> Index:
    """Index of vectors put after each other; examples of a label with the same heaviest term lie together, so that blocks have tight bounds."""
    at = np.cumsum(size) - size
    heaviest = np.array([terms[a + np.argmax(own[a : a + n])] if n else -1 for a, n in zip(at, size)], np.int64)
    order = np.lexsort((ids, heaviest, toxic))
    ids, toxic, size, at = ids[order], toxic[order], size[order], at[order]
    moved = _ranges(at, size)
    own_term, own_weight, own_at = terms[moved].astype(np.int32), own[moved], np.append(0, np.cumsum(size))
    clean, number = int((toxic == 0).sum()), np.arange(len(ids))
    split = -(-clean // BLOCK)
    block_of = np.where(number < clean, number // BLOCK, split + (number - clean) // BLOCK)
    starts = np.nonzero(np.append(True, block_of[1:] != block_of[:-1]))[0] if len(ids) else number

    example = np.repeat(number, size).astype(np.int32)
    often = np.bincount(own_term, minlength=len(weights))
    often = [t for t in np.argsort(-often, kind="stable")[:MOST_OFTEN] if often[t] * OFTEN > len(ids)]
    row, rows = np.full(len(weights), -1, np.int64), np.zeros((len(often), len(ids)))
    row[often] = np.arange(len(often))
    inside = row[own_term] >= 0
    rows[row[own_term[inside]], example[inside]] = own_weight[inside]
    term, example, weight = own_term[~inside], example[~inside], own_weight[~inside]
    order = np.lexsort((example, term))
    term, example, weight = term[order], example[order], weight[order]
    key = term * np.int64(len(starts) + 1) + block_of[example]
    at = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.zeros(0, np.int64)
    numbers = np.arange(len(weights) + 1)
    return Index(
        weights, np.searchsorted(term, numbers), example, weight, np.searchsorted(term[at], numbers), block_of[example[at]],
        np.maximum.reduceat(weight, at) if len(at) else weight, np.append(at, len(key)), ids, toxic, own_at, own_term, own_weight,
        [(slice(0, clean), slice(0, split)), (slice(clean, len(ids)), slice(split, len(starts)))], starts, row, rows)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the weighted logistic curve of y over the columns of x, by Newton's method with step halving; a slight ridge on the scaled slopes."""
    scale = np.sqrt((w[:, None] * x * x).sum(axis=0) / w.sum())
    scale[scale == 0] = 1.0
    z = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 1e-3 * w.sum()), 0.0)

    def loss(c: np.ndarray) -> float:
        t = z @ c
        return float((w * (np.logaddexp(0, t) - y * t)).sum() + (ridge * c * c).sum() / 2)

    c = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -700, 700)))
        g = z.T @ (w * (y - p)) - ridge * c
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), g)
        while loss(c + step) > loss(c) and np.abs(step).max() > 1e-9:
            step = step / 2
        c = c + step
        if np.abs(step).max() < 1e-9:
            break
    return c[:-1] / scale, float(c[-1])


def leave_one_out(spark, index: Index) -> DataFrame:
    """(example, votes): the votes that each example gets from the others, null without neighbours; searched in tasks."""
    shared = broadcast_model(spark, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.column(0)[at : at + BATCH].to_pylist()
                near = own.nearest([own.own(i) for i in some], without=some)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([own.votes(n) if any(len(c) for c, _ in n) else None for n in near], pa.list_(pa.float64()))], ["example", "votes"])

    return spark.range(0, len(index.ids), 1, max(1, min(64, len(index.ids) // 100))).mapInArrow(run, "example long, votes array<double>")


def calibrate(index: Index, votes: list[list[float] | None], totals: dict[int, int]) -> None:
    """Fits the curve on the examples' votes, rows weighted to the labels' shares."""
    share = np.array([totals.get(y, 0) / max(1, (index.toxic == y).sum()) for y in (0, 1)])
    y, w = index.toxic.astype(float), share[index.toxic]
    lone = np.array([x is None for x in votes])
    index.alone = float((w * y)[lone].sum() / w[lone].sum()) if lone.any() else float((w * y).sum() / w.sum())
    if not lone.all():
        slopes, index.shift = logistic(np.array([x for x in votes if x is not None]), y[~lone], w[~lone])
        index.slopes = tuple(slopes.tolist())


def word_weights(df: np.ndarray, examples_with: np.ndarray, documents: int, smaller: int) -> np.ndarray:
    """Weight of one occurrence of each word: squared idf, less for words that few examples have; ``smaller`` counts the smaller label's examples."""
    return np.log((1 + documents) / (1 + df)) ** 2 * np.minimum(1, examples_with * COMMON / max(1, smaller))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Index | None:
    """The index of the sampled examples; None without examples of both labels."""
    spark = docs.sparkSession
    picked, totals = examples(docs, labels, per_class)
    rows = _term_rows(docs, picked).toArrow()  # the words of 2 * per_class texts at most
    rows = rows.sort_by([("doc_id", "ascending"), ("term", "ascending")])
    if len(set(rows["toxic"].unique().to_pylist())) < 2:
        return None
    terms = pc.unique(rows["term"]).sort()  # the empty one is the first
    df = document_frequencies(docs, terms)
    number = pc.index_in(rows["term"], value_set=terms).to_numpy()
    ids, label, tf = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy(), rows["tf"].to_numpy()
    first = np.nonzero(np.append(True, ids[1:] != ids[:-1]))[0]  # the empty term of each example
    weight_of = word_weights(df, np.bincount(number, minlength=len(terms)), int(df[0]), int(np.bincount(label[first], minlength=2).min()))
    weights = {t: (i, x) for i, (t, x) in enumerate(zip(terms.to_pylist()[1:], weight_of[1:].tolist()))}
    weight = (1 + np.log(tf)) * weight_of[number]
    weight[first] = 0
    weight /= np.maximum(np.repeat(np.sqrt(np.add.reduceat(weight * weight, first)), np.diff(np.append(first, len(ids)))), 1e-300)
    real = number > 0
    size = np.diff(np.append(first, len(ids))) - 1
    index = _index(ids[first], label[first].astype(np.int64), size, number[real].astype(np.int64) - 1, weight[real], weights)
    del rows, df, number, weight
    votes = sorted((r["example"], r["votes"]) for r in bounded(leave_one_out(spark, index), len(index.ids)))
    calibrate(index, [v for _, v in votes], totals)
    return index


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """doc_id, score and the nearest examples (evidence: id, similarity, toxic) of every whole text."""
    shared = broadcast_model(docs.sparkSession, index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def results(own: Index | None, texts: list) -> list[tuple]:
        if own is None:
            return [(0.0, [])] * len(texts)
        out = []
        for near in own.nearest([own.arrays(lower_words(t)) for t in texts]):
            best = sorted((x for c, i in near for x in zip(c[:3].tolist(), i[:3].tolist())), key=lambda x: (-x[0], x[1]))[:3]
            out.append((own.score(near), [{"doc_id": int(own.ids[i]), "similarity": c, "toxic": int(own.toxic[i])} for c, i in best]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = pickle.loads(shared.value), {}
        for piece, texts in pieces(batches):
            for at in range(0, len(texts), BATCH):
                some = texts[at : at + BATCH]
                keys = [blake2b(t or b"", digest_size=16).digest() for t in some]
                if len(known) > REMEMBERED:
                    known.clear()
                new = {k: t for k, t in zip(keys, some) if k not in known}  # copies share their neighbours
                known.update(zip(new, results(own, list(new.values()))))
                made = [known[k] for k in keys]
                columns = [pa.array(c, k) for c, k in zip(zip(*made), (pa.float64(), kind))]
                yield pa.RecordBatch.from_arrays([piece.column(0)[at : at + BATCH], *columns], ["doc_id", "score", "evidence"])

    schema = "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
