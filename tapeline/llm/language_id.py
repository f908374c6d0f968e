"""Language of words and documents by a linear-chain conditional random field.

Every word of a text is a position of the chain and its language the label; runs without blanks
are cut where the script changes and at wide punctuation, and what is longer than ``LONG`` bytes
then into several positions that together hold all of it. Emissions are
learned weights of hashed affix and character n-gram features and of per-language lexicons,
transitions are learned from code-switched sequences; forward-backward gives each word's
posterior. A document's language is the one with the largest mean posterior.

Every language is learned. The training sample is bounded: ``PER_LANGUAGE`` documents of each
language, fewer where there are many languages, ``SAMPLE_WORDS`` words of each, from a place in the
whole text that a hash picks. More than ``MAX_LANGUAGES`` distinct values are an error.

Forward-backward keeps the steps of one stretch of a chain, so a text of any length takes a few
numbers a word.

Edge cases: a text that is null or has no letter is ``und`` with score 0; ties go to the
language that sorts first; rows with a null id are predicted like any other; repeated rows get
the same result; with nothing to learn from every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import bounded, broadcast_model, fold, neutral, pieces

#: Documents learned from: of each language at most PER_LANGUAGE, of all together about SAMPLE_DOCS, of a language at least LEAST_DOCS.
PER_LANGUAGE, SAMPLE_DOCS, LEAST_DOCS, SAMPLE_WORDS = 250, 16_000, 16, 400
#: The model's weights grow with the languages, to 140 MB at so many; a table with more distinct values has no language column.
MAX_LANGUAGES = 1_000
FOLDS, HELD_OUT = 4, 2
HASHED, LEXICON = 1 << 15, 200
#: Training: sequences of SPAN words cut from segments of 4 to 30 words of one document each.
SPAN, SEQUENCES, BATCH, EPOCHS, RATE = 64, 800, 40, 3, 0.5
#: Steps of a chain that are held at once.
STRETCH = 8_192

#: Bytes of words after lower-casing: ASCII letters and all bytes of non-ASCII characters.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


#: Longer words are cut into pieces of PIECE bytes; a piece begins with the last OVERLAP bytes before it, so no n-gram is lost.
LONG, PIECE, OVERLAP = 40, 24, 2
#: Stands at the end of a piece where its word goes on.
GOES_ON = b"\x01"
_WIDE = re.compile(rb"[\xe0-\xff]|[^ ]{%d}" % (LONG + 1))
#: Punctuation beyond ASCII, and letters of scripts; characters of no listed script stay together.
_MARKS = "\u2000-\u206f\u3000-\u3003\u3008-\u3020\u3030\u303d\ufe30-\ufe4f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_SCRIPTS = [
    "a-z\u00c0-\u024f\u0300-\u036f\u1e00-\u1eff", "\u0370-\u03ff\u1f00-\u1fff", "\u0400-\u052f", "\u0530-\u058f", "\u0590-\u05ff", "\u0600-\u06ff\u0750-\u077f",
    *(f"{chr(b)}-{chr(b + 0x7F)}" for b in range(0x0900, 0x1000, 0x80)), "\u1000-\u109f", "\u10a0-\u10ff", "\u1200-\u137f", "\u1780-\u17ff",
    "\u3040-\u30ff\u31f0-\u31ff\uff66-\uff9f", "\u1100-\u11ff\u3130-\u318f\uac00-\ud7af", "\u3005-\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"]
_SEGMENTS = re.compile("|".join([*(f"[{x}]+" for x in _SCRIPTS), f"[^{_MARKS}{''.join(_SCRIPTS)}]+"]))


def words_of(text: str) -> list[bytes]:
    run = text.lower().encode().translate(_LETTERS)
    words = run.split()
    return [p for w in words for p in (_cut(w) if _WIDE.search(w) else (w,))] if _WIDE.search(run) else words


def blank_parts(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut after blanks, which no word goes over."""
    start, size = 0, PART if size is None else size
    while len(text) - start > size and (cut := text.find(" ", start + size)) >= 0:
        yield text[start : cut + 1]
        start = cut + 1
    yield text[start:]


def _cut(run: bytes) -> list[bytes]:
    """The positions of a run: its segments of one script, the long ones in pieces."""
    out = []
    for segment in _SEGMENTS.findall(run.decode()):
        w = segment.encode()
        if len(w) <= LONG:
            out.append(w)
            continue
        for i in range(0, len(w), PIECE):
            head = GOES_ON + w[i - OVERLAP : i] if i else b""
            out.append(head + w[i : i + PIECE] + (GOES_ON if i + PIECE < len(w) else b""))
    return out


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself, its prefixes and suffixes, its n-grams of two and three bytes; a piece has the affixes of its word's real ends only."""
    h = zlib.crc32
    head, tail = not word.startswith(GOES_ON), not word.endswith(GOES_ON)
    w = b"^" * head + word.strip(GOES_ON) + b"$" * tail
    out = [h(b"w" + w)]
    out += [h(w[:i], 1) for i in range(2, min(5, len(w)))] if head else []
    out += [h(w[-i:], 2) for i in range(2, min(6, len(w)))] if tail else []
    out += [h(w[i : i + 2], 3) for i in range(head, len(w) - 1 - tail)]
    out += [h(w[i : i + 3], 4) for i in range(0, len(w) - 2)]
    return [x % HASHED for x in out]


class Chain:
    """Weights of the field: emissions by feature (hashed ones, then one lexicon flag for each language) and transitions."""

    def __init__(self, languages: list[str], lexicons: list[frozenset]):
        k = len(languages)
        self.languages, self.lexicons = languages, lexicons
        self.weights = np.zeros((HASHED + k, k), np.float32)
        self.moves, self.first = np.zeros((k, k)), np.zeros(k)

    def word_features(self, word: bytes) -> list[int]:
        return features(word) + [HASHED + i for i, x in enumerate(self.lexicons) if word in x]

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """A row of potentials, scaled to a largest value of 1, for each word; features of so many words are held at once."""
        out = []
        for i in range(0, len(words), 20_000):
            rows = [self.word_features(w) for w in words[i : i + 20_000]]
            starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
            flat = np.fromiter((f for r in rows for f in r), np.int64)
            e = np.add.reduceat(self.weights[flat], starts, axis=0)
            out.append(np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float64))
        return np.concatenate(out)

    def posteriors(self, potentials: np.ndarray, ids: np.ndarray, lengths: np.ndarray, per_word: bool = False):
        """Sum of the posteriors over the words of each sequence.

        ``ids`` numbers the words' rows of ``potentials``, sequence after sequence, of
        ``lengths`` (all positive, longest first). All sequences take each step together.
        """
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        longest, k = int(lengths[0]), len(self.languages)
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
        move = np.exp(self.moves - self.moves.max())
        first = np.exp(self.first - self.first.max())[None, :]

        def forward(a: np.ndarray | None, begin: int, end: int):
            for t in range(begin, end):
                n = active[t]
                a = (first if a is None else a[:n] @ move) * potentials[ids[starts[:n] + t]]
                a /= a.sum(axis=1, keepdims=True)
                yield a

        # only the last step before each stretch is kept; the steps of a stretch are taken again on the way back
        before: list[np.ndarray | None] = [None]
        for at in range(0, longest - STRETCH, STRETCH):
            for a in forward(before[-1], at, at + STRETCH):
                pass
            before.append(a)
        total, words = np.zeros((len(lengths), k)), np.zeros((len(ids) if per_word else 0, k))
        b = np.ones((0, k))
        for stretch in range(len(before) - 1, -1, -1):
            at = stretch * STRETCH
            alphas = list(forward(before[stretch], at, min(longest, at + STRETCH)))
            for t in range(at + len(alphas) - 1, at - 1, -1):
                n = active[t]
                if t + 1 < longest:
                    m = active[t + 1]
                    b = (b * potentials[ids[starts[:m] + t + 1]]) @ move.T
                    b /= b.sum(axis=1, keepdims=True)
                b = np.concatenate([b, np.ones((n - len(b), k))]) if len(b) < n else b
                g = alphas[t - at] * b
                g /= g.sum(axis=1, keepdims=True)
                total[:n] += g
                if per_word:
                    words[starts[:n] + t] = g
        return words if per_word else total


def _sequences(samples: list[tuple[int, list[bytes]]], rng: np.random.Generator) -> list[list[tuple[bytes, int]]]:
    """Code-switched sequences: segments of single documents put after each other, languages drawn evenly."""
    by_label: dict[int, list] = {}
    for label, words in samples:
        if words:
            by_label.setdefault(label, []).append(words)
    labels = sorted(by_label)
    out = []
    for _ in range(SEQUENCES):
        seq: list[tuple[bytes, int]] = []
        while len(seq) < SPAN:
            label = labels[rng.integers(len(labels))]
            words = by_label[label][rng.integers(len(by_label[label]))]
            n = int(rng.integers(4, 31))
            at = int(rng.integers(max(1, len(words) - n + 1)))
            seq += [(w, label) for w in words[at : at + n]]
        out.append(seq[:SPAN])
    return out


def train(languages: list[str], samples: list[tuple[int, list[bytes]]], seed: int = 7) -> Chain:
    """Conditional likelihood by stochastic gradient ascent with per-weight step sizes."""
    counts = [Counter() for _ in languages]
    for label, words in samples:
        counts[label].update(words)
    lexicons = [frozenset(w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n > 1) for c in counts]
    chain, rng, k = Chain(languages, lexicons), np.random.default_rng(seed), len(languages)
    sequences = _sequences(samples, rng)
    seen, seen_moves = np.full_like(chain.weights, 1e-3), np.full((k, k), 1e-3)
    known: dict[bytes, list[int]] = {}
    for _ in range(EPOCHS):
        for at in range(0, len(sequences), BATCH):
            batch = sequences[at : at + BATCH]
            names = sorted({w for s in batch for w, _ in s})
            row = {w: i for i, w in enumerate(names)}
            feats = [known.setdefault(w, chain.word_features(w)) for w in names]
            flat = np.fromiter((f for r in feats for f in r), np.int64)
            size = np.array([len(r) for r in feats])
            e = np.add.reduceat(chain.weights[flat], np.cumsum(size) - size, axis=0)
            potentials = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float64)
            ids = np.array([[row[w] for w, _ in s] for s in batch])
            gold = np.array([[y for _, y in s] for s in batch])
            move = np.exp(chain.moves - chain.moves.max())
            p = potentials[ids]
            alpha, beta = np.empty_like(p), np.ones_like(p)
            alpha[:, 0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, SPAN):
                alpha[:, t] = (alpha[:, t - 1] @ move) * p[:, t]
                alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
            for t in range(SPAN - 2, -1, -1):
                beta[:, t] = (beta[:, t + 1] * p[:, t + 1]) @ move.T
                beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
            g = alpha * beta
            g /= g.sum(axis=2, keepdims=True)
            # expected moves, each step of each sequence normalized; their sum is one matrix product
            after = p[:, 1:] * beta[:, 1:]
            share = alpha[:, :-1] / ((alpha[:, :-1] @ move) * after).sum(axis=2, keepdims=True)
            pair = move * (share.reshape(-1, k).T @ after.reshape(-1, k))
            step = np.eye(k)[gold] - g
            by_word = np.zeros((len(names), k))
            np.add.at(by_word, ids.ravel(), step.reshape(-1, k))
            grad = np.zeros_like(chain.weights)
            np.add.at(grad, flat, np.repeat(by_word, size, axis=0).astype(np.float32))
            grad = grad / BATCH - 1e-5 * chain.weights
            seen += grad * grad
            chain.weights += (RATE * grad / np.sqrt(seen)).astype(np.float32) * 0.5
            moved = np.zeros((k, k))
            np.add.at(moved, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            moved = (moved - pair) / BATCH
            seen_moves += moved * moved
            chain.moves += RATE * moved / np.sqrt(seen_moves) * 0.5
    return chain


def training_sample(docs: DataFrame) -> DataFrame:
    """lang and words of the sampled documents; only ids and languages are ranked, the sample's ids are broadcast."""
    named = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    if (n := len(bounded(named.select("lang").distinct().limit(MAX_LANGUAGES + 1), MAX_LANGUAGES + 1))) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages or more where the field learns at most {MAX_LANGUAGES}; merge rare ones or set them to null")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    each = max(LEAST_DOCS, min(PER_LANGUAGE, SAMPLE_DOCS // max(1, n)))
    picked = named.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= each)
    picked = picked.select("doc_id", "lang").distinct()
    texts = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), ["doc_id", "lang"])

    def run(batches):
        for piece, texts in pieces(batches, "text"):
            words = [words_of(t.decode()) for t in texts]
            at = [zlib.crc32(t) % max(1, len(w) - SAMPLE_WORDS + 1) for t, w in zip(texts, words)]
            cut = [b" ".join(w[i : i + SAMPLE_WORDS]) for i, w in zip(at, words)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(cut, pa.binary())], ["doc_id", "lang", "words"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, "doc_id long, lang string, words binary")
    return rows.groupBy("doc_id", "lang").agg(F.min("words").alias("words"))


def fit(docs: DataFrame) -> Chain | None:
    """The field of the bounded sample; None if it is empty."""
    most = max(SAMPLE_DOCS, LEAST_DOCS * MAX_LANGUAGES)
    rows = sorted(((r["lang"], r["doc_id"], bytes(r["words"])) for r in bounded(training_sample(docs), most)))
    languages = sorted({lang for lang, _, words in rows if words})
    if not languages:
        return None
    return train(languages, [(languages.index(lang), words.split()) for lang, _, words in rows if words])


#: Texts handled together, in bytes: short documents take each step of the chain together.
TOGETHER = 4_000_000
#: Words whose potentials a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Characters of a text whose words are numbered at once, or up to the next blank.
PART = 1_000_000


def predict(docs: DataFrame, chain: Chain | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score of every whole text."""
    kinds = dict(docs.dtypes)
    shared = broadcast_model(docs.sparkSession, chain)

    def languages_of(chain: Chain, texts: list, rows: dict, table: list) -> tuple[list, list]:
        found, scores = ["und"] * len(texts), [0.0] * len(texts)
        if len(rows) > REMEMBERED:
            rows.clear()
            table.clear()
        lists, known = {}, len(rows)
        for i, t in enumerate(texts):
            s = t.decode() if t else ""
            if any(map(str.isalpha, s)):
                ids = [np.array([rows.setdefault(w, len(rows)) for w in words_of(part)], dtype=np.int32) for part in blank_parts(s)]
                if any(map(len, ids)):
                    lists[i] = np.concatenate(ids)
        if not lists:
            return found, scores
        if len(rows) > known:
            table.append(chain.emissions(list(islice(rows, known, None))))
        if len(table) > 1:
            table[:] = [np.concatenate(table)]
        order = sorted(lists, key=lambda i: -len(lists[i]))
        lengths = np.array([len(lists[i]) for i in order])
        mean = chain.posteriors(table[0], np.concatenate([lists[i] for i in order]), lengths) / lengths[:, None]
        for i, m in zip(order, mean):
            found[i], scores[i] = chain.languages[int(np.argmax(m))], float(min(1.0, m.max()))
        return found, scores

    def run(batches):
        chain, rows, table = pickle.loads(shared.value), {}, []
        for piece, texts in pieces(batches, "text", TOGETHER):
            found, scores = languages_of(chain, texts, rows, table) if chain else (["und"] * len(texts), [0.0] * len(texts))
            same = [piece.column(piece.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*same, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the documents that aren't held out."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float) -> DataFrame:
    """The documents that have a language with at least this score; same columns, no shuffle."""
    d, restored = neutral(docs, "text")
    found = predict(d, fit(docs), tuple(d.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select(*restored)
