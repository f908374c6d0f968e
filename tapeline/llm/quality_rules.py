"""Quality rules as a learned decision list.

Text statistics of labelled documents go through sequential covering: a rule is grown from
threshold conditions by information gain, pruned on rows it hasn't seen, kept if it is precise
there, and the rows it covers are taken away. The list comes out as one ordered Spark
conditional expression over the statistics columns (``verdict``), and as text.

Edge cases: null texts have no words and fail the base rules; rows without a label, and labels
without a document, teach nothing; without usable labels the list is empty and every document
that passes the base rules is kept; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import bounded, map_texts

#: Labelled documents that the list is learned from: those with the smallest hash of the id.
SAMPLE = 20_000
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share"]
#: A rule must be this precise on rows held back for pruning, and cover so many of them.
PRECISION, COVER = 0.97, 5
MAX_CONDITIONS, MAX_RULES, CUTS = 3, 12, 48

_UPPER, _DIGIT, _MARK = bytes(range(0x41, 0x5B)), b"0123456789", b"!\"'()+,-./:;=?@[\\]^_`{}~"
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_marks long, n_distinct long"


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of ``width`` words that the list has twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == len(words):
        return 0
    size, key = len(number), ids[:n].copy()
    for i in range(1, width):
        if len(number) ** width < 1 << 62:
            key = key * size + ids[i : i + n]
        else:  # name the longer window by its rank, so that names stay small
            key = np.unique(key, return_inverse=True)[1] * size + ids[i : i + n]
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.nonzero(count[name] > 1)[0]
    hit = np.zeros(len(words) + 1, np.int64)
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + width, -1)
    return int((np.cumsum(hit) > 0).sum())


def _stats(text: bytes | None) -> tuple:
    if not text:
        return (0,) * 10
    words = text.split()  # of bytes: the six ASCII spaces
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    less = lambda kinds: len(text) - len(text.translate(None, kinds))
    return (len(words), chars, less(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words), len(lines), less(_UPPER), less(_DIGIT), less(_MARK), len(set(words)))


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of every whole text: the base statistics, then lines with a word, letters A-Z, digits, marks and different words."""

    def run(piece: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        cols = np.array([_stats(t) for t in texts], dtype=np.int64).reshape(len(texts), 10).T
        return pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, cols)], [c.split()[0] for c in STATS.split(", ")])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), STATS, run)


def with_features(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return stats.select(
        "*", share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_digits", "word_chars").alias("digit_share"),
        share("n_marks", "word_chars").alias("mark_share"), share("n_distinct", "n_words").alias("distinct_share"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.cut if self.above else v <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition of the largest information gain until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for j, name in enumerate(FEATURES):
            values = np.unique(x[inside, j])
            cuts = np.unique(np.round(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1]), 6))
            own, is_bad = x[inside, j], bad[inside]
            for above in (True, False):
                hold = own[None, :] > cuts[:, None] if above else own[None, :] <= cuts[:, None]
                p, n = (hold & is_bad).sum(axis=1), (hold & ~is_bad).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = Condition(name, above, float(cuts[i])), g[i]
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that is best on rows held back."""

    def worth(r: Rule) -> tuple:
        c = _covers(r, x)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return ((p - n) / max(1, p + n), -len(r))

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=worth, default=())


def learn(x: np.ndarray, bad: np.ndarray, held_back: np.ndarray) -> list[Rule]:
    """Rules for bad rows in order; a rule that isn't precise on the rows held back ends the list."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and (left & bad & ~held_back).any():
        grow, back = left & ~held_back, left & held_back
        rule = _prune(_grow(x[grow], bad[grow]), x[back], bad[back])
        inside = _covers(rule, x) & left
        p, n = (inside & bad & held_back).sum(), (inside & ~bad & held_back).sum()
        if not rule or p < COVER or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Features and label of the sampled documents; the sample's ids (``sample`` at most) are broadcast."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    named = named.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(named), "doc_id")
    stats = statistics(texts).join(F.broadcast(named), "doc_id")
    passed = with_features(stats).where(~F.col("base_failed"))
    return passed.groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("r")).select("doc_id", "r.*")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The list learned from at most ``sample`` labelled documents that pass the base rules."""
    rows = sorted((r["doc_id"], r["quality"], *(r[f] for f in FEATURES)) for r in bounded(labelled_sample(docs, labels, sample), sample))
    if not rows:
        return []
    table = np.array(rows, dtype=float)
    return learn(table[:, 2:], table[:, 1] == 0, np.arange(len(rows)) % 3 == 0)


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression: the number of the first rule that fires, null if none does."""
    out = None
    for i, rule in enumerate(rules):
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(i + 1)) if out is None else out.when(both, F.lit(i + 1))
    return F.lit(None).cast("int") if out is None else out


def describe(rules: list[Rule]) -> list[str]:
    return [f"{i + 1}: drop if " + " and ".join(map(str, r)) for i, r in enumerate(rules)]


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Base statistics, base_failed, kept and the rule that fired for every document."""
    rules = fit(docs, labels, sample)
    d = with_features(statistics(docs)).withColumn("rule", verdict(rules))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
