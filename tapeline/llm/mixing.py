"""Mixing sources to target weights with soft domain membership.

A softmax classifier learned from a labelled table gives every document a posterior over
the domains, in whole units of 1/UNITS. Nonnegative document rates are then fitted by projected
gradient least squares, so that the expected tokens of each domain (tokens times rate times
posterior, over all documents) meet their targets. Steps are scaled by a document's tokens, so
rates depend on the posterior only: documents are summed by posterior before the iterations,
each iteration is one aggregation of that smaller table, and the rate of every document follows
from the few numbers that the iterations sent back. All sums are exact (decimals), so the rates
don't depend on the order of tasks.

Bounds: the classifier learns from ``PER_DOMAIN`` labelled documents of each domain (those with
the smallest hash of the id) over ``HASHED`` features; posteriors have C(UNITS + K - 1, K - 1)
values for K domains.

Edge cases: null and empty texts have no tokens and the posterior of no features; rows without a
domain, or with one that has no target, teach nothing; without anything to learn from the
posterior is even; without tokens all rates are 1; a domain with a target that no document
belongs to keeps its shortfall; an id with several domains takes the smallest name; repeated
rows get the same rate; other columns are carried by ``resample`` and ignored elsewhere.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import bounded, broadcast_model, lower_words, neutral, pieces
from tapeline.session import cut_lineage

#: Units of a posterior, and decimals of a rate; a share of tokens far below the smallest target is still counted.
UNITS, DECIMALS = 10_000, 9
HASHED, PER_DOMAIN = 1 << 15, 2_000
#: A feature is used if some domain's share of documents with it is so many standard errors off the others'.
STANDARD_ERRORS, LEAST_DOCS = 4.0, 4
#: Shares of the token budget by domain of the labels table.
TARGETS = {"clean": 0.95, "low": 0.04, "toxic": 0.01}
ITERATIONS, TOLERANCE = 60, 1e-5
RIDGE = 1e-4


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic rows, other rows of low quality, clean rows."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")


def text_features(text: bytes | None) -> tuple[int, np.ndarray]:
    """Words between spaces (the tokens), and the different hashed features: words, and shares of symbols, capitals and repeats."""
    words = lower_words(text)
    if not text:
        return 0, np.zeros(0, np.int64)
    n = len(text.split())
    kinds = {b"symbols": b"#*$%&|<>!", b"capitals": bytes(range(0x41, 0x5B)), b"digits": b"0123456789"}
    shape = [k + b"%d" % min(20, 40 * (len(text) - len(text.translate(None, v))) // len(text)) for k, v in kinds.items()]
    different = set(words)
    shape.append(b"different%d" % (10 * len(different) // max(1, len(words))))
    h = zlib.crc32
    return n, np.unique(np.fromiter((h(w) % HASHED for w in [*different, *(b"\x00" + s for s in shape)]), np.int64))


@dataclass
class Classifier:
    """Weights of each feature and the constant by domain, and a temperature fitted on rows held back."""

    domains: list[str]
    constant: np.ndarray
    weights: np.ndarray  # HASHED x domains
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=0)

    def posterior(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.constant) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def units(self, logits: np.ndarray) -> np.ndarray:
        """Posteriors in whole units; the remainders go to the largest fractions, ties to the first domain."""
        p = UNITS * self.posterior(logits)
        whole = np.floor(p + 1e-9).astype(np.int64)
        whole[np.argsort(-(p - whole).round(9), kind="stable")[: UNITS - whole.sum()]] += 1
        return whole


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _train(lists: list[np.ndarray], y: np.ndarray, row_weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and constants of a ridged softmax regression on present features, by gradient steps of adapted size."""
    size = np.array([len(x) + 1 for x in lists])
    flat = np.concatenate([np.append(x, HASHED) for x in lists]).astype(np.int64)  # HASHED: the constant
    names, flat = np.unique(flat, return_inverse=True)
    starts, gold, w = np.cumsum(size) - size, np.eye(k)[y], row_weight / row_weight.sum()
    weights, seen = np.zeros((len(names), k)), np.full((len(names), k), 1e-12)
    for _ in range(400):
        step = (gold - _softmax(np.add.reduceat(weights[flat], starts, axis=0))) * w[:, None]
        spread = np.repeat(step, size, axis=0)
        grad = np.stack([np.bincount(flat, spread[:, j], len(names)) for j in range(k)], axis=1) - RIDGE * weights
        seen += grad * grad
        weights += 0.3 * grad / np.sqrt(seen)
    out = np.zeros((HASHED + 1, k))
    out[names] = weights.round(6)
    return out[:HASHED], out[HASHED]


def fit_classifier(docs: DataFrame, domains: DataFrame, names: list[str], per_domain: int = PER_DOMAIN) -> Classifier:
    """Feature counts are summed by Spark; every third sampled document is held back for the temperature."""
    spark = docs.sparkSession
    known = domains.where(F.col("domain").isin(names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    totals = {r["domain"]: r["n"] for r in bounded(known.groupBy("domain").agg(F.count("*").alias("n")), len(names))}
    picked = None
    for name in names:
        p = known.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        picked = p if picked is None else picked.unionByName(p)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    number = {name: i for i, name in enumerate(names)}

    def run(batches):
        for piece, texts in pieces(batches):
            own = [number[d] for d in piece.column(piece.schema.names.index("domain")).to_pylist()]
            feats = [text_features(t)[1] for t in texts]
            back = [zlib.crc32(t or b"") % 3 == 0 for t in texts]
            made = [pa.array(own, pa.int32()), pa.array(back), pa.array([f.tolist() for f in feats], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([piece.column(0), *made], ["doc_id", "domain", "back", "features"])

    rows = texts.mapInArrow(run, "doc_id long, domain int, back boolean, features array<int>")
    rows = cut_lineage(spark, rows.groupBy("doc_id").agg(F.min(F.struct("domain", "back", "features")).alias("r")).select("r.*"))
    k = len(names)
    docs_of = np.zeros(k)
    for r in bounded(rows.where("NOT back").groupBy("domain").agg(F.count("*").alias("n")), k):
        docs_of[r["domain"]] = r["n"]
    seen = np.zeros((HASHED, k))
    for r in bounded(rows.where("NOT back").select("domain", F.explode("features").alias("f")).groupBy("f", "domain").agg(F.count("*").alias("n")), HASHED * k):
        seen[r["f"], r["domain"]] = r["n"]
    if not docs_of.sum():
        return Classifier(names, np.zeros(k), np.zeros((HASHED, k)))
    others, n_others = seen.sum(axis=1, keepdims=True) - seen, docs_of.sum() - docs_of
    pooled = seen.sum(axis=1, keepdims=True) / docs_of.sum()
    error = np.sqrt(pooled * (1 - pooled) * (1 / np.maximum(1, docs_of) + 1 / np.maximum(1, n_others)))
    apart = np.abs(seen / np.maximum(1, docs_of) - others / np.maximum(1, n_others))
    used = ((apart > STANDARD_ERRORS * np.maximum(error, 1e-12)) & (seen >= LEAST_DOCS)).any(axis=1)

    shared = broadcast_model(spark, used)

    def chosen(batches):
        keep = pickle.loads(shared.value)
        for batch in batches:
            lists = [[f for f in x if keep[f]] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["domain", "back", "features"])

    found = sorted((r["back"], r["domain"], r["features"]) for r in bounded(rows.mapInArrow(chosen, rows.schema), per_domain * k))
    back, y = np.array([r[0] for r in found]), np.array([r[1] for r in found])
    lists = [np.array(r[2], dtype=np.int64) for r in found]
    row_weight = np.array([totals[n] if n in totals else 0 for n in names])[y] / np.bincount(y, minlength=k)[y]
    weights, constant = _train([x for x, h in zip(lists, back) if not h], y[~back], row_weight[~back], k)
    model = Classifier(names, constant, weights)
    if back.any():
        z = np.array([model.logits(x) for x, h in zip(lists, back) if h]) + constant
        own, w = y[back], row_weight[back]

        def loss(t: float) -> float:
            return float(-(w * np.log(np.maximum(_softmax(z / t)[np.arange(len(own)), own], 1e-12))).sum())

        model.temperature = min((2.0**e for e in np.arange(-2, 4.25, 0.25)), key=loss)
    return model


def posteriors(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_tokens and p (posterior in units, in the order of the domains) of every whole text."""
    shared = broadcast_model(docs.sparkSession, model)
    kinds = dict(docs.dtypes)

    def run(batches):
        m = pickle.loads(shared.value)
        for piece, texts in pieces(batches):
            made = [text_features(t) for t in texts]
            p = [m.units(m.logits(f)).tolist() for _, f in made]
            same = [piece.column(piece.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*same, pa.array([n for n, _ in made], pa.int64()), pa.array(p, pa.list_(pa.int32()))], [*keep, "n_tokens", "p"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long, p array<int>"]))


def rate_of(p: str, steps: list[list[float]]) -> Column:
    """The rate that the gradient steps give to a posterior: start at 1, add posterior times step, never below 0."""
    if not steps:
        return F.lit(1.0)
    folded = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    along = lambda s: sum((F.col(p)[i] * s[i] for i in range(1, len(steps[0]))), F.col(p)[0] * s[0]) / UNITS
    return F.aggregate(folded, F.lit(1.0), lambda x, s: F.greatest(F.lit(0.0), x + along(s)))


@dataclass
class Rates:
    steps: list[list[float]]
    targets: np.ndarray
    reached: np.ndarray


def fit_rates(members: DataFrame, targets: np.ndarray) -> Rates:
    """Projected gradient for the rates of ``members`` (n_tokens, p), targets in tokens.

    The squared errors are weighed by the inverse of the token-weighted second moments of the
    posteriors whose rate isn't at its bound, so overlapping domains don't slow the descent; a
    step that doesn't bring the targets nearer is halved. The fit stops when every domain is
    within TOLERANCE of its target, or no step helps.
    """
    spark, k = members.sparkSession, len(targets)
    sums = members.groupBy("p").agg(F.sum("n_tokens").alias("t")).where("t > 0")
    sums = cut_lineage(spark, sums)
    rows = sums.count()
    sums = sums.coalesce(max(1, rows // 50_000))

    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def state(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by domain, and the second moments of the posteriors with a rate over 0."""
        p, t = F.col("p"), F.col("t").cast("decimal(16,0)")
        free = F.when(F.col("x") > 0, t).otherwise(0)
        rate = rate_of("p", steps).cast(f"decimal(20,{DECIMALS})")
        row = sums.withColumn("x", rate).agg(
            *[F.sum(t * p[i].cast("decimal(5,0)") * F.col("x")).alias(f"d{i}") for i in range(k)],
            *[F.sum(free * (p[i] * p[j]).cast("decimal(9,0)")).alias(f"m{i}_{j}") for i, j in pairs]).first()
        values = [float(v or 0) for v in row]
        moments = np.zeros((k, k))
        for (i, j), v in zip(pairs, values[k:]):
            moments[i, j] = moments[j, i] = v / UNITS**2
        return np.array(values[:k]) / UNITS, moments

    def error(at: np.ndarray) -> float:
        return float((((targets - at) / np.maximum(targets, 1)) ** 2).sum())

    steps: list[list[float]] = []
    at, moments = state(steps)
    for _ in range(ITERATIONS if at.sum() else 0):
        if (np.abs(targets - at) <= TOLERANCE * np.maximum(targets, 1)).all():
            break
        step = np.linalg.pinv(moments, rcond=1e-9, hermitian=True) @ (targets - at)
        for _ in range(8):
            tried = [*steps, [float(v) for v in step.round(9)]]
            new, new_moments = state(tried)
            if error(new) < error(at):
                break
            step = step / 2
        else:
            break
        steps, at, moments = tried, new, new_moments
    return Rates(steps, targets, at)


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, Rates]:
    """Documents (columns ``keep``) with n_tokens, p and rate, and the fit. Targets are shares of all tokens."""
    targets = TARGETS if targets is None else targets
    names = sorted(targets)
    members = cut_lineage(docs.sparkSession, posteriors(docs, fit_classifier(docs, domains, names), list(keep)))
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    rates = fit_rates(members, np.array([targets[n] for n in names]) / sum(targets.values()) * total)
    return members.withColumn("rate", F.round(rate_of("p", rates.steps), DECIMALS)), rates


def copies(rate: Column, *keys: str) -> Column:
    """Copies of a document that make its rate in expectation: the whole part, and one more if a hash of the keys says so."""
    part = F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("long")).cast("int")


def resample(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents, each as often as its rate says; same columns."""
    named, restored = neutral(docs, "doc_id", "text")
    d, _ = mix(named, domains, targets, tuple(named.columns))
    many = d.withColumn("_copies", copies(F.col("rate"), "doc_id", "text")).where("_copies > 0")
    return many.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*restored)


def digest(d: DataFrame, names: list[str]) -> DataFrame:
    return d.select("doc_id", "n_tokens", *[F.col("p")[i].cast("long").alias(f"units_{n}") for i, n in enumerate(names)], "rate")
