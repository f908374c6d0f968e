"""Secrets in texts, by fixed formats and by sliding-window entropy, in native expressions only.

Formats: an assignment to a name that says it is a secret, an access key, a long hexadecimal run.
Entropy: a candidate is a run of token characters with letters and digits. The smallest character
class that holds the run (hexadecimal digits, letters of one case with digits, letters of both
cases) gives its alphabet, window and least entropy. A window slides over the run; a character
that enters or leaves changes one count each and the entropy by the difference of two table
values, in whole numbers, so every engine decides alike. The span goes from the first to the last
window that is random enough. An allow-list suppresses candidates of known harmless forms and
digests that the text before them names.

Places are code points: the pieces between matches and the matches themselves add up to the text,
so running sums of both lengths give the starts. Everything happens inside a row; nothing is
shuffled. Long runs are folded in segments that overlap by a window, and running sums are taken in
blocks, so work grows with the text.

Edge cases: a null text is an empty one; without spans there are counts of zero and the digest of
an empty list; spans of the formats and of the entropy may overlap and both stay; rows with a
null id and repeated rows are scanned like any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats in the order of their names in a tie, as pattern, group that is measured and its least length.
#: A match that is too short still uses up its characters, so the first pattern has no length of its own.
FORMATS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
#: A window needs as many digits; words with a number attached rarely have them.
LEAST_DIGITS = 2
#: Characters of a run that one fold goes over, besides the window before them.
SEGMENT = 2_048
#: Values per block of the running sums.
BLOCK = 256
#: Entropies are whole numbers of this fraction of a bit.
SCALE = 1 << 16

#: Harmless candidates, by what they contain (lower case) ...
ALLOWED = r"example|sample|dummy|placeholder|changeme|redacted|test_?key|your_?(api|key|token|secret)|xxxx|0123456789|1234567890|abcdefghij|deadbeef"
#: ... by their whole form: identifiers in groups, dates, words joined by marks with a number at the end ...
ALLOWED_FORMS = r"^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}[t_-]?[0-9-]*|([a-z]+[/_-])+[0-9]+)$"
#: ... and digests that the text before them names.
ALLOWED_BEFORE = r"(md5|sha-?1|sha-?224|sha-?256|sha-?384|sha-?512|digest|checksum|commit)[\"']?[ :=(-]*[\"']?$"
BEFORE_CHARS = 24


@dataclass(frozen=True)
class CharacterClass:
    name: str
    form: str
    alphabet: str
    window: int
    bits: float

    @property
    def gains(self) -> list[int]:
        """n * log2(n) for the counts a window can have, scaled."""
        return [0] + [round(SCALE * n * math.log2(n)) for n in range(1, self.window + 1)]

    @property
    def most(self) -> int:
        """The sum of the counts' gains is log2(window) - entropy times the window: random windows have at most so much."""
        return math.floor(SCALE * self.window * (math.log2(self.window) - self.bits))


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: From the smallest class on. Random characters have 3.2, 3.7 and 4.1 bits in such windows.
CLASSES = (
    CharacterClass("entropy_hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdefABCDEF", 16, 2.8),
    CharacterClass("entropy_alnum", "^([0-9a-z/_+-]+|[0-9A-Z/_+-]+)$", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", 16, 3.35),
    CharacterClass("entropy_base64", "^.*$", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", 20, 3.75),
)
KINDS = [*FORMATS, *[c.name for c in CLASSES]]
SPAN = "array<struct<start:bigint,kind_order:int,end:bigint,kind:string,value:string>>"


def running(values: Column) -> Column:
    """Sums of the values before each one, in blocks: a fold that appends copies what it has."""
    def sums(a):
        return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc + v))
    inside = F.transform(F.arrays_zip(blocks.alias("block"), F.slice(sums(totals), F.lit(1), F.size(totals)).alias("before")),
                         lambda z: F.transform(F.slice(sums(z["block"]), F.lit(1), F.size(z["block"])), lambda v: v + z["before"]))
    return F.when(F.size(values) > 0, F.flatten(inside)).otherwise(F.array().cast("array<bigint>"))


def located(hits: str, gaps: str) -> Column:
    """Matches with their starts and the texts before them."""
    pairs = F.arrays_zip(F.slice(F.col(gaps), F.lit(1), F.size(hits)).alias("gap"), F.col(hits).alias("hit"))
    starts = running(F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("long")))
    return F.transform(F.arrays_zip(pairs.alias("p"), starts.alias("before")), lambda z: F.struct(
        (z["before"] + F.length(z["p"]["gap"])).alias("start"), z["p"]["gap"].alias("gap"), z["p"]["hit"].alias("hit")))


def windows(run: Column, c: CharacterClass) -> Column:
    """(first, last) places of the random windows in a run: start of the first and end of the last one; nulls without any.

    The fold's state holds the counts of the window's characters and the sum of their gains.
    """
    w, gains = c.window, F.array(*[F.lit(g).cast("long") for g in c.gains])
    codes = F.transform(F.split(run, ""), lambda ch: (F.instr(F.lit(c.alphabet), ch) - 1).cast("int"))
    none = F.lit(None).cast("int")
    empty = F.struct(F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).cast("long").alias("gain"), F.lit(0).alias("digits"), none.alias("first"), none.alias("last"))

    def step(state, z, i):
        entering, leaving = z["code"], z["gone"]
        had, has = F.get(state["counts"], leaving), F.get(state["counts"], entering)
        same = F.coalesce(entering == leaving, F.lit(False))
        lost = F.when(same | leaving.isNull(), F.lit(0)).otherwise(F.get(gains, had) - F.get(gains, had - 1))
        won = F.when(same, F.lit(0)).otherwise(F.get(gains, has + 1) - F.get(gains, has))
        gain = state["gain"] + won - lost
        digits = state["digits"] + (entering < 10).cast("int") - F.coalesce((leaving < 10).cast("int"), F.lit(0))
        counts = F.transform(state["counts"], lambda n, k: n + (k == entering).cast("int") - F.coalesce((k == leaving).cast("int"), F.lit(0)))
        random = (i >= w - 1) & (gain <= c.most) & (digits >= LEAST_DIGITS)
        return F.struct(counts.alias("counts"), gain.alias("gain"), digits.alias("digits"),
                        F.coalesce(state["first"], F.when(random, i - w + 1)).alias("first"), F.when(random, i + 1).otherwise(state["last"]).alias("last"))

    # each character with the one that leaves the window when it enters
    gone = F.concat(F.array_repeat(none, w), codes)
    entries = F.transform(F.arrays_zip(codes.alias("code"), F.slice(gone, F.lit(1), F.size(codes)).alias("gone")), lambda z, i: F.struct(z["code"].alias("code"), z["gone"].alias("gone"), i.alias("i")))
    return F.aggregate(entries, empty, lambda state, z: step(state, z, z["i"]), lambda state: F.struct(state["first"].alias("first"), state["last"].alias("last")))


def random_span(candidate: Column, order: int, c: CharacterClass) -> Column:
    """The span of a candidate's random windows; null without any."""
    run, overlap = candidate["hit"], c.window - 1
    segments = F.transform(F.sequence(F.lit(0), F.floor((F.length(run) - 1) / SEGMENT).cast("int")), lambda s: s * SEGMENT)
    found = F.transform(segments, lambda at: F.struct(at.alias("at"), windows(F.substring(run, at + 1, F.lit(SEGMENT + overlap)), c).alias("w")))
    first = F.array_min(F.transform(found, lambda f: f["at"] + f["w"]["first"]))
    last = F.array_max(F.transform(found, lambda f: f["at"] + f["w"]["last"]))
    return F.when(first.isNotNull(), F.struct(
        (candidate["start"] + first).cast("long").alias("start"), F.lit(order).alias("kind_order"), (candidate["start"] + last).cast("long").alias("end"),
        F.lit(c.name).alias("kind"), F.substring(run, first + 1, last - first).alias("value")))


def format_spans(d: DataFrame, kind: str) -> DataFrame:
    """Adds the spans of one format as column ``kind``."""
    pattern, group, least = FORMATS[kind]
    order = KINDS.index(kind)
    d = d.withColumn("_hits", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size("_hits") > 0
    d = d.withColumn("_gaps", F.when(some, F.split("text", pattern, -1)))
    measured = F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))) if group else F.col("_hits")
    d = d.withColumn("_measured", measured)
    spans = F.transform(F.arrays_zip(located("_hits", "_gaps").alias("m"), F.col("_measured").alias("value")), lambda z: F.struct(
        z["m"]["start"].alias("start"), F.lit(order).alias("kind_order"), (z["m"]["start"] + F.length(z["m"]["hit"])).alias("end"), F.lit(kind).alias("kind"), z["value"].alias("value")))
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return d.withColumn(kind, F.when(some, kept).otherwise(F.array()).cast(SPAN)).drop("_hits", "_gaps", "_measured")


def entropy_spans(d: DataFrame) -> DataFrame:
    """Adds the spans of random windows as column ``entropy``."""
    d = d.withColumn("_hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    some = F.exists("_hits", lambda h: h.rlike("[0-9][^0-9]*[0-9]") & h.rlike("[A-Za-z]"))
    d = d.withColumn("_gaps", F.when(some, F.split("text", CANDIDATE, -1)))
    lower = lambda c: F.lower(c["hit"])
    candidates = F.filter(located("_hits", "_gaps"), lambda c: (
        c["hit"].rlike("[0-9][^0-9]*[0-9]") & c["hit"].rlike("[A-Za-z]") & ~lower(c).rlike(ALLOWED) & ~lower(c).rlike(ALLOWED_FORMS)
        & ~F.lower(F.substring(c["gap"], -BEFORE_CHARS, BEFORE_CHARS)).rlike(ALLOWED_BEFORE)))
    d = d.withColumn("_candidates", F.when(some, candidates))

    def span(c):
        best = None
        for k in reversed(range(len(CLASSES))):
            own = random_span(c, len(FORMATS) + k, CLASSES[k])
            best = own if best is None else F.when(c["hit"].rlike(CLASSES[k].form), own).otherwise(best)
        return best

    found = F.filter(F.transform("_candidates", span), lambda s: s.isNotNull())
    return d.withColumn("entropy", F.coalesce(F.when(F.size("_candidates") > 0, found), F.array()).cast(SPAN)).drop("_hits", "_gaps", "_candidates")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans of each format (``assign``, ``access``, ``hex``) and of the entropy, and ``spans``: all of them by start and kind.

    A span has start, end (code points, exclusive), kind and value (of an assignment: what is assigned).
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in FORMATS:
        d = format_spans(d, kind)
    d = entropy_spans(d)
    return d.select("doc_id", *FORMATS, "entropy", F.array_sort(F.concat(*FORMATS)).alias("base"), F.array_sort(F.concat(*FORMATS, "entropy")).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in FORMATS], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"),
                        F.size("entropy").cast("long").alias("n_entropy"))
