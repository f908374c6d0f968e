"""SimHash near-duplicates by tiled exact comparison.

Different fingerprints are grouped into tiles by the population counts of their segments. The
counts of two fingerprints differ, summed over the segments, by no more than their bits do, so a
pair of tiles whose counts differ by more than the radius is skipped without a look inside. The
other tile pairs are compared exactly, block against block, with numpy exclusive-or and bit
counts. A block comparison returns only a spanning forest of the links it found; the
components of all forests are those of all links.

Edge cases: null and empty texts have the fingerprint zero and link like any other; repeated
rows and equal texts have equal fingerprints; a null id is never a component's name (a
component of null ids has the name null); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import map_texts, neutral
from tapeline.session import cut_lineage

RADIUS = 2
SHINGLE = 3
#: Segments whose population counts name a tile.
SEGMENTS = 4
#: Fingerprints of a tile that are compared at once; larger tiles are several blocks.
BLOCK = 4096
NO_ID = -(1 << 63)

def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of word shingles, repeats included."""
    import xxhash

    if not text:
        return 0
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n < width:
        hashes = [h(b" ".join(words), 42)]
    elif width == 3:
        hashes = [h(b"%b %b %b" % w, 42) for w in zip(words, words[1:], words[2:])]
    else:
        hashes = [h(b" ".join(words[i : i + width]), 42) for i in range(n - width + 1)]
    m, ones = len(hashes), np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for i in range(0, m, 1 << 16):
        part = values[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the fingerprint as a long (the 64 bits)."""
    kinds = dict(docs.dtypes)

    def run(piece: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], pa.array(fp)], [*keep, "fp"])

    return map_texts(docs.select(*keep, "text"), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "fp long"]), run)


def _near_tiles(segments: int, radius: int) -> np.ndarray:
    """Differences of population counts, by segment, that sum to the radius at most: one of each pair d, -d, and zero."""
    found = {(0,) * segments}
    for _ in range(radius):
        found |= {d[:i] + (d[i] + s,) + d[i + 1 :] for d in found for i in range(segments) for s in (-1, 1)}
    return np.array(sorted(d for d in found if d >= (0,) * segments), dtype=np.int64)


def _stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as (fingerprint, smallest fingerprint it reaches), one for each fingerprint that isn't the smallest."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = at[: len(left)], at[len(left) :]
    root = np.arange(len(nodes))
    while True:  # each pass hangs the larger root below the smaller one, then shortens the paths
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[child], nodes[root[child]]


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links between two lists of fingerprints; never more than a few million pairs are held."""
    left, right = a[:0], a[:0]
    step = max(1, 2_000_000 // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        x, y = a[i + x], b[y]
        left, right = np.concatenate([left, x[x != y]]), np.concatenate([right, y[x != y]])
        if len(left) > 1_000_000:
            left, right = _stars(left, right)
    return _stars(left, right)


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """A spanning forest (a, b) of the pairs of different fingerprints (column ``fp``) within the radius.

    A fingerprint stays at home in its tile and visits the tiles whose counts are near and
    larger, so each near pair of tiles meets once. A tile of many fingerprints is dealt into
    blocks by a hash, and block meets block.
    """
    width = 64 // segments
    fps = fps.select("fp").distinct()
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))) for i in range(segments)]
    tile = F.lit(0).cast("long")
    for c in counts:
        tile = tile * 128 + c + 32  # room for visits beyond either end
    own = cut_lineage(fps.sparkSession, fps.select("fp", tile.alias("tile")))
    blocks = own.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))

    shifts = []
    for d in _near_tiles(segments, radius):
        s = 0
        for x in d:
            s = s * 128 + int(x)
        shifts.append(s)
    home = own.join(blocks, "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    guests = home.select("fp", "part", F.col("blocks").alias("own_blocks"), "tile", F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
    guests = guests.withColumn("tile", F.col("tile") + F.col("shift")).join(blocks, "tile")
    # part i of every visiting tile meets block j at home; inside a tile only i <= j
    parts = guests.groupBy("tile").agg(F.max("own_blocks").alias("parts"))
    guests = guests.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where((F.col("shift") != 0) | (F.col("part") <= F.col("at")))
    hosts = home.select("tile", F.col("part").alias("at"), "fp").join(parts, "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = guests.select("tile", "part", "at", "fp", F.lit(1).alias("side")).unionByName(hosts.select("tile", "part", "at", "fp", F.lit(0).alias("side")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        fp = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)
        a, b = _forest(fp[side == 1], fp[side == 0], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return both.groupBy("tile", "part", "at").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an undirected edge list (a, b) reaches.

    Stars in turn: every node tells its larger neighbours of its smallest neighbour, then its
    smaller neighbours; the number of rounds is logarithmic in practice. The edge list is
    checkpointed in each round and never larger than the first one, up to direction.
    """
    spark = edges.sparkSession
    small, large = F.least("a", "b"), F.greatest("a", "b")
    now = cut_lineage(spark, edges.where("a <> b").select(large.alias("u"), small.alias("v")).distinct())
    mark = None
    while True:
        # large star: larger neighbours (and the node) move to the smallest neighbour of the node
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        near = star.join(least, "u")
        new = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut_lineage(spark, new)
        seen = new.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        now = new
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _components_of(own: DataFrame, radius: int) -> DataFrame:
    """fp and component_id (the smallest id among all rows of the component) of every fingerprint."""
    first = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(first.select("fp"), radius))
    rooted = first.join(roots, first.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every document."""
    spark = docs.sparkSession
    own = cut_lineage(spark, fingerprints(docs))
    named = _components_of(own, radius).drop("root")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, the one that comes first by id and text hash; same columns.

    Winners are found on narrow rows. The documents are joined to them by id and text hash;
    rows equal in both are numbered in the same place, and one stays.
    """
    spark = docs.sparkSession
    d, restored = neutral(docs, "doc_id", "text")
    d = d.withColumn("text_key", F.xxhash64("text"))
    own = cut_lineage(spark, fingerprints(d, ("doc_id", "text_key")))
    first = own.groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    roots = _components_of(own, radius).select("fp", "root")
    winners = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("w")).select(
        F.coalesce(F.col("w.doc_id"), F.lit(NO_ID)).alias("id"), F.col("w.text_key").alias("text_key"))
    same = Window.partitionBy("id", "text_key").orderBy(F.lit(0))
    kept = d.withColumn("id", F.coalesce(F.col("doc_id"), F.lit(NO_ID))).join(winners, ["id", "text_key"], "left_semi")
    return kept.withColumn("n", F.row_number().over(same)).where("n = 1").select(*restored)
