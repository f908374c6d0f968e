"""Hilbert-curve sharding.

Metadata dimensions (language, source, size) are quantised to BITS bits each. A document's cell
is the index of its point on the Hilbert curve, and the curve order is cut into runs of equal
row counts. A shard then covers few boxes of the metadata space, and a reader skips files by
the ranges of the quantised dimensions (``manifest``).

Places come from counts, not from a global sort: cells (at most 2^(3*BITS), whatever the input)
are summed along the curve, a cell of many rows is dealt into buckets by a hash of the row, and
only the rows of one bucket are numbered together. A cell with a third of all rows is many
buckets, and so is one row that is repeated as often.

Edge cases: null languages and sources have a code of their own; null texts have the size 1 and
the crc32 of no bytes; null ids are ordered first; rows that agree in id, size and crc32 take
places of the same cell in any order; an empty table gives no rows; other columns are carried,
those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import neutral
from tapeline.llm.decontamination import stored
from tapeline.session import cut_lineage

BITS = 6
#: Rows numbered together, on average; more rows in a cell make more buckets.
BUCKET_ROWS = 2_000
OUTPUTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"]


def hilbert_numbers(points: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points (rows) below 2^bits, neighbours on the curve being neighbours in space.

    Each column is walked from the top bit: where the bit is set the lower bits of the first
    axis are inverted, else exchanged with the axis; Gray code and interleaving give the index.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def quantised(bits: int = BITS) -> list[Column]:
    """Codes below 2^bits: hash codes of language and source (0: null), and the size.

    The size code has equal steps of its logarithm up to the largest text there can be, half octaves with six bits.
    """
    top = (1 << bits) - 1
    named = [F.coalesce((F.crc32(F.col(c).cast("string").cast("binary")) % top + 1).cast("int"), F.lit(0)) for c in ("lang", "source")]
    return [*named, F.least(F.floor(F.log2("size") * ((1 << bits) / 32)).cast("int"), F.lit(top))]


CODES = ("_lang_code", "_source_code", "_size_code")


def curve_places(codes: DataFrame, bits: int) -> DataFrame:
    """The cells that occur, with their rows and their places on the curve: at most 2^(3 * bits) rows."""
    def run(batches):
        for batch in batches:
            points = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_numbers(points, bits).astype(np.int32))], [*CODES, "_n", "curve"])

    cells = codes.groupBy(*CODES).agg(F.count("*").alias("_n"))
    return cells.mapInArrow(run, ", ".join([*(f"{c} int" for c in CODES), "_n long", "curve int"]))


def assign(docs: DataFrame, shards: int = 16, bits: int = BITS, bucket_rows: int = BUCKET_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot, grown_shard and curve (the cell) to every document.

    Law ``rows``: shard sizes differ by one row at most, the first shards being the larger
    ones. ``keep`` names the input columns that are kept (all, if it isn't given); with what the
    numbering needs they become a table in the shared folder, so texts are hashed once, and go
    through one shuffle, to their buckets.
    """
    spark = docs.sparkSession
    d, _ = neutral(docs, "doc_id", "text", "lang", "source")
    d = d.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    d = d.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    d = d.withColumns(dict(zip(CODES, quantised(bits)))).withColumn("_place", F.monotonically_increasing_id())
    kept = [c for c in (docs.columns if keep is None else keep) if c not in OUTPUTS]
    own = [c if c in d.columns else f"carried{docs.columns.index(c)}" for c in kept]
    d = stored(spark, d.select(*dict.fromkeys([*own, "doc_id", "size", "text_crc32", *CODES, "_place"])), "shard-rows")

    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = curve_places(d.select(*CODES), bits).select(
        *CODES, "curve", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_s"), F.sum("_n").over(whole).alias("_total"),
        F.greatest(F.ceil(F.col("_n") / bucket_rows), F.lit(1)).cast("int").alias("_buckets"))
    cells = F.broadcast(cut_lineage(spark, cells))  # as many rows as cells at most
    # equal rows differ in their place in the stored table, so a row that is repeated often is spread as well
    d = d.join(cells, [*CODES]).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "_place"), F.col("_buckets")).cast("int"))
    inside = Window.partitionBy("curve").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = d.groupBy("curve", "_s", "_bucket").agg(F.count("*").alias("_n"))
    places = held.select("curve", "_bucket", (F.col("_s") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_start"))

    order = Window.partitionBy("curve", "_bucket").orderBy("doc_id", "text_crc32", "size", "_place")
    d = d.withColumn("_row", F.row_number().over(order)).join(places, ["curve", "_bucket"])
    at, each, more = F.col("_start") + F.col("_row") - 1, F.expr(f"_total div {shards}"), F.col("_total") % shards
    head = more * (each + 1)
    d = d.withColumn("_at", at)
    shard = F.when(F.col("_at") < head, F.expr(f"_at div (_total div {shards} + 1)")).otherwise(
        more + F.floor((F.col("_at") - head) / F.greatest(each, F.lit(1))))
    d = d.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * each + F.least(F.col("shard").cast("long"), more)
    return d.withColumn("slot", (F.col("_at") - start).cast("long")).select(
        *[F.col(o).alias(c) for o, c in zip(own, kept)], "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def manifest(sharded: DataFrame, bits: int = BITS) -> DataFrame:
    """For each shard its rows, bytes and the range of every quantised dimension."""
    names = ("lang_code", "source_code", "size_code")
    d = sharded.select("shard", "size", *[c.alias(n) for c, n in zip(quantised(bits), names)])
    ranges = [f(n).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))]
    return d.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)
