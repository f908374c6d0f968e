"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow rows that one Python call holds at most are cut into pieces of about this many text bytes.
PIECE_BYTES = 2_000_000

#: ASCII letters and digits in lower case and every byte of a non-ASCII character; the rest separates words.
LOWER_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Words are runs of anything but space and the control characters 9 to 13.
SPACED_WORDS = bytes(0x20 if 9 <= b <= 13 or b == 0x20 else 0x21 if b < 0x20 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text whose A-Z are lower-cased; null has none."""
    return text.translate(LOWER_WORDS).split() if text else []


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null ids are read as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).cast("binary")) % modulus


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with their texts as bytes, each of about ``size`` bytes of text (one row at least)."""
    for batch in batches:
        texts = batch.column(batch.schema.names.index(column)).cast(pa.binary())
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, own in enumerate(sizes):
            if held and held + own > size:
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += own + 1
        if start < len(sizes):
            yield batch.slice(start), texts.slice(start).to_pylist()


def map_texts(df: DataFrame, schema: str, per_piece: Callable[[pa.RecordBatch, list], pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` over slices of bounded text size; ``text`` must be a column of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            yield per_piece(piece, texts)

    return df.mapInArrow(run, schema)


def neutral(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """The table with neutral names for all columns but ``own``, and the columns that restore the old names and order.

    Operators that carry whole rows work on it, so no column of a caller clashes with theirs.
    """
    names = {c: f"carried{i}" for i, c in enumerate(docs.columns) if c not in own}
    d = docs.select(*own, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return d, [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def bounded(df: DataFrame, limit: int) -> list[dict]:
    """Rows of a model or of a sample on the driver; the caller's plan holds them to ``limit``, and more are an error."""
    rows = df.toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"{rows.num_rows} rows where at most {limit} were planned")
    return rows.to_pylist()


def broadcast_model(spark: SparkSession, model: object) -> Broadcast:
    """A model of bounded size as pickled bytes that hold their classes; tasks read it with ``pickle.loads``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))
