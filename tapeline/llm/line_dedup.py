"""Line dedup with a suffix array over line ids.

Documents in the order of their ids are one long sequence of lines, a line being its 128-bit
hash. Suffixes that begin at repeated lines are sorted by prefix doubling: ranks of the first d
lines, paired with the ranks d lines further on, are the ranks of the first 2d lines. A rank is
the place of its group in the suffix array, so groups are refined without sorting everything
again, and a suffix that no other shares its beginning with is settled and leaves.

Suffixes that share a beginning are an interval of the array, and the beginnings that count
are those of the fewest lines with ``min_words`` words. The first suffix of such an interval is
kept, the beginnings of the others are later copies and are deleted. Copies that continue the
same kept text make one maximal run.

Edge cases: null texts have no lines and stay null; lines without a word count as lines but not
as words; copies within a document and overlapping copies are deleted too; rows equal in id and
text are one document read several times and get the same result; null ids come first in the
order; an empty table gives no rows; other columns are ignored by ``dedup_runs`` and carried by
``delete_runs``, which replaces those named like its results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import neutral, pieces
from tapeline.session import cut_lineage

#: Words that a repeated run must have.
MIN_WORDS = 50
NO_ID = -(1 << 63)
MADE = ["clean_text", "n_lines", "n_removed"]
LINES = "doc long, text_key long, line int, id1 long, id2 long, need int"
DOC = ["doc", "text_key"]


def needs(counts: list[int], min_words: int) -> np.ndarray:
    """For each line the fewest lines from it on that have ``min_words`` words; 0 if the text ends before."""
    total = np.concatenate([[0], np.cumsum(counts)])
    end = np.searchsorted(total, total[:-1] + min_words, side="left")
    return np.where(end < len(total), end - np.arange(len(counts)), 0).astype(np.int32)


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """Every line with its document, number, 128-bit id and ``need``."""

    def run(batches):
        import xxhash

        for piece, texts in pieces(batches):
            n, line, ids, need = [], [], [], []
            for text in texts:
                own = text.split(b"\n") if text is not None else []
                n.append(len(own))
                line.append(np.arange(len(own), dtype=np.int32))
                ids += [xxhash.xxh3_128_digest(x) for x in own]
                need.append(needs([len(x.split()) for x in own], min_words))
            at = pa.array(np.repeat(np.arange(len(texts)), n))
            both = np.frombuffer(b"".join(ids), dtype=">i8").astype(np.int64).reshape(-1, 2)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (line, need)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(at), piece.column(1).take(at), pa.array(flat[0]), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(flat[1])],
                ["doc", "text_key", "line", "id1", "id2", "need"])

    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    return d.mapInArrow(run, LINES)


def _places(groups: DataFrame, within: list[str], key: list[str], bucket: Column) -> DataFrame:
    """``groups`` (key, n) with ``before``: the suffixes of smaller keys inside ``within``.

    Keys are summed by order-preserving buckets first, so one parent with very many groups is
    not numbered in one task.
    """
    groups = groups.withColumn("_b", bucket)
    sums = groups.groupBy(*within, "_b").agg(F.sum("n").alias("_n"))
    upto = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, "_b").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [*within, "_b"])
    return ranked.withColumn("before", F.col("_before") + F.col("_in")).drop("_b", "_before", "_in")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """Suffixes at repeated lines, ranked by their first line (the alphabet is ordered by hash).

    A document that is read several times leaves its suffixes once.
    """
    lines = cut_lineage(lines.sparkSession, lines)  # the texts are read once
    groups = cut_lineage(lines.sparkSession, lines.groupBy("id1", "id2").agg(F.count("*").alias("n")).where("n > 1"))
    # 4096 buckets of the first hash: they are summed along the order in one small window
    groups = groups.withColumn("top", F.shiftright("id1", 52))
    tops = groups.groupBy("top").agg(F.sum("n").alias("_n"))
    tops = tops.select("top", F.coalesce(F.sum("_n").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ranked = _places(groups, ["top"], ["id1", "id2"], F.shiftright("id1", 44)).join(F.broadcast(tops), "top")
    return lines.join(ranked.select("id1", "id2", (F.col("start") + F.col("before")).alias("rank")), ["id1", "id2"]).select(*DOC, "line", "need", "rank").dropDuplicates([*DOC, "line"])


def _ahead(suffixes: DataFrame, by: Column) -> DataFrame:
    """Suffixes joined with the rank ``by`` lines further on in the same document; the others are settled."""
    other = suffixes.select(*DOC, F.col("line").alias("_line"), F.col("rank").alias("rank2"))
    return suffixes.withColumn("_line", F.col("line") + by).join(other, [*DOC, "_line"]).drop("_line")


def dedup_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies: doc, text_key, line, need (lines of the copied beginning) and the place of the kept text."""
    spark = docs.sparkSession
    suffixes = cut_lineage(spark, _first_ranks(lines_of(docs, min_words)))
    depth, found = 1, []
    most = suffixes.agg(F.max("need")).first()[0] or 0
    while depth <= most:
        # intervals of beginnings with depth to 2 * depth - 1 lines: two overlapping ranks name one
        own = suffixes.where((F.col("need") >= depth) & (F.col("need") < 2 * depth))
        other = suffixes.select(*DOC, F.col("line").alias("_line"), F.col("rank").alias("rank2"))
        own = own.withColumn("_line", F.col("line") + F.col("need") - depth).join(other, [*DOC, "_line"]).drop("_line")
        interval = own.groupBy("rank", "rank2", "need").agg(F.min(F.struct(*DOC, "line")).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = own.join(interval, ["rank", "rank2", "need"]).where(F.struct(*DOC, "line") > F.col("kept"))
        found.append(cut_lineage(spark, later.select(*DOC, "line", "need", "kept")))
        if 2 * depth > most:
            break
        paired = _ahead(suffixes, F.lit(depth))
        groups = paired.groupBy("rank", "rank2").agg(F.count("*").alias("n")).where("n > 1")
        ranked = _places(groups, ["rank"], ["rank2"], F.expr("rank2 div 65536")).select("rank", "rank2", (F.col("rank") + F.col("before")).alias("_new"))
        suffixes = cut_lineage(spark, paired.join(ranked, ["rank", "rank2"]).select(*DOC, "line", "need", F.col("_new").alias("rank")))
        depth *= 2
        if suffixes.isEmpty():
            break
    if not found:
        found = [suffixes.where("false").select(*DOC, "line", "need", F.struct(*DOC, "line").alias("kept"))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def maximal_runs(later: DataFrame) -> DataFrame:
    """Later copies that overlap or touch and continue the same kept text, as one run each."""
    order = Window.partitionBy(*DOC).orderBy("line")
    shift = F.col("kept.line") - F.col("line")
    d = later.withColumn("end", F.col("line") + F.col("need")).withColumn("shift", shift)
    new = (F.col("line") > F.lag("end").over(order)) | (F.col("shift") != F.lag("shift").over(order)) | (F.col("kept.doc") != F.lag("kept.doc").over(order))
    d = d.withColumn("_run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order))
    return d.groupBy(*DOC, "_run").agg(
        F.min("line").alias("first_line"), (F.max("end") - F.min("line")).alias("n_lines"), F.min("kept").alias("kept")).drop("_run")


def delete_runs(docs: DataFrame, later: DataFrame) -> DataFrame:
    """Adds clean_text, n_lines and n_removed to the documents.

    The line numbers of a document's copies are joined to it as arrays, no longer than the
    document has lines.
    """
    marks = later.groupBy(*DOC).agg(F.collect_list("line").alias("_at"), F.collect_list("need").alias("_need"))
    named, restored = neutral(docs, "doc_id", "text")
    names, kinds = named.columns, dict(named.dtypes)
    d = named.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text_key": F.xxhash64("text")}).join(marks, DOC, "left").select(*names, "_at", "_need")

    def run(batches):
        for piece, texts in pieces(batches):
            at = piece.column(piece.schema.names.index("_at")).to_pylist()
            need = piece.column(piece.schema.names.index("_need")).to_pylist()
            clean, n, removed = [], [], []
            for text, a, k in zip(texts, at, need):
                own = text.split(b"\n") if text is not None else []
                gone = np.zeros(len(own) + 1, np.int64)
                if a:
                    np.add.at(gone, np.array(a), 1)
                    np.add.at(gone, np.array(a) + np.array(k), -1)
                gone = np.cumsum(gone)[:-1] > 0
                n.append(len(own))
                removed.append(int(gone.sum()))
                clean.append(text if not gone.any() else b"\n".join(x for x, g in zip(own, gone) if not g))
            made = [pa.array(clean, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[piece.column(piece.schema.names.index(c)) for c in names], *made], [*names, *MADE])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "clean_text string, n_lines long, n_removed long"])
    return d.mapInArrow(run, schema).select(*[c for c, n in zip(restored, docs.columns) if n not in MADE], *MADE)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents' ids and texts without later copies of repeated line runs."""
    d = docs.select("doc_id", "text")
    return delete_runs(d, dedup_runs(d, min_words))


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_removed", F.octet_length("clean_text").cast("long").alias("clean_bytes"), F.sha2("clean_text", 256).alias("clean_sha256"))
