"""Token counts as an exact length histogram.

Every text is encoded by a public tokenizer inside the tasks, documents are summed by encoded
length, and sums from both ends of the histogram answer totals, quantiles and truncated totals
for every context limit. The histogram has as many rows as there are different lengths.

Edge cases: null and empty texts have no tokens; special-token strings in a text are ordinary
text; repeated rows count each; an empty table gives an empty histogram; other columns are
ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.llm.common import pieces
from tapeline.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A vocabulary file is broadcast; larger files are refused.
MAX_VOCABULARY_BYTES = 64_000_000
#: Lengths per block of the suffix sums.
BLOCK = 1024

def _encoder(file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def load_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file as a broadcast of its bytes; the size is checked first."""
    file = spark.read.format("binaryFile").load(path).select("length", "content")
    size = file.agg(F.sum("length")).first()[0]
    if size is None or size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: {size} bytes is no vocabulary of at most {MAX_VOCABULARY_BYTES}")
    return spark.sparkContext.broadcast(bytes(file.first()["content"]))


def encoded_lengths(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of every document."""
    shared = load_vocabulary(docs.sparkSession, tokenizer)

    def run(batches):
        encode = _encoder(shared.value).encode_ordinary  # once a task
        for piece, texts in pieces(batches):
            n = [len(encode(t.decode())) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row for each encoded length with the answers for a context limit of that length.

    n_docs, docs_upto (at most so long) and docs_over; tokens (of these documents), tokens_upto,
    truncated_total (all documents cut to the limit), lost_tokens, quantile (share of documents
    at most so long). Between two lengths the truncated total is linear: from the row of the
    next smaller length add docs_over for each further token of the limit.

    Sums run inside blocks of lengths and over the blocks, so no task orders all lengths.
    """
    h = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    h = h.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("_block", F.expr(f"length div {BLOCK}"))
    h = cut_lineage(lengths.sparkSession, h)  # the texts are encoded once
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("_block", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
                           F.sum("_d").over(whole).alias("_docs"), F.sum("_t").over(whole).alias("_tokens"))
    inside = Window.partitionBy("_block").orderBy("length")
    h = h.join(blocks, "_block")
    h = h.withColumn("docs_upto", F.col("_d0") + F.sum("n_docs").over(inside)).withColumn("tokens_upto", F.col("_t0") + F.sum("tokens").over(inside))
    h = h.withColumn("docs_over", F.col("_docs") - F.col("docs_upto"))
    h = h.withColumn("truncated_total", F.col("tokens_upto") + F.col("docs_over") * F.col("length"))
    return h.select("length", "n_docs", "tokens", "docs_upto", "docs_over", "tokens_upto", "truncated_total",
                    (F.col("_tokens") - F.col("truncated_total")).alias("lost_tokens"), (F.col("docs_upto") / F.col("_docs")).alias("quantile"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens left when every document is cut to ``limit``."""
    return hist.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"))
