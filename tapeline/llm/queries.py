"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import alignment, chat, decontamination, language_id, lexical_search, line_dedup, mixing, near_dup, quality_rules, secret_scan, sharding, token_counts, toxicity
from tapeline.llm.checks import CHAT_SQL, DECONTAMINATION_SQL, LINE_DEDUP_SQL, SEARCH_SQL, SECRETS_SQL
from tapeline.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"), domains)
    return mixing.digest(mixed, sorted(mixing.TARGETS))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return sharding.assign(d, keep=["doc_id"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(rows.unionByName(chat.added_conversation(spark)))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.cross_align(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_mixing, op3_decontamination, op4_toxicity, op5_language_id, op6_simhash, op7_sharding, op8_quality_rules, op9_token_counts, op10_chat_format, op11_lexical_search, op12_secret_scan, op13_alignment)
}
#: The other queries rest on trained models, an external vocabulary or hashes that the SQL engine lacks.
ORACLES: dict[str, str] = {"op1_line_dedup": LINE_DEDUP_SQL, "op3_decontamination": DECONTAMINATION_SQL, "op10_chat_format": CHAT_SQL, "op11_lexical_search": SEARCH_SQL, "op12_secret_scan": SECRETS_SQL}
