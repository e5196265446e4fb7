"""The numbered operators as queries over the test tables, and their expected results as SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from burnledger.llm import op1_language, op2_decontamination, op3_license, op4_token_counts, op5_substring, op6_packing, op7_quality, op8_fingerprint, op9_jaccard, op10_binary_ids, op11_simhash, op12_spelling, op13_runs

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_language.identify(table(spark, sf_dir, "documents"))


def op7_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op7_quality.scored(docs, op7_quality.train(docs, table(spark, sf_dir, "labels")))


def op2_decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_license.scan(table(spark, sf_dir, "documents"), op3_license.known(spark))


def op4_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_token_counts.count_edits(table(spark, sf_dir, "documents"), op4_token_counts.sample_edits())


def op5_substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_substring.report(table(spark, sf_dir, "documents"))


def op6_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_packing.pack(table(spark, sf_dir, "documents"))


def op8_fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op9_jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_jaccard.components(table(spark, sf_dir, "documents"))


def op10_binary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_binary_ids.token_files(table(spark, sf_dir, "documents"))


def op11_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_simhash.components(table(spark, sf_dir, "documents"))


def op12_spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_spelling.report(table(spark, sf_dir, "documents"))


def op13_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_runs.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_language": op1_language_query,
    "op2_decontamination": op2_decontamination_query,
    "op3_license": op3_license_query,
    "op4_token_counts": op4_token_counts_query,
    "op5_substring": op5_substring_query,
    "op7_quality": op7_quality_query,
    "op6_packing": op6_packing_query,
    "op8_fingerprint": op8_fingerprint_query,
    "op9_jaccard": op9_jaccard_query,
    "op10_binary_ids": op10_binary_query,
    "op11_simhash": op11_simhash_query,
    "op12_spelling": op12_spelling_query,
    "op13_runs": op13_runs_query,
}

ORACLES: dict[str, str] = {"op3_license": op3_license.oracle()}
