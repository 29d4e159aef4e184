"""The queries of this subpackage, by name, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conflictpack, decontaminate, exactdedup, langid, licences, minhash, suffixdedup, suffixtree, tokenpack, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(table(spark, sf_dir, "documents"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.digest(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.digest(table(spark, sf_dir, "documents"))


def op9_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenpack.packed(table(spark, sf_dir, "documents"))


def op10_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflictpack.packed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_suffix_tree, op3_toxicity, op4_language_id, op5_licence_scan, op6_decontaminate, op7_minmax_dedup, op8_exact_dedup, op9_token_packing, op10_conflict_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op5_licence_scan": licences.oracle(), "op8_exact_dedup": exactdedup.ORACLE}
