"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, language, licences, mixing, neardup, periodic, repeats, surrogates, tokens, topk, toxicity, warc


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(_t(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_t(spark, sf_dir, "documents"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(_t(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(_t(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.report(_t(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The secret is the cluster's; without one a run has its own, which nobody keeps.
    return surrogates.report(_t(spark, sf_dir, "documents"), spark.conf.get("spark.apexline.surrogates.key", None) or secrets.token_hex(32))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_t(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(_t(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_t(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(_t(spark, sf_dir, "pages"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(_t(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_topk, op2_mixing, op3_licences, op4_language, op5_toxicity, op6_tokens, op7_surrogates, op8_repeats, op9_decontaminate, op10_neardup,
        op11_periodic, op12_warc, op13_centroids,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_licences": licences.sql()}
