"""The queries of this subpackage: opN applies operator N to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import annaq, bpe, decontam, htmltext, langid, licenses, quality, secretscan, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all rows, of every row whose id is divisible by 50."""
    return annaq.neighbours(_table(spark, sf_dir, "embeddings"), queries=F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id, op2_decontamination, op3_secret_scan, op4_nearest_neighbours, op5_quality_classifier,
        op6_byte_bpe, op7_license_scan, op8_warc_reader, op9_simhash_groups, op10_html_extraction,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The WARC round trip gives the pages themselves. Models, automata, trees and tokenizers aren't SQL: tests hold those against brute force."""
    return {"op8_warc_reader": "SELECT page_id, trim(url) AS url, html FROM pages"}
