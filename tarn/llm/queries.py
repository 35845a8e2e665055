"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, chaining, decontam, dualtree, hostbayes, langid, licenses, linededup, rules, simhash, tokencount, warc, whitening
from tarn.llm.common import scan

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(scan(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(scan(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(scan(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_boilerplate(scan(spark, sf_dir, "documents"))
    text = F.col("_kept_text")
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.length(text).cast("bigint").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.shared_passages(scan(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source is a host; its documents of one language are a path of it, as in page addresses
    path = F.concat_ws("/", F.lit(""), "lang")
    return hostbayes.site_quality(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels"), F.col("source"), path)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(scan(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(scan(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(scan(spark, sf_dir, "pages")).drop("n_chunks")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(scan(spark, sf_dir, "embeddings"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.cluster(scan(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    own = (op1_bpe, op2_token_counts, op3_license_scan, op4_line_dedup, op5_substring_dedup, op6_quality_rules, op7_decontamination, op8_quality_classifier, op9_simhash, op10_language_id, op11_warc, op12_whitening, op13_clustering)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from tarn.llm.oracles import ORACLES

    return {k: v for k, v in ORACLES.items() if k in queries()}
