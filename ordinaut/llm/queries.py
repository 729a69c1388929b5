"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import decontaminate, licenses, media, neardup, packing, quality, sharding, toxicity, urls, warc
from .common import id_text, read_table, written


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _scored(scores: DataFrame, n: int, held: int) -> DataFrame:
    return scores.select(
        "doc_id",
        (_remainder(n) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.mux_texts(id_text(read_table(spark, sf_dir, "documents")))
    return media.digest_media(written(files, "media"))


def op3_bagminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(id_text(read_table(spark, sf_dir, "documents")))


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", urls.fetch_day(F.col("page_id")).alias("day"))
    found = urls.filter_urls(captures, urls.list_of(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("day", "valid_from")})


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _scored(quality.quality_scores(docs, labels, keep=_remainder(3) != 1), 3, 1)


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(id_text(read_table(spark, sf_dir, "documents")), public_tokenizers.path(packing.TOKENIZER), packing.SEQUENCE)


def op9_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _scored(toxicity.toxicity_scores(docs, labels, keep=_remainder(5) != 0), 5, 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_media_columns": op2_media_columns,
    "op3_bagminhash_neardup": op3_bagminhash_neardup,
    "op4_string_tiling": op4_string_tiling,
    "op5_url_filter": op5_url_filter,
    "op6_warc_normaliser": op6_warc_normaliser,
    "op7_quality_ranking": op7_quality_ranking,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_extendible_hashing": op9_extendible_hashing,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op5_url_filter": urls.ORACLE,
    "op9_extendible_hashing": sharding.oracle(),
}
