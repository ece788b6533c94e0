"""The queries of this package over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, decontam, jaccard, licenses, lines, media, quality, secrets, suffix_dedup, token_counts
from .common import spread
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_OF_TEXT = 50256  # beyond the vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.features(media.media_columns(table(spark, sf_dir, "documents")))
    return rows.select(
        F.col("key").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    any_base = F.size("base_starts") > 0
    all_labels = F.array_sort(F.array_union("base_labels", F.array_distinct(F.transform("matches", lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(any_base, 1.0).otherwise(best).alias("score"),
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_dropped")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, END_OF_TEXT)
    return counts.select(F.col("key").alias("doc_id"), "n_tokens")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_media": op2_media,
    "op3_licenses": op3_licenses,
    "op4_jaccard": op4_jaccard,
    "op5_lines": op5_lines,
    "op6_secrets": op6_secrets,
    "op7_token_counts": op7_token_counts,
    "op8_decontam": op8_decontam,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
}
