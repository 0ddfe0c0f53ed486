"""The subpackage's queries over the tables in a folder, as {name: function of (spark, folder)}, and SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .ann import nearest
from .bpe import encode
from .decontamination import contaminated
from .language_id import identify
from .length_histogram import length_histogram, suffix_sums
from .license_scan import PHRASES, license_scan
from .minhash_dedup import near_duplicates
from .secret_scan import KINDS, secret_scan
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup(_table(spark, folder, "documents"), length=100)
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = secret_scan(_table(spark, folder, "documents"), redact=False)

    def kind(name: str):
        return F.filter("spans", lambda s: s["kind"] == name)

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return out.select("doc_id", *(F.size(kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op4_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), words=4, percent=80)


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    out = encode(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    out = identify(_table(spark, folder, "documents"), learn=~_held_out())
    return out.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup(_table(spark, folder, "documents"), length=13)
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_sums(length_histogram(_table(spark, folder, "documents")))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = license_scan(_table(spark, folder, "documents"), PHRASES)
    places = F.transform("base_places", lambda p: p["word"])
    base = F.array_sort(F.array_distinct(F.transform("base_places", lambda p: p["label"])))
    return out.select("doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_dedup, op2_nearest, op3_secret_scan, op4_minhash_dedup, op5_bpe, op6_decontamination, op7_language_id, op8_substring_dedup, op9_length_histogram, op10_license_scan)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
