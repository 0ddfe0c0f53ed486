"""A corpus from raw documents to token ids, in stages; each works on all that the one before kept.

Rows are judged one by one beside their own columns; only near-dedup and decontamination shuffle. Stages take rows with
null and repeated ids, null, empty and very long texts, and further columns of any name (other than those that begin with
_kinfold_), which go through unchanged; of an empty table they make an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, decontamination, language_id, secret_scan
from kinfold.llm import exchange as X
from kinfold.llm import text as t
from kinfold.llm.minhash_dedup import near_duplicates
from kinfold.llm.sampling import texts_of


#: Of columns that are only there within a stage; documents may have further columns of any other name.
_P = "_kinfold_"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; those that the models reject (none, as in null and empty texts, or unlike any of them) go."""
    out = language_id.judged(docs, language_id.learned(docs), prefix=_P)
    return out.where(~F.col(f"{_P}rejected")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 in five-word shingles, the one with the smallest id stays.

    Where ids are null or repeated, rows go by their place in the order of ids (null ones last) and texts instead.
    """
    rows, key = docs, "doc_id"
    if docs.where(F.col(key).isNull()).limit(1).count() or docs.groupBy(key).count().where("count > 1").limit(1).count():
        rows, key = X.written(docs.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn(f"{_P}row", F.monotonically_increasing_id())), f"{_P}row"
    gone = near_duplicates(rows, words=5, percent=80, id_col=key).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go. Rows are told by their texts; null texts stay; without a benchmark all do."""
    return decontamination.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced by what kind they are, and n_chars follows."""
    model = secret_scan.fit([x[2] for x in texts_of(t.id_text(docs), 1500)])
    out = secret_scan.cleaned(docs, model, prefix=_P)
    changed = F.size(f"{_P}spans") > 0
    own = {"text": F.col(f"{_P}redacted"), "n_chars": F.when(changed, F.length(f"{_P}redacted").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(own[c].alias(c) if c in own else c for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids (little-endian, unsigned, 32 bits); a row for each row, null texts without tokens."""
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next one's is written; the last table is left for the rows that read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = X.place(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                X.deleted(spark, before)
            before = path
    return docs


#: SQL can't tell the stages' models and the tokenizer; the tests hold them against plain versions.
ORACLE_SQL = None
