"""Token counts: documents by encoded length, and what suffix sums over the lengths answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from .bpe import token_counts

#: Lengths that are summed together before the sums over blocks.
_BLOCK = 512


def length_histogram(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): exact, one row for each length that occurs. Null or empty text: length 0. Empty table: no rows."""
    return token_counts(docs, path, id_col, text_col).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: the histogram's row, and

    docs_longer: documents of more tokens; docs_up_to: of at most so many (docs_up_to / all documents is the
    quantile that the length answers); tokens_longer: tokens of the longer ones; tokens_up_to; tokens_total;
    truncated_total: tokens left if every document is cut at the limit.

    Sums go block by block: within a block of lengths, then over the blocks, of which there are as many as the
    longest document has tokens over 512. The histogram, a row for each length, is kept in the shared folder first, as the
    two kinds of sums each read it and the texts are to be encoded once.
    """
    rows = X.kept(histogram).withColumn("block", F.floor(F.col("n_tokens") / _BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    per = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("later_tokens"), F.sum("bd").over(everything).alias("docs_total"), F.sum("bt").over(everything).alias("tokens_total"))
    above = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", F.coalesce(F.sum("n_docs").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("t")).join(per, "block")
    out = own.select("n_tokens", "n_docs", (F.col("d") + F.col("later_docs")).alias("docs_longer"), (F.col("t") + F.col("later_tokens")).alias("tokens_longer"), "docs_total", "tokens_total")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        (F.col("docs_total") - F.col("docs_longer")).alias("docs_up_to"),
        "tokens_longer",
        (F.col("tokens_total") - F.col("tokens_longer")).alias("tokens_up_to"),
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """What the histogram answers for any context limits, whether a document has that length or not: (limit, docs_longer, tokens_up_to, tokens_longer, truncated_total).

    One pass over the histogram for all limits; a row for each distinct one. Of an empty histogram all answers are 0.
    """
    wanted = sorted(set(limits))
    n, d = F.col("n_tokens"), F.col("n_docs")
    total = lambda x, where: F.coalesce(F.sum(F.when(where, x)), F.lit(0)).cast("long")
    answer = lambda c: F.struct(F.lit(c).cast("long").alias("limit"), total(d, n > c).alias("docs_longer"), total(n * d, n <= c).alias("tokens_up_to"), total(n * d, n > c).alias("tokens_longer"))
    told = histogram.agg(F.array(*map(answer, wanted)).alias("told")).select(F.inline("told"))
    return told.select("*", (F.col("tokens_up_to") + F.col("limit") * F.col("docs_longer")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of all documents don't exceed. sums: of `suffix_sums`. Null of an empty table."""
    reached = lambda q: F.min(F.when(F.col("docs_up_to") >= F.lit(q) * (F.col("docs_up_to") + F.col("docs_longer")), F.col("n_tokens")))
    return sums.agg(F.array(*(F.struct(F.lit(float(q)).alias("share"), reached(q).alias("n_tokens")) for q in shares)).alias("told")).select(F.inline("told"))
