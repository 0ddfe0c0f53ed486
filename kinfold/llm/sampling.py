"""Bounded samples of rows to fit classifiers on. Nothing else is ever sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Characters of a text that a classifier is fitted on, at most, so that what comes to the driver is bounded by rows.
MOST = 50_000


def texts_of(docs: DataFrame, rows: int, where: Column | None = None, by: str | None = None, most: int = MOST) -> list:
    """Up to `rows` texts, of each up to `most` characters (for each value of `by`, of which null is none), the first in the order of a hash of doc_id: rows (by, text).

    The ids are chosen first, then the texts are read. What comes to the driver are a row for each value of `by`, and the texts.
    """
    some = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        some = some.where(where)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if by is None:
        ids = some.select("doc_id").orderBy(*order).limit(rows)
    else:
        some = some.where(F.col(by).isNotNull())
        # Of a value with many rows only about 4 * rows come first, by the same hash that then ranks them
        shares = {r[by]: min(1.0, 4 * rows / r["count"]) for r in some.groupBy(by).count().collect()}
        if not shares:
            return []
        share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
        some = some.where(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= F.try_element_at(share, F.col(by)))
        ids = some.select("doc_id", by).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= rows)
    wanted = sorted({r.doc_id for r in ids.collect()})
    if not wanted:
        return []
    kind = F.col(by).alias("kind") if by else F.lit(None).cast("string").alias("kind")
    found = some.where(F.col("doc_id").isin(wanted)).select("doc_id", kind, F.substring("text", 1, most).alias("text")).collect()
    return sorted({(r.kind, r.doc_id, r.text) for r in found}, key=lambda x: (str(x[0]), x[1], x[2]))
