"""Genomic views of the driver's tables: the same integer expressions as in the SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS_SQL = """
SELECT l_partkey AS site, CAST(l_suppkey % 3 AS INT) AS library, CAST(l_quantity AS INT) AS base_qual, l_linestatus = 'O' AS is_rev,
  CAST(round(l_discount * 600) AS INT) AS map_qual, CAST(l_partkey % 4 AS INT) AS ref_base,
  CAST(CASE WHEN l_partkey % 7 < 2 AND l_suppkey % 3 = 1 AND l_linenumber % 2 = 0 THEN (l_partkey + 1) % 4 ELSE l_partkey % 4 END AS INT) AS base
FROM lineitem
"""


def reads(spark: SparkSession, folder: str) -> DataFrame:
    item = spark.read.parquet(f"{folder}/lineitem.parquet")
    planted = (F.col("l_partkey") % 7 < 2) & (F.col("l_suppkey") % 3 == 1) & (F.col("l_linenumber") % 2 == 0)
    return item.select(
        F.col("l_partkey").alias("site"),
        (F.col("l_suppkey") % 3).cast("int").alias("library"),
        F.col("l_quantity").cast("int").alias("base_qual"),
        (F.col("l_linestatus") == "O").alias("is_rev"),
        F.round(F.col("l_discount") * 600).cast("int").alias("map_qual"),
        (F.col("l_partkey") % 4).cast("int").alias("ref_base"),
        F.when(planted, (F.col("l_partkey") + 1) % 4).otherwise(F.col("l_partkey") % 4).cast("int").alias("base"),
    )


RANGES_SQL = "SELECT CAST(o_custkey % 20 AS INT) AS contig, o_orderkey % 100000 AS beg, o_orderkey % 100000 + 1 + o_custkey % 50 AS \"end\", o_orderkey AS id FROM orders"


def ranges(spark: SparkSession, folder: str) -> DataFrame:
    o = spark.read.parquet(f"{folder}/orders.parquet")
    beg = F.col("o_orderkey") % 100000
    return o.select((F.col("o_custkey") % 20).cast("int").alias("contig"), beg.alias("beg"), (beg + 1 + F.col("o_custkey") % 50).alias("end"), F.col("o_orderkey").alias("id"))


TARGETS_SQL = "SELECT CAST(c_custkey % 20 AS INT) AS contig, c_custkey * 37 % 100000 AS beg, c_custkey * 37 % 100000 + 1 + c_custkey % 400 AS \"end\", c_custkey AS id FROM customer"


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges to annotate others with."""
    c = spark.read.parquet(f"{folder}/customer.parquet")
    beg = F.col("c_custkey") * 37 % 100000
    return c.select((F.col("c_custkey") % 20).cast("int").alias("contig"), beg.alias("beg"), (beg + 1 + F.col("c_custkey") % 400).alias("end"), F.col("c_custkey").alias("id"))
