"""The library's queries over the driver's tables, and the SQL that tells the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import genome as G
from .operators import calling, pileup, regions
from .plans import derived, more, views
from .plans import oracles as O

_R = f"r AS ({views.READS_SQL}), f AS (SELECT * FROM r WHERE base_qual >= 13 AND base BETWEEN 0 AND 3)"
_DEPTHS = "SELECT site, " + ", ".join(f"CAST(sum(CASE WHEN library = {i} AND base {op} ref_base THEN 1 ELSE 0 END) AS BIGINT) AS {who}_{kind}" for i, who in enumerate(("dad", "child", "mom")) for kind, op in (("ref", "="), ("alt", "<>"))) + " FROM f GROUP BY site"


def _filtered(spark: SparkSession, folder: str) -> DataFrame:
    return pileup.read_filter(views.reads(spark, folder))


def read_filter(spark, folder):
    return _filtered(spark, folder).groupBy("library").agg(F.count("*").alias("n_reads"))


def pileup_ad(spark, folder):
    return pileup.trio_depths(_filtered(spark, folder))


def allele_rank(spark, folder):
    return pileup.ranked_alleles(_filtered(spark, folder))


def strand_counts(spark, folder):
    return pileup.allele_counts(_filtered(spark, folder)).select("site", "library", "base", "depth", "forward", "reverse")


def rms_mapq(spark, folder):
    return pileup.rms_mapping_quality(pileup.allele_counts(_filtered(spark, folder))).select("site", F.round("mq", 6).alias("mq"))


def depth_stats(spark, folder):
    return pileup.depth_statistics(_filtered(spark, folder)).select("site", "dp", F.round("log_null", 6).alias("log_null"))


def trio_call(spark, folder):
    calls = calling.trio_calls(pileup.trio_depths(_filtered(spark, folder)))
    return calls.where("mutq >= 0.01").select("site", F.round("mutq", 3).alias("mutq"), F.round("lld", 4).alias("lld"), F.round("dnp", 5).alias("dnp"))


def loglike_total(spark, folder):
    calls = calling.trio_calls(pileup.trio_depths(_filtered(spark, folder)))
    return calls.agg(F.round(F.sum("lld"), 3).alias("log_likelihood"))


def region_merge(spark, folder):
    return regions.merge(views.ranges(spark, folder))


def overlap_count(spark, folder):
    return _counted(views.ranges(spark, folder).withColumnRenamed("id", "left_id"), views.targets(spark, folder).withColumnRenamed("id", "right_id"))


def overlap_count_whole(spark, folder):
    """All ranges with all ranges."""
    all_ = views.ranges(spark, folder)
    return _counted(all_.withColumnRenamed("id", "left_id"), all_.withColumnRenamed("id", "right_id"))


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    hits = regions.overlaps(left, right, 64).groupBy("left_id").agg(F.count("*").alias("n"), F.sum("shared").alias("shared"))
    return left.select("left_id").join(hits, "left_id", "left").select("left_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("shared", F.lit(0)).alias("shared"))


def loc_codec(spark, folder):
    r = views.ranges(spark, folder).select("id", G.pack_location(F.col("contig"), F.col("beg")).alias("loc"))
    return r.select("id", "loc", G.contig_of(F.col("loc")).alias("contig"), G.position_of(F.col("loc")).alias("pos"))


def gt_codec(spark, folder):
    p = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", (F.col("p_partkey") % 45).cast("int").alias("gt"))
    lo, hi = G.genotype_alleles(F.col("gt"))
    return p.select("p_partkey", lo.alias("lo"), hi.alias("hi"), G.genotype_index(lo, hi).alias("gt"))


def sample_distance(spark, folder):
    """Distance of libraries: sites of 1 minus the chance of the same genotype, from hom/het/alt weights of the depths."""
    d = pileup.trio_depths(_filtered(spark, folder))
    norm = lambda who: [F.col(f"{who}_{k}") / (F.col(f"{who}_ref") + F.col(f"{who}_alt")) for k in ("ref", "alt")]
    out = None
    for i, j in (("dad", "child"), ("dad", "mom"), ("child", "mom")):
        x, y = norm(i), norm(j)
        part = d.where(f"{i}_ref + {i}_alt > 0 AND {j}_ref + {j}_alt > 0").agg(F.round(F.sum(1 - x[0] * y[0] - x[1] * y[1]), 4).alias("distance")).select(F.lit(i).alias("a"), F.lit(j).alias("b"), "distance")
        out = part if out is None else out.union(part)
    return out


_QUERIES = (read_filter, pileup_ad, allele_rank, strand_counts, rms_mapq, depth_stats, trio_call, loglike_total, region_merge, overlap_count, overlap_count_whole, loc_codec, gt_codec, sample_distance, *derived.QUERIES, *more.QUERIES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    with_f = f"WITH {_R} "
    ranges = f"g AS ({views.RANGES_SQL})"
    pair = lambda i, j: f"SELECT '{i}' AS a, '{j}' AS b, round(sum(1 - {i}_ref / ({i}_ref + {i}_alt) * {j}_ref / ({j}_ref + {j}_alt) - {i}_alt / ({i}_ref + {i}_alt) * {j}_alt / ({j}_ref + {j}_alt)), 4) AS distance FROM d WHERE {i}_ref + {i}_alt > 0 AND {j}_ref + {j}_alt > 0"
    return derived.oracle_sql(with_f, _R, _DEPTHS) | more.oracle_sql(with_f, _R, _DEPTHS) | {
        "read_filter": with_f + "SELECT library, count(*) AS n_reads FROM f GROUP BY library",
        "pileup_ad": with_f + _DEPTHS,
        "allele_rank": with_f + "SELECT site, base, depth, CAST(row_number() OVER (PARTITION BY site ORDER BY is_ref DESC, depth DESC, base) AS INT) AS rank FROM (SELECT site, base, count(*) AS depth, max(CASE WHEN base = ref_base THEN 1 ELSE 0 END) AS is_ref FROM f GROUP BY site, base)",
        "strand_counts": with_f + "SELECT site, library, base, count(*) AS depth, CAST(sum(CASE WHEN is_rev THEN 0 ELSE 1 END) AS BIGINT) AS forward, CAST(sum(CASE WHEN is_rev THEN 1 ELSE 0 END) AS BIGINT) AS reverse FROM f GROUP BY site, library, base",
        "rms_mapq": with_f + "SELECT site, round(sqrt(sum(map_qual * map_qual) / count(*)), 6) AS mq FROM f GROUP BY site",
        "depth_stats": with_f + "SELECT site, CAST(sum(t) AS BIGINT) AS dp, round(sum(t * log10(t)) - sum(t) * log10(sum(t)), 6) AS log_null FROM (SELECT site, base, count(*) AS t FROM f GROUP BY site, base) GROUP BY site",
        "trio_call": O.trio(_R, _DEPTHS) + " SELECT site, round(mutq, 3) AS mutq, round(lld, 4) AS lld, round(dnp, 5) AS dnp FROM t WHERE mutq >= 0.01",
        "loglike_total": O.trio(_R, _DEPTHS) + " SELECT round(sum(lld), 3) AS log_likelihood FROM t",
        "region_merge": f"WITH {ranges}, n AS (SELECT *, CASE WHEN beg <= max(\"end\") OVER (PARTITION BY contig ORDER BY beg, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM g), i AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY beg, \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT contig, min(beg) AS beg, max(\"end\") AS \"end\" FROM i GROUP BY contig, island",
        "overlap_count": f"WITH {ranges}, b AS ({views.TARGETS_SQL}) SELECT a.id AS left_id, count(b.id) AS n, CAST(coalesce(sum(CASE WHEN b.id IS NOT NULL THEN least(a.\"end\", b.\"end\") - greatest(a.beg, b.beg) END), 0) AS BIGINT) AS shared FROM g a LEFT JOIN b ON a.contig = b.contig AND a.beg < b.\"end\" AND b.beg < a.\"end\" GROUP BY a.id",
        "loc_codec": f"WITH {ranges} SELECT id, CAST(contig AS BIGINT) * 4294967296 + beg AS loc, contig, CAST(beg AS INT) AS pos FROM g",
        "gt_codec": "SELECT p_partkey, CAST(g - h * (h + 1) // 2 AS INT) AS lo, CAST(h AS INT) AS hi, CAST(g AS INT) AS gt FROM (SELECT p_partkey, p_partkey % 45 AS g, CAST(floor((sqrt(8 * (p_partkey % 45) + 1) - 1) / 2) AS BIGINT) AS h FROM part)",
        "sample_distance": f"WITH {_R}, d AS ({_DEPTHS}) " + " UNION ALL ".join(pair(i, j) for i, j in (("dad", "child"), ("dad", "mom"), ("child", "mom"))),
    }
