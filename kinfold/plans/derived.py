"""Further queries over the driver's tables, each with SQL that tells the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import model as M
from ..functions import pedigree as P
from ..functions import text as X
from ..operators import denovo, lineage, pedigree_calling, phasing, pileup, regions
from . import oracles as O
from . import views

PEDIGREE = "##PEDNG\nmom . . 2 mom\ndad . . 1 dad\nchild dad mom 2 child\n"
LIBRARIES = ["dad", "child", "mom"]


def _filtered(spark: SparkSession, folder: str) -> DataFrame:
    return pileup.read_filter(views.reads(spark, folder))


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    d = pileup.trio_depths(_filtered(spark, folder))
    ad = F.array(*(F.array(F.col(f"{w}_ref").cast("int"), F.col(f"{w}_alt").cast("int")) for w in LIBRARIES))
    return d.select(F.lit("1").alias("contig"), F.col("site").cast("int").alias("pos"), F.array(F.lit("A"), F.lit("C")).alias("alleles"), ad.alias("ad"))


def _graph(model: str) -> P.Graph:
    return P.build(X.parse_pedigree(PEDIGREE), [(x, x) for x in LIBRARIES], model)


def _called(spark: SparkSession, folder: str, model: str) -> DataFrame:
    calls = pedigree_calling.call(_sites(spark, folder), _graph(model), LIBRARIES, least=0.0, everything=True)
    return calls.where("mutq >= 0.01").select(F.col("pos").cast("long").alias("site"), F.round("mutq", 3).alias("mutq"), F.round("lld", 4).alias("lld"), F.round("dnp", 5).alias("dnp"))


def pedigree_call(spark, folder):
    return _called(spark, folder, "autosomal")


def pedigree_call_xlinked(spark, folder):
    return _called(spark, folder, "x-linked")


def pedigree_loglike(spark, folder):
    out = pedigree_calling.log_likelihood(_sites(spark, folder), _graph("autosomal"), LIBRARIES)
    return out.select(F.round("log_likelihood", 3).alias("log_likelihood"))


def _genotype_ll(spark, folder, ploidy):
    @F.pandas_udf("array<double>")
    def ll(ref: pd.Series, alt: pd.Series) -> pd.Series:
        depth = pd.concat([ref, alt], axis=1).to_numpy()
        return pd.Series(list(M.genotype_likelihoods(depth, 2, M.Parameters(), ploidy)))

    d = pileup.trio_depths(_filtered(spark, folder)).withColumn("ll", ll("child_ref", "child_alt"))
    return d.select("site", *(F.round(F.get("ll", F.lit(i)), 5).alias(f"ll{i}") for i in range(3 if ploidy == 2 else 2)))


def genotype_ll_diploid(spark, folder):
    return _genotype_ll(spark, folder, 2)


def genotype_ll_haploid(spark, folder):
    return _genotype_ll(spark, folder, 1)


_PL = {w: [10 * k + i + 1 for i in range(10)] for k, w in enumerate(("child", "mom", "dad"))}


def _likelihoods(spark: SparkSession, folder: str, width: int) -> DataFrame:
    e = spark.read.parquet(f"{folder}/embeddings.parquet").where("embedding IS NOT NULL AND size(embedding) >= 30")
    pl = lambda w: F.array(*(F.floor(F.abs(F.element_at("embedding", i).cast("double")) * 100).cast("int") for i in _PL[w][:width]))
    return e.select("vec_id", F.substring(F.lit("ACGT"), 1, 4).substr((F.col("vec_id") % 4 + 1).cast("int"), F.lit(1)).alias("ref"), *(pl(w).alias(f"{w}_pl") for w in _PL), *(F.lit(20).alias(f"{w}_dp") for w in _PL))


def dnm_trio_snp(spark, folder):
    return denovo.trio_snps(_likelihoods(spark, folder, 10), cutoff=-1.0).select("vec_id", F.round(F.log10("pp_dnm"), 4).alias("pp"), F.round(F.log10("null_like"), 4).alias("null_like"))


def dnm_trio_snp_xs(spark, folder):
    return denovo.trio_snps(_likelihoods(spark, folder, 10), "XS", cutoff=-1.0).select("vec_id", F.round(F.log10("pp_dnm"), 4).alias("pp"), F.round(F.log10("null_like"), 4).alias("null_like"))


def dnm_trio_indel(spark, folder):
    sites = _likelihoods(spark, folder, 3).withColumn("alt", F.concat("ref", F.lit("A")))
    return denovo.trio_indels(sites, cutoff=-1.0).select("vec_id", F.round(F.log10("pp_dnm"), 4).alias("pp"), F.round(F.log10("null_like"), 4).alias("null_like"))


def dnm_pair(spark, folder):
    sites = _likelihoods(spark, folder, 10).withColumnsRenamed({"child_pl": "tumor_pl", "mom_pl": "normal_pl", "child_dp": "tumor_dp", "mom_dp": "normal_dp"})
    return denovo.pair_snps(sites, cutoff=-1.0).select("vec_id", F.round("pp_dnm", 6).alias("pp"), F.round("null_like", 6).alias("null_like"))


def phase_range_join(spark, folder):
    g = views.ranges(spark, folder).withColumnRenamed("beg", "pos").withColumn("contig", F.col("contig").cast("string"))
    sites = g.where("id % 8 <> 1").select("contig", "pos", F.when(F.col("id") % 3 == 0, "CC").otherwise("CG").alias("gt_child"), F.lit("CC").alias("gt_p1"), F.when(F.col("id") % 5 == 0, "NN").otherwise("GG").alias("gt_p2"))
    dnm = g.where("id % 8 = 1").select("contig", "pos", F.lit("A").alias("inherited"), F.lit("T").alias("variant"))
    return phasing.informative_sites(dnm, sites, 40).groupBy("contig", "dnm_pos").agg(F.count("*").alias("n"), F.sum(F.col("hap_pos") - F.col("dnm_pos")).alias("offset"))


def region_semi_join(spark, folder):
    g = views.ranges(spark, folder)
    return regions.within(g.where("id % 3 = 1").select("contig", F.col("beg").alias("pos"), "id"), g.where("id % 3 = 0"), 256).select("id")


_MODES = ("any", "count", "fraction", "reciprocal", "point")


def _annotated(mode: str, whole: bool = False):
    def query(spark, folder):
        g = views.ranges(spark, folder)
        out = regions.annotate(g, g if whole else views.targets(spark, folder), mode, 0.3, 256)
        return out.select("id", F.round("value", 6).alias("value"))

    query.__name__ = f"bed_overlap_{mode}" + "_whole" * whole
    return query


def percent_decode(spark, folder):
    """All urls, with their percent signs, slashes and colons coded, and a text after them that isn't wholly a code."""
    @F.pandas_udf(StringType())
    def decode(x: pd.Series) -> pd.Series:
        return x.map(X.percent_decode, na_action="ignore")

    coded = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2f")), F.lit(":"), F.lit("%3A"))
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", decode(F.concat(coded, F.lit("%20x%41%zzy"))).alias("url"))


def qc_and_depth(spark, folder):
    counts = pileup.allele_counts(_filtered(spark, folder)).groupBy("site").agg(F.sum("depth").alias("dp"), F.sqrt(F.sum("mq2") / F.sum("depth")).alias("mq"))
    return counts.select("site", denovo.qc_flag(F.col("mq"), F.col("dp")).alias("flag"), denovo.deep_enough(F.col("dp"), least=25).alias("deep"))


def two_alleles(spark, folder):
    g = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", F.array(*(F.array(*((F.col("p_partkey") * (k + 3) * (s + 1) % 7).cast("int") for k in range(4))) for s in range(2))).alias("ad"))
    out = g.select("p_partkey", lineage.two_alleles(F.col("ad")).alias("a"))
    return out.select("p_partkey", F.get("a", F.lit(0)).cast("int").alias("first"), F.get("a", F.lit(1)).cast("int").alias("second"))


def ten_genotypes(spark, folder):
    p = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", F.array(F.lit("G"), F.lit("T"), F.lit("X")).alias("a"), F.array(*((F.col("p_partkey") * (k + 3) % 61).cast("int") for k in range(6))).alias("pl"))
    return p.select("p_partkey", F.array_join(denovo.ten_genotypes(F.col("a"), F.col("pl")).cast("array<string>"), ",").alias("pl"))


def lineage_search(spark, folder):
    """Trees of six samples over all sites; likelihoods of the three genotypes from the depths of six libraries."""
    item = spark.read.parquet(f"{folder}/lineitem.parquet")
    lib = (F.col("l_suppkey") % 6).cast("int")
    alt = (F.col("l_partkey") % 5 == lib) | ((F.col("l_partkey") % 2 == 0) & (lib < 2))
    n = item.groupBy(F.col("l_partkey").alias("site")).agg(*(F.sum(F.when((lib == k) & (alt == v), 1).otherwise(0)).alias(f"n{k}{int(v)}") for k in range(6) for v in (False, True)))
    pl = lambda k: F.array(F.col(f"n{k}1") * 20.0, (F.col(f"n{k}0") + F.col(f"n{k}1")) * 3.0, F.col(f"n{k}0") * 20.0)
    out = lineage.search(n.select("site", F.array(*map(pl, range(6))).alias("pl")))
    return out.select("start", "tree", F.round("score", 3).alias("score"))


QUERIES = (pedigree_call, pedigree_call_xlinked, pedigree_loglike, genotype_ll_diploid, genotype_ll_haploid, dnm_trio_snp, dnm_trio_snp_xs, dnm_trio_indel, dnm_pair, phase_range_join, region_semi_join, *map(_annotated, _MODES), *(_annotated(mode, whole=True) for mode in _MODES), percent_decode, qc_and_depth, two_alleles, ten_genotypes, lineage_search)


def oracle_sql(with_f: str, reads: str, depths: str) -> dict[str, str]:
    """The parts that the other queries' SQL begins with."""
    trio = O.trio(reads, depths)
    g = f"WITH g AS ({views.RANGES_SQL})"
    f = g + f', a AS (SELECT * FROM g), b AS ({views.TARGETS_SQL})'
    over = 'a LEFT JOIN b ON a.contig = b.contig AND a.beg < b."end" AND b.beg < a."end"'
    shared = 'least(a."end", b."end") - greatest(a.beg, b.beg)'
    per = lambda value, join=over: f"{f} SELECT a.id AS id, CAST({value} AS DOUBLE) AS value FROM {join} GROUP BY a.id"
    ad = [[f"(p_partkey * {k + 3} * {s + 1} % 7)" for k in range(4)] for s in range(2)]
    totals = " UNION ALL ".join(f"SELECT p_partkey, {k} AS k, {ad[0][k]} + {ad[1][k]} AS d FROM part" for k in range(4))
    at = {"A": 2, "C": 2, "G": 0, "T": 1}
    place = [(max(at[x[0]], at[x[1]]), min(at[x[0]], at[x[1]])) for x in "AA AC AG AT CC CG CT GG GT TT".split()]
    return {
        "pedigree_call": trio + " SELECT site, round(mutq, 3) AS mutq, round(lld, 4) AS lld, round(dnp, 5) AS dnp FROM t WHERE mutq >= 0.01",
        "pedigree_call_xlinked": O.trio(reads, depths, True) + " SELECT site, round(mutq, 3) AS mutq, round(lld, 4) AS lld, round(dnp, 5) AS dnp FROM t WHERE mutq >= 0.01",
        "pedigree_loglike": trio + " SELECT round(sum(lld), 3) AS log_likelihood FROM t",
        "genotype_ll_diploid": O.likelihoods(with_f, depths, 2),
        "genotype_ll_haploid": O.likelihoods(with_f, depths, 1),
        "dnm_trio_snp": O.snp("auto"),
        "dnm_trio_snp_xs": O.snp("XS"),
        "dnm_trio_indel": O.indel(),
        "dnm_pair": O.pair(),
        "phase_range_join": g + " SELECT CAST(d.contig AS VARCHAR) AS contig, d.beg AS dnm_pos, count(*) AS n, CAST(sum(h.beg - d.beg) AS BIGINT) AS \"offset\" FROM g d JOIN g h ON d.contig = h.contig AND abs(h.beg - d.beg) <= 40 AND h.beg <> d.beg WHERE d.id % 8 = 1 AND h.id % 8 <> 1 AND h.id % 3 <> 0 AND h.id % 5 <> 0 GROUP BY d.contig, d.beg",
        "region_semi_join": g + ' SELECT id FROM g s WHERE id % 3 = 1 AND EXISTS (SELECT 1 FROM g r WHERE r.id % 3 = 0 AND r.contig = s.contig AND s.beg >= r.beg AND s.beg < r."end")',
        "bed_overlap_any": per("max(CASE WHEN b.id IS NULL THEN 0 ELSE 1 END)"),
        "bed_overlap_count": per("count(b.id)"),
        "bed_overlap_reciprocal": per(f'count(CASE WHEN {shared} >= 0.3 * (a."end" - a.beg) AND {shared} >= 0.3 * (b."end" - b.beg) THEN 1 END)'),
        "bed_overlap_point": per("max(CASE WHEN b.id IS NULL THEN 0 ELSE 1 END)", 'a LEFT JOIN b ON a.contig = b.contig AND a.beg >= b.beg AND a.beg < b."end"'),
        "bed_overlap_fraction": f'{f}, c AS (SELECT a.id, count(DISTINCT CASE WHEN b.id IS NOT NULL THEN p.p END) AS n, max(a."end" - a.beg) AS size FROM a, LATERAL (SELECT unnest(range(a.beg, a."end")) AS p) p LEFT JOIN b ON a.contig = b.contig AND p.p >= b.beg AND p.p < b."end" GROUP BY a.id) SELECT id, round(n / size, 6) AS value FROM c',
        "percent_decode": "SELECT page_id, url || ' xAy' AS url FROM pages",
        "qc_and_depth": with_f + " SELECT site, CASE WHEN sqrt(sum(map_qual * map_qual) / count(*)) < 40 OR count(*) < 10 THEN 1 ELSE 0 END AS flag, count(*) >= 25 AS deep FROM f GROUP BY site",
        "two_alleles": f"WITH t AS ({totals}), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d DESC, k DESC) AS n FROM t) SELECT p_partkey, CAST(max(CASE WHEN n = 1 THEN k END) AS INT) AS first, CAST(max(CASE WHEN n = 2 THEN k END) AS INT) AS second FROM r GROUP BY p_partkey",
        "ten_genotypes": "SELECT p_partkey, concat_ws(',', " + ", ".join(f"p_partkey * {hi * (hi + 1) // 2 + lo + 3} % 61" for hi, lo in place) + ") AS pl FROM part",
    }
