"""Whole tasks from files to results: call, loglike, dnm, phaser, treecall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import genome as G
from .functions import model as M
from .functions import pedigree as P
from .functions import trees as T
from .functions.text import file_type, input_mode, parse_inheritance, parse_newick, parse_regions, region_ranges
from .operators import alignment, denovo, lineage, pedigree_calling, phasing, pileup, regions
from .sources import reads, tables, variants


def options(text: str) -> dict[str, str]:
    """Lines key=value; comments begin with #."""
    rows = [x.strip() for x in text.splitlines()]
    return {k.strip().replace("-", "_"): v.strip() for k, _, v in (x.partition("=") for x in rows if x and not x.startswith("#"))}


def _within(spark: SparkSession, sites: DataFrame, region: str | None, bed: str | None, lengths: dict[str, int]) -> DataFrame:
    """Sites (pos 1-based) in a region's text or a BED file."""
    if region is None and bed is None:
        return sites
    if bed is not None:
        ranges = tables.read_bed(spark, bed)
    else:
        names = list(lengths)
        ranges = spark.createDataFrame([(names[c], b, e) for c, b, e in region_ranges(parse_regions(region), lengths)], "contig string, beg long, end long")
    shifted = regions.within(sites.withColumn("one_based", F.col("pos")).withColumn("pos", F.col("pos") - 1), ranges)
    return shifted.drop("pos").withColumnRenamed("one_based", "pos")


def _bases(spark: SparkSession, paths: list[str], fasta: str | None, region: str | None, bed: str | None, contigs: dict[str, int] | None, least_mapq: int, least_base_qual: int, tag: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(bases with library and ref_base, [(library, sample)]) of any number of SAM or BAM files and a FASTA."""
    if fasta is None:
        raise ValueError("reads need a reference sequence")
    groups: dict[str, tuple[str, str]] = {}
    parts = None
    for p in paths:
        own = reads.read_groups(reads.header_text(spark, file_type(p)[0]), tag)
        groups |= own
        rows = alignment.with_libraries(alignment.bases(reads.read_reads(spark, p), least_mapq, least_base_qual), own)
        parts = rows if parts is None else parts.unionByName(rows)
    kept = _within(spark, parts, region, bed, contigs or {})
    return tables.reference_bases(kept, tables.read_fasta(spark, fasta)), sorted({(lib, s) for lib, s in groups.values()})


def depths(spark: SparkSession, paths: list[str], fasta: str | None = None, region: str | None = None, bed: str | None = None, contigs: dict[str, int] | None = None, least_mapq: int = 0, least_base_qual: int = 13, tag: str = "LB") -> tuple[DataFrame, list[tuple[str, str]]]:
    """(sites of alleles and ad, [(library, sample)]) of one VCF, or of any number of SAM or BAM files and a FASTA."""
    if input_mode(paths) == "variant":
        if len(paths) != 1:
            raise ValueError("only one variant file can be read")
        path = file_type(paths[0])[0]
        labels = variants.parse_labels(variants.vcf_samples(spark, path))
        sites = variants.allele_depths(variants.read_vcf(spark, path))
        picked = F.array(*(F.get("ad", F.lit(i)) for i, _, _ in labels))
        return _within(spark, sites.withColumn("ad", picked), region, bed, contigs or {}), [(lib, s) for _, lib, s in labels]
    found, libraries = _bases(spark, paths, fasta, region, bed, contigs, least_mapq, least_base_qual, tag)
    return alignment.site_depths(found, [lib for lib, _ in libraries]), libraries


def _graph(spark: SparkSession, ped: str, libraries: list[tuple[str, str]], inheritance: str, mu: float, mu_somatic: float, mu_library: float) -> P.Graph:
    return P.build(tables.read_pedigree(spark, ped), libraries, parse_inheritance(inheritance), mu, mu_somatic, mu_library)


def call(spark: SparkSession, paths: list[str], ped: str, inheritance: str = "autosomal", mu: float = 1e-8, mu_somatic: float = 0.0, mu_library: float = 0.0, least: float = 0.5, everything: bool = False, output: str | None = None, contigs: dict[str, int] | None = None, p: M.Parameters = M.Parameters(), **reading) -> DataFrame:
    """De novo calls; with output (x.vcf or x.vcf.gz) and contigs (in order, with lengths) also written as VCF.

    Calls from reads further have adf (depths on the forward strand) and the site's tests, mq, fs, mqta, rpta and bqta; see `pileup.site_tests`.
    """
    from_reads = input_mode(paths) == "sequence"
    if from_reads:
        own = {"fasta": None, "region": None, "bed": None, "least_mapq": 0, "least_base_qual": 13, "tag": "LB"} | reading
        found, libraries = _bases(spark, paths, contigs=contigs, **own)
        sites = alignment.site_depths(found, [lib for lib, _ in libraries])
    else:
        sites, libraries = depths(spark, paths, contigs=contigs, **reading)
    graph = _graph(spark, ped, libraries, inheritance, mu, mu_somatic, mu_library)
    out = pedigree_calling.call(sites, graph, [lib for lib, _ in libraries], p, least, everything)
    if from_reads:
        places = [[lib for lib, _ in libraries].index(x) for x in graph.libraries]
        tested = pileup.site_tests(found.where(F.col("library").isin(*(lib for lib, _ in libraries))).withColumn("ref_base", G.base_index(F.col("ref_base"))), ("contig", "pos"))
        strands = sites.select("contig", F.col("pos").cast("int").alias("pos"), F.transform(F.array(*map(F.lit, places)), lambda i: F.get("adf", i)).alias("adf"))
        out = out.join(strands, ["contig", "pos"], "left").join(tested.withColumn("pos", F.col("pos").cast("int")), ["contig", "pos"], "left")
    if output is not None:
        variants.write_vcf(pedigree_calling.vcf_lines(out, graph), pedigree_calling.vcf_header(graph, contigs or {}), output, list(contigs or {}))
    return out


def loglike(spark: SparkSession, paths: list[str], ped: str, inheritance: str = "autosomal", mu: float = 1e-8, mu_somatic: float = 0.0, mu_library: float = 0.0, p: M.Parameters = M.Parameters(), **reading) -> DataFrame:
    sites, libraries = depths(spark, paths, **reading)
    return pedigree_calling.log_likelihood(sites, _graph(spark, ped, libraries, inheritance, mu, mu_somatic, mu_library), [lib for lib, _ in libraries], p)


def dnm(spark: SparkSession, vcf: str, ped: str, model: str = "auto", snp_rate: float = 1e-8, indel_rate: float = 1e-9, pair_rate: float = 1e-9, poly: float = 1e-3, scale: float = 1.0, least_depth: int = 10, cutoff: float = 1e-4, output: str | None = None, contigs: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """{"snp", "indel", "pair"}: calls by lookup tables; pairs only with model auto. Depths are DP, or I16 shared out.

    With output (x.vcf or x.vcf.gz) and contigs (in order, with lengths) the calls of trios are also written as VCF.
    """
    samples = variants.vcf_samples(spark, vcf)
    rows = variants.read_vcf(spark, vcf).where(F.size("alts") > 0)
    i16 = variants.info_ints("I16")
    pls = variants.format_ints("PL")
    shared = F.when(i16.isNotNull(), denovo.split_depth(denovo.i16_depth(i16), pls))
    dp = F.coalesce(variants.format_ints("DP"), F.transform("cells", lambda c, i: F.array(F.get(shared, i))))
    indel = (F.length("ref") > 1) | F.exists("alts", lambda a: F.length(a) > 1)
    made = rows.withColumn("dp", dp).withColumn("p", pls).withColumn("indel", indel).where("p IS NOT NULL")
    ten = F.transform("p", lambda v: denovo.ten_genotypes(F.col("alleles"), v))
    pick = lambda pl: F.map_from_arrays(F.array(*map(F.lit, samples)), F.zip_with(pl, F.col("dp"), lambda a, d: F.struct(a.alias("pl"), F.get(d, F.lit(0)).alias("dp"))))
    columns = ["contig", "pos", "ref", "alt"]
    base = made.withColumn("alt", F.array_join("alts", ","))
    snps = base.where(~F.col("indel")).withColumn("cells", pick(ten)).select(*columns, "cells")
    indels = base.where("indel").withColumn("cells", pick(F.transform("p", lambda v: F.slice(v, 1, 3)))).select(*columns, "cells")
    trios, pairs = tables.read_classic_pedigree(spark, ped)
    out = {}
    if trios.take(1):
        out["snp"] = denovo.trio_snps(denovo.trio_members(snps, trios), model, snp_rate, poly, least_depth, cutoff)
        out["indel"] = denovo.trio_indels(denovo.trio_members(indels, trios), model, indel_rate, scale, least_depth, cutoff)
        if output is not None:
            children = sorted({r["child"] for r in trios.collect()})
            lines = denovo.vcf_lines(out["snp"], children).unionByName(denovo.vcf_lines(out["indel"], children))
            variants.write_vcf(lines, denovo.vcf_header(children, contigs or {}), output, list(contigs or {}))
    listed = [(r["tumor"], r["normal"]) for r in pairs.collect()] if model == "auto" else []
    if listed:
        each = snps.withColumn("pair", F.explode(F.array(*(F.struct(F.lit(t).alias("tumor"), F.lit(n).alias("normal")) for t, n in listed))))
        for who in ("tumor", "normal"):
            cell = F.try_element_at("cells", F.col(f"pair.{who}"))
            each = each.withColumn(who, F.col(f"pair.{who}")).withColumn(f"{who}_pl", cell["pl"]).withColumn(f"{who}_dp", cell["dp"])
        out["pair"] = denovo.pair_snps(each.drop("cells", "pair"), pair_rate, least_depth, cutoff)
    return out


def phaser(spark: SparkSession, mutations: str, sites: str, bam: str, window: int = 1000) -> DataFrame:
    rows = reads.read_reads(spark, bam)
    # A file's reads come in order within its one partition.
    ordered = rows.withColumn("ordinal", F.monotonically_increasing_id())
    return phasing.phase(tables.read_mutations(spark, mutations), tables.read_phasing_sites(spark, sites), ordered, window)


def lineage_sites(spark: SparkSession, vcf: str, genotypes: int = 3) -> DataFrame:
    """contig, pos, ref, pl (of each sample) of sites with bases as reference and first alternative."""
    rows = variants.read_vcf(spark, vcf).where(F.col("ref").isin(*"ACGT") & F.get("alts", F.lit(0)).isin(*"ACGT"))
    rows = rows.withColumn("p", variants.format_ints("PL")).withColumn("a", variants.format_ints("AD")).where("p IS NOT NULL AND a IS NOT NULL")
    pl = lineage.three_genotypes(F.col("p"), lineage.two_alleles(F.col("a"))) if genotypes == 3 else F.transform("p", lambda v: F.transform(denovo.ten_genotypes(F.col("alleles"), v), lambda x: F.least(x, F.lit(255))))
    return rows.select("contig", "pos", "ref", pl.cast("array<array<double>>").alias("pl")).where(~F.exists("pl", lambda v: F.exists(v, lambda x: x.isNull())))


def treecall(spark: SparkSession, vcf: str, mu: float = 80.0, het: float = 30.0, least: float = 60.0) -> DataFrame:
    """(start, tree, score), the best first, with the samples' names in the tree."""
    names = variants.vcf_samples(spark, vcf)
    sites = lineage_sites(spark, vcf).persist()
    try:
        found = lineage.search(sites, mu, het, least).collect()
    finally:
        sites.unpersist()
    numbers = [str(k) for k in range(len(names))]
    rows = [(r["start"], T.to_text(T.from_twig(parse_newick(r["tree"]), numbers), names), r["score"]) for r in found]
    return spark.createDataFrame(rows, "start string, tree string, score double").orderBy("score", "start")


def genotype(spark: SparkSession, vcf: str, tree: str, mu: float = 80.0, het: float = 30.0) -> DataFrame:
    names = variants.vcf_samples(spark, vcf)
    return lineage.placements(lineage_sites(spark, vcf, 10), T.from_twig(parse_newick(tree), names), names, mu, het)
