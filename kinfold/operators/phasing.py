"""Which parent a de novo mutation comes from, told by reads that also cover an informative site nearby."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import cigar_runs


def informative_sites(mutations: DataFrame, sites: DataFrame, window: int = 1000) -> DataFrame:
    """Mutations (contig, pos, inherited, variant) with phasing sites (contig, pos, gt_child, gt_p1, gt_p2) within a window.

    Parents' genotypes known and different, the child heterozygous. An equi-join on bins as wide as the window.
    """
    good = sites.where("NOT (gt_child LIKE 'N%' OR gt_p1 LIKE 'N%' OR gt_p2 LIKE 'N%') AND gt_p1 <> gt_p2 AND substr(gt_child, 1, 1) <> substr(gt_child, 2, 1)")
    right = good.select("contig", F.floor(F.col("pos") / window).alias("bin"), F.col("pos").alias("hap_pos"), "gt_p1", "gt_p2")
    left = mutations.select("contig", F.col("pos").alias("dnm_pos"), "inherited", "variant")
    left = left.withColumn("bin", F.explode(F.array(*(F.floor(F.col("dnm_pos") / window) + k for k in (-1, 0, 1)))))
    both = left.join(right, ["contig", "bin"])
    return both.where((F.abs(F.col("hap_pos") - F.col("dnm_pos")) <= window) & (F.col("hap_pos") != F.col("dnm_pos"))).drop("bin")


def aligned_text(cigar: str, seq: str) -> str | None:
    """The read laid along the reference: clips and insertions cut out, deletions as dashes that the cursor doesn't pass.

    None with any other operation than M, S, I, D.
    """
    at = 0
    for n, op in cigar_runs(cigar):
        if op == "M":
            at += n
        elif op in "SI":
            seq = seq[:at] + seq[at + n :]
        elif op == "D":
            seq = seq[:at] + "-" * n + seq[at:]
        else:
            return None
    return seq


@F.pandas_udf(StringType())
def _aligned(cigar: pd.Series, seq: pd.Series) -> pd.Series:
    return pd.Series([aligned_text(c, s) if c is not None and s is not None else None for c, s in zip(cigar, seq, strict=True)])


def phasing_reads(reads: DataFrame) -> DataFrame:
    """Reads (contig, pos 1-based, qname, flag, cigar, seq, xt) that are mapped, no rescued mate, and pass; duplicates stay."""
    kept = reads.where((F.col("flag").bitwiseAND(4 | 512) == 0) & (F.coalesce("xt", F.lit("")) != "M"))
    return kept.withColumn("aligned", _aligned("cigar", "seq"))


def pair_counts(pairs: DataFrame, reads: DataFrame, width: int = 1000) -> DataFrame:
    """(contig, dnm_pos, hap_pos, dnm_base, hap_base, n) by reads with an `ordinal` (place in the file).

    Of a read's alignments in file order, each counts once both bases are known; a later mate's base replaces an earlier one.
    A pair of sites at which a read has an operation that can't be laid out is left out.
    """
    start = F.col("pos") - 1
    r = phasing_reads(reads)
    r = r.withColumn("last", start + F.greatest(F.coalesce(F.length("aligned"), F.lit(1)), F.lit(1)))
    r = r.withColumn("bin", F.explode(F.sequence(F.floor(start / width), F.floor(F.col("last") / width))))
    p = pairs.select("contig", "dnm_pos", "hap_pos", "variant", "gt_p1", "gt_p2").distinct()
    lo, hi = F.least("dnm_pos", "hap_pos"), F.greatest("dnm_pos", "hap_pos")
    p = p.withColumn("bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    keys = ["contig", "dnm_pos", "hap_pos", "variant", "gt_p1", "gt_p2"]
    hits = r.join(p, ["contig", "bin"]).where((start < hi) & (F.col("last") >= lo))
    hits = hits.select(*keys, "qname", "ordinal", "aligned", start.alias("start")).dropDuplicates([*keys, "qname", "ordinal"])

    def base(at: str) -> Column:
        offset = F.col(at) - F.col("start")
        return F.when((offset >= 1) & (offset < F.length("aligned")), F.expr(f"substr(aligned, CAST({at} - start AS INT), 1)"))

    seen = hits.select(*keys, "qname", F.struct("ordinal", F.col("aligned").isNull().alias("bad"), base("dnm_pos").alias("d"), base("hap_pos").alias("h")).alias("a"))
    reads_of = seen.groupBy(*keys, "qname").agg(F.array_sort(F.collect_list("a")).alias("a"))

    def step(acc: Column, x: Column) -> Column:
        d, h = F.coalesce(x["d"], acc["d"]), F.coalesce(x["h"], acc["h"])
        new = F.when(d.isNotNull() & h.isNotNull(), F.array(F.concat(d, h))).otherwise(F.array().cast("array<string>"))
        return F.struct(d.alias("d"), h.alias("h"), F.concat(acc["out"], new).alias("out"))

    none = F.struct(F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("h"), F.array().cast("array<string>").alias("out"))
    told = reads_of.select(*keys, F.exists("a", lambda x: x["bad"]).alias("bad"), F.aggregate("a", none, step, lambda acc: acc["out"]).alias("bases"))
    counted = told.select(*keys, "bad", F.explode_outer("bases").alias("b")).groupBy(*keys, "b").agg(F.count("b").alias("n"), F.max("bad").alias("bad"))
    broken = counted.where("bad").select(*keys[:3]).distinct()
    good = counted.where("b IS NOT NULL").join(broken, keys[:3], "left_anti")
    return good.select(*keys, F.substring("b", 1, 1).alias("dnm_base"), F.substring("b", 2, 1).alias("hap_base"), "n")


def parent_of_origin(variant: Column, dnm_base: Column, hap_base: Column, gt1: Column, gt2: Column) -> Column:
    """p1, p2 or N/A: whose genotype alone has the phasing base; a homozygous genotype of that base settles it."""
    mine, yours = (F.when(variant == dnm_base, x).otherwise(y) for x, y in (("p1", "p2"), ("p2", "p1")))
    all_ = lambda g: g == F.concat(hap_base, hap_base)
    has = lambda g: F.substring(g, 1, 2).contains(hap_base)
    return F.when(all_(F.substring(gt1, 1, 2)), mine).when(all_(F.substring(gt2, 1, 2)), yours).when(has(gt1) & ~has(gt2), mine).when(has(gt2) & ~has(gt1), yours).otherwise(F.lit("N/A"))


def phase(mutations: DataFrame, sites: DataFrame, reads: DataFrame, window: int = 1000) -> DataFrame:
    """(contig, dnm_pos, hap_pos, dnm_base, hap_base, n, parent) of all mutations; n is 0 and the rest null without reads."""
    counts = pair_counts(informative_sites(mutations, sites, window), reads, window)
    told = counts.withColumn("parent", parent_of_origin(F.col("variant"), F.col("dnm_base"), F.col("hap_base"), F.col("gt_p1"), F.col("gt_p2")))
    all_ = mutations.select("contig", F.col("pos").alias("dnm_pos")).distinct()
    out = all_.join(told, ["contig", "dnm_pos"], "left")
    return out.select("contig", "dnm_pos", "hap_pos", "dnm_base", "hap_base", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "parent")
