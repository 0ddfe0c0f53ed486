"""From aligned reads to bases at reference places, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. functions import genome as G


def cigar_runs(cigar: Column) -> Column:
    """Array of (n, op)."""
    ops = "(\\d+)([MIDNSHP=X])"
    return F.zip_with(F.regexp_extract_all(cigar, F.lit(ops), 1), F.regexp_extract_all(cigar, F.lit(ops), 2), lambda n, o: F.struct(n.cast("int").alias("n"), o.alias("op")))


def _sum(cigar: Column, ops: str) -> Column:
    return F.aggregate(cigar_runs(cigar), F.lit(0), lambda acc, r: acc + F.when(F.lit(ops).contains(r["op"]), r["n"]).otherwise(0))


def query_length(cigar: Column) -> Column:
    return _sum(cigar, "MIS=X")


def target_length(cigar: Column) -> Column:
    return _sum(cigar, "MDN=X")


def aligned_runs(cigar: Column) -> Column:
    """Array of (target, query, n): runs of aligned bases with 0-based offsets from the start and in the read."""

    def step(acc: Column, r: Column) -> Column:
        both = r["op"].isin("M", "=", "X")
        run = F.struct(acc["t"].alias("target"), acc["q"].alias("query"), r["n"].alias("n"))
        out = F.when(both, F.concat(acc["out"], F.array(run))).otherwise(acc["out"])
        return F.struct((acc["t"] + F.when(both | r["op"].isin("D", "N"), r["n"]).otherwise(0)).alias("t"), (acc["q"] + F.when(both | r["op"].isin("I", "S"), r["n"]).otherwise(0)).alias("q"), out.alias("out"))

    start = F.struct(F.lit(0).alias("t"), F.lit(0).alias("q"), F.array().cast("array<struct<target:int,query:int,n:int>>").alias("out"))
    return F.aggregate(cigar_runs(cigar), start, step, lambda acc: acc["out"])


def bases(reads: DataFrame, least_mapq: int = 0, least_base_qual: int = 13, least_query: int = 0) -> DataFrame:
    """One row a kept base: contig, pos (1-based), rg, base (0..3), base_qual, map_qual, is_rev, read_pos.

    Reads without a place, not primary, failed or duplicates, of low mapping quality or short go, and bases that are
    deleted, of low quality or not A, C, G, T. A read of n bases makes n rows at most; nothing is shuffled.
    """
    kept = reads.where(G.keeps_read(F.col("flag"), F.col("mapq"), least_mapq) & (query_length(F.col("cigar")) >= least_query))
    runs = kept.select("contig", "pos", "rg", "seq", "qual", F.col("mapq").alias("map_qual"), (F.col("flag").bitwiseAND(16) != 0).alias("is_rev"), F.explode(aligned_runs(F.col("cigar"))).alias("r"))
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("r.n") - 1)))
    at = each.withColumn("read_pos", F.col("r.query") + F.col("k"))
    out = at.select("contig", (F.col("pos") + F.col("r.target") + F.col("k")).alias("pos"), "rg", G.base_index(F.expr("substring(seq, read_pos + 1, 1)")).alias("base"), (F.ascii(F.expr("substring(qual, read_pos + 1, 1)")) - 33).alias("base_qual"), "map_qual", "is_rev", "read_pos")
    return out.where((F.col("base_qual") >= least_base_qual) & (F.col("base") < 4))


def with_libraries(b: DataFrame, groups: dict[str, tuple[str, str]]) -> DataFrame:
    """Bases of the read groups {id: (library, sample)}, with the library; others go. The map is as long as the header's list."""
    lib = F.create_map(*(F.lit(x) for rg, (library, _) in groups.items() for x in (rg, library)))
    return b.withColumn("library", F.try_element_at(lib, "rg")).where("library IS NOT NULL").drop("rg")


def site_depths(b: DataFrame, libraries: list[str]) -> DataFrame:
    """Bases (contig, pos, ref_base, library, base, is_rev) to one row a site: alleles, the reference first, then by depth (ties by
    base), and ad, adf: of each library, in the given order, the depth of each allele, on both strands and forward. One shuffle, partial counts before it."""
    ref = G.base_index(F.col("ref_base"))
    n = len(libraries)
    counts = [F.sum(F.when((F.col("library") == lib) & (F.col("base") == a), 1).otherwise(0)).cast("int") for lib in libraries for a in range(4)]
    forward = [F.sum(F.when((F.col("library") == lib) & (F.col("base") == a) & ~F.col("is_rev"), 1).otherwise(0)).cast("int") for lib in libraries for a in range(4)]
    per = b.where(F.col("library").isin(*libraries)).groupBy("contig", "pos").agg(F.first(ref).alias("ref"), *(c.alias(f"n{i}") for i, c in enumerate(counts)), *(c.alias(f"f{i}") for i, c in enumerate(forward)))
    table = lambda x: F.array(*(F.array(*(F.col(f"{x}{i * 4 + a}") for a in range(4))) for i in range(n)))
    totals = [sum((F.col(f"n{i * 4 + a}") for i in range(1, n)), F.col(f"n{a}")) for a in range(4)]
    ranked = F.array_sort(F.filter(F.array(*(F.struct((F.col("ref") != a).alias("r"), (-totals[a]).alias("d"), F.lit(a).alias("a")) for a in range(4))), lambda x: ~x["r"] | (x["d"] < 0)))
    out = per.select("contig", "pos", F.transform(ranked, lambda x: x["a"]).alias("order"), table("n").alias("t"), table("f").alias("tf"), F.col("ref"))
    # A reference that isn't a base comes first with no depth.
    has = F.col("ref") < 4
    alleles = F.transform("order", lambda a: F.substring(F.lit("ACGT"), 1, 4).substr(a + 1, F.lit(1)))
    ad, adf = (F.transform(t, lambda row: F.transform(F.col("order"), lambda a: F.get(row, a))) for t in ("t", "tf"))
    padded = lambda x: F.when(has, x).otherwise(F.transform(x, lambda v: F.concat(F.array(F.lit(0)), v)))
    return out.select("contig", "pos", F.when(has, alleles).otherwise(F.concat(F.array(F.lit("N")), alleles)).alias("alleles"), padded(ad).alias("ad"), padded(adf).alias("adf"))
