"""Queries over single functions, sources and filters, on rows made from the driver's tables; each with SQL that tells the same."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genome as G
from ..functions import pedigree as P
from ..functions import text as X
from ..operators import alignment, calling, denovo, lineage, pedigree_calling, pileup
from ..sources import tables, variants
from . import derived, views
from . import oracles as O


def _part(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("k"))


def _each(df: DataFrame, make, schema: str) -> DataFrame:
    """A plain function over the rows (k, x), a batch at a time."""

    def work(frames):
        for f in frames:
            yield pd.DataFrame([(k, *make(x)) for k, x in zip(f["k"], f["x"], strict=True)], columns=[c.split()[0] for c in ("k long, " + schema).split(", ")])

    return df.mapInPandas(work, "k long, " + schema)


def _place(spark: SparkSession) -> str:
    """A new path that all tasks see."""
    alone = spark.sparkContext.master.split("[")[0] == "local"
    folder = spark.conf.get("spark.checkpoint.dir", None) or (os.path.join(tempfile.gettempdir(), "kinfold-files") if alone else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{folder}/{uuid.uuid4().hex}"


def _written(lines: DataFrame, path: str) -> str:
    lines.write.text(path)
    return path


def _rounded(calls: DataFrame, site) -> DataFrame:
    return calls.select(site.alias("site"), F.round("qual", 3).alias("qual"), F.round("mutx", 5).alias("mutx"), F.round("lls", 4).alias("lls"), F.round("llh", 4).alias("llh"))


def trio_statistics(spark, folder):
    return _rounded(calling.trio_calls(pileup.trio_depths(derived._filtered(spark, folder))), F.col("site"))


def pedigree_statistics(spark, folder):
    calls = pedigree_calling.call(derived._sites(spark, folder), derived._graph("autosomal"), derived.LIBRARIES, least=0.0, everything=True)
    return _rounded(calls, F.col("pos").cast("long"))


def pedigree_call_filtered(spark, folder):
    """Sites that pass the quality and mutation filters."""
    calls = pedigree_calling.call(derived._sites(spark, folder), derived._graph("autosomal"), derived.LIBRARIES, least=0.5)
    return calls.select(F.col("pos").cast("long").alias("site"), F.col("dp").cast("long").alias("dp"), "denovo")


def pedigree_genotypes(spark, folder):
    """The likeliest genotypes of the three and their posterior."""
    graph = derived._graph("autosomal")
    calls = pedigree_calling.call(derived._sites(spark, folder), graph, derived.LIBRARIES, least=0.0, everything=True)
    at = {who: next(i for i, v in enumerate(graph.nodes) if v.label == f"LB/{who}") for who in derived.LIBRARIES}
    cells = [c for who, i in at.items() for c in (F.get("gt", F.lit(i)).alias(f"{who}_gt"), F.round(F.array_max(F.get("gp", F.lit(i))), 4).alias(f"{who}_gp"))]
    return calls.select(F.col("pos").cast("long").alias("site"), *cells)


THREE = "##PEDNG\ngf . . 1 dad\ngm . . 2 .\nmo . . 2 mom\nf gf gm 1 .\nk f mo 2 child\n"


def pedigree_three_generations(spark, folder):
    """Grandfather, mother and child are read; the grandmother and the father aren't."""
    graph = P.build(X.parse_pedigree(THREE), [(x, x) for x in derived.LIBRARIES], "autosomal")
    calls = pedigree_calling.call(derived._sites(spark, folder), graph, derived.LIBRARIES, least=0.0, everything=True)
    return calls.select(F.col("pos").cast("long").alias("site"), F.round("mutq", 3).alias("mutq"), F.round("lld", 4).alias("lld"), F.round("llh", 4).alias("llh"), F.round("dnp", 5).alias("dnp"), F.round("mutx", 5).alias("mutx"))


_TREE = ((0, 1), 2)


def tree_score(spark, folder):
    """Score of one tree of the three libraries over all sites."""
    return lineage.score_trees(_depth_pl(spark, folder), [_TREE], 20.0, 30.0).select("tree", F.round("score", 3).alias("score"))


def tree_placements(spark, folder):
    """Of each site, the chance that it didn't mutate along the tree and that it did once."""
    sites = _depth_pl(spark, folder).select(F.lit("1").alias("contig"), F.col("site").cast("int").alias("pos"), F.lit("A").alias("ref"), "pl")
    return lineage.placements(sites, _TREE, ["dad", "child", "mom"], 20.0, 30.0).select("pos", F.round("null_p", 5).alias("null_p"), F.round("mut_p", 5).alias("mut_p"))


def dnm_trio_snp_xd(spark, folder):
    return denovo.trio_snps(derived._likelihoods(spark, folder, 10), "XD", cutoff=-1.0).select("vec_id", F.round(F.log10("pp_dnm"), 4).alias("pp"), F.round(F.log10("null_like"), 4).alias("null_like"))


def dnm_trio_snp_found(spark, folder):
    return denovo.trio_snps(derived._likelihoods(spark, folder, 10)).select("vec_id", F.round(F.log10("pp_dnm"), 4).alias("pp"), F.round(F.log10("null_like"), 4).alias("null_like"))


def dnm_counters(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    return denovo.counters(e.select(*((F.col("vec_id") % m).alias(f"{w}_dp") for w, m in (("child", 17), ("mom", 23), ("dad", 31)))))


def dnm_members(spark, folder):
    """Sites of three samples for the trios of a pedigree, one of which lacks a member."""
    sites = _part(spark, folder).select("k", F.map_from_arrays(F.array(F.lit("K"), F.lit("D"), F.lit("M")), F.array(*(F.struct(F.array((F.col("k") % m).cast("int")).alias("pl"), (F.col("k") % (m + 3)).cast("int").alias("dp")) for m in (5, 7, 11)))).alias("cells"))
    trios = spark.createDataFrame([("K", "D", "M"), ("K", "M", "D"), ("K", "D", "other")], "child string, dad string, mom string")
    return denovo.trio_members(sites, trios).select("k", "child", "dad", "mom", F.get("child_pl", F.lit(0)).alias("child_pl"), F.get("dad_pl", F.lit(0)).alias("dad_pl"), F.get("mom_pl", F.lit(0)).alias("mom_pl"), "child_dp", "dad_dp", "mom_dp")


def dnm_site_codes(spark, folder):
    """Sites with every kind of fault, for a trio that has all members and one that hasn't."""
    k = F.col("k")
    pl = F.when(k % 7 == 0, F.lit(None).cast("array<int>")).otherwise(F.array(F.lit(1)))
    cells = F.map_from_arrays(F.when(k % 4 == 0, F.array(F.lit("K"), F.lit("D"))).otherwise(F.array(F.lit("K"), F.lit("D"), F.lit("M"))), F.when(k % 4 == 0, F.array(*(F.struct(pl.alias("pl")) for _ in range(2)))).otherwise(F.array(*(F.struct(pl.alias("pl")) for _ in range(3)))))
    sites = _part(spark, folder).select("k", F.when(k % 5 == 0, "N").otherwise("aT").alias("ref"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("C"))).alias("alts"), cells.alias("cells"))
    trios = spark.createDataFrame([("K", "D", "M"), ("K", "X", "Y")], "child string, dad string, mom string")
    return denovo.site_codes(sites, trios).select("k", F.col("trio.dad").alias("dad"), "code", F.coalesce("message", F.lit("")).alias("message"))


def _cigars(spark, folder):
    n = lambda a, b: (F.col("k") % a + b).cast("string")
    return _part(spark, folder).select("k", F.concat(n(5, 1), F.lit("S"), n(40, 1), F.lit("M"), n(3, 1), F.lit("D"), n(7, 1), F.lit("="), n(4, 1), F.lit("I"), n(6, 1), F.lit("N"), n(9, 1), F.lit("X"), n(2, 1), F.lit("H")).alias("x"))


_CIGAR_SQL = "c AS (SELECT p_partkey AS k, p_partkey % 5 + 1 AS s, p_partkey % 40 + 1 AS m, p_partkey % 3 + 1 AS d, p_partkey % 7 + 1 AS e, p_partkey % 4 + 1 AS i, p_partkey % 6 + 1 AS n, p_partkey % 9 + 1 AS x FROM part)"


def cigar_lengths(spark, folder):
    c = _cigars(spark, folder).withColumn("runs", alignment.aligned_runs(F.col("x")))
    last = F.element_at("runs", -1)
    return c.select("k", alignment.query_length(F.col("x")).alias("query"), alignment.target_length(F.col("x")).alias("target"), F.size("runs").alias("runs"), last["target"].alias("last_target"), last["query"].alias("last_query"))


def cigar_positions(spark, folder):
    """Of the place 30 bases right of the alignment's start: where in the read it is, and whether it is deleted."""
    return _each(_cigars(spark, folder), lambda x: X.query_position(x, 30), "at long, deleted boolean")


def aligned_bases(spark, folder):
    """Reads of 8 bases, of which one is deleted and one inserted, counted by place and base."""
    k = F.col("k")
    r = _part(spark, folder).select(F.lit("1").alias("contig"), (k % 50 + 1).cast("int").alias("pos"), F.when(k % 3 == 0, "a").otherwise("b").alias("rg"), F.lit("ACGTNACG").alias("seq"), F.lit("IIII!III").alias("qual"), F.lit("2S2M1D2M1I1M").alias("cigar"), (k % 61).cast("int").alias("mapq"), F.when(k % 11 == 0, 1024).when(k % 2 == 0, 16).otherwise(0).alias("flag"))
    b = alignment.with_libraries(alignment.bases(r, least_mapq=10), {"a": ("L1", "S1")})
    return b.groupBy("library", "pos", "base").agg(F.count("*").alias("n"), F.sum(F.col("is_rev").cast("int")).alias("rev"), F.sum("read_pos").alias("read_pos"))


def region_text(spark, folder):
    """Regions written in four ways, read as half-open ranges."""
    k = F.col("id")
    name, beg, end = F.concat(F.lit("c"), F.col("contig").cast("string")), F.col("beg") + 1, F.col("end")
    text = F.when(k % 4 == 0, F.concat(name, F.lit(":"), beg, F.lit("-"), end)).when(k % 4 == 1, F.concat(name, F.lit(":"), beg, F.lit("+"), end - F.col("beg"))).when(k % 4 == 2, F.concat(name, F.lit(":"), beg, F.lit("-"))).otherwise(F.concat(name, F.lit(":-"), end))
    contigs = {f"c{i}": 150_000 for i in range(20)}
    return _each(views.ranges(spark, folder).select(k.alias("k"), text.alias("x")), lambda x: X.region_ranges(X.parse_regions(x), contigs)[0], "contig long, beg long, end long")


def file_types(spark, folder):
    ext = F.element_at(F.array(*map(F.lit, ("vcf", "bcf", "bam", "sam", "cram", "ped"))), (F.col("k") % 6 + 1).cast("int"))
    packed = F.when(F.col("k") % 5 == 0, ".gz").when(F.col("k") % 5 == 1, ".bgz").otherwise("")
    path = F.when(F.col("k") % 7 == 0, F.concat(ext, packed, F.lit(":dir.d/file.txt"))).otherwise(F.concat(F.lit("dir.d/file"), F.col("k"), F.lit("."), ext, packed))
    return _each(_part(spark, folder).select("k", path.alias("x")), lambda x: (*X.file_type(x)[1:], X.file_category(X.file_type(x)[1])), "ext string, packed string, category string")


def sex_and_inheritance(spark, folder):
    """Names and prefixes of them, in any case."""
    sex = F.element_at(F.array(*map(F.lit, ("1", "MALE", "m", "2", "Fem", "0", "auto"))), (F.col("k") % 7 + 1).cast("int"))
    model = F.element_at(F.array(*map(F.lit, ("autosomal", "X-linked", "xlinked", "Y", "w-l", "mitochondrial", "mat", "P-linked", "z"))), (F.col("k") % 9 + 1).cast("int"))
    return _each(_part(spark, folder).select("k", F.concat(sex, F.lit(" "), model).alias("x")), lambda x: (X.parse_sex(x.split()[0]), X.parse_inheritance(x.split()[1])), "sex string, model string")


def newick_trees(spark, folder):
    k = F.col("k")
    text = F.concat(F.lit("((a:"), (k % 5).cast("string"), F.lit(",'b''s':0.5)x:"), (k % 3).cast("string"), F.lit(".25,c:1e1);"))

    def read(x):
        t = X.parse_newick(x)
        again = X.parse_newick(X.write_newick(t).replace("b's", "'b''s'"))
        return len(t.leaves()), sum(n.length for n in t.walk()) - t.length, ",".join(again.leaves())

    return _each(_part(spark, folder).select("k", text.alias("x")), read, "leaves long, length double, names string")


def pedigree_rows(spark, folder):
    k = F.col("k").cast("string")
    text = F.concat(F.lit("##PEDNG\n# none\nm%20"), k, F.lit("@tag . . female =\nd . . 1 .\nchild d:0."), (F.col("k") % 10).cast("string"), F.lit(" m%20"), k, F.lit(":2 0 lib1 lib2\n"))

    def read(x):
        m, d, child = X.parse_pedigree(x)
        return m.name, ",".join(m.tags + m.samples), m.sex + "," + d.sex + "," + child.sex, child.dad_length, child.mom_length, child.mom, len(child.samples)

    return _each(_part(spark, folder).select("k", text.alias("x")), read, "name string, labels string, sexes string, dad_length double, mom_length double, mom string, samples long")


def pedigree_models(spark, folder):
    """Which founders and families a trio has under each model."""
    rows = []
    for k, model in enumerate(("autosomal", "x-linked", "y-linked", "maternal", "paternal")):
        graph = derived._graph(model)
        rows.append((k, model, sum(not v.ups for v in graph.nodes), max(v.ploidy for v in graph.nodes), sum(v.kind == "library" for v in graph.nodes)))
    return spark.createDataFrame(rows, "k int, model string, roots int, ploidy int, libraries int")


def site_tests(spark, folder):
    """Mapping quality and strand test of the sites; reads have no place, so the linenumber stands for it."""
    out = pileup.site_tests(derived._filtered(spark, folder).withColumn("read_pos", F.col("base_qual") % 7))
    return out.select("site", F.round("mq", 6).alias("mq"), F.round("fs", 5).alias("fs"))


def site_ranks(spark, folder):
    """Rank tests of the sites' mapping and base qualities; null without both kinds of reads or with fewer than 4."""
    out = pileup.site_tests(derived._filtered(spark, folder).withColumn("read_pos", F.col("base_qual") % 7))
    return out.select("site", F.round("mqta", 4).alias("mqta"), F.round("rpta", 4).alias("rpta"), F.round("bqta", 4).alias("bqta"))


def phred_family(spark, folder):
    p = (F.col("k") + 1) / F.lit(1000000.0)
    q = (F.col("k") % 97).cast("double")
    return _part(spark, folder).select("k", (-F.round(-G.phred(p), 6)).alias("phred"), F.round(G.phred1m(p), 9).alias("phred1m"), F.round(G.unphred(q), 9).alias("unphred"), F.round(G.unphred1m(q), 9).alias("unphred1m"), G.rounded_phred(p, 40).alias("rounded"), G.rounded_phred1m(p, 1).alias("rounded1m"))


def substitutions(spark, folder):
    base = lambda m: F.substring(F.lit("ACGTN"), 1, 5).substr((F.col("k") % m[0] % 5 + 1).cast("int"), F.lit(1)) if m[1] else None
    two = lambda a, b: F.concat(base((a, 1)), base((b, 1)))
    d = _part(spark, folder).select("k", two(7, 11).alias("a"), two(7, 13).alias("b"))
    changed = G.changed_bases(F.col("a"), F.col("b"))
    return d.select("k", changed["from"].alias("was"), changed["to"].alias("is"), G.substitution(changed["from"], changed["to"]).alias("kind"), G.base_index(F.substring("b", 2, 1)).alias("code"))


def i16_fields(spark, folder):
    i16 = F.array(*((F.col("k") * (i + 3) % (11 + i)).cast("double") for i in range(16)))
    return _part(spark, folder).select("k", denovo.i16_depth(i16).alias("depth"), F.coalesce(denovo.i16_mapq(i16), F.lit(-1)).alias("mapq"))


def clean_alts(spark, folder):
    alt = F.element_at(F.array(*map(F.lit, ("T", "T,X", "X", "A,N,G", "A,C", "C,X,X"))), (F.col("k") % 6 + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ("GL/a", "LB/b/c", "plain", "SM/x"))), (F.col("k") % 4 + 1).cast("int"))
    return _part(spark, folder).select("k", denovo.clean_alt(alt).alias("alt"), G.trim_label(label).alias("label"))


def split_depths(spark, folder):
    pl = lambda m: F.array((F.col("k") % m).cast("int"), F.lit(5), F.lit(9))
    d = _part(spark, folder).select("k", denovo.split_depth((F.col("k") % 50).cast("int"), F.array(pl(2), pl(3), pl(5))).alias("d"))
    return d.select("k", *(F.get("d", F.lit(i)).alias(f"d{i}") for i in range(3)))


def kept_reads(spark, folder):
    flag = (F.col("k") % 4096).cast("int")
    return _part(spark, folder).where(G.keeps_read(flag, (F.col("k") % 60).cast("int"), 20))


def genotype_texts(spark, folder):
    gt = F.element_at(F.array(*map(F.lit, ("0/0", "0|1", "1/0:35", "1|1", "./.", "0/2"))), (F.col("k") % 6 + 1).cast("int"))
    return _part(spark, folder).select("k", variants.genotype_bases(F.lit("G"), F.lit("T"), gt).alias("gt"))


def _depth_pl(spark, folder):
    d = pileup.trio_depths(derived._filtered(spark, folder))
    pl = lambda w: F.array(F.col(f"{w}_alt") * 20.0, (F.col(f"{w}_ref") + F.col(f"{w}_alt")) * 3.0, F.col(f"{w}_ref") * 20.0)
    return d.select("site", F.array(*map(pl, derived.LIBRARIES)).alias("pl"))


def sample_distances(spark, folder):
    """Of each two libraries, over the sites, the chance that their genotypes differ."""
    d = lineage.distances(_depth_pl(spark, folder))
    return spark.createDataFrame([(i, j, round(float(d[i, j]), 4)) for i in range(len(d)) for j in range(i)], "a int, b int, distance double")


def two_of_four(spark, folder):
    """Likelihoods of the two deepest alleles' genotypes."""
    pl = F.array(*((F.col("k") * (i + 3) % 89).cast("int") for i in range(10)))
    alleles = F.array((F.col("k") % 4).cast("int"), ((F.col("k") + 1 + F.col("k") % 3) % 4).cast("int"))
    out = lineage.three_genotypes(F.array(pl), alleles)
    return _part(spark, folder).select("k", *(F.get(F.get(out, F.lit(0)), F.lit(i)).alias(f"pl{i}") for i in range(3)))


def vcf_depths(spark, folder):
    """Sites written as VCF text and read again; those with an indel or without AD are left out."""
    k = F.col("k")
    ad = lambda m: F.when(k % m == 0, F.lit(".")).otherwise(F.concat((k % m).cast("string"), F.lit(","), (k % (m + 2)).cast("string")))
    alt = F.when(k % 10 == 3, "GA").otherwise("t")
    form = F.when(k % 10 == 7, "GT").otherwise("GT:AD")
    line = F.concat_ws("\t", F.lit("1"), k.cast("string"), F.lit("."), F.lit("g"), alt, F.lit("9.5"), F.lit("PASS"), F.concat(F.lit("DB;DP="), (k % 77).cast("string"), F.lit(",x")), form, F.concat(F.lit("0/1:"), ad(5)), F.concat(F.lit("0/0:"), ad(9)))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb",)], "value string")
    path = _written(head.union(_part(spark, folder).select(line)), _place(spark) + ".vcf")
    read = variants.allele_depths(variants.read_vcf(spark, path))
    cell = lambda i, j: F.get(F.get("ad", F.lit(i)), F.lit(j)).alias(f"ad{i}{j}")
    return read.select("pos", "ref", F.array_join("alts", ",").alias("alt"), "qual", F.get(variants.info_ints("DP"), F.lit(0)).alias("dp"), F.get(variants.info_ints("DP"), F.lit(1)).alias("dp2"), *(cell(i, j) for i in range(2) for j in range(2)))


def _variant_file(spark, folder, m: int) -> DataFrame:
    """Records of every m-th place, written and read again."""
    k = F.col("k")
    gt = F.element_at(F.array(*map(F.lit, ("0/1", "1|0", "./.", "0"))), (k % 4 + 1).cast("int"))
    line = F.concat_ws("\t", F.lit("1"), k.cast("string"), F.lit("."), F.lit("G"), F.when(k % 15 == 0, "GA").when(k % m == 0, "T").otherwise("C"), F.lit("."), F.lit("."), F.concat(F.lit("AF=0."), (k % 9).cast("string")), F.lit("GT:GQ"), F.concat(gt, F.lit(":"), (k % 7).cast("string"), F.lit(".5")))
    head = spark.createDataFrame([("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta",)], "value string")
    return variants.read_vcf(spark, _written(head.union(_part(spark, folder).where(k % m < 2).select(line)), _place(spark) + ".vcf"))


def vcf_getters(spark, folder):
    first = F.get(variants.genotypes(), F.lit(0))
    return _variant_file(spark, folder, 3).select("pos", F.get(variants.info_numbers("AF"), F.lit(0)).alias("af"), F.get(F.get(variants.format_numbers("GQ"), F.lit(0)), F.lit(0)).alias("gq"), F.array_join(first["alleles"].cast("array<string>"), ",", "?").alias("gt"), first["phased"].alias("phased"))


def _in_step(collapse: str):
    def query(spark, folder):
        both = variants.in_step([_variant_file(spark, folder, 3), _variant_file(spark, folder, 5)], collapse)
        alt = lambda i: F.coalesce(F.element_at(F.col(f"f{i}.alts"), 1), F.lit("-")).alias(f"alt{i}")
        return both.select("pos", alt(0), alt(1))

    query.__name__ = f"vcf_in_step_{collapse}"
    return query


def bed_rows(spark, folder):
    r = views.ranges(spark, folder)
    lines = r.select(F.concat_ws("\t", F.concat(F.lit("c"), "contig"), "beg", "end", F.lit("name")))
    path = _written(spark.createDataFrame([("# a comment",), ("",)], "value string").union(lines), _place(spark) + ".bed")
    return tables.read_bed(spark, path)


def genotype_call_rows(spark, folder):
    """Calls of genotypes along a lineage, written and read again."""
    k = F.col("k")
    text = lambda x: x.cast("string")
    line = F.concat_ws("\t", F.lit("c1"), text(k), F.lit("A"), F.lit("0.25"), F.concat(F.lit("1e-0"), text(k % 9)), F.lit("RR"), F.lit("0.5"), F.lit("RR"), F.lit("RA"), F.lit("0.125"), text(k % 4), F.concat(F.lit("s"), text(k % 3), F.lit(",s9")))
    head = spark.createDataFrame([("\t".join(x.split()[0] for x in tables.GENOTYPE_CALLS.split(", ")),)], "value string")
    read = tables.read_genotype_calls(spark, _written(head.union(_part(spark, folder).select(line)), _place(spark) + ".txt"))
    return read.select("contig", "pos", F.round(-F.log10("mut_p"), 6).alias("mut_q"), "null_base", "mut_alt", "mut_loc", "mut_smpl")


def mutation_rows(spark, folder):
    k = F.col("k")
    path = _written(_part(spark, folder).select(F.concat_ws("\t", F.lit("1"), k, F.lit("A"), F.when(k % 2 == 0, "C").otherwise("T"))), _place(spark) + ".txt")
    return tables.read_mutations(spark, path)


def reference_sites(spark, folder):
    """Bases at places of a sequence of 1,000 lines; beyond its end N."""
    lines = spark.range(1000).coalesce(1).orderBy("id").select(F.substring(F.lit("ACGTTGCAACGTACGTTGCA"), 1, 20).alias("value"))
    path = _written(spark.createDataFrame([(">1 text with > inside",)], "value string").union(lines).coalesce(1), _place(spark) + ".fa")
    sites = _part(spark, folder).select(F.lit("1").alias("contig"), (F.col("k") * 37 % 21000 + 1).alias("pos"), "k")
    return tables.reference_bases(sites, tables.read_fasta(spark, path, 4096), 4096).select("k", "pos", "ref_base")


QUERIES = (trio_statistics, pedigree_statistics, pedigree_call_filtered, pedigree_genotypes, pedigree_three_generations, tree_score, tree_placements, dnm_trio_snp_xd, dnm_trio_snp_found, dnm_counters, dnm_members, dnm_site_codes, cigar_lengths, cigar_positions, aligned_bases, region_text, file_types, sex_and_inheritance, newick_trees, pedigree_rows, pedigree_models, site_tests, site_ranks, phred_family, substitutions, i16_fields, clean_alts, split_depths, kept_reads, genotype_texts, sample_distances, two_of_four, vcf_depths, vcf_getters, *map(_in_step, variants.COLLAPSE), bed_rows, genotype_call_rows, mutation_rows, reference_sites)


def oracle_sql(with_f: str, reads: str, depths: str) -> dict[str, str]:
    trio = O.trio(reads, depths)
    stats = trio + " SELECT site, round(qual, 3) AS qual, round(mutx, 5) AS mutx, round(lls, 4) AS lls, round(llh, 4) AS llh FROM t"
    g = f"WITH g AS ({views.RANGES_SQL})"
    gt = "CASE {} WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END"
    best = lambda who, col: f"b{col} AS (SELECT site, arg_max({col}, p) AS top, max(p) / sum(p) AS share FROM (SELECT site, {col}, sum(p_all * ex) AS p FROM z GROUP BY site, {col}) GROUP BY site)"
    lf = lambda x: f"lgamma({x} + 1)"
    weight = lambda x: f"-({lf(x)} + {lf(f'r1 - {x}')} + {lf(f'c1 - {x}')} + {lf(f'r2 - c1 + {x}')})"
    pick = lambda texts, m, k="p_partkey": f"[{', '.join(repr(x) for x in texts)}][CAST({k} % {m} + 1 AS INT)]"
    one = lambda m: f"SELECT CAST(p_partkey AS INT) AS pos, CASE WHEN p_partkey % 15 = 0 THEN 'GA' WHEN p_partkey % {m} = 0 THEN 'T' ELSE 'C' END AS alt FROM part WHERE p_partkey % {m} < 2"
    step = f"WITH a AS ({one(3)}), b AS ({one(5)}) SELECT coalesce(a.pos, b.pos) AS pos, coalesce(a.alt, '-') AS alt0, coalesce(b.alt, '-') AS alt1 FROM a FULL JOIN b ON a.pos = b.pos AND {{}}"
    pl = lambda w: f"[pow(10, -2 * {w}_alt), pow(10, -0.3 * ({w}_ref + {w}_alt)), pow(10, -2 * {w}_ref)]"
    near = lambda x, y: f"sum(1 - list_dot_product({x}, {y}) / (list_sum({x}) * list_sum({y})))"
    at = lambda x, y: f"CAST((greatest({x}, {y}) * (greatest({x}, {y}) + 1) // 2 + least({x}, {y})) AS BIGINT)"
    return {
        "trio_statistics": stats,
        "pedigree_statistics": stats,
        "pedigree_call_filtered": trio + " SELECT site, dp, true AS denovo FROM t WHERE qual >= 0.5 AND mutq >= 0.5",
        "pedigree_genotypes": trio + f", {best('dad', 'd')}, {best('mom', 'm')}, {best('child', 'c')} SELECT bd.site, " + ", ".join(f"{gt.format(f'b{c}.top')} AS {w}_gt, round(b{c}.share, 4) AS {w}_gp" for w, c in (("dad", "d"), ("child", "c"), ("mom", "m"))) + " FROM bd JOIN bm ON bm.site = bd.site JOIN bc ON bc.site = bd.site",
        "pedigree_three_generations": O.trio(reads, depths, generations=3) + " SELECT site, round(mutq, 3) AS mutq, round(lld, 4) AS lld, round(llh, 4) AS llh, round(dnp, 5) AS dnp, round(mutx, 5) AS mutx FROM t",
        "tree_score": O.tree(depths, reads, "SELECT 0 AS tree, round(sum(-10 * log10(none + one)), 3) AS score FROM t"),
        "tree_placements": O.tree(depths, reads, "SELECT CAST(site AS INT) AS pos, round(none / every, 5) AS null_p, round(one / every, 5) AS mut_p FROM t"),
        "dnm_trio_snp_xd": O.snp("XD"),
        "dnm_trio_snp_found": O.snp("auto", 1e-4),
        "dnm_counters": "SELECT count(*) AS interrogated, CAST(sum(CASE WHEN vec_id % 17 >= 10 AND vec_id % 23 >= 10 AND vec_id % 31 >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS passing FROM embeddings",
        "dnm_members": "SELECT p_partkey AS k, 'K' AS child, dad, mom, CAST(p_partkey % 5 AS INT) AS child_pl, CAST(p_partkey % d AS INT) AS dad_pl, CAST(p_partkey % m AS INT) AS mom_pl, CAST(p_partkey % 8 AS INT) AS child_dp, CAST(p_partkey % (d + 3) AS INT) AS dad_dp, CAST(p_partkey % (m + 3) AS INT) AS mom_dp FROM part, (VALUES ('D', 'M', 7, 11), ('M', 'D', 11, 7)) t(dad, mom, d, m)",
        "dnm_site_codes": "WITH c AS (SELECT p_partkey AS k, dad, CASE WHEN p_partkey % 7 = 0 THEN -6 WHEN p_partkey % 5 = 0 THEN 10 WHEN p_partkey % 3 = 0 THEN -11 WHEN dad = 'X' THEN -2 WHEN p_partkey % 4 = 0 THEN -1 ELSE 0 END AS code FROM part, (VALUES ('D'), ('X')) t(dad)) SELECT k, dad, CAST(code AS INT) AS code, CASE code WHEN -6 THEN 'PL is missing' WHEN 10 THEN 'the reference is no base' WHEN -11 THEN 'there is no other allele' WHEN 0 THEN '' ELSE 'members missing: ' || -code END AS message FROM c",
        "cigar_lengths": f"WITH {_CIGAR_SQL} SELECT k, CAST(s + m + e + i + x AS INT) AS query, CAST(m + d + e + n + x AS INT) AS target, 3 AS runs, CAST(m + d + e + n AS INT) AS last_target, CAST(s + m + e + i AS INT) AS last_query FROM c",
        "cigar_positions": f"WITH {_CIGAR_SQL} SELECT k, CAST(CASE WHEN 30 < m THEN s + 30 WHEN 30 < m + d THEN s + m WHEN 30 < m + d + e THEN s + 30 - d WHEN 30 < m + d + e + n THEN s + m + e + i WHEN 30 < m + d + e + n + x THEN s + 30 - d - n + i ELSE s + m + e + i + x END AS BIGINT) AS at, (30 >= m AND 30 < m + d) OR (30 >= m + d + e AND 30 < m + d + e + n) AS deleted FROM c",
        "aligned_bases": "SELECT 'L1' AS library, CAST(p_partkey % 50 + 1 + o AS INT) AS pos, CAST(base AS INT) AS base, count(*) AS n, CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rev, CAST(sum(q) AS BIGINT) AS read_pos FROM part, (VALUES (0, 2, 2), (1, 3, 3), (4, 0, 5), (5, 2, 7)) v(o, base, q) WHERE p_partkey % 3 = 0 AND p_partkey % 61 >= 10 AND p_partkey % 11 <> 0 GROUP BY ALL",
        "region_text": g + ' SELECT id AS k, CAST(contig AS BIGINT) AS contig, CASE WHEN id % 4 = 3 THEN 0 ELSE beg END AS beg, CASE WHEN id % 4 = 2 THEN 150000 ELSE "end" END AS "end" FROM g',
        "file_types": f"SELECT p_partkey AS k, {pick(('vcf', 'bcf', 'bam', 'sam', 'cram', 'ped'), 6)} AS ext, CASE p_partkey % 5 WHEN 0 THEN 'gz' WHEN 1 THEN 'bgz' ELSE '' END AS packed, {pick(('variant', 'variant', 'sequence', 'sequence', 'sequence', 'pedigree'), 6)} AS category FROM part",
        "sex_and_inheritance": f"SELECT p_partkey AS k, {pick(('male', 'male', 'male', 'female', 'female', 'autosomal', 'autosomal'), 7)} AS sex, {pick(('autosomal', 'x-linked', 'x-linked', 'y-linked', 'w-linked', 'maternal', 'maternal', 'paternal', 'z-linked'), 9)} AS model FROM part",
        "newick_trees": "SELECT p_partkey AS k, 3 AS leaves, CAST(p_partkey % 5 + 0.5 + p_partkey % 3 + 0.25 + 10 AS DOUBLE) AS length, 'a,b''s,c' AS names FROM part",
        "pedigree_rows": "SELECT p_partkey AS k, 'm ' || p_partkey AS name, 'tag,m ' || p_partkey AS labels, 'female,male,autosomal' AS sexes, CAST(p_partkey % 10 AS DOUBLE) / 10 AS dad_length, CAST(2 AS DOUBLE) AS mom_length, 'm ' || p_partkey AS mom, 2 AS samples FROM part",
        "site_tests": f"""{with_f}, m AS (SELECT site, sqrt(sum(map_qual * map_qual) / count(*)) AS mq, CAST(sum(CASE WHEN base = ref_base AND NOT is_rev THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN base <> ref_base AND NOT is_rev THEN 1 ELSE 0 END) AS BIGINT) AS b,
  CAST(sum(CASE WHEN base = ref_base AND is_rev THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN base <> ref_base AND is_rev THEN 1 ELSE 0 END) AS BIGINT) AS d FROM f GROUP BY site),
  n AS (SELECT *, a + b AS r1, c + d AS r2, a + c AS c1 FROM m),
  o AS (SELECT site, any_value(mq) AS mq, any_value(a + c > 0 AND b + d > 0) AS two, sum(CASE WHEN {weight('x')} <= {weight('a')} + 1e-9 THEN exp({weight('x')} - {weight('a')}) ELSE 0 END) / sum(exp({weight('x')} - {weight('a')})) AS p FROM n, LATERAL (SELECT unnest(range(greatest(0, c1 - r2), least(r1, c1) + 1)) AS x) GROUP BY site)
  SELECT site, round(mq, 6) AS mq, CASE WHEN two THEN round(-10 * log10(least(p, 1)) + 0.0, 5) END AS fs FROM o""",
        "site_ranks": f"{with_f} SELECT e.site, round(x.t, 4) AS mqta, round(y.t, 4) AS rpta, round(z.t, 4) AS bqta FROM (SELECT DISTINCT site FROM f) e LEFT JOIN {O.rank_test(reads, 'map_qual')} x ON x.site = e.site LEFT JOIN {O.rank_test(reads, 'base_qual % 7')} y ON y.site = e.site LEFT JOIN {O.rank_test(reads, 'base_qual')} z ON z.site = e.site",
        "phred_family": "SELECT p_partkey AS k, round(-10 * log10(p), 6) AS phred, round(-10 * log10(1 - p), 9) AS phred1m, round(pow(10, -q / 10), 9) AS unphred, round(1 - pow(10, -q / 10), 9) AS unphred1m, CAST(least(round(-10 * log10(p)), 40) AS INT) AS rounded, CAST(least(round(-10 * log10(1 - p)), 1) AS INT) AS rounded1m FROM (SELECT p_partkey, (p_partkey + 1) / 1000000.0 AS p, CAST(p_partkey % 97 AS DOUBLE) AS q FROM part)",
        "substitutions": """WITH b AS (SELECT p_partkey AS k, 'ACGTN'[CAST(p_partkey % 7 % 5 + 1 AS INT)] AS a, 'ACGTN'[CAST(p_partkey % 11 % 5 + 1 AS INT)] AS b, 'ACGTN'[CAST(p_partkey % 13 % 5 + 1 AS INT)] AS d FROM part),
  c AS (SELECT *, CASE WHEN b <> d THEN b END AS was, CASE WHEN b <> d THEN d END AS "is" FROM b)
  SELECT k, was, "is", CASE WHEN was IS NULL OR was = 'N' OR "is" = 'N' THEN NULL WHEN (was IN ('A', 'G')) = ("is" IN ('A', 'G')) THEN 'ts' ELSE 'tv' END AS kind, CAST(instr('ACGTN', d) - 1 AS INT) AS code FROM c""",
        "i16_fields": "WITH v AS (SELECT p_partkey AS k, list_transform(range(16), lambda i: p_partkey * (i + 3) % (11 + i)) AS x FROM part) SELECT k, CAST(x[1] + x[2] + x[3] + x[4] AS INT) AS depth, CASE WHEN x[1] + x[2] + x[3] + x[4] > 0 THEN CAST(floor(sqrt((x[10] + x[12]) / (x[1] + x[2] + x[3] + x[4])) + 0.499) AS INT) ELSE -1 END AS mapq FROM v",
        "clean_alts": f"SELECT p_partkey AS k, {pick(('T', 'T', 'X', 'A,G', 'A,C', 'C,X'), 6)} AS alt, {pick(('a', 'b/c', 'plain', 'x'), 4)} AS label FROM part",
        "split_depths": """WITH a AS (SELECT p_partkey AS k, CAST(p_partkey % 50 AS INT) AS t, CASE WHEN p_partkey % 2 = 0 THEN greatest(1, CAST(floor(p_partkey % 50 / 3.0 + 0.4999) AS INT)) ELSE 0 END AS d0 FROM part),
  b AS (SELECT *, CASE WHEN k % 3 = 0 THEN greatest(1, CAST(trunc((t - d0) / 2.0 + 0.4999) AS INT)) ELSE 0 END AS d1 FROM a)
  SELECT k, d0, d1, CASE WHEN k % 5 = 0 THEN greatest(1, CAST(trunc(t - d0 - d1 + 0.4999) AS INT)) ELSE 0 END AS d2 FROM b""",
        "kept_reads": "SELECT p_partkey AS k FROM part WHERE CAST(p_partkey % 4096 AS INT) & 3844 = 0 AND p_partkey % 60 >= 20",
        "genotype_texts": f"SELECT p_partkey AS k, {pick(('GG', 'GT', 'GT', 'TT', 'NN', 'NN'), 6)} AS gt FROM part",
        "sample_distances": f"WITH {reads}, d AS ({depths}), v AS (SELECT {pl('dad')} AS v0, {pl('child')} AS v1, {pl('mom')} AS v2 FROM d) SELECT a, b, round(distance, 4) AS distance FROM (SELECT 1 AS a, 0 AS b, {near('v1', 'v0')} AS distance FROM v UNION ALL SELECT 2, 0, {near('v2', 'v0')} FROM v UNION ALL SELECT 2, 1, {near('v2', 'v1')} FROM v)",
        "two_of_four": f"SELECT k, {', '.join(f'CAST(k * ({at(x, y)} + 3) % 89 AS INT) AS pl{i}' for i, (x, y) in enumerate((('x', 'x'), ('x', 'y'), ('y', 'y'))))} FROM (SELECT p_partkey AS k, p_partkey % 4 AS x, (p_partkey + 1 + p_partkey % 3) % 4 AS y FROM part)",
        "vcf_depths": "SELECT CAST(p_partkey AS INT) AS pos, 'G' AS ref, 't' AS alt, 9.5::DOUBLE AS qual, CAST(p_partkey % 77 AS INT) AS dp, CAST(NULL AS INT) AS dp2, " + ", ".join(f"CAST(CASE WHEN p_partkey % {m} = 0 THEN 0 ELSE p_partkey % {m + j} END AS INT) AS ad{i}{j // 2}" for i, m in enumerate((5, 9)) for j in (0, 2)) + " FROM part WHERE p_partkey % 10 NOT IN (3, 7)",
        "vcf_getters": f"SELECT CAST(p_partkey AS INT) AS pos, CAST(p_partkey % 9 AS DOUBLE) / 10 AS af, CAST(p_partkey % 7 + 0.5 AS DOUBLE) AS gq, {pick(('0,1', '1,0', '?,?', '0'), 4)} AS gt, p_partkey % 4 = 1 AS phased FROM part WHERE p_partkey % 3 < 2",
        **{f"vcf_in_step_{c}": step.format(join) for c, join in (("none", "a.alt = b.alt"), ("any", "true"), ("snps", "(a.alt = b.alt OR a.alt <> 'GA' AND b.alt <> 'GA')"), ("indels", "a.alt = b.alt"), ("both", "(a.alt = 'GA') = (b.alt = 'GA')"))},
        "bed_rows": g + ' SELECT \'c\' || contig AS contig, beg, "end" FROM g',
        "genotype_call_rows": "SELECT 'c1' AS contig, CAST(p_partkey AS INT) AS pos, CAST(p_partkey % 9 AS DOUBLE) AS mut_q, 'RR' AS null_base, 'RA' AS mut_alt, CAST(p_partkey % 4 AS INT) AS mut_loc, 's' || p_partkey % 3 || ',s9' AS mut_smpl FROM part",
        "mutation_rows": "SELECT '1' AS contig, p_partkey AS pos, 'A' AS inherited, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'T' END AS variant FROM part",
        "reference_sites": "SELECT k, pos, CASE WHEN pos > 20000 THEN 'N' ELSE 'ACGTTGCAACGTACGTTGCA'[CAST((pos - 1) % 20 + 1 AS INT)] END AS ref_base FROM (SELECT p_partkey AS k, p_partkey * 37 % 21000 + 1 AS pos FROM part)",
        "pedigree_models": "SELECT * FROM (VALUES (0, 'autosomal', 2, 2, 3), (1, 'x-linked', 2, 2, 3), (2, 'y-linked', 1, 1, 1), (3, 'maternal', 2, 1, 3), (4, 'paternal', 2, 1, 3)) v(k, model, roots, ploidy, libraries)",
    }
