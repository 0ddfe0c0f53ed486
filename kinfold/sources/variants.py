"""VCF text in and out. Compressed files are read whole by one task each; keep large inputs plain or as parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_type

_FIXED = ("contig", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Of the header's last line."""
    row = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    if row is None:
        raise ValueError(f"{path} has no header line")
    return row["value"].rstrip("\r").split("\t")[9:]


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos (null if it is no number), id, ref, alts, alleles, qual, filter, info (map), format, cells (texts of each sample)."""
    kind = file_type(path)[1].lower()
    if kind in ("bcf", "cram"):
        raise ValueError(f"file type '{kind}' is not supported; convert it to vcf")
    if file_type(path)[2].lower() in ("bgz", "gzip"):
        raise ValueError("text is unpacked by the name's ending .gz; rename the file")
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(cells.alias("c"))
    out = rows.select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(_FIXED)), F.when(F.size("c") > 9, F.expr("slice(c, 10, size(c) - 9)")).otherwise(F.array().cast("array<string>")).alias("s"))
    alts = F.when(F.col("alt") == ".", F.array().cast("array<string>")).otherwise(F.split("alt", ","))
    parts = F.split("info", ";")
    name = lambda x: F.substring_index(x, "=", 1)
    first = lambda k: F.get(F.filter(parts, lambda x: name(x) == k), F.lit(0))
    keys = F.array_distinct(F.transform(parts, name))
    info = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, first(k).substr(F.length(k) + 2, F.length(first(k))))))
    return out.select(
        "contig",
        F.col("pos").try_cast("int").alias("pos"),
        "id",
        F.upper("ref").alias("ref"),
        alts.alias("alts"),
        F.concat(F.array(F.upper("ref")), alts).alias("alleles"),
        F.expr("try_cast(qual AS DOUBLE)").alias("qual"),
        "filter",
        info.alias("info"),
        F.split("format", ":").alias("format"),
        F.transform("s", lambda x: F.split(x, ":")).alias("cells"),
    )


def _ints(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda v: v.try_cast("int"))


def format_ints(name: str) -> Column:
    """Of each sample the field's numbers, missing ones null; null for the whole row if the field isn't there."""
    at = F.array_position("format", name).cast("int")
    return F.when(at > 0, F.transform("cells", lambda c: _ints(F.coalesce(F.get(c, at - 1), F.lit(".")))))


def info_ints(name: str) -> Column:
    return F.when(F.map_contains_key("info", name), _ints(F.try_element_at("info", F.lit(name))))


def format_numbers(name: str) -> Column:
    """The same as doubles, so that fields of either type are read."""
    at = F.array_position("format", name).cast("int")
    return F.when(at > 0, F.transform("cells", lambda c: F.transform(F.split(F.coalesce(F.get(c, at - 1), F.lit(".")), ","), lambda v: v.try_cast("double"))))


def info_numbers(name: str) -> Column:
    return F.when(F.map_contains_key("info", name), F.transform(F.split(F.try_element_at("info", F.lit(name)), ","), lambda v: v.try_cast("double")))


def genotypes() -> Column:
    """Of each sample its alleles (null: missing) and if they are phased; null for the whole row without GT."""
    at = F.array_position("format", "GT").cast("int")
    told = lambda c: F.coalesce(F.get(c, at - 1), F.lit("."))
    return F.when(at > 0, F.transform("cells", lambda c: F.struct(F.transform(F.split(told(c), "[/|]"), lambda v: v.try_cast("int")).alias("alleles"), F.contains(told(c), F.lit("|")).alias("phased"))))


#: What makes records of several files one, beside their place.
COLLAPSE = ("none", "snps", "indels", "both", "any")


def in_step(files: list[DataFrame], collapse: str = "none") -> DataFrame:
    """Records of several files of `read_vcf` side by side: contig, pos, and for each file a struct f0, f1, ... or null.

    collapse: none joins records of the same alleles; snps, indels, both also records that are all SNPs, all indels, or of either
    kind; any joins whatever is at a place. A file's records that are the same in this are numbered, and joined one by one in their alleles' order.
    """
    if collapse not in COLLAPSE:
        raise ValueError(f"records can't be joined by '{collapse}'")
    if not files:
        raise ValueError("no file")
    out = None
    for i, df in enumerate(files):
        own = F.concat_ws(",", "alleles")
        snp = F.forall("alleles", lambda a: F.length(a) == 1)
        key = {"none": own, "any": F.lit("")}.get(collapse)
        if key is None:
            key = F.when(snp & F.lit(collapse in ("snps", "both")), F.lit("snp")).when(~snp & F.lit(collapse in ("indels", "both")), F.lit("indel")).otherwise(own)
        order = Window.partitionBy("contig", "pos", "key").orderBy(F.concat_ws(",", "alleles"))
        rows = df.withColumn("key", key).withColumn("nth", F.row_number().over(order))
        rows = rows.select("contig", "pos", "key", "nth", F.struct(*(c for c in df.columns if c not in ("contig", "pos"))).alias(f"f{i}"))
        out = rows if out is None else out.join(rows, ["contig", "pos", "key", "nth"], "full_outer")
    return out.drop("key", "nth")


def is_snp_or_reference() -> Column:
    """All alleles are one base (or stand for any); mixtures with indels don't count."""
    one = lambda a: (F.length(a) == 1) | a.isin("<*>", "<X>", "<NON_REF>")
    return F.forall("alleles", one)


def allele_depths(variants: DataFrame) -> DataFrame:
    """SNP and reference sites with ad: of each sample its depth of each allele; sites without AD are left out, missing values are 0."""
    n = F.size("alleles")
    ad = F.transform(format_ints("AD"), lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.coalesce(F.get(v, i), F.lit(0)), F.lit(0))))
    return variants.where(is_snp_or_reference()).withColumn("ad", ad).where("ad IS NOT NULL")


def genotype_likelihoods(variants: DataFrame, samples: list[str]) -> DataFrame:
    """Sites with cells: a map of each sample to its pl and dp."""
    dp = format_ints("DP")
    made = F.map_from_arrays(F.array(*map(F.lit, samples)), F.zip_with(format_ints("PL"), F.coalesce(dp, F.transform("cells", lambda _: F.lit(None).cast("array<int>"))), lambda p, d: F.struct(p.alias("pl"), F.get(d, F.lit(0)).alias("dp"))))
    return variants.withColumn("made", made).where("made IS NOT NULL").drop("cells").withColumnRenamed("made", "cells")


def parse_labels(columns: list[str]) -> list[tuple[int, str, str]]:
    """(column, library, sample) of columns LB/sample/library or plain names; germline and somatic columns don't count."""
    out, seen = [], set()
    for i, label in enumerate(columns):
        if label.startswith(("GL/", "SM/")):
            continue
        sample, _, library = label.removeprefix("LB/").partition("/")
        library = library or sample
        if library in seen:
            raise ValueError(f"library '{library}' occurs twice")
        seen.add(library)
        out.append((i, library, sample))
    return out


def write_vcf(lines: DataFrame, header: list[str], path: str, contigs: list[str]) -> None:
    """Rows (contig, pos, line) below the header; the parts of the folder in name order are one VCF.

    Ranges of sites go to different tasks, the header is in the first one.
    """
    kind, packed = file_type(path)[1:]
    if kind.lower() != "vcf":
        raise ValueError(f"file type '{kind}' is not supported")
    spark = lines.sparkSession
    order = F.array_position(F.array(*map(F.lit, contigs)), F.col("contig")).cast("int")
    top = spark.createDataFrame([(-1, i, x) for i, x in enumerate(header)], "c int, pos long, line string")
    body = lines.select(order.alias("c"), F.col("pos").cast("long").alias("pos"), "line")
    top.unionByName(body).orderBy("c", "pos", "line").select("line").write.mode("overwrite").text(path, compression="gzip" if packed else "none")


def allele_table(sites: DataFrame) -> DataFrame:
    """contig, pos, alleles joined by commas, and of each library its depths joined by commas."""
    return sites.select("contig", "pos", F.array_join("alleles", ",").alias("alleles"), F.transform("ad", lambda v: F.array_join(v.cast("array<string>"), ",")).alias("ad"))


def genotype_bases(ref: Column, alt: Column, gt: Column) -> Column:
    """Two bases of a genotype 0|0, 1|1, 0|1 or 1|0 (or with /); NN if it isn't known."""
    clean = F.substring_index(F.translate(gt, "|", "/"), ":", 1)
    return F.when(clean == "0/0", F.concat(ref, ref)).when(clean == "1/1", F.concat(alt, alt)).when(clean.isin("0/1", "1/0"), F.concat(ref, alt)).otherwise(F.lit("NN"))
