"""From filtered reads to allele depths; all partial aggregates, shuffled once by site."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def read_filter(reads: DataFrame, least_base_qual: int = 13) -> DataFrame:
    """Reads whose base is A, C, G or T (0..3) with enough quality."""
    return reads.where((F.col("base_qual") >= least_base_qual) & F.col("base").between(0, 3))


def allele_counts(reads: DataFrame) -> DataFrame:
    """(site, library, ref_base, base): depth, forward, reverse, sum of squared mapping qualities."""
    rev = F.sum(F.when(F.col("is_rev"), 1).otherwise(0))
    return reads.groupBy("site", "library", "ref_base", "base").agg(F.count("*").alias("depth"), (F.count("*") - rev).alias("forward"), rev.alias("reverse"), F.sum(F.col("map_qual") * F.col("map_qual")).alias("mq2"))


def ranked_alleles(reads: DataFrame) -> DataFrame:
    """A site's alleles: the reference first, then by depth, ties by base."""
    total = reads.groupBy("site", "ref_base", "base").agg(F.count("*").alias("depth"))
    first = (F.col("base") == F.col("ref_base")).cast("int")
    order = Window.partitionBy("site").orderBy(F.desc(first), F.desc("depth"), F.asc("base"))
    return total.withColumn("rank", F.row_number().over(order)).select("site", "base", "depth", "rank")


def trio_depths(reads: DataFrame) -> DataFrame:
    """One row a site, with reference and alternative depth of libraries 0 (dad), 1 (child), 2 (mom)."""
    cols = []
    for lib, name in enumerate(("dad", "child", "mom")):
        for kind, test in (("ref", F.col("base") == F.col("ref_base")), ("alt", F.col("base") != F.col("ref_base"))):
            cols.append(F.sum(F.when((F.col("library") == lib) & test, 1).otherwise(0)).alias(f"{name}_{kind}"))
    return reads.groupBy("site").agg(*cols)


def rms_mapping_quality(counts: DataFrame) -> DataFrame:
    """(site, mq): root mean square over the site's reads, of `allele_counts`."""
    return counts.groupBy("site").agg(F.sqrt(F.sum("mq2") / F.sum("depth")).alias("mq"))


def depth_statistics(reads: DataFrame) -> DataFrame:
    """(site, dp, log_null): depth, and log10 of the chance of the alleles at their own frequencies."""
    per = reads.groupBy("site", "base").agg(F.count("*").alias("t"))
    return per.groupBy("site").agg(F.sum("t").alias("dp"), (F.sum(F.col("t") * F.log10("t")) - F.sum("t") * F.log10(F.sum("t"))).alias("log_null"))


_TESTS = ("fs", "mqta", "rpta", "bqta")


def site_tests(reads: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Of reads (keys, ref_base, base, is_rev, map_qual, read_pos, base_qual), a row a site: mq (root mean square of mapping qualities) and, where
    both reference and other reads exist, fs (phred of Fisher's test of the strands) and mqta, rpta, bqta (Anderson and Darling's tests of mapping
    qualities, places in the read and base qualities); null elsewhere, and for fewer than 4 reads but for fs.

    A site's values come together as counts of each value that occurs, so a deep site is no longer than its values are many.
    """
    ref = (F.col("base") == F.col("ref_base")).alias("is_ref")
    rows = reads.select(*keys, ref, "is_rev", F.inline(F.array(*(F.struct(F.lit(k).alias("what"), F.col(c).cast("double").alias("value")) for k, c in enumerate(("map_qual", "read_pos", "base_qual"))))))
    counts = rows.groupBy(*keys, "is_ref", "is_rev", "what", "value").agg(F.count("*").alias("n"))
    told = counts.groupBy(*keys).agg(F.collect_list(F.struct("is_ref", "is_rev", "what", "value", "n")).alias("told"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields[:-1]), "mq double", *(f"{x} double" for x in _TESTS)])
    return told.mapInArrow(_tested(len(keys)), schema)


def _tested(n_keys: int) -> Callable:
    def of(told: list[dict]) -> list[float | None]:
        quality = [x for x in told if x["what"] == 0]
        total = sum(x["n"] for x in quality)
        mq = (sum(x["n"] * x["value"] ** 2 for x in quality) / total) ** 0.5
        strand = lambda ref, rev: sum(x["n"] for x in quality if x["is_ref"] is ref and x["is_rev"] is rev)
        a, b, c, d = strand(True, False), strand(False, False), strand(True, True), strand(False, True)
        if not (a + c and b + d):
            return [mq, None, None, None, None]
        out = [mq, stats.phred(stats.fisher(a, b, c, d))]
        for what in range(3):
            sides = [[v for x in told if x["what"] == what and x["is_ref"] is ref for v in [x["value"]] * x["n"]] for ref in (True, False)]
            value = stats.anderson_darling(*sides)
            out.append(None if value != value else value)
        return out

    def work(batches):
        for batch in batches:
            rows = [of(x) for x in batch.column(n_keys).to_pylist()]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *columns], names=[*batch.schema.names[:n_keys], "mq", *_TESTS])

    return work
