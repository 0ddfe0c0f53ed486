"""Scalar functions on locations, genotypes, qualities and labels, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_location(contig: Column, pos: Column) -> Column:
    return F.shiftleft(contig.cast("long"), 32) + pos.cast("long")


def contig_of(loc: Column) -> Column:
    return F.shiftright(loc, 32).cast("int")


def position_of(loc: Column) -> Column:
    return loc.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def genotype_index(b: Column, a: Column) -> Column:
    """Of the alleles in any order."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.expr("0") + (hi * (hi + 1) / 2).cast("int") + lo


def genotype_alleles(gt: Column) -> tuple[Column, Column]:
    """(smaller, larger) allele of an index."""
    hi = F.floor((F.sqrt(8 * gt + 1) - 1) / 2).cast("int")
    return (gt - (hi * (hi + 1) / 2).cast("int")).cast("int"), hi


def phred(p: Column) -> Column:
    """Of 0 infinity, below 0 NaN; null of null alone."""
    return F.when(p == 0, F.lit(math.inf)).when(p < 0, F.lit(math.nan)).otherwise(-10 * F.log10(p))


def unphred(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def phred1m(p: Column) -> Column:
    """Of 1 - p, exact for small p; of 1 infinity, above 1 NaN; null of null alone."""
    return F.when(p == 1, F.lit(math.inf)).when(p > 1, F.lit(math.nan)).otherwise(-10 / F.lit(math.log(10)) * F.log1p(-p))


def unphred1m(q: Column) -> Column:
    """p of `phred1m`."""
    return -F.expm1(-q * F.lit(math.log(10) / 10))


def rounded_phred(p: Column, most: int = 2**31 - 1) -> Column:
    """Whole phreds, halves away from zero, `most` at most; of 0 that."""
    return F.when(p <= 0, F.lit(most)).otherwise(F.least(F.round(phred(p)), F.lit(float(most))).cast("int"))


def rounded_phred1m(p: Column, most: int = 2**31 - 1) -> Column:
    return F.when(p >= 1, F.lit(most)).otherwise(F.least(F.round(phred1m(p)), F.lit(float(most))).cast("int"))


def substitution(first: Column, second: Column) -> Column:
    """ts (A and G, C and T), tv (another change of a base), or null where nothing changes or one isn't a base."""
    a, b = base_index(first), base_index(second)
    return F.when((a < 4) & (b < 4) & (a != b), F.when(F.abs(a - b) == 2, "ts").otherwise("tv"))


def changed_bases(first: Column, second: Column) -> Column:
    """(from, to) where two genotypes of two bases differ in just one of them; else null."""
    pair = lambda i, j: (F.substring(first, i, 1), F.substring(second, j, 1))
    out = F.lit(None).cast("struct<from:string,to:string>")
    for i, j in ((2, 2), (2, 1), (1, 2), (1, 1)):
        (x, y), (p, q) = pair(i, j), pair(3 - i, 3 - j)
        out = F.when((p == q) & (x != y), F.struct(x.alias("from"), y.alias("to"))).otherwise(out)
    return out


def base_index(base: Column) -> Column:
    """A, C, G, T to 0..3, others 4."""
    at = F.instr(F.lit("ACGT"), F.upper(base)) - 1
    return F.when((at >= 0) & (F.length(base) == 1), at).otherwise(F.lit(4)).cast("int")


def trim_label(label: Column) -> Column:
    return F.regexp_replace(label, "^(GL|SM|LB)/", "")


def keeps_read(flag: Column, mapq: Column, least: int = 0) -> Column:
    """Mapped, primary, passing quality control, no duplicate; null mapq doesn't pass."""
    return (flag.bitwiseAND(F.lit(0xF04)) == 0) & (mapq >= least)
