"""De novo mutations from genotype likelihoods (PL) by lookup tables; sites are independent, nothing is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookup as L

#: PL of a genotype that the site's alleles can't tell.
MAX_PL = 65535
#: Sites whose configurations are laid out at once; bounds memory to some 10 MB an array.
_CHUNK = 1024


def ten_genotypes(alleles: Column, pl: Column) -> Column:
    """PL in VCF order to the order AA, AC, AG, AT, CC, ...; genotypes of absent bases are MAX_PL.

    An allele that isn't a base (X, N, <*>) stands for all bases not seen.
    """
    place = lambda b: F.array_position(alleles, b).cast("int") - 1
    rest = F.aggregate(F.transform(alleles, lambda a, i: F.when(~a.isin("A", "C", "G", "T"), i)), F.lit(None).cast("int"), lambda acc, x: F.coalesce(x, acc))
    at = {b: F.when(place(b) >= 0, place(b)).otherwise(rest) for b in "ACGT"}

    def one(g: str) -> Column:
        x, y = at[g[0]], at[g[1]]
        hi, lo = F.greatest(x, y), F.least(x, y)
        return F.when(x.isNull() | y.isNull(), F.lit(MAX_PL)).otherwise(F.get(pl, (hi * (hi + 1) / 2 + lo).cast("int")))

    return F.transform(F.array(*map(one, L.SNP)), lambda v: F.coalesce(v, F.lit(MAX_PL)))


def qc_flag(mapq: Column, depth: Column) -> Column:
    return F.when((mapq < 40) | (depth < 10), 1).otherwise(0)


def i16_depth(i16: Column) -> Column:
    return F.aggregate(F.slice(i16, 1, 4), F.lit(0), lambda a, x: a + x.cast("int"))


def i16_mapq(i16: Column) -> Column:
    """Root mean square; null without reads."""
    d = i16_depth(i16)
    return F.when(d > 0, (F.sqrt((F.get(i16, F.lit(9)) + F.get(i16, F.lit(11))) / d) + 0.499).cast("int"))


def split_depth(total: Column, pls: Column) -> Column:
    """A site's depth shared out to three samples in turn: at least 1, and 0 to a sample without any PL of 0."""

    def step(acc: Column, pl: Column) -> Column:
        left = F.lit(3) - F.size(acc["out"])
        raw = F.when(left != 0, (acc["rest"] / left + 0.4999).cast("int"))
        d = F.when(~F.exists(pl, lambda v: v == 0), 0).otherwise(F.greatest(F.lit(1), raw))
        return F.struct((acc["rest"] - F.coalesce(d, F.lit(0))).cast("int").alias("rest"), F.concat(acc["out"], F.array(d.cast("int"))).alias("out"))

    start = F.struct(total.cast("int").alias("rest"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(pls, start, step, lambda acc: acc["out"])


def deep_enough(*depths: Column, least: int = 10) -> Column:
    out = F.lit(True)
    for d in depths:
        out = out & (d >= least)
    return out


def clean_alt(alt: Column) -> Column:
    """Without the first `,X` or `,N`."""
    return F.regexp_replace(alt, "^((?:(?!,[XN]).)*),[XN]", "$1")


def _lists(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), width)


def _best(all_: np.ndarray, denovo: np.ndarray):
    """Largest null and de novo values with their places, and the sum; first of equals."""
    flat = all_.reshape(len(all_), -1)
    flags = denovo.ravel()
    out = []
    for mask in (~flags, flags):
        v = np.where(mask, flat, 0.0)
        at = v.argmax(1)
        out += [v[np.arange(len(v)), at], at]
    return (*out, flat.sum(1))


_OUT = "null_like double, null_gt string, null_code int, pp_null double, dnm_like double, dnm_gt string, dnm_code int, pp_dnm double"


def _apply(sites: DataFrame, weigh, denovo: np.ndarray, code: np.ndarray, names: np.ndarray) -> DataFrame:
    """Rows with the likeliest null and de novo configurations; weigh(batch) gives [site, configuration...]."""
    fields = [x.split() for x in _OUT.split(", ")]

    def work(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, _CHUNK):
                b = whole.slice(start, _CHUNK)
                null, i, dn, k, total = _best(weigh(b), denovo)
                with np.errstate(invalid="ignore", divide="ignore"):
                    pp = dn / total
                flat = code.ravel()
                values = (null, names[i], flat[i], 1 - pp, dn, names[k], flat[k], pp)
                kinds = {"double": pa.float64(), "string": pa.string(), "int": pa.int32()}
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, kinds[t]) for v, (_, t) in zip(values, fields, strict=True))], names=[*b.schema.names, *(n for n, _ in fields)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sites.schema), _OUT])
    return sites.mapInArrow(work, schema)


def _trio_names(kinds: tuple[str, ...]) -> np.ndarray:
    return np.array([f"{c}/{m}/{d}" for m in kinds for d in kinds for c in kinds])


def _usable(sites: DataFrame, columns: tuple[str, ...], width: int) -> DataFrame:
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(F.size(c) == width, F.lit(False)) & ~F.exists(c, lambda v: v.isNull())
    return sites.where(good)


def trio_snps(sites: DataFrame, model: str = "auto", rate: float = 1e-8, poly: float = 1e-3, least_depth: int = 10, cutoff: float = 1e-4) -> DataFrame:
    """Sites (ref, {child,mom,dad}_pl of ten, {child,mom,dad}_dp) with a de novo posterior above the cutoff.

    Sites with another reference than A, C, G, T, without PLs of ten, or too shallow are left out.
    """
    t = L.snp_table(model, rate, poly)
    good = _usable(sites, ("child_pl", "mom_pl", "dad_pl"), 10).where(F.col("ref").isin(*"ACGT")).where(deep_enough(F.col("child_dp"), F.col("mom_dp"), F.col("dad_dp"), least=least_depth))

    def weigh(b: pa.RecordBatch) -> np.ndarray:
        c, m, d = (10 ** (-_lists(b, f"{w}_pl", 10) / 10) for w in ("child", "mom", "dad"))
        ref = np.array(["ACGT".index(x) for x in b.column("ref").to_pylist()], int)
        return m[:, :, None, None] * d[:, None, :, None] * c[:, None, None, :] * t["weight"][ref]

    out = _apply(good, weigh, t["denovo"], t["code"], _trio_names(L.SNP))
    return out.where(F.col("pp_dnm") > cutoff)


def trio_indels(sites: DataFrame, model: str = "auto", rate: float = 1e-9, scale: float = 1.0, least_depth: int = 10, cutoff: float = 1e-4) -> DataFrame:
    """The same of indels (ref, alt, PLs of three); several alternatives are left out. rate 0: by the indel's length."""
    t = L.indel_table(model)
    good = _usable(sites, ("child_pl", "mom_pl", "dad_pl"), 3).where(~F.col("alt").contains(",") & F.col("ref").isNotNull()).where(deep_enough(F.col("child_dp"), F.col("mom_dp"), F.col("dad_dp"), least=least_depth))

    def weigh(b: pa.RecordBatch) -> np.ndarray:
        c, m, d = (10 ** (-_lists(b, f"{w}_pl", 3) / 10) for w in ("child", "mom", "dad"))
        rates = np.array([L.indel_rate(r, a, rate, scale) for r, a in zip(b.column("ref").to_pylist(), b.column("alt").to_pylist(), strict=True)])
        return m[:, :, None, None] * d[:, None, :, None] * c[:, None, None, :] * t["weight"] * rates[:, None, None, None] ** t["hits"]

    out = _apply(good, weigh, t["denovo"], t["code"], _trio_names(L.INDEL))
    return out.where(F.col("pp_dnm") > cutoff)


def pair_snps(sites: DataFrame, rate: float = 1e-9, least_depth: int = 10, cutoff: float = 1e-4) -> DataFrame:
    """Sites ({normal,tumor}_pl of ten, {normal,tumor}_dp) where tumor and normal differ; genotypes are normal/tumor."""
    t = L.pair_table(rate)
    good = _usable(sites, ("normal_pl", "tumor_pl"), 10).where(deep_enough(F.col("normal_dp"), F.col("tumor_dp"), least=least_depth))

    def weigh(b: pa.RecordBatch) -> np.ndarray:
        n, u = (10 ** (-_lists(b, f"{w}_pl", 10) / 10) for w in ("normal", "tumor"))
        return n[:, :, None] * u[:, None, :] * t["weight"]

    names = np.array([f"{n}/{u}" for n in L.SNP for u in L.SNP])
    return _apply(good, weigh, t["denovo"], t["code"], names).where(F.col("pp_dnm") > cutoff)


def trio_members(sites: DataFrame, trios: DataFrame) -> DataFrame:
    """Sites with a map `cells` (sample to struct of pl, dp), for each trio (child, dad, mom) of a pedigree.

    The few trios go along as literals in one array, so that each site is read once; trios with absent members are left out.
    """
    rows = [(r["child"], r["dad"], r["mom"]) for r in trios.select("child", "dad", "mom").collect()]
    if not rows:
        raise ValueError("the pedigree has no trio")
    each = sites.withColumn("trio", F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("child", "dad", "mom"), r, strict=True))) for r in rows))))
    out = each
    for who in ("child", "dad", "mom"):
        cell = F.try_element_at("cells", F.col(f"trio.{who}"))
        out = out.withColumn(who, F.col(f"trio.{who}")).withColumn(f"{who}_pl", cell["pl"]).withColumn(f"{who}_dp", cell["dp"])
    return out.where("child_pl IS NOT NULL AND mom_pl IS NOT NULL AND dad_pl IS NOT NULL").drop("trio", "cells")


def counters(sites: DataFrame, columns: tuple[str, ...] = ("child_dp", "mom_dp", "dad_dp"), least_depth: int = 10) -> DataFrame:
    """One row: interrogated, passing: sites, and those deep enough in all samples."""
    passing = F.coalesce(deep_enough(*(F.col(c) for c in columns), least=least_depth), F.lit(False))
    return sites.agg(F.count("*").alias("interrogated"), F.coalesce(F.sum(passing.cast("long")), F.lit(0)).cast("long").alias("passing"))


def _short(x: Column) -> Column:
    """Six digits, as numbers are written to a stream."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", x), "(\\.\\d*?)0+(e|$)", "$1$2"), "\\.(e|$)", "$1")


#: Of the text rows: title, members' names, of genotypes.
_TITLES = {"snp": ("DENOVO-SNP", ("child", "dad", "mom"), "child/mom/dad"), "indel": ("DENOVO-INDEL", ("child", "dad", "mom"), "child/mom/dad"), "pair": ("DENOVO-PAIR-SNP", ("tumor", "normal"), "normal/tumor")}


def text_rows(calls: DataFrame, kind: str) -> DataFrame:
    """Calls (with contig, pos, ref, alt, the members' names, and {member}_dp) with `line`: the row of keys and values that tells them.

    kind: snp, indel or pair. Depths that are null are left empty.
    """
    title, members, names = _TITLES[kind]
    word = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    alt = word("alt") if kind == "indel" else clean_alt(word("alt"))
    cells: list[Column] = [F.lit(f"{title} {members[0].upper()}_ID: "), word(members[0])]
    if kind == "pair":
        cells += [F.lit(" NORMAL_ID: "), word("normal")]
    cells += [F.lit(" chr: "), word("contig"), F.lit(" pos: "), word("pos"), F.lit(" ref: "), word("ref"), F.lit(" alt: "), alt]
    cells += [F.lit(" maxlike_null: "), _short(F.col("null_like")), F.lit(" pp_null: "), _short(F.col("pp_null")), F.lit(f" tgt_null({names}): "), word("null_gt")]
    cells += [F.lit(" code: "), word("null_code")] if kind != "pair" else []
    cells += [F.lit(" maxlike_dnm: "), _short(F.col("dnm_like")), F.lit(" pp_dnm: "), _short(F.col("pp_dnm")), F.lit(f" tgt_dnm({names}): "), word("dnm_gt")]
    cells += [F.lit(" lookup: "), word("dnm_code")] if kind != "pair" else []
    for i, m in enumerate(members):
        cells += [F.lit(f" READ_DEPTH {m}: " if i == 0 else f" {m}: "), word(f"{m}_dp")]
    cells += [F.lit(" null_snpcode: "), word("null_code"), F.lit(" dnm_snpcode: "), word("dnm_code")] if kind == "pair" else []
    return calls.withColumn("line", F.concat(*cells))


_FIELDS = (("NULL_CONFIG(child/mom/dad)", "String", "null_gt"), ("PP_NULL", "Float", "pp_null"), ("ML_NULL", "Float", "null_like"), ("DNM_CONFIG(child/mom/dad)", "String", "dnm_gt"), ("PP_DNM", "Float", "pp_dnm"), ("ML_DNM", "Float", "dnm_like"), ("RD", "Integer", "child_dp"))


def vcf_header(children: list[str], contigs: dict[str, int]) -> list[str]:
    """Of calls of trios, a column for each child."""
    out = ["##fileformat=VCFv4.2"]
    out += [f'##INFO=<ID={k},Number=1,Type=Integer,Description="{text}">' for k, text in (("RD_MOM", "Read depth of the mother"), ("RD_DAD", "Read depth of the father"), ("code", "Code of the likeliest configuration without a mutation"))]
    out += [f'##FORMAT=<ID={name},Number=1,Type={kind},Description="Of the child or its trio">' for name, kind, _ in _FIELDS]
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs.items()]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *children])]


def vcf_lines(calls: DataFrame, children: list[str]) -> DataFrame:
    """(contig, pos, line) of calls of trios (with contig, pos, ref, alt, child): a record each, in which the other children's cells are missing."""
    cell = F.concat_ws(":", *(F.coalesce(_short(F.col(c).cast("double")) if kind != "String" else F.col(c), F.lit(".")) for _, kind, c in _FIELDS))
    info = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in (("RD_MOM", "mom_dp"), ("RD_DAD", "dad_dp"), ("code", "null_code"))))
    cells = [F.when(F.col("child") == c, cell).otherwise(F.lit(".")) for c in children]
    line = F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", clean_alt(F.col("alt")), F.lit("0"), F.lit("PASS"), info, F.lit(":".join(f[0] for f in _FIELDS)), *cells)
    return calls.select("contig", F.col("pos").cast("int").alias("pos"), line.alias("line"))


#: Codes of sites that no call is made of; -1 to -3 tell how many members are missing.
NO_PL, BAD_REFERENCE, NO_ALT = -6, 10, -11


def site_codes(sites: DataFrame, trios: DataFrame) -> DataFrame:
    """Sites (ref, alts, and cells: a map of samples to structs of pl) by the trios (child, dad, mom), each with `code`, 0 where a call can be made, and `message`.

    The first of these counts: no sample has PL, the reference doesn't begin with a base, there is no other allele, members are missing.
    """
    rows = [(r["child"], r["dad"], r["mom"]) for r in trios.select("child", "dad", "mom").collect()]
    if not rows:
        raise ValueError("the pedigree has no trio")
    each = sites.withColumn("trio", F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("child", "dad", "mom"), r, strict=True))) for r in rows))))
    missing = sum((F.when(F.coalesce(F.map_contains_key("cells", F.col(f"trio.{who}")), F.lit(False)), 0).otherwise(1) for who in ("child", "dad", "mom")), F.lit(0))
    no_pl = ~F.coalesce(F.exists(F.map_values("cells"), lambda c: c["pl"].isNotNull()), F.lit(False))
    reference = F.coalesce(F.upper(F.substring("ref", 1, 1)).isin(*"ACGT"), F.lit(False))
    code = F.when(no_pl, NO_PL).when(~reference, BAD_REFERENCE).when(F.coalesce(F.size("alts"), F.lit(0)) < 1, NO_ALT).otherwise(-missing).cast("int")
    texts = F.when(F.col("code") == NO_PL, "PL is missing").when(F.col("code") == BAD_REFERENCE, "the reference is no base").when(F.col("code") == NO_ALT, "there is no other allele").when(F.col("code") < 0, F.concat(F.lit("members missing: "), F.abs("code").cast("string")))
    return each.withColumn("code", code).withColumn("message", texts)
