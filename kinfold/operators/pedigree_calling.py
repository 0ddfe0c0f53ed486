"""Calls and likelihoods of sites under a pedigree; each batch of sites by itself, nothing is shuffled."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import pedigree as P

_SITE = "contig string, pos int, alleles array<string>"
_CALL = (
    "qual double, mutq double, mutx double, denovo boolean, dnp double, lld double, lls double, llh double, dp int, dnq int, dnt string, dnl string, "
    "germline boolean, somatic boolean, library boolean, gt array<string>, gq array<int>, gp array<array<double>>, mutp array<double>, node_dnp array<double>, pl array<array<int>>, ad array<array<int>>"
)
_CHUNK = 2048


def _counts(column: pa.ChunkedArray | pa.Array, places: list[int], n: int) -> np.ndarray:
    """[site, library, allele] of lists of equal shape."""
    outer = column.to_pylist()
    return np.array([[row[p][:n] for p in places] for row in outer], dtype=np.int64).reshape(len(outer), len(places), n)


def _chunks(batch: pa.RecordBatch):
    """Parts of a batch with the same number of alleles, at most 4."""
    n = np.minimum(np.array([len(x) for x in batch.column("alleles").to_pylist()], int), 4)
    for k in np.unique(n).tolist():
        at = np.flatnonzero(n == k)
        for i in range(0, len(at), _CHUNK):
            yield k, batch.take(pa.array(at[i : i + _CHUNK]))


def _gt(g: int, ploidy: int) -> str:
    if ploidy == 1:
        return str(g)
    a = int((math.sqrt(8 * g + 1) - 1) // 2)
    return f"{g - a * (a + 1) // 2}/{a}"


def _places(graph: P.Graph, libraries: list[str]) -> list[int]:
    return [libraries.index(x) for x in graph.libraries]


def call(sites: DataFrame, graph: P.Graph, libraries: list[str], p: M.Parameters = M.Parameters(), least: float = 0.5, everything: bool = False) -> DataFrame:
    """Sites (contig, pos, alleles, ad by library) that vary (and, but for `everything`, have a mutation) with quality `least`.

    What tells of a single mutation (dnq, dnt, dnl and the kinds of branch) is null where one is no likelier than before.
    Sites with one allele are dropped beforehand if `least` is above 0. Sites without alleles or depths are left out.
    """
    places = _places(graph, libraries)
    good = sites.where(F.size("alleles") > (1 if least > 0 else 0)).where("ad IS NOT NULL").select("contig", F.col("pos").cast("int").alias("pos"), "alleles", "ad")
    floor = P.one_mutation_prior(graph, p)
    nodes = graph.nodes
    libs = [i for i, v in enumerate(nodes) if v.kind == "library"]

    def work(batches):
        for batch in batches:
            for n, part in _chunks(batch):
                depth = _counts(part.column("ad"), places, n)
                s = P.statistics(graph, depth, p)
                keep = s["qual"] >= least if least > 0 else np.ones(len(depth), bool)
                if not everything and least > 0:
                    keep &= s["mutq"] >= least
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                alleles = [part.column("alleles")[int(i)].as_py() for i in at]
                single = [bool(s["dnp"][i] >= floor > 0) for i in at]
                branch = [nodes[s["dnl"][i]] for i in at]
                rows = {
                    "contig": part.column("contig").take(pa.array(at)).to_pylist(),
                    "pos": part.column("pos").take(pa.array(at)).to_pylist(),
                    "alleles": alleles,
                    **{k: s[k][at] for k in ("qual", "mutq", "mutx")},
                    "denovo": (s["mutq"][at] >= least) & (least > 0),
                    **{k: s[k][at] for k in ("dnp", "lld", "lls", "llh")},
                    "dp": depth[at].sum((1, 2)).astype(np.int32),
                    "dnq": [int(s["dnq"][i]) if one else None for i, one in zip(at, single, strict=True)],
                    "dnt": [P.mutation_text(graph, int(s["dnl"][i]), int(s["dnt_row"][i]), int(s["dnt_col"][i]), a[:n]) if one else None for i, a, one in zip(at, alleles, single, strict=True)],
                    "dnl": [b.label if one else None for b, one in zip(branch, single, strict=True)],
                    **{k: [k in b.flags if one else None for b, one in zip(branch, single, strict=True)] for k in ("germline", "somatic", "library")},
                    "gt": [[_gt(int(g), v.ploidy) for g, v in zip(s["gt"][i], nodes, strict=True)] for i in at],
                    "gq": s["gq"][at].tolist(),
                    "gp": [[x[i].tolist() for x in s["post"]] for i in at],
                    "mutp": s["mutp"][at].tolist(),
                    "node_dnp": s["node_dnp"][at].tolist(),
                    "pl": [[s["pl"][libs.index(v)][i].tolist() if v in libs else None for v in range(len(nodes))] for i in at],
                    "ad": depth[at].tolist(),
                }
                yield pd.DataFrame(rows)

    def frames(batches):
        for frame in work(batches):
            yield from pa.Table.from_pandas(frame, schema=_ARROW, preserve_index=False).to_batches()

    return good.mapInArrow(frames, f"{_SITE}, {_CALL}")


_T = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64())), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}
_ARROW = pa.schema([(f.split()[0], _T[f.split()[1]]) for f in f"{_SITE}, {_CALL}".split(", ")])


def log_likelihoods(sites: DataFrame, graph: P.Graph, libraries: list[str], p: M.Parameters = M.Parameters()) -> DataFrame:
    """(contig, pos, lld, scale): log10 P(data) of each site and its part that doesn't depend on the genotypes."""
    places = _places(graph, libraries)
    good = sites.where("size(alleles) > 0 AND ad IS NOT NULL").select("contig", F.col("pos").cast("int").alias("pos"), "alleles", "ad")

    def work(batches):
        for batch in batches:
            for n, part in _chunks(batch):
                s = P.statistics(graph, _counts(part.column("ad"), places, n), p)
                yield pa.RecordBatch.from_arrays([part.column("contig"), part.column("pos"), pa.array(s["lld"]), pa.array(s["lld"] - s["llh"])], names=["contig", "pos", "lld", "scale"])

    return good.mapInArrow(work, "contig string, pos int, lld double, scale double")


def log_likelihood(sites: DataFrame, graph: P.Graph, libraries: list[str], p: M.Parameters = M.Parameters()) -> DataFrame:
    """One row: log_likelihood, log_hidden (total less observed), log_observed. Sums are exact within a batch of sites, so the
    order of sites hardly matters; batches are added up after."""
    each = log_likelihoods(sites, graph, libraries, p)

    def part(frames):
        lld, scale, n = [], [], 0
        for f in frames:
            lld.append(math.fsum(f["lld"]))
            scale.append(math.fsum(f["scale"]))
            n += len(f)
        yield pd.DataFrame({"lld": [math.fsum(lld)], "scale": [math.fsum(scale)], "n": [n]})

    sums = each.mapInPandas(part, "lld double, scale double, n long").agg(F.coalesce(F.sum("lld"), F.lit(0.0)).alias("lld"), F.coalesce(F.sum("scale"), F.lit(0.0)).alias("scale"))
    return sums.select(F.col("lld").alias("log_likelihood"), (F.col("lld") - F.col("scale")).alias("log_hidden"), F.col("scale").alias("log_observed"))


def trim_alleles(alleles: list[str], gts: list[str], gps: list[list[float]], ploidies: list[int], least: float) -> list[int]:
    """Places of the alleles to keep: the reference, those of a called genotype, and those whose dosage reaches `least`."""
    if any(x not in (1, 2) for x in ploidies):
        raise ValueError("ploidies above 2 can't be trimmed")
    called = {int(a) for g in gts for a in g.replace("|", "/").split("/") if a != "."}
    top = [0.0] * len(alleles)
    for gp, ploidy in zip(gps, ploidies, strict=True):
        dose = [0.0] * len(alleles)
        pairs = M.pairs(len(alleles)) if ploidy == 2 else [(a, a) for a in range(len(alleles))]
        for x, (b, a) in zip(gp, pairs, strict=False):
            dose[b] += x / 2
            dose[a] += x / 2
        top = [max(t, d) for t, d in zip(top, dose, strict=True)]
    return [a for a in range(len(alleles)) if a == 0 or a in called or top[a] >= least]


def vcf_header(graph: P.Graph, contigs: dict[str, int]) -> list[str]:
    """Fixed dictionary, the contigs, the pedigree's branches, and the columns."""
    info = {"MUTQ": "Float:Phred of no mutation", "MUTX": "Float:Expected mutations", "LLD": "Float:log10 likelihood", "LLS": "Float:LLD less the saturated likelihood", "LLH": "Float:log10 likelihood of hidden data", "DENOVO": "Flag:Mutation found", "DNP": "Float:Probability of exactly one mutation", "DNQ": "Integer:Quality of DNT", "DNT": "String:Likeliest mutation", "DNL": "String:Where it is", "GERMLINE": "Flag:On a germline branch", "SOMATIC": "Flag:On a somatic branch", "LIBRARY": "Flag:On a library branch", "DP": "Integer:Depth", "AD": "Integer:Allele depths", "ADF": "Integer:Allele depths, forward strand", "ADR": "Integer:Allele depths, reverse strand", "MQ": "Float:Root mean square of mapping qualities", "FS": "Float:Phred of the strands' exact test", "MQTa": "Float:Rank test of mapping qualities", "RPTa": "Float:Rank test of places in reads", "BQTa": "Float:Rank test of base qualities"}
    form = {"GT": "String:1:Genotype", "GQ": "Integer:1:Genotype quality", "GP": "Float:G:Genotype posterior", "MUTP": "Float:1:Probability of a mutation", "DNP": "Float:1:Probability of the single mutation", "PL": "Integer:G:Genotype likelihoods", "AD": "Integer:R:Allele depths", "ADF": "Integer:R:Allele depths, forward strand", "ADR": "Integer:R:Allele depths, reverse strand"}
    out = ["##fileformat=VCFv4.2"]
    for k, v in info.items():
        kind, text = v.split(":", 1)
        out.append(f'##INFO=<ID={k},Number={0 if kind == "Flag" else "R" if k.startswith("AD") else 1},Type={kind},Description="{text}">')
    for k, v in form.items():
        kind, number, text = v.split(":", 2)
        out.append(f'##FORMAT=<ID={k},Number={number},Type={kind},Description="{text}">')
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs.items()]
    for v in graph.nodes:
        names = {"dad": "Father", "mom": "Mother"} if len(v.ups) == 2 else dict.fromkeys(("dad", "mom", "mitotic", "library"), "Original")
        cells = []
        for k, (p, u, kind) in enumerate(v.ups):
            name = names.get(kind, ("Father", "Mother")[k])
            cells += [f"{name}={graph.nodes[p].label}", f"{name}MR={u:g}"]
        if cells:
            out.append(f"##PEDIGREE=<Child={v.label},{','.join(cells)}>")
    out.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(v.label for v in graph.nodes)]))
    return out


def vcf_lines(calls: DataFrame, graph: P.Graph, least_frequency: float = 0.0) -> DataFrame:
    """(contig, pos, line) of calls; alleles that no one has are trimmed. Numbers have six digits. Strands and tests are told where calls have them."""
    nodes = graph.nodes
    ploidies = [v.ploidy for v in nodes]
    libs = [i for i, v in enumerate(nodes) if v.kind == "library"]

    def number(x: float) -> str:
        return f"{float(x):.6g}"

    def line(r) -> str:
        keep = trim_alleles(list(r.alleles), list(r.gt), [list(x) for x in r.gp], ploidies, least_frequency)
        new = {old: k for k, old in enumerate(keep)}
        n = min(4, len(r.alleles))
        pick = {1: [a for a in keep if a < n], 2: [i for i, (b, a) in enumerate(M.pairs(n)) if b in new and a in new]}
        info = [f"MUTQ={number(r.mutq)}", f"MUTX={number(r.mutx)}", f"LLD={number(r.lld)}", f"LLS={number(r.lls)}", f"LLH={number(r.llh)}", *(["DENOVO"] if r.denovo else []), f"DNP={number(r.dnp)}"]
        if r.dnt is not None:
            info += [f"DNQ={int(r.dnq)}", f"DNT={r.dnt}", f"DNL={r.dnl}", *(k.upper() for k in ("germline", "somatic", "library") if getattr(r, k))]
        info.append(f"DP={r.dp}")
        kept = [k for k in keep if k < n]
        strands = getattr(r, "adf", None)
        total = lambda rows: ",".join(str(sum(int(row[k]) for row in rows)) for k in kept)
        info.append(f"AD={total(r.ad)}")
        if strands is not None:
            info += [f"ADF={total(strands)}", f"ADR={total([[a - f for a, f in zip(x, y, strict=False)] for x, y in zip(r.ad, strands, strict=True)])}"]
        info += [f"{name}={number(value)}" for name in ("MQ", "FS", "MQTa", "RPTa", "BQTa") if (value := getattr(r, name.lower(), None)) is not None and value == value]
        cells = []
        for i, v in enumerate(nodes):
            gt = "/".join(str(new[int(a)]) for a in r.gt[i].split("/"))
            at = pick[v.ploidy]
            pl = ",".join(str(r.pl[i][k]) for k in at) if r.pl[i] is not None else "."
            ad = ",".join(str(r.ad[libs.index(i)][k]) for k in keep if k < n) if i in libs else "."
            of = libs.index(i) if i in libs else None
            more = [] if strands is None else [".", "."] if of is None else [",".join(str(strands[of][k]) for k in kept), ",".join(str(r.ad[of][k] - strands[of][k]) for k in kept)]
            cells.append(":".join([gt, str(r.gq[i]), ",".join(number(r.gp[i][k]) for k in at), number(r.mutp[i]), number(r.node_dnp[i]), pl, ad, *more]))
        alts = ",".join(r.alleles[a] for a in keep[1:]) or "."
        return "\t".join([r.contig, str(r.pos), ".", r.alleles[0], alts, number(r.qual), ".", ";".join(info), "GT:GQ:GP:MUTP:DNP:PL:AD" + (":ADF:ADR" if strands is not None else ""), *cells])

    def work(frames):
        for f in frames:
            yield pd.DataFrame({"contig": f["contig"], "pos": f["pos"], "line": [line(r) for r in f.itertuples(index=False)]})

    return calls.mapInPandas(work, "contig string, pos int, line string")
