"""The tasks from a shell: python -m kinfold call --ped x.ped --fasta r.fa a.sam b.sam.

Options can also come from a file of key=value lines (--arg-file, - for standard input), what is given on the line going first, and
the text of --region from a file (@file; a BED file if it is named so). Results go to standard output unless --output names a file.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import DataFrame, SparkSession

from . import commands
from .functions import model as M
from .functions.text import file_type, parse_numbers, told_by_file
from .operators import denovo, pedigree_calling

_READING = {"fasta": str, "region": str, "bed": str, "min_mapqual": int, "min_basequal": int, "rgtag": str}
_RENAMED = {"min_mapqual": "least_mapq", "min_basequal": "least_base_qual", "rgtag": "tag", "min_qual": "least", "all": "everything"}
_MODEL = {f.name: float for f in dataclasses.fields(M.Parameters) if f.name != "mu"}
_PEDIGREE = {"ped": str, "inheritance": str, "mu": float, "mu_somatic": float, "mu_library": float, "contigs": str}
#: Of each task: positional arguments (the last one may repeat for call and loglike), options.
TASKS = {
    "call": (("inputs",), _PEDIGREE | _READING | _MODEL | {"min_qual": float, "all": bool, "output": str}),
    "loglike": (("inputs",), _PEDIGREE | _READING | _MODEL),
    "dnm": (("vcf", "ped"), {"model": str, "snp_rate": float, "indel_rate": float, "pair_rate": float, "poly": float, "scale": float, "least_depth": int, "cutoff": float}),
    "phaser": (("mutations", "sites", "bam"), {"window": int}),
    "treecall": (("vcf",), {}),
    "genotype": (("vcf", "tree"), {}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    tasks = top.add_subparsers(dest="task", required=True)
    for name, (positional, options) in TASKS.items():
        own = tasks.add_parser(name)
        for p in positional:
            own.add_argument(p, nargs="*" if p == "inputs" else None)
        own.add_argument("--arg-file")
        for key, kind in options.items():
            flag = "--" + key.replace("_", "-")
            own.add_argument(flag, action="store_const", const=True) if kind is bool else own.add_argument(flag, type=kind)
    return top


def arguments(line: list[str]) -> tuple[str, dict]:
    """(task, what its function takes). Options that aren't given are left to the function."""
    given = vars(parser().parse_args(line))
    task, path = given.pop("task"), given.pop("arg_file")
    kinds = TASKS[task][1]
    if path:
        text = sys.stdin.read() if path == "-" else open(path, encoding="utf-8").read()
        for key, value in commands.options(text).items():
            if key not in kinds:
                raise ValueError(f"option '{key}' of {path} is not known")
            if given.get(key) is None:
                given[key] = value.lower() in ("1", "true", "yes", "on", "") if kinds[key] is bool else kinds[key](value)
    out = {k: v for k, v in given.items() if v is not None}
    if "region" in out:
        text, extension = told_by_file(out["region"])
        if extension.lower() == "bed":
            out["bed"] = file_type(out.pop("region")[1:])[0]
        else:
            out["region"] = text
    if "contigs" in out:
        pairs = [x.split("=") for x in out["contigs"].split(",")]
        out["contigs"] = {name: parse_numbers(n, whole=True)[0] for name, n in pairs}
    own = {k: out.pop(k) for k in _MODEL if k in out}
    if task in ("call", "loglike"):
        if "ped" not in out:
            raise ValueError("a pedigree is needed (--ped)")
        out["paths"] = out.pop("inputs")
        out["p"] = M.Parameters(**own, **({"mu": out["mu"]} if "mu" in out else {}))
    return task, {_RENAMED.get(k, k): v for k, v in out.items()}


def _lines(rows: DataFrame, column: str) -> None:
    for r in rows.select(column).toLocalIterator():
        print(r[column])


def run(spark: SparkSession, line: list[str]) -> None:
    task, own = arguments(line)
    if task == "call":
        out = commands.call(spark, **own)
        if "output" not in own:
            sites, libraries = commands.depths(spark, own["paths"], **{k: v for k, v in own.items() if k in ("fasta", "region", "bed", "least_mapq", "least_base_qual", "tag", "contigs")})
            graph = commands._graph(spark, own["ped"], libraries, own.get("inheritance", "autosomal"), own.get("mu", 1e-8), own.get("mu_somatic", 0.0), own.get("mu_library", 0.0))
            for x in [*pedigree_calling.vcf_header(graph, own.get("contigs", {})), *(r["line"] for r in pedigree_calling.vcf_lines(out, graph).orderBy("contig", "pos").toLocalIterator())]:
                print(x)
        else:
            out.count()
    elif task == "loglike":
        r = commands.loglike(spark, **own).first()
        for key in ("log_likelihood", "log_hidden", "log_observed"):
            print(f"{key}\t{r[key]:.17g}")
    elif task == "dnm":
        for kind, rows in commands.dnm(spark, **own).items():
            _lines(denovo.text_rows(rows, kind), "line")
    else:
        out = getattr(commands, task)(spark, **own)
        print("\t".join(out.columns))
        for r in out.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in r))


if __name__ == "__main__":
    run(SparkSession.builder.appName("kinfold").getOrCreate(), sys.argv[1:])
