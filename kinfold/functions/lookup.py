"""Trio and pair configurations of the lookup-table caller, each derived from Mendel's rules.

Arrays are [mom, dad, child] or [normal, tumor], so that the first of equal maxima is the smallest mom (normal) first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Diploid genotypes of SNPs, and of indels (reference, different).
SNP = ("AA", "AC", "AG", "AT", "CC", "CG", "CT", "GG", "GT", "TT")
INDEL = ("RR", "RD", "DD")
#: Shares of sites and of site frequencies, in priors.
_MONOMORPHIC, _BIALLELIC, _VARIANT, _TRIALLELIC_CASES = 0.995, 0.998, 0.002, 414
_FOUR_ALLELES = 1e-26
_INDEL_ERROR = 0.05
#: Ln of an indel's rate is slope * length + intercept.
INSERTION = (-0.2994, -22.8689)
DELETION = (-0.2856, -21.9313)
MODELS = ("auto", "XS", "XD")


@dataclass(frozen=True)
class Configuration:
    n_alleles: int
    code: int
    #: Probability that the parents pass the child's genotype on.
    passed: float
    #: Mutations needed; None: the configuration can't occur.
    mutations: int | None
    denovo: bool


def _het(g: str) -> bool:
    return g[0] != g[1]


def _turn(a: str, b: str) -> int:
    """4: transition, 5: transversion."""
    return 4 if {a, b} in ({"A", "G"}, {"C", "T"}) else 5


def _base_code(child: str, mom: str, dad: str) -> int:
    return 9 if _het(child) else {(False, False): 6, (True, False): 7, (False, True): 8, (True, True): 9}[_het(dad), _het(mom)]


def _origin(child: str, mom: str, dad: str) -> str:
    if any(a not in mom + dad for a in child):
        return "new"
    if not any(a in mom for a in child):
        return "dad"
    return "mom" if not any(a in dad for a in child) else "both"


def snp_configuration(child: str, mom: str, dad: str, model: str) -> Configuration:
    n = len({*child, *mom, *dad})
    if model != "auto" and (n > 2 or _het(dad) or (model == "XS" and _het(child))):
        return Configuration(n, 9, 0.0, None, False)
    if n == 4:
        return Configuration(n, 9, 0.0, 0, False)
    share = 0.5 ** (_het(mom) + _het(dad))
    if n == 3:
        x, y = child
        if (x in dad and y in mom) or (x in mom and y in dad):
            return Configuration(n, 9, 0.25 if not _het(child) or share == 0.25 else 0.5, 0, False)
        return Configuration(n, 9, 1.0, 2 if not {x, y} & {*mom, *dad} else 1, True)
    origin, code = _origin(child, mom, dad), _base_code(child, mom, dad)
    if origin == "both":
        return Configuration(n, code, max(share, 0.5) if _het(child) else share, 0, False)
    alleles = sorted({*child, *mom, *dad})
    if origin == "new":
        if _het(child):
            return Configuration(n, _turn(*alleles), 1.0, 1, True)
        return Configuration(n, 3, 1.0, 1 if model == "XS" else 2, True)
    if origin == "mom" and model == "XS":
        return Configuration(n, 2, 1.0, 0, False)
    return Configuration(n, _turn(*alleles), 1.0, 1, True)


def indel_configuration(child: str, mom: str, dad: str, model: str) -> Configuration:
    n = len({*child, *mom, *dad})
    code = _base_code(child, mom, dad)
    if model != "auto" and (_het(dad) or (model == "XS" and _het(child))):
        return Configuration(n, code, 0.0, 0, False)
    origin = _origin(child, mom, dad)
    share = 0.5 ** (_het(mom) + _het(dad))
    if origin == "new":
        return Configuration(n, 3, 1.0, 1 if _het(child) or model == "XS" else 2, True)
    if origin in ("dad", "mom"):
        code = 1 if origin == "dad" else 2
        return Configuration(n, code, 0.0, 0, False) if model == "auto" else Configuration(n, code, 1.0, 1, True)
    return Configuration(n, code, max(share, 0.5) if _het(child) else share, 0, False)


def _frequency(hits: int, homozygous: bool) -> float:
    """Of a biallelic site with so many copies of the reference in the parents, as a share of such sites."""
    if hits == 2:
        return 2 / 5 * 1 / 5 * 0.5 if homozygous else 2 / 5 * 2 / 5
    return {0: 3 / 5 * 1 / 5, 3: 3 / 5 * 4 / 5 * 0.5, 1: 2 / 5 * 2 / 5 * 0.5}[hits]


def snp_prior(child: str, mom: str, dad: str, ref: str, poly: float, x_linked: bool) -> float:
    """Of the parents' genotypes at a site with this reference base."""
    parents = mom + dad
    n, kinds, hits = len({*child, *parents}), len({*parents}), parents.count(ref)
    rare = _VARIANT * _VARIANT / _TRIALLELIC_CASES
    if n > 3:
        out = _FOUR_ALLELES
    elif kinds == 3 or (n < 3 and hits == 0 and kinds == 2):
        out = rare
    elif n == 3:
        out = poly * poly
    elif hits == 4:
        out = _MONOMORPHIC * _BIALLELIC
    else:
        out = _MONOMORPHIC * _VARIANT * _frequency(hits, not _het(mom) and not _het(dad))
    return out * (0.75 if x_linked else 1.0)


def indel_prior(mom: str, dad: str, x_linked: bool) -> float:
    hits = (mom + dad).count("R")
    out = _INDEL_ERROR if hits == 4 else (1 - _INDEL_ERROR) * _frequency(hits, not _het(mom) and not _het(dad))
    return out * (0.75 if x_linked else 1.0)


@lru_cache(32)
def snp_table(model: str, rate: float, poly: float) -> dict[str, np.ndarray]:
    """weight [ref, mom, dad, child]: transmission x prior x mutation; denovo, code, n_alleles."""
    if model not in MODELS:
        raise ValueError(f"model '{model}' is not known")
    rows = [[[snp_configuration(c, m, d, model) for c in SNP] for d in SNP] for m in SNP]
    get = lambda f: np.array([[[f(x) for x in r] for r in plane] for plane in rows])
    chance = {None: 0.0, 0: 1 - rate, 1: rate, 2: rate * rate}
    prior = np.array([[[[snp_prior(c, m, d, ref, poly, model != "auto") for c in SNP] for d in SNP] for m in SNP] for ref in "ACGT"])
    return {"weight": prior * get(lambda x: x.passed * chance[x.mutations]), "denovo": get(lambda x: x.denovo), "code": get(lambda x: x.code), "n_alleles": get(lambda x: x.n_alleles)}


@lru_cache(8)
def indel_table(model: str) -> dict[str, np.ndarray]:
    """weight [mom, dad, child] but for mutations; hits: how many of these."""
    if model not in MODELS:
        raise ValueError(f"model '{model}' is not known")
    rows = [[[indel_configuration(c, m, d, model) for c in INDEL] for d in INDEL] for m in INDEL]
    get = lambda f: np.array([[[f(x) for x in r] for r in plane] for plane in rows])
    prior = np.array([[[indel_prior(m, d, model != "auto")] * 3 for d in INDEL] for m in INDEL])
    return {"weight": prior * get(lambda x: x.passed), "hits": get(lambda x: x.mutations or 0), "denovo": get(lambda x: x.denovo), "code": get(lambda x: x.code), "n_alleles": get(lambda x: x.n_alleles)}


@lru_cache(8)
def pair_table(rate: float) -> dict[str, np.ndarray]:
    """[normal, tumor]: prior (mutations between the genotypes), denovo, code (1: both homozygous ... 4: neither)."""

    def changed(n: str, t: str) -> int:
        rest = list(t)
        for a in n:
            if a in rest:
                rest.remove(a)
        return len(rest)

    k = np.array([[changed(n, t) for t in SNP] for n in SNP])
    code = np.array([[1 + 2 * _het(n) + _het(t) for t in SNP] for n in SNP])
    return {"weight": np.choose(k, [1 - rate, rate, rate * rate]), "denovo": k > 0, "code": code}


def indel_rate(ref: str, alt: str, rate: float, scale: float) -> float:
    """The given rate, or if that is 0 the one of the indel's length; scaled."""
    slope, intercept = INSERTION if len(alt) > len(ref) else DELETION
    return scale * (rate if rate else float(np.exp(slope * abs(len(ref) - len(alt)) + intercept)))
