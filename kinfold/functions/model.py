"""Genotype, mutation and prior models as small NumPy arrays; built on the driver, applied to batches of sites.

Diploid genotypes are in the order 0/0, 0/1, 1/1, 0/2, 1/2, 2/2, ...; transition arrays have parents first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class Parameters:
    """Defaults are the usual ones for human trios."""

    mu: float = 1e-8
    theta: float = 0.001
    k_alleles: float = 5.0
    bias_hom: float = 0.0
    bias_het: float = 0.0
    bias_hap: float = 0.0
    lib_bias: float = 1.0
    lib_error: float = 0.0005
    lib_k: float = 4.0
    over_hom: float = 0.0005
    over_het: float = 0.0005


def pairs(n: int) -> list[tuple[int, int]]:
    """Alleles (b, a), b <= a, of the diploid genotypes of n alleles."""
    return [(b, a) for a in range(n) for b in range(a + 1)]


def allele_matrix(n: int, u: float, k: float) -> np.ndarray:
    """P(allele j | allele i) along a branch of length u; n of k alleles are seen."""
    off = -np.expm1(-u * k / (k - 1)) / k
    return np.full((n, n), off) + np.eye(n) * (1 - k * off)


def event_matrix(n: int, u: float, k: float, events: int) -> np.ndarray:
    """The same, jointly with exactly so many mutations."""
    r = (-1 / (k - 1)) ** events
    weight = np.exp(-u) * u**events / np.prod(np.arange(1, events + 1), dtype=float)
    return weight * (np.full((n, n), (1 - r) / k) + np.eye(n) * r)


def mean_matrix(n: int, u: float, k: float) -> np.ndarray:
    """Expected number of mutations times the probability."""
    r = -1 / (k - 1)
    turned = u * r * np.exp(u * (r - 1))
    return np.full((n, n), (u - turned) / k) + np.eye(n) * turned


def gametes(m: np.ndarray) -> np.ndarray:
    """From a diploid parent's genotype to the allele passed on."""
    return np.array([(m[b] + m[a]) / 2 for b, a in pairs(len(m))])


def child(dad: np.ndarray, mom: np.ndarray) -> np.ndarray:
    """[dad, mom, child] of two parents' gamete matrices; alleles of the child are not ordered."""
    both = np.einsum("di,mj->dmij", dad, mom)
    n = dad.shape[1]
    return np.stack([both[..., b, a] + (both[..., a, b] if a != b else 0) for b, a in pairs(n)], -1)


def check_prior(p: Parameters) -> None:
    """ValueError if the founders' chances would leave 0 to 1."""
    k, e = p.k_alleles, p.theta / (p.k_alleles - 1) if p.k_alleles > 1 else -1.0
    if p.theta < 0 or k < 2:
        raise ValueError("theta has to be 0 at least, and the alleles 2")
    for name, value, top, others in (("bias_hom", p.bias_hom, 2 + e, k - 1), ("bias_het", p.bias_het, 2 + 2 * e, k - 2), ("bias_hap", p.bias_hap, 1 + e, k - 1)):
        if value > 1 or (e > 0 and others > 0 and value < -top / (others * e)):
            raise ValueError(f"{name} {value} is out of range")


def diploid_prior(n: int, p: Parameters) -> np.ndarray:
    check_prior(p)
    k, e = p.k_alleles, p.theta / (p.k_alleles - 1)
    hom, het, scale = (1 + e) / (1 + k * e), e / (1 + k * e), 2 + k * e
    ref_ref = hom * (2 + e + (k - 1) * e * p.bias_hom) / scale
    alt_alt = hom * e * (1 - p.bias_hom) / scale
    ref_alt = het * (2 + 2 * e + (k - 2) * e * p.bias_het) / scale
    alt_alt2 = het * 2 * e * (1 - p.bias_het) / scale
    return np.array([(ref_ref if a == 0 else alt_alt) if a == b else (ref_alt if b == 0 else alt_alt2) for b, a in pairs(n)])


def haploid_prior(n: int, p: Parameters) -> np.ndarray:
    check_prior(p)
    k, e = p.k_alleles, p.theta / (p.k_alleles - 1)
    out = np.full(n, e * (1 - p.bias_hap) / (1 + k * e))
    out[0] = (1 + e + (k - 1) * e * p.bias_hap) / (1 + k * e)
    return out


def alphas(p: Parameters) -> dict[str, float]:
    """Dirichlet parameters of reads given a genotype."""
    tiny = np.finfo(float).eps / 2
    hom, het = ((1 - max(o, tiny)) / max(o, tiny) for o in (p.over_hom, p.over_het))
    error = max(p.lib_error, tiny)
    right, wrong = 1 - error, error / (p.lib_k - 1)
    share = p.lib_bias / (1 + p.lib_bias)
    both = right + wrong
    return {
        "match": hom * right,
        "miss": hom * wrong,
        "het_ref": het * both * share,
        "het_alt": het * both * (1 - share),
        "het_any": het * both / 2,
        "het_miss": het * wrong,
        "hom": hom,
        "het": het,
    }


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive values: shifted up, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series


def log_rising(alpha: float, n: np.ndarray) -> np.ndarray:
    """ln of alpha (alpha + 1) ... (alpha + n - 1)."""
    return lgamma(alpha + np.asarray(n, float)) - lgamma(np.full(np.shape(n), alpha))


def genotype_likelihoods(depth: np.ndarray, n: int, p: Parameters, ploidy: int = 2) -> np.ndarray:
    """[..., allele] read counts to [..., genotype] ln P(reads | genotype), of the first n alleles."""
    a = alphas(p)
    seen = {k: log_rising(v, depth) for k, v in a.items() if k not in ("hom", "het")}
    total = depth.sum(-1)
    hom, het = log_rising(a["hom"], total), log_rising(a["het"], total)
    out = []
    for lo, hi in pairs(n) if ploidy == 2 else [(i, i) for i in range(n)]:
        if lo == hi:
            out.append(seen["miss"].sum(-1) - seen["miss"][..., hi] + seen["match"][..., hi] - hom)
        else:
            names = ("het_ref", "het_alt") if lo == 0 else ("het_any", "het_any")
            rest = seen["het_miss"].sum(-1) - seen["het_miss"][..., lo] - seen["het_miss"][..., hi]
            out.append(rest + seen[names[0]][..., lo] + seen[names[1]][..., hi] - het)
    return np.stack(out, -1)


@lru_cache(64)
def trio_arrays(n: int, p: Parameters) -> dict[str, np.ndarray]:
    """[dad, mom, child] arrays, priors of the parents included: full, without mutation, with exactly one, expected number."""
    u, k = p.mu, p.k_alleles
    full, none, one, mean = (gametes(m) for m in (allele_matrix(n, u, k), event_matrix(n, u, k, 0), event_matrix(n, u, k, 1), mean_matrix(n, u, k)))
    prior = diploid_prior(n, p)
    joint = np.einsum("d,m->dm", prior, prior)[..., None]
    return {"full": joint * child(full, full), "none": joint * child(none, none), "one": joint * (child(one, none) + child(none, one)), "mean": joint * (child(mean, full) + child(full, mean))}


def trio_statistics(dad: np.ndarray, kid: np.ndarray, mom: np.ndarray, p: Parameters = Parameters()) -> dict[str, np.ndarray]:
    """Statistics of sites with [site, allele] read counts: qual, mutq, mutx, dnp, lld, lls, llh."""
    n = min(4, dad.shape[1])
    lls = [genotype_likelihoods(x[:, :n], n, p) for x in (dad, kid, mom)]
    tops = [x.max(-1) for x in lls]
    d, c, m = (np.exp(x - t[:, None]) for x, t in zip(lls, tops, strict=True))
    arrays = trio_arrays(n, p)
    value = {k: np.einsum("dmc,sd,sm,sc->s", w, d, m, c, optimize=True) for k, w in arrays.items()}
    scale = sum(tops)
    alone = trio_arrays(1, p)["full"].item()
    mono = alone * d[:, 0] * m[:, 0] * c[:, 0]
    total = (dad + kid + mom)[:, :n].astype(float)
    depth = total.sum(-1)
    xlog = lambda x: x * np.log10(np.where(x > 0, x, 1))
    lld = (np.log(value["full"]) + scale) / np.log(10)
    return {
        "qual": -10 * np.log10(mono / value["full"]),
        "mutq": -10 * np.log10(value["none"] / value["full"]),
        "mutx": value["mean"] / value["full"],
        "dnp": value["one"] / value["full"],
        "lld": lld,
        "lls": lld - (xlog(total).sum(-1) - xlog(depth)),
        "llh": lld - scale / np.log(10),
    }
