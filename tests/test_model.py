import itertools
import math

import numpy as np
import pytest

from kinfold.functions import model as M
from kinfold.functions import stats


def call(dad, kid, mom):
    return {k: v[0] for k, v in M.trio_statistics(*(np.array([x]) for x in (dad, kid, mom))).items()}


def test_known_trio_site():
    got = call((34, 0), (15, 20), (43, 1))
    want = {"qual": 301.941, "mutq": 48.1562, "mutx": 0.999985, "lld": -22.6485, "lls": 0.914317, "llh": -8.30233, "dnp": 0.999985}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=2e-5), k


def test_sites_without_reads():
    got = call((0, 0), (0, 0), (0, 0))
    assert got["qual"] == pytest.approx(0.00325621, rel=1e-4) and got["mutq"] == pytest.approx(2.17147e-08, rel=1e-4) and got["lld"] == pytest.approx(-0.000976457, rel=1e-4)
    got = call((0,) * 4, (0,) * 4, (0,) * 4)
    assert got["qual"] == pytest.approx(0.0097666, rel=1e-4) and got["lld"] == pytest.approx(-0.000325418, rel=1e-4)


def test_likelihoods_by_enumeration():
    p, a = M.Parameters(), M.alphas(M.Parameters())
    depth = np.array([7, 3, 1])
    got = M.genotype_likelihoods(depth, 3, p)
    rise = lambda x, n: math.fsum(math.log(x + i) for i in range(n))
    for g, (lo, hi) in enumerate(M.pairs(3)):
        want = 0.0
        for i, d in enumerate(depth.tolist()):
            if lo == hi:
                want += rise(a["match" if i == lo else "miss"], d)
            elif i not in (lo, hi):
                want += rise(a["het_miss"], d)
            else:
                want += rise(a["het_any" if lo else ("het_ref" if i == lo else "het_alt")], d)
        want -= rise(a["hom" if lo == hi else "het"], int(depth.sum()))
        assert got[g] == pytest.approx(want, rel=1e-9)


def test_matrices():
    full = M.allele_matrix(5, 0.3, 5.0)
    assert full.sum(1) == pytest.approx(np.ones(5))
    assert sum(M.event_matrix(5, 0.3, 5.0, x) for x in range(30)) == pytest.approx(full)
    assert sum(x * M.event_matrix(5, 0.3, 5.0, x) for x in range(30)) == pytest.approx(M.mean_matrix(5, 0.3, 5.0))
    assert M.child(M.gametes(full), M.gametes(full)).sum(-1) == pytest.approx(np.ones((15, 15)))


def test_lgamma():
    x = np.array([1e-3, 0.33, 1.0, 7.9, 8.0, 1999.5, 1e6])
    assert M.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_tests():
    assert stats.fisher(6, 12, 12, 5) == pytest.approx(0.04371017, rel=1e-6)
    assert stats.fisher(20, 200, 19, 301) == pytest.approx(0.1679341, rel=1e-6)
    assert stats.anderson_darling([40, 31, 35, 40, 40, 32, 33], [21, 31, 33, 34, 34, 40, 42, 20]) == pytest.approx(-0.52579911592960638, rel=1e-9)


def test_trio_by_enumeration():
    p = M.Parameters(mu=0.01)
    depth = [np.array([[9, 1]]), np.array([[4, 5]]), np.array([[8, 0]])]
    got = M.trio_statistics(*depth, p)
    l = [np.exp(M.genotype_likelihoods(d[0], 2, p)) for d in depth]
    prior, m = M.diploid_prior(2, p), M.allele_matrix(2, p.mu, p.k_alleles)
    total = 0.0
    for d, c, mo in itertools.product(range(3), repeat=3):
        for x, y in itertools.product(M.pairs(2)[d], M.pairs(2)[mo]):
            for i, j in itertools.product(range(2), repeat=2):
                if tuple(sorted((i, j))) == M.pairs(2)[c]:
                    total += prior[d] * prior[mo] * l[0][d] * l[2][mo] * l[1][c] * m[x, i] * m[y, j] / 4
    assert got["lld"][0] == pytest.approx(math.log10(total), rel=1e-9)
