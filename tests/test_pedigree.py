import itertools
import math

import numpy as np
import pytest

from kinfold.functions import model as M
from kinfold.functions import pedigree as P
from kinfold.functions import text as T

TRIO = "##PEDNG v1.0\nMom . . 2 M\nDad . . 1 D\nKid Dad Mom 2 K\n"
QUAD = "##PEDNG\nDad . . 1 DadSm\nMom . . 2 MomSm\nEve Dad Mom 2 EveSm\nBob Dad Mom 1 BobSm\n"


def trio(model="autosomal", ped=TRIO, **kw):
    return P.build(T.parse_pedigree(ped), [("D", "D"), ("K", "K"), ("M", "M")], model, **kw)


def stats(graph, *depth):
    by = dict(zip("DKM", depth, strict=False))
    return P.statistics(graph, np.array([[by[x] for x in graph.libraries]]))


def test_trio_as_known():
    g = trio()
    assert [v.label for v in g.nodes] == ["GL/Mom", "GL/Dad", "LB/D", "LB/K", "LB/M"]
    got = stats(g, (34, 0), (15, 20), (43, 1))
    want = {"qual": 301.941, "mutq": 48.1562, "mutx": 0.999985, "lld": -22.6485, "lls": 0.914317, "llh": -8.30233, "dnp": 0.999985}
    for k, v in want.items():
        assert got[k][0] == pytest.approx(v, rel=2e-5), k
    assert got["dnq"][0] in (130, 131)
    assert P.mutation_text(g, got["dnl"][0], got["dnt_row"][0], got["dnt_col"][0], ["G", "T"]) == "G/G*G/G->G/T"
    assert got["gq"][0].tolist() == [49, 57, 57, 255, 49]
    assert [x[0].tolist() for x in got["pl"]] == [[0, 101, 753], [385, 0, 282], [0, 93, 871]]


def test_trio_x_linked():
    got = stats(trio("x-linked"), (34, 0), (15, 20), (43, 1))
    want = {"qual": 301.941, "mutq": 48.7418, "mutx": 0.999987, "lld": -22.6482, "lls": 0.914533, "llh": -8.30211, "dnp": 0.999987}
    for k, v in want.items():
        assert got[k][0] == pytest.approx(v, rel=2e-5), k
    assert got["dnq"][0] == 132


def test_y_linked_has_only_the_father():
    g = trio("y-linked")
    assert g.libraries == ["D"]
    got = stats(g, (34,))
    assert got["lld"][0] == pytest.approx(-0.00775852, rel=1e-4) and got["llh"][0] == pytest.approx(-0.000433969, rel=1e-4)


def test_no_reads():
    g = trio()
    got = stats(g, *[(0,) * 2] * 3)
    assert got["dnq"][0] == 31 and got["dnp"][0] == pytest.approx(5e-9, rel=1e-3)
    assert P.mutation_text(g, got["dnl"][0], got["dnt_row"][0], got["dnt_col"][0], ["A", "C"]) == "A/A*A/A->A/C"
    assert stats(g, *[(0,) * 4] * 3)["dnq"][0] == 2


def test_quad_graphs():
    libs = [(f"{x}Lb", f"{x}Sm") for x in ("Dad", "Mom", "Eve", "Bob")]
    g = P.build(T.parse_pedigree(QUAD), libs, "x-linked", 1e-8, 3e-8, 5e-8)
    assert [v.label for v in g.nodes] == ["GL/Dad", "GL/Mom", "LB/DadSm/DadLb", "LB/MomSm/MomLb", "LB/EveSm/EveLb", "LB/BobSm/BobLb"]
    assert [v.ploidy for v in g.nodes] == [1, 2, 1, 2, 2, 1]
    assert [[(p, pytest.approx(u, rel=1e-6)) for p, u, _ in v.ups] for v in g.nodes] == [[], [], [(0, 8e-8)], [(1, 8e-8)], [(0, 9e-8), (1, 9e-8)], [(1, 9e-8)]]


def brute(graph, depth, p, kind="full"):
    """Sum over all genotypes of all nodes."""
    n = depth.shape[1]
    widths = [n * (n + 1) // 2 if v.ploidy == 2 else n for v in graph.nodes]
    libs = iter(depth)
    lik = {i: np.exp(M.genotype_likelihoods(next(libs), n, p, v.ploidy)) for i, v in enumerate(graph.nodes) if v.kind == "library"}
    arrays = {i: P.transition(v, graph.nodes, n, p.k_alleles, kind) for i, v in enumerate(graph.nodes) if v.ups}
    prior = {1: M.haploid_prior(n, p), 2: M.diploid_prior(n, p)}
    total, marginal = 0.0, [np.zeros(w) for w in widths]
    for g in itertools.product(*map(range, widths)):
        x = 1.0
        for i, v in enumerate(graph.nodes):
            ups = [q for q, _, _ in sorted(v.ups, key=lambda u: u[2] == "mom")]
            x *= arrays[i][tuple(g[q] for q in ups) + (g[i],)] if ups else prior[v.ploidy][g[i]]
            if i in lik:
                x *= lik[i][g[i]]
        total += x
        for i, j in enumerate(g):
            marginal[i][j] += x
    return total, [m / total for m in marginal]


PEDS = {
    "quad": (QUAD, [("DadSm", "DadSm"), ("EveSm", "EveSm"), ("BobSm", "BobSm")]),
    "half sibs": ("##PEDNG\nA . . 1 a\nB . . 2 b\nC . . 2 c\nD A B 1 d\nE A C 2 e\n", [(x, x) for x in "abde"]),
    "three generations": ("##PEDNG\nA . . 1 .\nB . . 2 b\nC A B 1 c\nD . . 2 d\nE C D 2 e\n", [(x, x) for x in "bcde"]),
    "somatic": ("##PEDNG\nA . . 2 ((x,y)xy,z);\n", [(x, x) for x in "xyz"]),
    "gametes": ("##PEDNG\nA . . 1 a\nS@gamete A . 2 s\nT@haploid A . 1 t\nC@clone A . 1 c\n", [(x, x) for x in "astc"]),
}


@pytest.mark.parametrize("name", PEDS)
@pytest.mark.parametrize("model", ["autosomal", "x-linked", "maternal", "z-linked"])
def test_by_enumeration(name, model):
    ped, libs = PEDS[name]
    p = M.Parameters()
    graph = P.build(T.parse_pedigree(ped), libs, model, 0.02, 0.03, 0.01)
    if not graph.nodes:
        return
    depth = np.random.default_rng(3).integers(0, 9, (len(graph.libraries), 2))
    got = P.statistics(graph, depth[None], p)
    total, marginal = brute(graph, depth, p)
    none, _ = brute(graph, depth, p, "none")
    assert got["lld"][0] == pytest.approx(math.log10(total), rel=1e-9)
    assert got["mutq"][0] == pytest.approx(-10 * math.log10(none / total), rel=1e-6, abs=1e-9)
    for i, m in enumerate(marginal):
        assert got["post"][i][0] == pytest.approx(m, rel=1e-8, abs=1e-12)


def test_one_mutation_by_enumeration():
    ped, libs = PEDS["half sibs"]
    graph, p = P.build(T.parse_pedigree(ped), libs, "autosomal", 0.02, 0.03, 0.01), M.Parameters()
    depth = np.array([[9, 1], [3, 3], [5, 0], [0, 6]])
    got = P.statistics(graph, depth[None], p)
    total = brute(graph, depth, p)[0]
    want, mean = 0.0, 0.0
    real = P.transition
    try:
        for c, v in enumerate(graph.nodes):
            if v.ups:
                P.transition = lambda node, nodes, n, k, kind, v=v: real(node, nodes, n, k, "one" if node is v else "none")
                want += brute(graph, depth, p)[0]
                P.transition = lambda node, nodes, n, k, kind, v=v: real(node, nodes, n, k, "mean" if node is v else "full")
                mean += brute(graph, depth, p)[0]
    finally:
        P.transition = real
    assert got["dnp"][0] == pytest.approx(want / total, rel=1e-8)
    assert got["mutx"][0] == pytest.approx(mean / total, rel=1e-8)
    assert got["node_dnp"][0].sum() == pytest.approx(1)


@pytest.mark.parametrize("rows", ["A B C 1 .\nB . . 1 .\nC . . 1 .", "A B B 1 .\nB . . 0 .", "A B C 1 .\nB . . 1 .", "A@clone B C 1 .\nB . . 1 .\nC . . 2 .", "A B . 1 .\nB . . 1 ."])
def test_refused_pedigrees(rows):
    with pytest.raises(ValueError):
        P.build(T.parse_pedigree("##PEDNG\n" + rows + "\n"), [])


def test_loop_is_refused():
    ped = "##PEDNG\nA . . 1 a\nB . . 2 b\nC A B 1 c\nD A B 2 d\nE C D 1 e\n"
    with pytest.raises(ValueError, match="loop"):
        P.build(T.parse_pedigree(ped), [(x, x) for x in "abcde"])


def test_texts():
    assert T.percent_decode("a%20b%zzc%4") == "a bc" and T.percent_decode("%C3%A9+") == "é+"
    assert T.file_type("x/y.vcf.gz") == ("x/y.vcf.gz", "vcf", "gz") and T.file_type("bam:-") == ("-", "bam", "")
    assert T.file_type(".hidden")[1] == "" and T.file_type("vcf.gz:a.txt") == ("a.txt", "vcf", "gz")
    with pytest.raises(ValueError):
        T.input_mode(["a.bam", "b.vcf"])
    t = T.parse_newick("((M1:2,M2)M12,M3:0.5);")
    assert t.leaves() == ["M1", "M2", "M3"] and T.write_newick(t, False) == "((M1,M2)M12,M3);"
    for bad in ("", "(a,b", "a b", "(,)", "(a,b))"):
        with pytest.raises(ValueError):
            T.parse_newick(bad)
    assert T.parse_sex("Fem") == "female" and T.parse_inheritance("x") == "x-linked" and T.parse_inheritance("m") == "maternal"
    with pytest.raises(ValueError):
        T.parse_inheritance("")


def test_regions_and_cigars():
    got = T.parse_regions("1 2:5 3:1,000-2,000\n4:7- 5:-9 6:11+10 7:1.2e3-1.3e3")
    assert got == [("1", None, None), ("2", 5, 5), ("3", 1000, 2000), ("4", 7, None), ("5", 1, 9), ("6", 11, 20), ("7", 1200, 1300)]
    for bad in ("", "1:", "1:a", "1:5-x"):
        with pytest.raises(ValueError):
            T.parse_regions(bad)
    assert T.region_ranges([("b", None, 5), ("a", 3, None)], {"a": 9, "b": 4}) == [(1, 0, 4), (0, 2, 9)]
    with pytest.raises(ValueError):
        T.region_ranges([("a", 10, 12)], {"a": 9})
    assert T.query_length("2S3M1D4M2I") == 11 and T.target_length("2S3M1D4M2I") == 8
    assert [T.query_position("2S3M1D4M", x) for x in (-1, 0, 2, 3, 4)] == [(-1, False), (2, False), (4, False), (5, True), (5, False)]
