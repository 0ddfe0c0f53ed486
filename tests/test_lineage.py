import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import model as M
from kinfold.functions import pedigree as P
from kinfold.functions import text as X
from kinfold.functions import trees as T
from kinfold.operators import lineage, regions
from kinfold.plans import fitting
from kinfold.streaming.calls import start_calls


def random_sites(rng, n, m, tree):
    """Mutations on random branches of the tree, clear likelihoods."""
    b = T.branches(tree)
    out = []
    for k in range(n):
        hit = b[rng.integers(len(b))]
        out.append((k, [[100.0, 0.0, 100.0] if s in hit else [0.0, 80.0 + float(rng.integers(9)), 120.0] for s in range(m)]))
    return out


@pytest.fixture(scope="module")
def tree():
    return (((0, 1), 2), ((3, 4), 5))


@pytest.fixture(scope="module")
def sites(spark, tree):
    return spark.createDataFrame(random_sites(np.random.default_rng(1), 60, 6, tree), "site long, pl array<array<double>>").repartition(3).persist()


def test_likelihood_by_enumeration():
    rng = np.random.default_rng(2)
    pl, tree = rng.integers(0, 60, (2, 3, 3)).astype(float), ((0, 1), 2)
    m, same, changed = T.matrices(3, 20.0)
    prior = 10 ** (-T.base_prior(30, T.GENOTYPES3) / 10)
    assert prior.sum() == pytest.approx(1)
    p = 10 ** (-pl / 10)
    for s in range(2):
        total, none, one = 0.0, 0.0, 0.0
        for r, a, x, y, z in itertools.product(range(3), repeat=5):
            edges = [(a, x), (a, y), (r, a), (r, z)]
            data = prior[r] * p[s, 0, x] * p[s, 1, y] * p[s, 2, z]
            at = lambda k: [m, same, changed][k]
            prod = lambda ks: np.prod([at(k)[low, up] for k, (up, low) in zip(ks, edges, strict=True)])  # noqa: B023, E731
            total += data * prod((0, 0, 0, 0))
            none += data * prod((1, 1, 1, 1))
            one += data * sum(prod(tuple(2 if i == j else 1 for i in range(4))) for j in range(4))
        got = T.place(tree, pl, 20.0, 30.0)
        assert got["null_p"][s] == pytest.approx(none / total) and got["mut_p"][s] == pytest.approx(one / total)
        assert T.site_scores(tree, pl, 20.0, 30.0)[s] == pytest.approx(-10 * np.log10(none + one))


def test_matrix10_rows():
    sums = T.matrix10(40.0).sum(1)
    assert sums[0] == pytest.approx(1) and T.matrix3(40.0).sum(1) == pytest.approx(np.ones(3))


def test_shapes(tree):
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    joined = T.neighbour_joining(d)
    assert sorted(T.leaves(joined)) == list(range(5))
    assert T.compare(joined, (((0, 1), 2), (3, 4)))["norm_rf"] == 0
    assert len(T.rerooted(tree)) == 8 and all(sorted(T.leaves(x)) == list(range(6)) for x in T.neighbours(tree))
    assert T.compare(tree, tree) == {"norm_rf": 0.0, "ref_edges_in_tree": 1.0, "tree_edges_in_ref": 1.0, "distance": 0.0, "ratio": pytest.approx(1.0)}
    other = T.compare(tree, (((0, 3), 2), ((1, 4), 5)))
    assert other["norm_rf"] > 0 and other["ratio"] < 1
    with pytest.raises(ValueError):
        T.compare(tree, (0, 1))
    names = list("abcdef")
    assert T.from_twig(X.parse_newick(T.to_text(tree, names)), names) == tree
    assert T.drawn((0, (1, 2)), names, {"b": "x"}).splitlines() == ["+", "|-a", "`-+", "  |-b x", "  `-c"]


def test_search(spark, sites, tree):
    got = lineage.search(sites).collect()
    names = [str(k) for k in range(6)]
    for r in got:
        found = T.from_twig(X.parse_newick(r["tree"]), names)
        assert T.compare(tree, found)["norm_rf"] == 0
    # As good as the tree that made the sites.
    true = lineage.score_trees(sites, [tree]).first()["score"]
    assert min(r["score"] for r in got) <= true + 1e-6


def test_distances(sites):
    d = lineage.distances(sites)
    pl = np.array([r["pl"] for r in sites.collect()])
    p = 10 ** (-pl / 10)
    p /= p.sum(2, keepdims=True)
    for i, j in itertools.combinations(range(6), 2):
        assert d[i, j] == pytest.approx((1 - (p[:, i] * p[:, j]).sum(1)).sum())


def test_placements(spark, tree):
    names = list("abcdef")
    of = lambda g: [0.0 if x == g else 200.0 for x in T.GENOTYPES10]
    rows = [("1", 5, "A", [of("AC"), of("AC")] + [of("AA")] * 4), ("1", 6, "A", [of("AA")] * 6)]
    df = spark.createDataFrame(rows, "contig string, pos int, ref string, pl array<array<double>>")
    got = {r["pos"]: r for r in lineage.placements(df, tree, names).collect()}
    assert (got[5]["mut_smpl"], got[5]["mut_base"], got[5]["mut_alt"]) == ("a,b", "AA", "AC") and got[5]["mut_p"] > 0.99
    assert got[6]["null_p"] > 0.99 and got[6]["null_base"] == "AA"
    text = lineage.annotate(lineage.placements(df.where("pos = 5"), tree, names), tree, names)
    assert text == "(((a:0,b:0):1,c:0):0,((d:0,e:0):0,f:0):0);"


def test_compatibility(spark):
    rng = np.random.default_rng(4)
    pls = rng.integers(0, 3, (9, 4, 3)) * 30
    df = spark.createDataFrame([(i, pls[i].tolist()) for i in range(9)], "site long, pl array<array<long>>")
    got = {(r["i"], r["j"]): r["cost"] for r in lineage.compatibility(df, block=4).collect()}
    assert len(got) == 45
    for i in range(9):
        for j in range(i, 9):
            sums = {}
            for s in range(4):
                a, b = int(pls[i, s, 0] == 0), int(pls[j, s, 0] == 0)
                sums[2 * a + b] = sums.get(2 * a + b, 0) + min(pls[i, s, a], pls[j, s, b])
            assert got[i, j] == min(sums.get(g, 0) for g in range(max(sums) + 1))


def test_two_alleles(spark):
    df = spark.createDataFrame([([[5, 1, 4], [0, 3, 0]], [[0, 1, 2, 3, 4, 5], [9, 8, 7, 6, 5, 4]])], "ad array<array<int>>, pl array<array<int>>")
    got = df.select(lineage.two_alleles(F.col("ad")).alias("a"), "pl").select("a", lineage.three_genotypes(F.col("pl"), F.col("a")).alias("g"), lineage.is_singleton(F.col("pl")).alias("s")).first()
    assert got["a"] == [0, 2] and got["g"] == [[0, 3, 5], [9, 6, 4]] and got["s"]


def test_regions(spark):
    f = spark.createDataFrame([(1, "1", 0, 10), (2, "1", 20, 24), (3, "2", 0, 4)], "id long, contig string, beg long, end long")
    r = spark.createDataFrame([("1", 5, 12), ("1", 8, 10), ("1", 19, 25), ("1", 30, 31)], "contig string, beg long, end long")
    want = {"any": [1, 1, 0], "count": [2, 1, 0], "fraction": [0.5, 1, 0], "reciprocal": [1, 1, 0], "point": [0, 1, 0]}
    for mode, values in want.items():
        got = dict(regions.annotate(f, r, mode, least=0.5 if mode != "reciprocal" else 0.5, width=4).collect())
        assert [got[k] for k in (1, 2, 3)] == values, mode
    s = spark.createDataFrame([("1", 9), ("1", 12), ("2", 9)], "contig string, pos long")
    assert regions.within(s, r, 4).collect() == [("1", 9)]
    assert sorted(regions.merge_as_last(r).collect()) == [("1", 5, 10), ("1", 19, 25), ("1", 30, 31)]
    c = spark.createDataFrame([("chr1",), ("chrX",), ("Y",), ("chr1_random",)], "c string")
    assert [x[0] for x in c.select(regions.chromosome(F.col("c"))).collect()] == ["1", "23", None, None]


PED = "##PEDNG\nM . . 2 M\nD . . 1 D\nK D M 2 K\n"


def test_stream_and_fit(spark, tmp_path):
    graph = P.build(X.parse_pedigree(PED), [("D", "D"), ("K", "K"), ("M", "M")])
    rows = [("1", k, ["G", "T"], [[30, k % 2], [15, 14], [29, 15 * (k % 2)]]) for k in range(20)] + [("1", 99, ["G", "T"], [[34, 0], [15, 20], [43, 1]])]
    sites = spark.createDataFrame(rows, "contig string, pos int, alleles array<string>, ad array<array<int>>")
    sites.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sites.schema).parquet(str(tmp_path / "in"))
    start_calls(stream, graph, ["D", "K", "M"], str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    assert 99 in {r["pos"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    x, value = fitting.nelder_mead(lambda v: float(((v - np.array([0.3, 0.05])) ** 2).sum()), np.array([0.9, 0.9]), np.zeros(2), np.ones(2), 200, 1e-14)
    assert x == pytest.approx([0.3, 0.05], abs=1e-3) and value < 1e-6
    p, better = fitting.fit(sites.coalesce(1), graph, ["D", "K", "M"], ["lib_error"], M.Parameters(), steps=3)
    from kinfold.operators.pedigree_calling import log_likelihood

    assert better >= log_likelihood(sites, graph, ["D", "K", "M"]).first()["log_likelihood"] and 1e-6 <= p.lib_error <= 0.1
