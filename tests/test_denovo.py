import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import lookup as L
from kinfold.operators import denovo, phasing


def test_known_indel_rows():
    want = {"RR/RR/RR": (1, 6, 1, 0, 0.05), "RD/RD/RD": (2, 9, 0.5, 0, 0.152), "RD/RR/RR": (2, 3, 1, 1, 0.05), "RR/DD/RD": (2, 1, 0, 0, 0.076), "DD/DD/RR": (2, 2, 0, 0, 0.038), "RR/DD/DD": (2, 3, 1, 1, 0.114), "DD/RD/DD": (2, 8, 0.5, 0, 0.076), "DD/DD/RD": (2, 7, 0.5, 0, 0.076), "DD/RD/RD": (2, 9, 0.25, 0, 0.152)}
    for names, (n, code, passed, new, prior) in want.items():
        c, m, d = names.split("/")
        x = L.indel_configuration(c, m, d, "auto")
        assert (x.n_alleles, x.code, x.passed, x.denovo) == (n, code, passed, bool(new)), names
        assert L.indel_prior(m, d, False) == pytest.approx(prior)


def test_known_pair_rows():
    t = L.pair_table(1e-9)
    want = {"AA/AA": 0.999999999, "AC/AA": 1e-9, "CC/AA": 1e-18, "CG/AA": 1e-18, "AA/AC": 1e-9, "AG/AC": 1e-9, "CC/AC": 1e-9, "GT/AC": 1e-18, "CT/AG": 1e-18, "GG/AG": 1e-9}
    for names, prior in want.items():
        n, u = (L.SNP.index(x) for x in names.split("/"))
        assert t["weight"][n, u] == pytest.approx(prior)


def test_snp_configurations():
    f = lambda names, model="auto": L.snp_configuration(*names.split("/"), model)
    assert f("AG/GG/GG") == L.Configuration(2, 4, 1.0, 1, True)
    assert f("AA/GG/GG") == L.Configuration(2, 3, 1.0, 2, True) and f("AA/GG/GG", "XS").mutations == 1
    assert f("AC/AG/CC").passed == 0.5 and not f("AC/AG/CC").denovo
    assert f("AA/CC/GG").mutations == 2 and f("AC/GG/AA").mutations == 1
    assert f("AA/AA/CC", "XS") == L.Configuration(2, 2, 1.0, 0, False) and f("AA/AA/CC", "XD").denovo
    assert f("AC/AA/CC", "XS").mutations is None and f("AA/AA/AC", "XD").mutations is None
    # Without mutation, what parents pass on sums to one where no configuration is triallelic.
    for m, d in itertools.product(("AA", "AC", "CC"), repeat=2):
        assert sum(f(f"{c}/{m}/{d}").passed for c in ("AA", "AC", "CC") if not f(f"{c}/{m}/{d}").denovo) == pytest.approx(1)


def pl(spark, **cols):
    return spark.createDataFrame([cols])


def test_trio_snp_by_enumeration(spark):
    rng = np.random.default_rng(5)
    pls = {w: [int(x) for x in rng.integers(0, 60, 10)] for w in ("child", "mom", "dad")}
    row = pl(spark, site=1, ref="G", **{f"{w}_pl": v for w, v in pls.items()}, child_dp=20, mom_dp=20, dad_dp=20)
    got = denovo.trio_snps(row, cutoff=0.0).first()
    all_, best = 0.0, {True: 0.0, False: 0.0}
    chance = {0: 1 - 1e-8, 1: 1e-8, 2: 1e-16}
    for (i, m), (j, d), (k, c) in itertools.product(enumerate(L.SNP), repeat=3):
        x = L.snp_configuration(c, m, d, "auto")
        v = 10 ** (-(pls["mom"][i] + pls["dad"][j] + pls["child"][k]) / 10) * x.passed * chance[x.mutations] * L.snp_prior(c, m, d, "G", 1e-3, False)
        all_ += v
        best[x.denovo] = max(best[x.denovo], v)
    assert got["pp_dnm"] == pytest.approx(best[True] / all_) and got["null_like"] == pytest.approx(best[False])
    shallow = row.withColumn("mom_dp", F.lit(9))
    assert denovo.trio_snps(shallow, cutoff=0.0).count() == 0


def test_clear_denovo(spark):
    low, hom = [200] * 10, L.SNP.index("GG")
    of = lambda g: [0 if x == g else 200 for x in L.SNP]
    row = pl(spark, ref="G", child_pl=of("AG"), mom_pl=of("GG"), dad_pl=of("GG"), child_dp=30, mom_dp=30, dad_dp=30)
    got = denovo.trio_snps(row).first()
    assert low[hom] == 200 and got["dnm_gt"] == "AG/GG/GG" and got["pp_dnm"] > 0.99 and got["dnm_code"] == 4
    row = pl(spark, normal_pl=of("GG"), tumor_pl=of("AG"), normal_dp=30, tumor_dp=30)
    assert denovo.pair_snps(row).first()["dnm_gt"] == "GG/AG"
    row = pl(spark, ref="G", alt="GAA", child_pl=[200, 0, 200], mom_pl=[0, 200, 200], dad_pl=[0, 200, 200], child_dp=30, mom_dp=30, dad_dp=30)
    assert denovo.trio_indels(row, rate=0.0).first()["dnm_gt"] == "RD/RR/RR"
    assert denovo.trio_indels(row.withColumn("alt", F.lit("GA,GAA"))).count() == 0


def test_columns(spark):
    row = spark.createDataFrame([(["G", "T", "X"], [0, 10, 20, 30, 40, 50], [5, 5, 0, 0] + [0] * 5 + [4000] + [0] + [4000] + [0] * 4, "A,X,N")], "al array<string>, pl array<int>, i16 array<int>, alt string")
    got = row.select(denovo.ten_genotypes(F.col("al"), F.col("pl")).alias("g"), denovo.i16_depth(F.col("i16")).alias("d"), denovo.i16_mapq(F.col("i16")).alias("q"), denovo.clean_alt(F.col("alt")).alias("a")).first()
    assert got["g"] == [50, 50, 30, 40, 50, 30, 40, 0, 10, 20] and (got["d"], got["q"], got["a"]) == (10, 28, "A,N")
    row = spark.createDataFrame([(30, [[0, 1], [3, 4], [2, 0]])], "d int, p array<array<int>>")
    assert row.select(denovo.split_depth(F.col("d"), F.col("p")).alias("x")).first()["x"] == [10, 0, 20]


def test_trio_members(spark):
    sites = spark.sql("SELECT 1 AS pos, map('a', struct(array(0,1,2) AS pl, 12 AS dp), 'b', struct(array(1,0,2) AS pl, 13 AS dp), 'c', struct(array(2,1,0) AS pl, 14 AS dp)) AS cells")
    trios = spark.createDataFrame([("a", "b", "c"), ("a", "b", "z")], "child string, dad string, mom string")
    got = denovo.trio_members(sites, trios).collect()
    assert len(got) == 1 and got[0]["mom_pl"] == [2, 1, 0] and got[0]["dad_dp"] == 13


def test_phasing(spark):
    dnm = spark.createDataFrame([("1", 105, "A", "T"), ("1", 5000, "A", "T")], "contig string, pos long, inherited string, variant string")
    sites = spark.createDataFrame([("1", 110, "CG", "CC", "GG"), ("1", 112, "CC", "CC", "GG"), ("1", 111, "CG", "NN", "GG"), ("1", 105, "CG", "CC", "GG")], "contig string, pos long, gt_child string, gt_p1 string, gt_p2 string")
    read = lambda q, o, pos, flag, cigar, seq: ("1", pos, q, flag, cigar, seq, None, o)
    reads = spark.createDataFrame(
        [read("r1", 1, 101, 0, "12M", "GGGGTGGGGCGG"), read("r2", 2, 101, 0, "12M", "GGGGAGGGGGGG"), read("r3", 3, 101, 0, "6M", "GGGGTG"), read("r3", 4, 106, 0, "6M", "GGGGCG"), read("r4", 5, 101, 4, "12M", "GGGGTGGGGCGG"), read("r5", 6, 101, 0, "2S12M", "NNGGGGTGGGGCGG")],
        "contig string, pos long, qname string, flag int, cigar string, seq string, xt string, ordinal long",
    )
    assert phasing.informative_sites(dnm, sites, 50).select("dnm_pos", "hap_pos").collect() == [(105, 110)]
    got = {tuple(r) for r in phasing.phase(dnm, sites, reads, 50).collect()}
    # A base is taken one place before its offset counted from zero, so that a 1-based place is met.
    assert got == {("1", 105, 110, "T", "C", 3, "p1"), ("1", 105, 110, "A", "G", 1, "p1"), ("1", 5000, None, None, None, 0, None)}


def test_aligned_text():
    assert phasing.aligned_text("2S3M1I2M", "xxABCiDE") == "ABCDE"
    assert phasing.aligned_text("2M2D2M", "ABCD") == "AB--CD" and phasing.aligned_text("2M1N", "AB") is None
