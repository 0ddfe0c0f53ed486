import pytest

from kinfold import commands

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
PED = "##PEDNG\nM . . 2 M\nD . . 1 D\nK D M 2 K\n"
SITES = HEAD + "D\tK\tM\n" + "1\t7\t.\tG\tT\t.\t.\t.\tAD:PL:DP\t34,0:0,101,753:34\t15,20:385,0,282:35\t43,1:0,93,871:44\n1\t9\t.\tG\tT\t.\t.\t.\tAD:PL:DP\t34,0:0,101,753:34\t15,0:0,60,282:35\t43,1:0,93,871:44\n1\t20\t.\tG\tGA\t.\t.\t.\tPL:DP\t0,99,99:30\t99,0,99:30\t0,99,99:30\n"


@pytest.fixture
def files(tmp_path):
    def write(**texts):
        for name, text in texts.items():
            (tmp_path / name.replace("_", ".")).write_text(text)
        return lambda name: str(tmp_path / name)

    return write


def test_call_and_loglike(spark, files):
    at = files(a_vcf=SITES, a_ped=PED)
    got = commands.call(spark, [at("a.vcf")], at("a.ped"), output=at("o.vcf"), contigs={"1": 100}).collect()
    assert [(r["pos"], r["dnt"]) for r in got] == [(7, "G/G*G/G->G/T")]
    assert commands.call(spark, [at("a.vcf")], at("a.ped"), region="1:8-", contigs={"1": 100}).count() == 0
    assert commands.loglike(spark, [at("a.vcf")], at("a.ped"), region="1:7", contigs={"1": 100}).first()["log_likelihood"] == pytest.approx(-22.6485, rel=1e-5)
    with pytest.raises(ValueError):
        commands.call(spark, [at("a.vcf"), at("a.sam")], at("a.ped"))


def test_call_from_reads(spark, files):
    head = "".join(f"@RG\tID:{x}\tLB:{x}\tSM:{x}\n" for x in "DKM")
    row = lambda i, who, base: f"{who}{i}\t0\t1\t3\t60\t3M\t*\t0\t0\tC{base}C\tIII\tRG:Z:{who}\n"
    body = "".join(row(i, who, "T" if who == "K" and i % 2 else "G") for who in "DKM" for i in range(30))
    at = files(a_sam=head + body, a_ped=PED, r_fa=">1\nAACGCAA\n")
    got = commands.call(spark, [at("a.sam")], at("a.ped"), fasta=at("r.fa")).collect()
    assert [(r["pos"], r["alleles"], r["ad"], r["dnt"]) for r in got] == [(4, ["G", "T"], [[30, 0], [15, 15], [30, 0]], "G/G*G/G->G/T")]


def test_dnm(spark, files):
    at = files(a_vcf=SITES, a_ped="f K D M\nf K M 0\n")
    out = commands.dnm(spark, at("a.vcf"), at("a.ped"))
    assert [(r["pos"], r["dnm_gt"]) for r in out["snp"].collect()] == [(7, "GT/GG/GG")]
    assert [(r["pos"], r["dnm_gt"]) for r in out["indel"].collect()] == [(20, "RD/RR/RR")]
    assert [(r["pos"], r["dnm_gt"]) for r in out["pair"].collect()] == [(7, "GG/GT")]
    assert "pair" not in commands.dnm(spark, at("a.vcf"), at("a.ped"), "XD")


def test_phaser_and_options(spark, files):
    at = files(d_txt="1\t105\tA\tT\n", g_txt="1\t110\tCG\tCC\tGG\n", a_sam="r1\t0\t1\t101\t60\t12M\t*\t0\t0\tGGGGTGGGGCGG\tIIIIIIIIIIII\n")
    got = commands.phaser(spark, at("d.txt"), at("g.txt"), at("a.sam")).first()
    assert (got["dnm_base"], got["hap_base"], got["n"], got["parent"]) == ("T", "C", 1, "p1")
    assert commands.options("# x\nmin-qual = 3\n") == {"min_qual": "3"}


def test_treecall(spark, files):
    ref, alt = "30,0:0,90,200", "15,15:200,0,200"
    rows = [("ab", 1), ("ab", 2), ("cd", 3), ("a", 4), ("d", 5)]
    at = files(a_vcf=HEAD + "a\tb\tc\td\n" + "".join(f"1\t{p}\t.\tA\tC\t.\t.\t.\tAD:PL\t" + "\t".join(alt if s in who else ref for s in "abcd") + "\n" for who, p in rows))
    best = commands.treecall(spark, at("a.vcf")).first()["tree"]
    assert "(a,b)" in best or "(c,d)" in best
    got = {r["pos"]: r["mut_smpl"] for r in commands.genotype(spark, at("a.vcf"), "((a,b),(c,d));").collect()}
    assert got[4] == "a" and got[1] in ("a,b", "c,d") and got[3] in ("a,b", "c,d")


def test_strands_and_tests_of_a_call(spark, files):
    """Reads of either strand with qualities that differ between the alleles; against the formulas."""
    from kinfold.functions import stats

    head = "".join(f"@RG\tID:{x}\tLB:{x}\tSM:{x}\n" for x in "DKM")
    rows, ref, alt = [], [], []
    for who in "DKM":
        for i in range(30):
            base = "T" if who == "K" and i % 2 else "G"
            back, mapq, qual = i % 3 == 0, 40 + i % 7 - (base == "T") * 5, "I" if i % 4 else "?"
            rows.append(f"{who}{i}\t{16 if back else 0}\t1\t{3 - i % 2}\t{mapq}\t3M\t*\t0\t0\t{'AC'[: 1 + i % 2]}{base}{'CC'[: 1 - i % 2]}\tI{qual}{qual}\tRG:Z:{who}\n")
            (alt if base == "T" else ref).append((back, mapq))
    at = files(a_sam=head + "".join(rows), a_ped=PED, r_fa=">1\nAACGCAA\n")
    got = commands.call(spark, [at("a.sam")], at("a.ped"), fasta=at("r.fa"), output=at("o.vcf"), contigs={"1": 7}).collect()
    r = next(x for x in got if x["pos"] == 4)
    strand = lambda x, back: sum(b is back for b, _ in x)
    assert r["fs"] == pytest.approx(stats.phred(stats.fisher(strand(ref, False), strand(alt, False), strand(ref, True), strand(alt, True))))
    assert r["mq"] == pytest.approx((sum(q * q for _, q in ref + alt) / len(ref + alt)) ** 0.5)
    assert r["mqta"] == pytest.approx(stats.anderson_darling([q for _, q in ref], [q for _, q in alt])) and r["rpta"] is not None and r["bqta"] is not None
    assert [sum(x) for x in zip(*r["adf"])] == [strand(ref, False), strand(alt, False)]
    line = next(x["value"] for x in spark.read.text(at("o.vcf")).collect() if x["value"].startswith("1\t4\t"))
    assert f"AD={len(ref)},{len(alt)};ADF={strand(ref, False)},{strand(alt, False)};ADR={strand(ref, True)},{strand(alt, True)};MQ=" in line and ":AD:ADF:ADR\t" in line and ";BQTa=" in line


def test_text_rows(spark, files):
    from kinfold.operators import denovo

    at = files(a_vcf=SITES, a_ped="f K D M\nf K M 0\n")
    out = commands.dnm(spark, at("a.vcf"), at("a.ped"))
    line = denovo.text_rows(out["snp"], "snp").first()["line"]
    assert line.startswith("DENOVO-SNP CHILD_ID: K chr: 1 pos: 7 ref: G alt: T maxlike_null: ") and "tgt_dnm(child/mom/dad): GT/GG/GG" in line and line.endswith(" READ_DEPTH child: 35 dad: 34 mom: 44")
    assert denovo.text_rows(out["pair"], "pair").first()["line"].startswith("DENOVO-PAIR-SNP TUMOR_ID: K NORMAL_ID: M chr: 1 pos: 7")
    assert denovo.text_rows(out["indel"], "indel").first()["line"].startswith("DENOVO-INDEL CHILD_ID: K chr: 1 pos: 20 ref: G alt: GA")
    numbers = spark.createDataFrame([(1.0,), (0.5,), (1e-10,), (1.25e-7,), (123456789.0,), (0.0,)], "x double").select(denovo._short(denovo.F.col("x")).alias("t"))
    assert [r["t"] for r in numbers.collect()] == ["1", "0.5", "1e-10", "1.25e-07", "1.23457e+08", "0"]


def test_shell(spark, files, capsys):
    from kinfold import __main__ as shell

    at = files(a_vcf=SITES, a_ped=PED, t_ped="f K D M\n", o_txt="# options\nmin-qual = 0.6\nmu=1e-8\n", r_txt="1:7", b_bed="1\t6\t7\n")
    shell.run(spark, ["call", "--ped", at("a.ped"), "--contigs", "1=100", "--arg-file", at("o.txt"), at("a.vcf")])
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "##fileformat=VCFv4.2" and [x.split("\t")[1] for x in out if not x.startswith("#")] == ["7"]
    for region in ("1:7", "@" + at("r.txt"), "@" + at("b.bed")):
        shell.run(spark, ["loglike", "--ped", at("a.ped"), "--contigs", "1=100", "--region", region, at("a.vcf")])
        told = dict(x.split("\t") for x in capsys.readouterr().out.splitlines())
        assert float(told["log_likelihood"]) == pytest.approx(-22.6485, rel=1e-5) and set(told) == {"log_likelihood", "log_hidden", "log_observed"}
    shell.run(spark, ["dnm", at("a.vcf"), at("t.ped")])
    assert [x.split()[0] for x in capsys.readouterr().out.splitlines()] == ["DENOVO-SNP", "DENOVO-INDEL"]
    with pytest.raises(ValueError):
        shell.arguments(["call", "--ped", "x", "--arg-file", at("r.txt"), "a.vcf"])
    task, own = shell.arguments(["call", "--ped", "x", "--theta", "0.01", "--min-mapqual", "3", "--all", "a.sam", "b.sam"])
    assert own["p"].theta == 0.01 and own["least_mapq"] == 3 and own["everything"] is True and own["paths"] == ["a.sam", "b.sam"]


def test_dnm_as_vcf(spark, files):
    from kinfold.sources import variants

    at = files(a_vcf=SITES, a_ped="f K D M\nf D K M\n")
    commands.dnm(spark, at("a.vcf"), at("a.ped"), output=at("o.vcf"), contigs={"1": 100})
    lines = [r["value"].split("\t") for r in spark.read.text(at("o.vcf")).collect()]
    head = next(x for x in lines if x[0] == "#CHROM")
    rows = [x for x in lines if not x[0].startswith("#")]
    assert head[9:] == ["D", "K"] and [(x[1], x[3], x[4], x[6], x[9]) for x in rows if x[10] != "."] == [("7", "G", "T", "PASS", "."), ("20", "G", "GA", "PASS", ".")]
    cells = dict(zip(rows[0][8].split(":"), next(x for x in rows if x[1] == "7" and x[10] != ".")[10].split(":")))
    assert cells["DNM_CONFIG(child/mom/dad)"] == "GT/GG/GG" and cells["RD"] == "35" and 0.9 < float(cells["PP_DNM"]) <= 1
    assert variants.read_vcf(spark, at("o.vcf")).count() == len(rows)
    with pytest.raises(ValueError):
        variants.in_step([], "none")
