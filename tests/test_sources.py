import gzip
import struct

import pytest
from pyspark.sql import functions as F

from kinfold.functions import pedigree as P
from kinfold.functions import text as T
from kinfold.operators import alignment, pedigree_calling
from kinfold.sources import reads, tables, variants

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tLB/D\tLB/K\tLB/M
1\t7\t.\tG\tT\t50\tPASS\tDP=9;I16=1,2,3,4;X\tGT:AD:PL\t0/0:34,0:0,9,99\t0/1:15,20:9,0,9\t0/0:43,1:0,9,99
1\t8\t.\tG\t.\t.\t.\t.\tGT:AD\t0/0:34\t0/0:5\t0/0:.
2\t9\t.\tGA\tG\t.\t.\t.\tGT:AD\t0/0:34,0\t0/0:5,0\t0/0:3,0
2\t10\t.\tG\tA,C\t.\t.\t.\tGT\t0/0\t0/0\t0/0
2\t11\t.\tA\tC\t.\t.\t.\tAD:GT\t40,0\t30,0\t.
"""
PED = "##PEDNG\nM . . 2 M\nD . . 1 D\nK D M 2 K\n"


@pytest.fixture(scope="module")
def vcf(tmp_path_factory):
    path = tmp_path_factory.mktemp("v") / "a.vcf"
    path.write_text(VCF)
    return str(path)


def test_vcf(spark, vcf):
    df = variants.read_vcf(spark, vcf)
    labels = variants.parse_labels(variants.vcf_samples(spark, vcf))
    assert labels == [(0, "D", "D"), (1, "K", "K"), (2, "M", "M")]
    first = df.where("pos = 7").select("alleles", "qual", "info", variants.info_ints("I16").alias("i"), variants.format_ints("PL").alias("p")).first()
    assert first["alleles"] == ["G", "T"] and first["qual"] == 50 and first["info"]["DP"] == "9" and first["i"] == [1, 2, 3, 4] and first["p"][1] == [9, 0, 9]
    ad = {r["pos"]: r["ad"] for r in variants.allele_depths(df).collect()}
    assert ad == {7: [[34, 0], [15, 20], [43, 1]], 8: [[34], [5], [0]], 11: [[40, 0], [30, 0], [0, 0]]}
    cells = variants.genotype_likelihoods(df, ["D", "K", "M"]).collect()
    assert len(cells) == 1 and cells[0]["cells"]["K"]["pl"] == [9, 0, 9] and cells[0]["cells"]["K"]["dp"] is None
    with pytest.raises(ValueError):
        variants.read_vcf(spark, "a.bcf")
    with pytest.raises(ValueError):
        variants.parse_labels(["LB/a/x", "LB/b/x"])


def test_call_to_vcf(spark, vcf, tmp_path):
    graph = P.build(T.parse_pedigree(PED), [("D", "D"), ("K", "K"), ("M", "M")])
    sites = variants.allele_depths(variants.read_vcf(spark, vcf))
    rows = pedigree_calling.call(sites, graph, ["D", "K", "M"])
    got = rows.collect()
    assert [(r["pos"], r["dnt"], r["denovo"], r["germline"]) for r in got] == [(7, "G/G*G/G->G/T", True, True)]
    assert got[0]["gt"] == ["0/0", "0/0", "0/0", "0/1", "0/0"] and got[0]["pl"][3] == [385, 0, 282] and got[0]["pl"][0] is None
    all_ = pedigree_calling.call(sites, graph, ["D", "K", "M"], least=0.0, everything=True)
    assert {r["pos"] for r in all_.collect()} == {7, 8, 11}
    out = str(tmp_path / "o.vcf")
    variants.write_vcf(pedigree_calling.vcf_lines(rows, graph), pedigree_calling.vcf_header(graph, {"1": 100, "2": 100}), out, ["1", "2"])
    back = variants.read_vcf(spark, out)
    row = back.first()
    assert back.count() == 1 and row["info"]["MUTQ"] == "48.1562" and row["info"]["DNT"] == "G/G*G/G->G/T" and row["qual"] == 301.941
    assert variants.vcf_samples(spark, out) == [v.label for v in graph.nodes]


def test_log_likelihood(spark, vcf):
    graph = P.build(T.parse_pedigree(PED), [("D", "D"), ("K", "K"), ("M", "M")])
    sites = variants.allele_depths(variants.read_vcf(spark, vcf))
    got = pedigree_calling.log_likelihood(sites.where("pos = 7"), graph, ["D", "K", "M"]).first()
    assert got["log_likelihood"] == pytest.approx(-22.6485, rel=1e-5) and got["log_hidden"] == pytest.approx(-8.30233, rel=1e-5)
    assert pedigree_calling.log_likelihood(sites.where("pos < 0"), graph, ["D", "K", "M"]).first()["log_likelihood"] == 0


def test_trim():
    assert pedigree_calling.trim_alleles(["A", "C", "G"], ["0/0", "1"], [[1, 0, 0, 0, 0, 0], [0, 1, 0]], [2, 1], 0.1) == [0, 1]
    assert pedigree_calling.trim_alleles(["A", "C"], ["0/0"], [[0.8, 0.2, 0.0]], [2], 0.1) == [0, 1]
    assert pedigree_calling.trim_alleles(["A", "C"], ["0/0"], [[0.82, 0.18, 0.0]], [2], 0.1) == [0]


SAM = "@HD\tVN:1.6\n@RG\tID:g1\tLB:L1\tSM:S1\n@RG\tID:g2\tSM:S2\nr1\t0\t1\t11\t60\t2S3M1D2M\t*\t0\t0\tNNACGTA\tIIIIII!\tRG:Z:g1\nr2\t1024\t1\t11\t60\t3M\t*\t0\t0\tACG\tIII\tRG:Z:g1\nr3\t16\t1\t12\t50\t1M1I2M\t*\t0\t0\tCTGT\tIIII\tRG:Z:g2\tXT:A:M\n"


def bam(text: str) -> bytes:
    head = "".join(x + "\n" for x in text.splitlines() if x.startswith("@")).encode()
    out = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 500)
    for x in text.splitlines():
        if x.startswith("@"):
            continue
        c = x.split("\t")
        ops = [(n << 4) | "MIDNSHP=X".index(o) for n, o in T.cigar_runs(c[5])]
        code = ["=ACMGRSVTWYHKDBN".index(b) for b in c[9]] + [0] * (len(c[9]) % 2)
        packed = bytes(a << 4 | b for a, b in zip(code[::2], code[1::2], strict=True))
        tags = b"NMi" + struct.pack("<i", 3) + b"ZBBs" + struct.pack("<i2h", 2, 5, 6)
        for t in c[11:]:
            name, kind, value = t.split(":")
            tags += name.encode() + kind.encode() + value.encode() + (b"\0" if kind == "Z" else b"")
        body = struct.pack("<iiBBHHHiiii", 0, int(c[3]) - 1, len(c[0]) + 1, int(c[4]), 0, len(ops), int(c[1]), len(c[9]), -1, -1, 0) + c[0].encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(ord(q) - 33 for q in c[10]) + tags
        out += struct.pack("<i", len(body)) + body
    return b"".join(gzip.compress(out[i : i + 50]) for i in range(0, len(out), 50))


def test_sam_and_bam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.bam").write_bytes(bam(SAM))
    sam = reads.read_reads(spark, str(tmp_path / "a.sam"))
    assert sorted(map(str, sam.collect())) == sorted(map(str, reads.read_reads(spark, str(tmp_path / "a.bam")).collect()))
    assert sam.where("qname = 'r3'").first()["xt"] == "M"
    for name in ("a.sam", "a.bam"):
        groups = reads.read_groups(reads.header_text(spark, str(tmp_path / name)))
        assert groups == {"g1": ("L1", "S1"), "g2": ("g2", "S2")}
    with pytest.raises(ValueError):
        reads.read_reads(spark, "a.cram")
    with pytest.raises(ValueError):
        reads.read_groups("@RG\tLB:x")
    (tmp_path / "cut.bam").write_bytes(gzip.compress(gzip.decompress(bam(SAM))[:-9]))
    with pytest.raises(ValueError):
        list(reads.bam_rows(str(tmp_path / "cut.bam")))

    b = alignment.with_libraries(alignment.bases(sam), groups)
    rows = sorted((r["pos"], r["library"], r["base"], r["read_pos"]) for r in b.collect())
    assert rows == [(11, "L1", 0, 2), (12, "L1", 1, 3), (12, "g2", 1, 0), (13, "L1", 2, 4), (13, "g2", 2, 2), (14, "g2", 3, 3), (15, "L1", 3, 5)]
    (tmp_path / "r.fa").write_text(">1 one\nAAAAAAAAAA\nACTGTT\n>2\nC\n")
    fasta = tables.read_fasta(spark, str(tmp_path / "r.fa"), block=4)
    with_ref = tables.reference_bases(b, fasta, block=4)
    sites = {r["pos"]: (r["alleles"], r["ad"]) for r in alignment.site_depths(with_ref, ["L1", "g2"]).collect()}
    assert sites == {11: (["A"], [[1], [0]]), 12: (["C"], [[1], [1]]), 13: (["T", "G"], [[0, 1], [0, 1]]), 14: (["G", "T"], [[0, 0], [0, 1]]), 15: (["T"], [[1], [0]])}
    far = spark.createDataFrame([("1", 99), ("3", 1)], "contig string, pos int")
    assert {r["ref_base"] for r in tables.reference_bases(far, fasta, 4).collect()} == {"N"}


def test_lengths(spark):
    c = spark.createDataFrame([("2S3M1D4M2I",), ("*",)], "cigar string")
    got = c.select(alignment.query_length(F.col("cigar")), alignment.target_length(F.col("cigar"))).collect()
    assert [tuple(r) for r in got] == [(11, 8), (0, 0)]


def test_tables(spark, tmp_path):
    (tmp_path / "p.ped").write_text("f c d m\nf t n 0\nf d 0 0\n")
    trios, pairs = tables.read_classic_pedigree(spark, str(tmp_path / "p.ped"))
    assert trios.collect() == [("c", "d", "m")] and pairs.collect() == [("t", "n")]
    (tmp_path / "b.bed").write_text("# x\n\n1\t5\t9\tname\n2 0 3\n")
    assert sorted(tables.read_bed(spark, str(tmp_path / "b.bed")).collect()) == [("1", 5, 9), ("2", 0, 3)]
    (tmp_path / "bad.bed").write_text("1\tx\t9\n")
    with pytest.raises(Exception, match="BED"):
        tables.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "d.txt").write_text("1\t5\tA\tT\n")
    assert tables.read_mutations(spark, str(tmp_path / "d.txt")).collect() == [("1", 5, "A", "T")]
    (tmp_path / "x.ped").write_text(PED)
    assert [m.name for m in tables.read_pedigree(spark, str(tmp_path / "x.ped"))] == ["M", "D", "K"]
    g = spark.createDataFrame([("0|1:3",), ("1/1",), (".",)], "gt string")
    assert [r[0] for r in g.select(variants.genotype_bases(F.lit("A"), F.lit("C"), F.col("gt"))).collect()] == ["AC", "CC", "NN"]


def test_labels_and_genotype_calls(spark, tmp_path):
    from kinfold.sources import tables

    (tmp_path / "two.txt").write_text("a\tAnna\nb\tBert\n")
    (tmp_path / "one.txt").write_text("Anna\nBert\n")
    assert tables.read_labels(spark, str(tmp_path / "two.txt")) == {"a": "Anna", "b": "Bert"}
    assert tables.read_labels(spark, str(tmp_path / "one.txt")) == {"0": "Anna", "1": "Bert"}
    (tmp_path / "calls.txt").write_text("chrom pos ref null_p\n1 7 A 0.5 0.25 AA 0.5 AA AC 0.1 2 s1,s2\n")
    r = tables.read_genotype_calls(spark, str(tmp_path / "calls.txt")).collect()
    assert [(x.contig, x.pos, x.null_p, x.mut_loc, x.mut_smpl) for x in r] == [("1", 7, 0.5, 2, "s1,s2")]


def test_fasta_across_splits(spark, tmp_path):
    """Small splits that part lines and contigs; headers with a > inside, blank lines, small letters."""
    import random

    from kinfold.sources import tables

    rnd = random.Random(6)
    want, text = {}, ""
    for name in ("c1", "c2", "c3"):
        seq = "".join(rnd.choice("ACGTacgt") for _ in range(rnd.randrange(500, 2000)))
        want[name] = seq.upper()
        text += f">{name} some > text\n" + "\n".join(seq[i : i + 37] for i in range(0, len(seq), 37)) + "\n\n"
    (tmp_path / "r.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        got = tables.read_fasta(spark, str(tmp_path / "r.fa"), 64).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, seq in want.items():
        assert "".join(r.seq for r in sorted((r for r in got if r.contig == name), key=lambda r: r.block)) == seq
