"""Small text tables and reference sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Member, parse_pedigree


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), "\\s+").alias("c"))


def read_pedigree(spark: SparkSession, path: str) -> list[Member]:
    return parse_pedigree("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def read_classic_pedigree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of family, child, dad, mom: (trios (child, dad, mom), pairs (tumor, normal)); 0 is none."""
    rows = _lines(spark, path).select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("family", "child", "dad", "mom"))))
    return rows.where("dad <> '0' AND mom <> '0'").select("child", "dad", "mom"), rows.where("dad <> '0' AND mom = '0'").select(F.col("child").alias("tumor"), F.col("dad").alias("normal"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, beg, end), half-open; a row that isn't one fails."""
    c = _lines(spark, path)
    bad = (F.size("c") < 3) | ~F.get("c", F.lit(1)).rlike("^[0-9]+$") | ~F.coalesce(F.get("c", F.lit(2)), F.lit("")).rlike("^[0-9]+$")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a BED row: "), F.array_join("c", " "))).cast("string"))
    return c.select(F.coalesce(checked, F.get("c", F.lit(0))).alias("contig"), F.get("c", F.lit(1)).cast("long").alias("beg"), F.get("c", F.lit(2)).cast("long").alias("end"))


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """Tab rows contig, pos, inherited, variant; these two must differ."""
    df = spark.read.csv(path, sep="\t", schema="contig string, pos long, inherited string, variant string")
    same = F.when(F.col("inherited") == F.col("variant"), F.raise_error(F.lit("the inherited and the variant base are the same")).cast("string"))
    return df.withColumn("variant", F.coalesce(same, F.col("variant")))


def read_phasing_sites(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="contig string, pos long, gt_child string, gt_p1 string, gt_p2 string")


#: Columns of genotype calls along a lineage, as `commands.genotype` makes them.
GENOTYPE_CALLS = "contig string, pos int, ref string, null_p double, mut_p double, null_base string, null_base_p double, mut_base string, mut_alt string, mut_conf_p double, mut_loc int, mut_smpl string"


def read_genotype_calls(spark: SparkSession, path: str) -> DataFrame:
    """Rows of twelve columns between blanks or tabs, below one line of names; a number that isn't one fails."""
    c = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("c"), F.col("value").startswith("contig").alias("names") | F.col("value").startswith("chrom"))
    rows = c.where(~F.coalesce(F.col(c.columns[1]), F.lit(False))).where(F.size("c") >= 12)
    return rows.select(*(F.get("c", F.lit(i)).cast(x.split()[1]).alias(x.split()[0]) for i, x in enumerate(GENOTYPE_CALLS.split(", "))))


def read_labels(spark: SparkSession, path: str) -> dict[str, str]:
    """New names of samples: of rows `old<tab>new`, or of one column by the rows' numbers from 0. The file is as small as its samples are few."""
    rows = [r["value"].rstrip().split("\t") for r in spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("value")).collect()]
    return {(c[0] if len(c) > 1 else str(i)): c[1] if len(c) > 1 else c[0] for i, c in enumerate(rows)}


def _fasta_lines(batches):
    """(path, start of the split, line) of record batches in their order."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("path", "start", "value")), strict=True)


def _bases(line: str) -> str:
    return "".join(line.split()).upper()


def _summary(batches):
    """Of each split: bases before its first header, its last header (or null), bases after that."""
    told: dict[tuple, list] = {}
    for path, start, line in _fasta_lines(batches):
        own = told.setdefault((path, start), [0, None, 0])
        if line.startswith(">"):
            own[1:] = [line[1:].split()[0] if line[1:].split() else "", 0]
        else:
            own[0 if own[1] is None else 2] += len(_bases(line))
    if told:
        rows = [(*k, *v) for k, v in told.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["path", "start", "before", "last", "after"])


def _pieces(begins: dict[tuple, tuple[str | None, int]], block: int):
    """begins: of each split, the contig that goes on in it, and how many of its bases came before."""

    def work(batches):
        now, contig, at, rows = None, None, 0, []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["contig", "block", "at", "piece"])
        for path, start, line in _fasta_lines(batches):
            if (path, start) != now:
                now = path, start
                contig, at = begins[now]
            if line.startswith(">"):
                contig, at = line[1:].split()[0] if line[1:].split() else "", 0
                continue
            own = _bases(line)
            while own and contig is not None:
                room = block - at % block
                rows.append((contig, at // block, at, own[:room]))
                at += len(own[:room])
                own = own[room:]
            if len(rows) >= 4096:
                yield flush()
                rows = []
        if rows:
            yield flush()

    return work


def read_fasta(spark: SparkSession, path: str, block: int = 1 << 16) -> DataFrame:
    """(contig, block, seq): pieces of the sequences, so that bases are joined on (contig, block).

    Splits of the files are read by tasks of their own: a first pass counts each split's bases, from which the driver tells where its sequence goes on (one
    small row a split); a second one cuts lines at blocks, which are then put together. A line that begins with > is a header.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    begins: dict[tuple, tuple[str | None, int]] = {}
    before, contig, at = None, None, 0
    for r in sorted(lines.mapInArrow(_summary, "path string, start long, before long, last string, after long").collect(), key=lambda r: (r.path, r.start)):
        if r.path != before:
            before, contig, at = r.path, None, 0
        begins[r.path, r.start] = contig, at
        contig, at = (contig, at + r.before) if r.last is None else (r.last, r.after)
    pieces = lines.mapInArrow(_pieces(begins, block), "contig string, block int, at long, piece string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy("contig", "block").agg(whole.alias("seq"))


def reference_bases(sites: DataFrame, fasta: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Sites (contig, pos 1-based) with ref_base; N where the sequence doesn't reach."""
    at = F.col("pos") - 1
    left = sites.withColumn("block", F.floor(at / block).cast("int"))
    out = left.join(fasta, ["contig", "block"], "left")
    base = F.expr(f"substring(seq, CAST((pos - 1) % {block} AS INT) + 1, 1)")
    return out.withColumn("ref_base", F.coalesce(F.nullif(base, F.lit("")), F.lit("N"))).drop("block", "seq")
