"""Aligned reads: SAM text through Spark, BAM through a data source of one partition a file."""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, contig string, pos int, mapq int, cigar string, seq string, qual string, rg string, xt string"
#: Fixed values of the format: codes of operations and bases.
_OPERATIONS = "MIDNSHP=X"
_BASES = "=ACMGRSVTWYHKDBN"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Columns of SCHEMA; pos is 1-based; numbers that are none are null."""
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    c = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    tag = lambda t: F.nullif(F.regexp_extract("value", f"\t{t}:[AZ]:([^\t\r]*)", 1), F.lit(""))
    return rows.select(c(0).alias("qname"), c(1).try_cast("int").alias("flag"), c(2).alias("contig"), c(3).try_cast("int").alias("pos"), c(4).try_cast("int").alias("mapq"), c(5).alias("cigar"), c(9).alias("seq"), c(10).alias("qual"), tag("RG").alias("rg"), tag("XT").alias("xt"))


def blocks(path: str) -> Iterator[bytes]:
    """The unpacked pieces of a file of gzip members, as they come."""
    with open(path, "rb") as f:
        member = zlib.decompressobj(31)
        while raw := f.read(1 << 20):
            while raw:
                if out := member.decompress(raw):
                    yield out
                raw = b""
                if member.eof:
                    raw, member = member.unused_data, zlib.decompressobj(31)


class Stream:
    """Reads so many bytes at a time; keeps no more than a piece beyond them."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            piece = next(self.pieces, None)
            if piece is None:
                break
            self.held, self.at = self.held[self.at :] + piece, 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def exactly(self, n: int) -> bytes:
        out = self.take(n)
        if len(out) != n:
            raise ValueError("the file is cut off")
        return out


def bam_header(s: Stream) -> tuple[str, list[tuple[str, int]]]:
    if s.exactly(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = s.exactly(struct.unpack("<i", s.exactly(4))[0]).split(b"\0")[0].decode()
    contigs = []
    for _ in range(struct.unpack("<i", s.exactly(4))[0]):
        name = s.exactly(struct.unpack("<i", s.exactly(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", s.exactly(4))[0]))
    return text, contigs


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            n = struct.unpack_from("<i", raw, at + 1)[0]
            at += 5 + n * _SIZES[chr(raw[at])]
        else:
            if kind == "A":
                out[name] = chr(raw[at])
            at += _SIZES[kind]
    return out


def bam_rows(path: str) -> Iterator[tuple]:
    s = Stream(blocks(path))
    _, contigs = bam_header(s)
    while head := s.take(4):
        if len(head) != 4:
            raise ValueError("the file is cut off")
        raw = s.exactly(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", raw)
        at = 32 + l_name
        name = raw[32 : at - 1].decode()
        ops = struct.unpack_from(f"<{n_cigar}I", raw, at)
        at += 4 * n_cigar
        packed = raw[at : at + (l_seq + 1) // 2]
        at += len(packed)
        qual = raw[at : at + l_seq]
        tags = _tags(raw[at + l_seq :])
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        cigar = "".join(f"{x >> 4}{_OPERATIONS[x & 15]}" for x in ops) or "*"
        text = "*" if not l_seq or qual[:1] == b"\xff" else "".join(chr(q + 33) for q in qual)
        yield (name, flag, contigs[ref][0] if ref >= 0 else "*", pos + 1, mapq, cigar, seq or "*", text, tags.get("RG"), tags.get("XT"))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.bam"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise ValueError(f"no file at {self.path}")
        return [_Part(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from bam_rows(partition.path)


class BamSource(DataSource):
    """spark.read.format("bam").load(path): a file, a pattern, or a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").load(path)


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.text import file_type

    kind = file_type(path)[1].lower()
    if kind not in ("sam", "bam"):
        raise ValueError(f"file type '{kind}' is not supported; convert it to bam or sam")
    return (read_bam if kind == "bam" else read_sam)(spark, file_type(path)[0])


def read_groups(header: str, tag: str = "LB") -> dict[str, tuple[str, str]]:
    """Of a header's @RG lines {id: (library, sample)}; the library falls back to the id, the sample to the library."""
    out: dict[str, tuple[str, str]] = {}
    samples: dict[str, str] = {}
    for line in header.splitlines():
        if not line.startswith("@RG"):
            continue
        cells = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
        if "ID" not in cells:
            raise ValueError("a read group has no ID")
        library = cells.get(tag, cells["ID"])
        sample = cells.get("SM", library)
        if samples.setdefault(library, sample) != sample:
            raise ValueError(f"library '{library}' has two samples")
        out[cells["ID"]] = (library, sample)
    return out


def header_text(spark: SparkSession, path: str) -> str:
    if file_type_of(path) == "bam":
        return bam_header(Stream(blocks(path)))[0]
    return "\n".join(r["value"] for r in spark.read.text(path).where(F.col("value").startswith("@")).collect())


def file_type_of(path: str) -> str:
    from ..functions.text import file_type

    return file_type(path)[1].lower()
