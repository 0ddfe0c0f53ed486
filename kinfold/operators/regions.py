"""Intervals: merging, containment and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(ranges: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(contig, beg, end), half-open: unions of ranges that touch or overlap.

    Ranges are ordered within bins (by their begin) of the given width, each on its own; across bins only a row a bin is ordered: how far
    the bins before reach, and how many unions they began.
    """
    rows = ranges.select("contig", "beg", "end").withColumn("bin", F.floor(F.col("beg") / width))
    order = Window.partitionBy("contig", "bin").orderBy("beg", "end")
    inner = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inner", inner)
    before = Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy("contig", "bin").agg(F.max("end").alias("most")).select("contig", "bin", F.max("most").over(before).alias("outer"))
    # Of a bin without an end before, greatest leaves out nulls; the first range of a contig has neither
    flagged = rows.join(reach, ["contig", "bin"]).withColumn("new", F.when(F.col("beg") <= F.greatest("inner", "outer"), 0).otherwise(1))
    begun = flagged.groupBy("contig", "bin").agg(F.sum("new").alias("n")).select("contig", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    island = F.col("earlier") + F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = flagged.join(begun, ["contig", "bin"]).withColumn("island", island)
    return numbered.groupBy("contig", "island").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("island")


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of overlapping ranges (contig, beg, end and an id each: left_id, right_id).

    An equi-join on bins of the given width; a pair is told in the bin where the later of the two begins.
    """
    bins = lambda df: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor((F.col("end") - 1) / width))))
    a = bins(left).select("contig", "bin", "left_id", F.col("beg").alias("b1"), F.col("end").alias("e1"))
    b = bins(right).select("contig", "bin", "right_id", F.col("beg").alias("b2"), F.col("end").alias("e2"))
    both = a.join(b, ["contig", "bin"]).where("b1 < e2 AND b2 < e1").where(F.floor(F.greatest("b1", "b2") / width) == F.col("bin"))
    return both.select("left_id", "right_id", (F.least("e1", "e2") - F.greatest("b1", "b2")).alias("shared"))


def within(sites: DataFrame, ranges: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Sites (contig, pos 0-based) in some range, each once; ranges need not be merged."""
    r = ranges.select("contig", "beg", "end").where("beg < end").withColumn("bin", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor((F.col("end") - 1) / width))))
    s = sites.withColumn("bin", F.floor(F.col("pos") / width))
    hit = (s["contig"] == r["contig"]) & (s["bin"] == r["bin"]) & (s["pos"] >= r["beg"]) & (s["pos"] < r["end"])
    return s.join(r, hit, "left_semi").drop("bin")


def merge_as_last(ranges: DataFrame) -> DataFrame:
    """Like merge, but a union ends where the last of its ranges (by beg, end) does, even if an earlier one reaches further.

    The end so far decides what is joined, so ranges of a contig are folded in order by one task.
    """
    folded = ranges.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("beg", "end"))).alias("r"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["beg"].alias("beg"), x["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (x["beg"] <= F.get(acc, F.size(acc) - 1)["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    start = F.expr("CAST(array() AS array<struct<beg:bigint,end:bigint>>)")
    typed = F.transform("r", lambda x: F.struct(x["beg"].cast("long").alias("beg"), x["end"].cast("long").alias("end")))
    return folded.select("contig", F.explode(F.aggregate(typed, start, step)).alias("x")).select("contig", "x.beg", "x.end")


def chromosome(name):
    """Without chr; X is 23. Null for Y, M and unplaced pieces."""
    bare = F.regexp_replace(name, "^(?i)chr", "")
    return F.when(F.upper(bare) == "X", "23").when(F.upper(bare).rlike("^(Y|M|MT)$") | F.lower(bare).contains("random"), None).otherwise(bare)


def annotate(features: DataFrame, intervals: DataFrame, mode: str, least: float = 0.5, width: int = 1 << 14) -> DataFrame:
    """Features (id, contig, beg, end) with value, told from intervals (contig, beg, end); features without a hit have 0.

    any: 1 if one overlaps; fraction: overlapped share of the feature, places covered twice counted once; reciprocal:
    intervals that share `least` of both; point: 1 if the feature's first place lies in one; count: overlapping ones.
    """
    f = features.withColumnRenamed("id", "left_id")
    if mode == "point":
        f = f.withColumn("end", F.col("beg") + 1)
    right = merge(intervals.select("contig", "beg", "end")) if mode == "fraction" else intervals.select("contig", "beg", "end")
    right = right.withColumn("length", F.col("end") - F.col("beg")).withColumn("right_id", F.struct("beg", "end", F.monotonically_increasing_id().alias("k")))
    hits = overlaps(f.select("left_id", "contig", "beg", "end"), right, width)
    size = f.select("left_id", (F.col("end") - F.col("beg")).alias("size"))
    if mode == "reciprocal":
        both = hits.join(size, "left_id")
        length = F.col("right_id.end") - F.col("right_id.beg")
        hits = both.where((F.col("shared") >= least * F.col("size")) & (F.col("shared") >= least * length)).select("left_id", "right_id", "shared")
    told = hits.groupBy("left_id").agg(F.count("*").alias("n"), F.sum("shared").alias("shared"))
    out = size.join(told, "left_id", "left")
    value = {"any": F.when(F.col("n") > 0, 1.0), "point": F.when(F.col("n") > 0, 1.0), "count": F.col("n").cast("double"), "reciprocal": F.col("n").cast("double"), "fraction": F.col("shared") / F.col("size")}
    if mode not in value:
        raise ValueError(f"mode '{mode}' is not known")
    return out.select(F.col("left_id").alias("id"), F.coalesce(value[mode], F.lit(0.0)).alias("value"))
