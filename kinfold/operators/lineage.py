"""Lineage trees of samples from genotype likelihoods: one pass over the sites for all trees of a search step.

Sites are rows with pl: of each sample its phred likelihoods of 3 or 10 genotypes. What comes to the driver is as large as
the samples or the trees compared, never as the sites.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trees as T


def two_alleles(ad: Column) -> Column:
    """Places of the two deepest alleles over all samples (ad: of each sample its depths); of equals the later first."""
    n = F.size(F.get(ad, F.lit(0)))
    totals = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.aggregate(ad, F.lit(0).cast("long"), lambda acc, v: acc + F.coalesce(F.get(v, i), F.lit(0))).alias("d"), i.alias("i")))
    return F.slice(F.transform(F.sort_array(totals, asc=False), lambda x: x["i"]), 1, 2)


def _at(x: Column, y: Column) -> Column:
    hi, lo = F.greatest(x, y), F.least(x, y)
    return (hi * (hi + 1) / 2 + lo).cast("int")


def three_genotypes(pl: Column, alleles: Column) -> Column:
    """Of each sample the likelihoods of the two alleles' genotypes: both first, one each, both second."""
    a, b = F.get(alleles, F.lit(0)), F.get(alleles, F.lit(1))
    return F.transform(pl, lambda v: F.array(*(F.get(v, _at(x, y)) for x, y in ((a, a), (a, b), (b, b)))))


def _array(pl: pd.Series) -> np.ndarray:
    return np.array([[np.asarray(s, float) for s in site] for site in pl], float)


def distances(sites: DataFrame) -> np.ndarray:
    """Of each two samples: over the sites, the chance that their genotypes differ. One small matrix a partition."""

    def work(frames):
        total = None
        for f in frames:
            if not len(f):
                continue
            p = 10 ** (-_array(f["pl"]) / 10)
            p /= p.sum(2, keepdims=True)
            d = len(p) - np.einsum("sig,sjg->ij", p, p)
            total = d if total is None else total + d
        if total is not None:
            yield pd.DataFrame({"m": [len(total)], "d": [total.ravel().tolist()]})

    parts = sites.select("pl").mapInPandas(work, "m int, d array<double>")
    flat = parts.select("m", F.posexplode("d").alias("k", "v")).groupBy("m", "k").agg(F.sum("v").alias("v")).collect()
    m = flat[0]["m"] if flat else 0
    out = np.zeros(m * m)
    for r in flat:
        out[r["k"]] = r["v"]
    out = out.reshape(m, m)
    np.fill_diagonal(out, 0.0)
    return out


def score_trees(sites: DataFrame, trees: list[T.Tree], mu: float = 80.0, het: float = 30.0) -> DataFrame:
    """(tree, score): for each tree's place in the list the sum over the sites; smaller is better."""

    def work(frames):
        total = np.zeros(len(trees))
        for f in frames:
            if len(f):
                pl = _array(f["pl"])
                total += [T.site_scores(t, pl, mu, het).sum() for t in trees]
        yield pd.DataFrame({"tree": np.arange(len(trees), dtype=np.int32), "score": total})

    return sites.select("pl").mapInPandas(work, "tree int, score double").groupBy("tree").agg(F.sum("score").alias("score"))


def best_split(sites: DataFrame, samples: list[int], least: float = 60.0, most: int = 20) -> tuple[list[int], list[int]]:
    """The bipartition of least cost: over sites where a side has evidence above `least`, both sides' cheapest genotypes.

    All bipartitions of up to `most` samples are tried; of more, those that single out one sample or follow a joined tree.
    """
    m = len(samples)
    if m <= most:
        sides = ((np.arange(1, 2 ** (m - 1))[:, None] >> np.arange(m - 1, -1, -1)) & 1).astype(bool)
    else:
        tree = T.neighbour_joining(distances(sites.withColumn("pl", F.array(*(F.get("pl", F.lit(s)) for s in samples)))))
        sides = np.array([[k in b for k in range(m)] for b in map(set, T.branches(tree))])
    chunk = 4096

    def work(frames):
        total = np.zeros(len(sides))
        for f in frames:
            if not len(f):
                continue
            pl = _array(f["pl"])[:, samples]
            for i in range(0, len(sides), chunk):
                s = sides[i : i + chunk].astype(float)
                for site in pl:
                    one = s @ site
                    zero = site.sum(0) - one
                    seen = (one.max(1) > least) | (zero.max(1) > least)
                    total[i : i + chunk] += np.where(seen, one.min(1) + zero.min(1), 0.0)
        at = int(total.argmin())
        yield pd.DataFrame({"k": np.arange(len(sides)), "cost": total}) if at >= 0 else pd.DataFrame()

    row = sites.select("pl").mapInPandas(work, "k long, cost double").groupBy("k").agg(F.sum("cost").alias("cost")).orderBy("cost", "k").first()
    side = sides[row["k"]]
    return [s for s, x in zip(samples, side, strict=True) if not x], [s for s, x in zip(samples, side, strict=True) if x]


def partition_tree(sites: DataFrame, samples: list[int], least: float = 60.0) -> T.Tree:
    """Splits again and again, each by the best bipartition."""
    if len(samples) == 1:
        return samples[0]
    if len(samples) == 2:
        return tuple(samples)
    a, b = best_split(sites, samples, least)
    return (partition_tree(sites, a, least), partition_tree(sites, b, least))


def search(sites: DataFrame, mu: float = 80.0, het: float = 30.0, least: float = 60.0, gain: float = 1e-4) -> DataFrame:
    """(start, tree as text of sample numbers, score): from a joined and a partitioned tree, exchanges and new roots as long as
    the score falls by more than `gain`. Each step scores all neighbours in one pass over the sites, which are kept meanwhile, so
    that what they come from is read once."""
    sites = sites.select("pl").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _searched(sites, mu, het, least, gain)
    finally:
        sites.unpersist()


def _searched(sites: DataFrame, mu: float, het: float, least: float, gain: float) -> DataFrame:
    spark = sites.sparkSession
    d = distances(sites)
    if len(d) < 2:
        raise ValueError("a tree needs two samples and a site")
    starts = {"joined": T.neighbour_joining(d), "split": partition_tree(sites, list(range(len(d))), least)}
    out = []
    for name, tree in starts.items():
        tree = T.canonical(tree)
        score = score_trees(sites, [tree], mu, het).first()["score"]
        while near := T.neighbours(tree):
            best = score_trees(sites, near, mu, het).orderBy("score", "tree").first()
            if best["score"] >= score - gain:
                break
            tree, score = near[best["tree"]], best["score"]
        out.append((name, T.to_text(tree, [str(k) for k in range(len(d))]), float(score)))
    return spark.createDataFrame(out, "start string, tree string, score double")


def placements(sites: DataFrame, tree: T.Tree, names: list[str], mu: float = 80.0, het: float = 30.0) -> DataFrame:
    """Sites (contig, pos, ref, pl) with where on the tree they mutated: null_p, mut_p, null_base, null_base_p, mut_base,
    mut_alt, mut_conf_p, mut_loc, mut_smpl."""
    below = [",".join(names[k] for k in b) for b in T.branches(tree)]
    columns = ("null_p", "mut_p", "null_base", "null_base_p", "mut_base", "mut_alt", "mut_conf_p", "mut_loc")

    def work(frames):
        for f in frames:
            if not len(f):
                continue
            s = T.place(tree, _array(f["pl"]), mu, het)
            yield f[["contig", "pos", "ref"]].assign(**{k: s[k] for k in columns}, mut_smpl=[below[k] for k in s["mut_loc"]])

    kinds = {"null_base": "string", "mut_base": "string", "mut_alt": "string", "mut_loc": "int"}
    schema = "contig string, pos int, ref string, " + ", ".join(f"{k} {kinds.get(k, 'double')}" for k in columns) + ", mut_smpl string"
    return sites.select("contig", F.col("pos").cast("int").alias("pos"), "ref", "pl").mapInPandas(work, schema)


def annotate(calls: DataFrame, tree: T.Tree, names: list[str]) -> str:
    """The tree's text with the number of mutations as each branch's length."""
    counts = {r["mut_smpl"]: r["n"] for r in calls.groupBy("mut_smpl").agg(F.count("*").alias("n")).collect()}
    lengths = {frozenset(b): counts.get(",".join(names[k] for k in b), 0) for b in T.branches(tree)}
    return T.to_text(tree, names, lengths)


def compatibility(sites: DataFrame, block: int = 512) -> DataFrame:
    """(i, j, cost) of site numbers i <= j (column `site`, pl): the cheapest of the groups of samples that the two sites make;
    0 where they agree with one tree. Sites are paired block by block, so that a task holds two blocks."""
    n_blocks = int(((sites.agg(F.max("site")).first()[0] or 0) // block) + 1)
    own = F.floor(F.col("site") / block).cast("int")
    other = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    each = sites.select("site", "pl", own.alias("b")).withColumn("o", F.explode(other))
    each = each.select("site", "pl", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("site")
        pl = _array(f["pl"])
        site = f["site"].to_numpy()
        ref = (pl[:, :, 0] == 0).astype(int)
        rest = np.take_along_axis(pl, ref[:, :, None], 2)[:, :, 0]
        lo, hi = int(f["lo"].iloc[0]), int(f["hi"].iloc[0])
        left, right = np.flatnonzero(site // block == lo), np.flatnonzero(site // block == hi)
        out = []
        for i in left:
            cost = np.minimum(rest[i], rest[right])
            group = 2 * ref[i] + ref[right]
            sums = np.stack([np.where(group == g, cost, 0).sum(1) for g in range(4)], 1)
            seen = np.arange(4)[None, :] <= group.max(1)[:, None]
            best = np.where(seen, sums, np.inf).min(1)
            keep = site[right] >= site[i]
            out.append(pd.DataFrame({"i": site[i], "j": site[right][keep], "cost": best[keep].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "cost": []}).astype("int64")

    return each.groupBy("lo", "hi").applyInPandas(work, "i long, j long, cost long")


def is_singleton(pl: Column) -> Column:
    """Exactly one sample isn't surely the reference."""
    return F.size(F.filter(pl, lambda v: F.get(v, F.lit(0)) > 0)) == 1
