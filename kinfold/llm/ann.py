"""Approximate nearest neighbours by largest inner product: query-aware collision counting.

A block of vectors is projected on `projections` directions, and the places are sorted along each. A query
looks at a window centred on its own projection in every one of the sorted arrays; vectors that are in many
windows collide often. Virtual rehashing widens the windows, which only adds places at both ends; vectors that
collide more often than the threshold are verified with the exact inner product. The search stops once the windows
are so wide that a vector as near as the k-th best one verified reaches the threshold with the probability CERTAIN.
Windows begin narrow, at what vectors of the block need to find their own nearest ones (from a sample of SAMPLE).

Windows find what is near in distance. So that this is what has the largest inner product, a block is split into bands
of similar lengths, in which vectors get a further component that makes them all as long as the band's longest one,
and queries that length and a zero. Bands go from the longest vectors to the shortest; one whose vectors are too short
to reach the k-th best product, whatever their direction, is not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The chance that a vector as near as the k-th best is verified, at least.
CERTAIN = 0.93
#: Vectors of a band that its windows are fitted to, at most.
SAMPLE = 64
#: Longest by shortest vector of a band, at most, unless that is less than an eighth of the block.
SPREAD = 1.25


def directions(dim: int, count: int, seed: int = 11) -> np.ndarray:
    """Random directions, orthogonal to one another as far as the dimension goes; unit variance of a unit step is dim."""
    rng = np.random.default_rng(seed + dim)
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(parts, 1)[:, :count] * np.sqrt(dim)


def lengths(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Lengths in units of the largest component, and that; squares neither overflow nor vanish."""
    largest = float(np.abs(vectors).max())
    return np.sqrt(((vectors / largest) ** 2).sum(1)), largest


class Band:
    """Sorted projections of vectors of similar lengths, made equally long by a further component. unit: in units of the longest."""

    def __init__(self, places: np.ndarray, unit: np.ndarray, longest: float, along: np.ndarray, least: int, k: int):
        self.places, self.longest, self.along, self.least = places, longest, along, least
        n, m = len(unit), along.shape[1]
        at = np.column_stack([unit, np.sqrt(np.maximum(1 - (unit**2).sum(1), 0))]) @ along
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        self.apart = 4.0 * float(np.abs(at).max()) + 1.0
        self.shift = np.arange(m) * self.apart
        self.sorted = (np.take_along_axis(at, self.order.T, 0) + self.shift).T.ravel()
        self.begin = np.arange(m) * n
        # What windows have to be for a sample's own nearest vectors, in their distances
        rows = np.linspace(0, n - 1, min(n, SAMPLE)).astype(np.int64)
        nearest = min(k, max(n - 1, 1))
        product = unit[rows] @ unit.T
        product[np.arange(len(rows)), rows] = -np.inf
        top = np.argpartition(-product, nearest - 1, axis=1)[:, :nearest]
        norm = np.maximum(np.sqrt((unit[rows] ** 2).sum(1)), 1e-300)
        far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(product, top, 1) / norm[:, None], 1e-12))
        off = np.abs(at[top] - ((unit[rows] / norm[:, None]) @ along[:-1])[:, None])
        need = np.partition(off, least - 1, axis=2)[:, :, least - 1]
        own = np.isfinite(far)
        self.reach = float(np.quantile((need / far)[own], CERTAIN)) if own.any() else 1.0
        self.start = self.reach * float(np.median(far.max(1)[np.isfinite(far.max(1))])) if own.any() else 1.0

    def candidates(self, query: np.ndarray, found: Callable, step: float = 1.06) -> None:
        """query: of unit length. found: gets places that collide enough, and tells the k-th best product so far in units of the longest vector."""
        n = len(self.places)
        center = query @ self.along[:-1] + self.shift
        counts = np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        half = self.start
        lo = hi = None
        while True:
            wide = min(half, self.apart / 2)
            a = np.searchsorted(self.sorted, center - wide) - self.begin
            b = np.searchsorted(self.sorted, center + wide, "right") - self.begin
            a, b = np.clip(a, 0, n), np.clip(b, 0, n)
            if lo is None:
                parts = [o[i:j] for o, i, j in zip(self.order, a.tolist(), b.tolist(), strict=True)]
            else:
                parts = [o[i:j] for o, i, j in zip(self.order, a.tolist(), lo.tolist(), strict=True)] + [o[i:j] for o, i, j in zip(self.order, hi.tolist(), b.tolist(), strict=True)]
            counts += np.bincount(np.concatenate(parts), minlength=n)
            lo, hi = a, b
            new = np.flatnonzero((counts >= self.least) & ~seen)
            seen[new] = True
            best = found(self.places[new])
            if half >= self.apart / 2 or half >= self.reach * np.sqrt(max(2 - 2 * best / self.longest, 0)):
                return
            half *= step
            step = min(step * 1.01, 2.0)


class Index:
    """The bands of a block, the longest vectors first."""

    def __init__(self, vectors: np.ndarray, projections: int, threshold: float, k: int):
        self.vectors = vectors
        self.size, self.scale = lengths(vectors)
        self.scaled = vectors / self.scale
        least = max(1, int(np.ceil(threshold * projections)))
        along = directions(vectors.shape[1] + 1, projections)
        order = np.argsort(-self.size, kind="stable")
        self.bands: list[Band] = []
        i = 0
        while i < len(order):
            longest = max(float(self.size[order[i]]), 1e-300)
            j = max(i + 1, int(np.searchsorted(-self.size[order], -longest / SPREAD, "right")))
            j = max(j, i + max(2 * k, len(order) // 8))
            if len(order) - j < max(2 * k, len(order) // 8):
                j = len(order)
            own = order[i:j]
            self.bands.append(Band(own, self.scaled[own] / longest, longest, along, least, k))
            i = j

    def search(self, query: np.ndarray, k: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k best found among `other`, and exact products; best first, ties to the earlier place."""
        size, scale = lengths(query[None])
        unit = query / scale / size[0]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        best = -np.inf
        had = 0

        def found(places: np.ndarray) -> float:
            nonlocal best, held, had
            places = places[other[places]]
            if len(places):
                product = self.scaled[places] @ unit
                near = product >= best
                held.append((places[near], product[near]))
                had += len(places)
                if had >= k:
                    p, v = (np.concatenate(c) for c in zip(*held, strict=True))
                    if len(v) >= k:
                        best = max(best, float(np.partition(v, len(v) - k)[len(v) - k]) - 1e-9)
                        held = [(p[v >= best], v[v >= best])]
            return best if np.isfinite(best) else -1e9

        for band in self.bands:
            if had >= k and band.longest * (1 + 1e-9) < best:
                break
            band.candidates(unit, found)
        if not held:
            return np.zeros(0, np.int64), np.zeros(0)
        places = np.sort(np.concatenate([p for p, _ in held]))
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.vectors[places] * query).sum(1)
        order = np.argsort(-score, kind="stable")
        return places[order], score[order]


def _search(k: int, projections: int, threshold: float) -> Callable:
    def work(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if data.num_rows and queries.num_rows:
            data = data.sort_by("vec_id")
            ids = data.column("vec_id").to_numpy()
            dim = data.column("dim")[0].as_py()
            flat = lambda table: table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            index = Index(flat(data), projections, threshold, k)
            for own, vector in zip(queries.column("vec_id").to_pylist(), flat(queries), strict=True):
                found, score = index.search(vector, k, ids != own)
                out += zip([own] * k, ids[found[:k]].tolist(), score[:k].tolist())
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return work


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, projections: int = 64, threshold: float = 0.6, block_rows: int = 16_384, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k nearest rows by inner product, in double precision: query_id, rank (from 1), vec_id, score.

    threshold: share of the projections in whose windows a vector has to be. The recall is set by CERTAIN, for vectors
    of any lengths and blocks of any size, and the tests measure it. Every row is indexed, in blocks of about block_rows
    by a hash of the id, so that a task's memory is bounded; queries meet every block in groups of about block_rows. A query's own row (same id) is no candidate.
    Nearest first, ties to the smaller id; a query with fewer candidates has fewer rows.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do null ids; vectors of
    different lengths are not compared. Repeated rows count as often as they occur; a query that is repeated is answered once
    (of several vectors of one id, the least in order is the query). Products that overflow are infinite, or last if not a number. Other columns are not read.
    Empty tables: no rows.
    """
    vec = F.transform(F.col("vec"), lambda x: x.cast("double"))

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec")).where("vec_id IS NOT NULL AND size(vec) > 0")
        df = df.select("vec_id", vec.alias("vec"))
        finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(finite & F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))

    data = valid(vectors)
    asked = valid(queries).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    n, q = data.count(), asked.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-q // block_rows))
    data = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    data = data.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "block", "group"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k, projections, threshold), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
