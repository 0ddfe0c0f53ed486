"""Nearest neighbours on odd rows: repeats, ties, huge and tiny components, clashing columns; and how much is verified."""

import numpy as np
from pyspark.sql import functions as F

from kinfold.llm import ann


def test_repeats_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    own = rng.normal(size=(60, 8))
    own[30:40] = own[20:30]
    rows = [(i, v.tolist()) for i, v in enumerate(own)]
    df = spark.createDataFrame([*rows, rows[0], rows[0], rows[7]], "vec_id long, embedding array<double>")
    df = df.select("*", *(F.lit(1).alias(c) for c in ("vec", "dim", "block", "group", "rank", "score", "query_id")))
    got = ann.nearest(df, df.where("vec_id IN (0, 20, 25)"), k=5).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in (0, 20, 25) for k in range(1, 6)]
    for q in (0, 20, 25):
        twice = [*range(60), 7] + ([] if q == 0 else [0, 0])
        want = sorted((-float((own[q] * own[i]).sum()), i) for i in twice if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(2)
    own = rng.normal(size=(50, 4)) * 10.0 ** rng.integers(-300, 150, (50, 1))
    own[3] = [1e308, 1e308, -1e308, 1e308]
    own[4] = [5e-324, 0, 0, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 10 = 0"), k=3).collect()
    assert len(got) == 15 and all(r.rank <= 3 for r in got)


def test_few_are_verified_where_vectors_are_clustered():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(200, 64))
    own = centers[rng.integers(0, 200, 8000)] + 0.3 * rng.normal(size=(8000, 64))
    own /= np.sqrt((own**2).sum(1))[:, None]
    index = ann.Index(own, 64, 0.6, 20)
    told = []
    for band in index.bands:
        find = band.candidates
        band.candidates = lambda query, found, find=find: find(query, lambda places: told.append(len(places)) or found(places))
    ids = np.arange(len(own))
    hit = 0
    for q in range(0, 8000, 200):
        found, _ = index.search(own[q], 20, ids != q)
        score = own @ own[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20].tolist()) & set(found[:20].tolist()))
    assert hit >= 0.95 * 20 * 40 and sum(told) < 0.05 * 8000 * 40
