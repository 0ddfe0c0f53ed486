import glob
import os

import duckdb
import pytest

from kinfold import catalog

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert rows(catalog.queries()[name](spark, FOLDER).toPandas()) == rows(con.sql(catalog.oracle_sql()[name]).df())


def test_phred_family_of_all_chances(spark, tmp_path):
    """Chances up to 1, which larger part tables have, and above it: infinity, NaN and the sign of zero as in SQL."""
    keys = [0, 1, 96, 499_999, 500_000, 999_997, 999_998, 999_999, 1_000_000, 1_199_999]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = catalog.queries()["phred_family"](spark, str(tmp_path))
    want = con.sql(catalog.oracle_sql()["phred_family"])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_phred_of_no_chances(spark):
    from kinfold.functions import genome as G

    df = spark.createDataFrame([(x,) for x in (None, float("nan"), -0.5, 0.0, 0.1, 1.0, 1.5)], "p double")
    p = df["p"]
    got = [tuple(r) for r in df.select(G.phred(p), G.phred1m(p)).collect()]
    nan, inf = float("nan"), float("inf")
    want = [(None, None), (nan, nan), (nan, -1.76091259), (inf, 0.0), (10.0, 0.45757491), (0.0, inf), (-1.76091259, nan)]
    for g, w in zip(got, want, strict=True):
        assert g == w or g == pytest.approx(w, abs=1e-7, nan_ok=True)


def test_whole_overlaps(spark, con):
    """Against brute force over all ranges, contigs and ids."""
    import numpy as np

    from kinfold.plans import views

    g = con.sql(views.RANGES_SQL).df()
    contig, beg, end, ids = (g[c].to_numpy() for c in ("contig", "beg", "end", "id"))
    assert len(set(contig)) > 5
    shared = np.minimum(end[:, None], end) - np.maximum(beg[:, None], beg)
    hit = (contig[:, None] == contig) & (shared > 0)
    size = (end - beg).astype(float)
    got = {r.left_id: (r.n, r.shared) for r in catalog.queries()["overlap_count_whole"](spark, FOLDER).collect()}
    assert got == {int(i): (int(h.sum()), int(s[h].sum())) for i, h, s in zip(ids, hit, shared)}
    both = hit & (shared >= 0.3 * size[:, None]) & (shared >= 0.3 * size)
    at = (contig[:, None] == contig) & (beg[:, None] >= beg) & (beg[:, None] < end)
    part = [len({p for j in np.flatnonzero(h) for p in range(max(b, beg[j]), min(e, end[j]))}) / (e - b) for h, b, e in zip(hit, beg, end)]
    for mode, value in {"any": hit.any(1), "count": hit.sum(1), "fraction": part, "reciprocal": both.sum(1), "point": at.any(1)}.items():
        got = {r.id: r.value for r in catalog.queries()[f"bed_overlap_{mode}_whole"](spark, FOLDER).collect()}
        assert got == {int(i): round(float(v), 6) for i, v in zip(ids, value)}


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_merge_in_bins(spark):
    import random

    from kinfold.operators import regions

    rnd = random.Random(3)
    rows = [(c, b, b + rnd.choice((1, 3, 5, 400))) for c in "xy" for b in (rnd.randrange(3000) for _ in range(150))]
    want = []
    for c, b, e in sorted(rows):
        if want and want[-1][0] == c and b <= want[-1][2]:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([c, b, e])
    df = spark.createDataFrame(rows, "contig string, beg long, end long")
    for width in (7, 100, 1 << 20):
        assert sorted(map(list, regions.merge(df, width).collect())) == want
